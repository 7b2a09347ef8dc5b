"""Truth tables of single operators: quirks and edges that the queries' tables do not show."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import phonetic
from scriptorium.functions import text as X
from scriptorium.operators import fuzzy as Z
from scriptorium.operators import intervals as I
from scriptorium.operators import learning as L
from scriptorium.operators import logs as G
from scriptorium.operators import ranking as R
from scriptorium.operators import prompts as P
from scriptorium.operators import render as N
from scriptorium.operators import transcripts as T
from scriptorium.sources import files
from scriptorium.streaming import incremental

DAY = 86_400_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize(spark):
    cases = {"": "", "Don't  STOP!": "don't stop", "'tis 'quoted' x'": "tis 'quoted' x", "café ﬁn": "café fin", "a ' b": "a b"}
    assert {k: one(spark, X.normalize_text(F.lit(k))) for k in cases} == cases
    assert one(spark, X.normalize_text(F.lit(None).cast("string"))) == ""


def test_word_errors(spark):
    rows = [("", ""), ("", "a b"), ("a b", ""), ("a b c", "a x c d"), ("a b", "b"), ("a", "a")]
    found = spark.createDataFrame(rows, "r string, h string").select(X.word_errors(F.col("r"), F.col("h")).alias("e")).select("e.*").collect()
    assert [(r.wer, r.substitutions, r.insertions, r.deletions) for r in found] == [(0, 0, 0, 0), (float("inf"), 0, 2, 0), (1, 0, 0, 2), (2 / 3, 1, 1, 0), (0.5, 0, 0, 1), (0, 0, 0, 0)]


def test_scores_at_the_edges_of_recency(spark):
    now = 100 * DAY
    rows = [(1, now - 60 * DAY), (2, now - 61 * DAY), (3, now + 1), (4, None)]
    e = spark.createDataFrame(rows, "id long, last_seen_us long").selectExpr("*", "'A' as tier", "0.0D as boost_weight", "array('Run') as contexts")
    assert [r.s for r in e.select(R.bias_score(now, "run").alias("s")).collect()] == [pytest.approx(x) for x in (0.015, 0.0075, 0.0075, 0.0075)]


def test_tier_a_passes_filters_but_not_exclusions(spark):
    rows = [(1, "a", "A", ["x"]), (2, "b", "C", ["x"]), (3, "c", "C", ["y"]), (4, "d", "H", ["y"]), (5, "e", "A", ["z"])]
    e = spark.createDataFrame(rows, "id long, canonical string, tier string, contexts array<string>").selectExpr("*", "1.0D as boost_weight", "cast(null as long) as last_seen_us")
    found = R.select_bias_list(e, 0, min_tier="D", include_contexts=("Y",), exclude_contexts=("z",))
    assert sorted(r.id for r in found.collect()) == [1, 3]


def test_time_carries(spark):
    times = {3661.9996: "01:01:02,000", -1.0: "00:00:00,000", float("nan"): "00:00:00,000", 0.0005: "00:00:00,000", 59.5: "00:00:59,500"}
    for seconds, text in times.items():
        assert one(spark, N.time_text(F.lit(seconds), ",")) == text
    assert one(spark, N.short_time(F.lit(75.0))) == "01:15"


def test_markdown_and_unknown_format(spark):
    assert one(spark, N.escape_markdown(F.lit("a*b_[c]"))) == r"a\*b\_\[c\]"
    with pytest.raises(ValueError):
        N.render(spark.range(1), "docx")


def test_prompt_budget(spark):
    alias = lambda a, wrong=False: (a, wrong)
    rows = [(1, "Alpha", "Alpha", "person", 1.0, [alias("alpha"), alias("Al"), alias("Ally")], []), (2, "Beta", None, "ORG", 3.0, [alias("Bta", True)], []), (3, "Gamma", "G.", "person", 2.0, [], None)]
    entries = spark.createDataFrame(rows, "id long, canonical string, display string, type string, boost_weight double, aliases array<struct<alias:string,is_common_misspelling:boolean>>, contexts array<string>")
    said = lambda *a: P.term_prompt(entries, *a).collect()[0].prompt
    assert said(100) == "You may hear proper nouns: [People: Gamma, Alpha, Al] [Organizations: Beta]"
    assert said(100, "tech").startswith("This is a technical discussion about software development. You may hear: [People")
    assert said(10) == "You may hear proper nouns: [People: Gamma]" and said(3) == ""
    assert P.term_prompt(entries.where("false")).collect()[0].prompt == "" and P.correction_table(entries.where("false")).collect()[0].block == ""
    lines = P.correction_table(entries, 2).collect()[0].block.split("\n")
    assert lines[7:9] == ["| Beta | ORG |  |  |", "| Gamma | person |  | G. |"] and lines[10] == "NEAR-MISS RULE:"
    for bad in (lambda: P.term_prompt(entries, 0), lambda: P.correction_table(entries, 0)):
        with pytest.raises(ValueError):
            bad()


def test_gap_exactly_at_the_threshold_does_not_merge(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.5, 2.0), (1, 2.25, 3.0)], "grp long, start double, end double")
    assert sorted((r.start, r.end) for r in I.merge_gaps(rows).collect()) == [(0.0, 1.0), (1.5, 3.0)]


def test_overlaps_zero_lengths_and_batches(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 4.0, 6.0), (1, 3, 5.0, 5.0), (1, 4, 9.0, 12.0)], "grp long, id long, start double, end double")
    assert [r.id for r in I.drop_overlapping(rows).orderBy("segment").collect()] == [1, 3, 4]
    segs = spark.createDataFrame([(1, i, float(i * 20), float(i * 20 + 20)) for i in range(5)], "transcript long, segment long, start double, end double")
    assert [r.batch for r in I.duration_batches(segs).orderBy("segment").collect()] == [0, 0, 0, 1, 1]


def test_marks_spread_left_through_capitals(spark):
    words = [("so", 0.9), ("Anna", 0.9), ("Maria", 0.9), ("Xu", 0.2), ("B", 0.95), ("came", 0.9)]
    column = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(c).alias("confidence")) for w, c in words])
    assert one(spark, T.mark_spans(column)) == "so [?Anna Maria Xu B?] came"


def test_gate(spark):
    words = lambda *ws: F.array(*[F.struct(F.lit(w).alias("word"), F.lit(c).alias("confidence")) for w, c in ws])
    assert one(spark, X.gate_correction(words(("Hello,", 0.9), ("world", 0.9)), F.lit("hello WORLD"))) is True
    assert one(spark, X.gate_correction(words(("Hello", 0.9), ("world", 0.9)), F.lit("hello word"))) is False
    assert one(spark, X.gate_correction(words(("hello", 0.1)), F.lit("other"))) is True


def test_candidates_and_sounds(spark):
    assert phonetic.double_metaphone("Smith") == ("SM0", "XMT") and phonetic.double_metaphone("Knight") == ("NT", "")
    assert phonetic.double_metaphone("Philip")[0] == "FLP" and phonetic.double_metaphone("Schmidt")[0] == "XMT"
    forms = spark.createDataFrame([(1, "stravo", "canonical", 0), (2, "garmo", "alias", 1), (3, "phone", "canonical", 0)], "entry_id long, form string, kind string, ord int")
    queries = spark.createDataFrame([("Stravvo",), ("garmo",), ("fone",)], "query string")
    found = {r.query: (r.entry_id, r.match_type) for r in Z.best_match(queries, forms, 0.3).collect()}
    assert found["garmo"] == (2, "exact_alias") and found["Stravvo"][0] == 1 and found["fone"] == (3, "metaphone")


def test_codes_of_published_examples():
    """Examples that come with public versions of the algorithm; codes are not cut."""
    known = {
        "maurice": ("MRS", ""), "aubrey": ("APR", ""), "cambrillo": ("KMPRL", "KMPR"), "heidegger": ("HTKR", ""), "katherine": ("K0RN", "KTRN"), "richard": ("RXRT", "RKRT"),
        "bob": ("PP", ""), "walter": ("ALTR", "FLTR"), "bartosz": ("PRTS", "PRTX"), "filipowicz": ("FLPTS", "FLPFX"), "thumb": ("0M", "TM"), "knight": ("NT", ""), "laugh": ("LF", ""),
    }
    assert {w: phonetic.double_metaphone(w) for w in known} == known


def test_edit_pairs_lose_none(spark):
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(90)})
    forms = spark.createDataFrame([(i, w, "canonical", 0) for i, w in enumerate(words)], "entry_id long, form string, kind string, ord int")
    found = {(r.query, r.form) for r in Z.edit_pairs(forms.select(F.col("form").alias("query")), forms).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    assert found == {(a, b) for a in words for b in words if 1 <= distance(a, b) <= 3}


def test_similarity(spark):
    assert one(spark, Z.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(8 / 13)


def test_logs_skip_broken_lines(spark):
    lines = spark.createDataFrame([("s1", '{"event": "chunk_transcribed", "start_time": 1.0, "lowest_conf_words": [["a", 0.2]]}'), ("s1", '{"event": "chunk_transcribed", "start_time": 1.0}'), ("s1", "{broken"), ("s1", " ")], "session string, line string")
    events = G.read_lines(lines)
    assert events.count() == 2 and G.once(events).count() == 1


def test_queue_merges_and_promotes(spark):
    seen = spark.createDataFrame([("Ann", "a", 1), ("ann", "b", 2), ("Bob", "a", 3), ("ANN", "b", 4)], "term string, source string, pos long")
    pending = L.queue(seen, F.lower("term"))
    assert [(r.id, r.canonical, r.occurrences) for r in L.promoted(pending).collect()] == [("discovered-ann", "Ann", 3)]
    assert [r.key for r in L.still_pending(pending).collect()] == ["bob"]
    assert {r.key: r.occurrences for r in L.merged(pending, pending).collect()} == {"ann": 6, "bob": 2}


def test_files(spark, tmp_path):
    entry = {"canonical": "Alpha", "type": "org", "tier": "A", "boost_weight": 2.0, "aliases": ["Al"], "pronunciations": [{"ipa": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps([entry, {"canonical": " "}]))
    (tmp_path / "b.json").write_text(json.dumps({"entries": [entry]}))
    assert files.dictionary_json(spark, str(tmp_path / "a.json")).count() == 1 and files.dictionary_json(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "tech.txt").write_text("# note\nspark\n\nSome Name\n")
    assert {(r.term, r.domain, r.type) for r in files.vocabulary(spark, str(tmp_path / "tech.txt")).collect()} == {("spark", "tech", "jargon"), ("Some Name", "tech", "jargon")}
    (tmp_path / "t.json").write_text(json.dumps({"version": "1.0", "segments": [{"id": 0, "start": 0.0, "end": 1.0, "speaker": " ", "text": "x"}, {"id": 1, "start": 2.0, "end": 1.0}]}))
    found = files.transcript_segments(files.transcripts(spark, str(tmp_path / "t.json"))).collect()
    assert [(r.id, r.speaker) for r in found] == [(0, None)]
    assert files.profile('{"name": "run", "priority_boost": {}}').max_entries == 150 and files.profile("{") is None
    assert files.valid_domain("ok-1") and not files.valid_domain("../x")
    assert len(files.file_digest(spark, str(tmp_path / "a.json")).first().digest) == 16


def test_streams(spark, tmp_path):
    schema = "key string"
    (tmp_path / "in").mkdir()
    for i, keys in enumerate((["a", "b"], ["a", "c"], ["a", "b"])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"key": k}) for k in keys))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = incremental.promotions(stream).writeStream.format("memory").queryName("promoted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r.key, r.occurrences) for r in spark.table("promoted").collect()] == [("a", 3)]


def plain_chunks(rows, cap, overlap, between, hard, rate):
    """(start, length) of one recording's chunks, segment after segment and window after window."""
    out = []
    for i, (begins, ends, difficulty, total) in enumerate(sorted(rows)):
        if i and between > 0:
            early = max(0.0, begins - between)
            begins = begins if out and early < out[-1][0] + out[-1][1] - 0.1 else early
        if i < len(rows) - 1 and between > 0:
            ends = min(total, ends + between)
        if ends - begins <= 0:
            continue
        most = min(cap, hard) if difficulty > 0.35 else cap
        start = begins
        while start < ends:
            stop = min(start + most, ends)
            length = (min(int(stop * rate), int(total * rate)) - int(start * rate)) / rate
            if length <= 0:
                break
            out.append((start, length))
            if stop >= ends:
                break
            start = max(stop - min(overlap, most - 1.0), start + 1.0)
    return [(round(a, 6), round(b, 6)) for a, b in out]


@pytest.mark.parametrize("cap, overlap, between, hard, rate", [(60.0, 2.0, 0.25, 30.0, 16_000), (4.0, 1.5, 0.0, 3.0, 100), (3.0, 2.5, 0.5, 9.0, 8), (2.0, 0.0, 5.0, 1.0, 1)])
def test_chunks_by_a_plain_loop(spark, cap, overlap, between, hard, rate):
    import random

    from scriptorium.operators import intervals as I

    rng = random.Random(rate)
    rows = [(g, a := float(rng.randrange(0, 300)) / 2, a + rng.choice([-1.0, 0.0, 0.05, 1.0, 3.0, 20.0, 150.0]), rng.choice([0.1, 0.9]), rng.choice([100.0, 130.0])) for g in range(30) for _ in range(rng.randrange(1, 9))]
    rows = list({(g, a): (g, a, b, d, {h: t for h, *_, t in rows}[g]) for g, a, b, d, _ in rows}.values())
    odd = [(900, None, 1.0, 0.1, 9.0), (901, 0.0, 1.0, None, 9.0), (902, 0.0, 1.0, 0.1, None), (None, 0.0, 1.0, 0.1, 9.0)]
    found = {}
    for r in I.chunks(spark.createDataFrame(rows + odd, "grp long, start double, end double, difficulty double, total double"), cap=cap, overlap=overlap, between=between, hard=hard, rate=rate).orderBy("grp", "chunk").collect():
        found.setdefault(r.grp, []).append((round(r.start, 6), round(r.length, 6)))
    want = {g: c for g in {r[0] for r in rows} if (c := plain_chunks([r[1:] for r in rows if r[0] == g], cap, overlap, between, hard, rate))}
    one = plain_chunks([(0.0, 1.0, 0.0, 9.0)], cap, overlap, between, hard, rate)
    assert found == want | {901: one, None: one}
    with pytest.raises(ValueError, match="below the cap"):
        I.chunks(None, cap=2.0, overlap=2.0)


def test_difficulty_by_speech(spark):
    from scriptorium.operators import intervals as I

    rows = spark.createDataFrame([([0.2], [0.5, 1.0]), ([0.2], []), ([0.4], None), ([], [0.0])], "s array<double>, p array<double>")
    assert [round(r.d, 9) for r in rows.select(I.difficulty_of(F.col("s"), F.col("p")).alias("d")).collect()] == [0.15625, 0.0, 1.0, 0.5]


def test_lines_of_a_kind_and_their_typed_tables(spark):
    from scriptorium.operators import events as V

    rows = spark.createDataFrame([("s", "2001", 1, [("Ab", 0.5), ("c", None)])], "session string, ts string, id long, words array<struct<word:string,probability:double>>")
    lines = V.lines(rows, "chunk_transcribed", {"chunk_id": F.col("id"), "start_time": F.lit(1.23456), **V.of_words(F.col("words"))})
    lines = lines.unionByName(V.lines(rows, "config", {"x": F.lit(1)})).unionByName(spark.createDataFrame([("s", t) for t in ("{bad", "[1]", " ", '{"event":"odd"}', '{"a":1}', "null", None)], "session string, line string"))
    events = V.parsed(lines)
    (chunk,) = V.of_kind(events, "chunk_transcribed").collect()
    assert (chunk.chunk_id, chunk.start_time, chunk.duration, chunk.word_count, chunk.low_conf_pct, chunk.avg_confidence) == (1, 1.23, None, 2, 50.0, 0.75)
    assert [(r.word, r.probability) for r in V.lowest_words(V.of_kind(events, "chunk_transcribed")).collect()] == [("ab", 0.5), ("c", 1.0)]
    assert V.of_kind(events, "config").count() == 1 and {r.field for r in V.told(events).collect()} == set(V.FIELDS["chunk_transcribed"]) - {"duration"}
    assert [tuple(r) for r in V.account(events).collect()] == [("s", 7, 4, 1)]
    with pytest.raises(ValueError, match="unknown kind"):
        V.lines(rows, "nothing", {})
    with pytest.raises(ValueError, match="no fields"):
        V.lines(rows, "error", {"x": F.lit(1)})
