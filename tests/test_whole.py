"""Registered queries do the whole job: each is compared with a plain version over all rows and whole texts.

Queries that SQL cannot state over all rows are compared here with a brute-force version instead.
"""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import edits as B
from scriptorium.functions import text as X
from scriptorium.operators import fuzzy as Z
from scriptorium.plans import catalog
from scriptorium.sources import relations as S
from test_queries import FOLDER, TABLES, rows


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["metaphone_join", "match_candidates", "best_match"])
def test_matches_come_from_every_entry(name, spark):
    found = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert {i % 10 for i in found.entry_id} == set(range(10))


def test_best_match_is_the_best_of_all_entries(spark):
    queries = catalog.QUERIES["match_candidates"](spark, FOLDER).select("query").distinct()
    every = Z.forms(S.entries(spark, FOLDER), S.aliases(spark, FOLDER))
    ways = Z.exact(queries, every).unionByName(Z.by_sound(queries, every)).unionByName(Z.by_edits(queries, every)).toPandas()
    best = ways.groupby("query").confidence.max()
    got = catalog.QUERIES["best_match"](spark, FOLDER).toPandas().set_index("query").confidence
    assert got.to_dict() == best[best >= 0.5].to_dict()


def plain_edits(ref, hyp):
    """(distance, substitutions, insertions, deletions); of equal ones substitution, then insertion."""
    row = [(j, 0, j, 0) for j in range(len(hyp) + 1)]
    for i, a in enumerate(ref, 1):
        old, row = row, [(i, 0, 0, i)]
        for j, b in enumerate(hyp, 1):
            (d, s, n, x), up, left = old[j - 1], old[j], row[j - 1]
            steps = [(d + 1, s + 1, n, x), (left[0] + 1, left[1], left[2] + 1, left[3]), (up[0] + 1, up[1], up[2], up[3] + 1)]
            row.append(old[j - 1] if a == b else min(steps, key=lambda c: c[0]))
    return row[-1]


def test_edits_by_a_plain_table():
    rng = random.Random(3)
    for _ in range(600):
        a, b = (["".join(rng.choice("abé") for _ in range(rng.randint(1, 2))) for _ in range(rng.choice([0, 1, 3, 9, 40]))] for _ in "ab")
        assert X._edits(a, b) == plain_edits(a, b)
        assert X._distance("".join(a), "".join(b)) == plain_edits("".join(a), "".join(b))[0]


@pytest.mark.parametrize("band, kept", [(64, 1 << 26), (1, 1 << 26), (1, 8), (3, 40)])
def test_edits_of_alike_and_unlike_lists_by_a_plain_table(band, kept, monkeypatch):
    """Narrow bands have to be widened, and columns that are not kept are made again."""
    monkeypatch.setattr(X, "_BAND", band)
    monkeypatch.setattr(X, "_KEPT_BITS", kept)
    rng = random.Random(band * kept)
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        a, b = ([rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 17, 60]))] for _ in "ab")
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.9]
        assert X._edits(a, b) == plain_edits(a, b)


def test_alike_lists_cost_their_length_times_their_distance():
    rng = random.Random(2)
    a = [str(rng.randrange(4_000)) for _ in range(30_000)]
    b = [x for x in a if rng.random() > 0.002]
    b[100:100] = ["new"] * 20
    made = []
    columns, X._Table.columns = X._Table.columns, lambda self, *args: (made.append((args[1] - args[0]) * self.width), columns(self, *args))[1]
    try:
        assert X._edits(a, b) == (len(a) - len(b) + 40, 0, 20, len(a) - len(b) + 20)
    finally:
        X._Table.columns = columns
    assert sum(made) < 12 * len(a) * 100


@pytest.fixture(scope="module")
def long_pair(spark, tmp_path_factory):
    """Two documents of a language that differ only far behind their thirtieth word."""
    folder = str(tmp_path_factory.mktemp("pair"))
    same = " ".join(f"w{i}" for i in range(50))
    S.texts(spark, FOLDER).limit(0).unionByName(spark.createDataFrame([(1, f"{same} one é two"), (2, f"{same} one e two three")], "doc_id long, text string").withColumn("lang", F.lit("en")), allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_error_rates_of_whole_texts(spark, long_pair):
    (row,) = catalog.QUERIES["wer_pairs"](spark, long_pair).collect()
    assert (row.n_ref, row.n_hyp, row.substitutions, row.insertions, row.deletions) == (53, 54, 1, 1, 0)
    (row,) = catalog.QUERIES["wer_averages"](spark, long_pair).collect()
    assert row.macro == row.micro == round(2 / 53, 6)


def test_character_rates_by_a_plain_table(spark, sql):
    """On the pairs of plain letters, for which a library counts the same edits."""
    pairs = catalog.QUERIES["cer_pairs"](spark, FOLDER).toPandas()
    norm = catalog.ORACLES["wer_counts"].split("SELECT doc_id, len")[0]
    want = sql.execute(norm + " SELECT doc_id, round(levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', '')) / length(replace(ref, ' ', '')), 6) AS cer FROM pairs WHERE regexp_matches(ref || hyp, '^[a-z0-9'' ]+$') AND ref <> ''").df()
    assert len(want) and rows(pairs[pairs.doc_id.isin(want.doc_id)]) == rows(want)


def plain_spans(text):
    for found in re.finditer(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text):
        if found.start() and not text[: found.start()].rstrip(" \t\n").endswith((".", "!", "?")):
            yield found.group(), found.start()


def test_spans_of_every_document(spark):
    texts = S.texts(spark, FOLDER).select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r in texts for x in plain_spans(r.text or ""))
    assert any(not r.text.isascii() and list(plain_spans(r.text)) for r in texts if r.text)
    assert sorted(map(tuple, catalog.QUERIES["capitalized_spans"](spark, FOLDER).collect())) == want


def test_spans_beside_letters_of_other_scripts(spark):
    texts = ["in Frané Paris", "am Müller\u00a0Weg Bonn", "où Ivan\u00a0Petrov, éPaul", "я Anna Maria 😀 Rom", "x Ab1 Cd_ Ef"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, Z.capitalized_spans(docs).collect())) == sorted((i, *x) for i, t in enumerate(texts) for x in plain_spans(t))


def test_character_rates_of_every_pair(spark, long_pair):
    (row,) = catalog.QUERIES["cer_pairs"](spark, long_pair).collect()
    letters = "".join(f"w{i}" for i in range(50))
    assert row.cer == round(plain_edits(letters + "oneétwo", letters + "oneetwothree")[0] / len(letters + "oneétwo"), 6)
    pairs, rates = (catalog.QUERIES[q](spark, FOLDER).select("doc_id").toPandas().doc_id for q in ("wer_pairs", "cer_pairs"))
    assert sorted(pairs) == sorted(rates)


def test_followers_within_and_between_chunks(spark):
    from scriptorium.operators import order

    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None])) for k in rng.sample(range(-300_000, 300_000), 400)] + [(None, "a"), (1 << 40, "b")]
    found = {(r.g, r.k): r.next for r in order.followers(spark.createDataFrame(rows, "k long, g string"), "g", "k").collect()}
    for g in ("a", "b", None):
        keys = sorted(k for k, h in rows if h == g and k is not None)
        assert [found[g, k] for k in keys] == [*keys[1:], None]
    assert len(found) == 401


def test_rolling_context_looks_past_blank_segments(spark):
    from scriptorium.operators import transcripts as T

    rows = [(1, i, "" if i % 7 else f"w{i}", 0.0) for i in range(1, 900)]
    found = {r.segment: r.context for r in T.rolling_context(spark.createDataFrame(rows, "transcript long, segment long, text string, start double"), most_chars=10_000).collect()}
    said = [(i, t) for _, i, t, _ in rows if t]
    assert all(found[i] == " ".join([t for j, t in said if j < i][-100:]) for _, i, _, _ in rows)


def test_pairs_that_are_too_long_have_no_rates(spark, monkeypatch):
    rows = spark.createDataFrame([("a b", "a c"), ("x " * 50_001 + "x", "a")], "ref string, hyp string")
    first, second = rows.select(X.word_errors(F.col("ref"), F.col("hyp")).alias("e")).select("e.*").collect()
    assert (first.wer, first.substitutions) == (0.5, 1) and second.wer is None and second.n_ref == 50_002


def test_rates_of_documents_of_any_length(spark, tmp_path):
    """Pairs around and beyond 50,000 words, alike and unlike, have all counts."""
    words = [f"w{i}" for i in range(50_300)]
    texts = [(1, "en", words[:49_999]), (2, "en", words), (3, "en", ["new", *words[:40_000], *words[40_100:], "x", "y"]), (4, "fr", words[::-1]), (5, "fr", ["one", *words[:99]])]
    frame = spark.createDataFrame([(i, lang, " ".join(w)) for i, lang, w in texts], "doc_id long, lang string, text string")
    S.texts(spark, FOLDER).limit(0).unionByName(frame, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES["wer_pairs"](spark, str(tmp_path)).collect()}
    assert found[1] == (301 / 49_999, 0, 301, 0, 49_999, 50_300)
    assert found[2] == (103 / 50_300, 0, 3, 100, 50_300, 50_203)
    assert found[4][4:] == (50_300, 100) and found[4][1] + found[4][3] == 50_299 and found[4][2] == 0
    rates = {r.lang: r.micro for r in catalog.QUERIES["wer_averages"](spark, str(tmp_path)).collect()}
    assert rates["en"] == round(404 / 100_299, 6)


@pytest.mark.parametrize("kept, rows_", [(1 << 26, 0), (8, 0), (8, 200), (500, 90), (3_000, 1 << 30)])
def test_edits_with_little_memory_by_a_plain_table(kept, rows_, monkeypatch):
    """Columns made again from pieces within pieces, words' rows made from their places."""
    monkeypatch.setattr(X, "_BAND", 1)
    monkeypatch.setattr(X, "_KEPT_BITS", kept)
    monkeypatch.setattr(X, "_ROW_BITS", rows_)
    rng = random.Random(kept + rows_)
    for _ in range(150):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        a, b = ([rng.choice(letters) for _ in range(rng.choice([1, 2, 9, 40, 150]))] for _ in "ab")
        if rng.random() < 0.3:
            b = [x for x in a if rng.random() < 0.9] or ["q"]
        assert X._edits(a, b) == plain_edits(a, b)


@pytest.mark.parametrize("few, blocks, size, step", [(24, 1 << 13, 1 << 26, 18), (1, 40, 1 << 26, 0), (1, 1 << 13, 9_000, 0), (10_000, 3, 1 << 26, 0)])
def test_edits_of_many_pairs_at_a_time(few, blocks, size, step, monkeypatch):
    """Batches give what single pairs give; a batch's pairs end at different steps and have blocks of their own."""
    for name, value in (("_FEW", few), ("_BLOCKS", blocks), ("_BYTES", size), ("_STEP", step)):
        monkeypatch.setattr(B, name, value)
    rng = random.Random(blocks + size)
    lengths = [1, 2, 63, 64, 65, 127, 128, 129, 200]
    pairs = [tuple([rng.choice(letters) for _ in range(rng.choice(lengths))] for _ in "ab") for letters in ["ab", "abcdefgh", "aé😀퟿zyxwvu"] * 50]
    pairs += [(a, [x for x in a if rng.random() < 0.9] or ["q"]) for a, _ in pairs[:30]]
    refs, hyps = zip(*pairs)
    alone = []
    X_edits = lambda r, h: (alone.append(1), X._edits(r, h))[1]
    assert [tuple(x) for x in B.counted(refs, hyps, B.words_coded, X_edits, True)] == [X._edits(a, b) for a, b in pairs]
    assert len(alone) < 60 and (step or size < 10_000 or not alone)
    want = [(X._distance("".join(a), "".join(b)),) for a, b in pairs]
    assert B.counted(["".join(a) for a in refs], ["".join(b) for b in hyps], B.characters_coded, lambda r, h: (X._distance(r, h),), False) == want
    assert B.counted([], [], B.words_coded, X._edits, True) == []


def test_rates_count_pairs_together(spark, monkeypatch):
    """One batch for all pairs of a batch of rows, empty sides and nulls beside them."""
    seen = []
    counted = B.counted
    monkeypatch.setattr(B, "counted", lambda refs, *args: (seen.append(len(refs)), counted(refs, *args))[1])
    refs, hyps = pd.Series(["abc", "", None, "xyz", ""] * 40), pd.Series(["ab", "q", "a", "xyzzy", ""] * 40)
    assert X.character_edits.func(refs, hyps).astype(object).where(lambda v: v.notna(), None).tolist() == [1, 1, None, 2, 0] * 40
    words = [["a", "b"], [], ["a"], ["a", "b", "c"]]
    said = [["a", "c"], ["a"], [], ["b", "c", "d"]]
    got = X.word_edits.func(pd.Series([np.array(w, object) for w in words]), pd.Series([np.array(w, object) for w in said]))
    assert got.to_numpy().tolist() == [[1, 1, 0, 0], [1, 0, 1, 0], [1, 0, 0, 1], [2, 0, 1, 1]]
    assert seen == [80, 2]
