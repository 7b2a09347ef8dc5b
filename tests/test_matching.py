"""Spans, anchors and sounds against plain loops over all rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import random

import pytest

from scriptorium.functions import phonetic
from scriptorium.operators import fuzzy as Z
from scriptorium.operators import phonetic_join
from scriptorium.plans import fuzzy_queries

FORMS = [(1, "ron chernow", "canonical", 0), (2, "suunto", "canonical", 0), (2, "sunto watch", "alias", 1), (3, "navesink", "canonical", 0), (4, "garmin", "canonical", 0)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def test_similarity_by_a_plain_table(spark):
    words = ["", "a", "strava", "stravva", "ron chernow", "churn now", "ábc", "naïve cafés", "x" * 70, "xy" * 40]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", Z.similarity("a", "b").alias("s")).collect()
    assert all(abs(r.s - ratio(r.a, r.b)) < 1e-12 for r in rows)


def plain_sound(query, form):
    """The confidence by the first combination of codes that meets, or None below its least value."""
    words = lambda t: [c for w in re.split(r"[ \t\n\x0b\f\r]+", t) if len(c := re.sub("[^a-zA-Z]", "", w)) >= 2]
    theirs = [phonetic.double_metaphone(w) for w in words(form)]
    for w in words(query):
        p, a = phonetic.double_metaphone(w)
        for mine, k, weight, least in ((p, 0, 0.8, 0.35), (p, 1, 0.7, 0.35), (a, 0, 0.7, 0.35), (a, 1, 0.6, 0.3)):
            if mine and any(mine == t[k] for t in theirs):
                confidence = weight * ratio(query, form)
                return confidence if confidence > least else None
    return None


def plain_candidates(queries, rows, most):
    """query: [(place, entry, form, confidence, match)], by every strategy over all forms."""
    out = {}
    for query in queries:
        q, best = query.strip(" ").lower(), {}

        def offer(entry, confidence, way, form, kind, best=best):
            if entry not in best or (-confidence, way, form) < best[entry][:3]:
                best[entry] = (-confidence, way, form, kind)

        for kind, confidence, match in (("canonical", 1.0, "exact"), ("alias", 0.98, "exact_alias")):
            if found := [e for e, f, k, _ in rows if k == kind and f == q]:
                offer(max(found), confidence, 0, q, match)
        for entry, form, kind, _ in rows:
            if (c := plain_sound(q, form)) is not None:
                offer(entry, c, 1, form, "metaphone")
            if abs(len(q) - len(form)) <= 3 and 1 <= (d := edits(q, form)) <= 3 and (c := {"canonical": 0.6, "alias": 0.55}[kind] * (1 - d / max(len(q), len(form)))) > 0.3:
                offer(entry, c, 2, form, "edit_distance")
        order = sorted(best.items(), key=lambda x: (x[1][0], x[1][1], x[0]))[:most]
        out[query] = [(i + 1, e, form, round(-c, 9), match) for i, (e, (c, _, form, match)) in enumerate(order)]
    return {q: v for q, v in out.items() if v}


def found_candidates(queries, rows, most):
    out = {}
    for r in Z.candidates(queries, rows, most).collect():
        out.setdefault(r.query, []).append((r.place, r.entry_id, r.form, round(r.confidence, 9), r.match_type))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("most", [1, 3, 10])
def test_candidates_of_a_dictionary_by_a_plain_loop(spark, most, monkeypatch):
    """The whole top of each query, with its ties, cut into many blocks."""
    monkeypatch.setattr(phonetic_join, "FORMS", 7)
    monkeypatch.setattr(phonetic_join, "QUERIES", 3)
    rng = random.Random(most)
    names = ["smith", "smyth", "schmidt", "kathryn", "catherine", "philip", "filip", "knight", "nite", "wright", "x", "ab", "bob", "bobby", "josé", "xavier", "thomas", "tomas"]
    forms = sorted({(e, " ".join(rng.choices(names, k=rng.choice([1, 2, 3]))) + rng.choice(["", "", f" {e}"]), rng.choice(["canonical", "alias"])) for e in range(60) for _ in range(2)})
    forms = [(e, f, k, int(k == "alias")) for e, f, k in forms]
    queries = sorted({" ".join(rng.choices(names, k=rng.choice([1, 1, 2]))).title() for _ in range(40)} | {"", "  ", "12", "Smith 7 ", "zz" * 50, "smith " * 20})
    rows = spark.createDataFrame(forms, "entry_id long, form string, kind string, ord int")
    got = found_candidates(spark.createDataFrame([(q,) for q in queries], "query string").unionByName(spark.createDataFrame([(None,)], "query string")), rows, most)
    want = plain_candidates(queries, forms, most)
    assert got == want and max(map(len, want.values())) == most


def test_queries_find_what_a_plain_loop_finds(spark):
    """match_candidates and metaphone_join over all rows of the smallest tables."""
    folder = "/root/testdata/sf0.001"
    queries = [r.query for r in fuzzy_queries._queries(spark, folder).collect()]
    forms = [tuple(r) for r in fuzzy_queries._rows(spark, folder).collect()]
    sounds = {(q, f): plain_sound(q.lower(), f) for q in queries for f in {f for _, f, _, _ in forms}}
    want = {(q, e, f, round(sounds[q, f], 9)) for q in queries for e, f, _, _ in forms if sounds[q, f] is not None}
    got = [(r.query, r.entry_id, r.form, round(r.confidence, 9)) for r in fuzzy_queries.metaphone_join(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert found_candidates(fuzzy_queries._queries(spark, folder), fuzzy_queries._rows(spark, folder), 10) == plain_candidates(queries, forms, 10)


def test_common_subsequences_in_a_block():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé 😀") for _ in range(n)) for n in (0, 1, 2, 5, 9, 30, 62, 63, 64, 90)]
    letters, lengths = phonetic_join.letters_of(words)
    assert lengths.tolist() == [len(w) for w in words]
    for q in words[1:]:
        assert phonetic_join.subsequences(q, letters).tolist() == [lcs(q, w) for w in words]


def test_pieces_miss_no_pair_within_three_edits(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 13))) for _ in range(130)})
    rows = spark.createDataFrame([(i, w, "canonical", 0) for i, w in enumerate(words)], "entry_id long, form string, kind string, ord int")
    got = [(r.query, r.form, r.distance) for r in Z.edit_pairs(spark.createDataFrame([(w,) for w in words], "query string"), rows).collect()]
    want = {(a, b, d) for a in words for b in words if 1 <= (d := edits(a, b)) <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_match_spans_by_a_plain_loop(spark):
    texts = ["I met Ron Chernow in town. Ron Chernow wrote", "my sunto broke, and the Sunto Watch too", "near navysink a garmen rang", "", None, "no names here", "Garmin. And Garmin again!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spark.createDataFrame(FORMS, "entry_id long, form string, kind string, ord int")
    codes = {c for _, form, _, _ in FORMS for w in form.split() for c in phonetic.double_metaphone(w) if c}
    spans = {}
    for i, t in enumerate(texts):
        for m in re.finditer(r"\b[A-Za-z]+\b", t or ""):
            if len(m.group()) >= 3 and codes & {c for c in phonetic.double_metaphone(m.group()) if c}:
                spans[i, m.group(), m.start()] = True
        for m in re.finditer(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", t or ""):
            if m.start() and not t[: m.start()].rstrip(" \t\n").endswith((".", "!", "?")):
                spans[i, m.group(), m.start()] = False
    queries = spark.createDataFrame([(s,) for s in {s for _, s, _ in spans}], "query string")
    best = {}
    for r in Z.candidates(queries, rows).collect():
        best.setdefault(r.query, []).append((r.place, r.entry_id, round(r.confidence, 9)))
    want = {(*k, k[2] + len(k[1])): sorted(best[k[1]]) for k, strict in spans.items() if k[1] in best and (not strict or sorted(best[k[1]])[0][2] >= 0.5)}
    got = {(r.doc_id, r.span, r.start, r.end): [(c.place, c.entry_id, round(c.confidence, 9)) for c in r.candidates] for r in Z.match_spans(docs, rows).collect()}
    assert got == want and {(i, s) for i, s, *_ in got} >= {(0, "Ron Chernow"), (1, "sunto"), (2, "garmen")}


def test_spans_by_sql_are_those_of_the_frame(spark):
    from scriptorium.operators import table_functions as U

    texts = ["I met Ron Chernow in town. Ron Chernow wrote", "my sunto broke, and the Sunto Watch too", "near navysink a garmen rang", "", None, "no names", "Garmin. And Garmin again!", "é Élan Suunto"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spark.createDataFrame(FORMS, "entry_id long, form string, kind string, ord int")
    both = [sorted((r.doc_id, r.span, r.start, r.end, [tuple(c) for c in r.candidates]) for r in found.collect()) for found in (Z.match_spans(docs, rows), U.match_spans(spark, docs, rows))]
    assert both[0] == both[1] and len(both[0]) > 6


def test_a_table_function_ends_its_partitions_early(spark):
    from scriptorium.operators import table_functions as U

    U.register(spark)
    rows = spark.range(40).selectExpr("id % 3 as g", "id")
    found = spark.sql("SELECT place, row FROM first_rows(2, TABLE(SELECT * FROM {rows}) PARTITION BY g ORDER BY id DESC)", rows=rows).collect()
    assert sorted((r.row, r.place) for r in found) == [("0|36", 2), ("0|39", 1), ("1|34", 2), ("1|37", 1), ("2|35", 2), ("2|38", 1)]


def test_anchors_by_a_plain_loop(spark):
    terms = {"ron chernow", "suunto", "strava", "phở"}
    cases = [("churn now", "Ron Chernow"), ("the chair", "Ron Chernow"), ("soon toe,", "Suunto"), ("shoe", " suunto "), ("stravva!", "Strava"), ("anything", "Other"), ("", "Strava"), ("x", ""), (None, "Strava"), ("fone", "phở"), ("...", "Strava")]

    def valid(original, corrected):
        if not original or not corrected or (term := corrected.lower().strip()) not in terms:
            return True
        words = term.split()
        codes = [c for w in words if (c := phonetic.double_metaphone(w)[0])]
        if not codes:
            return True
        said = [w for o in original.lower().split() if (w := o.strip(".,!?;:\"'"))]
        return any(1 - edits(o, w) / max(len(o), len(w)) >= 0.5 for o in said for w in words) or any(c in [x for x in phonetic.double_metaphone(o) if x] for o in said for c in codes)

    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, original string, corrected string")
    got = {r.id: r.valid for r in Z.anchored(rows, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {i: valid(*c) for i, c in enumerate(cases)} and set(got.values()) == {True, False}


def test_names_heard_by_sound_by_a_plain_loop(spark):
    said = ["katherine", "kathrin", "catherine", "smith", "smyth", "schmidt", "shmit", "philip", "filip", "fillip", "al", "bob"]
    forms = ["katherine", "smith", "philip", "bob dylan", "schmidt"]

    def confidence(word, form):
        p, a = phonetic.double_metaphone(re.sub("[^a-zA-Z]", "", word))
        hit = 9
        for t in form.split():
            q, b = phonetic.double_metaphone(t)
            for i, (mine, theirs) in enumerate(((p, q), (p, b), (a, q), (a, b))):
                if mine and mine == theirs:
                    hit = min(hit, i)
        return (0.8, 0.7, 0.7, 0.6)[hit] * ratio(word, form) if hit < 9 else 0

    want = {f: min(w for w in said if len(w) >= 3 and confidence(w, f) >= 0.6) for f in forms if any(len(w) >= 3 and confidence(w, f) >= 0.6 for w in said)}
    entities = spark.createDataFrame([(f, said) for f in forms], "form string, words array<string>")
    assert {r.form: r.word for r in Z.heard_by_sound(entities).collect()} == want and len(want) >= 3


def test_no_spans_of_empty_tables(spark):
    rows = spark.createDataFrame(FORMS, "entry_id long, form string, kind string, ord int")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert Z.match_spans(none, rows).count() == 0 and Z.match_spans(none.unionByName(spark.createDataFrame([(1, "Garmin Garmin")], none.schema)), rows.where(F.lit(False))).count() == 0


def test_sound_saves_names_from_being_taken_for_invented(spark):
    from scriptorium.plans import catalog

    folder = "/root/testdata/sf0.001"
    plain = {r.form: r.outcome for r in catalog.QUERIES["discovery"](spark, folder).collect()}
    rows = catalog.QUERIES["discovery_by_sound"](spark, folder).collect()
    assert {r.form for r in rows} == set(plain)
    for r in rows:
        saved = r.heard_as is not None
        assert r.outcome == ("discovered" if saved else plain[r.form])
        assert not saved or plain[r.form] == "rejected_hallucinations" and ratio(r.heard_as, r.form) >= 0.75 - 1e-9
    assert any(r.heard_as for r in rows)
