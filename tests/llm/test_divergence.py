"""The divergence audit against a plain computation and against its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, most):
    """The result's rows from (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    kept = {lang: [t for t, n in docs[lang].items() if n >= least] for lang, _ in groups}
    out = []
    shares = lambda n, lang: {t: 1 + 10**9 * (n[t] + 5) // (sum(n[x] for x in kept[lang]) + 5 * len(kept[lang])) for t in kept[lang]}
    of = {g: shares(counts[g], g[0]) for g in groups}
    whole = {lang: shares(sum((counts[g] for g in groups if g[0] == lang), Counter()), lang) for lang, _ in groups}
    for g in groups:
        pair = [(sum(abs(of[g][t] - of[o][t]) for t in kept[g[0]]), o[1]) for o in groups if o[0] == g[0] and o != g]
        term = [(of[g][t] - whole[g[0]][t], t) for t in kept[g[0]] if counts[g][t] and of[g][t] > whole[g[0]][t]]
        for part, values, last in (("pair", pair, None), ("term", term, most)):
            values.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(*g, part, item, value, i + 1) for i, (value, item) in enumerate(values[:last])]
    return Counter(out)


def result(docs, **how):
    return Counter(map(tuple, divergence.divergence(docs, **how).collect()))


def of_rows(docs):
    return [(r.text, r.lang, r.source) for r in docs.collect()]


@pytest.mark.parametrize("which", ["odd", "none", "copies"])
@pytest.mark.parametrize("least, most", [(1, 50), (2, 3), (1_000, 50)])
def test_equals_a_plain_computation(which, least, most, request):
    docs = request.getfixturevalue(which)
    assert result(docs, least_docs=least, most_terms=most) == plain(of_rows(docs), least, most)


@pytest.mark.parametrize("merged, held", [(400_000, 800_000), (50, 100)])
def test_many_sources_in_two_languages(spark, merged, held, monkeypatch):
    """Small bounds make tasks send parts of their counts and of their tallies."""
    monkeypatch.setattr(divergence, "MERGED", merged)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("wort", "Mot", "été", "ß", "词") for b in "abcdefghij"]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(50)], k=rng.randrange(30))) + "_x-1", rng.choice(["de", "fr", None]), f"src{min(rng.randrange(12), rng.randrange(12))}") for _ in range(300)]
    rows += [("", "de", "no words"), (None, "xx", "alone"), ("one", "yy", "a"), ("two", "yy", "b")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, source string, term string").repartition(3)
    assert result(docs, least_docs=5) == plain(rows, 5, 50)


def test_sql_states_the_same(copies):
    con = duckdb.connect()
    docs = copies.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de"))
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    rows = con.execute(divergence.ORACLE).fetchall()
    assert len(rows) > 10 and Counter(rows) == plain(of_rows(docs), divergence.LEAST_DOCS, divergence.MOST_TERMS) == result(docs)


def test_shares_of_very_large_counts_are_exact(spark):
    n = [0, 1, 9_000_000_000_000, 2_718_281_828_459]
    rows = [(c, 80_000_000_000_007, 12_345) for c in n]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 5) // (a + 5 * v) for c, a, v in rows]
