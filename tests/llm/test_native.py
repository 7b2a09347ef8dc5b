"""Mixing and quality rules against their SQL and against plain loops."""

from __future__ import annotations

import re

import duckdb
import pandas as pd
import pytest

from scriptorium.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_sql(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    return con.execute(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = list(b.columns)
    key = lambda df: sorted(tuple("-" if pd.isna(v) else f"{float(v):.6f}" if not isinstance(v, str) else v for v in r) for r in df[columns].itertuples(index=False))
    assert key(a) == key(b)


@pytest.mark.parametrize("which", ["odd", "none", "copies"])
def test_mix_equals_sql(which, request):
    docs = request.getfixturevalue(which)
    same(mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas(), in_sql(mixing.oracle(), docs))


@pytest.mark.parametrize("which", ["odd", "copies"])
def test_mix_keeps_to_its_targets(which, request):
    docs = request.getfixturevalue(which)
    found = mixing.mix(docs).toPandas()
    assert (found["taken"] <= 3 * found["size"]).all() and (found["taken"] >= 0).all()
    names = docs.select("source").distinct().toPandas()["source"].tolist()
    names = sorted((n for n in names if not pd.isna(n))) + [None] * any(pd.isna(n) for n in names)
    totals = {n: 0 for n in names}
    for r in docs.collect():
        totals[r.source] += len(WORD.findall(r.text or ""))
    capped, want = set(), {}
    while True:  # the contract's own loop
        weights = {n: i % 3 + 1 for i, n in enumerate(names)}
        left = sum(totals.values()) - sum(3 * totals[n] for n in capped)
        free = sum(w for n, w in weights.items() if n not in capped)
        want = {n: 3 * totals[n] if n in capped else left * weights[n] / free for n in names}
        more = {n for n in names if want[n] > 3 * totals[n]}
        if more <= capped:
            break
        capped |= more
    for source_size, target in {(r.source_size, r.target) for r in found.itertuples()}:
        assert any(abs(want[n] - target) < 1e-6 for n in names if totals[n] == source_size)
    taken = found.groupby("target")["taken"].sum()
    sources = found.groupby("target")["source_size"].first()
    for target, got in taken.items():
        assert abs(got - target) <= max(mixing.BLOCK, 0.02 * sources[target])


def test_sainte_lague_deals_highest_quotients(spark):
    claims = spark.createDataFrame([(0, i, w, 100) for i, w in enumerate((53, 24, 23, 7, 0, 1))], "g int, i int, w long, seats long").selectExpr("*", "1000L as most")
    dealt = {r.i: r["__seats"] for r in mixing.sainte_lague(claims, ["g"], "seats", "w", "i", "most").collect()}
    weights, want = (53, 24, 23, 7, 0, 1), [0] * 6
    for _ in range(100):
        best = max(range(6), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert dealt == dict(enumerate(want))


def test_mixed_documents_hold_the_words_taken(odd):
    found = mixing.mix_documents(odd)
    assert found.columns == odd.columns
    words = sum(len(WORD.findall(r.text)) for r in found.collect())
    assert words == sum(r.taken for r in mixing.mix(odd).collect())


@pytest.mark.parametrize("which", ["odd", "none", "copies"])
def test_quality_equals_sql(which, request):
    docs = request.getfixturevalue(which)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality_rules.quality_rules(docs).select(*columns).toPandas()
    if which == "odd":  # the SQL groups by id, so it takes each id once
        got, docs = got[got["doc_id"].notna() & (got["doc_id"] != 5)], docs.where("doc_id is not null and doc_id != 5")
    same(got, in_sql(quality_rules.ORACLE, docs))


def test_repeated_words_by_a_plain_loop(spark):
    texts = ["a b c d e", "a b c d e a b c d e", "a a a a a a a", "x a b c d e y a b c d e z", "a b c d e f a b c d e f g", ""]
    got = [r.n_repeat_words for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    want = []
    for t in texts:
        w = t.split()
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want.append(len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}))
    assert got == want


def test_lines_that_fail_go_and_the_rest_stays(odd):
    kept = {r.doc_id: r for r in quality_rules.clean_documents(odd).collect()}
    assert kept[12].text.startswith("same line\nsame line\nw0 ") and "rights" not in kept[12].text and "About" not in kept[12].text
    assert kept[12].n_chars == len(kept[12].text) and kept[12].bucket == "clash"
    assert 1 not in kept and 4 not in kept and kept[6].text.endswith("w59.")


def test_prose_that_mentions_a_phrase_stays(spark):
    prose = "The board met in spring to settle its privacy policy and the terms of use, and it voted for both of them after a long talk."
    texts = [prose, f"{prose}\nPrivacy policy | Terms of use", f"{prose}\nDatenschutzerklärung", f"{prose}\nAccueil", f"{prose}\nThe board met in ...", prose.replace(".", "..."), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.kept, r.n_lines_removed) for r in quality_rules.quality_rules(docs).collect()}
    assert found == {0: (True, 0), 1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (True, 1), 5: (True, 0), 6: (False, 0)}
