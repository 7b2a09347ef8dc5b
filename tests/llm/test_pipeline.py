"""Every stage of the pipeline against plain versions of its decisions."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import mixing, quality_rules
from scriptorium.llm.queries import tokenizer
from test_native import in_sql
from test_operators import components, sets_by_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_order(odd, copies, spark, tmp_path):
    import tiktoken

    from scriptorium.llm.bpe import load_ranks

    docs = odd.unionByName(copies.selectExpr("doc_id + 1000 as doc_id", *[f"`{c}`" for c in copies.columns[1:]]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, str(tmp_path))
        result.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == seen[name][0].columns
    # quality rules by their SQL, for the ids that stand once; what stays of a text are its lines in order
    before, after = seen["quality_rules"]
    texts = {r.doc_id: r.text for r in before.collect()}
    once = {i for i, n in Counter(r.doc_id for r in before.collect()).items() if n == 1 and i is not None}
    judged = in_sql(quality_rules.ORACLE, before.where(F.col("doc_id").isin(list(once))))
    assert {r.doc_id for r in after.collect()} & once == {int(i) for i, kept in zip(judged.doc_id, judged.kept, strict=True) if kept}
    for r in after.where(F.col("doc_id").isNotNull()).collect():
        left = iter((texts[r.doc_id] or "").split("\n"))
        assert all(line in left for line in r.text.split("\n")) and r.n_chars == len(r.text)
    before, after = ([r.text for r in x.collect()] for x in seen["exact_dedup"])
    assert Counter(after) == Counter(set(before))
    ids = {r.doc_id for r in seen["ngram_join"][1].collect()}
    assert len(ids & set(range(1100, 1160))) == 1 and ids >= set(range(1200, 1260))
    # near duplicates by brute force over the stage's whole input: the smallest id of each component stays
    rows = seen["ngram_join"][0].select("doc_id", "text").collect()
    smallest = components(sets_by_words([r.text for r in rows]), [r.doc_id for r in rows])
    assert Counter(r.doc_id for r in seen["ngram_join"][1].collect()) == Counter(r.doc_id for r, least in zip(rows, smallest, strict=True) if r.doc_id == least)
    before, after = seen["mixing"]
    # each document as often as it is taken, by the operator and by its SQL, in whole or cut to its first words
    stated = in_sql(mixing.oracle(), before)
    assert sorted(stated.taken) == sorted(r.taken for r in mixing.mix(before).collect())
    taken = Counter()
    for r in after.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert taken == Counter({r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken})
    texts = {r.doc_id: WORD.findall(r.text) for r in before.collect()}
    assert all(texts[r.doc_id][: len(w := WORD.findall(r.text))] == w for r in after.collect())
    before, after = seen["byte_bpe"]
    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in before.collect())


def test_run_returns_the_last_stage(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 100


def test_empty_table(none, spark):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
