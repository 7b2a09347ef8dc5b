"""The recognizer slot: one load in each worker, failures as empty lists, places in cleaned texts."""

from __future__ import annotations

import math

import pyarrow as pa

from scriptorium.operators import recognition as N

def loaders():
    """A model that tells how often it was loaded where it runs, and one that cannot be loaded."""
    loads = []

    def broken():
        raise OSError("no such model")

    def fussy():
        loads.append(1)

        def predict(text, labels):
            if "fail" in text:
                raise RuntimeError("out of memory")
            return [
                {"text": f" {text} ", "label": labels[0], "score": 0.6, "start": 0, "end": len(text)},
                {"text": str(len(loads)), "label": "loads", "score": 0.9},
                {"text": "late", "label": "x", "score": 0.6},
                *({"text": "bad", "label": "x", "score": s} for s in (math.nan, math.inf, -1, 1.5, "0.9", None, 0.2)),
                {"text": " ", "label": "x", "score": 0.9},
                {"text": None, "label": "x", "score": 0.9},
                {"text": "y", "label": "", "score": 0.9},
            ]

        return predict

    return fussy, broken


def found(spark, texts, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    return {r.id: [(e.text, e.entity_type, round(e.confidence, 6), e.start, e.end) for e in r.entities] for r in N.with_entities(rows, **how).collect()}


def test_rules_and_places(spark):
    texts = ["  We met Ron\tChernow, and Bob. Al\x00ice Smith​ lives in Paris at Acme Inc", "", None, " \n ", "Éva Bo", "Home. Again Home"]
    got = found(spark, texts)
    clean = [N.cleaned(t or "") for t in texts]
    assert all(clean[i][e[3] : e[4]] == e[0] for i, es in got.items() for e in es)
    assert [e[:3] for e in got[0]] == [("Ron\tChernow", "person", 0.8), ("Alice Smith", "person", 0.8), ("Acme Inc", "organization", 0.8), ("We", "term", 0.6), ("Bob", "term", 0.6), ("Paris", "location", 0.6)]
    assert got[1] == got[2] == got[3] == [] and [e[0] for e in got[4]] == ["Bo"] and [e[0] for e in got[5]] == ["Again Home", "Home"]
    assert [e[:3] for e in found(spark, texts, labels=("location",))[0]] == [("Paris", "location", 0.6)]


def test_a_model_is_loaded_once_and_its_failures_are_empty(spark):
    fussy, broken = loaders()
    got = found(spark, ["a b", "fail", "c"] * 40, load=fussy)
    assert all(got[i] == [] for i in range(1, 120, 3))
    for i in range(0, 120, 3):
        assert got[i] == [("1", "loads", 0.9, None, None), ("a b", "person", 0.6, 0, 3), ("late", "x", 0.6, None, None)]
    assert set(map(tuple, found(spark, ["a", "b"], load=broken).values())) == {()}


def test_nouns_of_a_transcript(spark):
    rows = [(1, 0, "I met Ron Chernow there.", "i met ron chernow there"), (1, 1, "Ron Chernow wrote. Xanthippe Zorro came", None), (1, 2, "and Paul Inventedname", "and paul"), (2, 0, "Ron Chernow", "nothing alike"), (2, 1, None, None)]
    segments = spark.createDataFrame(rows, "transcript long, segment long, text string, raw_text string")
    known = spark.createDataFrame([("xanthippe zorro",)], "form string")
    got = {(r.transcript, r.text): (r.type, r["count"], r.outcome, r.snippet) for r in N.discovered_nouns(segments, known, ("the",)).collect()}
    assert got[1, "Ron Chernow"] == ("person", 2, "discovered", "I met Ron Chernow there.")
    assert got[1, "Xanthippe Zorro"][2] == "already_in_dictionary" and got[1, "Paul Inventedname"][2] == "discovered"  # half of it was heard
    assert got[2, "Ron Chernow"][2:] == ("rejected_hallucinations", None)


def test_batches_are_taken_in_parts(monkeypatch):
    """By bytes of text and by rows; a longer text is a part of its own."""
    texts = ["é" * 600, None, "a" * 10, "b" * 5_000, "", "c"] + ["d"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    monkeypatch.setattr(N, "PART_BYTES", 1_210)
    monkeypatch.setattr(N, "PART_TEXTS", 8)
    for whole in (batch, batch.slice(1), batch.slice(0, 0)):
        made = list(N.parts(whole, 1))
        assert [x for p in made for x in p.column(1).to_pylist()] == whole.column(1).to_pylist()
        assert all(1 <= p.num_rows <= 8 and (p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 1_210) for p in made)
    assert [p.num_rows for p in N.parts(batch, 1)] == [3, 1, 8, 8, 6]


def test_only_names_leave_a_transcript(spark):
    segments = spark.createDataFrame([(1, 0, "I met RON Chernow. Ron Chernow and Ron Chernow, in Paris", None)], "transcript long, segment long, text string, raw_text string")
    found = N.discovered_nouns(segments, spark.createDataFrame([("paris",)], "form string"), ("the",), min_confidence=0.5)
    met = found._jdf.queryExecution().optimizedPlan()
    while "Join" not in met.nodeName():
        met = met.children().head()
    side = met.children().head().output()
    assert not {"said", "words", "raw"} & {side.apply(i).name() for i in range(side.size())}
    got = {r.text: (r["count"], r.outcome, r.snippet) for r in found.collect()}
    assert got["Ron Chernow"] == (2, "discovered", "I met RON Chernow.") and got["Paris"] == (1, "already_in_dictionary", None)
