"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

Each text is read as the hashed buckets of its words, in lower case (A-Z), and of its byte n-grams in
``GRAMS``, as they are written. A word that only says again what the word before it says is read as one
word for all of those. A document is the mean of its buckets' vectors; a softmax over two outputs gives
the score. Vectors and outputs are trained together by stochastic gradient descent in numpy.

Training takes at most ``TRAIN_DOCS`` labelled rows, drawn by a hash of the id from the rows that may
be learnt from; that is the only bound, and a documented one. The sample's texts stay on the executors: the
driver gets the buckets of each and their shares, 2^BUCKET_BITS of them at most however long a text is, and
trains for ``EPOCHS`` passes. As the outputs see a mean of vectors, a bucket matters only
through the difference that its vector makes to the two outputs: after training one number for each
bucket is left, and scoring is a mean of looked-up numbers. That table, ``2^BUCKET_BITS`` floats, is
what is broadcast, whatever the input. Scoring runs over whole texts in Arrow batches, without an
exchange.

Defined results: a null or empty text has no buckets, so its score is the softmax of the bias alone.
Labels, language, source and id are never features. Rows with a null label or id teach nothing; with
no labelled rows at all, every score is 0.5. Of rows with one id the smallest label and the smallest
text teach. Very long texts are read to their end. Repeated rows get equal scores, an empty table an empty
result; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels

BUCKET_BITS = 18
DIMENSIONS = 8
GRAMS = (3, 4)
TRAIN_DOCS = 4_000
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.7
SEED = 11
#: What a word is read as that only says again what the word before it says.
REPEATED = np.uint64(0x5EC0_17D5_A11E_0F0B)

def features(block: kernels.Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every text of a block, end to end, and where each text's begin: of its words in lower case, then
    of its byte n-grams as they are written."""
    low = kernels.lowered(block)
    found = kernels.words(low)
    words = kernels.range_hashes(kernels.prefix_hashes(low), found.starts, found.ends)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    words[np.setdiff1d(again, found.bounds)] = REPEATED  # not the first word of a text
    shift, written = np.uint64(64 - BUCKET_BITS), kernels.prefix_hashes(block)
    parts = [((words >> shift).astype(np.int32), found.bounds)]
    for n in GRAMS:
        counts = np.maximum(0, np.diff(block.offsets) - n + 1)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(bounds[-1]) + np.repeat(block.offsets[:-1] - bounds[:-1], counts)
        grams = kernels.range_hashes(written, at, at + n)
        with np.errstate(over="ignore"):
            parts.append(((kernels.mixed(grams + np.uint64(n)) >> shift).astype(np.int32), bounds))
    sizes = np.stack([np.diff(bounds) for _, bounds in parts])
    bounds = np.concatenate([[0], np.cumsum(sizes.sum(axis=0))])
    out = np.empty(bounds[-1], np.int32)
    begins = bounds[:-1].copy()
    for (buckets, own), size in zip(parts, sizes, strict=True):
        out[np.repeat(begins - own[:-1], size) + np.arange(own[-1])] = buckets
        begins += size
    return out, bounds


def means(block: kernels.Block, table: np.ndarray) -> np.ndarray:
    """For each text the mean of the table over its buckets; 0 for a text without any."""
    buckets, bounds = features(block)
    sums = np.concatenate([[0.0], np.cumsum(table[buckets], dtype=np.float64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


def counted(block: kernels.Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its different buckets and the share of the text that each has."""
    buckets, bounds = features(block)
    made = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        seen, times = np.unique(buckets[a:b], return_counts=True)
        made.append((seen, (times / max(1, b - a)).astype(np.float32)))
    return made


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The table of each bucket's pull towards label 1, and the bias, from documents' buckets and shares."""
    n_buckets = 1 << BUCKET_BITS
    if not docs:
        return np.zeros(n_buckets, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (n_buckets, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    outputs = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.zeros(2, np.float32)
    # both labels weigh the same in the vectors; the bias is set to the labels' true shares after
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 / np.maximum(share, 1e-6)
    steps = epochs * len(docs)
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            seen, part = docs[i]
            mean = part @ vectors[seen] if len(seen) else np.zeros(DIMENSIONS, np.float32)
            raw = outputs @ mean + bias
            odds = np.exp(raw - raw.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            error *= weight[labels[i]]
            back = outputs.T @ error
            outputs -= rate * np.outer(error, mean)
            bias -= rate * error
            if len(seen):
                vectors[seen] -= (rate * GAIN) * part[:, None] * back[None, :]
    pull = vectors @ (outputs[1] - outputs[0])
    return pull.astype(np.float32), float(bias[1] - bias[0]) + float(np.log(max(share[1], 1e-6) / max(share[0], 1e-6)))


#: A bucket has a small share of a document, so its step is made larger by this.
GAIN = 20.0


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the key as text leaves the remainder of the rows never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """__text and __label of at most TRAIN_DOCS labelled rows that may be learnt from."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    drawn = usable.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    # of repeated ids the smallest label and text teach, so that reruns learn the same
    drawn = drawn.groupBy("__key").agg(F.min("__label").alias("__label"))
    drawn = drawn.orderBy(F.xxhash64("__key"), "__key").limit(TRAIN_DOCS)
    # at most TRAIN_DOCS keys, so this side is always small enough to broadcast
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    # rows with the same id would make the sample grow: one of them is enough
    return texts.join(F.broadcast(drawn), "__key").groupBy("__key").agg(F.min("__text").alias("__text"), F.min("__label").alias("__label"))


def training_buckets(sample: DataFrame) -> DataFrame:
    """__key, __label, and packed buckets and shares of the sample's texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for block in kernels.blocks(batch.column(2)) for x in counted(block)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], names=["__key", "__label", "__seen", "__share"])

    kind = sample.schema["__key"].dataType.simpleString()
    return sample.select("__key", "__label", "__text").mapInArrow(made, f"__key {kind}, __label int, __seen binary, __share binary")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted for each row."""
    sample = training_buckets(training_rows(docs, labels, key, text, label)).toArrow()
    sample = sample.take(pa.array(np.argsort(sample["__key"].to_numpy(), kind="stable")))
    packed = zip(sample["__seen"].to_pylist(), sample["__share"].to_pylist(), strict=True)
    table, bias = train([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in packed], sample["__label"].to_pylist())
    model = docs.sparkSession.sparkContext.broadcast((table.tobytes(), bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, shift = model.value
        pull = np.frombuffer(raw, np.float32)
        for batch in batches:
            made = [1 / (1 + np.exp(-(means(block, pull) + shift))) for block in kernels.blocks(batch.column(2))]
            scores = pa.array(np.concatenate(made) if made else np.zeros(0), pa.float64())
            predicted = pa.array((scores.to_numpy() >= THRESHOLD).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores, predicted], names=[key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text))
    return rows.mapInArrow(scored, f"`{key}` {kind}, held_out boolean, score double, predicted int")
