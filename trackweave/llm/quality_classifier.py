"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document.

A document's vector is the mean of the vectors of its features; a softmax layer
turns it into a probability. Vectors and layer are learned together by
stochastic gradient descent in numpy, in one task, on at most ``TRAIN_ROWS``
labelled rows (picked by a hash of the id) of at most ``TRAIN_CHARS`` characters
in all; both bounds are of the fit only. Spark takes one text per id, the one
of the smallest hash, before anything goes to that task.

For scoring the layer is folded into the vectors: each feature has one number,
and a document's logit is the mean of its features' numbers plus a constant.
The table of numbers has a fixed size and goes to the tasks with the function;
whole texts are scored in one pass without a shuffle. Inputs are the characters
of the text alone.

Defined cases: a NULL or blank text has no features and gets the constant's
probability; without labelled rows every score is 0.5; rows labelled twice
count with their lower label; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackweave.llm.words import BASE, INVERSE, mix, powers
from trackweave.session import materialize

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 4000
#: Characters that it is fitted on, at most; where the chosen rows hold more, the longest texts are left out.
TRAIN_CHARS = 200_000_000
#: Hash buckets of features, length of vectors, character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 18, 16, (3, 4)
EPOCHS, RATE = 6, 0.8
#: Distances at which a repeated word is a feature of its own (word n-grams reduced to "same word again").
REPEATS = 8
#: Code points whose features are computed at a time.
SLICE = 1 << 20
#: Score from which a document is predicted to be good.
GOOD = 0.7


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, grouped by document, and where each document begins (with the end)."""
    texts = [t or "" for t in texts]
    joined = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = 1 + np.concatenate(([0], np.cumsum(sizes + 1)))  # of each text in the joined run
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    code = mix(np.where(blank, 32, joined).astype(np.uint64))
    ids, where = [], []
    for n in GRAMS:  # a blank stands for the edge of a word at either end of a gram, never inside
        if len(code) < n:
            continue
        total = np.full(len(code) - n + 1, n, np.uint64)
        inside = np.ones(len(total), bool)
        for i in range(n):
            total = total * np.uint64(BASE) + code[i:len(code) - n + 1 + i]
            if 0 < i < n - 1:
                inside &= ~blank[i:len(code) - n + 1 + i]
        at = np.flatnonzero(inside & ~(blank[:len(total)] & blank[n - 1:]))
        ids.append(mix(total[at]))
        where.append(at + 1)  # the second character is never an edge
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * powers(BASE, len(code)), dtype=np.uint64)))
    words = mix((sums[ends] - sums[starts]) * powers(INVERSE, len(code))[starts])
    ids.append(words)
    where.append(starts)
    doc = np.searchsorted(begins, starts, side="right")
    same = doc[1:] == doc[:-1]
    ids.append(mix(words[:-1] * np.uint64(3) + words[1:])[same])
    where.append(starts[:-1][same])
    for n in range(1, REPEATS + 1):  # a word that stands n words before too: one feature per distance
        same = (doc[n:] == doc[:-n]) & (words[n:] == words[:-n])
        ids.append(np.full(int(same.sum()), mix(np.full(1, n, np.uint64))[0]))
        where.append(starts[n:][same])
    every, place = np.concatenate(ids), np.concatenate(where)
    doc = np.searchsorted(begins, place, side="right") - 1
    order = np.argsort(doc, kind="stable")
    return (every[order] % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(doc[order], np.arange(len(texts) + 1))


def text_slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` code points; a longer text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Model:
    """One number per feature bucket and a constant."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for every text."""
        out = np.empty(len(texts))
        for a, b in text_slices(texts):
            ids, first = features(texts[a:b])
            sums = np.concatenate(([0.0], np.cumsum(self.table[ids], dtype=np.float64)))
            n = np.diff(first)
            out[a:b] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-out))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Stochastic gradient descent over documents in random order; the rate falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    docs = []
    for a, b in text_slices(texts):
        ids, first = features(texts[a:b])
        for x, y in zip(first[:-1], first[1:], strict=True):
            unique, counts = np.unique(ids[x:y], return_counts=True)
            docs.append((unique.astype(np.int32), (counts / max(1, y - x)).astype(np.float32)))
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            now = rate * (1 - step / steps)
            step += 1
            ids, share = docs[i]
            mean = share @ vectors[ids]
            logits = layer @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = layer.T @ error
            layer -= now * np.outer(error, mean)
            bias -= now * 0.1 * error
            # Shares are small, so steps are scaled up, but never so far that the mean moves by more than one step.
            scale = min(200.0, 1.0 / max(1e-12, float(share @ share)))
            vectors[ids] -= (now * scale) * share[:, None] * back
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> DataFrame:
    """doc_id, quality, text: at most ``rows`` labelled ids outside the held-out part, one text of each."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id")).limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # so many ids, each in any number of rows
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text")))  # reduced before the shuffle
    sample = materialize(texts.groupBy("doc_id", "quality").agg(first["text"].alias("text")), "sample")
    size = F.coalesce(F.length("text"), F.lit(0))
    so_far = Window.orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # ids and sizes of the chosen rows
    sizes = sample.select("doc_id", size.cast("long").alias("size")).withColumn("total", F.sum("size").over(so_far))
    return sample.join(F.broadcast(sizes.filter(F.col("total") <= chars).select("doc_id")), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on the training rows, in the order of their ids."""
    sample = training_rows(docs, labels, rows, chars)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        model = fit(group["text"].tolist(), group["quality"].to_numpy())
        return pd.DataFrame({"table": [model.table.astype(np.float32).tobytes()], "bias": [model.bias]})

    found = sample.groupBy(F.lit(1).alias("all")).applyInPandas(run, "table binary, bias double").collect()
    if not found:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(found[0].table, np.float32), found[0].bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` to every document."""
    table, bias = model.table, model.bias
    kept = [f for f in docs.schema.fields if f.name != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(table, bias)
        for batch in batches:
            done = own.scores(batch.column(text).to_pylist())
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(done)], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, score double")
