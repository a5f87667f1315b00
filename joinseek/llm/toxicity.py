"""Toxicity: a linear classifier over character n-grams scaled by log-count ratios.

Learning reads a bounded sample of labelled documents: in how many toxic and how
many other documents each hashed n-gram occurs gives its naive Bayes log-count
ratio; all n-grams whose two shares differ are kept, up to a rate of false
discoveries, and a logistic regression is fitted on their presence times their
ratio. Scoring reads every document in batches where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.llm.text import kept_table
from joinseek.session import quoted

PRIME = np.uint64(1_099_511_628_211)
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicityParams:
    """``sample`` labelled documents of each class at most are learnt from, smallest hash first.

    N-grams are hashed to ``bits`` bits. Those enter the model whose shares differ
    by so many standard errors that a ``false_rate`` of them at most is expected
    to do so by chance, so small and large samples act alike. Counts of the
    sample and the model are all that is gathered, whatever the size of the corpus.
    """

    sample: int = 4000
    min_order: int = 3
    max_order: int = 6
    bits: int = 20
    false_rate: float = 0.05
    smoothing: float = 1.0
    penalty: float = 1e-3
    rounds: int = 150
    threshold: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    params: ToxicityParams


def held_out(key: str) -> Column:
    """True for a quarter of the keys, which learning never sees."""
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string")) % 4 == 2, F.lit(False))


CHUNK = 1 << 20
#: Features of documents that are worked on at once.
BLOCK = 1 << 20


def ngrams(text: str, params: ToxicityParams) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, a piece of the text and an order at a time.

    Letters are lower-cased and white space is one blank, also at both ends.
    """
    whole = f" {' '.join(text.lower().split())} "
    for at in range(0, len(whole), CHUNK):
        piece = whole[at : at + CHUNK + params.max_order - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        rolled = codes
        for order in range(2, params.max_order + 1):
            if len(codes) < order:
                break
            rolled = rolled[:-1] * PRIME + codes[order - 1 :]
            if order >= params.min_order:
                yield ((rolled * MIX) >> np.uint64(64 - params.bits)).astype(np.int64)


def _labelled_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams, text: str, key: str) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of the sample, and how many labelled documents each class has."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(quoted(key)).isNotNull()).where(~held_out(key))
    usable = usable.select(F.col(quoted(key)).alias("__key"), F.col("toxic").cast("int").alias("label")).distinct()
    totals = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    classes = [
        usable.where(F.col("label") == label).orderBy(F.xxhash64("__key"), "__key").limit(params.sample) for label in (0, 1)
    ]
    chosen = kept_table(classes[0].unionAll(classes[1]), "labelled")
    # Two times params.sample rows of two numbers at most.
    texts = docs.select(F.col(quoted(key)).alias("__key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "__key").select("label", "text")
    return kept_table(sample, "sample"), totals


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, text: str = "text", key: str = "doc_id") -> ToxicityModel:
    """A model from ``labels`` (key, toxic 0 or 1) and the texts of ``docs``.

    Labels of held-out keys are not read. Without labels of both classes the
    model has no features and gives every text the share of toxic labels.
    """
    params = params or ToxicityParams()
    sample, totals = _labelled_sample(docs, labels, params, text, key)
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    share = (toxic + 0.5) / (toxic + other + 1)
    none = np.zeros(0)
    prior = ToxicityModel(none.astype(np.int64), none, float(np.log(share / (1 - share))), params)
    if not toxic or not other:
        return prior

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << params.bits), np.int64)
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = [np.unique(h) for h in ngrams(body.as_py(), params)]
                if hashes:
                    counts[label, np.unique(np.concatenate(hashes))] += 1
        seen = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(counts[1, seen]), pa.array(counts[0, seen])], names=["feature", "toxic", "other"]
        )

    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not c:
        return prior
    grams = sample.mapInArrow(counted, "feature bigint, toxic bigint, other bigint")
    grams = grams.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    both = f"(toxic + other) / {t + c}D"
    z = f"abs(toxic / {t}D - other / {c}D) / sqrt({both} * (1 - {both} + 1e-9D) * {1 / t + 1 / c}D)"
    tested = kept_table(grams.withColumn("z", F.expr(z)), "ngrams")
    # At most 2 to the power of ``bits`` rows: one per hashed n-gram.
    table = tested.where(F.col("z") >= least_z(tested, params.false_rate)).toPandas().sort_values("feature")
    features = table["feature"].to_numpy(dtype=np.int64)
    if not len(features):
        return prior
    smooth = params.smoothing
    ratio = np.log((table["toxic"].to_numpy() + smooth) / (t + 2 * smooth))
    ratio -= np.log((table["other"].to_numpy() + smooth) / (c + 2 * smooth))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(features, params)
        for batch in batches:
            found = [_present(body.as_py(), lookup, params).tolist() for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"]
            )

    rows = sample.mapInArrow(present, "label int, found array<int>").toArrow()
    found = rows.column("found").combine_chunks()
    label = rows.column("label").to_numpy().astype(np.float32)
    weight = np.where(label == 1, toxic / t, other / c)
    weights, bias = _logistic(found.flatten().to_numpy(), found.value_lengths().to_numpy(), ratio, label, (weight / weight.sum()).astype(np.float32), params)
    return ToxicityModel(features, weights * ratio, bias, params)


#: Steps per unit in which the least z is found.
STEPS = 50


def least_z(tested: DataFrame, false_rate: float) -> float:
    """The least z at which no more than this share of the n-grams above is expected there by chance."""
    counts = tested.groupBy(F.floor(F.col("z") * STEPS).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    total, above, least = sum(r["count"] for r in counts), 0, float("inf")
    for r in counts:
        above += r["count"]
        if total * erfc(r.step / STEPS / sqrt(2)) <= false_rate * above:
            least = r.step / STEPS
    return least


def _logistic(
    found: np.ndarray, sizes: np.ndarray, ratio: np.ndarray, label: np.ndarray, weight: np.ndarray, params: ToxicityParams
) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the weighted log loss with a squared penalty.

    ``found`` has the numbers of the features of each document, ``sizes`` how many
    they are; a feature that is present has the value of its ratio. Blocks of
    documents are taken one after another, so that no step copies all numbers.
    """
    ends = np.cumsum(sizes)
    blocks, at = [], 0
    while at < len(sizes):
        first = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        blocks.append((at, to, int(first), int(ends[to - 1])))
        at = to

    def sums(values: np.ndarray) -> np.ndarray:
        """Per document the sum of its features' values."""
        out = np.zeros(len(sizes), np.float32)
        for low, high, start, stop in blocks:
            held = np.flatnonzero(sizes[low:high])
            if len(held):
                offsets = (ends[low:high] - sizes[low:high] - start)[held]
                out[low + held] = np.add.reduceat(values[found[start:stop]], offsets)
        return out

    def gathered(values: np.ndarray) -> np.ndarray:
        """Per feature the sum of its documents' values."""
        out = np.zeros(len(ratio), np.float64)
        for low, high, start, stop in blocks:
            out += np.bincount(found[start:stop], np.repeat(values[low:high], sizes[low:high]), minlength=len(ratio))
        return out

    scale = ratio.astype(np.float32)
    step = 1.0 / (0.25 * float((weight * (1 + sums(scale * scale))).sum()) + params.penalty)
    now = ahead = np.zeros(len(ratio), np.float32)
    bias = bias_ahead = 0.0
    for k in range(params.rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(sums(scale * ahead) + bias_ahead, -50, 50))) - label)
        after = (ahead - step * (scale * gathered(error) + params.penalty * ahead)).astype(np.float32)
        bias_after = bias_ahead - step * float(error.sum())
        pace = k / (k + 3)
        ahead, bias_ahead = after + np.float32(pace) * (after - now), bias_after + pace * (bias_after - bias)
        now, bias = after, bias_after
    return now.astype(np.float64), bias


def _lookup(features: np.ndarray, params: ToxicityParams) -> np.ndarray:
    table = np.full(1 << params.bits, -1, np.int32)
    table[features] = np.arange(len(features), dtype=np.int32)
    return table


def _present(text: str, lookup: np.ndarray, params: ToxicityParams) -> np.ndarray:
    found = [np.zeros(0, np.int32)]
    for hashes in ngrams(text, params):
        numbers = lookup[hashes]
        found.append(numbers[numbers >= 0])
    return np.unique(np.concatenate(found))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null or empty text has the score of the bias alone; equal texts have equal
    scores. No column but the key and the text is read.
    """
    params, weights, bias = model.params, model.weights, model.bias
    slim = docs.select(F.col(quoted(key)).alias(key), held_out(key).alias("held_out"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("__text"))
    schema = slim.drop("__text").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(model.features, params)
        for batch in batches:
            sums = np.array([weights[_present(body.as_py(), lookup, params)].sum() for body in batch.column(2)], np.float64)
            scores = 1 / (1 + np.exp(-np.clip(sums + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores), pa.array((scores >= params.threshold).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"],
            )

    return slim.mapInArrow(scored, schema)
