"""Repeated passages: the earliest occurrence of some lines or sentences stays, later ones go."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.llm.hot import joined_by_key
from joinseek.llm.text import kept_table
from joinseek.session import quoted

#: A unit ends behind a line feed, and behind the end of a sentence that a blank follows.
UNIT_END = re.compile(r"\n|[.!?](?=[\x20\x09-\x0D])")
DOC = ["doc", "b1", "b2"]
DIGEST = ["d1", "d2"]
#: Runs per batch that goes back to Spark.
ROWS = 100_000


@dataclass(frozen=True)
class LineParams:
    """Units are compared in runs of consecutive ones that together have ``min_words`` words."""

    min_words: int = 20


def units(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, stop, normal form, words) of the lines and sentences of a text that have a word.

    Offsets count code points. The normal form has A-Z in lower case and one
    blank between words.
    """
    found, at = [], 0
    ends = [m.end() for m in UNIT_END.finditer(text)]
    for end in [*ends, len(text)]:
        words = text[at:end].encode("utf-8", "surrogatepass").lower().split()
        if words:
            found.append((at, end, b" ".join(words), len(words)))
        at = end
    return found


def runs(parts: Sequence[tuple[int, int, bytes, int]], min_words: int) -> Iterator[tuple[int, int]]:
    """From every unit on as many as have ``min_words`` words; the last ones grow backwards instead.

    So every unit is in a run, and a text of fewer words is one run.
    """
    end = words = 0
    last = None
    for start in range(len(parts)):
        while words < min_words and end < len(parts):
            words += parts[end][3]
            end += 1
        if words < min_words:
            first = start
            while words < min_words and first > 0:
                first -= 1
                words += parts[first][3]
            if (first, end) != last:
                yield first, end
            return
        last = (start, end)
        yield last
        words -= parts[start][3]


def _body(text: Column) -> list[Column]:
    """Two numbers that tell the texts of rows apart that share a key."""
    halves = (F.substring(F.md5(text), 16 * k + 1, 16) for k in range(2))
    return [F.conv(half, 16, -10).cast("long").alias(name) for half, name in zip(halves, DOC[1:], strict=True)]


def _runs(docs: DataFrame, params: LineParams, text: str, key: str) -> DataFrame:
    """(doc, b1, b2, start, stop, again, d1, d2) of every run; ``again`` if the text has it further ahead."""
    slim = docs.select(F.col(quoted(key)).alias("doc"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    slim = slim.select("doc", *_body(F.col("text")), "text")
    doc_type = slim.schema["doc"].dataType.simpleString()
    min_words = params.min_words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, stops, again, digests = [], [], [], [], []

            def made() -> pa.RecordBatch:
                taken = batch.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
                numbers = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                arrays = [*taken.columns, pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(again, pa.bool_())]
                arrays += [pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(2)]
                for held in (rows, starts, stops, again, digests):
                    held.clear()
                return pa.RecordBatch.from_arrays(arrays, names=[*DOC, "start", "stop", "again", *DIGEST])

            for row, value in enumerate(batch.column(3)):
                parts = units(value.as_py())
                seen = set()
                for a, b in runs(parts, min_words):
                    digest = hashlib.md5(b" ".join([p[2] for p in parts[a:b]]), usedforsecurity=False).digest()
                    rows.append(row)
                    starts.append(parts[a][0])
                    stops.append(parts[b - 1][1])
                    again.append(digest in seen)
                    digests.append(digest)
                    seen.add(digest)
                if len(rows) >= ROWS:
                    yield made()
            if rows:
                yield made()

    return slim.mapInArrow(cut, f"doc {doc_type}, b1 bigint, b2 bigint, start int, stop int, again boolean, d1 bigint, d2 bigint")


def repeats(docs: DataFrame, params: LineParams, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, b1, b2, removed): the spans that go, per document and text that loses any.

    ``removed`` is an array of (start, stop, kept_in) in page order, without
    overlaps: a span is all that later occurrences of runs cover, and
    ``kept_in`` the smallest document that has one of them first. Runs are ranked
    by key, missing ones last, then by text and place.
    """
    found = kept_table(_runs(docs, params, text, key), "runs")
    counted = found.groupBy(*DIGEST).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = kept_table(counted.where("n > 1"), "shared")
    total = found.count()
    repeated = kept_table(joined_by_key(found, shared, DIGEST, "n", total), "repeated")
    # Texts that share the first key: the first of them by its own number.
    rivals = repeated.where("doc <=> first").groupBy(*DIGEST, "n").agg(F.min("b1").alias("least"), F.max("b1").alias("most"))
    rivals = kept_table(rivals.where("least < most").select(*DIGEST, "least", "n"), "rivals")
    later = repeated.where("again OR NOT doc <=> first").unionByName(
        joined_by_key(repeated.where("doc <=> first AND NOT again").drop("n"), rivals, DIGEST, "n", total).where("b1 > least").drop("least")
    )
    spans = later.groupBy(*DOC, "start", "stop").agg(F.min("first").alias("kept_in"))
    order = "OVER (PARTITION BY doc, b1, b2 ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND"
    spans = spans.selectExpr("*", f"start > coalesce(max(stop) {order} 1 PRECEDING), -1) AS opens")
    spans = spans.selectExpr("*", f"count_if(opens) {order} CURRENT ROW) AS number")
    merged = spans.groupBy(*DOC, "number").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_in").alias("kept_in"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kept_in"))).alias("removed"))


def without_repeats(docs: DataFrame, params: LineParams | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``removed`` with their offsets.

    A passage is a run of lines and sentences (see ``runs``); one that only repeats
    by chance is too short to be a run, while a short line goes with its
    neighbours. Nothing else changes: the text left is what lies between the spans.
    Null texts stay null and empty ones empty; rows that agree in key and text are
    one document, none of which loses anything to the other. Rows without a key
    come after all others. An empty table gives an empty one. A column called
    ``removed`` is replaced, all others and all rows stay, and no name of theirs
    clashes with those used inside.
    """
    params = params or LineParams()
    found = kept_table(repeats(docs, params, text, key), "repeats")
    kept = [c for c in docs.columns if c != "removed"]
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(quoted(c)) for c in kept)).alias("row"), F.col(quoted(key)).alias("own"), F.col(quoted(text)).alias("whole"),
        *(c.alias(f"own_{k}") for k, c in enumerate(_body(whole), 1)),
    )
    same = F.col("own").eqNullSafe(F.col("doc")) & (F.col("own_1") == F.col("b1")) & (F.col("own_2") == F.col("b2"))
    joined = rows.join(found, same, "left")
    since = "IF(i = 0, 0, removed[greatest(i - 1, 0)].stop)"
    pieces = f"transform(removed, (x, i) -> substring(whole, {since} + 1, x.start - {since}))"
    cut = f"IF(removed IS NULL, whole, concat(array_join({pieces}, ''), substring(whole, removed[size(removed) - 1].stop + 1))) AS cut"
    none = f"CAST(array() AS {found.schema['removed'].dataType.simpleString()})"
    made = joined.selectExpr("row", cut, f"coalesce(removed, {none}) AS removed")
    return made.select(*(F.col("cut").alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c) for c in kept), "removed")
