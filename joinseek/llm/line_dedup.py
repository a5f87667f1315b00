"""Lines that several documents hold stay in the first of them only.

Every line is normalised and hashed, documents are counted per hash, and lines
whose hash is in enough documents go from all but the smallest document. Texts
are put together again from the places of the lines that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.llm.hot import joined_by_key
from joinseek.llm.text import kept_table
from joinseek.session import quoted

#: Blank, tab, line feed to carriage return.
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class LineDedupParams:
    """Lines whose key has ``min_chars`` code points and is in ``min_documents`` documents are repeats."""

    min_chars: int = 10
    min_documents: int = 2


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _body(text: Column) -> Column:
    """A digest of the whole text, which tells rows apart that share a key."""
    return F.unhex(F.md5(text))


def repeated_places(docs: DataFrame, params: LineDedupParams | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, body, places): the numbers of the lines that go, from 0, per document and text that loses any.

    Only digests travel: a row per line that is long enough to count, first
    reduced to one per document and digest. Lines held by very many documents meet
    their count where they are.
    """
    params = params or LineDedupParams()
    whole = docs.select(F.col(quoted(key)).alias("doc"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    exploded = whole.select("doc", _body(F.col("text")).alias("body"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    keyed = exploded.select("doc", "body", "place", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.char_length("key") >= params.min_chars)
    units = kept_table(keyed.select("doc", "body", "place", F.unhex(F.md5("key")).alias("digest")), "line-units")
    holders = units.groupBy("digest", "doc").agg(F.count(F.lit(1)).alias("n"))
    held = holders.groupBy("digest").agg(
        F.count(F.lit(1)).alias("documents"), F.min("doc").alias("first"), F.sum("n").alias("lines")
    )
    shared = kept_table(held.where(F.col("documents") >= params.min_documents), "line-shared")
    total = units.count()
    later = joined_by_key(units, shared, ["digest"], "lines", total).where(~F.col("doc").eqNullSafe(F.col("first")))
    return later.groupBy("doc", "body").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without_repeated_lines(
    docs: DataFrame, params: LineDedupParams | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and ``n_lines`` and ``n_dropped`` (bigint).

    Lines end at line feeds only. ``n_lines`` counts them before any goes; a null
    or empty text is one empty line and comes out empty. A repeat stays in all
    rows of the smallest key that holds it, also where that key holds it twice.
    Rows that share a key are one document. Rows without a key are one document
    after all others. Equal rows stay and are cut alike. An empty table gives an
    empty one. Columns called as the new ones are replaced, all others stay, and
    no name of theirs clashes with those used inside.
    """
    found = kept_table(repeated_places(docs, params, text, key), "line-repeats")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(quoted(c)) for c in kept)).alias("row"), F.col(quoted(key)).alias("own"), body.alias("whole")
    )
    same = F.col("own").eqNullSafe(F.col("doc")) & (_body(F.col("whole")) == F.col("body"))
    joined = rows.join(found, same, "left").select("row", _lines(F.col("whole")).alias("lines"), "whole", "places")
    # The runs of lines between those that go.
    runs = (
        "transform(sequence(0, size(places)), i -> slice(lines, IF(i = 0, 0, places[greatest(i - 1, 0)] + 1) + 1, "
        "IF(i = size(places), size(lines), places[least(i, size(places) - 1)]) - IF(i = 0, 0, places[greatest(i - 1, 0)] + 1)))"
    )
    joined = joined.selectExpr(
        "row",
        f"IF(places IS NULL, whole, array_join(flatten({runs}), '\\n')) AS cut",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        "CAST(coalesce(size(places), 0) AS BIGINT) AS n_dropped",
    )
    columns = [F.col("cut").alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c) for c in kept]
    return joined.select(*columns, "n_lines", "n_dropped")
