"""URL filters: dated list entries become intervals, captures meet those of their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.llm.hot import joined_by_key
from joinseek.llm.text import kept_table
from joinseek.session import quoted


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without its final slash; empty for the root."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.rtrim(found, F.lit("/"))


def url_patterns(url: Column) -> Column:
    """Every pattern that covers a URL, most special first.

    These are the host with its path, then with each shorter path, the host, and
    each parent domain that still has a dot.
    """
    host, steps = host_of(url), F.split(path_of(url), "/", -1)
    labels = F.split(host, r"\.", -1)
    paths = F.transform(
        F.sequence(F.lit(0), F.size(steps) - 1),
        lambda k: F.concat(host, F.array_join(F.slice(steps, F.lit(1), F.size(steps) - k), "/")),
    )
    parents = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels) - 1, F.lit(2))),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    parents = F.when(F.size(labels) > 2, parents).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.concat(paths, parents))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, list, action, valid_from, valid_to) from (list, pattern, action, listed_on).

    An entry holds from its day until the day of the next entry of the same list
    and pattern. Of several on one day the last by name of the action holds.
    Entries that lack the pattern, the list, the action or the day are ignored.
    """
    named = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND action IS NOT NULL AND listed_on IS NOT NULL")
    daily = named.groupBy("list", "pattern", "listed_on").agg(F.max("action").alias("action"))
    until = "lead(listed_on) OVER (PARTITION BY list, pattern ORDER BY listed_on)"
    return daily.selectExpr("pattern", "list", "action", "listed_on AS valid_from", f"{until} AS valid_to")


def in_force(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """The as-of join: ``asked`` (pattern, at, ...) with the entry in force at that time, in ``m``.

    ``intervals`` are those of ``validity``. Both sides stand in one row of time per
    pattern and list, and every question carries the last interval begun, so that m
    intervals and n questions are m + n rows. Of several lists a block comes before an
    allow, then the first by name. Questions no list answers are left out.
    """
    lists = intervals.select("pattern", "list").distinct()
    rest = [c for c in asked.columns if c not in ("pattern", "at")]
    begun = "named_struct('action', action, 'valid_from', valid_from, 'valid_to', valid_to)"
    nothing = (f"CAST(NULL AS {asked.schema[c].dataType.simpleString()}) AS {quoted(c)}" for c in rest)
    starts = intervals.selectExpr("pattern", "list", "valid_from AS at", "0 AS turn", f"{begun} AS begun", *nothing)
    none = f"CAST(NULL AS {starts.schema['begun'].dataType.simpleString()}) AS begun"
    line = asked.join(lists, "pattern").selectExpr("pattern", "list", "at", "1 AS turn", none, *rest).unionAll(starts)
    last = "last_value(begun) IGNORE NULLS OVER (PARTITION BY pattern, list ORDER BY at, turn ROWS UNBOUNDED PRECEDING) AS last"
    answered = line.selectExpr("pattern", "list", "at", "turn", *rest, last).where("turn = 1")
    active = answered.where("last.action IN ('block', 'allow') AND (last.valid_to IS NULL OR at < last.valid_to)")
    first = "min(struct(last.action = 'allow' AS allowed, list, last.valid_from)) AS m"
    return active.groupBy("pattern", "at", *rest).agg(F.expr(first))


def screened(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with blocked, matched_pattern, matched_list and listed_on.

    Every capture is judged by the entries in force on the day it was fetched.
    The most special pattern with an entry ``block`` or ``allow`` decides, a
    block before an allow; ``remove`` ends an entry. A capture without a valid
    URL or day matches nothing and is not blocked. Rows that agree in URL and day
    get the same verdict and all stay; columns called as the four are replaced.
    Days are compared in the type of ``listed_on``.

    Captures ask once per pattern and day, however many there are, and patterns
    and days that many captures share get their answer by a broadcast.
    """
    made = ["blocked", "matched_pattern", "matched_list", "listed_on"]
    rest = [quoted(c) for c in captures.columns if c not in made]
    # Copies of a capture are judged once.
    seen = captures.select(F.col(quoted(url)).alias("__url"), F.col(quoted(fetched)).alias("__day")).distinct()
    at = F.col("__day").cast(entries.schema["listed_on"].dataType).alias("at")
    keyed = seen.where("__day IS NOT NULL").select("__url", "__day", at, F.posexplode(url_patterns(F.col("__url"))).alias("__rank", "pattern"))
    # Only patterns that a list names go on.
    intervals = kept_table(validity(entries), "intervals")
    keyed = kept_table(keyed.join(intervals.select("pattern").distinct(), "pattern", "left_semi"), "captures")
    asked = keyed.groupBy("pattern", "at").agg(F.count(F.lit(1)).alias("captures"))
    answers = kept_table(in_force(asked, intervals), "answers")
    hits = joined_by_key(keyed, answers, ["pattern", "at"], "captures", keyed.count())
    first = F.min(F.expr("struct(__rank, m.allowed, m.list, m.valid_from, pattern)")).alias("m")
    verdicts = hits.groupBy("__url", "__day").agg(first)
    joined = captures.join(
        verdicts, (F.col(quoted(url)) == F.col("__url")) & (F.col(quoted(fetched)) == F.col("__day")), "left"
    )
    return joined.selectExpr(
        *rest,
        "coalesce(NOT m.allowed, false) AS blocked",
        "m.pattern AS matched_pattern",
        "m.list AS matched_list",
        "m.valid_from AS listed_on",
    )
