"""The whole search: four stages, each for the table pairs still without a join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.operators.candidates import (
    PAIR,
    column_combinations,
    hier_parents,
    hier_singles,
    without_known,
)
from joinseek.operators.contribution import join_contribution
from joinseek.operators.counters import counter_columns, useful_columns
from joinseek.operators.keys import foreign_keys, unique_keys
from joinseek.operators.names import common_columns, same_category_pairs, similar_columns
from joinseek.operators.overlap import CANDIDATE, measure_overlap, rank
from joinseek.operators.profile import add_distinct, column_stats, union_all
from joinseek.operators.prune import prune_category, prune_length, prune_missing
from joinseek.operators.semantic import Taxonomy
from joinseek.params import Params
from joinseek.session import local_table, settle, written


@dataclass
class Discovery:
    """What a search found; every part is a DataFrame.

    ``columns`` profiles all columns, ``catalog`` those not ``dropped``. The
    report is complete when the search returns; counters and contributions read
    the data again and do so only when asked for.
    """

    tables: Mapping[str, DataFrame]
    params: Params
    columns: DataFrame
    catalog: DataFrame
    dropped: DataFrame
    report: DataFrame

    @property
    def mergeable(self) -> DataFrame:
        """The candidates that join well enough, best first."""
        return rank(self.report.where("mergeable"))

    @cached_property
    def counters(self) -> DataFrame:
        """Columns of mergeable candidates that may be mere counters."""
        used = useful_columns(self.report)
        counted = self._with_distinct(used.select("table", "column").distinct())
        limits = (self.params.counter_min_uniqueness, self.params.counter_max_miss)
        tests = counter_columns(self.tables, counted, used, *limits)
        return used.join(tests, ["table", "column"]).where("is_counter").select(*PAIR, "side", "column")

    @cached_property
    def contribution(self) -> DataFrame:
        """What each mergeable candidate adds to either side."""
        return join_contribution(self.tables, self.report.where("mergeable"), self.columns)

    def _with_distinct(self, columns: DataFrame) -> DataFrame:
        """Catalogue rows of these columns; only unknown distinct counts are read."""
        asked = self.catalog.join(columns, ["table", "column"], "left_semi")
        known = settle(with_measured(asked, self.report))
        unread = add_distinct(known.where("distinct IS NULL AND category = 'Numerical'"), self.tables)
        return known.where("distinct IS NOT NULL").unionByName(unread)


def with_measured(catalog: DataFrame, report: DataFrame) -> DataFrame:
    """The catalogue with the distinct counts that scoring single pairs has shown."""
    measured = union_all(
        [
            report.where(f"size({side}) = 1 AND {side}_keys IS NOT NULL").selectExpr(
                f"{side}_table AS table", f"{side}[0] AS column", f"{side}_keys AS keys"
            )
            for side in ("left", "right")
        ]
    )
    keys = measured.groupBy("table", "column").agg(F.max("keys").alias("keys"))
    joined = catalog.join(keys, ["table", "column"], "left")
    return joined.withColumn("distinct", F.expr("coalesce(distinct, keys - IF(missing > 0, 1, 0))")).drop("keys")


def table_pairs(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str]] | None) -> list[tuple[str, str]]:
    """The given pairs, or every pair of tables in the order of the mapping."""
    names = list(tables)
    if pairs is None:
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    unknown = {t for pair in pairs for t in pair} - set(names)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return list(pairs)


def pair_table(spark, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return local_table(
        spark,
        {"left_table": [a for a, _ in pairs], "right_table": [b for _, b in pairs]},
        {"left_table": pa.string(), "right_table": pa.string()},
    )


@dataclass
class _Search:
    tables: Mapping[str, DataFrame]
    params: Params
    taxonomy: Taxonomy | None
    catalog: DataFrame
    pairs: DataFrame
    reports: list[DataFrame] = field(default_factory=list)

    def measure(self, candidates: DataFrame) -> DataFrame:
        """Score candidates and add them to the reports."""
        p = self.params
        report = written(
            measure_overlap(self.tables, candidates, self.catalog, p.min_join, p.eval_method, p.score_method)
        )
        self.reports.append(report)
        return report

    def known(self) -> DataFrame:
        return union_all(self.reports)

    def with_known_distinct(self, catalog: DataFrame) -> DataFrame:
        """The catalogue with the distinct counts the search has come to know."""
        if self.catalog is catalog:
            return catalog
        known = self.catalog.select("table", "column", "distinct")
        return catalog.drop("distinct").join(known, ["table", "column"], "left")

    def close_pairs(self) -> bool:
        """Drop table pairs that have a join now; true if any is left."""
        merged = self.known().where("mergeable").select(*PAIR).distinct()
        self.pairs = settle(self.pairs.join(merged, PAIR, "left_anti"))
        return not self.pairs.isEmpty()

    def measure_combined(self, singles: DataFrame, stage: str) -> None:
        """Score combinations of single pairs, unless they contain a failed one."""
        known = self.known()
        parents = hier_parents(known, self.params.hier_max_matches)
        usable = written(hier_singles(singles, parents))
        if usable.count() >= min(self.params.combination_sizes):
            combined = column_combinations(usable, self.params.combination_sizes, stage)
            self.measure(without_known(combined, known))

    def same_names(self) -> None:
        common = common_columns(self.catalog, self.pairs)
        self.measure(common)
        self.measure_combined(common, "S1")

    def similar_names(self) -> None:
        similar = similar_columns(self.catalog, self.pairs, self.params.name_methods, self.taxonomy)
        similar = written(without_known(similar, self.known()))
        self.measure(similar)
        self.measure_combined(similar.unionAll(common_columns(self.catalog, self.pairs)), "S2")

    def key_references(self) -> None:
        p = self.params
        used = self.pairs.select(F.col("left_table").alias("table")).unionAll(self.pairs.select("right_table"))
        still = self.catalog.join(used.distinct(), "table", "left_semi")
        known = settle(with_measured(still, self.known()))
        # Only columns that no stage has counted are read.
        unread = add_distinct(known.where("distinct IS NULL"), self.tables)
        counted = settle(known.where("distinct IS NOT NULL").unionByName(unread))
        self.catalog = counted
        sided, _ = prune_category(counted, self.pairs)
        keys = unique_keys(self.tables, sided, p.min_key_ratio, p.max_key_columns, scope=[*PAIR, "side", "table"])
        found = []
        for side, other in (("left", "right"), ("right", "left")):
            found.append(
                foreign_keys(
                    keys.where(F.col("side") == side),
                    sided.where(F.col("side") == other),
                    on=[(c, c) for c in PAIR],
                    key_side=side,
                    max_columns=p.max_key_columns,
                )
            )
        candidates = found[0].unionAll(found[1]).dropDuplicates(CANDIDATE)
        self.measure(without_known(candidates, self.known()))

    def same_categories(self) -> None:
        self.measure(without_known(same_category_pairs(self.catalog, self.pairs), self.known()))


def discover_joins(
    tables: Mapping[str, DataFrame],
    pairs: Sequence[tuple[str, str]] | None = None,
    params: Params = Params(),
    taxonomy: Taxonomy | None = None,
) -> Discovery:
    """On which columns can these tables be joined, how well, and to what gain?

    The stages are S1 equal names, S2 similar names, S3 unique key to foreign
    key, S4 any columns of equal category. A table pair leaves the search at the
    first stage that finds a mergeable candidate. All pairs of a stage share its
    jobs; between jobs the driver only reads column names and small counts, while
    candidates and reports stay in the checkpoint folder.
    """
    spark = next(iter(tables.values())).sparkSession
    catalog = settle(column_stats(tables)).withColumn("distinct", F.lit(None).cast("bigint"))
    kept, sparse = prune_missing(catalog, params.max_missing)
    kept, long = prune_length(kept, params.max_avg_chars, params.length_scope)
    kept = settle(kept)
    search = _Search(tables, params, taxonomy, kept, pair_table(spark, table_pairs(tables, pairs)))
    for stage in (search.same_names, search.similar_names, search.key_references, search.same_categories):
        stage()
        if not search.close_pairs():
            break
    return Discovery(
        tables=tables,
        params=params,
        columns=catalog,
        catalog=search.with_known_distinct(kept),
        dropped=sparse.drop("missing").unionAll(long),
        report=search.known(),
    )
