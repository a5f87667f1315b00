"""Registered queries: every operator over the test tables, as a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinseek.functions.strings import string_similarity
from joinseek.operators.candidates import (
    column_combinations,
    hier_discard,
    hier_parents,
    split_by_parents,
    without_known,
)
from joinseek.operators.contribution import join_contribution, join_on
from joinseek.operators.counters import counter_columns, mode_count, useful_columns
from joinseek.operators.keys import foreign_keys, unique_keys
from joinseek.operators.lake import lake_overlap
from joinseek.operators.names import common_columns, same_category_pairs, similar_columns
from joinseek.operators.neighbourhood import global_rank, sorted_neighbourhood
from joinseek.operators.overlap import CANDIDATE, INFO_TYPE, listing, measure_overlap, rank, useful
from joinseek.operators.profile import (
    SKETCH_ERROR,
    distinct_counts,
    group_by_category,
    merged_sketches,
    profile,
    shape,
    sketch_catalog,
    sketched_distinct,
)
from joinseek.operators.prune import (
    cardinality_discards,
    cardinality_kept,
    drop_properties,
    pair_columns,
    prune_category,
    prune_length,
    prune_missing,
    prune_uniqueness,
)
from joinseek.operators.semantic import Taxonomy, semantic_similarity
from joinseek.operators.similarity import similarity_join
from joinseek.params import Params
from joinseek.plans.discover import discover_joins, pair_table
from joinseek.session import checkpoint_folder, local_table, settle
from joinseek.sources.tables import read_csv, read_parquet

NAME_METHODS = (("Levenshtein", 0.5), ("Jaro", 0.8))
Tables = dict[str, DataFrame]


def load(spark: SparkSession, folder: str, *names: str) -> Tables:
    return {name: read_parquet(spark, f"{folder}/{name}.parquet") for name in names}


def candidates(spark: SparkSession, rows: Sequence[tuple[str, str, list[str], list[str]]]) -> DataFrame:
    """Candidates named by hand: (left table, right table, left, right)."""
    names = ("left_table", "right_table", "left", "right")
    text, many = pa.string(), pa.list_(pa.string())
    table = local_table(
        spark,
        {n: [r[i] for r in rows] for i, n in enumerate(names)},
        dict(zip(names, (text, text, many, many), strict=True)),
    )
    return table.select(F.lit("given").alias("stage"), "*", F.array().cast(INFO_TYPE).alias("similarity_info"))


COLUMNS = ["array_join(left, ',') AS left_columns", "array_join(right, ',') AS right_columns"]
REPORT = [
    "left_table",
    "right_table",
    *COLUMNS,
    "round(join_score, 6) AS join_score",
    "matches",
    "round(total, 6) AS total",
    "CAST(mergeable AS INT) AS mergeable",
    "description",
]


def report_rows(report: DataFrame) -> DataFrame:
    return report.selectExpr(*REPORT)


def profile_rows(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        F.col("table").alias("table_name"),
        F.col("column").alias("column_name"),
        "category",
        "rows",
        "missing",
        F.col("distinct").alias("distinct_values"),
        F.round("avg_chars", 6).alias("avg_chars"),
    )


def with_nulls(orders: DataFrame) -> DataFrame:
    """Orders with missing values and dates as text, which the tables lack."""
    unfinished = F.col("o_orderstatus") != "F"
    return orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(unfinished, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_text"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("rare_day"),
        (F.col("o_orderstatus") == "O").alias("is_open"),
    )


def profile_orders(spark: SparkSession, folder: str) -> DataFrame:
    return profile_rows(profile(load(spark, folder, "orders", "customer", "events")))


def profile_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return profile_rows(profile({"derived": with_nulls(load(spark, folder, "orders")["orders"])}))


def profile_texts(spark: SparkSession, folder: str) -> DataFrame:
    return profile_rows(profile(load(spark, folder, "documents", "pages", "conversations")))


def table_shapes(spark: SparkSession, folder: str) -> DataFrame:
    counted = shape(load(spark, folder, "lineitem", "orders", "events", "documents", "labels"))
    return counted.selectExpr("table AS table_name", "rows AS n_rows", "columns AS n_columns")


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV and read back: types and values survive."""
    path = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    load(spark, folder, "customer")["customer"].write.csv(path, header=True, quote='"', escape='"')
    return read_csv(spark, path)


def category_groups(spark: SparkSession, folder: str) -> DataFrame:
    grouped = group_by_category(profile(load(spark, folder, "lineitem", "events"), distinct=False))
    return grouped.select(F.col("table").alias("table_name"), "category", F.array_join("columns", ",").alias("members"))


def missing_pruned(spark: SparkSession, folder: str) -> DataFrame:
    catalog = profile({"derived": with_nulls(load(spark, folder, "orders")["orders"])}, distinct=False)
    _, dropped = prune_missing(settle(catalog), 0.3)
    return dropped.select(F.col("column").alias("column_name"), "missing", F.round("value", 6).alias("share"))


def length_pruned(spark: SparkSession, folder: str) -> DataFrame:
    catalog = settle(profile(load(spark, folder, "documents", "pages", "conversations", "customer"), distinct=False))
    _, dropped = prune_length(catalog, 70)
    return dropped.select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), F.round("value", 6).alias("avg_chars")
    )


def text_length_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """The rule for the category Text only: dates as text stay."""
    t = load(spark, folder, "customer", "orders")
    catalog = settle(profile({"customer": t["customer"], "derived": with_nulls(t["orders"])}, distinct=False))
    _, dropped = prune_length(catalog, 9, scope="text")
    return dropped.selectExpr("table AS table_name", "column AS column_name", "round(value, 6) AS avg_chars")


def pruned_catalog(spark: SparkSession, folder: str) -> DataFrame:
    catalog = settle(profile({"derived": with_nulls(load(spark, folder, "orders")["orders"])}))
    _, sparse = prune_missing(catalog, 0.3)
    return profile_rows(drop_properties(catalog, sparse))


def uniqueness_pruned(spark: SparkSession, folder: str) -> DataFrame:
    catalog = settle(profile(load(spark, folder, "lineitem", "orders")))
    kept, _ = prune_uniqueness(catalog, 1, 0.2)
    return kept.selectExpr("table AS table_name", "column AS column_name", "distinct AS distinct_values")


def category_pruned(spark: SparkSession, folder: str) -> DataFrame:
    catalog = settle(profile(load(spark, folder, "orders", "region", "customer"), distinct=False))
    pairs = pair_table(spark, [("orders", "region"), ("orders", "customer")])
    _, dropped = prune_category(catalog, pairs)
    return dropped.select("left_table", "right_table", "side", F.col("column").alias("column_name"), "category", "rows")


def cardinality_discarded(spark: SparkSession, folder: str) -> DataFrame:
    catalog = settle(profile(load(spark, folder, "orders", "customer")))
    found = cardinality_discards(catalog, pair_table(spark, [("orders", "customer")]), 0.45)
    return found.select("left_column", "right_column", "left_distinct", "right_distinct")


def cardinality_pairs(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "orders", "customer", "lineitem", "part")
    pairs = pair_table(spark, [("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part")])
    found = cardinality_kept(settle(profile(t)), pairs, 0.45)
    return found.select("left_table", "right_table", "left_column", "right_column", "left_distinct", "right_distinct")


def sketched_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values from sketches of two halves of each table, beside the exact counts."""
    t = load(spark, folder, "orders", "customer", "events")
    halves = [
        {name: df.where(f"pmod(xxhash64({df.columns[0]}), 2) = {half}") for name, df in t.items()} for half in (0, 1)
    ]
    found = sketched_distinct(merged_sketches([sketch_catalog(half) for half in halves])).withColumnRenamed("distinct", "estimate")
    exact = distinct_counts(t)
    close = f"CAST(abs(estimate - distinct) <= {SKETCH_ERROR}D * distinct AS INT) AS is_close"
    return found.join(exact, ["table", "column"]).selectExpr("table AS table_name", "column AS column_name", "rows", "missing", "distinct AS distinct_values", close)


def text_similarity(method: str) -> Callable[[SparkSession, str], DataFrame]:
    """The names of any two parts that are in one order."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = load(spark, folder, "lineitem", "part")
        named = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name").distinct()
        other = named.select("l_orderkey", F.col("p_name").alias("other_name"))
        pairs = named.join(other, "l_orderkey").where("p_name <= other_name").select("p_name", "other_name").distinct()
        scored = pairs.select("p_name", "other_name", string_similarity("p_name", "other_name", method).alias("info"))
        return scored.select("p_name", "other_name", F.round("info.score", 6).alias("score"), F.col("info.method").alias("method"))

    return query


def similar_words(method: str, minimum: float) -> Callable[[SparkSession, str], DataFrame]:
    """The words of the benchmark beside similar ones of the conversations."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = load(spark, folder, "benchmark", "conversations")
        sides = [df.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''") for df in t.values()]
        found = similarity_join(*sides, "word", "word", method, minimum)
        return found.select(F.col("left_value").alias("left_word"), F.col("right_value").alias("right_word"), F.round("score", 6).alias("score"))

    return query


def world_taxonomy(t: Tables) -> Taxonomy:
    """Customers and suppliers below nations, regions and the world.

    A customer has a second sense below its market segment.
    """
    nation = F.concat(F.lit("n"), F.col("n_nationkey"))
    region = F.concat(F.lit("r"), F.col("r_regionkey"))

    def edges(df: DataFrame, child: Column, parent: Column) -> DataFrame:
        return df.select(child.alias("child"), parent.alias("parent"))

    def meanings(df: DataFrame, word: str, sense: Column) -> DataFrame:
        return df.select(F.col(word).alias("word"), sense.alias("sense"))

    customer, market = F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("m"), F.col("c_custkey"))
    supplier = F.concat(F.lit("s"), F.col("s_suppkey"))
    isa = (
        edges(t["customer"], customer, F.concat(F.lit("n"), F.col("c_nationkey")))
        .unionAll(edges(t["customer"], market, F.concat(F.lit("seg"), F.col("c_mktsegment"))))
        .unionAll(edges(t["supplier"], supplier, F.concat(F.lit("n"), F.col("s_nationkey"))))
        .unionAll(edges(t["nation"], nation, F.concat(F.lit("r"), F.col("n_regionkey"))))
        .unionAll(edges(t["region"], region, F.lit("world")))
    )
    senses = (
        meanings(t["customer"], "c_name", customer)
        .unionAll(meanings(t["customer"], "c_name", market))
        .unionAll(meanings(t["supplier"], "s_name", supplier))
    )
    return Taxonomy(senses, isa)


def path_similarity(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "customer", "supplier", "nation", "region", "orders", "lineitem")
    words = (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "l_suppkey")
        .distinct()
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .select("c_name", "s_name")
    )
    return semantic_similarity(words, world_taxonomy(t), "c_name", "s_name").withColumn("score", F.round("score", 6))


COMMON = [("labels", "documents"), ("conversations", "documents"), ("benchmark", "documents")]
SIMILAR = [("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]


def common_names(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "labels", "documents", "conversations", "benchmark")
    catalog = settle(profile(t, distinct=False))
    return report_rows(measure_overlap(t, common_columns(catalog, pair_table(spark, COMMON)), catalog))


def similar_names(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "orders", "customer", "lineitem", "part", "supplier")
    catalog = settle(profile(t, distinct=False))
    found = similar_columns(catalog, pair_table(spark, SIMILAR), NAME_METHODS)
    report = measure_overlap(t, found, catalog)
    return report.selectExpr(
        "left_table",
        "right_table",
        *COLUMNS,
        "array_join(similarity_info.method, ',') AS methods",
        "round(array_max(similarity_info.score), 6) AS name_score",
        "matches",
        "description",
    )


HALVES = ("finished", "unfinished")


def line_halves(spark: SparkSession, folder: str) -> Tables:
    """Lines of orders split by status, so that some column pairs fail."""
    lines = load(spark, folder, "lineitem")["lineitem"]
    finished = F.col("l_linestatus") == "F"
    return dict(zip(HALVES, (lines.where(finished), lines.where(~finished)), strict=True))


def combined_columns(spark: SparkSession, folder: str) -> DataFrame:
    t = line_halves(spark, folder)
    catalog = settle(profile(t, distinct=False))
    singles = common_columns(catalog, pair_table(spark, [HALVES]))
    return report_rows(measure_overlap(t, column_combinations(singles), catalog, min_join=0.0))


def hierarchical_discard(spark: SparkSession, folder: str) -> DataFrame:
    t = line_halves(spark, folder)
    catalog = settle(profile(t, distinct=False))
    singles = common_columns(catalog, pair_table(spark, [HALVES]))
    parents = hier_parents(measure_overlap(t, singles, catalog, min_join=0.001), 1)
    kept = hier_discard(column_combinations(singles), parents)
    return report_rows(measure_overlap(t, kept, catalog, min_join=0.001))


def hierarchical_rest(spark: SparkSession, folder: str) -> DataFrame:
    t = line_halves(spark, folder)
    catalog = settle(profile(t, distinct=False))
    singles = common_columns(catalog, pair_table(spark, [HALVES]))
    parents = hier_parents(measure_overlap(t, singles, catalog, min_join=0.001), 1)
    split = split_by_parents(column_combinations(singles), parents)
    return split.selectExpr(
        COLUMNS[0], "CAST(is_child AS INT) AS is_child", "array_join(remaining.left, ',') AS remaining"
    )


def single_keys(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "lineitem", "orders", "customer")
    return key_rows(unique_keys(t, settle(profile(t)), 0.95))


def composite_keys(spark: SparkSession, folder: str) -> DataFrame:
    """At ratio 1 no single column is a key."""
    t = load(spark, folder, "lineitem")
    return key_rows(unique_keys(t, settle(profile(t)), 1))


def key_rows(keys: DataFrame) -> DataFrame:
    return keys.select(
        F.col("table").alias("table_name"),
        F.col("number").cast("int").alias("n_columns"),
        F.array_join("columns.name", ",").alias("key_columns"),
        F.round("percentage", 6).alias("percentage"),
    )


def key_references(
    spark: SparkSession, keys_of: str, other: str, side: str, t: Tables, min_join: float = 0.45, min_ratio: float = 0.95
) -> DataFrame:
    catalog = settle(profile(t))
    pair = (keys_of, other) if side == "left" else (other, keys_of)
    both = pair_columns(catalog, pair_table(spark, [pair]))
    scope = ["left_table", "right_table", "table"]
    keys = unique_keys(t, both.where(F.col("table") == keys_of), min_ratio, scope=scope)
    same = [(c, c) for c in ("left_table", "right_table")]
    found = foreign_keys(keys, both.where(F.col("table") == other), same, side)
    rows = both.where(F.col("table") == keys_of).select("table", "rows").distinct()
    counted = keys.join(rows, "table").selectExpr(
        "table", "transform(columns, c -> c.name) AS columns", "CAST(rint(percentage * rows) AS BIGINT) AS keys"
    )
    return report_rows(measure_overlap(t, found, catalog, min_join, key_counts=counted))


def single_references(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "customer", "orders")
    return key_references(spark, "customer", "orders", "right", t)


def composite_references(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "lineitem", "events")
    return key_references(spark, "lineitem", "events", "left", t, min_join=0.1, min_ratio=1)


def category_pairs(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "supplier", "customer")
    catalog = settle(profile(t, distinct=False))
    found = same_category_pairs(catalog, pair_table(spark, [("supplier", "customer")]))
    return report_rows(measure_overlap(t, found, catalog))


def not_yet_known(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "lineitem", "supplier")
    catalog = settle(profile(t, distinct=False))
    pairs = pair_table(spark, [("lineitem", "supplier")])
    known = similar_columns(catalog, pairs, NAME_METHODS)
    return report_rows(measure_overlap(t, without_known(same_category_pairs(catalog, pairs), known), catalog))


def measured(
    rows: Sequence[tuple[str, str, list[str], list[str]]], known_sizes: bool = False, **options
) -> Callable[[SparkSession, str], DataFrame]:
    """A query that scores the given candidates."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = load(spark, folder, *sorted({r[i] for r in rows for i in (0, 1)}))
        catalog = settle(profile(t, distinct=known_sizes))
        return report_rows(measure_overlap(t, candidates(spark, rows), catalog, **options))

    return query


JACCARD = [
    ("lineitem", "orders", ["l_orderkey"], ["o_orderkey"]),
    ("lineitem", "orders", ["l_orderkey", "l_shipdate"], ["o_orderkey", "o_orderdate"]),
    ("lineitem", "orders", ["l_orderkey", "l_partkey"], ["o_orderkey"]),
    ("lineitem", "orders", ["l_orderkey"], ["no_such_column"]),
    ("lineitem", "orders", ["l_orderkey", "l_returnflag"], ["o_orderkey", "o_custkey"]),
    ("lineitem", "orders", ["l_linestatus"], ["o_orderstatus"]),
    ("lineitem", "orders", ["l_extendedprice"], ["o_custkey"]),
    ("orders", "customer", ["o_custkey"], ["c_custkey"]),
]
COSINE = [("labels", "documents", ["doc_id"], ["doc_id"]), ("labels", "documents", ["quality"], ["doc_id"])]
PRUNED = [("events", "customer", ["user_id"], ["c_custkey"]), ("lineitem", "part", ["l_partkey"], ["p_partkey"])]


def order_views(spark: SparkSession, folder: str) -> Tables:
    """All orders twice, with the priority missing for one status or another."""
    orders = load(spark, folder, "orders")["orders"]

    def without(status: str) -> DataFrame:
        known = F.when(F.col("o_orderstatus") != status, F.col("o_orderpriority"))
        return orders.select("o_custkey", known.alias("priority"))

    return {"not_final": without("F"), "not_open": without("O")}


def merged_nulls(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = order_views(spark, folder)
        catalog = settle(profile(t, distinct=False))
        both = ["o_custkey", "priority"]
        rows = [("not_final", "not_open", both, both), ("not_final", "not_open", ["priority"], ["priority"])]
        return report_rows(measure_overlap(t, candidates(spark, rows), catalog, 0.2, method))

    return query


def result_listing(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "lineitem", "orders", "customer")
    catalog = settle(profile(t, distinct=False))
    return listing(measure_overlap(t, candidates(spark, JACCARD), catalog)).select("left_table", "right_table", "line")


TIES = (1, 3, 67, 201, 333, 402, 1005, 2001, 2675, 3999)


def listing_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of 4,000 in percent: many end in a five at the third decimal."""
    orders = load(spark, folder, "orders")["orders"]
    t = {
        "residues": orders.selectExpr("o_orderkey % 4000 AS k"),
        "parts": orders.selectExpr(*(f"o_orderkey % {m} AS m{m}" for m in TIES)),
    }
    catalog = settle(profile(t, distinct=False))
    rows = [("residues", "parts", ["k"], [f"m{m}"]) for m in TIES]
    report = measure_overlap(t, candidates(spark, rows), catalog, 0.0)
    return listing(report).select("left_table", "right_table", "line")


def ranked_report(spark: SparkSession, folder: str) -> DataFrame:
    """Mergeable candidates of equal category with their place by score."""
    t = load(spark, folder, "lineitem", "orders")
    catalog = settle(profile(t, distinct=False))
    found = same_category_pairs(catalog, pair_table(spark, [("lineitem", "orders")]))
    merged, _ = useful(measure_overlap(t, found, catalog))
    # One row per candidate, so this window is small whatever the data size.
    place = F.row_number().over(Window.orderBy(F.desc("join_score"), *CANDIDATE)).alias("place")
    return rank(merged).select(place, "*").selectExpr("place", *COLUMNS, "round(join_score, 6) AS join_score")


def near_balances(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "supplier", "customer")
    pairs = sorted_neighbourhood(
        t["supplier"], t["customer"], ["s_acctbal", "s_nationkey"], ["c_acctbal", "c_nationkey"]
    )
    return pairs.select(
        F.round("left_0", 2).alias("s_acctbal"),
        F.round("right_0", 2).alias("c_acctbal"),
        F.col("left_1").cast("int").alias("nation"),
        F.col("exact").cast("int").alias("exact"),
    )


def near_order_keys(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "lineitem", "orders")
    pairs = sorted_neighbourhood(t["lineitem"], t["orders"], ["l_orderkey"], ["o_orderkey"])
    return pairs.where("exact").select(F.col("left_0").alias("l_orderkey"), F.col("right_0").alias("o_orderkey"))


def ranked_prices(spark: SparkSession, folder: str) -> DataFrame:
    prices = load(spark, folder, "lineitem")["lineitem"].select(F.col("l_extendedprice").alias("price")).distinct()
    return global_rank(prices, "price").select("price", F.col("rank").alias("place"))


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "customer", "orders", "lineitem")
    t["derived"] = with_nulls(t["orders"])
    rows = [
        ("customer", "orders", ["c_custkey"], ["o_custkey"]),
        ("lineitem", "derived", ["l_orderkey"], ["o_orderkey"]),
        ("derived", "orders", ["priority"], ["o_orderpriority"]),
        ("orders", "derived", ["o_orderkey", "o_orderpriority"], ["o_orderkey", "priority"]),
    ]
    rounded = [f"round({c}, 6) AS {c}" for c in ("right_adds", "left_adds")]
    return join_contribution(t, candidates(spark, rows)).selectExpr(
        "left_table", "right_table", *COLUMNS, "CAST(joined_rows AS BIGINT) AS joined_rows", *rounded
    )


def renamed_join(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "labels", "documents")
    return join_on(t["labels"], t["documents"], ["doc_id"], ["doc_id"])


def counters(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "orders", "customer", "lineitem", "events", "documents")
    found = counter_columns(t, settle(profile(t)))
    return found.select(
        F.col("table").alias("table_name"),
        F.col("column").alias("column_name"),
        F.round("uniqueness", 6).alias("uniqueness"),
        F.round("miss", 6).alias("miss"),
        F.col("is_counter").cast("int").alias("is_counter"),
    )


def all_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The same test for every number, whole and fractional, however often it repeats."""
    t = load(spark, folder, "orders", "customer")
    return tested_misses(t)


def decimal_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys beyond the whole numbers of a double, as decimals."""
    orders = load(spark, folder, "orders")["orders"]
    big = "CAST(o_orderkey + 9007199254740992 AS DECIMAL(20, 0)) AS big_key"
    return tested_misses({"decimals": orders.selectExpr(big, "CAST(o_custkey AS DECIMAL(12, 2)) AS customer")})


def tested_misses(t: Tables) -> DataFrame:
    found = counter_columns(t, settle(profile(t)), min_uniqueness=0.0)
    return found.where("miss IS NOT NULL").select(
        F.col("column").alias("column_name"), F.round("miss", 6).alias("miss")
    )


def modes(spark: SparkSession, folder: str) -> DataFrame:
    return mode_count(load(spark, folder, "lineitem")["lineitem"], "l_quantity", ["l_returnflag", "l_linestatus"])


def searched(*pairs: tuple[str, str], what: str = "report", **options) -> Callable[[SparkSession, str], DataFrame]:
    """A whole search over the given table pairs."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = load(spark, folder, *sorted({name for pair in pairs for name in pair}))
        found = discover_joins(t, pairs, Params(name_methods=NAME_METHODS, **options))
        if what == "contribution":
            rounded = [f"round({c}, 6) AS {c}" for c in ("right_adds", "left_adds")]
            return found.contribution.selectExpr("left_table", "right_table", *COLUMNS, *rounded)
        if what == "counters":
            return found.counters.select("left_table", "right_table", "side", F.col("column").alias("column_name"))
        if what == "useful":
            used = useful_columns(found.report)
            return used.select("left_table", "right_table", "side", F.col("column").alias("column_name"))
        if what == "dropped":
            lengths = F.round("value", 6).alias("avg_chars")
            return found.dropped.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), lengths)
        kept = found.report if what == "report" else found.mergeable
        return kept.selectExpr("stage", *REPORT)

    return query


def halves_search(spark: SparkSession, folder: str) -> DataFrame:
    """Tables with equal names: the search ends in its first stage, combinations included."""
    found = discover_joins(line_halves(spark, folder), [HALVES], Params(name_methods=NAME_METHODS))
    return found.report.selectExpr("stage", *REPORT)


NAMED_ALIKE = [("customer", "nation"), ("nation", "region"), ("lineitem", "part"), ("lineitem", "supplier")]


def name_taxonomy(t: Tables) -> Taxonomy:
    """Column names by what follows their prefix; a retailprice is a price, and so on."""
    spark = next(iter(t.values())).sparkSession
    named = local_table(spark, {"word": sorted({c for df in t.values() for c in df.columns})}, {"word": pa.string()})
    senses = named.selectExpr("word", "regexp_extract(word, '_(.*)$', 1) AS sense")
    isa = senses.selectExpr("sense AS child", "regexp_extract(sense, '(price|date|status|name)$', 1) AS parent")
    return Taxonomy(senses, isa.where("parent <> '' AND parent <> child").distinct())


def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search in which only the meaning of names decides; triples are the combinations tried."""
    t = load(spark, folder, *sorted({name for pair in NAMED_ALIKE for name in pair}))
    params = Params(name_methods=(("Semantic", 0.3),), combination_sizes=(3,))
    found = discover_joins(t, NAMED_ALIKE, params, name_taxonomy(t))
    return found.report.selectExpr("stage", *REPORT, "round(array_max(similarity_info.score), 6) AS name_score")


ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def overlaps_of_all(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of all tables beside one another."""
    t = load(spark, folder, *ALL_TABLES)
    found = lake_overlap(t, settle(profile(t, distinct=False)), 0.45)
    return found.withColumn("join_score", F.round("join_score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "table_shapes": table_shapes,
    "csv_scan": csv_scan,
    "profile_orders": profile_orders,
    "profile_nulls": profile_nulls,
    "profile_texts": profile_texts,
    "category_groups": category_groups,
    "prune_missing": missing_pruned,
    "prune_length": length_pruned,
    "prune_length_text": text_length_pruned,
    "prune_uniqueness": uniqueness_pruned,
    "prune_category": category_pruned,
    "pruned_catalog": pruned_catalog,
    "cardinality_discard": cardinality_discarded,
    "cardinality_kept": cardinality_pairs,
    "profile_sketch": sketched_profile,
    "name_equality": text_similarity("Equality"),
    "name_levenshtein": text_similarity("Levenshtein"),
    "name_jaro": text_similarity("Jaro"),
    "similarity_join": similar_words("Levenshtein", 0.8),
    "similarity_join_jaro": similar_words("Jaro", 0.9),
    "semantic_similarity": path_similarity,
    "common_columns": common_names,
    "similar_columns": similar_names,
    "column_combinations": combined_columns,
    "hier_discard": hierarchical_discard,
    "hier_remaining": hierarchical_rest,
    "already_discarded": not_yet_known,
    "unique_keys": single_keys,
    "unique_keys_composite": composite_keys,
    "foreign_keys": single_references,
    "foreign_keys_composite": composite_references,
    "same_category_pairs": category_pairs,
    "overlap_jaccard": measured(JACCARD),
    "overlap_cosine": measured(COSINE, score_method="cosine"),
    "overlap_pruned": measured(PRUNED, known_sizes=True),
    "overlap_merge": merged_nulls("Merge"),
    "overlap_exact_nulls": merged_nulls("SortedNeighborhood"),
    "result_listing": result_listing,
    "listing_ties": listing_ties,
    "rank_by_score": ranked_report,
    "sorted_neighbourhood": near_balances,
    "sorted_neighbourhood_exact": near_order_keys,
    "global_rank": ranked_prices,
    "join_contribution": contributions,
    "renamed_join": renamed_join,
    "counter_columns": counters,
    "counter_buckets": all_counters,
    "counter_decimals": decimal_counters,
    "mode_count": modes,
    "lake_overlap": overlaps_of_all,
    "discover_orders_customer": searched(("orders", "customer")),
    "discover_labels_documents": searched(("labels", "documents")),
    "discover_cosine": searched(("labels", "documents"), score_method="cosine"),
    "discover_merge": searched(("orders", "customer"), eval_method="Merge"),
    "discover_common_names": halves_search,
    "discover_semantic": semantic_search,
    "discover_dropped": searched(("labels", "documents"), what="dropped"),
    "discover_useful_columns": searched(("lineitem", "orders"), ("customer", "nation"), what="useful"),
    "discover_contribution": searched(("orders", "customer"), what="contribution"),
    "discover_counters": searched(("orders", "customer"), ("part", "lineitem"), what="counters"),
    "discover_lake": searched(
        ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("customer", "nation"),
        ("nation", "region"), ("events", "customer"), what="mergeable",
    ),
}
