"""For each registered query the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

TIES = (1, 3, 67, 201, 333, 402, 1005, 2001, 2675, 3999)

# Columns of the test tables in table order, by kind: i whole number, d
# fractional number, s string, t timestamp.
SCHEMAS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d "
    "l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
    # Its vectors are left out: no other column holds arrays.
    "embeddings": "vec_id:i label:i",
    "derived": "o_orderkey:i o_custkey:i priority:s price:d day_text:s rare_day:s is_open:b",
    "residues": "k:i",
    "parts": " ".join(f"m{m}:i" for m in TIES),
}
SCHEMAS |= dict.fromkeys(("finished", "unfinished"), SCHEMAS["lineitem"])
FIXED = {"i": "Numerical", "d": "Numerical", "b": "Boolean"}

DERIVED = """(SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority,
  CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS price,
  strftime(o_orderdate, '%d/%m/%Y') AS day_text,
  CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') END AS rare_day,
  o_orderstatus = 'O' AS is_open FROM orders) AS derived"""
SOURCES = {
    "derived": DERIVED,
    "finished": "(SELECT * FROM lineitem WHERE l_linestatus = 'F') AS finished",
    "unfinished": "(SELECT * FROM lineitem WHERE l_linestatus <> 'F') AS unfinished",
    "residues": "(SELECT o_orderkey % 4000 AS k FROM orders) AS residues",
    "parts": f"(SELECT {', '.join(f'o_orderkey % {m} AS m{m}' for m in TIES)} FROM orders) AS parts",
}


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in SCHEMAS[table].split()]


def source(table: str) -> str:
    return SOURCES.get(table, table)


def category(name: str, kind: str) -> str:
    """An aggregate expression for the category of a column."""
    if kind in FIXED:
        return f"'{FIXED[kind]}'"
    if kind == "t":
        return f"CASE WHEN count({name}) > 0.5 * count(*) THEN 'Date' ELSE 'Text' END"
    tests = []
    for order in ("%d/%m/%Y", "%m/%d/%Y"):
        tests.append(f"count(coalesce(try_strptime({name}, '%Y-%m-%d'), try_strptime({name}, '{order}')))")
    return f"CASE WHEN greatest({', '.join(tests)}) > 0.5 * count(*) THEN 'Date' ELSE 'Text' END"


def profile(*tables: str) -> str:
    """Catalogue rows: one per column."""
    parts = []
    for table in tables:
        for position, (name, kind) in enumerate(columns(table)):
            average = f"avg(length({name}))" if kind == "s" else "CAST(NULL AS DOUBLE)"
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, {position} AS position, "
                f"{category(name, kind)} AS category, count(*) AS rows, count(*) - count({name}) AS missing, "
                f"count(DISTINCT {name}) AS distinct_values, {average} AS avg_length FROM {source(table)}"
            )
    return "(" + " UNION ALL ".join(parts) + ")"


def profile_rows(*tables: str, where: str = "true") -> str:
    return (
        "SELECT table_name, column_name, category, rows, missing, distinct_values, "
        "round(CASE WHEN category = 'Text' THEN avg_length END, 6) AS avg_chars "
        f"FROM {profile(*tables)} WHERE {where}"
    )


def key(name: str, kind: str) -> str:
    """A value as text such that equal numbers give equal text."""
    if kind == "d":
        whole = f"{name} = floor({name}) AND abs({name}) < 9e18"
        return f"CASE WHEN {whole} THEN CAST(CAST({name} AS BIGINT) AS VARCHAR) ELSE CAST({name} AS VARCHAR) END"
    return f"CAST({name} AS VARCHAR)"


def key_lists(wanted: Sequence[tuple[str, Sequence[str]]]) -> str:
    """Distinct key tuples (t, c, cat, v, has_null) of the given column sets."""
    parts = []
    for table, names in wanted:
        kinds = dict(columns(table))
        values = ", ".join(key(n, kinds[n]) for n in names)
        nulls = " OR ".join(f"{n} IS NULL" for n in names)
        cats = "-".join({"s": "Text", "t": "Date"}.get(kinds[n]) or FIXED[kinds[n]] for n in names)
        parts.append(
            f"SELECT DISTINCT '{table}' AS t, '{','.join(names)}' AS c, '{cats}' AS cat, "
            f"[{values}] AS v, ({nulls}) AS has_null FROM {source(table)}"
        )
    return " UNION ALL ".join(parts)


def singles(*tables: str, skip: Sequence[str] = ()) -> list[tuple[str, list[str]]]:
    return [(t, [n]) for t in tables for n, _ in columns(t) if n not in skip]


def similar_words(score: str, minimum: float) -> str:
    """Word pairs of benchmark and conversations that reach a score of x and y.

    The score counts bytes, so every character is first made one byte.
    """
    return rf"""WITH words AS (SELECT DISTINCT side, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word
    FROM (SELECT 'x' AS side, text FROM benchmark UNION ALL SELECT 'y', text FROM conversations)),
letters AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM (SELECT DISTINCT word FROM words)),
bytes AS (SELECT c, chr(CAST(row_number() OVER (ORDER BY c) AS INT)) AS byte FROM (SELECT DISTINCT c FROM letters)),
coded AS (SELECT word, string_agg(byte, '' ORDER BY i) AS code FROM letters JOIN bytes USING (c) GROUP BY word),
l AS (SELECT word AS left_word, code AS x FROM words JOIN coded USING (word) WHERE side = 'x'),
r AS (SELECT word AS right_word, code AS y FROM words JOIN coded USING (word) WHERE side = 'y')
SELECT left_word, right_word, round(score, 6) AS score FROM (SELECT left_word, right_word, {score} AS score FROM l, r) WHERE score >= {minimum}"""


def report(
    sets: Sequence[tuple[str, Sequence[str]]],
    candidates: str,
    min_join: float = 0.45,
    score: str = "jaccard",
    nulls: bool = False,
    select: str = "",
    tail: str = "",
) -> str:
    """The overlap report of the candidates (lt, rt, lc, rc, plus others)."""
    if score == "jaccard":
        bound, total = "least(nl, nr) / greatest(nl, nr)", "CAST(nl + nr - m AS DOUBLE)"
    else:
        bound, total = "least(nl, nr) / sqrt(CAST(nl AS DOUBLE) * nr)", "sqrt(CAST(nl AS DOUBLE) * nr)"
    done = "Merge" if nulls else "Sorted Neighbourhood"
    full = "true" if nulls else "NOT a.has_null"
    return f"""WITH d AS ({key_lists(sets)}),
sizes AS (SELECT t, c, cat, count(*) AS n FROM d GROUP BY t, c, cat),
cand AS ({candidates}),
hits AS (SELECT lt, rt, lc, rc, count(*) AS m FROM cand JOIN d a ON a.t = lt AND a.c = lc
  JOIN d b ON b.t = rt AND b.c = rc AND a.v = b.v WHERE {full} GROUP BY lt, rt, lc, rc),
sized AS (SELECT cand.*, l.cat AS lcat, r.cat AS rcat, l.n AS nl, r.n AS nr, coalesce(hits.m, 0) AS found
  FROM cand JOIN sizes l ON l.t = cand.lt AND l.c = cand.lc JOIN sizes r ON r.t = cand.rt AND r.c = cand.rc
  LEFT JOIN hits ON hits.lt = cand.lt AND hits.rt = cand.rt AND hits.lc = cand.lc AND hits.rc = cand.rc),
judged AS (SELECT *, CASE WHEN lcat <> rcat THEN 'Category mismatch: ' || lcat || '-' || rcat
  WHEN {bound} < {min_join} THEN 'Pruned SN (' || printf('%.2f', {bound}) || ')' END AS reason FROM sized),
counted AS (SELECT *, CASE WHEN reason IS NULL THEN found ELSE 0 END AS m FROM judged),
scored AS (SELECT *, CASE WHEN reason IS NULL THEN {total} ELSE 0.0 END AS tot,
  CASE WHEN reason IS NULL THEN m / {total} ELSE 0.0 END AS score FROM counted),
report AS (SELECT {select} lt AS left_table, rt AS right_table, lc AS left_columns, rc AS right_columns,
  round(score, 6) AS join_score, CAST(m AS BIGINT) AS matches, round(tot, 6) AS total,
  CASE WHEN reason IS NULL AND score >= {min_join} THEN 1 ELSE 0 END AS mergeable,
  coalesce(reason, '{done}') AS description FROM scored)
SELECT * FROM report {tail}"""


def named_pairs(pairs: Sequence[tuple[str, str]], condition: str, extra: str = "") -> str:
    """Candidates from column names; the condition sees names a and b."""
    names = ", ".join(
        f"('{t}', '{n}', '{dict(s='Text', t='Date').get(k) or FIXED[k]}')"
        for t in sorted({t for p in pairs for t in p})
        for n, k in columns(t)
    )
    beside = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""SELECT p.lt, p.rt, l.a AS lc, r.b AS rc{extra} FROM (VALUES {beside}) AS p(lt, rt)
  JOIN (VALUES {names}) AS l(t, a, lcat) ON l.t = p.lt JOIN (VALUES {names}) AS r(t, b, rcat) ON r.t = p.rt
  WHERE {condition}"""


LEVENSHTEIN = "(1 - levenshtein(a, b) / greatest(length(a), length(b)))"
JARO = "jaro_similarity(a, b)"
SIMILAR_NAMES = f"({LEVENSHTEIN} >= 0.5 OR {JARO} >= 0.8)"


def given(*rows: tuple[str, str, str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(map(str, rows)) + ") AS g(lt, rt, lc, rc)"


def sets_of(*rows: tuple[str, str, str, str]) -> list[tuple[str, list[str]]]:
    both = {(r[i], r[i + 2]) for r in rows for i in (0, 1)}
    return [(t, c.split(",")) for t, c in sorted(both)]


COMMON_PAIRS = [("labels", "documents"), ("conversations", "documents"), ("benchmark", "documents")]
SIMILAR_PAIRS = [("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
HALVES = ("finished", "unfinished")
HALF = sorted(n for n, _ in columns("finished"))
COMBOS = [",".join(c) for k in (2, 3) for c in combinations(HALF, k)]
JACCARD = [
    ("lineitem", "orders", "l_orderkey", "o_orderkey"),
    ("lineitem", "orders", "l_orderkey,l_shipdate", "o_orderkey,o_orderdate"),
    ("lineitem", "orders", "l_linestatus", "o_orderstatus"),
    ("lineitem", "orders", "l_extendedprice", "o_custkey"),
    ("orders", "customer", "o_custkey", "c_custkey"),
]
FAILED = [
    ("lineitem", "orders", "l_orderkey,l_partkey", "o_orderkey", "error - length mismatch"),
    ("lineitem", "orders", "l_orderkey", "no_such_column", "error - wrong column names"),
    ("lineitem", "orders", "l_orderkey,l_returnflag", "o_orderkey,o_custkey", "Category mismatch: Text-Numerical"),
]
FAILED_ROWS = " UNION ALL ".join(
    f"SELECT '{a}', '{b}', '{c}', '{d}', 0.0, 0, 0.0, 0, '{e}'" for a, b, c, d, e in FAILED
)
HALF_SETS = [(t, c.split(",")) for t in HALVES for c in COMBOS]


def half_singles(min_join: float, select: str = "") -> str:
    """Every column of the halves with itself."""
    return report(singles(*HALVES), given(*((*HALVES, c, c) for c in HALF)), min_join, select=select)


def half_failed(min_join: float) -> str:
    """Columns of the halves that fail with at most one match."""
    return f"SELECT left_columns AS c FROM ({half_singles(min_join)}) WHERE mergeable = 0 AND matches <= 1"


def half_combinations(min_join: float) -> str:
    """Candidates of two and three columns without a failed one."""
    return f"""SELECT * FROM ({given(*((*HALVES, c, c) for c in COMBOS))}) AS g WHERE NOT EXISTS (
  SELECT 1 FROM ({half_failed(min_join)}) AS f WHERE list_contains(string_split(g.lc, ','), f.c))"""


def key_ratio(table: str, names: Sequence[str], smallest: int, least: float = 0.95) -> str:
    """Keys of one table: the smallest size with a hit at the least ratio, all its hits."""
    parts = []
    for size in range(1, smallest + 1):
        for combo in combinations(names, size):
            parts.append(
                f"SELECT '{table}' AS table_name, {size} AS n_columns, '{','.join(combo)}' AS key_columns, "
                f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(combo)} FROM {table})) / "
                f"(SELECT count(*) FROM {table}) AS ratio"
            )
    return f"""SELECT table_name, n_columns, key_columns, round(ratio, 6) AS percentage FROM (
  SELECT *, min(n_columns) OVER () AS least_columns FROM ({' UNION ALL '.join(parts)}) WHERE ratio >= {least})
  WHERE n_columns = least_columns"""


def misses(table: str, name: str) -> str:
    """Share of sorted-order steps of a column other than the usual one."""
    return f"""(SELECT 1 - max(n) / sum(n) FROM (SELECT step, count(*) AS n FROM (
  SELECT {name} - lag({name}) OVER (ORDER BY {name}) AS step FROM {table} WHERE {name} IS NOT NULL)
  WHERE step IS NOT NULL GROUP BY step))"""


def counter_rows(*tables: str) -> str:
    parts = []
    for table in tables:
        for name, kind in columns(table):
            uniqueness = f"(SELECT count(DISTINCT {name}) / count(*) FROM {table})"
            miss = misses(table, name) if FIXED.get(kind) == "Numerical" else "CAST(NULL AS DOUBLE)"
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, {uniqueness} AS u, {miss} AS m")
    return f"""SELECT table_name, column_name, round(u, 6) AS uniqueness,
  round(CASE WHEN u >= 0.99 THEN m END, 6) AS miss,
  CASE WHEN u >= 0.99 AND m <= 0.1 THEN 1 ELSE 0 END AS is_counter FROM ({' UNION ALL '.join(parts)})"""


def contribution(
    left: str, right: str, on: Sequence[tuple[str, str]], left_names: Sequence[str], right_names: Sequence[str]
) -> str:
    """One contribution row from the plain join; missing keys are equal."""
    l_keys, r_keys = [a for a, _ in on], [b for _, b in on]
    l_free = [n for n in left_names if n not in l_keys]
    r_free = [n for n in right_names if n not in r_keys]
    condition = " AND ".join(f"l.{a} IS NOT DISTINCT FROM r.{b}" for a, b in on)
    l_any = " OR ".join(f"l.{n} IS NOT NULL" for n in l_free)
    r_any = " OR ".join(f"r.{n} IS NOT NULL" for n in r_free)
    ls, rs = source(left).replace(" AS derived", ""), source(right).replace(" AS derived", "")
    return f"""SELECT '{left}' AS left_table, '{right}' AS right_table, '{','.join(l_keys)}' AS left_columns,
  '{','.join(r_keys)}' AS right_columns, count(*) AS joined_rows,
  round({len(r_free)} * count_if({r_any}) * 100 / ((SELECT count(*) FROM {ls}) * {len(left_names)}), 6) AS right_adds,
  round({len(l_free)} * count_if({l_any}) * 100 / ((SELECT count(*) FROM {rs}) * {len(right_names)}), 6) AS left_adds
  FROM {ls} l JOIN {rs} r ON {condition}"""


def names_of(table: str) -> list[str]:
    return [n for n, _ in columns(table)]


def categories(table: str) -> str:
    return ", ".join(f"('{n}', '{dict(s='Text', t='Date').get(k) or FIXED[k]}')" for n, k in columns(table))


def lake(min_join: float, *tables: str) -> str:
    """All column pairs of different tables that overlap enough, by joining all values with all values."""
    return f"""WITH d AS ({key_lists(singles(*tables))}),
sizes AS (SELECT t, c, count(*) AS n FROM d GROUP BY t, c),
hits AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, count(*) AS m FROM d AS a JOIN d AS b
  ON a.cat = b.cat AND a.v = b.v AND a.t < b.t WHERE NOT a.has_null GROUP BY ALL),
scored AS (SELECT hits.*, l.n + r.n - m AS total FROM hits JOIN sizes AS l ON l.t = lt AND l.c = lc JOIN sizes AS r ON r.t = rt AND r.c = rc)
SELECT lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column, m AS matches, total,
  round(m / CAST(total AS DOUBLE), 6) AS join_score FROM scored WHERE m / CAST(total AS DOUBLE) >= {min_join}"""


ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def score_rows(expression: str, method: str) -> str:
    return f"""WITH named AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_name, other_name, round({expression}, 6) AS score, '{method}' AS method FROM (SELECT DISTINCT x.p_name, y.p_name AS other_name,
  x.p_name AS a, y.p_name AS b FROM named AS x JOIN named AS y USING (l_orderkey) WHERE x.p_name <= y.p_name)"""


WORDS = """(SELECT DISTINCT c_custkey, s_suppkey, c_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
SEMANTIC = f"""WITH RECURSIVE isa(child, parent) AS (
  SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL
  SELECT 'm' || c_custkey, 'seg' || c_mktsegment FROM customer UNION ALL
  SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL
  SELECT 'r' || r_regionkey, 'world' FROM region),
senses(word, sense) AS (
  SELECT c_name, 'c' || c_custkey FROM customer UNION ALL SELECT c_name, 'm' || c_custkey FROM customer UNION ALL
  SELECT s_name, 's' || s_suppkey FROM supplier),
up(sense, ancestor, steps) AS (
  SELECT sense, sense, 0 FROM senses UNION
  SELECT up.sense, isa.parent, up.steps + 1 FROM up JOIN isa ON isa.child = up.ancestor),
reach AS (SELECT word, ancestor, min(steps) AS steps FROM senses JOIN up USING (sense) GROUP BY word, ancestor),
best AS (SELECT w.c_name, w.s_name, min(a.steps + b.steps) AS path FROM {WORDS} w
  JOIN reach a ON a.word = w.c_name JOIN reach b ON b.word = w.s_name AND b.ancestor = a.ancestor
  GROUP BY w.c_name, w.s_name)
SELECT w.c_name, w.s_name, round(coalesce(1.0 / (1 + path), 0.0), 6) AS score
FROM {WORDS} w LEFT JOIN best USING (c_name, s_name)"""

NEAR_BALANCES = """WITH l AS (SELECT DISTINCT s_acctbal AS k, s_nationkey AS b FROM supplier WHERE s_acctbal IS NOT NULL),
r AS (SELECT DISTINCT c_acctbal AS k, c_nationkey AS b FROM customer WHERE c_acctbal IS NOT NULL),
places AS (SELECT k, dense_rank() OVER (ORDER BY k) AS place FROM (SELECT k FROM l UNION SELECT k FROM r))
SELECT round(l.k, 2) AS s_acctbal, round(r.k, 2) AS c_acctbal, l.b AS nation,
  CASE WHEN l.k = r.k THEN 1 ELSE 0 END AS exact
FROM l JOIN places a ON a.k = l.k JOIN r ON r.b IS NOT DISTINCT FROM l.b JOIN places c ON c.k = r.k
WHERE abs(a.place - c.place) <= 4"""

VIEWS = """not_final AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority
  FROM orders),
not_open AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS priority FROM orders)"""


def null_overlap(method: str, equal: str) -> str:
    rows = []
    for names in ("o_custkey,priority", "priority"):
        condition = " AND ".join(f"l.{n} {equal} r.{n}" for n in names.split(","))
        rows.append(
            f"SELECT '{names}' AS cols, (SELECT count(*) FROM (SELECT DISTINCT {names} FROM not_final)) AS nl, "
            f"(SELECT count(*) FROM (SELECT DISTINCT {names} FROM not_open)) AS nr, (SELECT count(*) FROM "
            f"(SELECT DISTINCT {names} FROM not_final) l JOIN (SELECT DISTINCT {names} FROM not_open) r ON {condition}) AS m"
        )
    return f"""WITH {VIEWS}, c AS ({' UNION ALL '.join(rows)})
SELECT 'not_final' AS left_table, 'not_open' AS right_table, cols AS left_columns, cols AS right_columns,
  round(m / (nl + nr - m), 6) AS join_score, m AS matches, CAST(nl + nr - m AS DOUBLE) AS total,
  CASE WHEN m / (nl + nr - m) >= 0.2 THEN 1 ELSE 0 END AS mergeable, '{method}' AS description FROM c"""


def listing_rows(rows: str) -> str:
    return f"""SELECT left_table, right_table, 'Left: ' || replace(left_columns, ',', ', ') || ' Right: '
  || replace(right_columns, ',', ', ') || ' Join score: ' || printf('%.2f', join_score * 100) || ' (' || matches
  || ' / ' || CAST(total AS BIGINT) || ') ' || description AS line FROM ({rows})"""


def discovery(
    stage: str, pairs: Sequence[tuple[str, str]], sets: Sequence[tuple[str, Sequence[str]]], candidates: str, tail: str = ""
) -> str:
    return report(sets, candidates, select=f"'{stage}' AS stage,", tail=tail)


def similar_report(pairs: Sequence[tuple[str, str]], tail: str) -> str:
    tables = sorted({t for p in pairs for t in p})
    return discovery("S2", pairs, singles(*tables), named_pairs(pairs, SIMILAR_NAMES), tail)


def used_columns(merged: str) -> str:
    return " UNION ".join(
        f"SELECT left_table, right_table, '{side}' AS side, unnest(string_split({side}_columns, ',')) AS column_name "
        f"FROM ({merged})"
        for side in ("left", "right")
    )


LAKE = [
    ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("customer", "nation"),
    ("nation", "region"), ("events", "customer"),
]
LABELS = [("labels", "documents")]
LABEL_SETS = singles("labels", "documents", skip=["text"])
LABEL_KEYS = """((lc = 'doc_id') OR (rc = 'doc_id'))"""


def labels_search() -> str:
    """Equal names first; then keys (doc_id on both sides); then the rest.

    No other column of the two tables is a key at 0.95, and no name is similar
    without being equal, which the condition on similar names states.
    """
    numbers = named_pairs(LABELS, "lcat = rcat AND NOT (a = b)")
    staged = [
        ("S1", named_pairs(LABELS, "a = b")),
        ("S2", named_pairs(LABELS, f"{SIMILAR_NAMES} AND NOT (a = b)")),
        ("S3", f"SELECT * FROM ({numbers}) WHERE {LABEL_KEYS}"),
        ("S4", f"SELECT * FROM ({numbers}) WHERE NOT {LABEL_KEYS}"),
    ]
    return " UNION ALL ".join(f"({discovery(stage, LABELS, LABEL_SETS, rows)})" for stage, rows in staged)


def lake_search() -> str:
    """Similar names of all pairs, and the one combination of two useful pairs."""
    tables = sorted({t for p in LAKE for t in p})
    names = named_pairs(LAKE, SIMILAR_NAMES)
    single = report(singles(*tables), names)
    combos = f"""SELECT x.left_table AS lt, x.right_table AS rt, x.left_columns || ',' || y.left_columns AS lc,
      x.right_columns || ',' || y.right_columns AS rc FROM ({single}) x JOIN ({single}) y
      ON x.left_table = y.left_table AND x.right_table = y.right_table AND x.left_columns < y.left_columns
      AND x.right_columns <> y.right_columns
      WHERE (x.mergeable = 1 OR x.matches > 1) AND (y.mergeable = 1 OR y.matches > 1)"""
    pairs = [("l_linestatus,l_orderkey", "o_orderstatus,o_orderkey"), ("l_linestatus,l_partkey", "o_orderstatus,o_custkey"),
             ("l_orderkey,l_partkey", "o_orderkey,o_custkey"),
             ("l_linestatus,l_orderkey,l_partkey", "o_orderstatus,o_orderkey,o_custkey")]
    sets = [(t, c.split(",")) for a, b in pairs for t, c in (("lineitem", a), ("orders", b))]
    triple = "SELECT 'lineitem', 'orders', 'l_linestatus,l_orderkey,l_partkey', 'o_orderstatus,o_orderkey,o_custkey'"
    first = report(singles(*tables), names, select="'S2' AS stage,", tail="WHERE mergeable = 1")
    second = report(sets, f"{combos} UNION ALL {triple}", select="'S2' AS stage,", tail="WHERE mergeable = 1")
    return f"({first}) UNION ALL ({second}) UNION ALL ({late_stages('events', 'customer', first)})"


def late_stages(left: str, right: str, earlier: str) -> str:
    """Pairs of equal category, for two tables without a join so far.

    Pairs with a key column come first (S3), the others only if those fail (S4).
    """
    rows = report(
        singles(left, right),
        named_pairs([(left, right)], f"lcat = rcat AND NOT {SIMILAR_NAMES}"),
        tail="WHERE mergeable = 1",
    )
    return f"""SELECT * FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM {profile(left, right)} p
  WHERE p.distinct_values / p.rows >= 0.95 AND ((p.table_name = left_table AND p.column_name = left_columns)
    OR (p.table_name = right_table AND p.column_name = right_columns))) THEN 'S3' ELSE 'S4' END AS stage, r.*
  FROM ({rows}) r WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) e
    WHERE e.left_table = r.left_table AND e.right_table = r.right_table))
  QUALIFY stage = min(stage) OVER ()"""


NAMED_ALIKE = [("customer", "nation"), ("nation", "region"), ("lineitem", "part"), ("lineitem", "supplier")]


def meaning(name: str, pattern: str = "_(.*)$") -> str:
    return f"regexp_extract({name}, '{pattern}', 1)"


def semantic_report() -> str:
    """Names with one meaning, a meaning and its kind, or two meanings of one kind."""
    first, second = meaning("a"), meaning("b")
    one, two = (meaning(x, "_.*?(price|date|status|name)$") for x in ("a", "b"))
    score = f"""CASE WHEN {first} = {second} THEN 1.0 WHEN {first} = {two} OR {second} = {one} THEN 0.5
  WHEN {one} <> '' AND {one} = {two} THEN round(1 / 3.0, 6) ELSE 0.0 END"""
    tables = sorted({t for p in NAMED_ALIKE for t in p})
    rows = report(singles(*tables), named_pairs(NAMED_ALIKE, f"{score} >= 0.3"), select="'S2' AS stage,")
    scored = score.replace("(a,", "(left_columns,").replace("(b,", "(right_columns,")
    return f"SELECT *, CAST({scored} AS DOUBLE) AS name_score FROM ({rows})"


USEFUL = [("lineitem", "orders"), ("customer", "nation")]

ORACLES: dict[str, str] = {
    "table_shapes": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(columns(t))} AS n_columns FROM {t}"
        for t in ("lineitem", "orders", "events", "documents", "labels")
    ),
    "csv_scan": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "profile_orders": profile_rows("orders", "customer", "events"),
    "profile_nulls": profile_rows("derived"),
    "profile_texts": profile_rows("documents", "pages", "conversations"),
    "category_groups": "SELECT table_name, category, string_agg(column_name, ',' ORDER BY position) AS members "
    f"FROM {profile('lineitem', 'events')} GROUP BY table_name, category",
    "prune_missing": "SELECT column_name, missing, round(missing / rows, 6) AS share "
    f"FROM {profile('derived')} WHERE NOT missing / rows < 0.3",
    "prune_length": "SELECT table_name, column_name, round(avg_length, 6) AS avg_chars "
    f"FROM {profile('documents', 'pages', 'conversations', 'customer')} WHERE NOT avg_length < 70",
    "prune_length_text": "SELECT table_name, column_name, round(avg_length, 6) AS avg_chars "
    f"FROM {profile('customer', 'derived')} WHERE category = 'Text' AND NOT avg_length < 9",
    "prune_uniqueness": "SELECT table_name, column_name, distinct_values "
    f"FROM {profile('lineitem', 'orders')} WHERE distinct_values > greatest(1, 0.2 * rows)",
    "prune_category": f"""WITH p AS {profile('orders', 'region', 'customer')},
c AS (SELECT 'orders' AS left_table, t AS right_table, side, column_name, category, rows FROM
  (VALUES ('region'), ('customer')) AS o(t), LATERAL (SELECT 'left' AS side, * FROM p WHERE table_name = 'orders'
  UNION ALL SELECT 'right' AS side, * FROM p WHERE table_name = o.t))
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.left_table = c.left_table
  AND d.right_table = c.right_table AND d.category = c.category AND d.side <> c.side)""",
    "pruned_catalog": profile_rows("derived", where="missing / rows < 0.3"),
    "cardinality_discard": f"""SELECT l.column_name AS left_column, r.column_name AS right_column,
  l.distinct_values AS left_distinct, r.distinct_values AS right_distinct
FROM {profile('orders')} l, {profile('customer')} r
WHERE least(l.distinct_values, r.distinct_values) < greatest(l.distinct_values, r.distinct_values) * 0.45""",
    "cardinality_kept": f"""WITH p AS (SELECT * FROM {profile('orders', 'customer', 'lineitem', 'part')})
SELECT l.table_name AS left_table, r.table_name AS right_table, l.column_name AS left_column, r.column_name AS right_column,
  l.distinct_values AS left_distinct, r.distinct_values AS right_distinct FROM p AS l, p AS r
WHERE (l.table_name, r.table_name) IN (('orders', 'customer'), ('lineitem', 'orders'), ('lineitem', 'part'))
  AND least(l.distinct_values, r.distinct_values) >= greatest(l.distinct_values, r.distinct_values) * 0.45""",
    "profile_sketch": f"""SELECT table_name, column_name, rows, missing, distinct_values, 1 AS is_close
FROM {profile('orders', 'customer', 'events')}""",
    "name_equality": score_rows("CAST(a = b AS DOUBLE)", "Equality"),
    "name_levenshtein": score_rows(LEVENSHTEIN, "Levenshtein"),
    "name_jaro": score_rows(JARO, "Jaro"),
    "lake_overlap": lake(0.45, *ALL_TABLES),
    "similarity_join": similar_words("1 - levenshtein(x, y) / greatest(length(x), length(y), 1)", 0.8),
    "similarity_join_jaro": similar_words("jaro_similarity(x, y)", 0.9),
    "semantic_similarity": SEMANTIC,
    "common_columns": report(singles("labels", "documents", "conversations", "benchmark"), named_pairs(COMMON_PAIRS, "a = b")),
    "similar_columns": f"""SELECT left_table, right_table, left_columns, right_columns,
  concat_ws(',', CASE WHEN {LEVENSHTEIN} >= 0.5 THEN 'Levenshtein' END, CASE WHEN {JARO} >= 0.8 THEN 'Jaro' END) AS methods,
  round(greatest(CASE WHEN {LEVENSHTEIN} >= 0.5 THEN {LEVENSHTEIN} END, CASE WHEN {JARO} >= 0.8 THEN {JARO} END), 6)
    AS name_score, matches, description FROM (SELECT *, left_columns AS a, right_columns AS b FROM
  ({report(singles('orders', 'customer', 'lineitem', 'part', 'supplier'), named_pairs(SIMILAR_PAIRS, SIMILAR_NAMES))}))""",
    "column_combinations": report(HALF_SETS, given(*((*HALVES, c, c) for c in COMBOS)), 0.0),
    "hier_discard": report(HALF_SETS, half_combinations(0.001), 0.001),
    "hier_remaining": f"""WITH failed AS (SELECT coalesce(list(c), CAST([] AS VARCHAR[])) AS f FROM ({half_failed(0.001)}))
SELECT lc AS left_columns, CASE WHEN list_has_any(string_split(lc, ','), f) THEN 1 ELSE 0 END AS is_child,
  array_to_string(list_filter(string_split(lc, ','), lambda x : NOT list_contains(f, x)), ',') AS remaining
FROM (VALUES {', '.join(f"('{c}')" for c in COMBOS)}) AS g(lc), failed""",
    "already_discarded": report(
        singles("lineitem", "supplier"), named_pairs([("lineitem", "supplier")], f"lcat = rcat AND NOT {SIMILAR_NAMES}")
    ),
    "unique_keys": " UNION ALL ".join(f"({key_ratio(t, names_of(t), 1)})" for t in ("lineitem", "orders", "customer")),
    "unique_keys_composite": key_ratio("lineitem", names_of("lineitem"), 3, 1),
    "foreign_keys": report(
        singles("orders", "customer"),
        f"""SELECT n.* FROM ({named_pairs([('orders', 'customer')], 'lcat = rcat')}) n
  JOIN {profile('customer')} p ON p.column_name = n.rc AND p.distinct_values / p.rows >= 0.95""",
    ),
    "foreign_keys_composite": report(
        [("lineitem", c) for c in combinations(names_of("lineitem"), 2)]
        + [("events", c) for c in permutations(names_of("events"), 2)],
        f"""WITH l(n, cat) AS (VALUES {categories('lineitem')}), e(n, cat) AS (VALUES {categories('events')})
  SELECT 'lineitem' AS lt, 'events' AS rt, key_columns AS lc, a.n || ',' || b.n AS rc
  FROM ({key_ratio('lineitem', names_of('lineitem'), 2, 1)}) AS k
  JOIN l AS x ON x.n = split_part(key_columns, ',', 1) JOIN l AS y ON y.n = split_part(key_columns, ',', 2)
  JOIN e AS a ON a.cat = x.cat JOIN e AS b ON b.cat = y.cat AND b.n <> a.n""",
        0.1,
    ),
    "same_category_pairs": report(singles("supplier", "customer"), named_pairs([("supplier", "customer")], "lcat = rcat")),
    "overlap_jaccard": report(sets_of(*JACCARD), given(*JACCARD), tail=f"UNION ALL {FAILED_ROWS}"),
    "overlap_cosine": report(
        singles("labels", "documents", skip=["text"]),
        given(("labels", "documents", "doc_id", "doc_id"), ("labels", "documents", "quality", "doc_id")),
        score="cosine",
    ),
    "overlap_pruned": report(
        [("events", ["user_id"]), ("customer", ["c_custkey"]), ("lineitem", ["l_partkey"]), ("part", ["p_partkey"])],
        given(("events", "customer", "user_id", "c_custkey"), ("lineitem", "part", "l_partkey", "p_partkey")),
    ),
    "overlap_merge": null_overlap("Merge", "IS NOT DISTINCT FROM"),
    "overlap_exact_nulls": null_overlap("Sorted Neighbourhood", "="),
    "result_listing": listing_rows(report(sets_of(*JACCARD), given(*JACCARD), tail=f"UNION ALL {FAILED_ROWS}")),
    "listing_ties": listing_rows(
        report(singles("residues", "parts"), given(*(("residues", "parts", "k", f"m{m}") for m in TIES)), 0.0)
    ),
    "rank_by_score": "SELECT CAST(row_number() OVER (ORDER BY join_score DESC, left_columns, right_columns) AS INTEGER) "
    "AS place, left_columns, right_columns, join_score FROM ("
    + report(
        singles("lineitem", "orders"),
        named_pairs([("lineitem", "orders")], "lcat = rcat"),
        tail="WHERE mergeable = 1",
    )
    + ")",
    "sorted_neighbourhood": NEAR_BALANCES,
    "sorted_neighbourhood_exact": "SELECT DISTINCT l_orderkey, o_orderkey FROM lineitem JOIN orders "
    "ON l_orderkey = o_orderkey",
    "global_rank": "SELECT price, row_number() OVER (ORDER BY price) AS place FROM "
    "(SELECT DISTINCT l_extendedprice AS price FROM lineitem)",
    "join_contribution": " UNION ALL ".join(
        [
            contribution("customer", "orders", [("c_custkey", "o_custkey")], names_of("customer"), names_of("orders")),
            contribution(
                "lineitem", "derived", [("l_orderkey", "o_orderkey")], names_of("lineitem"),
                names_of("derived"),
            ),
            contribution(
                "derived", "orders", [("priority", "o_orderpriority")], names_of("derived"), names_of("orders"),
            ),
            contribution(
                "orders", "derived", [("o_orderkey", "o_orderkey"), ("o_orderpriority", "priority")],
                names_of("orders"), names_of("derived"),
            ),
        ]
    ),
    "renamed_join": "SELECT l.doc_id AS doc_id_left, quality, toxic, r.doc_id AS doc_id_right, text, lang, source, "
    "n_chars FROM labels l JOIN documents r ON l.doc_id IS NOT DISTINCT FROM r.doc_id",
    "counter_columns": counter_rows("orders", "customer", "lineitem", "events", "documents"),
    "counter_buckets": " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, round({misses(t, n)}, 6) AS miss"
        for t in ("orders", "customer")
        for n, k in columns(t)
        if k in "id"
    ),
    "counter_decimals": " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, round({misses(f'(SELECT {value} AS {n} FROM orders)', n)}, 6) AS miss"
        for n, value in (
            ("big_key", "CAST(o_orderkey + 9007199254740992 AS DECIMAL(20, 0))"),
            ("customer", "CAST(o_custkey AS DECIMAL(12, 2))"),
        )
    ),
    "mode_count": "SELECT l_returnflag, l_linestatus, max(n) AS mode_count FROM (SELECT l_returnflag, l_linestatus, "
    "l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag, l_linestatus",
    "discover_orders_customer": similar_report([("orders", "customer")], ""),
    "discover_labels_documents": labels_search(),
    "discover_cosine": report(LABEL_SETS, named_pairs(LABELS, "a = b"), score="cosine", select="'S1' AS stage,"),
    "discover_merge": report(
        singles("orders", "customer"), named_pairs([("orders", "customer")], SIMILAR_NAMES), nulls=True,
        select="'S2' AS stage,",
    ),
    "discover_common_names": f"""({half_singles(0.45, "'S1' AS stage,")}) UNION ALL
({report(HALF_SETS, half_combinations(0.45), select="'S1' AS stage,")})""",
    "discover_semantic": semantic_report(),
    "discover_dropped": "SELECT table_name, column_name, round(avg_length, 6) AS avg_chars "
    f"FROM {profile('labels', 'documents')} WHERE NOT avg_length < 70",
    "discover_useful_columns": used_columns(similar_report(USEFUL, "WHERE mergeable = 1")),
    "discover_contribution": "SELECT * EXCLUDE (joined_rows) FROM ("
    + contribution("orders", "customer", [("o_custkey", "c_custkey")], names_of("orders"), names_of("customer"))
    + ")",
    "discover_counters": f"""SELECT left_table, right_table, side, u.column_name FROM
  ({used_columns(similar_report([('orders', 'customer'), ('part', 'lineitem')], 'WHERE mergeable = 1'))}) u
  JOIN ({counter_rows('orders', 'customer', 'part', 'lineitem')}) c ON c.column_name = u.column_name
  AND c.table_name = CASE WHEN side = 'left' THEN left_table ELSE right_table END AND is_counter = 1""",
    "discover_lake": lake_search(),
}
