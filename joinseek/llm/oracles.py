"""The same results as the registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from joinseek.llm.queries import MIX
from joinseek.llm.warc import BASE32

WORD = r"[^\x20\x09-\x0D]+"


def _mix() -> str:
    domain = (
        "CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web'"
        " WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books' ELSE 'code' END"
    )
    levels = ["domain", "lang", "source"]
    steps = []
    for depth, level in enumerate(levels):
        path = ", ".join(levels[: depth + 1])
        parent = levels[:depth]
        listed = MIX.weights.get(level, {})
        cases = " ".join(f"WHEN {level} = '{name}' THEN {weight}" for name, weight in listed.items())
        weight = f"CASE {cases} ELSE {MIX.other} END" if cases else f"{MIX.other}"
        budget = f"above{depth - 1}.budget" if depth else f"{MIX.budget} * (SELECT sum(tokens) FROM leaf)"
        joined = f" JOIN above{depth - 1} USING ({', '.join(parent)})" if depth else ""
        group = ", ".join(parent) or "1"
        order = f"PARTITION BY {group} ORDER BY capacity / weight, {level}"
        steps.append(f"""
        nodes{depth} AS (SELECT {path}, n.capacity, CAST({weight} AS DOUBLE) AS weight, {budget} AS total
            FROM (SELECT {path}, sum(capacity) AS capacity FROM leaf GROUP BY {path}) AS n{joined}),
        rates{depth} AS (SELECT *, (total - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM nodes{depth}),
        above{depth} AS (SELECT {path}, least(capacity, greatest(0, max(rate) OVER (PARTITION BY {group}) * weight)) AS budget
            FROM rates{depth})""")
    return rf"""
    WITH sized AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS mark FROM documents),
        leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens,
            CAST(sum(n_tokens) * {MIX.max_epochs} AS DOUBLE) AS capacity FROM sized GROUP BY ALL),
        {','.join(steps)},
        plan AS (SELECT domain, lang, source, greatest(tokens, 1) AS tokens, CAST(floor(budget + 0.000001) AS BIGINT) AS budget
            FROM leaf JOIN above2 USING (domain, lang, source)),
        placed AS (SELECT sized.*, budget // tokens AS whole, budget % tokens AS rest,
            md5('{MIX.seed}:' || (budget // tokens) || ':' || doc_id || ':' || mark) AS place
            FROM sized JOIN plan USING (domain, lang, source)),
        since AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id
            ROWS UNBOUNDED PRECEDING) - n_tokens AS since FROM placed),
        copies AS (SELECT *, whole + CASE WHEN since < rest THEN 1 ELSE 0 END AS copies FROM since),
        each AS (SELECT *, unnest(range(copies)) AS epoch FROM copies)
    SELECT doc_id, domain, lang, source, n_tokens,
        CAST(CASE WHEN epoch = whole THEN least(n_tokens, rest - since) ELSE n_tokens END AS BIGINT) AS n_taken,
        CAST(epoch AS INTEGER) AS epoch
    FROM each"""


URL_FILTER = r"""
WITH captured AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched_on,
        nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
        string_split(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '/') AS steps
    FROM pages),
hosts AS (SELECT DISTINCT host, md5(host) AS h, array_to_string(string_split(host, '.')[-2:], '.') AS parent FROM captured WHERE host IS NOT NULL),
drawn AS (SELECT host, parent, substr(h, 1, 1) AS a, CAST('0x' || substr(h, 2, 2) AS INTEGER) AS n, md5(parent) AS p FROM hosts),
entries AS (
    SELECT host AS pattern, 'block' AS action, n AS day FROM drawn WHERE a < '8'
    UNION SELECT host, 'remove', n + 40 FROM drawn WHERE a < '4'
    UNION SELECT host, 'block', n + 90 FROM drawn WHERE a < '2'
    UNION SELECT host || '/en', 'allow', n // 2 FROM drawn WHERE a < '6'
    UNION SELECT parent, 'block', 200 + CAST('0x' || substr(p, 2, 2) AS INTEGER) // 2 FROM drawn WHERE substr(p, 1, 1) < '4'),
daily AS (SELECT pattern, day, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT pattern, action, DATE '2024-01-01' + CAST(day AS INTEGER) AS since,
    DATE '2024-01-01' + CAST(lead(day) OVER (PARTITION BY pattern ORDER BY day) AS INTEGER) AS until FROM daily),
keys AS (
    SELECT page_id, fetched_on, host || array_to_string(steps[1:len(steps) - k], '/') AS pattern, k AS rank
    FROM (SELECT *, unnest(range(len(steps))) AS k FROM captured WHERE host IS NOT NULL)
    UNION ALL
    SELECT page_id, fetched_on, array_to_string(string_split(host, '.')[k:], '.'), len(steps) + k
    FROM (SELECT *, unnest(range(2, len(string_split(host, '.')))) AS k FROM captured WHERE host IS NOT NULL)),
hits AS (
    SELECT page_id, pattern, action, since, row_number() OVER (PARTITION BY page_id ORDER BY rank, action DESC, since, pattern) AS r
    FROM keys JOIN spans USING (pattern)
    WHERE action <> 'remove' AND fetched_on >= since AND (until IS NULL OR fetched_on < until))
SELECT c.page_id, c.url, c.fetched_on, coalesce(h.action = 'block', false) AS blocked, h.pattern AS matched_pattern,
    CASE WHEN h.pattern IS NOT NULL THEN 'derived' END AS matched_list, h.since AS listed_on
FROM captured AS c LEFT JOIN (SELECT * FROM hits WHERE r = 1) AS h USING (page_id)
"""


def _warc() -> str:
    chars = [
        f"substr('{BASE32}', ((CAST('0x' || substr(h, {5 * part + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)"
        for part in range(8)
        for shift in (15, 10, 5, 0)
    ]
    return f"""
    WITH facts AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS f FROM facts)
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {' || '.join(chars)} AS payload_digest,
        CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> f THEN f END AS refers_to, true AS verified
    FROM firsts"""


#: A run of lines and sentences has at least 20 words; see LINES.
LINES = r"""
WITH marked AS (SELECT doc_id, replace(regexp_replace(coalesce(text, ''), '([.!?])([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'),
        chr(10), chr(10) || chr(1)) AS body FROM documents),
pieces AS (SELECT doc_id, unnest(string_split(body, chr(1))) AS piece, generate_subscripts(string_split(body, chr(1)), 1) AS k FROM marked),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start,
        trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS form
    FROM pieces),
part AS (SELECT doc_id, start, start + length(piece) AS stop, form, row_number() OVER d AS u,
        sum(len(string_split(form, ' '))) OVER d AS w, sum(len(string_split(form, ' '))) OVER d - len(string_split(form, ' ')) AS before
    FROM placed WHERE form <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
whole AS (SELECT doc_id, list(form ORDER BY u) AS forms, list(start ORDER BY u) AS starts, list(stop ORDER BY u) AS stops,
        max(u) AS u, max(w) AS w FROM part GROUP BY doc_id),
forward AS (SELECT a.doc_id, a.u AS a, b.u AS b FROM part AS a ASOF JOIN part AS b ON a.doc_id = b.doc_id AND a.before + 20 <= b.w),
back AS (SELECT t.doc_id, coalesce(a.u, 1) AS a, t.u AS b
    FROM whole AS t ASOF LEFT JOIN part AS a ON t.doc_id = a.doc_id AND t.w - 20 >= a.before),
run AS (SELECT doc_id, starts[a] AS start, stops[b] AS stop, md5(array_to_string(forms[a:b], ' ')) AS digest
    FROM (SELECT * FROM forward UNION SELECT * FROM back) JOIN whole USING (doc_id)),
ranked AS (SELECT *, row_number() OVER e AS r, first_value(doc_id) OVER e AS kept_in FROM run WINDOW e AS (PARTITION BY digest ORDER BY doc_id, start)),
later AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < start AS opens
    FROM ranked WHERE r > 1),
numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS n FROM later),
span AS (SELECT doc_id, n, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, min(kept_in) AS kept_in FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, start, stop, kept_in, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since FROM span),
cut AS (SELECT doc_id, count(*) AS n, max(stop) AS last, string_agg(start || ':' || stop || ':' || kept_in, ',' ORDER BY start) AS removed,
        string_agg(substr(text, since + 1, start - since), '' ORDER BY start) AS head
    FROM gaps JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN text ELSE head || substr(text, last + 1) END AS text,
    CAST(coalesce(n, 0) AS INTEGER) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN cut USING (doc_id)"""

CRC32 = """xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
    lambda crc, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
    xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""

TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, {CRC32.format("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
    SELECT heads.conv_id, 0 AS part, place, role, text FROM heads JOIN t ON t.conv_id = base AND place < h
    UNION ALL SELECT conv_id, 1, place, role, text FROM t JOIN heads USING (conv_id) WHERE place >= h),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS d FROM parts),
paths AS (
    SELECT conv_id, d, length(text) AS chars, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
whole AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (SELECT d, prefix, min(conv_id) AS c, count(*) AS n, max(chars) AS chars,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
    FROM whole GROUP BY ALL),
kids AS (SELECT d - 1 AS d, left(prefix, 64 * (d - 1)) AS prefix, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (d, prefix)),
below AS (SELECT k AS d, left(prefix, 64 * k) AS prefix, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * chars) AS saved
    FROM (SELECT *, unnest(range(d + 1)) AS k FROM own) GROUP BY ALL)
SELECT own.c AS conv_id, CAST(own.d AS BIGINT) AS depth, up.c AS parent_conv_id, own.n AS n_convs, own.kids AS n_children,
    leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(own.ids) AS ends_sha256
FROM own JOIN below USING (d, prefix)
LEFT JOIN nodes AS up ON up.d = own.d - 1 AND up.prefix = left(own.prefix, 64 * (own.d - 1))
"""

SHARED_LINES = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id"""


ORACLES: dict[str, str] = {
    "op1_mix_sources": _mix(),
    "op2_url_filter": URL_FILTER,
    "op4_warc_archive": _warc(),
    "op10_repeated_lines": LINES,
    "op12_conversation_trie": TRIE,
    "op13_shared_lines": SHARED_LINES,
}
