"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything is built from SQL functions of one row, so that no text is shuffled
and a text of any length stays in its own row. Offsets count code points and
ends are exclusive. Patterns are written so that each reads a text in linear
time: runs are possessive, and a run is only tried from its first character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.llm.text import computed_once
from joinseek.session import quoted
from joinseek.session import text as literal

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")

#: A quick test that must hold for a text with a span of this kind, and the pattern.
PATTERNS = {
    "email": (
        "contains({t}, '@')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    ),
    "ip": (r"{t} RLIKE '[0-9]\\.[0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("{t} RLIKE '[0-9](?:[ -]?[0-9]){{12}}'", r"[0-9](?:[ -]?[0-9])++"),
    "phone": ("contains({t}, '+')", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (
        "{t} RLIKE '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}'",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    ),
    "secret": (
        "{t} RLIKE '[:=]'",
        r"(?i:api[_-]?key|access[_-]?key|token|secret|passw(?:or)?d)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_+/.-]{8,}+",
    ),
    "ssn": ("{t} RLIKE '[0-9]-[0-9]{{2}}-[0-9]'", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}

#: Shorter matches cannot hold the digits their check asks for, nor can anything inside them.
SHORTEST = {"card": 13, "phone": 10}

#: Proposed again inside a rejected match, which may be several numbers in a row.
INNER = {
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
}

#: Score of a confirmed span without context, words near it that raise it and words before it that lower it.
SCORES = {
    "email": (0.9, "mail|contact|kontakt|correo", "example of"),
    "ip": (0.6, "ip|host|server|address|login", "version|release|section"),
    "card": (0.8, "card|visa|master|credit|karte|carte|tarjeta", "order|invoice|isbn"),
    "phone": (0.7, "phone|tel|call|mobile|fax", "order|invoice"),
    "iban": (0.9, "iban|bank|account|konto|compte|cuenta", "serial"),
    "secret": (0.7, "login|auth|key|config", "example|placeholder"),
    "ssn": (0.4, "ssn|social security|taxpayer", "order|invoice|part"),
}
CONTEXT_STEP = 0.2
CONTEXT_CHARS = 40
MIN_SCORE = 0.5

FOUND = "array<struct<start:int,stop:int,found:string>>"
SPANS = "array<struct<kind:string,start:int,stop:int,base:boolean,score:double>>"
BLOCK = 256
PIECE = 1024
BASE = ("email", "ip", "card", "phone")


def _blocks(rows: str) -> str:
    """An array in slices; arrays grow by copying, so only short ones are built element by element."""
    return f"transform(sequence(0, (size({rows}) - 1) div {BLOCK}), k -> slice({rows}, CAST(k * {BLOCK} AS INT) + 1, {BLOCK}))"


def _located(gaps: str, found: str, offset: str = "0", shortest: int = 0) -> str:
    """Matches of at least ``shortest`` characters with their offsets, from the text between matches and the matches.

    First the place where each block of matches begins, then those within it.
    """
    length = "length(x.gap) + length(x.found)"
    span = f"named_struct('start', at + length(x.gap), 'stop', at + {length}, 'found', x.found)"
    within = f"""aggregate(b, named_struct('at', s, 'spans', CAST(array() AS {FOUND})),
        (a, x) -> named_struct('at', a.at + {length}, 'spans', IF(length(x.found) < {shortest}, a.spans,
            concat(a.spans, transform(array(a.at), at -> {span})))),
        a -> a.spans)"""
    begins = f"""aggregate({{blocks}}, named_struct('at', {offset}, 'all', CAST(array() AS array<int>)),
        (a, b) -> named_struct('at', aggregate(b, a.at, (n, x) -> n + {length}), 'all', concat(a.all, array(a.at))),
        a -> a.all)"""
    zipped = f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, m) -> named_struct('gap', g, 'found', m))"
    # Arrays of one element, so that each is made once.
    blocks = f"transform(array({zipped}), z -> {_blocks('z')})"
    return f"flatten(transform({blocks}, blocks -> flatten(zip_with(blocks, {begins.format(blocks='blocks')}, (b, s) -> {within}))))"


def _digits(found: str) -> str:
    return f"regexp_replace({found}, '[^0-9]', '')"


def _luhn(found: str) -> str:
    """13 to 19 digits whose Luhn sum, doubling every second from the right, ends in 0."""
    d = _digits(found)
    value = f"CAST(substring(reverse({d}), i, 1) AS INT)"
    doubled = f"{value} * 2 - IF({value} > 4, 9, 0)"
    total = f"aggregate(sequence(1, length({d})), 0, (sum, i) -> sum + IF(i % 2 = 0, {doubled}, {value}))"
    return f"(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def _mod97(found: str) -> str:
    """15 to 34 characters that, first four moved to the end, leave 1 modulo 97."""
    plain = f"replace({found}, ' ', '')"
    moved = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
    char = f"substring({moved}, i, 1)"
    step = f"IF({char} < 'A', (r * 10 + try_cast({char} AS INT)) % 97, (r * 100 + ascii({char}) - 55) % 97)"
    rest = f"aggregate(sequence(1, length({moved})), 0, (r, i) -> {step})"
    return f"(length({plain}) BETWEEN 15 AND 34 AND {rest} = 1)"


VALID = {
    "email": "true",
    "ip": r"x.found RLIKE '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\\.|$)){4}'",
    "card": _luhn("x.found"),
    "phone": f"length({_digits('x.found')}) BETWEEN 9 AND 15",
    "iban": _mod97("x.found"),
    "secret": "true",
    "ssn": "NOT x.found RLIKE '^(?:000|666|9)|-00-|-0000$'",
}


def _pieces(text: str) -> str:
    """A text in pieces of equal length, so that no place in it is sought from its start."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def _cut(start: str, stop: str) -> str:
    """The part of the text in ``__pieces`` between two places."""
    first, last = f"CAST(({start}) div {PIECE} AS INT)", f"CAST(({stop}) div {PIECE} AS INT)"
    return f"substring(array_join(slice(__pieces, {first} + 1, {last} - {first} + 1), ''), ({start}) % {PIECE} + 1, ({stop}) - ({start}))"


def _scored(kind: str, spans: str, base: bool) -> str:
    """Spans with a score from their kind and the words around them."""
    start, more, less = SCORES[kind]
    before = f"lower({_cut('greatest(x.start - {0}, 0)'.format(CONTEXT_CHARS), 'x.start')})"
    after = f"lower({_cut('x.stop', f'x.stop + {CONTEXT_CHARS}')})"
    near = "IF({} RLIKE '(?:^|[^a-z])(?:{})(?:[^a-z]|$)', {}D, 0D)"
    raised = near.format(f"concat({before}, ' ', {after})", more, CONTEXT_STEP)
    score = f"round(least(1D, {start}D + {raised} - {near.format(before, less, CONTEXT_STEP)}), 3)"
    return (
        f"transform({spans}, x -> named_struct('kind', '{kind}', 'start', x.start, 'stop', x.stop,"
        f" 'base', {str(base).lower()}, 'score', {score}))"
    )


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array of personal-data spans per row.

    A span has kind, start, stop, base and score. Base spans are the leftmost
    matches of the four plain patterns that pass their check; they are always
    listed. The others (bank accounts, credentials, social security numbers, and
    numbers found inside a rejected match) need a score of at least 0.5. Null and
    empty texts have no spans; equal rows get equal spans; a column already
    called ``into`` is replaced, other columns stay as they are.
    """
    source = f"coalesce({quoted(text)}, '')"
    rest = [quoted(c) for c in docs.columns if c != into]
    proposed = []
    for kind, (test, pattern) in PATTERNS.items():
        present = test.format(t=source)
        none = "CAST(array() AS array<string>)"
        proposed.append(f"IF({present}, regexp_extract_all({source}, {literal(pattern)}, 0), {none}) AS __found_{kind}")
        proposed.append(f"IF({present}, split({source}, {literal(pattern)}, -1), {none}) AS __gaps_{kind}")
    located = [f"{_located(f'__gaps_{k}', f'__found_{k}', shortest=SHORTEST.get(k, 0))} AS __all_{k}" for k in KINDS]
    checked = [f"filter(__all_{k}, x -> {VALID[k]}) AS __ok_{k}" for k in KINDS]
    for kind, pattern in INNER.items():
        parts = _located(
            f"split(y.found, {literal(pattern)}, -1)", f"regexp_extract_all(y.found, {literal(pattern)}, 0)", "y.start"
        )
        inside = f"flatten(transform(filter(__all_{kind}, x -> NOT ({VALID[kind]})), y -> {parts}))"
        checked.append(f"filter({inside}, x -> {VALID[kind]}) AS __in_{kind}")
    any_found = " + ".join(f"size(__all_{k})" for k in KINDS)
    checked.append(f"IF({any_found} > 0, {_pieces(source)}, CAST(array() AS array<string>)) AS __pieces")
    all_spans = []
    for kind in KINDS:
        own = _scored(kind, f"__ok_{kind}", kind in BASE)
        if kind in INNER:
            own = f"concat({own}, {_scored(kind, f'__in_{kind}', False)})"
        # The fields after the kind sort by start, which merges the two lists.
        all_spans.append(f"array_sort({own}, (a, b) -> a.start - b.start)" if kind in INNER else own)
    listed = f"filter(concat({', '.join(all_spans)}), x -> x.base OR x.score >= {MIN_SCORE})"
    found = (
        docs.selectExpr(*rest, *proposed)
        .selectExpr(*rest, *located)
        .selectExpr(*rest, *(f"__all_{k}" for k in KINDS), *checked)
        .selectExpr(*rest, f"CAST({listed} AS {SPANS}) AS {quoted(into)}")
    )
    return computed_once(found, into)


def span_list(spans: str, base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    chosen = f"filter({quoted(spans)}, x -> x.base)" if base_only else quoted(spans)
    return F.expr(f"array_join(transform({chosen}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")


def count_of(spans: str, kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.expr(f"CAST(size(filter({quoted(spans)}, x -> x.base AND x.kind = '{kind}')) AS BIGINT)")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, as in ``<EMAIL>``.

    Overlapping spans become one, named after the first. A null text stays null;
    all columns and rows stay, in particular rows without any span.
    """
    name = quoted(text)
    columns = [quoted(c) for c in docs.columns]
    found = find_spans(docs, text, "__spans")
    ordered = "array_sort(__spans, (a, b) -> IF(a.start <> b.start, a.start - b.start, b.stop - a.stop))"
    blocks = found.selectExpr(
        *columns,
        "array_max(__spans.stop) AS __end",
        f"transform(array({ordered}), z -> {_blocks('z')})[0] AS __blocks",
        f"IF(size(__spans) > 0, {_pieces(name)}, NULL) AS __pieces",
    )
    # How far the spans before each block reach; a span that begins earlier is part of one of them.
    reached = """aggregate(__blocks, named_struct('stop', 0, 'all', CAST(array() AS array<int>)),
        (a, b) -> named_struct('stop', greatest(a.stop, array_max(b.stop)), 'all', concat(a.all, array(a.stop))), a -> a.all)"""
    firsts = """aggregate(b, named_struct('stop', s, 'all', CAST(array() AS array<struct<since:int,start:int,kind:string>>)),
        (a, x) -> named_struct('stop', greatest(a.stop, x.stop), 'all', IF(x.start < a.stop, a.all,
            concat(a.all, array(named_struct('since', a.stop, 'start', x.start, 'kind', x.kind))))),
        a -> a.all)"""
    named = blocks.selectExpr(*columns, "__end", "__pieces", f"flatten(zip_with(__blocks, {reached}, (b, s) -> {firsts})) AS __firsts")
    parts = f"array_join(transform(__firsts, x -> concat({_cut('x.since', 'x.start')}, '<', upper(x.kind), '>')), '')"
    cleaned = f"IF(__pieces IS NULL, {name}, concat({parts}, {_cut('__end', f'length({name})')})) AS {name}"
    return computed_once(named.selectExpr(*(cleaned if c == name else c for c in columns)), text)
