"""The packing chunkers as SQL, to check the DataFrame expressions against: a list reduction per separator, nested."""

from __future__ import annotations

_BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SEPARATORS = ("chr(10) || chr(10)", "chr(10)", "chr(32)")
NONE = "[]::VARCHAR[]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANKS}|{_BLANKS}$', '', 'g')"


def kept(x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' THEN [{strip(x)}] ELSE {NONE} END"


def _pack(parts: str, sep: str, size: int, oversize, tidy, v: str) -> str:
    """Each part becomes a state {o: finished, c: held}; two states merge as the packer would go on from the first."""
    p, a, b = f"p{v}", f"a{v}", f"b{v}"
    state = f"{{'o': CASE WHEN length({p}) > {size} THEN {oversize(p)} ELSE {NONE} END, 'c': CASE WHEN length({p}) > {size} THEN '' ELSE {p} END, 'big': length({p}) > {size}}}"
    joined = f"CASE WHEN {a}.c <> '' THEN {a}.c || {sep} || {b}.c ELSE {b}.c END"
    merged = (
        f"{{'o': CASE WHEN {b}.big THEN {a}.o || ({tidy(a + '.c')}) || {b}.o WHEN length({joined}) <= {size} THEN {a}.o ELSE {a}.o || ({tidy(a + '.c')}) END,"
        f" 'c': CASE WHEN {b}.big THEN '' WHEN length({joined}) <= {size} THEN {joined} ELSE {b}.c END, 'big': false}}"
    )
    done = f"list_reduce(list_transform({parts}, lambda {p}: {state}), lambda {a}, {b}: {merged})"
    return f"list_transform([{done}], lambda z{v}: z{v}.o || ({tidy(f'z{v}.c')}))[1]"


def _level(text: str, size: int, n: int, v: str) -> str:
    if n == len(SEPARATORS):
        return f"list_filter(list_transform(range(0, CAST(ceil(length({text}) / {size}.0) AS BIGINT)), lambda i{v}: {strip(f'substr({text}, i{v} * {size} + 1, {size})')}), lambda h{v}: h{v} <> '')"
    return _pack(f"string_split({text}, {SEPARATORS[n]})", SEPARATORS[n], size, lambda p: _level(p, size, n + 1, v + "x"), kept, v + str(n))


def recursive(text: str, size: int, overlap: int, v: str = "r") -> str:
    raw = f"CASE WHEN {strip(text)} = '' THEN {NONE} WHEN length({text}) <= {size} THEN {kept(text)} ELSE {_level(text, size, 0, v)} END"
    if overlap <= 0:
        return raw
    return f"list_transform([{raw}], lambda l{v}: list_transform(range(1, len(l{v}) + 1), lambda k{v}: CASE WHEN k{v} > 1 THEN right(l{v}[k{v} - 1], {overlap}) || l{v}[k{v}] ELSE l{v}[k{v}] END))[1]"


def paragraph(text: str, size: int, overlap: int) -> str:
    parts = f"list_filter(list_transform(string_split({text}, {SEPARATORS[0]}), lambda s: {strip('s')}), lambda s: s <> '')"
    tidy = lambda x: f"CASE WHEN {x} <> '' THEN [{x}] ELSE {NONE} END"
    return f"CASE WHEN len({parts}) = 0 THEN {NONE} ELSE {_pack(parts, SEPARATORS[0], size, lambda p: recursive(p, size, overlap, 'q'), tidy, 'g')} END"


def csv(text: str, size: int) -> str:
    """Rows as states {o: finished groups, r: rows held, n: their size}; the header is the first line."""
    lines = f"string_split({strip(text)}, chr(10))"
    head = f"{lines}[1]"
    merged = (
        f"{{'o': CASE WHEN length({head}) + a.n + b.n > {size} THEN list_append(a.o, {head} || chr(10) || array_to_string(a.r, chr(10))) ELSE a.o END,"
        f" 'r': CASE WHEN length({head}) + a.n + b.n > {size} THEN b.r ELSE a.r || b.r END, 'n': CASE WHEN length({head}) + a.n + b.n > {size} THEN b.n ELSE a.n + b.n END}}"
    )
    states = f"list_transform({lines}[2:], lambda w: {{'o': {NONE}, 'r': [w], 'n': length(w) + 1}})"
    done = f"list_reduce({states}, lambda a, b: {merged})"
    return f"CASE WHEN {strip(text)} = '' OR len({lines}) < 2 THEN {NONE} ELSE list_transform([{done}], lambda z: list_append(z.o, {head} || chr(10) || array_to_string(z.r, chr(10))))[1] END"


def exploded(columns: str, source: str, chunks: str) -> str:
    return f"SELECT {columns}, CAST(i - 1 AS INT) AS chunk_index, c[i] AS chunk FROM (SELECT {columns}, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT {columns}, {chunks} AS c FROM {source}))"
