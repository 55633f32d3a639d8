"""Problem 5: source files that do not parse - lexer-state maps, bracket summaries and local grammars."""

from __future__ import annotations

import ast
import json
import re
import sys
import tomllib
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import suffix
from tessera.llm import grammars
from tessera.session import spread

# Fixed value: suffix -> language judged.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".ts": "ts", ".java": "java", ".go": "go", ".c": "c", ".h": "c",
    ".json": "json", ".toml": "toml", ".xml": "xml",
}
PIECE = 1 << 18  # code points of a file chunk; longer texts are summarised and parsed piece by piece in several partitions
GROUP = 1 << 16  # code points of statements that are parsed at once

# Lexer states; the summary of a piece maps each state it may begin in to the one it ends in, with what stays open.
CODE, LINE, BLOCK, DOUBLE, SINGLE, RAW, TRIPLE_D, TRIPLE_S, DIRECTIVE = range(9)
_SLASHES = {"//": LINE, "/*": BLOCK, '"': DOUBLE, "'": SINGLE}
_RULES = {
    "python": {"#": LINE, '"""': TRIPLE_D, "'''": TRIPLE_S, '"': DOUBLE, "'": SINGLE},
    "java": _SLASHES | {'"""': TRIPLE_D},
    "json": {'"': DOUBLE},
    "toml": {"#": LINE, '"""': TRIPLE_D, "'''": TRIPLE_S, '"': DOUBLE, "'": SINGLE},
    "go": _SLASHES | {"`": RAW},
    "js": _SLASHES | {"`": RAW},
    "ts": _SLASHES | {"`": RAW},
    "c": _SLASHES,
}
_END = {
    LINE: re.compile(r"[^\r\n]*+[\r\n]"), BLOCK: re.compile(r"(?:[^*]|\*(?!/))*+\*/"), DOUBLE: re.compile(r'(?:\\[\s\S]|[^"\\\n])*+("|\n)'), SINGLE: re.compile(r"(?:\\[\s\S]|[^'\\\n])*+('|\n)"),
    RAW: re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*+(?:`|\$\{)"), TRIPLE_D: re.compile(r'(?:\\[\s\S]|[^"\\]|"(?!""))*+"""'), TRIPLE_S: re.compile(r"(?:\\[\s\S]|[^'\\]|'(?!''))*+'''"),
    DIRECTIVE: re.compile(r"(?:\\\r?\n|[^\n\\]|\\(?!\r?\n))*+\n"),
}
_PLAIN = {("go", RAW): re.compile(r"[^`]*+`"), ("toml", SINGLE): re.compile(r"[^'\n]*+('|\n)"), ("toml", TRIPLE_S): re.compile(r"(?:[^']|'(?!''))*+'''")}
_EXTRA = {"js": "|/", "ts": "|/", "c": r"|(?<![^\n])[ \t]*\#"}
_OPENERS = {k: re.compile("|".join(map(re.escape, sorted(v, key=len, reverse=True))) + r"|[()\[\]{}]" + _EXTRA.get(k, "")) for k, v in _RULES.items()}
_MATE = {")": "(", "]": "[", "}": "{"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/\w*")
_BEFORE_REGEX = re.compile(r"(?:^|[(\[{,;=:?&|!+\-*%<>^~}]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|instanceof|yield|await))\s*\Z")
_BRANCH = re.compile(r"[ \t]*#[ \t]*(?:else|elif|if[ \t]+0\b)|__cplusplus")
_TAG = re.compile(
    r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<!(?!--|\[CDATA)[^>\[]*(?:\[[^\]]*\])?[^>]*>|</([^\s>]+)\s*>|<([^\s/>!?\"']+)(?:[^\"'>/]|\"[^\"]*\"|'[^']*'|/(?!>))*(/?)>"
)
_TAG_OPEN = re.compile(r"<!--|<!\[CDATA\[|<\?|<")
_TAG_END = {BLOCK: "-->", RAW: "]]>", DIRECTIVE: "?>", DOUBLE: ">"}
STATES = range(9)
UNSURE = "?"  # among the closing brackets: what follows may have been read in the wrong state


def _unmatched(closing: list[str], stack: list[str], v: str) -> None:
    if stack:  # a mismatch inside the piece stays visible for good
        closing.append("!")
    closing.append(v)


def _run_xml(piece: str, state: int) -> tuple[int, list[str], list[str]]:
    closing, stack, at = [], [], 0
    if state in _TAG_END:
        end = piece.find(_TAG_END[state])
        if end < 0:
            return state, closing, stack
        at = end + len(_TAG_END[state])
    while (begin := piece.find("<", at)) >= 0:
        m = _TAG.match(piece, begin)
        if not m:
            break
        at = m.end()
        if m[2] and not m[3]:
            stack.append(m[2])
        elif m[1] and stack and stack[-1] == m[1]:
            stack.pop()
        elif m[1]:
            _unmatched(closing, stack, "/" + m[1])
    if begin < 0:
        return CODE, closing, stack
    m = _TAG_OPEN.match(piece, begin)
    if m[0] == "<":
        closing.append(UNSURE)  # the name of a tag that the piece cuts in two is not known behind it
    return {"<!--": BLOCK, "<![CDATA[": RAW, "<?": DIRECTIVE, "<": DOUBLE}[m[0]], closing, stack


def run(lang: str, piece: str, state: int, before: tuple[str, ...] = (), spots: list | None = None) -> tuple[int, list[str], list[str]]:
    """(state at the end, closing brackets that the piece leaves unmatched, opening ones) from a state at its beginning.

    before: the brackets that are open at its beginning, where they are known; spots receives the stretches of code outside all brackets
    (of JSON: inside the outermost). Template literals open a bracket `$` whose end leads back into the literal.
    """
    if lang == "xml":
        return _run_xml(piece, state)
    closing, stack, at, n = [], list(before), 0, len(piece)
    rules, opener = _RULES[lang], _OPENERS[lang]
    level, since = (1 if lang == "json" else 0), 0
    while at < n:
        if state != CODE:
            m = (_PLAIN.get((lang, state)) or _END[state]).match(piece, at)
            if not m:
                return state, closing, stack
            at, state = m.end(), CODE
            if m[0].endswith("${") and lang in ("js", "ts"):
                stack.append("$")
            since = at
            continue
        m = opener.search(piece, at)
        if spots is not None and len(stack) == level:
            spots.append((since, m.start() if m else n))
        if not m:
            break
        v = m[0]
        begin, at = at, m.end()
        since = at
        if v in rules:
            state = rules[v]
        elif v in ("(", "[", "{"):
            stack.append(v)
        elif v == "/":
            back = piece[max(0, m.start() - 200) : m.start()]
            if _BEFORE_REGEX.search(back) and (r := _REGEX.match(piece, m.start())):
                at = since = r.end()
        elif v.endswith("#"):
            at, state = m.start(), DIRECTIVE
            if _BRANCH.match(piece, m.start()) or "__cplusplus" in piece[m.start() : m.start() + 80]:
                closing.append(UNSURE)
        elif v == "}" and stack and stack[-1] == "$":
            stack.pop()
            state = RAW
        elif stack and stack[-1] == _MATE[v]:
            stack.pop()
        else:
            _unmatched(closing, stack, v)
    return state, closing, stack


def summary(lang: str, piece: str, first: bool) -> dict[int, tuple[int, list[str], list[str]]]:
    """The lexer-state map of a piece. Pieces may not cut a token in two: see `pieces`."""
    return {s: run(lang, piece, s) for s in ((CODE,) if first else STATES) if s in _STATES_OF[lang]}


_STATES_OF = {k: {CODE, *v.values()} | ({DIRECTIVE} if k == "c" else set()) for k, v in _RULES.items()} | {"xml": {CODE, *_TAG_END}}


def join(a: dict, b: dict) -> dict:
    """Associative product of the summaries of two neighbouring pieces."""
    out = {}
    for s, (mid, closing, opened) in a.items():
        end, c2, o2 = b[mid]
        stack, c = list(opened), []
        for v in c2:
            if v == UNSURE:
                c.append(v)
            elif v != "!" and not [x for x in c if x != UNSURE] and stack and stack[-1] == _MATE.get(v, v[1:]):
                stack.pop()
            else:
                if v == "}" and stack and stack[-1] == "$":
                    c.append(UNSURE)  # the end of a template's expression; what follows was read as code
                if stack and not c:
                    c.append("!")
                c.append(v)
        out[s] = (end, closing + c, stack + o2)
    return out


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Cuts behind line ends, so that no quote, comment sign or escape is cut in two; a longer line stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find("\n", at + size - 1)
        while cut > 0 and text[cut - 1 : cut] in ("\\", "\r"):
            cut = text.find("\n", cut + 1) if text[cut - 1] == "\\" else cut
            if cut < 0 or text[cut - 1 : cut] != "\\":
                break
        if cut < 0:
            break
        out.append(text[at : cut + 1])
        at = cut + 1
    out.append(text[at:])
    return out


def reduced(summaries: list[dict]) -> dict:
    whole = summaries[0]
    for x in summaries[1:]:
        whole = join(whole, x)
    return whole


def sure(whole: dict) -> bool:
    return UNSURE not in whole[CODE][1]


def balanced(whole: dict) -> bool:
    end, closing, opened = whole[CODE]
    return not [x for x in closing if x != UNSURE] and not opened and end in (CODE, LINE, DIRECTIVE)


#: Where a statement may begin, outside all brackets, and the last sign before it; the language's other statements stay with the one before.
_START = {
    "python": (re.compile(r"^(?=[A-Za-z_@\"'(\[{*~+-])(?!(?:else|elif|except|finally|case)\b)", re.M), ""),
    "js": (re.compile(r"^(?=(?:import|export|function|async function|class|const|let|var|if|for|switch|try|throw|interface|type|enum|declare|namespace|abstract)\b)", re.M), ";}"),
    "java": (re.compile(r"^(?=[A-Za-z@])(?!(?:import|package)\b)", re.M), ";}"),
    "go": (re.compile(r"^(?=(?:func|type|var|const)\b)", re.M), ""),
    "c": (re.compile(r"^(?=[A-Za-z_])", re.M), ";}"),
    "json": (re.compile(r"(?<=,)"), ""),
}
_START["ts"] = _START["js"]
_HEADER = {"go": "package p\n"}  # what a later group needs in front


def starts(lang: str, piece: str, state: int = CODE, before: tuple[str, ...] = ()) -> list[int]:
    """Offsets at which a statement (of JSON: a member) may begin: the state that holds there proves that it lies outside all brackets."""
    if lang not in _START:
        return []
    spots: list[tuple[int, int]] = []
    run(lang, piece, state, before, spots)
    pattern, ahead = _START[lang]
    out, i, last = [], 0, 0
    for m in pattern.finditer(piece):
        at = m.start()
        while i < len(spots) and spots[i][1] < at:
            i += 1
        if i == len(spots):
            break
        if at == 0 or spots[i][0] > at:
            continue
        if ahead and piece[max(0, at - 400) : at].rstrip()[-1:] not in tuple(ahead):
            continue
        if lang == "python" and (piece[last : last + 1] == "@" or piece[max(0, at - 3) : at].rstrip("\r\n").endswith("\\")):
            last = at
            continue
        out.append(at)
        last = at
    return out


def groups(text: str, cuts: list[int], size: int) -> list[str]:
    """The text in runs of whole statements of at least size code points (the last may be shorter)."""
    out, at = [], 0
    for c in cuts:
        if c - at >= size:
            out.append(text[at:c])
            at = c
    return [*out, text[at:]]


def parse_group(lang: str, text: str, first: bool, last: bool, shell: str = "") -> str | None:
    """The local grammar on whole statements; members of a JSON value get its brackets (shell) around them again."""
    if lang != "json":
        return parse(lang, text if first else _HEADER.get(lang, "") + text)
    inner = text.strip(" \t\r\n")
    inner = inner if last else inner.removesuffix(",")
    members = inner[int(first) : len(inner) - int(last)]
    if not members.strip(" \t\r\n"):
        return "member expected"
    return parse(lang, ("" if first else shell[0]) + inner + ("" if last else shell[1]))


def _no_constant(name: str):
    raise ValueError(name)


def parse(lang: str, text: str) -> str | None:
    """The local grammar of a language: None for a valid text, else what is wrong."""
    text = text.removeprefix("﻿")
    if not text.strip():
        return None
    keep = sys.getrecursionlimit()
    sys.setrecursionlimit(max(keep, 50_000))
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "file", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
        elif lang == "json":
            json.loads(text, parse_constant=_no_constant, parse_int=str, parse_float=str)
        elif lang == "toml":
            tomllib.loads(text)
        elif lang == "xml":
            expat.ParserCreate("utf-8").Parse(re.sub(r"(<\?xml[^>]*?)\sencoding\s*=\s*(\"[^\"]*\"|'[^']*')", r"\1", text, count=1).encode("utf-8", "surrogatepass"), True)
        else:
            grammars.check(lang, text)
    except (SyntaxError, ValueError, expat.ExpatError, grammars.Bad) as e:
        return (str(e) or type(e).__name__)[:200]
    except (RecursionError, MemoryError):
        return json_error(text) if lang == "json" else DEEP
    finally:
        sys.setrecursionlimit(keep)
    return None


DEEP = "nested too deeply for the grammar"
_JSON = re.compile(r'[ \t\r\n]*(?:([\[{\]},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b))')


def json_error(text: str) -> str | None:
    """JSON of any depth, without recursion: what may come next depends on the innermost bracket alone."""
    stack, want, at, end = [], "value", 0, len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _JSON.match(text, at)
        if not m:
            return f"unexpected character at {at}"
        at, sign, string, other = m.end(), *m.groups()
        if want in ("value", "value or ]") and (string or other or sign in ("[", "{")):
            if sign:
                stack.append(sign)
            want = {"[": "value or ]", "{": "key or }"}.get(sign, "next")
        elif want in ("key", "key or }") and string:
            want = ":"
        elif want == ":" and sign == ":":
            want = "value"
        elif want == "next" and sign == "," and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif sign in ("]", "}") and stack and stack[-1] == _MATE[sign] and want in ("next", {"]": "value or ]", "}": "key or }"}[sign]):
            stack.pop()
            want = "next"
        else:
            return f"{want} expected at {at}"
    return None if want == "next" and not stack else "the text ends too early"


def verdict(lang: str, text: str, whole: dict) -> str | None:
    """The exact check of a whole text, for what its summary or one of its groups makes doubtful. Where it is nested too deeply for the grammar
    the brackets decide."""
    e = parse(lang, text)
    if e != DEEP:
        return e
    return "brackets or quotes are not balanced" if sure(whole) and not balanced(whole) else None


def judge(lang: str, text: str) -> str | None:
    """Reduce the summaries of the text's pieces; parse the statements of a balanced text group by group; check exactly what is doubtful."""
    text = text.removeprefix("\ufeff")
    if not text.strip():
        return None
    whole = reduced([summary(lang, p, i == 0) for i, p in enumerate(pieces(text))])
    if sure(whole) and balanced(whole):
        cuts = starts(lang, text) if len(text) > GROUP else []
        some = groups(text, cuts, GROUP)
        shell = text.lstrip()[:1] + text.rstrip()[-1:]
        if len(some) > 1 and all(parse_group(lang, g, i == 0, i == len(some) - 1, shell) is None for i, g in enumerate(some)):
            return None
    return verdict(lang, text, whole)


def language(path: Column) -> Column:
    s = F.lower(suffix(path))
    return F.coalesce(*[F.when(s == k, v) for k, v in LANGUAGES.items()])


def judged(extractions: DataFrame, pieces_parsed: Accumulator | None = None) -> DataFrame:
    """file_id, directory, language, error (NULL for a valid file) of every row of a judged language.

    Texts of up to PIECE code points are summarised, reduced and parsed in the task that reads them, without a shuffle. Longer ones are cut, the
    pieces are summarised in parallel, and the summaries (a few bytes each) are reduced per file; they tell the state and the open
    brackets in which each piece begins, so that its statements are parsed where it lies, and only statements that lie in several pieces are put
    together. What is doubtful after that is checked as a whole text. NULL and blank texts are valid, rows of other content types or
    suffixes are not judged; NULL file_ids are kept. pieces_parsed counts the pieces of which statements were parsed where they lie.
    """
    rows = (
        extractions.where(F.col("content_type").isin("code", "structured_data"))
        .select("file_id", "directory", language(F.col("file_path")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
        .where(F.col("language").isNotNull())
    )
    schema = "file_id bigint, directory string, language string, error string"

    def result(b: pd.DataFrame, err: list) -> pd.DataFrame:
        return pd.DataFrame({"file_id": b["file_id"].astype("Int64"), "directory": b["directory"], "language": b["language"], "error": pd.Series(err, dtype=object)})

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield result(b, [judge(g, t) for g, t in zip(b["language"], b["text"])])

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(int(i), g, k, p) for i, g, t in zip(b["_key"], b["language"], b["text"]) for k, p in enumerate(pieces(t.removeprefix("\ufeff")))]
            yield pd.DataFrame(out, columns=["_key", "language", "no", "piece"])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [json.dumps(summary(g, p, k == 0)) for g, k, p in zip(b["language"], b["no"], b["piece"])]
            yield pd.DataFrame({"_key": b["_key"], "no": b["no"], "summary": s})

    @F.udf("struct<whole:string,entries:array<struct<no:int,entry:string>>>", useArrow=True)
    def entered(parts: list) -> tuple:
        """The reduced summary, and the state and open brackets in which each piece begins."""
        whole, out = None, []
        for r in parts:
            s = _loaded(r["summary"])
            out.append((r["no"], json.dumps([CODE, []] if whole is None else [whole[CODE][0], whole[CODE][2]])))
            whole = s if whole is None else join(whole, s)
        return json.dumps(whole), out

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What of each piece is whole statements is parsed here; the ends of statements that lie in several pieces go on."""
        for b in batches:
            out = []
            for key, no, g, p, entry in zip(b["_key"], b["no"], b["language"], b["piece"], b["entry"]):
                state, before = json.loads(entry)
                cuts = starts(g, p, state, tuple(before))
                if not cuts:
                    out.append((key, no, True, False, p, ""))
                    continue
                inner = [c - cuts[0] for c in cuts[1:]]
                shell = {"[": "[]", "{": "{}"}.get(before[0] if before else p.lstrip()[:1], "") if g == "json" else ""
                fine = all(parse_group(g, x, False, False, shell) is None for x in groups(p[cuts[0] : cuts[-1]], inner, GROUP) if x.strip()) if g != "json" or shell else True
                if pieces_parsed is not None:
                    pieces_parsed.add(1)
                keep = cuts[-1] if g != "json" or shell else cuts[0]
                out.append((key, no, fine, True, p[: cuts[0]], p[keep:]))
            yield pd.DataFrame(out, columns=["_key", "no", "fine", "cut", "head", "tail"])

    def doubtful(language: str, whole: str, parts: list) -> bool:
        """Whether a group failed, or the brackets do, or a statement that lies in several pieces fails."""
        s = _loaded(whole)
        if not (sure(s) and balanced(s)) or not all(r["fine"] for r in parts):
            return True
        held, some = parts[0]["head"], []
        shell = parts[0]["head"].lstrip()[:1] + (parts[-1]["tail"] or parts[-1]["head"]).rstrip()[-1:]
        for k, r in enumerate(parts):
            held = held + r["head"] if k else held
            if r["cut"]:
                some.append(held)
                held = r["tail"]
        some.append(held)
        return any(parse_group(language, x, i == 0, i == len(some) - 1, shell) is not None for i, x in enumerate(some) if x.strip() or language == "json")

    def long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield result(b, [verdict(g, t.removeprefix("\ufeff"), _loaded(w)) if d else None for g, t, w, d in zip(b["language"], b["text"], b["whole"], b["doubt"])])

    small = spread(rows.where(F.length("text") <= PIECE)).mapInPandas(short, schema)
    big = rows.where(F.length("text") > PIECE).withColumn("_key", F.xxhash64("language", "text"))
    cuts = big.select("_key", "language", "text").dropDuplicates(["_key"]).mapInPandas(cut_up, "_key bigint, language string, no int, piece string").repartition("_key", "no")
    sums = cuts.mapInPandas(summarise, "_key bigint, no int, summary string")
    reduced_ = sums.groupBy("_key").agg(entered(F.sort_array(F.collect_list(F.struct("no", "summary")))).alias("_e")).select("_key", "_e.whole", "_e.entries")
    entries = reduced_.select("_key", F.inline("entries"))
    done = cuts.join(entries, ["_key", "no"]).mapInPandas(parsed, "_key bigint, no int, fine boolean, cut boolean, head string, tail string")
    ends = done.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("no", "fine", "cut", "head", "tail"))).alias("parts"))
    doubt = F.udf(doubtful, "boolean", useArrow=True)
    judged_ = big.join(reduced_.select("_key", "whole"), "_key").join(ends, "_key").select("file_id", "directory", "language", "text", "whole", doubt("language", "whole", "parts").alias("doubt"))
    return small.unionByName(judged_.mapInPandas(long, schema))


def _loaded(text: str) -> dict:
    return {int(k): tuple(v) for k, v in json.loads(text).items()}


def rates(extractions: DataFrame) -> DataFrame:
    """directory, language, files, invalid, rate."""
    n, bad = F.count(F.lit(1)), F.count("error")
    return judged(extractions).groupBy("directory", "language").agg(n.alias("files"), bad.alias("invalid"), (bad / n).alias("rate"))
