"""Problem 8: text garbled by a wrong character encoding - finding it and restoring it by strict round trips."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

#: Encodings that text was wrongly read as, and those it may have been written in (UTF-8 is handled by itself).
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp852", "mac_cyrillic", "iso8859_2", "cp1254")
WRITTEN_IN = ("cp1252", "cp1251", "cp1250", "koi8_r", "cp866", "cp850", "cp437", "mac_roman", "iso8859_2", "cp852", "mac_cyrillic", "shift_jis", "euc_jp", "gbk", "iso8859_5")
WIDE = ("gbk", "shift_jis", "big5")
TABLE = 1 << 18  # size of the hashed table of character pairs
FITTED = 10_000  # pairs a model must have seen before it may call a line garbled
UNLIKELY, LIKELIER = 10.5, 0.62  # nats a pair beyond which a line without any garbling sign is doubted; part of its nats that a repair may keep
HELD = 1 << 20  # slots a task holds until they are counted, about
NO_SLOTS = np.zeros(0, np.int64)

_LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
_CYR = "Ѐ-ӿ"
_GREEK = "Ͱ-Ͽ"
_CJK = "\u3040-\u30ff\u3400-\u9fff"
# Signs that never touch a letter in clean text.
_SIGN = "¡¢£¤¥¦¨©ª¬¯±²³´¸¹º¼½¾¿×÷·ˆˇ˘˙˚˛˜˝†‡‰‹›™₧⌐∂∆∏∑∙√∞∩∫≈≠≡≤≥◊⌠⌡─-◿ƒ‚„"
_UP = "À-ÖØ-ÞĂĄĆČĎĐĘĚŁŃŇŐŘŚŞŠŤŢŮŰŸŹŻŽŒ"
_LOW = "a-zß-öø-ÿăąćčďđęěłńňőřśşšťţůűźżžœ"
# Latin letters outside the alphabets of the corpus's languages: they cost a little when met inside words.
_ODD = "ÐðÞþÝýÿØøÅåĂăĐđĎďĽľĺĹŢţŤťŘřŮůŰűŐőÆæÌìÒòŞşĞğıİ"
# Clean sequences in which a sign touches a letter.
_CLEAN = re.compile(r"(?<![^\W\d_])[¿¡](?=[%s])|(?<=\d)[ªº]|°[CF]\b|(?<![Â-ÖØ-ô])[©™®]|[£€$¥](?=\d)|‚(?=[A-Z])|„(?=[A-ZÄÖÜŁŚŻ])|µ(?=s\b)" % _LATIN)

_RULES = [
    (4.0, re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]")),
    (1.0, re.compile(f"(?<=[{_LATIN}{_CYR}{_GREEK}])[{_SIGN}]+(?=[{_LATIN}{_CYR}{_GREEK}])")),
    (1.0, re.compile(f"[{_SIGN}](?=[{_SIGN}])(?![─-╿])")),
    (1.0, re.compile(f"(?<![{_LATIN}\\d])[²³¹¼½¾¬¸¨´¯·÷×±¤¦†‡ˆˇ˘˙˚˛˜˝ƒ√∞∫≈≠≤≥∂∆∏∑◊⌐⌠⌡¢┌-▟](?=[{_LATIN}{_CYR}])")),
    (1.0, re.compile(f"(?<=[{_LATIN}])[²³¹¼½¾¬¸¨´¯·÷×±¤¦ˆˇ˘˙˚˛˜˝ƒ√∞∫≈≠≤≥∂∆∏∑◊⌐⌠⌡¢┌-▟]")),
    (1.0, re.compile(f"(?<=[{_LOW}])[{_UP}](?![A-Z])")),
    (1.0, re.compile(f"(?<=[{_LATIN}])[{_CYR}{_GREEK}{_CJK}]|(?<=[{_CYR}{_GREEK}{_CJK}])[{_LATIN}](?![A-Za-z0-9_])|(?<=[{_CYR}])[{_GREEK}{_CJK}]|(?<=[{_GREEK}{_CJK}])[{_CYR}]")),
    (1.0, re.compile("[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЅЄЇѕґјЃ]")),
    (0.7, re.compile(f"(?<=[а-яё])[А-ЯЁ]")),
    (0.5, re.compile(f"[{_ODD}]")),
    (1.2, re.compile(f"(?<![{_LATIN}{_CYR}{_GREEK}\u0300-\u036f])[\u0300-\u036f]")),
    (1.0, re.compile("[\uff61-\uff9f]")),
    (1.0, re.compile("[Â-ÖØ-ßâãðñ][\x80-\xbf€‚ƒ„†‡ˆ‰Š‹ŒŽ˜š›œžŸ]|[ÂÃÄÅÐÑ][‘’“”•–—™…]|[àâä-ïô][\x80-\xbf€‚ƒ„†‡ˆ‰Š‹ŒŽ˜š›œžŸ‘’“”•–—™…]{2}")),
    (1.2, re.compile("[ƀ-ǹȀ-ȗȜ-˅ˊ-˗Ԁ-֏܀-ࣿ᐀-᙮Ͱ-΅ϐ-ϿѠ-ѿҀ-ҍ]")),
    (1.2, re.compile(f"(?<=[{_LATIN}])[\u0590-\u06ff]")),
    (1.0, re.compile("(?:&[A-Za-z]{2,8}[0-9]{0,2};){2,}")),
    (1.0, re.compile("[αΓπΣσµτΦΘΩδ∞φε∩≡](?=[a-z])")),
    (0.6, re.compile(r"[┌-▟](?=\w)|(?<=\w)[┌-▟]")),
    (1.0, re.compile(r"[áàâ†]Ä|[†ç]∞|∞C|[ìî](?=\w{1,40}[îì](?!\w))|(?<=[A-Za-z]{3})[îì](?=[.,]?$|[.,\s])")),
]
_ENTITY = re.compile("(?:&[A-Za-z]{2,8}[0-9]{0,2};){2,}")
_ASCII_ONLY = re.compile(r"[^\x00-\x7f]|&[A-Za-z]{2,8}[0-9]{0,2};&[A-Za-z]{2,8}[0-9]{0,2};")
#: Quoted characters without any plain letter between the quotes: such a text explains the characters and is not garbled itself. Garbled words in
#: quotes hold plain letters too.
_QUOTED = re.compile(r"`[^`\nA-Za-z]+`|«[^«»\nA-Za-z]+»|'[^'\nA-Za-z\s]+'|\"[^\"\nA-Za-z\s]+\"|“[^“”\nA-Za-z]+”")


def cost(text: str, limit: float = math.inf) -> float:
    """Garbling cost: weighted count of character sequences that clean text does not hold. Counting ends once limit is reached."""
    t = _CLEAN.sub("", text)
    total = 0.0
    for weight, rule in _RULES:
        total += weight * len(rule.findall(t))
        if total >= limit:
            return total
    return total + sum(0.5 * len(m) for m in _HAN_RUN.findall(t) if _was_utf8(m))


# Han characters without kana: where such a run round-trips through a wide encoding to well-formed UTF-8, it arose from one.
_HAN_RUN = re.compile("[\u3400-\u9fff]{3,}")


def _was_utf8(run: str) -> bool:
    for enc in WIDE:
        for cut in (run, run[:-1]):
            try:
                s = cut.encode(enc).decode("utf-8")
            except UnicodeError:
                continue
            if len(s) > 1 and not _HAN_RUN.search(s):
                return True
    return False


#: What clean text of any language or notation hardly ever holds. Unlike `cost`, which only ranks repairs, this decides by itself: formulas,
#: trees, foreign names and mixed scripts (x², πr, Dvořák, ├─, Python版) do not count.
_SURE = [
    (1.0, re.compile("[\x80-\x84\x86-\x9f]")),
    (1.0, re.compile(f"(?<=[{_LOW}])[{_UP}](?![{_LATIN}])|(?<=[a-z])[ÂÃÅÐÑ](?=[a-z])")),
    (1.0, re.compile("[Â-ÖØ-ßâãðñ][\x80-\xa1€‚ƒ„†‡ˆ‰Š‹ŒŽ˜š›œžŸ]|[ÂÃ][\xa2-\xbf]|â[€„‚]|ï[»¿]|‚Ä|√[©®¢£™´¨ÆØ]")),
    (1.0, re.compile(f"(?<=[{_LATIN}{_CYR}])[¡¢£¤¥¦¨©¯¸¿‰ˆˇ˘˙˚˛˜˝ƒ‚„]+(?=[{_LATIN}{_CYR}])")),
    (1.0, re.compile("(?<=[a-z])(?:[А-Я](?![А-яЁё])|[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЅЄЇѕґј]|[ΒΓ](?![α-ωά-ώ])|[\uff61-\uff9f]|[\u0590-\u06ff]|[├┬](?=[^─-╿\\s]))")),
    (1.0, re.compile("(?:[РС](?:[^\\s\\w]|[Ѐ-Џѐ-џҐґ])){2}|&(?:Atilde|Acirc|Auml|Aring);&[A-Za-z]{2,8}[0-9]{0,2};")),
    (0.4, re.compile("(?<=[а-яё])[А-ЯЁ](?![А-ЯЁ])")),
]
SURE = 1.0  # from here on a line is garbled even if nothing restores it


def evidence(text: str) -> float:
    """How much of a line cannot be clean, whether or not it can be restored."""
    t = _CLEAN.sub("", text)
    return sum(weight * len(rule.findall(t)) for weight, rule in _SURE) + sum(_was_utf8(m) for m in _HAN_RUN.findall(t))


# Letters and punctuation that restored text is most likely to hold; only breaks ties between repairs of equal cost.
_LIKELY = set("éèàùêâôûçîïüöäßñáíóúãõąęłśżźćńÉÀÇÜÖÄÃÕŁŚŻ’‘“”–—…•«»€°¿¡ ×→µ├─│└")


def _pairs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the text between two blanks, where a pair that holds a character beyond ASCII begins, and the table slots of these pairs."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    beyond = c > 127
    at = np.flatnonzero(beyond[:-1] | beyond[1:])
    h = (c[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (c[at + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return c, at, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)


def pair_slots(text: str) -> np.ndarray:
    """Table slots of the neighbouring character pairs that hold a character beyond ASCII."""
    return _pairs(text)[2]


def pair_slots_by_line(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all lines, and the number of the line of each."""
    c, at, slots = _pairs(" \n ".join(lines))  # what parts the lines is ASCII and makes no pair
    return slots, np.searchsorted(np.flatnonzero(c == 10), at)


class Model:
    """How unlikely character pairs are, counted on clean texts. `nats` of a text sums over its pairs beyond ASCII: garbled text has more of them,
    and rarer ones, than the text it arose from."""

    def __init__(self, counts: np.ndarray | None = None):
        self.fitted = counts is not None and int(counts.sum()) >= FITTED
        n = np.zeros(TABLE) if counts is None else counts.astype(np.float64)
        self.cost = (math.log(n.sum() + 0.1 * TABLE) - np.log(n + 0.1)).astype(np.float32)

    def nats(self, text: str) -> float:
        unlikely = sum(1 for c in text if c > "\x7f" and c not in _LIKELY and not "а" <= c <= "я" and not "А" <= c <= "Я" and not "぀" <= c <= "鿿")
        return float(self.cost[pair_slots(text)].sum()) + 0.02 * unlikely  # the second decides where nothing was counted


def _counted(rows: DataFrame, slots_of: Callable[[str], np.ndarray]) -> np.ndarray:
    """How often each slot comes up in all texts; at most TABLE rows reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(TABLE, np.int64), [], 0
        for b in batches:
            for t in b["text"]:
                held.append(slots_of(t))
                n += len(held[-1])
                if n >= HELD:
                    total += np.bincount(np.concatenate(held), minlength=TABLE)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=TABLE)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": total[at]})

    counts = np.zeros(TABLE, np.int64)
    for r in rows.mapInPandas(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    return counts


def fit(documents: DataFrame) -> Model:
    """Counts the pairs of all clean documents. What looks clean holds some garbled lines too, which would make their likes likelier; so the lines
    that a model of all of it doubts are taken out again."""
    rows = spread(documents.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("text"))
    counts = _counted(rows, lambda t: pair_slots_by_line(t.split("\n"))[0] if looks_clean(t) else NO_SLOTS)
    model = Model(counts)
    if not model.fitted:
        return model
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def doubted(text: str) -> np.ndarray:
        lines = unlikely_lines(text, shipped.value)
        return pair_slots_by_line(lines)[0] if lines and looks_clean(text) else NO_SLOTS

    return Model(counts - _counted(rows, doubted))


@lru_cache(maxsize=64)
def tables(enc: str) -> tuple[dict[int, int], str]:
    """char -> byte of a single-byte encoding; bytes it leaves undefined stand for the control character of that number."""
    to = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            c = chr(b)
        to[ord(c)] = b
    return to, ""


@lru_cache(maxsize=64)
def utf8_runs(enc: str) -> re.Pattern:
    """Regex over characters: sequences whose bytes under enc are well-formed UTF-8 of two or more bytes."""
    to, _ = tables(enc)
    cls = lambda lo, hi: "[" + "".join(re.escape(chr(c)) for c, b in to.items() if lo <= b <= hi) + "]"
    t = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{t}|{cls(0xE0, 0xEF)}{t}{t}|{cls(0xF0, 0xF4)}{t}{t}{t}")


def utf8_layer(text: str, enc: str) -> tuple[str, int]:
    """text with every sequence that strictly round-trips (enc bytes -> UTF-8) decoded, and the number of such sequences."""
    to, _ = tables(enc)
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        try:
            s = bytes(to[ord(c)] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        n += 1
        return s

    return utf8_runs(enc).sub(one, text), n


_WIDE_RUN = re.compile(f"[{_CJK}\uff00-\uffef\u3001-\u303f\ue000-\uf8ff]+[\x20-\x7e]?")


def wide_layer(text: str, enc: str) -> tuple[str, int]:
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        try:
            s = m[0].encode(enc).decode("utf-8")
        except UnicodeError:
            return m[0]
        if s == m[0]:
            return s
        n += 1
        return s

    return _WIDE_RUN.sub(one, text), n


def recased(line: str, leads: str) -> str:
    """Garbled text may have been lower-cased afterwards; bring lead letters back to upper case.

    A letter before a soft hyphen is more likely just that."""
    return re.sub("[%s](?=[€\x80-\xac\xae-\xbf‚-›€™œŒšŠžŽƒˆ˜])" % leads, lambda m: m[0].upper(), line)


@lru_cache(maxsize=64)
def byte_text(enc: str) -> tuple[frozenset[int], dict[int, str]]:
    """The characters of an encoding, and what str.translate needs to turn them into their bytes as Latin-1 characters."""
    to, _ = tables(enc)
    return frozenset(to), {c: chr(b) for c, b in to.items()}


@lru_cache(maxsize=256)
def _bytes_under(line: str, read_as: str) -> bytes | None:
    chars, to = byte_text(read_as)
    if not {ord(c) for c in set(line) if not c.isascii()} <= chars:
        return None
    return line.translate(to).encode("latin-1")


def swapped(line: str, read_as: str, written_in: str) -> str | None:
    """Strict re-encode under read_as, strict decode as written_in; undefined bytes count as control characters."""
    raw = _bytes_under(line, read_as)
    if raw is None:
        return None
    try:
        return raw.decode(written_in)
    except UnicodeDecodeError:
        return None


def ranked(candidates: dict[str, int], model: Model, below: float) -> tuple[str, float] | None:
    """The likeliest of the candidates whose garbling cost is below the given one, and this cost. All candidates are ranked."""
    for s in sorted(candidates, key=lambda s: (model.nats(s), s)):
        if (c := cost(s, below)) < below:
            return s, c
    return None


def best_step(unit: str, now: float, model: Model) -> tuple[str, float, bool]:
    """The repair of one layer: (text, cost, whether it was a UTF-8 round trip)."""
    forms = dict.fromkeys((unit, recased(unit, "à-ïðñâ"), recased(unit, "ãäåðñ"), _ENTITY.sub(lambda m: html.unescape(m[0]), unit)))
    trips: dict[str, int] = {}
    for form in forms:
        for enc in READ_AS:
            s, n = utf8_layer(form, enc)
            if n:
                trips.setdefault(s, n)
        for enc in WIDE:
            s, n = wide_layer(form, enc)
            if n:
                trips.setdefault(s, n)
    best = ranked(trips, model, now)
    clean = best is not None and best[1] <= 0.5
    if clean and (not model.fitted or model.nats(best[0]) < LIKELIER * model.nats(unit)):
        return *best, True
    # a swap of encodings beats a round trip only where it leaves nothing garbled and, if the round trip does so too, is likelier
    swaps = {s: 1 for a in READ_AS for b in WRITTEN_IN if a != b and (s := swapped(unit, a, b)) is not None and s != unit}
    other = ranked(swaps, model, 0.01 if best else now - 0.4)
    if other and not (clean and model.nats(best[0]) <= model.nats(other[0])):
        return *other, False
    return (*best, True) if best else (unit, now, False)


#: Signs that may stand anywhere in clean text, also where they were hardly ever seen.
_TYPESET = re.compile("[‘’“”–—…•]")


def unlikely(line: str, model: Model) -> bool:
    """Whether the characters beyond ASCII stand as they hardly ever do in clean text, though no sign tells of garbling."""
    if not model.fitted or _TYPESET.sub("", line).isascii():
        return False
    n = model.cost[pair_slots(line)]
    return len(n) >= 4 and float(n.mean()) > UNLIKELY


def unlikely_lines(text: str, model: Model) -> list[str]:
    """The lines that are `unlikely`. The pairs of all lines are looked up at once; only lines near the bound are looked at by themselves."""
    if not model.fitted or text.isascii():
        return []
    lines = text.split("\n")
    slots, line = pair_slots_by_line(lines)
    n = np.bincount(line, minlength=len(lines))
    near = (n >= 4) & (np.bincount(line, model.cost[slots], minlength=len(lines)) > (UNLIKELY - 0.01) * n)
    return [lines[i] for i in np.flatnonzero(near) if unlikely(lines[i], model)]


def likelier_swap(line: str, model: Model) -> str | None:
    """The line under another pair of encodings, where that is far likelier as a whole and likely by itself."""
    best, least = None, LIKELIER * model.nats(line)
    for a in READ_AS:
        for b in WRITTEN_IN:
            if a != b and (s := swapped(line, a, b)) is not None and s != line and (c := model.nats(s)) < least and cost(s) == 0 and not unlikely(s, model):
                best, least = s, c
    return best


def repair_unit(unit: str, model: Model) -> tuple[str, float, float, int]:
    """(text, cost before, cost after, layers) of one line. Every layer that is undone lowers the cost, so the search ends."""
    first = now = cost(unit)
    layers = 0
    while now > 0:
        s, c, utf = best_step(unit, now, model)
        if s == unit or c >= now:
            break
        if not utf and c > 0.4 * now:
            break
        unit, now, layers = s, c, layers + 1
    return unit, first, now, layers


_SENTENCE = re.compile(r"(?<=[.!?…])(\s+)")


@lru_cache(maxsize=1 << 17)
def clean_piece(piece: str) -> bool:
    return cost(piece) == 0


def looks_clean(text: str) -> bool:
    """What costs anything lies between two blanks, and most such pieces come up again and again."""
    if "&" in text and _ENTITY.search(text):
        return False
    pieces = set(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
    return all(clean_piece(p) if len(p) < 64 else cost(p) == 0 for p in pieces if not p.isascii())


def repair(text: str, model: Model | None = None) -> tuple[bool, str, int, bool]:
    """(garbled, text as far as restored, layers undone, fully restored) of a whole text, line by line, however long its lines are."""
    model = model or Model()
    doubted = bool(unlikely_lines(text, model))
    if not doubted:
        if looks_clean(text):
            return False, text, 0, True
        masked = _QUOTED.sub(lambda m: "x" * len(m[0]), text)
        if not _ASCII_ONLY.search(masked) or cost(masked) == 0:
            return False, text, 0, True
    found, layers, full, out = False, 0, True, []
    for line in re.split("(\n)", text):
        bare = _QUOTED.sub("", line)
        if not _ASCII_ONLY.search(bare) or cost(bare) == 0:
            better = likelier_swap(line, model) if doubted and unlikely(bare, model) else None
            found, layers = found or better is not None, max(layers, int(better is not None))
            out.append(line if better is None else better)
            continue
        s, before, after, k = repair_unit(line, model)
        if (k == 0 or after > 0.5) and _SENTENCE.search(line):
            parts = [repair_unit(p, model) if cost(p) else (p, 0.0, 0.0, 0) for p in _SENTENCE.split(line)]
            if sum(p[2] for p in parts) < after:
                s, after, k = "".join(p[0] for p in parts), sum(p[2] for p in parts), max(p[3] for p in parts)
        lost = "�" in bare
        if k and cost(_QUOTED.sub("", s)) < cost(bare) or lost:
            found, layers = True, max(layers, k)
            full &= not lost and after < 1
            out.append(s)
        elif evidence(bare) >= SURE:
            found, full = True, False
            out.append(line)
        else:
            out.append(line)
    return found, "".join(out), layers, full


RESULT = "struct<garbled:boolean,restored:string,layers:int,complete:boolean>"


def repaired(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents plus garbled, restored (NULL unless garbled), layers, complete (whether all of it could be restored).

    Only rows with non-ASCII text reach Python; NULL and empty texts are not garbled. Whole texts are treated, line by line. Signs that clean text
    does not hold (`cost`) tell what is garbled; of all repairs that lower this cost the likeliest by the `Model` fitted on the clean rows is taken.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(fit(documents.select(F.col(text_col).alias("text"))))  # 1 MB

    @F.pandas_udf(RESULT)
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(False, None, 0, True) if t is None else repair(t, shipped.value) for t in s]
            yield pd.DataFrame([(g, r if g else None, n, c) for g, r, n, c in rows], columns=["garbled", "restored", "layers", "complete"])

    base = documents.drop("garbled", "restored", "layers", "complete")
    some = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x00-\x7F]|&[A-Za-z]{2,8}[0-9]{0,2};&")
    # not deterministic for the optimizer: a later filter on the result must not move it below the dealing out
    return spread(base.where(some)).withColumn("_r", fix.asNondeterministic()(F.col(text_col))).select(*[F.col(c) for c in base.columns], "_r.*")


def garbled(documents: DataFrame) -> DataFrame:
    """doc_id, restored, layers, complete of every garbled document."""
    return repaired(documents.select("doc_id", "text")).where("garbled").select("doc_id", "restored", "layers", "complete")
