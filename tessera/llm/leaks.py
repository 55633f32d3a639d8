"""Problem 6: evaluation passages inside training texts - CGK embedding, bit sampling and edit verification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

WINDOW = 12  # words: the shortest passage that counts
STEPS = 2 * WINDOW  # length of a random walk; most end their window later, so that few samples fall behind the end
SAMPLED = 5  # positions of its walk a hash samples
RECALL = 0.95  # of single windows with two edits; longer passages hold several windows and are met more often, equal windows always
MOST_WALKS = 64
TRIALS = 2000  # edited windows of the items on which the number of walks is settled
MAX_EDITS = 2
BLOCK_WORDS = 1_000_000  # words of evaluation text indexed at once (about 0.3 GB); more are treated in several passes
SEED = 20
_INVISIBLE = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")
_MARK = re.compile("[\u0300-\u036f\u0483-\u0487]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, whatever the case, spacing, invisible characters and encoding of accents."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        text = _MARK.sub("", unicodedata.normalize("NFKC", text.casefold()))
    else:
        text = text.lower()
    return _WORD.findall(text)


def walk(symbols: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """CGK embedding of the WINDOW symbols from each start: STEPS symbols, reading on when the symbol's random bit says so.

    Windows at a small edit distance get embeddings at a small Hamming distance with good probability; equal ones equal embeddings.
    """
    out = np.empty((STEPS, len(starts)), np.int32)
    at, end = starts.copy(), starts + WINDOW
    for j in range(STEPS):
        s = np.where(at < end, symbols[np.minimum(at, len(symbols) - 1)], -1)
        out[j] = s
        at = at + np.where(s >= 0, bits[j][s], 0)
    return out


def keys(embedded: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """64-bit hash of the sampled positions of each embedding."""
    h = np.full(embedded.shape[1], 1469598103934665603, np.uint64)
    for j in sample:
        h = (h ^ (embedded[j].astype(np.int64) + 2).astype(np.uint64)) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h


def random_walk(j: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the j-th walk (by step and symbol) and the positions that its hash samples."""
    rng = np.random.default_rng((SEED, j))
    return rng.integers(0, 2, (STEPS, vocabulary + 1), np.int8), np.sort(rng.choice(STEPS, SAMPLED, replace=False))


def needed_walks(symbols: np.ndarray, starts: np.ndarray, vocabulary: int, recall: float) -> int:
    """How many independent walks meet windows with two edits (two words changed; one deleted and one inserted) with the wanted recall: measured
    on TRIALS windows of the items themselves, since it depends on how their words repeat."""
    rng = np.random.default_rng(SEED)
    at = starts[rng.integers(len(starts), size=TRIALS)]
    plain = symbols[at[:, None] + np.arange(WINDOW)]
    changed, shifted = plain.copy(), plain.copy()
    strange = vocabulary  # a word that no item holds
    for i in range(TRIALS):
        changed[i, rng.choice(WINDOW, 2, replace=False)] = strange
        gone, new = rng.integers(WINDOW), rng.integers(WINDOW)
        shifted[i] = np.insert(np.delete(plain[i], gone), new, strange)
    first = np.arange(TRIALS) * WINDOW
    met = np.zeros((2, TRIALS), bool)
    for j in range(MOST_WALKS):
        bits, sample = random_walk(j, vocabulary)
        own, *edited = (keys(walk(x.ravel(), first, bits), sample) for x in (plain, changed, shifted))
        met |= np.stack([own == e for e in edited])
        if met.mean(1).min() >= recall:
            return j + 1
    return MOST_WALKS


class Index:
    """Hashes of all item windows. Every window of every item is indexed; memory is bounded by BLOCK_WORDS. One walk meets equal windows."""

    def __init__(self, items: list[tuple[int, str]], walks: int | None = None, recall: float = RECALL):
        self.vocab: dict[str, int] = {}
        self.ids, lists = [], []
        for item_id, text in items:
            w = words(text)
            if len(w) >= WINDOW:
                self.ids.append(item_id)
                lists.append([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w])
        self.bounds = np.cumsum([0] + [len(x) for x in lists])
        self.symbols = np.array([s for x in lists for s in x], np.int32)
        starts = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(self.bounds, self.bounds[1:])]) if lists else np.zeros(0, np.int64)
        known = len(self.vocab) + 1  # and one for the strange word of the trials
        self.walks = (walks or needed_walks(self.symbols, starts, known, recall)) if len(starts) else 0
        self.bits, self.samples = [], []
        for j in range(self.walks):
            bits, sample = random_walk(j, known)
            self.bits.append(bits)
            self.samples.append(sample)
        self.tables, self.filters = [], []
        for bits, sample in zip(self.bits, self.samples) if len(starts) else []:
            k = keys(walk(self.symbols, starts, bits), sample)
            order = np.argsort(k, kind="stable")
            flag = np.zeros(1 << 20, bool)
            flag[(k & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((k[order], starts[order]))
            self.filters.append(flag)
        self.item_of = np.repeat(np.arange(len(lists)), np.diff(self.bounds)) if lists else np.zeros(0, int)

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct hash matches: rows of document start, item start."""
        found = np.zeros(0, np.int64)
        for bits, sample, (k, where), flag in zip(self.bits, self.samples, self.tables, self.filters):
            h = keys(walk(symbols, starts, bits), sample)
            hit = np.flatnonzero(flag[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(k, h[hit], "left"), np.searchsorted(k, h[hit], "right")
            n = hi - lo
            if n.sum():
                reach = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                found = np.union1d(found, np.repeat(starts[hit], n) * len(self.symbols) + where[reach])
        return np.stack(np.divmod(found, max(len(self.symbols), 1)), 1)


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    same = np.concatenate([[0], (a == b).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(same))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def edit_distances(a: np.ndarray, b: np.ndarray, most: int = MAX_EDITS) -> np.ndarray:
    """Edit distance of each row of a to the same row of b, exact up to `most` and larger than it beyond (banded, all rows at once)."""
    n, w = a.shape
    far = np.full(n, most + 1, np.int8)
    row = {j: np.full(n, j, np.int8) for j in range(min(w, most) + 1)}
    for i in range(1, w + 1):
        new: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(w, i + most) + 1):
            if j == 0:
                new[j] = np.full(n, i, np.int8)
                continue
            best = row.get(j - 1, far) + (a[:, i - 1] != b[:, j - 1]).astype(np.int8)
            best = np.minimum(best, row.get(j, far) + 1)
            new[j] = np.minimum(np.minimum(best, new.get(j - 1, far) + 1), most + 1)
        row = new
    return row[w]


def scan(index: Index, batch: pd.DataFrame, windows_at_once: int = 100_000) -> Iterator[tuple]:
    """(doc_id, item_id, longest exact run in words, fewest edits of a window) of one batch of documents."""
    get = index.vocab.get
    pos, doc_at, docs, buf = 0, [], [], []

    def flush() -> Iterator[tuple]:
        symbols = np.concatenate([*buf, np.zeros(WINDOW, np.int32)])
        begin = np.array(doc_at)
        known = np.concatenate([[0], np.cumsum(symbols > 0)])
        starts = np.flatnonzero(known[WINDOW:] - known[:-WINDOW] >= WINDOW - MAX_EDITS)
        if not len(starts):
            return
        pairs = index.candidates(symbols, starts)
        if not len(pairs):
            return
        d = np.searchsorted(begin, pairs[:, 0], "right") - 1
        item = index.item_of[pairs[:, 1]]
        span = np.arange(WINDOW)
        edits = edit_distances(symbols[pairs[:, :1] + span], index.symbols[pairs[:, 1:] + span])
        near = np.flatnonzero(edits <= MAX_EDITS)
        ends = np.append(begin[1:], pos)
        runs: dict[tuple[int, int], list[int]] = {}
        for x, y, diag in np.unique(np.stack([d[near], item[near], pairs[near, 0] - pairs[near, 1]], 1), axis=0).tolist():
            lo, hi = max(begin[x], index.bounds[y] + diag), min(ends[x], index.bounds[y + 1] + diag)
            e = runs.setdefault((x, y), [0, WINDOW])
            e[0] = max(e[0], longest_run(symbols[lo:hi], index.symbols[lo - diag : hi - diag]))
        for x, y, e in zip(d[near].tolist(), item[near].tolist(), edits[near].tolist()):
            runs[x, y][1] = min(runs[x, y][1], e)
        for (x, y), (run, e) in runs.items():
            yield docs[x], index.ids[y], run, e

    for doc_id, text in zip(batch["doc_id"], batch["text"]):
        s = np.array([get(w, 0) for w in words(text)] + [0], np.int32)
        docs.append(doc_id)
        doc_at.append(pos)
        buf.append(s)
        pos += len(s)
        if pos >= windows_at_once:
            yield from flush()
            pos, doc_at, docs, buf = 0, [], [], []
    if buf:
        yield from flush()


SCHEMA = "doc_id bigint, item_id bigint, run_words int, edits int"


@lru_cache(maxsize=1)
def _indexed(items: tuple[tuple[int, str], ...], walks: int | None, recall: float) -> Index:
    return Index(list(items), walks, recall)


def leaks(documents: DataFrame, items: DataFrame, walks: int | None = None, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, run_words, edits: every document with a window of 12 words within two edits of an item's window.

    edits 0 means an exact run of at least 12 words; run_words is the longest exact run on an alignment that was met. Windows that are equal
    always share all hashes, so exact runs are never missed; a single window with two edits is met with at least `recall`, for which the
    number of walks is measured (`needed_walks`) unless it is given. Items go in blocks of BLOCK_WORDS words; a block's texts are broadcast,
    every worker indexes them once, and all documents are held against it: no shuffle, and no memory grows with either table. NULL ids and
    texts, and texts shorter than 12 words, match nothing; whole texts are searched.
    """
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 2 * WINDOW - 2)))
    out, block, n = [], [], 0

    def against(block: list[tuple[int, str]]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(tuple(block))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _indexed(shipped.value, walks, recall)
            for b in batches:
                if index.tables:
                    yield pd.DataFrame(scan(index, b), columns=["doc_id", "item_id", "run_words", "edits"])

        return docs.mapInPandas(find, SCHEMA)

    rows = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        n += len(r["text"]) // 4
        if n > BLOCK_WORDS:
            out.append(against(block))
            block, n = [], 0
    out.append(against(block))
    return reduce(DataFrame.unionByName, out)


def exact_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct doc_id, item_id with at least 12 consecutive words of the item."""
    return leaks(documents, items, walks=1).where("edits = 0").select("doc_id", "item_id").distinct()


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, documents, longest_run, edited_documents for every item that leaked."""
    found = leaks(documents, items).groupBy("item_id").agg(
        F.count_distinct(F.when(F.col("edits") == 0, F.col("doc_id"))).alias("documents"),
        F.count_distinct(F.when(F.col("edits") > 0, F.col("doc_id"))).alias("edited_documents"),
        F.max("run_words").alias("longest_run"),
    )
    return found.join(F.broadcast(items.select("item_id", "suite")), "item_id").select("item_id", "suite", "documents", "edited_documents", "longest_run")
