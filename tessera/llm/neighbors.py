"""Problem 3: the k most similar vectors of every vector - inverted lists scanned by an adaptive dimension scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.repeats import by_repetition
from tessera.session import cores, cut

K = 10
SAMPLE = 60_000  # vectors the coarse k-means is fitted on, at most
FLAT_LISTS = 1500  # beyond this many lists, centres are fitted cell by cell in tasks, on at most CELL_SAMPLE vectors a cell
CELL_SAMPLE = 40_000
PILOT = 256  # searched exactly, in every run, to find how many lists a vector must probe
TARGET = 0.98  # share of the pilot's true neighbours that lie in the probed lists
MIN_PROBED = 4
BLOCKS = (32, 48)  # dimensions after which the hypothesis test is made; the last block completes the distance
EPSILON = 1.7  # strictness of the test: a true neighbour is lost with a probability below exp(-c * EPSILON**2)
GROUP_MOST, GROUP_LEAST = 250_000, 2_000  # vectors of a task: at most (64 MB), and at least when all cores shall have work
SLICE = 1 << 12  # candidate vectors that are scanned at once, at most
PAIRS = 1 << 22  # queries x candidates (or centres) of one product, at most
DENSE = 0.03  # share of surviving pairs above which the next column block is multiplied as a whole
DONE = 1 - 1e-6  # a vector whose k-th best score is this high has nothing better to find
SEED = 33


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty centre restarts at a random vector."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(a, kind="stable")
        n = np.bincount(a, minlength=k)
        ends = np.cumsum(n)
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (ends - n)[full], axis=0)
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def usable(points: DataFrame, dim: int) -> DataFrame:
    """id, vector: one row per id whose vector has dim finite numbers that are not all zero. Repeated ids give the greatest vector."""
    v = F.col("vector")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    one, more = by_repetition(points.select("id", "vector").where(good), "id")
    return one.unionByName(more.groupBy("id").agg(F.max("vector").alias("vector")))


def unit(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x @ turn).astype(np.float32)


def flat(column: pa.Array, rows: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(rows, -1)


def floats(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


class Lists:
    """The vectors of one task in the order of their lists, with the halved squared lengths of their leading dimensions."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, lists: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.x, self.keys, lists = x[order], keys[order], lists[order]
        cuts = np.flatnonzero(np.diff(lists)) + 1
        self.span = {int(lists[a]): (int(a), int(b)) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(lists)])}
        self.half = {d: 0.5 * (self.x[:, :d] ** 2).sum(1) for d in BLOCKS if d < x.shape[1]}
        d = next(iter(self.half), x.shape[1])
        length = self.half.get(d, np.zeros(len(x), np.float32))
        self.lead = np.ascontiguousarray(np.concatenate([self.x[:, :d], -length[:, None]], 1))  # the length rides along in the product


class Queries:
    """Vectors that search, with the k best found so far; `bound` is the k-th best score known from elsewhere."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.x, self.keys, self.k, self.dim = x, keys, k, x.shape[1]
        self.bound = np.full(len(x), -2.0, np.float32) if bound is None else bound
        self.top = np.full((len(x), k), -2.0, np.float32)
        self.who = np.full((len(x), k), -1, np.int64)
        self.half = {d: 0.5 * (x[:, :d] ** 2).sum(1) for d in BLOCKS if d < self.dim}
        d = next(iter(self.half), self.dim)
        self.lead = np.concatenate([x[:, :d], np.ones((len(x), 1), np.float32)], 1)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.bound[rows], self.top[rows, -1])

    def scan(self, rows: np.ndarray, c: Lists, lo: int, hi: int) -> None:
        """Score the candidates lo to hi for the given rows, so many at a time that a product has PAIRS pairs at most."""
        for at in range(lo, hi, SLICE):
            to = min(at + SLICE, hi)
            tile = max(1, PAIRS // (to - at))
            for a in range(0, len(rows), tile):
                part = rows[a : a + tile]
                worst = self.worst(part)
                live = worst < DONE
                if live.any():
                    self.scan_tile(part[live], worst[live], c, at, to)

    def scan_tile(self, rows: np.ndarray, worst: np.ndarray, c: Lists, lo: int, hi: int) -> None:
        """On unit vectors the squared distance over the first d rotated dimensions, scaled by dim/d, estimates the full one; a pair is
        abandoned once it exceeds the k-th best distance so far by the factor (1 + EPSILON / sqrt(d)) ** 2. Written with the dot product: it
        lives while dot - |c|^2/2 >= |q|^2/2 - bound/2.
        """
        q, cand = self.x[rows], c.x[lo:hi]
        if worst.max() < -1:  # nothing to compare with yet: the k best of the whole block are the start
            dot = q @ cand.T
            near = min(self.k + 1, len(cand))
            j = np.argpartition(-dot, near - 1, axis=1)[:, :near].ravel()
            i = np.repeat(np.arange(len(rows)), near)
            return self.merge(rows, i, j, dot[i, j], worst, c.keys[lo:hi])
        limit = 2 - 2 * worst
        i = j = score = None
        done = 0
        for d, half in self.half.items():
            least = half[rows] - (0.5 * d / self.dim * (1 + EPSILON / d**0.5) ** 2) * limit
            if i is None:
                part = self.lead[rows] @ c.lead[lo:hi].T
                at = np.flatnonzero(part >= least[:, None])
                i, j = np.divmod(at, hi - lo)
                score = part.ravel()[at] + c.half[d][lo:hi][j]
            else:
                score += self.block(q, cand, i, j, done, d)
                keep = score - c.half[d][lo:hi][j] >= least[i]
                i, j, score = i[keep], j[keep], score[keep]
            done = d
        if i is None:
            dot = q @ cand.T
            i, j = np.nonzero(dot > worst[:, None])
            score = dot[i, j]
        else:
            score = score + self.block(q, cand, i, j, done, self.dim)
        self.merge(rows, i, j, score, worst, c.keys[lo:hi])

    def block(self, q: np.ndarray, cand: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Dot products of the pairs over the columns lo to hi: as one product where many pairs live, pair by pair where few do."""
        if len(i) > DENSE * len(q) * len(cand):
            return (q[:, lo:hi] @ cand[:, lo:hi].T)[i, j]
        return np.einsum("nd,nd->n", q[i, lo:hi], cand[j, lo:hi])

    def merge(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, worst: np.ndarray, keys: np.ndarray) -> None:
        ok = (score > worst[i]) & (self.keys[rows[i]] != keys[j])
        i, j, score = i[ok], j[ok], score[ok]
        if not len(i):
            return
        some, at = np.unique(i, return_inverse=True)
        to = rows[some]
        r = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        s = np.concatenate([self.top[to].ravel(), score])
        w = np.concatenate([self.who[to].ravel(), keys[j]])
        order = np.lexsort((-s, r))
        r, s, w = r[order], s[order], w[order]
        sel = np.arange(len(r)) - np.searchsorted(r, r, "left") < self.k
        self.top[to] = s[sel].reshape(-1, self.k)
        self.who[to] = w[sel].reshape(-1, self.k)

    def near(self, rows: np.ndarray) -> pa.Array:
        """The neighbours found, as a list of (score, other) a row."""
        top = self.top[rows]
        have = top > -2
        pairs = pa.StructArray.from_arrays([pa.array(top[have]), pa.array(self.who[rows][have])], names=["score", "other"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(have.sum(1))].astype(np.int32)), pairs)


def nearest_lists(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The nearest lists of each vector, best first."""
    out = np.empty((len(q), probes), np.int32)
    tile = max(1, PAIRS // len(centres))
    for a in range(0, len(q), tile):
        s = -(q[a : a + tile] @ centres.T)
        j = np.argpartition(s, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(probes), (len(s), 1))
        out[a : a + tile] = np.take_along_axis(j, np.argsort(np.take_along_axis(s, j, 1), axis=1, kind="stable"), 1)
    return out


def fit_centres(sampled: DataFrame, n: int, turn: np.ndarray) -> np.ndarray:
    """About sqrt(n) centres. Up to FLAT_LISTS come from one k-means on at most SAMPLE vectors. More come from two levels: every coarse
    cell's share of the centres is fitted in a task, on at most CELL_SAMPLE of the cell's vectors; only centres reach the driver."""
    share = lambda most: int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 20)) + 1
    some = lambda most: sampled.where(F.pmod("h", F.lit(1 << 20)) < share(most))
    rows = some(SAMPLE).orderBy("h").limit(SAMPLE).select("vector").toPandas()
    if len(rows) < 2:
        return np.zeros((0, len(turn)), np.float32)
    x = unit(np.stack(rows["vector"].to_numpy()), turn)
    lists = int(max(1, round(n**0.5)))
    if lists <= FLAT_LISTS:
        return k_means(x, max(1, min(lists, len(x) // 8)))
    coarse = k_means(x, max(1, min(round(lists**0.5), len(x) // 8)))
    part = np.bincount((x @ coarse.T).argmax(1), minlength=len(coarse)) / len(x)
    shipped = sampled.sparkSession.sparkContext.broadcast((turn, coarse))
    keep = np.minimum(1.0, CELL_SAMPLE / np.maximum(part * 48 * lists, 1))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, coarse = shipped.value
        for b in batches:
            v = unit(flat(b.column(1), b.num_rows), turn)
            c = (v @ coarse.T).argmax(1)
            ok = (np.asarray(b.column(0)) >> 20 & 0xFFFFF) / (1 << 20) < keep[c]
            yield pa.RecordBatch.from_arrays([pa.array(c[ok].astype(np.int32)), pa.array([r.tobytes() for r in v[ok]], pa.binary())], names=["cell", "vec"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(frame["vec"]), np.float32).reshape(len(frame), -1)
        k = max(1, min(round(lists * part[frame["cell"].iloc[0]]), len(v) // 8))
        return pd.DataFrame({"vec": [r.tobytes() for r in k_means(v, k)]})

    fitted = some(48 * lists).select("h", "vector").mapInArrow(cell, "cell int, vec binary").groupBy("cell").applyInPandas(fit, "vec binary").toPandas()
    return np.frombuffer(b"".join(fitted["vec"]), np.float32).reshape(len(fitted), -1)


def needed_probes(assigned: DataFrame, centres: np.ndarray, k: int) -> int:
    """How many of its nearest lists a vector must probe so that they hold TARGET of the true k nearest: measured on PILOT vectors, whose
    neighbours are found by an exact scan of all vectors."""
    rows = assigned.select("key", "vec").orderBy(F.xxhash64("key")).limit(PILOT).toPandas()
    shipped = assigned.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(rows["vec"]), np.float32).reshape(len(rows), -1), rows["key"].to_numpy()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, keys = shipped.value
        best, at = np.full((len(q), 1), -2.0, np.float32), np.zeros((len(q), 1), np.int32)
        for b in batches:
            s = q @ floats(b.column(2)).T
            s[keys[:, None] == np.asarray(b.column(0))[None, :]] = -2
            best, at = np.concatenate([best, s], 1), np.concatenate([at, np.tile(np.asarray(b.column(1)), (len(q), 1))], 1)
            j = np.argsort(-best, axis=1)[:, :k] if best.shape[1] <= k else np.argpartition(-best, k, axis=1)[:, :k]
            best, at = np.take_along_axis(best, j, 1), np.take_along_axis(at, j, 1)
        i, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(best[i, j]), pa.array(at[i, j])], names=["q", "score", "list"])

    found = assigned.select("key", "list", "vec").mapInArrow(exact, "q int, score float, list int")
    top = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "list")), asc=False), 1, k).alias("t")).collect()
    order = np.argsort(np.argsort(-(shipped.value[0] @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort([order[r["q"], t["list"]] for r in top for t in r["t"]])
    return int(min(len(centres), max(MIN_PROBED, ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))] + 1)))


def grouped(centres: np.ndarray, sizes: np.ndarray, groups: int) -> np.ndarray:
    """The group of each list: lists are halved again and again along their main direction, in proportion to their vectors."""
    out = np.zeros(len(centres), np.int64)

    def halve(idx: np.ndarray, first: int, n: int) -> None:
        if n <= 1 or len(idx) <= 1:
            out[idx] = first
            return
        x = centres[idx] - centres[idx].mean(0)
        side = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        idx = idx[np.argsort(side, kind="stable")]
        left = n // 2
        load = np.cumsum(sizes[idx])
        at = int(np.clip(np.searchsorted(load, load[-1] * left / n) + 1, 1, len(idx) - 1))
        halve(idx[:at], first, left)
        halve(idx[at:], first + left, n - left)

    halve(np.arange(len(centres)), 0, groups)
    return out


def ranked(points: DataFrame, k: int = K, dim: int = 64) -> tuple[DataFrame, DataFrame] | None:
    """((key, near: the k best as (score, other), best first), (key, id)); None for fewer than two usable vectors. See `neighbors`."""
    spark = points.sparkSession
    turn = rotation(dim)
    base = usable(points, dim)
    n = base.count()
    if n < 2:
        return None
    centres = fit_centres(base.select(F.xxhash64("id").alias("h"), "vector"), n, turn)
    lists = len(centres)
    shipped = spark.sparkContext.broadcast((turn, centres))  # about sqrt(n) vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = unit(flat(part.column(1), part.num_rows), turn)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest_lists(x, centres, 1)[:, 0]), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "list", "vec"])

    assigned = cut(base.mapInArrow(assign, "id string, list int, vec binary").withColumn("key", F.monotonically_increasing_id()))
    sizes = np.zeros(lists, np.int64)
    for r in assigned.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    probes = needed_probes(assigned, centres, k)
    groups = int(max(1, min(lists, max(np.ceil(n / GROUP_MOST), min(cores(spark), np.ceil(n / GROUP_LEAST))))))
    group_of = grouped(centres, sizes, groups)
    load = np.bincount(group_of, weights=sizes, minlength=groups)
    parts = np.maximum(1, np.ceil(load / max(GROUP_MOST, 2 * n / groups))).astype(np.int64)  # a list that outgrows a task is split by key
    first = np.cumsum(parts) - parts
    tasks = int(parts.sum())
    routes = spark.sparkContext.broadcast((group_of, first, parts))
    plan = F.broadcast(spark.createDataFrame([(i, int(first[g]), int(parts[g])) for i, g in enumerate(group_of)], "list int, _first int, _parts int"))
    placed = assigned.join(plan, "list").select((F.col("_first") + F.pmod(F.xxhash64("key"), F.col("_parts"))).cast("int").alias("task"), "list", "key", "vec")

    def gathered(batches: list[tuple]) -> Lists:
        return Lists(*(np.concatenate([b[i] for b in batches]) for i in range(3)))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector of the task searches the probed lists that the task holds, its own list first."""
        (_, centres), (group_of, first, parts) = shipped.value, routes.value
        kept, task = [], None
        for b in batches:
            if b.num_rows:
                task = b.column(0)[0].as_py()
                kept.append((floats(b.column(3)), np.asarray(b.column(2)), np.asarray(b.column(1))))
        if not kept:
            return
        c = gathered(kept)
        kept.clear()
        for own, (lo, hi) in c.span.items():
            for a in range(lo, hi, 2048):
                q = Queries(c.x[a : min(a + 2048, hi)], c.keys[a : min(a + 2048, hi)], k)
                every = np.arange(len(q.x))
                to = nearest_lists(q.x, centres, probes)
                q.scan(every, c, lo, hi)
                for d in np.unique(to):
                    if d != own and d in c.span:
                        q.scan(np.flatnonzero((to == d).any(1)), c, *c.span[d])
                visit = np.zeros((len(q.x), len(first)), bool)
                visit[every[:, None], group_of[to]] = True
                visit[:, group_of[own]] = parts[group_of[own]] > 1
                bound = q.worst(every)
                visit[bound >= DONE] = False
                row, g = np.nonzero(visit)
                row, dest = np.repeat(row, parts[g]), np.concatenate([np.arange(first[x], first[x] + parts[x]) for x in g]) if len(g) else np.zeros(0, np.int64)
                row, dest = row[dest != task], dest[dest != task]
                others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(q.x)))].astype(np.int32)), pa.array(dest.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.keys), pa.array([r.tobytes() for r in q.x], pa.binary()), pa.array(bound), pa.array([r.tobytes() for r in to], pa.binary()), others, q.near(every)],
                    names=["key", "vec", "bound", "probes", "others", "near"],
                )

    near = "near array<struct<score:float,other:bigint>>"
    at_home = cut(placed.repartitionById(tasks, "task").mapInArrow(home, f"key bigint, vec binary, bound float, probes binary, others array<int>, {near}"))
    held = placed.select("task", F.lit(0).alias("kind"), "list", "key", "vec", F.lit(None).cast("float").alias("bound"), F.lit(None).cast("binary").alias("probes"))
    asked = at_home.select(F.explode("others").alias("task"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("list"), "key", "vec", "bound", "probes")

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of other tasks search the lists of this one for what beats their bound."""
        kept: list[tuple] = []
        c = None
        for b in batches:
            kind = np.asarray(b.column(1))
            split = int(np.searchsorted(kind, 1))  # candidates come first
            if split:
                h = b.slice(0, split)
                kept.append((floats(h.column(4)), np.asarray(h.column(3)), np.asarray(h.column(2))))
            if split == b.num_rows:
                continue
            if c is None:
                if not kept:
                    return
                c = gathered(kept)
                kept.clear()
            for at in range(split, b.num_rows, 4096):
                h = b.slice(at, min(4096, b.num_rows - at))
                q = Queries(floats(h.column(4)), np.asarray(h.column(3)), k, np.asarray(h.column(5)).astype(np.float32))
                to = np.frombuffer(b"".join(h.column(6).to_pylist()), np.int32).reshape(h.num_rows, -1)
                order = np.argsort(to, axis=None, kind="stable")
                which = to.ravel()[order]
                cuts = np.flatnonzero(np.diff(which)) + 1
                for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(which)]):
                    if int(which[lo]) in c.span:
                        q.scan(order[lo:hi] // to.shape[1], c, *c.span[int(which[lo])])
                some = np.flatnonzero(q.top[:, 0] > -2)
                yield pa.RecordBatch.from_arrays([pa.array(q.keys[some]), q.near(some)], names=["key", "near"])

    met = held.unionByName(asked).repartitionById(tasks, "task").sortWithinPartitions("kind").mapInArrow(away, f"key bigint, {near}")
    both = at_home.select("key", "near").unionByName(met).groupBy("key").agg(F.flatten(F.collect_list("near")).alias("near"))
    return both.select("key", F.slice(F.sort_array("near", asc=False), 1, k).alias("near")), assigned.select("key", "id")


def _named(points: DataFrame, k: int, dim: int, least: float | None) -> DataFrame:
    out = ranked(points, k, dim)
    if out is None:
        return points.sparkSession.createDataFrame([], "id string, other_id string, score double, rank int")
    best, ids = out
    rows = best.select("key", F.posexplode("near").alias("_i", "_n")).select("key", (F.col("_i") + 1).alias("rank"), F.col("_n.score").cast("double").alias("score"), F.col("_n.other").alias("other"))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return rows.join(ids, "key").join(ids.select(F.col("key").alias("other"), F.col("id").alias("other_id")), "other").select("id", "other_id", "score", "rank")


def neighbors(points: DataFrame, k: int = K, dim: int = 64) -> DataFrame:
    """id, other_id, score (cosine), rank: the k most similar other ids of every usable id (see `usable`).

    1. About sqrt(n) lists by k-means (`fit_centres`); every vector is assigned to its nearest list and gets a 64-bit key. How many lists a
       vector must probe is measured in every run (`needed_probes`), so the recall does not depend on the size or shape of the data.
    2. Neighbouring lists form groups of about equal size, one task each. Every vector first searches the probed lists of its own group,
       nearest first, by an adaptive dimension scan with running top k.
    3. Then it visits, with its k-th best score as a bound, the other groups that hold lists it probes; what beats the bound comes back and is
       merged by key. A vector is shuffled once for each group it visits, at most as often as it probes lists; no pair is ever shuffled.

    A task holds at most twice GROUP_MOST vectors, however many copies of one vector there are: such a list is split
    by key, and a vector that has k copies of itself is finished and visits nothing. Accuracy: recall is measured in the README.
    Ties at rank k are broken arbitrarily but deterministically within a run. Empty tables and fewer than two usable vectors give no rows.
    """
    return _named(points, k, dim, None)


def similar_pairs(points: DataFrame, least: float = 0.9, k: int = K, dim: int = 64) -> DataFrame:
    """id_a < id_b, distinct, of all neighbours with a cosine of at least `least`. Code point order is the byte order of UTF-8."""
    n = _named(points, k, dim, least - 1e-7)
    return n.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def with_payload(found: DataFrame, points: DataFrame) -> DataFrame:
    """Adds file_path of the other id (one row per id, the greatest path)."""
    paths = points.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("other_id")).agg(F.max("file_path").alias("file_path"))
    return found.join(paths, "other_id", "left").select("id", "rank", "other_id", "file_path", "score")
