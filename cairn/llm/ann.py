"""Nearest neighbours from balanced posting lists.

Centroids are fitted on a bounded sample by balanced k-means in two levels: cells,
and lists within a cell. Every vector goes to the list of its nearest centroid
and, near a boundary, to that of a further one whose distance is within the
index's spread of the nearest. A query searches a graph over the centroids, which
every task holds, and takes the lists whose centroid is no farther than a ratio
times the nearest one, and further lists in the order of their centroids'
distance until they hold enough vectors for a whole answer. Spread and ratio are
calibrated on the sample: the spread copies at most COPIED of the vectors, the
ratio is the smallest that finds RECALL of the sample's true neighbours. Inside
the lists the search is exact.

Largest inner products become smallest distances by one more component that
lifts every vector to the longest vector's norm; queries are scaled to it, which
leaves their order of candidates as it is. The index takes that norm as 1.

Lists lie in shards of about SHARD_ROWS vectors, neighbouring lists together. A
query goes to a shard once, with the lists that it looks into there, and one row
of its best candidates comes back from each shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.text import column, let
from cairn.session import materialize

#: What is learned from at most: bytes of sample vectors (4 a component; 262,144 vectors of 64) and sample queries for the ratio.
SAMPLE_BYTES, SAMPLE_QUERIES = 64 << 20, 300
#: Vectors that a list should hold, and sample vectors that a centroid needs: with these the sample bounds the number of lists.
LIST_ROWS, LIST_SAMPLE = 16, 16
#: Lists that hold a vector at most, and the share of vectors that more than one may hold.
COPIES, COPIED = 2, 0.75
RECALL = 0.95
#: Ratios are to the distance of this place among the nearest centroids: the nearest of all is often near by chance.
BASE = 12
#: Links that each centroid has to its nearest ones.
NEIGHBOURS = 16
#: Cells whose lists a vector is compared with.
CELLS = 8
#: Vectors of a shard, and queries that meet one at once.
SHARD_ROWS, SHARD_QUERIES = 8192, 16384
K = 20


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector of the rows that take part: not null, not zero, all components finite."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull())
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("_v", lambda x: x != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1), 1e-300)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclass
class Index:
    centroids: np.ndarray  # in lifted space, on the unit sphere; lists of a cell stand together
    cells: np.ndarray  # the cells' centres
    first: np.ndarray  # each cell's first list, and one past the last
    longest: float
    graph: np.ndarray | None = None  # neighbours of each centroid, a row each
    spread: float = 1.0
    ratio: float = 1.0
    homes: np.ndarray | None = None  # ids whose nearest centroid each is: every vector counts once
    shard: np.ndarray | None = None  # the first shard of each list
    parts: np.ndarray | None = None  # shards that a list is cut into

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.c_[x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))]

    def ask(self, x: np.ndarray) -> np.ndarray:
        return np.c_[_unit(x), np.zeros(len(x))]

    def distances(self, q: np.ndarray, lists) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.centroids[lists] @ q)))

    def base(self, d: np.ndarray) -> float:
        at = min(BASE, len(d)) - 1
        return float(np.partition(d, at)[at])

    def search(self, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Search of the centroid graph from the nearest cell's lists: centroids and their distances, nearest first.

        Centroids farther than `ratio` times the nearest so far are not walked on from.
        """
        n = len(self.centroids)
        cell = int((self.cells @ q).argmax())
        at = np.arange(self.first[cell], self.first[cell + 1])
        d = np.full(n, np.inf)
        d[at] = self.distances(q, at)
        grown = np.zeros(n, bool)
        while True:
            todo = np.flatnonzero(~grown & (d <= ratio * self.base(d) + 1e-12))
            if not len(todo):
                break
            grown[todo] = True
            near = np.zeros(n, bool)
            near[self.graph[todo].ravel()] = True
            new = np.flatnonzero(near & np.isinf(d))
            d[new] = self.distances(q, new)
        found = np.flatnonzero(np.isfinite(d))
        order = found[np.argsort(d[found], kind="stable")]
        return order, d[order]

    def nearest(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, lists) of the COPIES nearest centroids of lifted vectors, among the lists of their nearest cells."""
        k = min(COPIES, len(self.centroids))
        inner, lists = np.full((len(y), k), -np.inf), np.zeros((len(y), k), np.int64)
        cells = min(CELLS, len(self.cells))
        near = np.argpartition(-(y @ self.cells.T), cells - 1, axis=1)[:, :cells]
        for c in range(len(self.cells)):
            rows = np.flatnonzero((near == c).any(1))
            lo, hi = self.first[c], self.first[c + 1]
            if not len(rows):
                continue
            s = np.c_[inner[rows], y[rows] @ self.centroids[lo:hi].T]
            at = np.c_[lists[rows], np.repeat(np.arange(lo, hi)[None], len(rows), 0)]
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            inner[rows], lists[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
        return np.sqrt(np.maximum(0.0, 2 - 2 * inner)), lists

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each vector: the nearest, and another near a boundary."""
        out = []
        for i in range(0, len(x), 4096):
            d, lists = self.nearest(self.lift(x[i : i + 4096]))
            in_reach = d <= self.spread * d[:, :1] + 1e-12
            in_reach[:, 0] = True
            in_reach &= np.isfinite(d)
            out += [at[ok] for at, ok in zip(lists, in_reach, strict=True)]
        return out

    def probes(self, x: np.ndarray, k: int = K) -> list[np.ndarray]:
        """The lists that each query looks into, by distance ratio.

        Where the lists' own vectors are not more than k (the query may be one of
        them), the next nearest lists are added until they are, or all are taken.
        """
        out = []
        for q in self.ask(x):
            best, d = self.search(q, self.ratio)
            best = best[d <= self.ratio * self.base(d) + 1e-12]
            if self.homes is not None and (have := self.homes[best].sum()) <= k:
                # the graph may not reach every centroid: the rest is put in order by distance itself
                rest = np.setdiff1d(np.arange(len(self.centroids)), best)
                rest = rest[np.argsort(self.distances(q, rest), kind="stable")]
                more = np.searchsorted(have + np.cumsum(self.homes[rest]), k, side="right") + 1
                best = np.r_[best, rest[:more]]
            out.append(best)
        return out


def _centroids(x: np.ndarray, k: int, seed: int = 3, rounds: int = 6) -> np.ndarray:
    """k-means whose assignment is charged for full clusters, so that lists stay balanced."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    if k == len(x):
        return c
    load = np.zeros(k)
    for _ in range(rounds):
        at, fee = [], 0.0
        for i in range(0, len(x), 4096):
            y = x[i : i + 4096]
            d = (y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)[None, :]
            fee = fee or np.median(np.maximum(d.min(1), 1e-12)) * 0.5
            at.append((d + fee * (load / (len(x) / k))[None, :]).argmin(1))
        at = np.concatenate(at)
        n = np.bincount(at, minlength=k)
        load = 0.5 * load + 0.5 * n
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return c


def build(x: np.ndarray, lists: int, longest: float, k: int = K) -> Index:
    """Centroids, graph, spread and ratio from sample vectors."""
    index = Index(x[:0], x[:0], np.zeros(0, int), longest)
    y = index.lift(x).astype(np.float32)
    cells = max(1, round(lists**0.5))
    centres = _unit(_centroids(y, cells))
    home = np.concatenate([(y[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(y), 4096)])
    n = np.bincount(home, minlength=cells)
    centres, home = centres[n > 0], np.searchsorted(np.flatnonzero(n), home)
    n = n[n > 0]
    made = [_centroids(y[home == c], min(int(m), max(1, round(lists * m / len(y)))), seed=c) for c, m in enumerate(n)]
    index.cells, index.first = centres.astype(float), np.r_[0, np.cumsum([len(m) for m in made])]
    index.centroids = _unit(np.concatenate(made).astype(float))
    c = index.centroids
    links = min(NEIGHBOURS, len(c) - 1)
    near = np.concatenate([np.argsort(-(c[i : i + 1024] @ c.T), axis=1, kind="stable")[:, : links + 1] for i in range(0, len(c), 1024)]) if links else np.zeros((len(c), 1), int)
    # a ring through all cells as well, so that the graph has no dead ends
    index.graph = np.c_[near, np.roll(np.arange(len(c)), 1), np.roll(np.arange(len(c)), -1)]
    d = np.concatenate([index.nearest(index.lift(x[i : i + 4096]))[0] for i in range(0, len(x), 4096)])
    if d.shape[1] > 1:
        index.spread = float(np.quantile(d[:, 1] / np.maximum(d[:, 0], 1e-9), COPIED))
    index.ratio = _ratio(index, x, k)
    return index


def _ratio(index: Index, x: np.ndarray, k: int) -> float:
    """The smallest ratio at which the sample's queries find RECALL of their true neighbours in the sample."""
    if len(index.centroids) == 1:
        return 1.0
    homes = index.lists_of(x)
    # neighbours of the whole table are nearer than those of a sample: the ratio found here errs to the safe side
    q = x[:: max(1, len(x) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q)) * max(1, len(x) // SAMPLE_QUERIES)] = -np.inf
    top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
    need = []
    for i, v in enumerate(index.ask(q)):
        d = index.distances(v, slice(None))
        d = d / max(index.base(d), 1e-9)
        need += [d[homes[j]].min() for j in top[i] if s[i, j] > -np.inf]
    return float(np.quantile(need, RECALL)) if need else 1.0


def norm(v: Column) -> Column:
    """Euclidean norm, through the largest component, so that squares of very long vectors stay finite."""

    def of(most: Column) -> Column:
        return most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + (c / most) * (c / most)))

    return let(F.array_max(F.transform(v, F.abs)), of)


def fit(rows: DataFrame, k: int = K) -> Index | None:
    """An index from a sample of SAMPLE_BYTES at most, of rows (_id, _v, _norm).

    Half of the sample are rows whose id's hash falls under its share, half the
    longest vectors: these are in most answers, however few they are.
    """
    stat = rows.agg(F.count("*").alias("n"), F.max("_norm").alias("longest"), F.max(F.size("_v")).alias("width")).first()
    if not stat["n"]:
        return None
    n, most = stat["n"], max(64, SAMPLE_BYTES // (4 * stat["width"]))
    drawn = rows
    if n > most:
        long_ = rows.agg(F.percentile_approx("_norm", 1 - most / (2 * n), 100_000)).first()[0]
        drawn = rows.where((F.pmod(F.xxhash64(F.lit("ann"), "_id"), F.lit(n)) < most // 2) | (F.col("_norm") > long_))
    got = drawn.select("_id", F.transform("_v", lambda c: (c / F.lit(stat["longest"])).cast("float")).alias("_v")).toArrow().sort_by("_id")
    x = got.column("_v").combine_chunks().flatten().to_numpy().reshape(-1, stat["width"]).astype(float) * stat["longest"]
    return build(x, max(1, min(n // LIST_ROWS, len(x) // LIST_SAMPLE)), float(stat["longest"]), k)


def _meet(ls: pa.Table, qs: pa.Table, k: int) -> pa.Table:
    """The k best candidates of each query in one shard: a row a query, best first.

    Products of lists and the queries that look into them are matrix products;
    what comes near the k best is scored again in a fixed order of addition, so
    that a pair has one score wherever it meets.
    """
    x, q = _vectors(ls), _vectors(qs)
    member = ls.column("list").to_numpy()
    order = np.argsort(member, kind="stable")
    lists, first = np.unique(member[order], return_index=True)
    past = np.r_[first[1:], len(order)]
    asks = qs.column("lists").combine_chunks()
    asked, by = asks.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(asks.offsets.to_numpy()))
    by = by[np.argsort(asked, kind="stable")]
    asked = np.sort(asked, kind="stable")
    # a vector may lie in COPIES lists of the shard; a few places more for products that differ in their last digits
    places = min(COPIES * (k + 1) + 6, COPIES * len(x))
    best, where = np.full((len(q), places), -np.inf), np.zeros((len(q), places), np.int64)
    for c, lo, hi in zip(lists, first, past, strict=True):
        a, b = np.searchsorted(asked, [c, c + 1])
        if a == b:
            continue
        mine, rows = by[a:b], order[lo:hi]
        for i in range(0, len(rows), 1024):
            part = rows[i : i + 1024]
            for j in range(0, len(mine), 1024):
                who = mine[j : j + 1024]
                s = np.c_[best[who], q[who] @ x[part].T]
                w = np.c_[where[who], np.repeat(part[None], len(who), 0)]
                top = np.argpartition(-s, places - 1, axis=1)[:, :places]
                best[who], where[who] = np.take_along_axis(s, top, 1), np.take_along_axis(w, top, 1)
    score = np.zeros(best.shape)
    for j in range(x.shape[1]):
        score += q[:, j, None] * x[where, j]
    who, place = np.nonzero(best > -np.inf)
    ids = ls.column("ids").combine_chunks()
    start, n = ids.offsets.to_numpy(), np.diff(ids.offsets.to_numpy())
    vector = where[who, place]
    many = n[vector]
    flat = ids.flatten().to_numpy()[np.repeat(start[vector] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    who, minus = np.repeat(who, many), np.repeat(-score[who, place], many)
    keep = flat != qs.column("_id").to_numpy()[who]
    who, minus, flat = who[keep], minus[keep], flat[keep]
    order = np.lexsort((flat, minus, who))
    who, minus, flat = who[order], minus[order], flat[order]
    new = np.r_[True, (who[1:] != who[:-1]) | (flat[1:] != flat[:-1])] if len(who) else np.zeros(0, bool)
    who, minus, flat = who[new], minus[new], flat[new]
    have = np.bincount(who, minlength=len(q))
    rank = np.arange(len(who)) - np.repeat(np.cumsum(have) - have, have)
    who, minus, flat = who[rank < k], minus[rank < k], flat[rank < k]
    have = np.bincount(who, minlength=len(q))
    top = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(have)], pa.int32()), pa.StructArray.from_arrays([pa.array(minus), pa.array(flat, pa.int64())], ["minus", "vec_id"]))
    return pa.table([qs.column("_id"), top], ["query_id", "top"])


def _vectors(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("_v").to_pylist()), float).reshape(t.num_rows, -1)


FOUND = "query_id long, top array<struct<minus: double, vec_id: long>>"


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """The k vectors with the largest inner product for each row whose id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score (in double precision, on the
    original vectors). Candidates are all rows but those with the query's own id;
    fewer than k rows come back only where there are fewer of them. Equal scores
    rank the smaller id first. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those of another length than the
    commonest, which have no inner product with it. Rows that repeat an id count
    once, by the vector with the largest hash. Rows with equal vectors are one
    vector of the index, with the k + 1 smallest of their ids: no larger one can
    be in an answer. An empty table gives an empty result; other columns, whatever
    they are called, are not read. Every vector is in at least one list; only
    which lists a query looks into is approximate.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    width = rows.groupBy(F.size("_v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1)
    rows = rows.join(F.broadcast(width.select("w")), F.size("_v") == F.col("w"), "left_semi")
    rows = materialize(rows.groupBy("_id").agg(F.max_by("_v", F.xxhash64("_v")).alias("_v")), "vectors")
    # the window keeps k + 1 rows of a vector in each task before it meets the others
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_v").orderBy("_id"))).where(F.col("_r") <= k + 1)
    distinct = few.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    distinct = materialize(distinct.select(F.get("ids", 0).alias("_id"), "_v", "ids", norm(F.col("_v")).alias("_norm")), "distinct")
    index = fit(distinct, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(column(b, "_v"), float)
            at = bare.value.lists_of(x)
            row = np.repeat(np.arange(len(x)), list(map(len, at)))
            home = np.concatenate([np.arange(len(a)) == 0 for a in at])
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.record_batch([pa.array(np.concatenate(at), pa.int32()), pa.array(home), b.column("ids").take(pa.array(row)), raw.take(pa.array(row))], ["list", "home", "ids", "_v"])

    bare = spark.sparkContext.broadcast(index)
    lists = materialize(distinct.mapInArrow(post, "list int, home boolean, ids array<long>, _v binary"), "lists")
    # two numbers a list; the sample bounds the number of lists
    n, homes = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids), np.int64)
    for r in lists.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.when(F.col("home"), F.size("ids"))).alias("homes")).collect():
        n[r["list"]], homes[r["list"]] = r["n"], r["homes"] or 0
    index.homes = homes
    index.parts = np.maximum(1, -(-n // SHARD_ROWS))
    # long lists have shards of their own; the others share one with their neighbours
    alone = index.parts > 1
    group = np.cumsum(np.where(alone, 0, n)) // SHARD_ROWS
    new = np.r_[True, (group[1:] != group[:-1]) | alone[1:] | alone[:-1]]
    index.shard = (np.cumsum(np.where(new, np.r_[0, index.parts[:-1]], 0)))[np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))]
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a query and shard: the lists there that it looks into."""
        for b in batches:
            if not b.num_rows:
                continue
            ix = shared.value
            x = np.array(column(b, "_v"), float)
            shard, row, ask = [], [], []
            for i, ls in enumerate(ix.probes(x, k)):
                ls = np.repeat(ls, ix.parts[ls])
                part = np.arange(len(ls)) - np.maximum.accumulate(np.where(np.r_[True, ls[1:] != ls[:-1]], np.arange(len(ls)), 0))
                s = ix.shard[ls] + part
                order = np.argsort(s, kind="stable")
                cut = np.flatnonzero(np.r_[True, s[order][1:] != s[order][:-1]])
                shard += s[order][cut].tolist()
                ask += np.split(ls[order], cut[1:])
                row += [i] * len(cut)
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.record_batch([pa.array(shard, pa.int32()), b.column("_id").take(pa.array(row)), raw.take(pa.array(row)), pa.array(ask, pa.list_(pa.int32()))], ["shard", "_id", "_v", "lists"])

    asked = materialize(rows.where(F.pmod("_id", F.lit(every)) == 0).mapInArrow(deal, "shard int, _id long, _v binary, lists array<int>"), "asked")
    # a shard that very many queries ask is met by a part of them at a time
    asks = asked.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_QUERIES).cast("int").alias("asks"))
    place = F.broadcast(spark.createDataFrame(list(zip(range(len(n)), index.shard.tolist(), index.parts.tolist(), strict=True)), "list int, first int, parts int"))
    left = lists.join(place, "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("_v"), F.col("parts")).cast("int"))
    left = left.join(asks, "shard").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("shard", "a", "list", "ids", "_v")
    right = asked.join(asks, "shard").withColumn("a", F.pmod(F.xxhash64("_id"), F.col("asks")).cast("int")).select("shard", "a", "_id", "_v", "lists")

    def meet(ls: pa.Table, qs: pa.Table) -> pa.Table:
        if not ls.num_rows or not qs.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "top": pa.array([], pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())])))})
        return _meet(ls, qs, k)

    found = left.groupBy("shard", "a").cogroup(right.groupBy("shard", "a")).applyInArrow(lambda a, b: meet(a, b), FOUND)
    # a row a shard with k places each: what meets here grows with the shards that a query looks into, not with the table's rows
    top = found.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("top"))).alias("top"))
    once = F.filter("top", lambda e, i: (i == 0) | (e != F.get("top", i - 1)))
    ranked = top.select("query_id", F.posexplode(F.slice(once, 1, k)).alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.minus") + 0.0).alias("score"))


def recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K, most: int = 200) -> float:
    """Share of the true neighbours that `found` has, by brute force for at most `most` queries."""
    rows = valid(vectors, id_col, vec_col)
    asked = rows.where(F.pmod("_id", F.lit(every)) == 0).orderBy(F.xxhash64("_id")).limit(most).toPandas()
    q, ids = np.array(asked["_v"].tolist(), float), asked["_id"].to_numpy()

    def best(batches):
        for b in batches:
            cand, x = np.array(column(b, "_id")), np.array(column(b, "_v"), float)
            if not len(cand):
                continue
            s = q @ x.T
            s[ids[:, None] == cand[None, :]] = -np.inf
            for i, row in zip(ids, s, strict=True):
                at = np.argsort(-row, kind="stable")[:k]
                yield pa.record_batch([pa.array(np.full(len(at), i), pa.int64()), pa.array(cand[at], pa.int64()), pa.array(row[at])], ["query_id", "vec_id", "score"])

    all_ = rows.mapInArrow(best, "query_id long, vec_id long, score double").where(F.col("score") > float("-inf"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = all_.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "vec_id")
    return true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / max(1, true.count())
