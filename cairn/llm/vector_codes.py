"""Vector code compression: product codes with codebooks learned in whole numbers.

A vector's components become integers, the vector is cut into equal parts, and
each part position has a codebook. A round broadcasts one kd-tree a codebook,
finds each part's nearest entry in it, and sums the parts of an entry in 64-bit
integers, first in the task and then by a grouping of at most entries x
components rows; so a round's result does not depend on how rows are dealt, and
a lost executor's tasks give the same sums again.

The search goes down the tree with all rows of a batch at once. A box is left
out only if its distance is above the best one so far: boxes at just that
distance are entered, since an entry of a lower index may lie in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 8
#: Rows whose labels' sums are broadcast; more labels meet their rows by a join, each label in SALTS parts.
BROADCAST_BYTES, SALTS = 16 << 20, 64
FAR = np.iinfo(np.int64).max


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    index: np.ndarray | None = None
    points: np.ndarray | None = None
    left: Node | None = None
    right: Node | None = None

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the node's box."""
        out = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (out * out).sum(1)


def tree(points: np.ndarray, index: np.ndarray | None = None) -> Node:
    """A kd-tree over the entries of one codebook, cut at the median of the widest component."""
    index = np.arange(len(points)) if index is None else index
    here = points[index]
    node = Node(here.min(0), here.max(0))
    if len(index) <= LEAF:
        node.index = np.sort(index)
        node.points = points[node.index]
        return node
    order = index[np.argsort(here[:, (node.high - node.low).argmax()], kind="stable")]
    half = len(order) // 2
    node.left, node.right = tree(points, order[:half]), tree(points, order[half:])
    return node


def nearest(root: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each row's nearest entry; of equally near ones the lowest index."""
    code, best = np.full(len(x), FAR, np.int64), np.full(len(x), FAR, np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.points is not None:
            gap = x[rows, None, :] - node.points[None]
            d = (gap * gap).sum(2)
            at = d.argmin(1)
            d, at = d[np.arange(len(rows)), at], node.index[at]
            better = (d < best[rows]) | ((d == best[rows]) & (at < code[rows]))
            best[rows[better]], code[rows[better]] = d[better], at[better]
            return
        left, right = node.left.bound(x[rows]), node.right.bound(x[rows])
        first = left <= right
        for near, far, mine, gap in ((node.left, node.right, first, right), (node.right, node.left, ~first, left)):
            visit(near, rows[mine])
            visit(far, rows[mine][gap[mine] <= best[rows[mine]]])

    visit(root, np.arange(len(x)))
    return code, best


def whole(values: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x), held within the range in which a vector's distance fits 64 bits (2^27 at 64 components)."""
    most = 1 << ((62 - max(0, (dims - 1).bit_length())) // 2 - 1)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most - 1).astype(np.int64)


def _block(batch: pa.RecordBatch, dims: int, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have dims components, and those rows as (row, part, component), the last part filled with zeros."""
    col = batch.column(batch.schema.get_field_index("_vec"))
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    fit = lengths == dims
    if not fit.all():
        col = col.filter(pa.array(fit))
    x = np.zeros((int(fit.sum()), parts * width), np.int64)
    x[:, :dims] = whole(col.flatten().to_numpy(zero_copy_only=False), dims).reshape(len(x), dims)
    return fit, x.reshape(-1, parts, width)


@dataclass(frozen=True)
class Codebooks:
    dims: int
    books: np.ndarray  # part, entry, component

    def trees(self) -> list[Node]:
        return [tree(b) for b in self.books]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    finite = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).cast("array<double>").alias("_vec"))
    return rows.where(F.col("_vec").isNotNull() & finite)


def _start(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    ids = [r[0] for r in rows.where("_id is not null").select("_id").distinct().orderBy("_id").limit(entries).collect()]
    firsts = {r["_id"]: r["_vec"] for r in rows.where(F.col("_id").isin(ids)).groupBy("_id").agg(F.min("_vec").alias("_vec")).collect()} if ids else {}
    if not ids:
        return Codebooks(-1, np.zeros((parts, 0, 1), np.int64))
    dims = len(firsts[ids[0]])
    width = max(1, -(-dims // parts))
    have = [np.array(firsts[i], np.float64) for i in ids if len(firsts[i]) == dims]
    x = np.zeros((len(have), parts * width), np.int64)
    x[:, :dims] = whole(np.array(have).reshape(len(have), dims), dims)
    return Codebooks(dims, x.reshape(-1, parts, width).transpose(1, 0, 2).copy())


def _round(rows: DataFrame, now: Codebooks) -> Codebooks:
    """Assign all parts, then move each used entry to the floor of its parts' mean."""
    parts, entries, width = now.books.shape
    shared = rows.sparkSession.sparkContext.broadcast((now.dims, now.trees()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, trees = shared.value
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            _, x = _block(b, dims, width, parts)
            for p, t in enumerate(trees):
                code, _ = nearest(t, x[:, p])
                n[p] += np.bincount(code, minlength=entries)
                np.add.at(total[p], code, x[:, p])
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.record_batch([pa.array(part * entries + entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["slot", "n", "total"])

    met = rows.select("_vec").mapInArrow(sums, "slot int, n long, total array<long>").select("slot", "n", F.posexplode("total").alias("at", "v"))
    books = now.books.copy()
    for r in met.groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toLocalIterator():  # at most entries x components rows
        books[r["slot"] // entries, r["slot"] % entries, r["at"]] = r["v"] // r["n"]
    shared.unpersist()
    return Codebooks(now.dims, books)


def _assign(rows: DataFrame, now: Codebooks) -> DataFrame:
    parts, _, width = now.books.shape
    shared = rows.sparkSession.sparkContext.broadcast((now.dims, now.trees() if now.books.size else []))
    label = rows.schema["_label"].dataType
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, trees = shared.value
        for b in batches:
            code, error = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            fit = np.zeros(b.num_rows, bool)
            if trees:
                fit, x = _block(b, dims, width, parts)
                found = [nearest(t, x[:, p]) for p, t in enumerate(trees)]
                names = hexes[np.stack([c for c, _ in found], 1)]
                code[fit] = ["".join(r) for r in names.tolist()]
                error[fit] = sum(d for _, d in found)
            yield pa.record_batch([b.column("_id"), b.column("_label"), pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=~fit)], ["_id", "_label", "code", "error"])

    return rows.mapInArrow(codes, f"_id long, _label {label.simpleString()}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each kept vector's code, its error, the error summed over its label, and the digest of the codebooks.

    Rows whose vector is null or holds a null or non-finite component are dropped;
    all others come back once each. Codebooks start as the parts of the `entries`
    (at most 256) smallest distinct ids, or of all ids if there are fewer; of rows
    that repeat an id the smallest vector counts. A null id starts no entry.
    Vectors have as many components as that of the smallest id; where that is no
    multiple of `parts`, zeros follow (and appear in the digest). Vectors of
    another length, and all where no id can start a codebook, take no part and
    come back with a null code and error. Components are held within the range in
    which a vector's error fits 64 bits (about 2^27 / 256 at 64 components, beyond
    any usual embedding). label_error is null where a label has only null errors,
    or where the sum leaves 64 bits; null labels are one label. An empty table
    gives an empty one. Other columns than those named are left out, so that their
    names cannot clash.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = _kept(vectors, id_col, vec_col, label_col)
    books = _start(rows, parts, entries)
    for _ in range(rounds if books.books.size else 0):
        books = _round(rows, books)
    out = materialize(_assign(rows, books), "codes")
    sums = materialize(out.groupBy("_label").agg(F.try_sum("error").alias("label_error")).select(F.col("_label").alias("_label2"), "label_error"), "label_errors")
    octets = sums.agg(F.sum(F.coalesce(F.octet_length(F.col("_label2").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    same = F.col("_label").eqNullSafe(F.col("_label2"))
    if octets <= broadcast_bytes:
        out = out.join(F.broadcast(sums), same)
    else:
        out = out.withColumn("_salt", F.pmod(F.xxhash64("_id", "code"), F.lit(SALTS)).cast("int"))
        sums = sums.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.join(sums, same & (F.col("_salt") == F.col("_salt2")))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
