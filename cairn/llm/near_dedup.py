"""Near-duplicate documents by Order MinHash.

A document's k-mers are its five-word shingles (words are runs of letters, digits
and underscores, in lower case), each labelled with its occurrence. For each of SKETCHES hash functions, the KEPT k-mers with the
smallest hashes are sampled and kept in text order: two documents share a sketch
with a likelihood that falls with their edit distance. Documents that share a
sketch (and are of like length) are candidates.

Candidates are verified by aligning the shingle sequences in a band: similarity
is the length of the longest common subsequence over the length of the union,
and links from SIMILARITY on.

Groups of copies can be large, so the documents of a bucket are not all paired.

* A twin Bloom filter over the candidates' shingles tells which a document can
  share with any other. Two documents whose shareable shingles are too few for
  the similarity are no candidates: this drops copies that were edited too much,
  and long documents that only share a passage, without comparing them.
* One document of each bucket, the pivot, with the fewest shingles of its own, is
  aligned with each other one. This joins the bulk of a group in linear work. Rows
  of a large bucket, and the pairs of its pivot, meet it in several tasks.
* Only documents that are then in another class than their bucket's pivot are
  paired with documents of other classes. A similar pair whose common shingles
  include one that COMMON documents or fewer hold meets on such a shingle: on one
  of the rarest that each of them has, as many as the similarity requires, and
  where enough shingles are left behind it for the similarity. A pair
  that only has commoner shingles in common must have enough of these; it meets in
  its bucket. Pairs of one class need no comparison. So no class is lost, and the
  number of pairs does not grow with the square of a group's size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.bloom import bits_for, has, seen_twice
from cairn.llm.text import U64, column, constants, each, mix, ngrams, occurrence_labelled, octets, text_of, word_hashes
from cairn.operators.concepts import components
from cairn.session import bound_batches, materialize

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, KEPT = 16, 3
HASHES, BITS_PER_SHINGLE = 3, 8
#: Documents that hold a shingle, up to which they are paired by it.
COMMON = 64
#: A key that holds more than one in HOT of a table's rows is dealt over several parts.
HOT = 1024
WORD = re.compile(r"\w+")


def shingles(text: str) -> np.ndarray:
    """Occurrence-labelled hashes of the five-word shingles, in text order."""
    return occurrence_labelled(ngrams(word_hashes(WORD.findall(text.lower())), SHINGLE))


def sketches(s: np.ndarray) -> np.ndarray:
    """Order MinHash: for each hash function, the KEPT smallest k-mers, in text order."""
    k = min(KEPT, len(s))
    a = constants(SKETCHES, 101)
    h = mix(s[None, :] * a[:, None] + (a[:, None] >> U64(7)))
    at = np.argpartition(h, k - 1, axis=1)[:, :k] if len(s) > k else np.tile(np.arange(len(s)), (SKETCHES, 1))
    at.sort(axis=1)
    out = np.arange(SKETCHES, dtype=U64)
    for j in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + s[at[:, j]])
    return out


def bands(n: int) -> list[int]:
    """Length classes: documents whose lengths differ by up to the similarity share one."""
    b = floor(log(n) / -log(SIMILARITY) + 1e-9)
    return [b, b + 1]


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the longest common subsequence within the band reaches the similarity.

    Labels are distinct in each document, so the subsequence is the longest
    ascending run of matched places (sparse dynamic programming). The band holds
    every pair of places that an alignment of that similarity can use.
    """
    n, m = len(a), len(b)
    need = ceil(least * (n + m) / (1 + least) - 1e-9)  # lcs / (n + m - lcs) >= least
    if min(n, m) < need:
        return False
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    at[at == m] = 0
    place = order[at]
    hit = b[place] == a
    band = max(n, m) - need
    i = np.flatnonzero(hit & (np.abs(place - np.arange(n)) <= band))
    if len(i) < need:
        return False
    p = place[i]
    if (p[1:] > p[:-1]).all():
        return True
    tails: list[int] = []
    for x in p.tolist():
        t = bisect_left(tails, x)
        tails[t : t + 1] = [x]
    return len(tails) >= need


def _sketched(docs: DataFrame) -> DataFrame:
    """_id, hash of the text, digest of the sequence of what white space parts, shingles' number, bucket keys."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        with np.errstate(over="ignore"):
            for b in batches:
                digest, size, keys = [], [], []
                for t in each(b, "_text"):
                    digest.append(xxhash.xxh3_128_digest(b" ".join(t.encode().split())))
                    s = shingles(t)
                    size.append(len(s))
                    keys.append(np.concatenate([mix(sketches(s) ^ U64(c + 1)) for c in bands(len(s))]).view(np.int64) if len(s) else [])
                yield pa.record_batch([b.column("_id"), b.column("_h"), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_h", "digest", "n", "keys"])

    return docs.mapInArrow(go, "_id long, _h long, digest binary, n int, keys array<long>")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align each pair; the pairs that link."""
    last, s = None, None
    with np.errstate(over="ignore"):
        for b in batches:
            ok, pivot = [], b.column("ta")
            for i, (p, xt) in enumerate(zip(column(b, "a"), each(b, "tb"), strict=True)):
                if p != last:
                    last, s = p, shingles(pivot[i].as_py())
                ok.append(aligned(shingles(xt), s))
            mask = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def _cut(many: DataFrame, key: str) -> DataFrame:
    """(key, cuts): into how many parts keys with over a HOT-th of the rows go; fewer than HOT rows, 2 * HOT parts in all."""
    most = max(1, many.count() // HOT)
    return F.broadcast(many.groupBy(key).agg(F.count("*").alias("k")).where(F.col("k") > most).select(key, F.ceil(F.col("k") / most).alias("cuts")))


def _meet(many: DataFrame, one: DataFrame, key: str, by: str, cuts: DataFrame) -> DataFrame:
    """many joined with the row of its key; a hot key's rows are dealt by the column by, and its one row goes to each part."""
    parts = F.coalesce("cuts", F.lit(1))
    dealt = many.join(cuts, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts)).drop("cuts")
    copied = one.join(cuts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("cuts")
    return dealt.join(copied, [key, "part"]).drop("part")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link. A pivot's many pairs meet its text in several tasks."""
    cuts = _cut(pairs, "a")
    with_b = pairs.join(texts.select(F.col("_id").alias("b"), F.col("text").alias("tb")), "b")
    both = _meet(with_b, texts.select(F.col("_id").alias("a"), F.col("text").alias("ta")), "a", "b", cuts).select("a", "b", "ta", "tb")
    return materialize(both.mapInArrow(_verify, "a long, b long"), "links")


def _shared_filter(texts: DataFrame):
    """A broadcast filter of the shingles that two candidates may have."""
    bits = bits_for(octets(texts) // 7, BITS_PER_SHINGLE)

    def sightings(batch: pa.RecordBatch) -> np.ndarray:
        got = [shingles(t) for t in each(batch, "text")]
        return np.concatenate(got) if got else np.zeros(0, U64)

    return texts.sparkSession.sparkContext.broadcast(seen_twice(texts.select("text"), sightings, bits, HASHES))


def _shareable(texts: DataFrame, shared) -> DataFrame:
    """(x, n, c): each candidate's shingles, and how many of them another candidate may have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                s = [shingles(t) for t in each(b, "text")]
                c = [int(has(shared.value, x, HASHES).sum()) for x in s]
                yield pa.record_batch([b.column("_id"), pa.array([len(x) for x in s], pa.int32()), pa.array(c, pa.int32())], ["x", "n", "c"])

    return texts.select("_id", "text").mapInArrow(count, "x long, n int, c int")


def _rare(texts: DataFrame, docs: DataFrame, shared) -> DataFrame:
    """(x, n, class, odd, c, h, prefix) for docs (x, n, class, odd).

    c: shingles that another of docs has; h: those that more than COMMON have;
    prefix: the rarer ones among the first, rarest first, of which two similar
    documents must have one in common unless all they share is common.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                s = [shingles(t) for t in each(b, "text")]
                s = [x[has(shared.value, x, HASHES)].view(np.int64) for x in s]
                yield pa.record_batch([*[b.column(i) for i in range(4)], pa.array(s, pa.list_(pa.int64()))], ["x", "n", "class", "odd", "s"])

    held = materialize(docs.join(texts, F.col("x") == F.col("_id")).select("x", "n", "class", "odd", "text").mapInArrow(go, "x long, n int, class long, odd boolean, s array<long>"), "shingles")
    single = held.select("x", F.explode("s").alias("s"))
    many = single.groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    per = single.join(many, "s").groupBy("x").agg(F.count("*").alias("c"), F.count_if(F.col("k") > COMMON).alias("h"), F.array_sort(F.collect_list(F.when(F.col("k") <= COMMON, F.struct("k", "s")))).alias("rare"))
    # shingles that no other document has come first of all, and take up places
    length = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-6) + 1 - (F.col("n") - F.col("c"))
    prefix = F.transform(F.slice("rare", F.lit(1), F.greatest(length, F.lit(0)).cast("int")), lambda r: r["s"])
    return held.drop("s").join(per, "x").select("x", "n", "class", "odd", "c", "h", prefix.alias("prefix"))


def _feasible(n1: str, c1: str, n2: str, c2: str):
    """Whether two documents have enough shareable shingles: what is shared is at most the fewer of them."""
    need = (F.col(n1) + F.col(n2)) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    return F.least(F.col(c1), F.col(c2)) >= need


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near duplicates of every document: id_col, class_id, n_links.

    class_id is the smallest id of the class; two documents are in one class if a
    chain of links joins them. Documents that are equal but for white space are
    exact copies and always in one class, empty and null texts too; texts of under
    five words have no shingle and only exact copies. n_links is the number of other
    word sequences that the document's own was aligned with and is similar to,
    enough of them to join the class. One row for each id: rows that repeat an id
    count once, by the text with the smallest hash; rows with a null id are left
    out. An empty table gives an empty one; other columns, whatever they are
    called, are not read. Whole texts are compared, however long.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    light = materialize(_sketched(rows), "sketches")
    once = light.groupBy("_id").agg(F.min(F.struct("_h", "digest")).alias("m")).select("_id", "m._h", "m.digest")
    one = light.join(once.select("_id", "_h"), ["_id", "_h"], "left_semi")
    first = one.groupBy("digest").agg(F.min(F.struct("_id", "_h")).alias("r"), F.first("n").alias("n"), F.first("keys").alias("keys")).select("digest", F.col("r._id").alias("rep"), "r._h", "n", "keys")
    reps = materialize(first, "reps")
    member = once.join(reps.select("digest", "rep"), "digest").select("_id", "rep")

    # one row a bucket and document; buckets of one are dropped before anything else is done
    entries = reps.select(F.explode("keys").alias("key"), F.col("rep").alias("x"))
    many = entries.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    entries = materialize(_meet(entries, many, "key", "x", _cut(entries, "key")), "buckets")
    # the texts of candidates are fetched once
    wanted = reps.join(entries.select(F.col("x").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("_id"), "_h")
    source = rows.join(wanted, ["_id", "_h"], "left_semi")
    texts = materialize(source.groupBy("_id").agg(F.min("_text").alias("text")), "texts")
    # the shortest partner has SIMILARITY times the shingles, so as many must be shareable
    shared = _shared_filter(texts)
    sizes = materialize(_shareable(texts, shared).where(F.col("c") >= F.col("n") * SIMILARITY - 1e-6), "sizes")
    entries = materialize(entries.join(sizes, "x"), "buckets")
    cuts = _cut(entries, "key")

    # one row a bucket of two documents or more
    pivot = entries.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct((F.col("n") - F.col("c")).alias("own"), F.col("x").alias("id"), "n", "c")).alias("p")).where("k > 1")
    pivot = materialize(pivot.select("key", F.col("p.id").alias("a"), F.col("p.n").alias("na"), F.col("p.c").alias("ca")), "pivots")
    star = _meet(entries, pivot, "key", "x", cuts).where((F.col("x") != F.col("a")) & _feasible("n", "c", "na", "ca")).select("a", F.col("x").alias("b")).distinct()
    star = materialize(star, "pairs")
    links = _links(star, texts)
    label = _classes(links)

    # documents in another class than their bucket's pivot, and the others of such buckets
    main = pivot.join(label.select(F.col("_id").alias("a"), F.col("class").alias("main")), "a", "left").select("key", F.coalesce("main", "a").alias("main"))
    known = _meet(entries, main, "key", "x", cuts).join(label.withColumnRenamed("_id", "x"), "x", "left").withColumn("class", F.coalesce("class", "x"))
    known = materialize(known.select("key", "x", "n", "class", (F.col("class") != F.col("main")).alias("odd")), "known")
    split = _meet(known, known.where("odd").select("key").distinct(), "key", "x", cuts)
    apart = _rare(texts, split.groupBy("x").agg(F.first("n").alias("n"), F.first("class").alias("class"), F.max("odd").alias("odd")), shared)
    apart = materialize(apart, "apart")
    shared.unpersist()  # no later step reads it: executors need not keep it

    def side(df: DataFrame, tag: str, *more: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}{tag}") for c in ("x", "n", "class", "odd", "c", "h", *more)])

    # places count from the rarest on: the first shingle that two documents share leaves no more to share than what follows it in either
    by_rare = apart.select("*", F.posexplode("prefix").alias("at", "s")).withColumn("left", F.col("c") - F.col("at"))
    meet = (F.col("s1") == F.col("s2")) & (F.col("class1") != F.col("class2")) & _feasible("n1", "left1", "n2", "left2")
    # a pair of two odd ones meets once
    rest = side(by_rare.where("odd"), "1", "s", "left").join(side(by_rare, "2", "s", "left"), meet & (~F.col("odd2") | (F.col("x1") < F.col("x2")))).select("x1", "x2")
    # a pair that shares several buckets meets in the one with the smallest key
    keyed = split.groupBy("x").agg(F.collect_set("key").alias("keys")).join(apart.where(F.col("h") >= F.col("n") * SIMILARITY - 1e-6), "x")
    by_key = keyed.withColumn("key", F.explode("keys"))
    meet = (F.col("key1") == F.col("key2")) & (F.col("class1") != F.col("class2")) & _feasible("n1", "h1", "n2", "h2") & (F.array_min(F.array_intersect("keys1", "keys2")) == F.col("key1"))
    rest = rest.unionByName(side(by_key.where("odd"), "1", "key", "keys").join(side(by_key, "2", "key", "keys"), meet & (~F.col("odd2") | (F.col("x1") < F.col("x2")))).select("x1", "x2"))
    rest = rest.select(F.col("x1").alias("a"), F.col("x2").alias("b")).distinct()
    rest = rest.join(star.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti").join(star, ["a", "b"], "left_anti")
    rest = materialize(rest, "pairs")
    links = materialize(links.unionByName(_links(rest, texts)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    nodes = reps.select(F.col("rep").alias("_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count("*").alias("n_links"))
    classes = nodes.join(_classes(links), "_id", "left").select("_id", F.coalesce("class", "_id").alias("class"))
    found = classes.join(degree, "_id", "left").select(F.col("_id").alias("rep"), "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return member.join(found, "rep").select(F.col("_id").alias(id_col), F.col("class").alias("class_id"), "n_links")


def _classes(links: DataFrame) -> DataFrame:
    """(_id, class) of the documents that have a link."""
    found = components(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links)
    return found.select(F.col("id").alias("_id"), F.col("component").alias("class"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each class, with all its columns.

    Rows that repeat an id stay once, by the text with the smallest hash. Rows
    with a null id belong to no class and stay.
    """
    stay = near_duplicates(docs, id_col, text_col).where(F.col("class_id") == F.col(id_col)).select(F.col(id_col).alias("_stay"))
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(stay, named[id_col] == F.col("_stay"), "left_semi")
    # where ids do not repeat, the order is over single rows
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_of(text_col)), F.xxhash64(*docs.columns)))
    kept = kept.withColumn("_turn", turn).where(F.col("_turn") == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
