"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

The canonical form of a text is its compatibility composition (NFKC), case
folded, with runs of white space as one blank and none at the ends. Two lanes of
xxhash64 over it make a 128-bit digest. Rows of equal digests are grouped and
their canonical texts compared byte by byte; texts that differ in spite of equal
digests get numbered ones. A text is also compared byte by byte with its edited
form and with the next text.

An exact digest says equal or not. The fingerprint also carries SKETCH smallest
xxhash64 values of the canonical text's three-word shingles, from which the
likeness of two unequal texts is read; unequal texts never reach 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.text import let, text_of
from cairn.session import materialize

SKETCH, SHINGLE = 24, 3
#: Rows of an ordered bucket that next_text aims at.
BUCKET_ROWS = 2000
#: Ranges at most: their bounds come to the driver. Larger tables have larger ranges, which the window spills.
MAX_BUCKETS = 8192


def canonical(c: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space folded. ICU is on Spark's own class path."""

    def compose(x: Column) -> Column:
        return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = compose(F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(c), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\u0085\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """Two lanes of 64 bits as 32 hex digits."""

    def lane(n: int) -> Column:
        return F.lpad(F.hex(F.xxhash64(F.lit(n), canon)), 16, "0")

    return F.lower(F.concat(lane(1), lane(2)))


def sketch(canon: Column) -> Column:
    """The smallest distinct hashes of shingles, ascending; of the words if there are too few for one shingle."""

    def of(ws: Column) -> Column:
        return F.when(
            F.size(ws) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(ws) - SHINGLE), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)])),
        ).otherwise(F.transform(ws, lambda w: F.xxhash64(w)))

    return F.slice(F.array_sort(F.array_distinct(let(F.split(canon, " "), of))), 1, SKETCH)


def likeness(d1: Column, s1: Column, d2: Column, s2: Column) -> Column:
    """1 for equal digests, else the share of the joint smallest hashes that both sketches hold, under 1."""
    joint = F.slice(F.array_sort(F.array_union(s1, s2)), 1, SKETCH)
    both = F.size(F.array_intersect(joint, F.array_intersect(s1, s2)))
    return F.when(d1 == d2, F.lit(1.0)).otherwise(F.least(both / F.greatest(F.size(joint), F.lit(1)), F.lit(1 - 1 / (2 * SKETCH))))


def fingerprint_of(d: Column, s: Column) -> Column:
    return F.concat_ws(":", d, F.array_join(F.transform(s, lambda h: F.lower(F.hex(h))), "."))


def next_text(rows: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """Add the text of the next row by id; the last row gets the first row's.

    Rows are dealt into ranges of ids of about BUCKET_ROWS rows; each range also
    gets a copy of the next range's first row. So the order is global, yet no
    task sees more than a range. Rows that repeat an id are ordered by text; rows
    without an id come first.
    """
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    n = rows.count()
    parts = min(MAX_BUCKETS, max(1, n // BUCKET_ROWS))
    cuts = []
    if parts > 1:
        cuts = sorted(set(rows.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]))
    placed = rows.withColumn("_bucket", _search(cuts, key) if cuts else F.lit(0)).withColumn("_key", key)
    # the first id of each bucket, which the bucket before gets a copy of: a row a bucket
    firsts = sorted((r["_bucket"], r["k"]) for r in placed.groupBy("_bucket").agg(F.min("_key").alias("k")).collect())
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]  # the first bucket's goes to the end of the last
    guests = F.broadcast(rows.sparkSession.createDataFrame(before, "_first long, _to int"))
    spread = F.filter(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("guest"))), lambda x: x["b"].isNotNull())
    dealt = placed.join(guests, F.col("_key") == F.col("_first"), "left").withColumn("_at", F.explode(spread)).withColumn("_guest", F.col("_at.guest")).withColumn("_bucket", F.col("_at.b"))
    w = Window.partitionBy("_bucket").orderBy("_guest", "_key", text_col)
    return dealt.withColumn(out, F.lead(text_col).over(w)).where(~F.col("_guest")).select(*rows.columns, out)


def _search(cuts: list[int], key: Column) -> Column:
    """How many of the ascending cuts are not above the key, by halving; each step is bound once, so the expression stays small."""
    bounds, n = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), len(cuts)

    def step(at: Column, size: int) -> Column:
        if not size:
            return at
        new = at + size
        up = F.when((new <= n) & (F.get(bounds, F.least(new, F.lit(n)) - 1) <= key), new).otherwise(at)
        return let(up, lambda x: step(x, size // 2))

    return step(F.lit(0), 1 << (n.bit_length() - 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, canonical text and digest of every row, by hash alone. A null text is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return rows.withColumn("_canon", canonical(F.col("_text"))).withColumn("_digest", digest(F.col("_canon")))


def clashes(rows: DataFrame) -> DataFrame:
    """(_digest, _canon, _number) of unequal canonical texts with equal digests, numbered in byte order from 1; rows as fingerprints() has them.

    A bucket is sound if the set of its texts has one: partial aggregation brings
    a group of copies, however large, to one row a task, with one text in it. Only
    where a bucket is unsound are its texts fetched.
    """
    buckets = rows.groupBy("_digest").agg(F.collect_set("_canon").alias("texts"))
    unsound = materialize(buckets.where("size(texts) > 1").select("_digest"), "unsound")
    if unsound.isEmpty():
        return rows.sparkSession.createDataFrame([], "_digest string, _canon string, _number int")
    texts = rows.select("_digest", "_canon").join(unsound, "_digest", "left_semi").distinct()
    return materialize(texts.withColumn("_number", F.row_number().over(Window.partitionBy("_digest").orderBy(F.col("_canon").cast("binary")))), "clashes")


def numbered(rows: DataFrame, clash: DataFrame, digest_col: str, canon_col: str) -> DataFrame:
    """rows with the number added to the digests of clashing texts."""
    c = clash.select(F.col("_digest").alias("_d"), F.col("_canon").alias("_c"), F.col("_number").alias("_n"))
    joined = rows.join(c, (F.col(digest_col) == F.col("_d")) & (F.col(canon_col) == F.col("_c")), "left")
    return joined.withColumn(digest_col, F.when(F.col("_n").isNull(), F.col(digest_col)).otherwise(F.concat(digest_col, F.lit("-"), F.col("_n").cast("string")))).select(*rows.columns)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, digest, the smallest id with the same canonical text, the group's rows.

    Digests tell texts apart to the byte (clashes()). Null and empty texts form one
    group; a null id is larger than any other. Repeated rows give equal rows, an
    empty table an empty one.
    """
    rows = fingerprints(docs, id_col, text_col)
    rows = numbered(rows, clashes(rows), "_digest", "_canon").select("_id", "_digest")
    groups = rows.groupBy("_digest").agg(F.count("*").alias("group_rows"), F.min("_id").alias("group_id"))
    return rows.join(groups, "_digest").select(F.col("_id").alias(id_col), F.col("_digest").alias("digest"), "group_id", "group_rows")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike they are.

    The edited form has the last floor(n/4) code points replaced by the first as
    many of the next document's. Returns id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next; one row for each
    input row, null texts as empty ones. Texts of any length are read whole; an
    empty table gives an empty one; other columns, whatever they are called, are
    not read.
    """
    clash = clashes(fingerprints(docs, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    rows = next_text(rows, "_id", "_text", "_next")
    n, q = F.char_length("_text"), F.floor(F.char_length("_text") / 4).cast("int")
    rows = rows.select("_id", "_text", "_next", n.alias("n"), F.concat(F.substring("_text", F.lit(1), n - q), F.substring("_next", F.lit(1), q)).alias("_edited"))
    rows = rows.select("_id", "n", F.sha2("_edited", 256).alias("sha"), *[canonical(F.col(c)).alias(f"c{k}") for k, c in (("0", "_text"), ("1", "_edited"), ("2", "_next"))])
    # each canonical text is looked at once for its digest and its sketch
    if not clash.isEmpty():
        for k in "012":
            rows = numbered(rows.withColumn(f"d{k}", digest(F.col(f"c{k}"))), clash, f"d{k}", f"c{k}")
    rows = rows.select("_id", "n", "sha", *[(F.col(f"d{k}") if f"d{k}" in rows.columns else digest(F.col(f"c{k}"))).alias(f"d{k}") for k in "012"], *[sketch(F.col(f"c{k}")).alias(f"s{k}") for k in "012"], *[(F.col("c0") == F.col(f"c{k}")).alias(f"same{k}") for k in "12"])

    def near(k: str) -> Column:
        # bytes decide inside an equal bucket
        return F.when(F.col(f"same{k}"), F.lit(1.0)).otherwise(F.least(likeness(F.col("d0"), F.col("s0"), F.col(f"d{k}"), F.col(f"s{k}")), F.lit(1 - 1 / (2 * SKETCH))))

    return rows.select(
        F.col("_id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        fingerprint_of(F.col("d0"), F.col("s0")).alias("fingerprint"),
        fingerprint_of(F.col("d1"), F.col("s1")).alias("edited_fingerprint"),
        near("1").alias("near_edited"),
        near("2").alias("near_next"),
    )
