"""JSON arrays of objects, read by many tasks and written by many.

Reading. The text source cuts a file at every closing brace, within byte ranges
that tasks read by themselves. Whether a brace is one of the structure depends on
what stands before it, so a range is first summed up without knowing: for a start
inside a string and for one outside, in which of the two states it ends and how
the depth of nesting changes. The summaries, one small row a range, are composed
in file order; then each task knows where it starts and cuts its range into
objects. Only an object that lies over the edge of ranges is put together by a
grouping. `ord` is an object's place in its file.

Writing. Rows are dealt into ranges of `ord`, and a range's task writes its
objects with commas between; the first part opens the bracket and the last closes
it. The parts in the order of their names are one array, and read_array() takes
the folder as it takes a file. join_parts() makes one file of them for programs
that want one, by the file system's own joining or by copying stream to stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import materialize
from cairn.sources.frames import numbered_over_all

#: Rows of one part that a writer aims at.
PART_ROWS = 200_000
BRACE = "}"


class NotAnArray(ValueError):
    """The text is no JSON array of objects."""


def walk(text: str, inside: bool) -> tuple[bool, int]:
    """(inside a string at the end, change of depth) over a piece of text that starts inside a string or not."""
    depth, at, n = 0, 0, len(text)
    while at < n:
        if inside:
            quote, back = text.find('"', at), text.find("\\", at)
            if 0 <= back < quote or (quote < 0 <= back):
                at = back + 2
            elif quote < 0:
                return True, depth
            else:
                inside, at = False, quote + 1
        else:
            quote = text.find('"', at)
            stop = n if quote < 0 else quote
            depth += text.count("{", at, stop) + text.count("[", at, stop) - text.count("}", at, stop) - text.count("]", at, stop)
            if quote < 0:
                return False, depth
            inside, at = True, quote + 1
    return inside, depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, lo, text): what stands between closing braces, in order within a range."""
    raw = spark.read.option("lineSep", BRACE).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("lo"), F.col("value").alias("text"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a range: its pieces but the last with their braces, and the last without."""
    now, out = None, []

    def close() -> None:
        if now is not None:
            file, lo, states, last = now
            tail = [walk(last, s) for s, _ in states]
            out.append((file, lo, *[x for pair in states for x in pair], *[x for (s, d), (_, before) in zip(tail, states, strict=True) for x in (s, before + d)]))

    for b in batches:
        for file, lo, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if now is None or (file, lo) != now[:2]:
                close()
                now = (file, lo, [(False, 0), (True, 0)], text)
                continue
            states = []
            for s, d in now[2]:
                s, more = walk(now[3] + BRACE, s)
                states.append((s, d + more))
            now = (file, lo, states, text)
    close()
    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 10, [pa.string(), pa.int64(), *[pa.bool_(), pa.int64()] * 4], strict=True)], [c.split()[0] for c in SUMS.split(", ")])


SUMS = "file string, lo long, out0 boolean, d0 long, out1 boolean, d1 long, end0 boolean, e0 long, end1 boolean, e1 long"


def _starts(sums: list) -> dict[tuple[str, int], tuple[int, bool, int, bool]]:
    """(place, inside a string, depth, whether it is the last of its file) of each range, from the ranges in file order."""
    out, inside, depth = {}, False, 0
    for at, r in enumerate(sums):
        last = at + 1 == len(sums) or sums[at + 1]["file"] != r["file"]
        out[(r["file"], r["lo"])] = (at, inside, depth, last)
        inside, change = (r["end1"], r["e1"]) if inside else (r["end0"], r["e0"])
        # the piece that ends a range ended with a brace, but for the last of a file
        depth += change - (0 if last or inside else 1)
    if inside or depth:
        raise NotAnArray("the text ends within a value")
    return out


def _cutter(starts: dict[tuple[str, int], tuple[int, bool, int, bool]]):
    """Cuts ranges at the ends of objects: (at, g, text, done), a row a group of pieces that end one object, `done` where the end lies in the range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = pending = None
        at = depth = g = 0
        inside = False
        held: list[str] = []
        rows: list[tuple[int, int, str, bool]] = []

        def step(piece: str, brace: bool = True) -> None:
            nonlocal inside, depth, held, g
            piece = piece + BRACE if brace else piece
            inside, change = walk(piece, inside)
            depth += change
            held.append(piece)
            if brace and depth == 1 and not inside:
                rows.append((at, g, "".join(held), True))
                held, g = [], g + 1

        def close() -> None:
            if where is not None:
                step(pending, not starts[where][3])
                if held:
                    rows.append((at, g, "".join(held), False))

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, CUT_TYPES, strict=True)], ["at", "g", "text", "done"])
            rows.clear()
            return out

        for b in batches:
            for file, lo, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, lo) != where:
                    close()
                    where = (file, lo)
                    at, inside, depth, _ = starts[where]
                    g, held = 0, []
                else:
                    step(pending)
                pending = text
                if len(rows) >= 5000:
                    yield flush()
        close()
        yield flush()

    return cut


CUTS = "at int, g long, text string, done boolean"
CUT_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.bool_()]


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): each object of the array at path (a file, or a folder of parts in the order of their names) as text.

    Raises NotAnArray where braces, brackets and quotes do not make one array whose
    elements are objects.
    """
    pieces = _pieces(spark, path)
    sums = sorted(pieces.mapInArrow(_summed, SUMS).collect(), key=lambda r: (r["file"], r["lo"]))  # a row a range
    if not sums:
        raise NotAnArray("the text is empty")
    rows = materialize(pieces.mapInArrow(_cutter(_starts(sums)), CUTS), "objects")
    ended = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.count_if("done").alias("n")).collect()}
    before, total = [], 0
    for at in range(len(sums)):
        before.append((at, total))
        total += ended.get(at, 0)
    rows = rows.join(F.broadcast(spark.createDataFrame(before, "at int, before long")), "at").withColumn("ord", F.col("before") + F.col("g"))
    alone = F.col("done") & (F.col("g") > 0)
    over = rows.where(~alone).groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("text"))
    every = rows.where(alone).select("ord", "text").unionByName(over)
    # an object's text has what parts it from the one before; after the last object, the bracket closes
    before_it = F.regexp_extract("text", r"(?s)^(\s*[\[,]\s*)\{", 1)
    right = F.when(F.col("ord") == total, F.col("text").rlike(r"(?s)^\s*\]\s*$") if total else F.col("text").rlike(r"(?s)^\s*\[\s*\]\s*$")).otherwise(F.trim(F.translate(before_it, "\n\r\t", "   ")) == F.when(F.col("ord") == 0, "[").otherwise(","))
    every = materialize(every.select("ord", right.alias("right"), F.expr("substring(text, length(regexp_extract(text, '(?s)^(\\\\s*[\\\\[,]\\\\s*)', 1)) + 1)").alias("value")), "elements")
    if not every.where("NOT right").isEmpty() or every.where(F.col("ord") == total).isEmpty():
        raise NotAnArray("the elements are not all objects")
    return every.where(F.col("ord") < total).select("ord", "value")


def read_array(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """The objects of a JSON array with their `ord`. With missing_ok a missing or broken file, or one that is no such array, is empty; else it is an error."""
    from cairn.sources.files import exists

    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("ord", T.LongType())]))
    if missing_ok and not exists(spark, path):
        return empty
    try:
        found = objects(spark, path)
    except NotAnArray:
        if missing_ok:
            return empty
        raise
    if missing_ok and not found.where(F.try_parse_json("value").isNull()).isEmpty():
        return empty
    rows = found.select("ord", F.from_json("value", schema, {"mode": "PERMISSIVE" if missing_ok else "FAILFAST"}).alias("r"))
    return rows.select("r.*", "ord")


def write_array(df: DataFrame, path: str, indent: int | None = 2) -> None:
    """Write rows as one JSON array in parts, in `ord` order where there is one, else in the order they come; all fields but ord, nulls too.

    path may be what df was read from. An empty table is an empty array.
    """
    fields = [c for c in df.columns if c != "ord"]
    order = ["ord"] if "ord" in df.columns else ["_at"]
    rows = df if "ord" in df.columns else materialize(df.withColumn("_at", F.monotonically_increasing_id()), "rows")
    rows = numbered_over_all(rows, order, "_n")
    total = rows.count()
    spark = df.sparkSession
    if not total:
        spark.range(1).select(F.lit("[]").alias("value")).write.mode("overwrite").text(path)
        return
    text = rows.select("_n", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("o")).repartitionByRange(-(-total // PART_ROWS), "_n").sortWithinPartitions("_n")

    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = "" if indent is None else " " * indent
        for b in batches:
            out = []
            for n, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                o = pad + json.dumps(json.loads(o), ensure_ascii=False, indent=indent).replace("\n", "\n" + pad)
                out.append(("[\n" if n == 1 else "") + o + ("," if n < total else "\n]"))
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])

    text.mapInArrow(dump, "value string").write.mode("overwrite").text(path)


def join_parts(spark: SparkSession, folder: str, file: str) -> None:
    """One file from the parts of a folder, copied stream to stream: for programs that do not read folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(file)
    fs = source.getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = target.getFileSystem(conf).create(target, True)
    try:
        for p in parts:
            stream = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    finally:
        out.close()
