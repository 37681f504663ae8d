"""Extracted edges: validation, repeats, degree limits, and the batches that extractors work on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import calls
from cairn.functions.scalar import strip
from cairn.session import spread
from cairn.sources.frames import first_n, keep_first, numbered, numbered_over_all

BATCH, OVERLAP, MAX_OUT = 20, 5, 10


def validate(raw: DataFrame, terms: DataFrame, concepts: DataFrame, pids: DataFrame | None = None) -> DataFrame:
    """Edges with resolved ends that may enter the graph.

    Ends are trimmed and resolved through terms (term, canonical); a TESTS edge
    starts at a problem id as it is, which must be in pids if that has any. Ends
    must be concepts, differ after resolution, and SOLVES must start at an
    algorithm or a mechanism.
    """
    cols = set(raw.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in cols else F.lit("")
    e = raw.select(strip(F.col("source")).alias("source"), strip(F.col("target")).alias("target"), strip(F.col("type")).alias("type"), F.coalesce(F.nullif(text("description"), F.lit("")), text("reason")).alias("description"), F.nullif(text("dimensions"), F.lit("")).alias("dimensions"), strip(text("chapter")).alias("chapter"), "ord")
    e = e.where((F.col("source") != "") & (F.col("target") != "") & F.col("type").isin(*S.EDGE_TYPES))
    t = terms.select("term", "canonical")
    e = spread(e, "source").join(t.select(F.col("term").alias("source"), F.col("canonical").alias("cs")), "source", "left")
    e = spread(e, "target").join(t.select(F.col("term").alias("target"), F.col("canonical").alias("ct")), "target", "left")
    e = e.withColumn("from", F.when(F.col("type") == "TESTS", F.col("source")).otherwise(F.coalesce("cs", "source"))).withColumn("to", F.coalesce("ct", "target"))
    known = concepts.select("name", "node_role")
    e = e.join(known.select(F.col("name").alias("to")), "to", "left_semi")
    tests = e.where("type = 'TESTS'").withColumn("node_role", F.lit(None).cast("string"))
    if pids is not None:
        some = pids.select(F.col("pid").alias("from")).distinct()
        any_ = F.broadcast(some.agg((F.count("*") > 0).alias("any")))
        hit = some.withColumn("ok", F.lit(True))
        tests = tests.join(hit, "from", "left").crossJoin(any_).where(F.coalesce("ok", F.lit(False)) | ~F.col("any")).drop("ok", "any")
    others = e.where("type <> 'TESTS'").join(known.select(F.col("name").alias("from"), "node_role"), "from")
    others = others.where((F.col("type") != "SOLVES") | F.coalesce("node_role", F.lit(S.DEFAULT_ROLE)).isin(*S.SOLVES_ROLES))
    out = others.unionByName(tests).where(F.col("from") != F.col("to"))
    return out.select(F.col("from").alias("source"), F.col("to").alias("target"), "type", "description", F.when(F.col("type") == "CONFUSABLE", F.col("dimensions")).alias("dimensions"), F.when(F.col("type") == "PREREQUISITE", F.lit(False)).alias("reviewed"), "chapter", "ord")


def dedupe(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target, type); ends of undirected types in either order."""
    flip = F.col("type").isin(*S.UNDIRECTED)
    a, b = F.when(flip, F.least("source", "target")).otherwise(F.col("source")), F.when(flip, F.greatest("source", "target")).otherwise(F.col("target"))
    return keep_first(edges, [a, b, F.col("type")], ["ord"])


def is_weak(description=None):
    c = F.coalesce(F.col("description") if description is None else description, F.lit(""))
    return reduce(lambda x, y: x | y, [c.contains(k) for k in S.WEAK_SIGNALS])


def trim_out_degree(prereq: DataFrame, most: int = MAX_OUT) -> DataFrame:
    """At most `most` edges a source: strongly worded before weakly worded, then in order. Repeats use up the quota."""
    return first_n(prereq, ["source"], [is_weak().cast("int"), "ord"], most)


def chapter_batches(concepts: DataFrame, size: int = BATCH, overlap: int = OVERLAP) -> DataFrame:
    """(chapter, batch, pos, name): overlapping batches of each chapter's concepts in file order.

    Batch b holds places [b * stride, b * stride + size); the last one reaches the end.
    """
    stride = size - overlap
    n = numbered(concepts, ["chapter"], ["ord", "name"]).withColumn("i", F.col("_rn") - 1)
    count = concepts.groupBy("chapter").agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / stride)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("i") - size) / stride) + 1).cast("int")
    upto = F.least(F.floor(F.col("i") / stride).cast("int"), last)
    return n.join(count, "chapter").withColumn("batch", F.explode(F.sequence(first, upto))).select("chapter", "batch", (F.col("i") - F.col("batch") * stride).cast("int").alias("pos"), "name")


def batch_counts(batches: DataFrame) -> DataFrame:
    """(chapter, batches, concepts) of chapter_batches()."""
    return batches.groupBy("chapter").agg(F.count_distinct("batch").alias("batches"), F.count_distinct("name").alias("concepts"))


def hardest_by_chapter(concepts: DataFrame, most: int = 6) -> DataFrame:
    return first_n(concepts, ["chapter"], [F.desc("difficulty"), "ord", "name"], most)


def chapter_pairs(concepts: DataFrame, pairs: DataFrame, most: int = 25) -> DataFrame:
    """Candidate pairs of a chapter and one it depends on: the hardest `most` of each. pairs: (source_chapter, target_chapter)."""
    top = hardest_by_chapter(concepts, most).select("chapter", "name")
    known = concepts.select("chapter").distinct()
    ok = pairs.where("source_chapter <> target_chapter").distinct().join(known.select(F.col("chapter").alias("source_chapter")), "source_chapter", "left_semi").join(known.select(F.col("chapter").alias("target_chapter")), "target_chapter", "left_semi")
    return ok.join(top.select(F.col("chapter").alias("source_chapter"), F.col("name").alias("source")), "source_chapter").join(top.select(F.col("chapter").alias("target_chapter"), F.col("name").alias("target")), "target_chapter")


def problem_candidates(concepts: DataFrame, most: int = 80) -> DataFrame:
    """(chapter, rank, name): concepts offered for a chapter's problems, its own first, then the hardest of all.

    Only the hardest `most` of other chapters can be needed, and they are the same
    few for every chapter but for its own: so the fill-in is cut before it is joined.
    """
    own = numbered(concepts, ["chapter"], ["ord", "name"]).where(F.col("_rn") <= most).select("chapter", "name", F.lit(0).alias("g"), F.col("_rn").cast("long").alias("o"))
    size = concepts.groupBy("chapter").agg(F.count("*").alias("n"))
    # the hardest 2 * most hold at least `most` that are not of a chapter, unless its own fill the list
    per = first_n(concepts, ["chapter"], [F.desc("difficulty"), "ord", "name"], most).select(F.col("chapter").alias("of"), "name", "difficulty", "ord")
    pool = per.orderBy(F.desc("difficulty"), "ord", "name").limit(2 * most)
    fill = size.where(F.col("n") < most).join(F.broadcast(pool), F.col("chapter") != F.col("of"))
    fill = numbered(fill, ["chapter"], [F.desc("difficulty"), "ord", "name"]).select("chapter", "name", F.lit(1).alias("g"), F.col("_rn").cast("long").alias("o"))
    return numbered(own.unionByName(fill), ["chapter"], ["g", "o"], "rank").where(F.col("rank") <= most).select("chapter", F.col("rank").cast("int").alias("rank"), "name")


def strip_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("type") != kind)


def known_pairs(pairs: DataFrame, names: DataFrame, most: int = 30) -> DataFrame:
    """Pairs (source, target) with both ends in scope, the first `most` by name."""
    a, b = names.select(F.col("name").alias("source")), names.select(F.col("name").alias("target"))
    return pairs.join(a, "source", "left_semi").join(b, "target", "left_semi").select("source", "target").distinct().orderBy("source", "target").limit(most)


def rejected_pairs(report: DataFrame, least: float = 0.85, most: int = 50) -> DataFrame:
    """Similar pairs that a reviewer kept apart: candidates for CONFUSABLE edges."""
    return report.where(F.col("decision").isNotNull() & ~F.coalesce(F.col("decision.merge"), F.lit(False)) & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "name_a", "name_b").limit(most)


def validate_candidates(candidates: DataFrame, concepts: DataFrame, call: calls.Client | calls.Asker, size: int = 10) -> DataFrame:
    """PREREQUISITE edges (source, target, description) that a model approves, asked for `size` pairs at a time.

    candidates: (source, target, definition, ord). Definitions are cut to 50 and
    100 characters in a prompt. The answer is {"results": [{"is_prerequisite",
    "description"}, ...]} in the order of the pairs; a batch whose call fails or
    whose answer does not parse approves nothing, a short one nothing beyond its end.
    """
    known = concepts.select(F.col("name").alias("source"), F.substring(F.coalesce("definition", F.lit("")), 1, 50).alias("of"))
    c = numbered_over_all(candidates, ["ord", "source", "target"], "n").join(known, "source", "left")
    c = c.withColumns({"id": F.floor((F.col("n") - 1) / size), "place": ((F.col("n") - 1) % size).cast("int")})
    line = F.format_string("%d. A=%s（%s）→ B=%s\n   B 的定义：%s", F.col("place") + 1, "source", F.coalesce("of", F.lit("")), "target", F.substring(F.coalesce("definition", F.lit("")), 1, 100))
    lines = c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    prompts = lines.select("id", F.concat(F.lit('判断每一对中 A 是否为 B 的先修概念，按顺序返回 {"results": [{"is_prerequisite": true, "description": ""}]}。\n'), "lines").alias("prompt"))
    said = calls.parsed(calls.asking(call)(prompts), "results array<struct<is_prerequisite boolean, description string>>")
    said = said.select("id", F.posexplode("parsed.results").alias("place", "r")).where("r.is_prerequisite")
    return c.join(said, ["id", "place"]).select("source", "target", F.lit("PREREQUISITE").alias("type"), strip(F.coalesce("r.description", F.lit(""))).alias("description"))


def confusable(report: DataFrame, concepts: DataFrame, call: calls.Client | calls.Asker, least: float = 0.85, most: int = 50) -> DataFrame:
    """CONFUSABLE edges (source, target, type, dimensions, description) among similar pairs that were kept apart, a call a pair.

    The first `most` pairs are asked, those with an end that is no concept left
    out of them; a failed call makes no edge.
    """
    d = concepts.select("name", F.coalesce("definition", F.lit("")).alias("text"))
    pairs = rejected_pairs(report, least, most).select("name_a", "name_b").distinct()
    pairs = pairs.join(d.select(F.col("name").alias("name_a"), F.col("text").alias("text_a")), "name_a").join(d.select(F.col("name").alias("name_b"), F.col("text").alias("text_b")), "name_b")
    prompt = F.concat(F.lit('这两个概念是否容易混淆？返回 {"confusable": true, "dimensions": "", "description": ""}。\nA='), "name_a", F.lit("："), "text_a", F.lit("\nB="), "name_b", F.lit("："), "text_b")
    said = calls.parsed(calls.asking(call)(pairs.select(F.struct("name_a", "name_b").alias("id"), prompt.alias("prompt"))), "confusable boolean, dimensions string, description string")
    ok = said.where("parsed.confusable")
    return ok.select(F.col("id.name_a").alias("source"), F.col("id.name_b").alias("target"), F.lit("CONFUSABLE").alias("type"), F.coalesce("parsed.dimensions", F.lit("")).alias("dimensions"), F.coalesce("parsed.description", F.lit("")).alias("description"))
