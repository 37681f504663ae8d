"""From pages to concepts, problems and edges: what a model is asked, and what of its answers enters the graph.

Each extractor makes a table of prompts, has them answered (functions/calls.py:
concurrent, in order, resumable with a log) and reads the answers with a schema;
an answer that fails or does not parse gives nothing. The two drivers chain the
extractors with validation, merging and trimming. Prompts are this library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import calls
from cairn.functions import scalar as X
from cairn.operators import concepts as C
from cairn.operators import edges as E
from cairn.operators import retrieval as R
from cairn.session import materialize
from cairn.sources import json_files as J

Call = calls.Client | calls.Asker

CONCEPT_TASK = '列出下文（{}）值得建立节点的概念，返回 {{"concepts": [{{"name", "definition", "node_role", "difficulty", "aliases", "preemptive", "starvation_free", "complexity", "scenario"}}]}}。'
PROBLEM_TASK = '列出下文（{}）的全部习题，题号从 {}_Q1 起，返回 {{"problems": [{{"pid", "stem", "answer", "type", "chapter"}}]}}。'
STRUCT_TASK = '下文（{}）说明了所列概念之间的哪些关系（PART_OF、SOLVES、RELATED）？返回 {{"edges": [{{"source", "target", "type", "description"}}]}}。'
DEPENDS_TASK = '下列各章之间有哪些先修关系？返回 {"chapter_deps": [{"prereq_chapter", "target_chapter", "reason"}]}。'
INTRA_TASK = '本章（{}）下列概念之间有哪些先修关系？返回 {{"edges": [{{"source", "target", "type", "description"}}]}}。'
PAIR_TASK = '目标章「{}」的概念直接依赖先修章「{}」的哪些概念？返回 {{"edges": [{{"source", "target", "type", "description"}}]}}。'
TESTS_TASK = '习题（{}）直接考查所列概念中的哪些（至多五个）？返回 {{"tests": [{{"concept", "description"}}]}}。'
CONCEPTS = "concepts array<struct<name string, definition string, node_role string, difficulty string, aliases array<string>, preemptive boolean, starvation_free boolean, complexity string, scenario string>>"
PROBLEMS = "problems array<struct<pid string, stem string, answer string, type string, chapter string>>"
EDGES = "edges array<struct<source string, target string, type string, description string, dimensions string>>"
DEPENDS = "chapter_deps array<struct<prereq_chapter string, target_chapter string>>"
TESTS = "tests array<struct<concept string, description string>>"

#: Steps in the order in which their edges enter: the first of repeats stays.
STEPS = ("STRUCT", "INTRA", "PAIR", "SCAN", "TESTS", "CONFUSABLE")


def _say(template: str, *parts: Column) -> Column:
    return F.format_string(template.replace("%", "%%").replace("{{", "{").replace("}}", "}").replace("{}", "%s"), *parts)


def _ask(rows: DataFrame, ident: Column, prompt: Column, call: Call, schema: str, field: str) -> DataFrame:
    """(id, at, x): the items of every answer. rows are written once, since prompts are asked once."""
    asked = materialize(rows.select(ident.alias("id"), prompt.alias("prompt")), "prompts")
    said = calls.parsed(calls.asking(call)(asked), schema)
    return materialize(said.select("id", F.posexplode(f"parsed.{field}").alias("at", "x")), "answers").where("x is not null")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _lines(of: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(of).alias("l")))), lambda x: x["l"]), "\n")


# extractors --------------------------------------------------------------


def concepts_from_chunks(chunks: DataFrame, call: Call) -> DataFrame:
    """Validated concepts of each chunk with its chapter, in order. chunks: (chapter, text, ord)."""
    got = _ask(chunks, F.struct("ord", "chapter"), F.concat(_say(CONCEPT_TASK, _text("chapter")), F.lit("\n"), _text("text")), call, CONCEPTS, "concepts")
    return C.validate(got.select("x.*", F.col("id.chapter").alias("chapter"), F.struct(F.col("id.ord").alias("a"), F.col("at").alias("b")).alias("ord")))


def problems_from_chapters(chapters: DataFrame, call: Call) -> DataFrame:
    """(pid, stem, answer, type, chapter, ord) of each chapter's exercises that have a stem. chapters: (chapter, prefix, exercises, ord); without exercises none is asked."""
    some = chapters.where(X.strip(F.col("exercises")) != "")
    got = _ask(some, F.struct("ord", "chapter"), F.concat(_say(PROBLEM_TASK, _text("chapter"), _text("prefix")), F.lit("\n"), F.col("exercises")), call, PROBLEMS, "problems")
    return C.with_stem(got.select("x.*", F.struct(F.col("id.ord").alias("a"), F.col("at").alias("b")).alias("ord")))


def struct_edges(chunks: DataFrame, terms: DataFrame, call: Call, most: int = 60) -> DataFrame:
    """Raw PART_OF, SOLVES and RELATED edges that chunks speak of. A chunk that mentions fewer than two concepts is not asked about.

    chunks: (chapter, text, ord), ord unlike for all; terms: (term, canonical, kind, ord, at).
    """
    texts = chunks.where(X.strip(_text("text")) != "").select(F.col("ord").alias("id"), "text")
    named = R.relevant_concepts(texts, terms, most).withColumn("m", -F.col("n"))
    lists = named.groupBy("id").agg(F.count("*").alias("k"), _lines("canonical", "m", "canonical").alias("names")).where("k >= 2")
    rows = chunks.join(lists, chunks["ord"] == lists["id"]).select("ord", "chapter", "names", "text")
    prompt = F.concat(_say(STRUCT_TASK, _text("chapter")), F.lit("\n概念：\n"), F.col("names"), F.lit("\n原文：\n"), F.col("text"))
    return _edges(_ask(rows, F.struct("ord", "chapter"), prompt, call, EDGES, "edges"), F.col("id.chapter"), "STRUCT")


def chapter_dependencies(concepts: DataFrame, call: Call, most: int = 6) -> DataFrame:
    """(source_chapter, target_chapter) between known, unlike chapters, from one call over the hardest of each. No chapter, no call."""
    top = E.hardest_by_chapter(concepts.where("chapter <> ''"), most).withColumns({"h": -F.col("difficulty"), "line": F.concat(F.lit("  - "), "name", F.lit("："), F.substring(_text("definition"), 1, 50))})
    each = top.groupBy("chapter").agg(_lines("line", "h", "ord").alias("lines"))
    # one prompt by nature: a line or six a chapter
    one = each.select("chapter", F.concat(F.lit("【"), "chapter", F.lit("】\n"), "lines").alias("part")).agg(_lines("part", "chapter").alias("lines"), F.count("*").alias("n")).where("n > 0")
    got = _ask(one, F.lit(0), F.concat(F.lit(DEPENDS_TASK + "\n"), "lines"), call, DEPENDS, "chapter_deps")
    known = concepts.select("chapter").where("chapter <> ''").distinct()
    pairs = got.select(F.col("x.prereq_chapter").alias("source_chapter"), F.col("x.target_chapter").alias("target_chapter")).where("source_chapter <> target_chapter").distinct()
    return pairs.join(known.withColumnRenamed("chapter", "source_chapter"), "source_chapter", "left_semi").join(known.withColumnRenamed("chapter", "target_chapter"), "target_chapter", "left_semi")


def _with_known(lists: DataFrame, members: DataFrame, partof: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """lists with `known`: the first PART_OF pairs between members (keys, name) of each list."""
    a, b = members.select(*keys, F.col("name").alias("source")), members.select(*keys, F.col("name").alias("target"))
    pairs = partof.select("source", "target").distinct().join(a, "source").join(b, [*keys, "target"])
    known = pairs.groupBy(*keys).agg(F.array_sort(F.collect_set(F.concat(F.lit("  "), "source", F.lit(" → "), "target"))).alias("p"))
    return lists.join(known.select(*keys, F.concat(F.lit("已知 PART_OF，请跳过：\n"), F.array_join(F.slice("p", 1, most), "\n"), F.lit("\n")).alias("known")), keys, "left").withColumn("known", F.coalesce("known", F.lit("")))


def prerequisites_in_batches(concepts: DataFrame, partof: DataFrame, call: Call) -> DataFrame:
    """Raw PREREQUISITE edges within chapters, asked for overlapping batches of a chapter's concepts, hardest first. Batches of one are not asked."""
    hard = concepts.where("chapter <> ''").withColumn("ord", F.struct((-F.coalesce("difficulty", F.lit(1))).alias("h"), F.col("ord").alias("o")))
    batches = E.chapter_batches(hard).join(concepts.select("name", "node_role", "difficulty", F.substring(_text("definition"), 1, 100).alias("of")), "name")
    batches = materialize(batches, "batches")
    line = F.format_string("- %s（%s，难度%d）：%s", "name", F.coalesce("node_role", F.lit("概念")), F.coalesce("difficulty", F.lit(1)), "of")
    lists = batches.withColumn("line", line).groupBy("chapter", "batch").agg(_lines("line", "pos").alias("lines"), F.count("*").alias("n")).where("n >= 2")
    rows = _with_known(lists, batches.select("chapter", "batch", "name"), partof, ["chapter", "batch"])
    prompt = F.concat(_say(INTRA_TASK, F.col("chapter")), F.lit("\n"), "known", "lines")
    return _edges(_ask(rows, F.struct("chapter", "batch"), prompt, call, EDGES, "edges"), F.col("id.chapter"), "INTRA")


def prerequisites_between_chapters(concepts: DataFrame, pairs: DataFrame, partof: DataFrame, call: Call, most: int = 25) -> DataFrame:
    """Raw PREREQUISITE edges from a chapter to one that depends on it, a call a pair over the hardest of both. pairs: (source_chapter, target_chapter)."""
    top = E.hardest_by_chapter(concepts, most).withColumns({"h": -F.col("difficulty"), "line": F.concat(F.lit("- "), "name", F.lit("（"), F.coalesce("node_role", F.lit("概念")), F.lit("）："), F.substring(_text("definition"), 1, 80))})
    lists = top.groupBy("chapter").agg(_lines("line", "h", "ord").alias("lines"))
    keys = ["source_chapter", "target_chapter"]
    rows = pairs.join(lists.select(F.col("chapter").alias(keys[0]), F.col("lines").alias("from")), keys[0]).join(lists.select(F.col("chapter").alias(keys[1]), F.col("lines").alias("to")), keys[1])
    ends = pairs.select(*keys, F.explode(F.array_distinct(F.array(*keys))).alias("chapter"))
    rows = _with_known(rows, ends.join(top.select("chapter", "name"), "chapter").select(*keys, "name"), partof, keys)
    prompt = F.concat(_say(PAIR_TASK, F.col(keys[1]), F.col(keys[0])), F.lit("\n"), "known", F.lit("先修章：\n"), "from", F.lit("\n目标章：\n"), "to")
    return _edges(_ask(rows, F.struct(*keys), prompt, call, EDGES, "edges"), F.concat_ws("→", "id.source_chapter", "id.target_chapter"), "PAIR")


def tests_edges(problems: DataFrame, concepts: DataFrame, call: Call, most: int = 80) -> DataFrame:
    """Raw TESTS edges, a call a problem with a pid and a stem, over its chapter's candidates. problems: (pid, stem, chapter, ord)."""
    p = problems.select(X.strip(F.col("pid")).alias("pid"), X.strip(F.col("stem")).alias("stem"), _text("chapter").alias("chapter"), "ord").where("pid <> '' and stem <> ''")
    known = concepts.withColumn("chapter", _text("chapter"))
    own = E.problem_candidates(known, most)
    # problems of a chapter that no concept is in choose from the hardest of all
    fill = known.orderBy(F.desc("difficulty"), "ord", "name").limit(most).select("name", (-F.col("difficulty")).alias("h"), "ord")
    lists = own.groupBy("chapter").agg(_lines("name", "rank").alias("names"))
    rest = fill.agg(_lines("name", "h", "ord").alias("any"))
    rows = p.join(F.broadcast(lists) if lists.count() <= 1000 else lists, "chapter", "left").crossJoin(F.broadcast(rest)).withColumn("names", F.coalesce("names", "any"))
    prompt = F.concat(_say(TESTS_TASK, F.col("pid")), F.lit("\n概念：\n"), F.col("names"), F.lit("\n题干：\n"), F.col("stem"))
    got = _ask(rows, F.struct("ord", "pid", "chapter"), prompt, call, TESTS, "tests").where(X.strip(F.col("x.concept")) != "")
    x = F.struct(F.col("id.pid").alias("source"), X.strip(F.col("x.concept")).alias("target"), F.lit("TESTS").alias("type"), X.strip(F.coalesce("x.description", F.lit(""))).alias("description"), F.lit(None).cast("string").alias("dimensions"))
    return _edges(got.withColumn("x", x), F.col("id.chapter"), "TESTS")


def _edges(got: DataFrame, chapter: Column, step: str) -> DataFrame:
    """Raw edges of one step with an order among all steps' edges: step, prompt, place in the answer."""
    ident = F.to_json("id") if dict(got.dtypes)["id"].startswith("struct") else F.col("id").cast("string")
    return got.select("x.source", "x.target", "x.type", "x.description", "x.dimensions", chapter.alias("chapter"), _order(step, ident, F.col("at")))


def _order(step: str, ident: Column, at: Column) -> Column:
    return F.struct(F.lit(STEPS.index(step)).alias("step"), ident.alias("prompt"), at.cast("long").alias("at")).alias("ord")


# drivers -----------------------------------------------------------------


def page_chapters(pages: DataFrame, chapter_name: str | None = None, only: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(source, number, chapter, prefix, body, exercises, ord): pages by chapter, or all as one chapter of the given name.

    pages: (source, page, text). `only` keeps chapters by number, where they are
    found by their headings; first and last are pages.
    """
    p = pages if first is None and last is None else R.page_range(pages, first or 1, last or (1 << 31) - 1)
    if chapter_name is None:
        c = R.chapters(p)
        c = c.where(F.col("number").isin(*only)) if only else c
        c = c.withColumn("chapter", F.concat_ws(".", F.col("number").cast("string"), "title"))
    else:
        clean = p.withColumn("text", X.clean_page(F.col("text")))
        c = clean.groupBy("source").agg(_lines("text", "page").alias("text")).select("source", F.lit(None).cast("int").alias("number"), F.lit(chapter_name).alias("chapter"), "text")
    cut = c.withColumn("x", X.split_exercises(F.col("text")))
    return cut.select("source", "number", "chapter", X.pid_prefix(F.col("chapter"), F.col("number")).alias("prefix"), "x.body", "x.exercises", F.struct("source", F.coalesce("number", F.lit(0)).alias("number")).alias("ord"))


def extract_candidates(chapters: DataFrame, call: Call, existing: dict[str, DataFrame] | None = None, most: int = 3000) -> dict[str, DataFrame]:
    """Candidate concepts, problems and chunks of chapters (page_chapters()), merged into what there is.

    existing: tables of those names as this function gave them before, or none to
    build anew. Concepts and problems keep the first of a name or pid, existing
    ones first; a chunk is added if no existing one has its id. A chapter or chunk
    whose call fails gives none.
    """
    body = chapters.select("source", "chapter", F.col("body").alias("text"), F.col("ord").alias("c_ord"))
    chunks = body.select("source", "chapter", "c_ord", F.posexplode(X.chunks(F.col("text"), most)).alias("pos", "text"))
    chunks = chunks.select(X.chunk_id(F.col("source"), F.col("chapter"), F.col("pos") + 1).alias("chunk_id"), "source", "chapter", "text", F.struct("c_ord", "pos").alias("ord"))
    chunks = materialize(chunks.withColumn("ord", F.to_json("ord")), "chunks")
    concepts = concepts_from_chunks(chunks, call)
    problems = problems_from_chapters(chapters.withColumn("ord", F.to_json("ord")), call)
    concepts, problems = (x.withColumn("ord", F.struct(F.lit(1).alias("run"), F.to_json("ord").alias("of"))) for x in (concepts, problems))
    chunks = chunks.withColumn("ord", F.struct(F.lit(1).alias("run"), F.col("ord").alias("of")))
    if existing:
        old = {k: v.withColumn("ord", F.struct(F.lit(0).alias("run"), F.to_json(F.struct("ord")).alias("of"))) for k, v in existing.items()}
        concepts, problems = old["concepts"].unionByName(concepts), old["problems"].unionByName(problems)
        chunks = J.append_chunks(old["chunks"], chunks)
    return {"concepts": materialize(C.dedupe(concepts), "concepts"), "problems": materialize(C.dedupe_problems(problems.where("pid <> ''")), "problems"), "chunks": materialize(chunks, "chunks")}


def extract_edges(
    concepts: DataFrame,
    call: Call,
    chunks: DataFrame | None = None,
    problems: DataFrame | None = None,
    reports: list[DataFrame] | None = None,
    prereq: bool = True,
    existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(edges, candidates): all steps' validated edges, the first of repeats, and the PREREQUISITE edges among them as found, for review.

    A step is left out where its input is none (chunks: PART_OF, RELATED and SOLVES;
    problems: TESTS; reports of merging: CONFUSABLE) or prereq is false. existing:
    an earlier result whose PREREQUISITE edges are to be replaced; its other edges
    come first and say what is known to be PART_OF.

    PREREQUISITE is asked within chapters, between chapters that depend on each
    other, and for concepts named in definitions; then each source keeps ten edges.
    """
    terms = J.terms(concepts)
    made: list[DataFrame] = []

    def valid(raw: DataFrame, pids: DataFrame | None = None) -> DataFrame:
        return materialize(E.validate(raw, terms, concepts, pids), "edges")

    if existing is not None:
        old = E.strip_type(existing, "PREREQUISITE")
        made.append(old.select("source", "target", "type", "description", "dimensions", F.lit(None).cast("boolean").alias("reviewed"), F.col("chapter"), F.struct(F.lit(-1).alias("step"), F.to_json(F.struct("ord")).alias("prompt"), F.lit(0).cast("long").alias("at")).alias("ord")))
    if chunks is not None:
        made.append(valid(struct_edges(chunks, terms, call)))
    found = None
    if prereq:
        before = made[0] if made else None
        for m in made[1:]:
            before = before.unionByName(m)
        none = concepts.sparkSession.createDataFrame([], "source string, target string, type string")
        partof = materialize((none if before is None else before).where("type = 'PART_OF'").select("source", "target"), "part_of")
        intra = valid(prerequisites_in_batches(concepts, partof, call))
        deps = materialize(chapter_dependencies(concepts, call), "chapter_deps")
        pairs = valid(prerequisites_between_chapters(concepts, deps, partof, call))
        seen = intra.unionByName(pairs)
        scan = materialize(R.definition_candidates(concepts, terms, seen.where("type = 'PREREQUISITE'")).join(concepts.select(F.col("name").alias("target"), "ord"), "target"), "scan")
        said = E.validate_candidates(scan, concepts, call)
        order = _order("SCAN", F.concat_ws("\0", "target", "source"), F.lit(0))
        scanned = valid(said.select("source", "target", "type", "description", F.lit("").alias("chapter"), order))
        found = materialize(E.trim_out_degree(seen.unionByName(scanned)), "prerequisites")
        made.append(found)
    if problems is not None:
        raw = tests_edges(problems, concepts, call)
        made.append(valid(raw, problems.select("pid")))
    for i, report in enumerate(reports or ()):
        raw = E.confusable(report, concepts, call)
        made.append(valid(raw.withColumns({"chapter": F.lit(""), "ord": _order("CONFUSABLE", F.concat_ws("\0", F.lit(str(i)), "source", "target"), F.lit(0))})))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    candidates = (found if found is not None else out.limit(0)).where("type = 'PREREQUISITE'")
    return materialize(E.dedupe(out), "edges"), candidates
