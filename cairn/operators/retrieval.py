"""Text chunks and terms, vectors, and the contexts that question answering is given."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalar as X
from cairn.operators import similar
from cairn.operators.containment import contained
from cairn.session import materialize
from cairn.sources.frames import first_n, numbered

#: Bytes of terms that one broadcast may hold; more terms meet the texts by their anchors (containment.py).
TERM_BYTES = 16 << 20
BLOCK = 512


def mentions(texts: DataFrame, terms: DataFrame, term_bytes: int | None = None) -> DataFrame:
    """(id, term, canonical, n): how often each term occurs in each text, non-overlapping. Exact containment.

    texts: (id, text). terms: (term, canonical). Terms of up to term_bytes are
    searched for by an automaton that each task builds once from a broadcast; beyond
    that no terms come to the driver: texts and terms meet by a join.
    """
    t = materialize(terms.select("term", "canonical").where("term <> ''").distinct(), "terms")
    octets = t.agg(F.sum(F.octet_length("term").cast("long") + F.coalesce(F.octet_length("canonical"), F.lit(0)) + 64)).first()[0] or 0
    if octets <= (TERM_BYTES if term_bytes is None else term_bytes):
        return _search(texts, texts.sparkSession.sparkContext.broadcast([tuple(r) for r in t.toLocalIterator()]))
    return contained(texts, t).join(t, "term").select("id", "term", "canonical", "n")


def _search(texts: DataFrame, shared) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        of: dict[str, list[str]] = {}
        for term, canonical in shared.value:
            of.setdefault(term, []).append(canonical)
        for term in of:
            a.add_word(term, term)
        if of:
            a.make_automaton()
        for b in batches:
            ids, ts, cs, ns = [], [], [], []
            for i, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = {term for _, term in a.iter(text)} if of and text else ()
                for term in found:
                    for c in of[term]:
                        ids.append(i)
                        ts.append(term)
                        cs.append(c)
                        ns.append(text.count(term))
            yield pa.record_batch([pa.array([x.as_py() for x in ids], b.schema.field(0).type), pa.array(ts, pa.string()), pa.array(cs, pa.string()), pa.array(ns, pa.int64())], ["id", "term", "canonical", "n"])

    return texts.select("id", "text").mapInArrow(go, f"id {kind}, term string, canonical string, n long")


def relevant_concepts(texts: DataFrame, terms: DataFrame, most: int = 60) -> DataFrame:
    """(id, canonical, n): concepts each text mentions under any name, most often first, by first term on ties."""
    m = mentions(texts, terms).join(terms.select("term", "canonical", F.struct("kind", "ord", "at").alias("o")), ["term", "canonical"])
    total = m.groupBy("id", "canonical").agg(F.sum("n").alias("n"), F.min("o").alias("o"))
    return first_n(total, ["id"], [F.desc("n"), "o", "canonical"], most).select("id", "canonical", "n")


def definition_candidates(concepts: DataFrame, terms: DataFrame, existing: DataFrame, most: int = 200) -> DataFrame:
    """(source, target, definition): concepts whose name occurs in another's definition, but for existing pairs (source, target)."""
    # definitions that many concepts have are searched once
    of = concepts.where("definition <> ''").select("definition", F.col("name").alias("id"))
    texts = of.select(F.col("definition").alias("id"), F.col("definition").alias("text")).distinct()
    m = mentions(texts, terms).select(F.col("id").alias("definition"), "term", "canonical")
    m = m.join(of.select("definition", "id"), "definition").where(F.col("canonical") != F.col("id"))
    pairs = m.groupBy(F.col("canonical").alias("source"), F.col("id").alias("target")).agg(F.max(F.char_length("term")).alias("len"))
    pairs = pairs.join(existing.select("source", "target").distinct(), ["source", "target"], "left_anti")
    out = pairs.join(concepts.select(F.col("name").alias("target"), "definition", "ord"), "target")
    return out.orderBy("ord", F.desc("len"), "source").limit(most).select("source", "target", "definition")


def chunks_by_concepts(asked: DataFrame, chunks: DataFrame, terms: DataFrame, max_chunks: int = 4, max_chars: int = 600, min_hits: int = 1) -> DataFrame:
    """The chunks that mention most of each question's concepts.

    asked: (query, canonical). Returns (query, rank, chunk_id, hits, hit_count, text).
    """
    wanted = asked.select("query", "canonical").distinct()
    used = terms.join(wanted.select("canonical").distinct(), "canonical", "left_semi")
    hit = mentions(chunks.select(F.col("chunk_id").alias("id"), "text"), used).select("id", "canonical").distinct()
    per = wanted.join(hit, "canonical").groupBy("query", F.col("id").alias("chunk_id")).agg(F.array_sort(F.collect_set("canonical")).alias("hits"))
    per = per.withColumn("hit_count", F.size("hits")).where(F.col("hit_count") >= min_hits)
    top = numbered(per, ["query"], [F.desc("hit_count"), "chunk_id"], "rank").where(F.col("rank") <= max_chunks)
    return top.join(chunks.select("chunk_id", "text"), "chunk_id").select("query", "rank", "chunk_id", "hits", "hit_count", X.truncate(F.col("text"), max_chars).alias("text"))


def chunk_table(pages: DataFrame, most: int = 3000, sep: str = r"\n{2,}") -> DataFrame:
    """(source, chapter, chunk_id, pos, text): chapters cut into chunks. pages: (source, chapter, text)."""
    out = pages.select("source", "chapter", F.posexplode(X.chunks(F.col("text"), most, sep)).alias("pos", "text"))
    return out.withColumn("chunk_id", X.chunk_id(F.col("source"), F.col("chapter"), F.col("pos") + 1))


def chapters(pages: DataFrame, skip: int = 9) -> DataFrame:
    """(source, number, title, text): pages put together by chapter.

    pages: (source, page, text). A chapter starts at the first page, after the
    first `skip`, one of whose first six lines is a heading that was not seen
    before in the source; pages before the first heading belong to none.
    """
    from pyspark.sql import Window

    p = pages.withColumn("text", X.clean_page(F.col("text")))
    head = F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 6), lambda x: X.chapter_heading(X.strip(x))), lambda h: h.isNotNull())
    p = p.withColumn("h", F.when(F.col("page") > skip, F.get(head, 0)))
    first = p.where("h is not null").groupBy("source", F.col("h.number").alias("number")).agg(F.min("page").alias("page"), F.min_by("h.title", "page").alias("title"))
    started = p.join(first, ["source", "page"], "left").select("source", "page", "text", "number", "title")
    # a source's pages: one document, the unit that is read in order anyway
    w = Window.partitionBy("source").orderBy("page")
    filled = started.withColumn("c", F.last(F.when(F.col("number").isNotNull(), F.struct("number", "title")), ignorenulls=True).over(w)).where("c is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return filled.groupBy("source", "c").agg(text.alias("text")).select("source", "c.number", "c.title", "text")


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    return pages.where(F.col("page").between(first, last))


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vec, dims): vectors with components, none of them null or no number. Vectors of unlike length have no likeness."""
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dims"))
    return v.where(F.col("vec").isNotNull() & (F.col("dims") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query, rank, id, score): exact nearest by cosine distance d, score 1 / (1 + d).

    queries: (id, vec), vectors: (id, vec). A stated set of queries goes against
    all vectors in blocks: each block of queries meets each block of vectors in one
    multiplication, and only a query's best k of a block leave the task. Neither
    side passes through the driver. A query meets the vectors of its own length;
    what is not usable() takes no part.
    """
    asked, held = usable(queries), usable(vectors)
    parts = [max(1, -(-x.count() // rows)) for x, rows in ((asked, BLOCK), (held, 16 * BLOCK))]

    def deal(x: DataFrame, own: str, other: str, n: int, others: int) -> DataFrame:
        return x.select("id", "vec", "dims", F.pmod(F.xxhash64("id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    left, right = deal(asked, "i", "j", *parts), deal(held, "j", "i", *parts[::-1])
    kinds = [x.schema["id"].dataType.simpleString() for x in (queries, vectors)]

    def meet(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        n = min(k, len(vs))
        if not len(qs) or not n:
            return pd.DataFrame({"query": qs["id"][:0], "id": vs["id"][:0], "cos": np.zeros(0)})
        # rounded before the cut, and by id among equals, as the ranks are
        vs = vs.sort_values("id", kind="stable")
        s = np.round(_unit(np.array(qs["vec"].tolist(), float)) @ _unit(np.array(vs["vec"].tolist(), float)).T, 6)
        at = np.argsort(-s, axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"query": np.repeat(qs["id"].to_numpy(), n), "id": vs["id"].to_numpy()[at.ravel()], "cos": np.take_along_axis(s, at, 1).ravel()})

    keys = ["dims", "i", "j"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query {kinds[0]}, id {kinds[1]}, cos double")
    top = numbered(near, ["query"], [F.desc("cos"), "id"], "rank").where(F.col("rank") <= k)
    return top.select("query", "rank", "id", F.round(X.distance_score(1 - F.col("cos")), 6).alias("score"))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def similar_pairs(vectors: DataFrame, least: float = 0.82, block: int = 1024) -> DataFrame:
    """(a, b, confidence), a < b: all pairs of vectors whose cosine reaches `least`. Exact.

    vectors: (id, vec); what is not usable() takes no part, and vectors of unlike
    length make no pair. Where pivots part the vectors well enough (similar.py),
    only cells that can hold a pair meet; else all blocks of vectors do.
    """
    v = materialize(usable(vectors), "vectors")
    n = v.count()
    cells = similar.Cells.of(v, n, least) if least > 0 and n > 2 * block else None
    if cells is not None and 2 * cells.products() < n * n // 2:
        out = cells.pairs(block)
    else:
        size = min(max(block, n // 16), 8 * block)  # fewer, larger blocks: a vector is sent once to each
        out = _all_blocks(v, max(1, -(-n // size)), least, block)
    return out.withColumn("confidence", F.round("confidence", 4)).where(F.col("confidence") >= least)


def _all_blocks(v: DataFrame, n: int, least: float, tile: int = 1024) -> DataFrame:
    """Each pair of n blocks meets once and is multiplied in tiles; only pairs over the threshold leave the task."""
    kind = v.schema["id"].dataType.simpleString()
    # the shape of a triangle of block pairs: each row goes to the pairs its block is in
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j")))
    dealt = v.withColumn("c", F.explode(to)).select("c.i", "c.j", "dims", "b", "id", "vec")

    def meet(pdf):
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": left["id"][:0], "b": left["id"][:0], "confidence": np.zeros(0)})
        x, y = (_unit(np.array(part["vec"].tolist(), float)) for part in (left, right))
        found = []
        for lo in range(0, len(x), tile):
            for at in range(0, len(y), tile):
                s = x[lo : lo + tile] @ y[at : at + tile].T
                p, q = np.nonzero(s >= least - 6e-5)  # rounding to four places may lift a pair over the threshold
                a, b, c = left["id"].to_numpy()[lo + p], right["id"].to_numpy()[at + q], s[p, q]
                keep = (a < b) if i == j else np.ones(len(a), bool)
                found.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "confidence": c[keep]}))
        return pd.concat(found)

    return dealt.groupBy("dims", "i", "j").applyInPandas(meet, f"a {kind}, b {kind}, confidence double")


# Fixed texts: labels of the documents and contexts.
def concept_document(c: DataFrame) -> DataFrame:
    """(name, document): the text a concept is embedded by."""
    none = F.array().cast("array<string>")
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    names = F.array_join(F.filter(F.coalesce("aliases", none), lambda a: a != ""), "、")
    lines = [F.concat(F.lit(label), text(x)) for label, x in (("概念名称：", "name"), ("定义：", "definition"), ("所属章节：", "chapter"), ("节点角色：", "node_role"), ("难度：", "difficulty"))]
    lines.append(F.when(names != "", F.concat(F.lit("别名："), names)))
    for x, label in (("preemptive", "是否抢占式"), ("starvation_free", "是否避免饥饿"), ("complexity", "复杂度或调度开销"), ("scenario", "典型适用场景")):
        if x in c.columns:
            value = F.initcap(F.col(x).cast("string")) if x in ("preemptive", "starvation_free") else F.col(x)
            lines.append(F.when(F.nullif(value, F.lit("")).isNotNull(), F.concat(F.lit(f"{label}："), value)))
    return c.select("name", F.concat_ws("\n", *lines).alias("document"))


def concept_metadata(c: DataFrame) -> DataFrame:
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)
    return c.select(text("name"), text("definition"), text("chapter"), text("node_role"), F.coalesce(F.nullif(F.col("difficulty"), F.lit(0)), F.lit(1)).alias("difficulty"))


def graph_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, context): a subgraph as text, nodes and edges in name order."""
    s = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    n = F.concat(F.lit("- 名称："), s("name"), F.lit("；角色："), s("node_role"), F.lit("；难度："), s("difficulty"), F.lit("；章节："), s("chapter"), F.lit("；定义："), s("definition"))
    e = F.concat(F.lit("- "), s("source"), F.lit(" -["), s("type"), F.lit("]-> "), s("target"), F.lit("："), s("description"))
    nn = nodes.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", n.alias("l")))), lambda x: x["l"]), "\n").alias("n"))
    ee = edges.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "target", "type", e.alias("l")))), lambda x: x["l"]), "\n").alias("e"))
    none = F.lit("无")
    return nn.join(ee, "root", "full_outer").select("root", F.concat(F.lit("【概念部分】\n"), F.coalesce("n", none), F.lit("\n\n【关系部分】\n"), F.coalesce("e", none)).alias("context"))


def vector_context(hits: DataFrame) -> DataFrame:
    """(query, context): definitions of the hits (query, rank, name, definition), best first."""
    line = F.concat(F.lit("- 名称："), F.coalesce("name", F.lit("")), F.lit("；定义："), F.coalesce("definition", F.lit("")))
    return hits.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))
