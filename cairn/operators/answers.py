"""Question answering over the graph and over vectors: contexts and prompts as tables, the model as an injected client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import calls
from cairn.operators import graph as G
from cairn.operators import retrieval as R

# Fixed texts: what is said where nothing was found.
NO_CHUNKS = "（无相关原文片段）"
NO_SEEDS = "未能从向量索引中检索到相关概念，无法进行图谱增强回答。"

GRAPH_TASK = "依据下面的图谱概念、图谱关系和原文片段回答问题；先给结论，再列出所依据的概念与关系，最后补充细节。依据不足时请说明。"
VECTOR_TASK = "只依据下面的概念定义回答问题；依据不足时请说明。"


def chunk_context(hits: DataFrame) -> DataFrame:
    """(query, context): the chunks found for each question, best first, with where they are from and what they mention.

    hits: (query, rank, chapter, hits, text), a few rows a question.
    """
    said = F.format_string("片段 %d（来源：%s；涉及概念：%s）\n%s", F.col("rank"), F.coalesce("chapter", F.lit("?")), F.array_join("hits", "、"), F.coalesce("text", F.lit("")))
    rows = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("l")))).alias("r"))
    return rows.select("query", F.array_join(F.transform("r", lambda x: x["l"]), "\n\n").alias("context"))


def tooltips(concepts: DataFrame, degrees: DataFrame, muted: str) -> DataFrame:
    """(name, tooltip): a concept's card; degrees: (name, degree)."""
    c = concepts.join(degrees, "name", "left")
    s = lambda x, none="": F.coalesce(F.col(x).cast("string"), F.lit(none))
    names = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "、")
    # fixed text: the card's markup
    parts = [
        F.lit("<div style='max-width:340px;font-family:sans-serif;'><b style='font-size:14px;'>"),
        F.col("name"),
        F.lit(f"</b><br/><span style='color:{muted};font-size:12px;'>"),
        F.concat_ws(" · ", s("chapter"), s("node_role", "概念"), F.concat(F.lit("难度 "), s("difficulty", "1")), F.concat(F.lit("度 "), s("degree", "0"))),
        F.lit("</span>"),
        F.when(F.size("aliases") > 0, F.concat(F.lit("<br/><i>别名："), names, F.lit("</i>"))).otherwise(""),
        F.lit("<br/><span style='font-size:12px;'>"),
        s("definition"),
        F.lit("</span></div>"),
    ]
    return c.select("name", F.concat(*parts).alias("tooltip"))


def graph_answers(
    questions: DataFrame, seeds: DataFrame, concepts: DataFrame, edges: DataFrame, terms: DataFrame, chunks: DataFrame | None, call: calls.Client | calls.Asker, hops: int = 2, max_chunks: int = 4, max_chars: int = 600
) -> DataFrame:
    """(query, answer, error): each question answered from the neighbourhood of its seed concepts.

    questions: (query, question). seeds: (query, rank, name), a few a question,
    as a vector search gives them. chunks: (chunk_id, chapter, text), or none to
    leave texts out. A question without seeds gets a fixed answer and no call.
    """
    named = seeds.where("name is not null and name <> ''")
    start = named.select(F.col("query").alias("root"), F.col("name").alias("node"))
    nodes, links = G.subgraph(start, concepts, edges, None, hops)
    rows = questions.join(named.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names")), "query", "left")
    rows = rows.join(R.graph_context(nodes, links).withColumnRenamed("root", "query"), "query", "left")
    parts = [F.lit(f"{GRAPH_TASK}\n\n【用户问题】\n"), F.col("question"), F.lit("\n\n【种子概念】\n"), F.col("names"), F.lit("\n\n【图谱上下文】\n"), F.coalesce("context", F.lit(""))]
    if chunks is not None:
        # all concepts of the neighbourhood are looked up, the seeds where it has none
        reached = nodes.select(F.col("root").alias("query"), F.col("name").alias("canonical"))
        only = named.join(reached.select("query").distinct(), "query", "left_anti").select("query", F.col("name").alias("canonical"))
        hits = R.chunks_by_concepts(reached.unionByName(only), chunks, terms, max_chunks, max_chars).join(chunks.select("chunk_id", "chapter"), "chunk_id")
        rows = rows.join(chunk_context(hits).withColumnRenamed("context", "found"), "query", "left")
        parts += [F.lit("\n\n【原文片段】\n"), F.coalesce("found", F.lit(NO_CHUNKS))]
    return _answered(rows.withColumn("prompt", F.when(F.col("names").isNotNull(), F.concat(*parts))), call, NO_SEEDS)


def vector_answers(questions: DataFrame, hits: DataFrame, call: calls.Client | calls.Asker) -> DataFrame:
    """(query, answer, error): each question answered from the definitions of its hits (query, rank, name, definition) alone."""
    rows = questions.join(R.vector_context(hits), "query", "left")
    return _answered(rows.withColumn("prompt", F.concat(F.lit(f"{VECTOR_TASK}\n\n【用户问题】\n"), "question", F.lit("\n\n【概念定义】\n"), F.coalesce("context", F.lit("")))), call, None)


def _answered(rows: DataFrame, call: calls.Client | calls.Asker, without: str | None) -> DataFrame:
    said = calls.asking(call)(rows.where("prompt is not null").select(F.col("query").alias("id"), "prompt"))
    silent = rows.where("prompt is null").select("query", F.lit(without).alias("answer"), F.lit(None).cast("string").alias("error"))
    return said.select(F.col("id").alias("query"), F.col("value").alias("answer"), "error").unionByName(silent)
