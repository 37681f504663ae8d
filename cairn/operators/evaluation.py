"""Answers compared by a judge, accuracy, histograms and the summary of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import calls
from cairn.functions.scalar import fenced_json
from cairn.operators import answers as A
from cairn.operators.vector_store import VectorStore
from cairn.session import materialize
from cairn.sources.frames import numbered


def accuracy(details: DataFrame) -> DataFrame:
    """(method, n, accuracy): share of right answers; a null verdict is wrong."""
    return details.groupBy("method").agg(F.count("*").alias("n"), F.avg(F.coalesce("correct", F.lit(False)).cast("int")).alias("accuracy"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def flatten_details(report: DataFrame, methods: list[str]) -> DataFrame:
    """Rows (method, question, ...) of a report with one struct column a method."""
    parts = [report.select(F.lit(m).alias("method"), F.explode(f"{m}.details").alias("d")).select("method", "d.*") for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MAIN_QUESTIONS = 75
# Fixed text: what is said of a verdict that is no object.
NO_VERDICT = "评判模型未返回 JSON 对象"
JUDGE_TASK = '“模型回答”是否覆盖了“标准答案”的关键概念、中间节点和关系方向？返回 {"correct": true, "reason": ""}。'


def first_questions(questions: DataFrame, most: int = MAIN_QUESTIONS) -> DataFrame:
    """The first questions in file order."""
    return questions.orderBy("ord").limit(most)


def hops_histogram(questions: DataFrame) -> DataFrame:
    return histogram(questions, "hops")


def judge(answered: DataFrame, call: calls.Client | calls.Asker) -> DataFrame:
    """answered with (correct, reason, error): a model's verdict on each answer, a call an answer.

    answered: (method, query, question, ground_truth, predicted). What casts to true
    is right; a verdict that is no object is wrong and says so. Where there is no
    answer, or the call fails, correct is null and error says why: with a log
    (calls.Asker) a later run asks for those alone.
    """
    rows = materialize(answered.withColumn("_id", F.struct("method", "query")), "answers")
    prompt = F.concat(F.lit(f"{JUDGE_TASK}\n\n【标准答案】\n"), F.coalesce("ground_truth", F.lit("")), F.lit("\n\n【模型回答】\n"), F.col("predicted"))
    said = calls.asking(call)(rows.select(F.col("_id").alias("id"), prompt.alias("prompt")))
    v = fenced_json(F.col("value"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    right = F.coalesce(F.try_variant_get(v, "$.correct", "boolean"), F.lit(False))
    why = F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit(""))
    verdict = said.select(
        F.col("id").alias("_id"),
        F.when(F.col("value").isNotNull(), is_object & right).alias("correct"),
        F.when(F.col("value").isNotNull(), F.when(is_object, why).otherwise(NO_VERDICT)).alias("reason"),
        "error",
    )
    return rows.join(verdict, "_id").drop("_id")


def compare(questions: DataFrame, answers: dict[str, DataFrame], call: calls.Client | calls.Asker) -> DataFrame:
    """(method, query, question, ground_truth, predicted, correct, reason, error) of all questions by all methods.

    questions: (query, question, answer). answers: (query, answer, error) a method.
    """
    out = None
    for method, given in answers.items():
        one = questions.select("query", "question", F.col("answer").alias("ground_truth")).join(given.select("query", F.col("answer").alias("predicted")), "query", "left")
        one = one.select(F.lit(method).alias("method"), "query", "question", "ground_truth", "predicted")
        out = one if out is None else out.unionByName(one)
    return judge(out, call)


def run_comparison(
    questions: DataFrame,
    index: VectorStore,
    concepts: DataFrame,
    edges: DataFrame,
    terms: DataFrame,
    chunks: DataFrame | None,
    model: calls.Client | calls.Asker,
    judge_model: calls.Client | calls.Asker,
    vector_k: int = 5,
    graph_k: int = 3,
    hops: int = 2,
) -> DataFrame:
    """compare() of answers from vectors alone and from the graph. One search of the index gives the hits of one and the seeds of the other.

    questions: (query, question, answer).
    """
    hits = materialize(index.search(questions.select(F.col("query").alias("id"), F.col("question").alias("text")), max(vector_k, graph_k)), "hits")
    by_vector = A.vector_answers(questions, hits.where(F.col("rank") <= vector_k), model)
    by_graph = A.graph_answers(questions, hits.where(F.col("rank") <= graph_k).select("query", "rank", "name"), concepts, edges, terms, chunks, model, hops)
    return compare(questions, {"vector_rag": by_vector, "graph_rag": by_graph}, judge_model)


def summary(concepts: DataFrame, relations: DataFrame, chapters: DataFrame, formulas: DataFrame | None = None, top: int = 15) -> DataFrame:
    """(section, at, label, n, text): counts, relations by frequency, the heaviest concepts, and chapters with their topics.

    concepts: (name, total_weight, occurrence_count, sources, ord), relations:
    (relation), chapters: (number, title, topics). Ties go by name, or by ord.
    """
    counts = [(1, "concepts", concepts), (2, "relations", relations), (3, "chapters", chapters), *([(4, "formulas", formulas)] if formulas is not None else [])]
    empty = F.lit("")
    parts = [t.agg(F.count("*").alias("n")).select(F.lit("counts").alias("section"), F.lit(at).alias("at"), F.lit(label).alias("label"), "n", empty.alias("text")) for at, label, t in counts]
    # relation types are few: a report's lines, numbered in one task
    dist = relations.groupBy(F.coalesce("relation", F.lit("?")).alias("label")).agg(F.count("*").alias("n"))
    dist = numbered(dist, [F.lit(0)], [F.desc("n"), "label"], "at").select(F.lit("relations").alias("section"), "at", "label", "n", F.repeat(F.lit("█"), F.least(F.lit(30), F.col("n")).cast("int")).alias("text"))
    heavy = top_by_weight(concepts, top)
    core = numbered(heavy, [F.lit(0)], [F.desc("_w"), "ord", "name"], "at").select(F.lit("core").alias("section"), "at", F.col("name").alias("label"), F.coalesce("occurrence_count", F.lit(0)).cast("long").alias("n"), F.size(F.coalesce("sources", F.array().cast("array<string>"))).cast("string").alias("text"))
    of = chapters.select(F.lit("chapters").alias("section"), F.col("number").cast("int").alias("at"), F.col("title").alias("label"), F.size(F.coalesce("topics", F.array().cast("array<string>"))).cast("long").alias("n"), empty.alias("text"))
    out = parts[0]
    for p in [*parts[1:], dist, core, of]:
        out = out.unionByName(p)
    return out


def top_by_weight(concepts: DataFrame, most: int = 40) -> DataFrame:
    """The heaviest concepts with _w, their total_weight or 0; equal ones in file order."""
    return concepts.withColumn("_w", F.coalesce("total_weight", F.lit(0.0))).orderBy(F.desc("_w"), "ord", "name").limit(most)
