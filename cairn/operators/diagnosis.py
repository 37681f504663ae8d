"""Diagnosis of weak concepts and mastery, for all learners in one plan.

attempts: (learner, pid, wrong, correct). Weights are summed as whole tenths, so
that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import scalar as X
from cairn.operators.graph import ancestors
from cairn.session import in_parts, materialize, spread
from cairn.sources.frames import keep_first, numbered


def tested(tests: DataFrame, concepts: DataFrame, raw_tests: DataFrame | None = None) -> DataFrame:
    """(pid, target, ord): the concepts each problem tests, once each, in edge order.

    A problem with no loaded TESTS edge falls back to raw_tests.
    """

    def real(t: DataFrame) -> DataFrame:
        once = t.groupBy(F.col("source").alias("pid"), "target").agg(F.min("ord").alias("ord"))
        return once.join(concepts.select(F.col("name").alias("target")), "target", "left_semi").select("pid", "target", "ord")

    got = real(tests)
    if raw_tests is None:
        return got
    return got.unionByName(real(raw_tests).join(got.select("pid").distinct(), "pid", "left_anti"))


def closure_of(concepts: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS) -> DataFrame:
    """(root, node, depth) of all concepts: what the functions here work out where no index (reach.py) is given."""
    return ancestors(concepts.select(F.col("name").alias("root")), prereq, max_hops)


#: Prerequisites that one row carries at most; a root with more has several rows.
PIECE = 64

#: Names in the rows of pieces() that learners' concepts meet in all, beyond which learners are taken in parts. A name is 10 to 20 bytes of a shuffle.
PART = 1 << 28

#: What is known of a concept besides its name.
NODE = ("node_role", "difficulty", "chapter", "definition")


def pieces(closure: DataFrame, concepts: DataFrame, *attributes: str) -> DataFrame:
    """(target, bases): the prerequisites of each root that are concepts, an array of (name, depth, attributes) of PIECE at most.

    attributes are columns of concepts or of closure. Answers meet these rows and go
    to their learner with them, and only there are they taken apart: what all
    learners' concepts come to is not shuffled row by row, and but once.
    """
    of = [x for x in attributes if x not in closure.columns]
    names = concepts.select(F.col("name").alias("node"), *of)
    c = closure.join(names, "node", "inner" if of else "left_semi")
    c = numbered(c, ["root"], ["node"])
    base = F.struct(F.col("node").alias("name"), "depth", *attributes)
    return c.groupBy(F.col("root").alias("target"), F.floor((F.col("_rn") - 1) / PIECE)).agg(F.collect_list(base).alias("bases")).select("target", "bases")


def unfolded(hits: DataFrame, met: DataFrame, *on: str) -> DataFrame:
    """hits (learner, target, ...) with a row for each of the bases of pieces(). All of a learner's rows lie in one partition."""
    at = spread(hits.join(met, ["target", *on]).select(*hits.columns, "bases"), "learner")
    return at.select(*hits.columns, F.explode("bases").alias("_b")).select(*hits.columns, "_b.*")


def parts_of(hits: DataFrame, met: DataFrame) -> int:
    """In how many parts hits (learner, target) take the rows of pieces(), PART names a part."""
    names = F.size("bases") * max(1, sum(f.dataType.simpleString() == "string" for f in met.schema["bases"].dataType.elementType))
    sizes = met.groupBy("target").agg(F.sum(names).alias("_n"))
    n = hits.groupBy("target").count().join(sizes, "target").agg(F.sum(F.col("count") * F.col("_n"))).first()[0]
    return max(1, -(-(n or 0) // PART))


def trace(attempts: DataFrame, tested_: DataFrame, concepts: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS, closure: DataFrame | None = None, about: tuple[str, ...] = NODE) -> DataFrame:
    """Candidate root causes of each wrong problem of each learner, with a reason, and the columns of concepts that `about` names."""
    closure = closure_of(concepts, prereq, max_hops) if closure is None else closure
    hits = attempts.where("wrong").select("learner", "pid").distinct().join(tested_, "pid").withColumnRenamed("ord", "t_ord")
    return _traced(hits, pieces(closure, concepts, *about), about)


def _traced(hits: DataFrame, met: DataFrame, about: tuple[str, ...]) -> DataFrame:
    rows = unfolded(hits, met)
    reason = X.trace_reason(F.col("name"), F.col("depth"), F.col("pid"), F.col("target"))
    return rows.select("learner", "name", "depth", *about, F.col("pid").alias("evidence_pid"), F.col("target").alias("evidence_target_concept"), "t_ord", reason.alias("reason"))


def trace_concepts(names: DataFrame, concepts: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS) -> DataFrame:
    """Candidates from concepts named directly (a column, name): no evidence problem."""
    closure = ancestors(names.select(F.col("name").alias("root")).join(concepts.select(F.col("name").alias("root")), "root", "left_semi"), prereq, max_hops)
    rows = closure.select(F.col("root").alias("target"), F.col("node").alias("name"), "depth").join(concepts.select("name", "node_role", "difficulty", "chapter", "definition"), "name")
    reason = X.trace_reason(F.col("name"), F.col("depth"), F.lit(""), F.col("target"))
    return rows.select("name", "depth", "node_role", "difficulty", "chapter", "definition", F.lit("").alias("evidence_pid"), F.col("target").alias("evidence_target_concept"), reason.alias("reason"))


def aggregate(traces: DataFrame, pid_order: DataFrame | None = None) -> DataFrame:
    """Candidates of all problems of a learner, a row a concept.

    pid_order: (learner, pid, p_ord) is the order in which problems were given,
    else they are taken by name. Evidence rows are one learner's for one concept.
    """
    t = traces if pid_order is None else traces.join(pid_order.withColumnRenamed("pid", "evidence_pid"), ["learner", "evidence_pid"])
    # within one problem: nearer first, then easier, chapter and name, as candidates are sorted
    order = [F.lit(0).alias("p_ord") if pid_order is None else F.col("p_ord"), F.col("evidence_pid"), F.col("depth"), F.col("t_ord")]
    row = F.struct(*order, F.col("evidence_target_concept"))
    about = [c for c in NODE if c in t.columns]
    out = t.groupBy("learner", "name").agg(
        F.count("*").alias("hit_count"),
        F.min("depth").alias("depth"),
        F.min(row).alias("_first"),
        F.array_sort(F.collect_list(row)).alias("_e"),
        *([F.min_by(F.struct(*about), row).alias("_n")] if about else []),
    )
    evidences = F.transform("_e", lambda e: F.struct(e["evidence_pid"].alias("pid"), e["evidence_target_concept"].alias("target_concept"), e["depth"].alias("depth")))
    targets = F.array_distinct(F.transform("_e", lambda e: e["evidence_target_concept"]))
    first = F.col("_first")
    return out.select(
        "learner",
        "name",
        "depth",
        *(["_n.*"] if about else []),
        first["evidence_pid"].alias("evidence_pid"),
        first["evidence_target_concept"].alias("evidence_target_concept"),
        X.aggregate_reason(F.col("hit_count"), targets).alias("reason"),
        "hit_count",
        evidences.alias("evidences"),
    )


def trace_problems(pids: DataFrame, tested_: DataFrame, concepts: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS, closure: DataFrame | None = None, about: tuple[str, ...] = NODE) -> DataFrame:
    """Weak candidates of problems (a column, pid), each taken by itself as one wrong answer: aggregate() with pid for learner.

    What problems test is written first, and problems are traced in parts, so that
    not all that their concepts build on lies on disk at once.
    """
    closure = closure_of(concepts, prereq, max_hops) if closure is None else closure
    hits = materialize(pids.select("pid").distinct().join(tested_, "pid").select("pid", "target", F.col("ord").alias("t_ord")), "hits", compression="zstd")
    met = materialize(pieces(closure, concepts, *about), "pieces")
    return in_parts(lambda part: aggregate(_traced(hits.where(part).withColumn("learner", F.col("pid")), met, about)).withColumnRenamed("learner", "pid"), "pid", parts_of(hits, met), "traces")


def sort_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("learner", "depth", "difficulty", "chapter", "name")


def _points(attempts: DataFrame, tested_: DataFrame, closure: DataFrame, concepts: DataFrame) -> DataFrame:
    """(learner, pid, target, wrong, correct, name, depth, points): what each answer says of each concept, a learner's rows in one partition."""
    # a problem counts once as wrong and once as right
    said = attempts.groupBy("learner", "pid").agg(F.max(F.coalesce("wrong", F.lit(False))).alias("wrong"), F.max(F.coalesce("correct", F.lit(False))).alias("correct")).where("wrong OR correct")
    # wrong answers speak against all that a concept builds on, right ones for the concept itself
    met = pieces(closure, concepts).withColumn("wrong", F.lit(True)).unionByName(pieces(closure.where("depth = 0"), concepts).withColumn("wrong", F.lit(False)))
    rows = unfolded(said.join(tested_.select("pid", "target"), "pid"), met, "wrong")
    points = F.when(F.col("wrong"), X.weight_tenths(F.col("depth"))).otherwise(0) - F.when(F.col("correct") & (F.col("depth") == 0), S.CORRECT_TENTHS).otherwise(0)
    return rows.withColumn("points", points.cast("long"))


def _scored(s: DataFrame) -> DataFrame:
    """weakness, mastery and risk from each learner's sums w; the other columns stay."""
    top = F.max("w").over(Window.partitionBy("learner"))
    rest = [c for c in s.columns if c not in ("learner", "name", "w")]
    scored = s.select("learner", "name", F.round(F.col("w") / F.lit(10.0), 4).alias("weakness"), F.round(1 - F.col("w").cast("double") / F.when(top <= 0, 10).otherwise(top), 4).alias("mastery"), *rest)
    return scored.withColumn("risk", X.risk(F.col("mastery")))


def mastery(attempts: DataFrame, tested_: DataFrame, concepts: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS, closure: DataFrame | None = None) -> DataFrame:
    """(learner, name, weakness, mastery, risk) of every concept that a learner's answers touch. A learner's rows lie in one partition."""
    closure = closure_of(concepts, prereq, max_hops) if closure is None else closure
    rows = _points(attempts, tested_, closure, concepts)
    return _scored(rows.groupBy("learner", "name").agg(F.greatest(F.lit(0).cast("long"), F.sum("points")).alias("w")))


def mastery_report(attempts: DataFrame, tested_: DataFrame, concepts: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS, closure: DataFrame | None = None) -> DataFrame:
    """mastery() with evidence lists and reasons."""
    closure = closure_of(concepts, prereq, max_hops) if closure is None else closure
    rows = _points(attempts, tested_, closure, concepts)
    lists = {
        "evidence_pids": F.when(F.col("wrong"), F.nullif(F.col("pid"), F.lit(""))),
        "evidence_target_concepts": F.when(F.col("wrong"), F.col("target")),
        "correct_evidence_pids": F.when(F.col("correct") & (F.col("depth") == 0), F.col("pid")),
    }
    s = rows.groupBy("learner", "name").agg(F.greatest(F.lit(0).cast("long"), F.sum("points")).alias("w"), *[F.array_sort(F.collect_set(c)).alias(k) for k, c in lists.items()])
    out = _scored(s).select("learner", "name", "weakness", "mastery", "risk", *lists)
    return out.withColumn("reason", X.mastery_reason(F.col("name"), F.col("evidence_pids"), F.col("evidence_target_concepts"), F.col("weakness"), F.col("risk"), F.col("correct_evidence_pids")))


def sort_mastery(report: DataFrame) -> DataFrame:
    return report.orderBy("learner", X.risk_order(F.col("risk")), F.desc("weakness"), "mastery", "name")


def weak(report: DataFrame, below: float = S.WEAK_BELOW) -> DataFrame:
    return report.where(F.col("mastery") < below)


def risk_histogram(report: DataFrame) -> DataFrame:
    return report.groupBy("risk").agg(F.count("*").alias("n"))


def first_tested_pids(problems: DataFrame, tests: DataFrame, limit: int = 2) -> DataFrame:
    """The first problems, in file order, that have a TESTS edge."""
    return problems.join(tests.select(F.col("source").alias("pid")).distinct(), "pid", "left_semi").orderBy("ord", "pid").limit(limit)


def problems_by_pid(pids: DataFrame, problems: DataFrame) -> DataFrame:
    """Each asked pid once with its problem, the first in file order; nulls where there is none."""
    return pids.select("pid").distinct().join(keep_first(problems, ["pid"], ["ord"]), "pid", "left")


def tested_summary(problems: DataFrame, tested_: DataFrame) -> DataFrame:
    """(pid, stem, tested_concepts): what each problem tests, in edge order."""
    of = tested_.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("tested_concepts"))
    return problems.join(of, "pid", "left").select("pid", F.coalesce("stem", F.lit("")).alias("stem"), F.coalesce("tested_concepts", F.array().cast("array<string>")).alias("tested_concepts"))
