"""The registered queries over the synthetic tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalar as X
from cairn.operators import concepts as C
from cairn.operators import diagnosis as D
from cairn.operators import edges as E
from cairn.operators import evaluation as V
from cairn.operators import graph as G
from cairn.operators import planning as P
from cairn.operators import questions as Q
from cairn.operators import retrieval as R
from cairn.session import materialize
from cairn.sources import json_files as J
from cairn.sources import loaded as L
from cairn.sources import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# the views that the SQL is written over
VIEWS = {
    "concept": "SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS name, p_name AS alias, concat(p_name, ' ', p_type) AS definition, p_brand AS chapter, CAST(1 + p_size % 3 AS INT) AS difficulty, CASE p_type WHEN 'SMALL' THEN '机制' WHEN 'ECONOMY' THEN '算法' WHEN 'PROMO' THEN '问题' ELSE '概念' END AS node_role, p_partkey AS ord FROM part",
    "prereq": "SELECT concat('P', CAST(p_partkey // 2 AS VARCHAR)) AS source, concat('P', CAST(p_partkey AS VARCHAR)) AS target, 2 * p_partkey AS ord FROM part WHERE p_partkey >= 1 UNION ALL SELECT concat('P', CAST(p_partkey // 3 AS VARCHAR)), concat('P', CAST(p_partkey AS VARCHAR)), 2 * p_partkey + 1 FROM part WHERE p_partkey >= 5 AND p_partkey % 5 = 0",
    "tests": "SELECT concat('O', CAST(l_orderkey AS VARCHAR)) AS source, concat('P', CAST(l_partkey AS VARCHAR)) AS target, min(l_linenumber) AS ord FROM lineitem GROUP BY l_orderkey, l_partkey",
    "attempts": "SELECT o_custkey AS learner, concat('O', CAST(o_orderkey AS VARCHAR)) AS pid, o_orderstatus = 'F' AS wrong, o_orderstatus = 'O' AS correct FROM orders",
    "related": "SELECT concat('P', CAST(a.l_partkey AS VARCHAR)) AS source, concat('P', CAST(b.l_partkey AS VARCHAR)) AS target, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_linenumber <= 2 AND b.l_linenumber <= 2 GROUP BY a.l_partkey, b.l_partkey",
    "part_of": "SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS source, concat('P', CAST(m AS VARCHAR)) AS target FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS m FROM part) t WHERE p_partkey <> m",
    "solves": "SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS source, concat('P', CAST(p_partkey // 4 AS VARCHAR)) AS target, p_partkey AS ord FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND p_partkey >= 1",
    "raw_edges": "SELECT concat('P', CAST(l_partkey AS VARCHAR)) AS source, concat('P', CAST(l_suppkey AS VARCHAR)) AS target, CASE l_returnflag WHEN 'A' THEN 'PREREQUISITE' WHEN 'R' THEN 'SOLVES' ELSE 'RELATED' END AS type, l_linestatus AS description, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord FROM lineitem",
    "edges": "SELECT source, target, 'PREREQUISITE' AS type FROM prereq UNION ALL SELECT source, target, 'TESTS' FROM tests UNION ALL SELECT source, target, 'SOLVES' FROM solves UNION ALL SELECT source, target, 'RELATED' FROM related UNION ALL SELECT source, target, 'PART_OF' FROM part_of",
    "walk": "SELECT name AS root, name AS node, 0 AS depth FROM concept UNION ALL SELECT r.root, p.source, r.depth + 1 FROM walk r JOIN prereq p ON p.target = r.node WHERE r.depth < 5",
    "anc": "SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node",
    "wrongs": "SELECT a.learner, a.pid, t.target, t.ord AS t_ord, c.node AS name, c.depth FROM attempts a JOIN tests t ON t.source = a.pid JOIN concept k ON k.name = t.target JOIN anc c ON c.root = t.target JOIN concept n ON n.name = c.node WHERE a.wrong",
    "score": "SELECT coalesce(w.learner, k.learner) AS learner, coalesce(w.name, k.name) AS name, greatest(0, coalesce(w10, 0) - 5 * coalesce(n, 0)) AS w10 FROM (SELECT learner, name, sum(CASE depth WHEN 0 THEN 10 WHEN 1 THEN 7 WHEN 2 THEN 5 ELSE 3 END) AS w10 FROM wrongs GROUP BY learner, name) w FULL OUTER JOIN (SELECT a.learner, t.target AS name, count(*) AS n FROM attempts a JOIN tests t ON t.source = a.pid JOIN concept c ON c.name = t.target WHERE a.correct GROUP BY a.learner, t.target) k ON w.learner = k.learner AND w.name = k.name",
    "mastered": "SELECT learner, name, round(w10 / CAST(10 AS DOUBLE), 4) AS weakness, round(1 - CAST(w10 AS DOUBLE) / CASE WHEN mx <= 0 THEN 10 ELSE mx END, 4) AS mastery FROM (SELECT *, max(w10) OVER (PARTITION BY learner) AS mx FROM score) x",
    "risked": "SELECT *, CASE WHEN mastery < 0.4 THEN 'high' WHEN mastery < 0.7 THEN 'medium' ELSE 'low' END AS risk FROM mastered",
    "weak": "SELECT learner, name FROM (SELECT *, count(*) FILTER (WHERE risk <> 'low') OVER (PARTITION BY learner) AS k, row_number() OVER (PARTITION BY learner ORDER BY CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, weakness DESC, mastery, name) AS r FROM risked) t WHERE risk <> 'low' OR (k = 0 AND r <= 10)",
}
NEEDS = {"edges": ["prereq", "tests", "solves", "related", "part_of"], "walk": ["concept", "prereq"], "anc": ["walk"], "wrongs": ["attempts", "tests", "concept", "anc"], "score": ["wrongs"], "mastered": ["score"], "risked": ["mastered"], "weak": ["risked"]}


def sql(body: str, *views: str) -> str:
    """body over the named views and those they need."""
    names: list[str] = []

    def take(v: str) -> None:
        for n in NEEDS.get(v, []):
            take(n)
        if v not in names:
            names.append(v)

    for v in views:
        take(v)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH RECURSIVE {head}\n{body}" if names else body


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# graph -------------------------------------------------------------------


@query(sql("SELECT 'Concept' AS label, count(*) AS n FROM concept UNION ALL SELECT 'Problem', count(*) FROM orders", "concept"))
def graph_node_counts(s, d):
    problems = W.table(s, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("pid"))
    nodes = W.concept(s, d).select(F.lit("Concept").alias("label")).unionByName(problems.select(F.lit("Problem").alias("label")))
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


@query(sql("SELECT type, count(*) AS n FROM edges GROUP BY type", "edges"))
def graph_edge_counts(s, d):
    return G.type_counts(W.edges(s, d))


@query(sql("SELECT type, n FROM (SELECT type, count(*) AS n FROM edges GROUP BY type) t", "edges"))
def relation_distribution(s, d):
    return V.histogram(W.edges(s, d), "type")


@query(sql("SELECT node_role, count(*) AS n FROM concept GROUP BY node_role", "concept"))
def role_histogram(s, d):
    return V.histogram(W.concept(s, d), "node_role")


COVERED = "SELECT {c} count(*) AS concepts, count(*) FILTER (WHERE e.name IS NOT NULL) AS with_prereq FROM concept LEFT JOIN (SELECT DISTINCT source AS name FROM prereq UNION SELECT target FROM prereq) e ON e.name = concept.name {g}"


@query(sql(COVERED.format(c="chapter,", g="GROUP BY chapter"), "concept", "prereq"))
def coverage_by_chapter(s, d):
    return G.coverage_by_chapter(W.concept(s, d), W.prereq(s, d))


@query(sql(COVERED.format(c="chapter,", g="GROUP BY ROLLUP (chapter)"), "concept", "prereq"))
def coverage_rollup(s, d):
    return G.coverage(W.concept(s, d), W.prereq(s, d))


@query(sql("SELECT name FROM concept WHERE name NOT IN (SELECT source FROM solves UNION SELECT target FROM solves)", "concept", "solves"))
def isolated_concepts(s, d):
    return G.isolated(W.concept(s, d), W.edges(s, d, "SOLVES"))


DEGREE = "SELECT name, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT source AS name, CASE WHEN type = 'RELATED' THEN 2 ELSE 1 END AS w FROM edges UNION ALL SELECT target, CASE WHEN type = 'RELATED' THEN 2 ELSE 1 END FROM edges) t GROUP BY name"


@query(sql(DEGREE, "edges"))
def degrees(s, d):
    return G.degrees(W.edges(s, d))


@query(sql(f"SELECT c.name, coalesce(degree, 0) AS degree FROM concept c LEFT JOIN ({DEGREE}) d ON d.name = c.name ORDER BY degree DESC, c.name LIMIT 40", "concept", "edges"))
def degree_topn(s, d):
    return G.top_degrees(W.concept(s, d), W.edges(s, d), 40)


@query(sql(f"SELECT name, degree FROM (SELECT c.name, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, c.name) AS r, count(*) OVER () AS n FROM concept c LEFT JOIN ({DEGREE}) d ON d.name = c.name) t WHERE n <= 80 OR (r <= 60 AND degree >= CASE WHEN n <= 200 THEN 1 ELSE 3 END)", "concept", "edges"))
def label_set(s, d):
    return G.label_set(W.concept(s, d), W.edges(s, d), 60)


@query(sql("SELECT name, type, direction, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT * FROM (SELECT source AS name, type, CASE WHEN type = 'RELATED' THEN 'both' ELSE 'out' END AS direction, target AS other FROM edges UNION ALL SELECT target, type, CASE WHEN type = 'RELATED' THEN 'both' ELSE 'in' END, source FROM edges) a) b GROUP BY name, type, direction", "edges"))
def neighbor_groups(s, d):
    return G.neighbour_groups(W.edges(s, d)).drop("neighbours")


GRAPH = "SELECT source, target, 'PREREQUISITE' AS type FROM prereq UNION ALL SELECT source, target, 'SOLVES' AS type FROM solves"
VIEWS["g"] = GRAPH
VIEWS["step"] = "SELECT source AS a, target AS b FROM g UNION SELECT target, source FROM g"
VIEWS["s1"] = "SELECT name AS root, name AS node FROM concept UNION SELECT c.name, b FROM concept c JOIN step ON a = c.name"
VIEWS["s2"] = "SELECT root, node FROM s1 UNION SELECT s1.root, b FROM s1 JOIN step ON a = s1.node"
NEEDS |= {"g": ["prereq", "solves"], "step": ["g"], "s1": ["concept", "step"], "s2": ["s1"]}


def _around(s, d, hops):
    seeds = W.concept(s, d).select(F.col("name").alias("root"), F.col("name").alias("node"))
    return G.subgraph(seeds, W.concept(s, d), W.edges(s, d, "PREREQUISITE", "SOLVES"), None, hops)


@query(sql("SELECT root, c.name, c.node_role FROM s1 JOIN concept c ON c.name = s1.node", "s1"))
def subgraph_1hop_nodes(s, d):
    return _around(s, d, 1)[0].select("root", "name", "node_role")


@query(sql("SELECT root, c.name, c.node_role FROM s2 JOIN concept c ON c.name = s2.node", "s2"))
def subgraph_2hop_nodes(s, d):
    return _around(s, d, 2)[0].select("root", "name", "node_role")


@query(sql("SELECT DISTINCT x.root, g.source, g.target, g.type FROM s1 x JOIN g ON g.source = x.node JOIN s1 y ON y.root = x.root AND y.node = g.target", "s1"))
def subgraph_1hop_edges(s, d):
    return _around(s, d, 1)[1].select("root", "source", "target", "type")


@query(sql("SELECT DISTINCT x.root, g.source, g.target, g.type FROM s2 x JOIN g ON g.source = x.node JOIN s2 y ON y.root = x.root AND y.node = g.target", "s2"))
def subgraph_2hop_edges(s, d):
    return _around(s, d, 2)[1].select("root", "source", "target", "type")


@query(sql("SELECT root, node, depth FROM anc", "anc"))
def prereq_ancestors(s, d):
    return G.ancestors(W.concept(s, d).select(F.col("name").alias("root")), W.prereq(s, d))


# what stays when nodes without predecessors are peeled off: the nodes that a cycle reaches
REACH = "SELECT source AS a, target AS b FROM prereq UNION SELECT x.a, p.target FROM reach x JOIN prereq p ON p.source = x.b"
VIEWS["reach"] = REACH
NEEDS["reach"] = ["prereq"]


@query(sql("SELECT count(DISTINCT b) AS n FROM reach WHERE a IN (SELECT a FROM reach WHERE a = b)", "reach"))
def prereq_cycle_residue(s, d):
    return G.cycle_residue(W.prereq(s, d)).agg(F.count("*").alias("n"))


# diagnosis ---------------------------------------------------------------


def _tested(s, d):
    return D.tested(W.tests(s, d), W.concept(s, d))


@query(sql("SELECT t.source AS pid, t.target, t.ord FROM tests t JOIN concept c ON c.name = t.target", "tests", "concept"))
def tested_concepts(s, d):
    return _tested(s, d)


@query(sql("SELECT target AS name, array_to_string(list(source ORDER BY ord, source), ',') AS practice FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord, source) AS r FROM tests) t WHERE r <= 3 GROUP BY target", "tests"))
def practice_topk(s, d):
    return P.practice(W.tests(s, d)).select("name", F.array_join("practice_pids", ",").alias("practice"))


@query(sql("SELECT learner, name, depth, pid AS evidence_pid, target AS evidence_target_concept FROM wrongs", "wrongs"))
def trace_candidates(s, d):
    return D.trace(W.attempts(s, d), _tested(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d)).select("learner", "name", "depth", "evidence_pid", "evidence_target_concept")


@query(sql("SELECT learner, name, count(*) AS hit_count, min(depth) AS depth, arg_min(pid, (pid, depth, t_ord, target)) AS evidence_pid FROM wrongs GROUP BY learner, name", "wrongs"))
def trace_aggregate(s, d):
    return D.aggregate(D.trace(W.attempts(s, d), _tested(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d))).select("learner", "name", "hit_count", "depth", "evidence_pid")


def _mastery(s, d):
    return D.mastery(W.attempts(s, d), _tested(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d))


def _report(s, d):
    """mastery for plans, which read it more than once, and what is planned from"""
    return materialize(P.marked(_mastery(s, d)), "mastery", compression="zstd")


def _weak(s, d):
    return materialize(P.weak_for_plan(_mastery(s, d)).select("learner", "name"), "weak", compression="zstd")


@query(sql("SELECT learner, m.name, weakness, mastery FROM mastered m JOIN concept c ON c.name = m.name", "mastered"))
def mastery_by_learner(s, d):
    return _mastery(s, d).select("learner", "name", "weakness", "mastery")


@query(sql("SELECT learner, name, mastery FROM mastered WHERE mastery < 0.6", "mastered"))
def weak_concepts(s, d):
    return D.weak(_mastery(s, d)).select("learner", "name", "mastery")


@query(sql("SELECT risk, count(*) AS n FROM risked GROUP BY risk", "risked"))
def risk_histogram(s, d):
    return D.risk_histogram(_mastery(s, d))


PLAN = "SELECT DISTINCT w.learner, a.node, a.depth FROM weak w JOIN anc a ON a.root = w.name JOIN concept c ON c.name = a.node"


@query(sql(f"SELECT learner, node AS name, min(depth) AS depth, max(depth) AS max_depth FROM ({PLAN}) t GROUP BY learner, node", "weak"))
def plan_nodes(s, d):
    return P.plan_nodes(_weak(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d))


@query(sql("SELECT DISTINCT w.learner, p.source, p.target FROM weak w JOIN anc a ON a.root = w.name JOIN prereq p ON p.source = a.node JOIN anc b ON b.root = w.name AND b.node = p.target JOIN concept ca ON ca.name = p.source JOIN concept cb ON cb.name = p.target", "weak"))
def plan_edges(s, d):
    return P.plan_edges(_weak(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d))


@query()
def learning_path(s, d):
    m = _report(s, d)
    return P.learning_path(m.where("planned"), m, W.concept(s, d), W.prereq(s, d), W.tests(s, d), closure=L.closure(s, d))


# edges and concepts ------------------------------------------------------


def _raw(s, d):
    return W.raw_edges(s, d)


VALID = "SELECT e.source, e.target, e.type, e.description, e.ord FROM raw_edges e JOIN concept b ON b.name = e.target JOIN concept a ON a.name = e.source WHERE e.source <> e.target AND (e.type <> 'SOLVES' OR a.node_role IN ('算法', '机制'))"
VIEWS["valid"] = VALID
NEEDS["valid"] = ["raw_edges", "concept"]


@query(sql("SELECT source, target, type, count(*) AS n FROM valid GROUP BY source, target, type", "valid"))
def edge_validate(s, d):
    terms = J.terms(W.concept(s, d).withColumn("aliases", F.array().cast("array<string>")))
    return E.validate(_raw(s, d), terms, W.concept(s, d)).groupBy("source", "target", "type").agg(F.count("*").alias("n"))


@query(sql("SELECT source, target, type, description FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN type = 'RELATED' THEN least(source, target) ELSE source END, CASE WHEN type = 'RELATED' THEN greatest(source, target) ELSE target END, type ORDER BY ord) AS r FROM raw_edges) t WHERE r = 1", "raw_edges"))
def edge_dedupe(s, d):
    return E.dedupe(_raw(s, d)).select("source", "target", "type", "description")


@query(sql("SELECT source, target, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS r FROM raw_edges WHERE type = 'PREREQUISITE') t WHERE r <= 10 GROUP BY source, target", "raw_edges"))
def out_degree_trim(s, d):
    return E.trim_out_degree(_raw(s, d).where("type = 'PREREQUISITE'")).groupBy("source", "target").agg(F.count("*").alias("n"))


@query(sql("SELECT chapter, CAST(b AS INT) AS batch, CAST(i - 15 * b AS INT) AS pos, name FROM (SELECT chapter, name, row_number() OVER (PARTITION BY chapter ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY chapter) AS n FROM concept) t, range(0, 400) r(b) WHERE i >= 15 * b AND i < 15 * b + 20 AND b <= greatest(0, CAST(ceil((n - 20) / 15.0) AS INT)) ", "concept"))
def chapter_batches(s, d):
    return E.chapter_batches(W.concept(s, d))


@query(sql("SELECT chapter, name FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY difficulty DESC, ord) AS r FROM concept) t WHERE r <= 6", "concept"))
def chapter_top6(s, d):
    return E.hardest_by_chapter(W.concept(s, d)).select("chapter", "name")


@query(sql("SELECT chapter, CAST(r AS INT) AS rank, name FROM (SELECT h.chapter, c.name, row_number() OVER (PARTITION BY h.chapter ORDER BY CASE WHEN c.chapter = h.chapter THEN 0 ELSE 1 END, CASE WHEN c.chapter = h.chapter THEN 0 ELSE -c.difficulty END, c.ord) AS r FROM (SELECT DISTINCT chapter FROM concept) h, concept c) t WHERE r <= 80", "concept"))
def problem_candidates80(s, d):
    return E.problem_candidates(W.concept(s, d))


@query(sql("SELECT a.name AS name, count(*) AS n FROM (SELECT alias AS name, name AS c FROM concept) a GROUP BY a.name", "concept"))
def concept_dedupe(s, d):
    c = W.concept(s, d).select(F.get("aliases", 0).alias("name"), F.array("name").alias("aliases"), "definition", "chapter", "difficulty", "node_role", "ord")
    return C.dedupe(c).select("name", F.size("aliases").cast("long").alias("n"))


@query(sql("SELECT h.o AS idx_a, c.ord AS idx_b FROM concept c JOIN (SELECT alias, min(ord) AS o FROM concept GROUP BY alias) h ON h.alias = c.alias AND c.ord > h.o", "concept"))
def alias_candidates(s, d):
    return C.alias_candidates(W.concept(s, d)).select("idx_a", "idx_b")


@query(sql("SELECT alias AS name, arg_min(name, ord) AS canonical FROM concept GROUP BY alias", "concept"))
def alias_resolution(s, d):
    names = W.concept(s, d).select(F.get("aliases", 0).alias("name")).distinct()
    return C.resolve(names, J.terms(W.concept(s, d)))


VIEWS["vec"] = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings"
VIEWS["cosines"] = "SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS c FROM vec a JOIN vec b ON a.vec_id < b.vec_id"
NEEDS["cosines"] = ["vec"]


def _vectors(s, d):
    return W.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(sql("SELECT a, b FROM cosines WHERE round(c, 4) >= 0.35", "cosines"))
def embed_pairs(s, d):
    return R.similar_pairs(_vectors(s, d), 0.35).select("a", "b")


@query(sql("SELECT query, CAST(r AS INT) AS rank, id FROM (SELECT q.vec_id AS query, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, v.v) / (q.n * v.n), 6) DESC, v.vec_id) AS r FROM vec q, vec v WHERE q.vec_id % 20 = 0) t WHERE r <= 5", "vec"))
def vector_topk(s, d):
    # the questions asked are a set of their own: every 20th vector stands for one
    return R.top_k(_vectors(s, d).where("id % 20 = 0"), _vectors(s, d)).select("query", "rank", "id")


VIEWS["linked"] = "SELECT a, b FROM cosines WHERE round(c, 4) >= 0.35 UNION ALL SELECT b, a FROM cosines WHERE round(c, 4) >= 0.35"
VIEWS["labels_met"] = "SELECT vec_id AS id, vec_id AS component FROM embeddings UNION SELECT l.b, m.component FROM labels_met m JOIN linked l ON l.a = m.id"
NEEDS |= {"linked": ["cosines"], "labels_met": ["linked"]}


@query(sql("SELECT id, min(component) AS component FROM labels_met GROUP BY id", "labels_met"))
def entity_components(s, d):
    v = _vectors(s, d)
    return C.components(v.select("id"), R.similar_pairs(v, 0.35).select("a", "b"))


# texts -------------------------------------------------------------------


@query("SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT (regexp_full_match(trim(x), '[·•\\d\\s]+') AND length(trim(x)) <= 6)), chr(10)) AS text FROM documents")
def clean_page(s, d):
    return W.table(s, d, "documents").select("doc_id", X.clean_page(F.coalesce("text", F.lit(""))).alias("text"))


# paragraphs are packed one after another: a step of the recursion is a paragraph of every text
WHITE = r"[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
VIEWS["para"] = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, x FROM (SELECT doc_id, k, regexp_replace(regexp_replace(y, '^{WHITE}+', ''), '{WHITE}+$', '') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS y, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) t) u WHERE x <> ''"
VIEWS["pack"] = "SELECT doc_id, i, x AS cur, 1 AS n FROM para WHERE i = 1 UNION ALL SELECT q.doc_id, q.i, CASE WHEN length(p.cur) + length(q.x) + 1 > 600 THEN q.x ELSE concat(p.cur, chr(10), chr(10), q.x) END, p.n + CASE WHEN length(p.cur) + length(q.x) + 1 > 600 THEN 1 ELSE 0 END FROM pack p JOIN para q ON q.doc_id = p.doc_id AND q.i = p.i + 1"
NEEDS["pack"] = ["para"]


@query(sql("SELECT printf('%d_c_C%03d', doc_id, n) AS chunk_id, CAST(n - 1 AS INT) AS pos, arg_max(cur, i) AS text FROM pack GROUP BY doc_id, n", "pack"))
def chunk_text(s, d):
    pages = W.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("c").alias("chapter"), F.col("text"))
    return R.chunk_table(pages, 600, "\n").select("chunk_id", "pos", "text")


MENTIONS = "SELECT d.doc_id AS id, b.item_id, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS n FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)"


@query(f"SELECT id, concat('B', CAST(item_id AS VARCHAR)) AS canonical, CAST(n AS BIGINT) AS n FROM ({MENTIONS}) t")
def mention_topk(s, d):
    docs = W.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = W.lexicon(s, d).withColumns({"kind": F.lit(0), "at": F.lit(0)})
    return R.relevant_concepts(docs, terms)


@query(f"SELECT query, CAST(r AS INT) AS rank, chunk_id, hit_count FROM (SELECT item_id % 4 AS query, concat('D', CAST(id AS VARCHAR)) AS chunk_id, CAST(count(DISTINCT item_id) AS INT) AS hit_count, row_number() OVER (PARTITION BY item_id % 4 ORDER BY count(DISTINCT item_id) DESC, concat('D', CAST(id AS VARCHAR))) AS r FROM ({MENTIONS}) t GROUP BY item_id % 4, id) u WHERE r <= 4")
def chunk_lookup(s, d):
    chunks = W.table(s, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    terms = W.lexicon(s, d)
    asked = terms.select((F.col("ord") % 4).alias("query"), "canonical")
    return R.chunks_by_concepts(asked, chunks, terms).select("query", "rank", "chunk_id", "hit_count")


@query(sql("SELECT source, target FROM (SELECT a.c AS source, b.name AS target, b.ord, max(length(a.term)) AS l FROM (SELECT alias AS term, arg_min(name, ord) AS c FROM concept GROUP BY alias) a JOIN concept b ON contains(b.definition, a.term) AND a.c <> b.name LEFT JOIN prereq p ON p.source = a.c AND p.target = b.name WHERE p.source IS NULL GROUP BY a.c, b.name, b.ord) t ORDER BY ord, l DESC, source LIMIT 200", "concept", "prereq"))
def definition_scan(s, d):
    c = W.concept(s, d)
    return R.definition_candidates(c, J.terms(c), W.prereq(s, d)).select("source", "target")


# evaluation and questions ------------------------------------------------


@query("SELECT 'quality' AS method, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS accuracy FROM labels UNION ALL SELECT 'toxic', count(*), avg(CAST(toxic AS DOUBLE)) FROM labels")
def accuracy_by_method(s, d):
    lab = W.table(s, d, "labels")
    rows = lab.select(F.lit("quality").alias("method"), (F.col("quality") == 1).alias("correct")).unionByName(lab.select(F.lit("toxic").alias("method"), (F.col("toxic") == 1).alias("correct")))
    return V.accuracy(rows)


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'pink') THEN 'warm' WHEN contains(p_name, 'blue') OR contains(p_name, 'green') THEN 'cold' ELSE 'other' END AS class FROM part")
def keyword_class(s, d):
    return W.table(s, d, "part").select("p_partkey", X.keyword_class(F.col("p_name"), {"warm": ["red", "pink"], "cold": ["blue", "green"]}, "other").alias("class"))


def _steps(s, d):
    e = W.edges(s, d, "PREREQUISITE", "SOLVES")
    return {k: Q.concept_edges(e, W.concept(s, d), k) for k in (Q.P, Q.SV)}


VIEWS["pe"] = "SELECT p.source, p.target, p.ord FROM prereq p JOIN concept a ON a.name = p.source JOIN concept b ON b.name = p.target"
VIEWS["se"] = "SELECT p.source, p.target, p.ord FROM solves p JOIN concept a ON a.name = p.source JOIN concept b ON b.name = p.target"
NEEDS |= {"pe": ["prereq", "concept"], "se": ["solves", "concept"]}


def _walks(*tables: str) -> str:
    nodes = ["t0.source", *[f"t{i}.target" for i in range(len(tables))]]
    joins = " ".join(f"JOIN {t} t{i} ON t{i}.source = t{i - 1}.target" for i, t in enumerate(tables) if i)
    apart = " AND ".join(f"{a} <> {b}" for i, a in enumerate(nodes) for b in nodes[:i])
    return f"SELECT DISTINCT concat_ws('>', {', '.join(nodes)}) AS path FROM {tables[0]} t0 {joins} WHERE {apart}"


def _paths(name: str, *kinds: str):
    tables = ["pe" if k == Q.P else "se" for k in kinds]

    def f(s, d):
        return Q.paths([_steps(s, d)[k] for k in kinds]).select(F.array_join("path", ">").alias("path"))

    f.__name__ = name
    query(sql(_walks(*tables), *dict.fromkeys(tables)))(f)


_paths("multihop_1", Q.P)
_paths("multihop_2_prereq", Q.P, Q.P)
_paths("multihop_2_prereq_solves", Q.P, Q.SV)
_paths("multihop_2_solves", Q.SV, Q.SV)
_paths("multihop_3", Q.P, Q.P, Q.P)
_paths("multihop_3_prereq_prereq_solves", Q.P, Q.P, Q.SV)
_paths("multihop_3_prereq_solves_solves", Q.P, Q.SV, Q.SV)
_paths("multihop_3_solves", Q.SV, Q.SV, Q.SV)


@query()
def multihop_set(s, d):
    return Q.question_set(W.edges(s, d, "PREREQUISITE", "SOLVES"), W.concept(s, d))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_activity(s, d):
    from cairn.streaming.activity import activity

    return activity(W.table(s, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
