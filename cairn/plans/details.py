"""More registered queries: the columns and branches that those in queries.py leave out, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalar as X
from cairn.operators import answers as A
from cairn.operators import concepts as C
from cairn.operators import diagnosis as D
from cairn.operators import edges as E
from cairn.operators import graph as G
from cairn.operators import questions as Q
from cairn.operators import retrieval as R
from cairn.plans import queries as base
from cairn.plans.queries import NEEDS, ORACLE_SQL, VIEWS, WHITE, query, sql
from cairn.sources import json_files as J
from cairn.sources import loaded as L
from cairn.sources import views as W

# graph -------------------------------------------------------------------

def _alone(where: str) -> str:
    return f"(SELECT count(*) FROM concept WHERE name NOT IN (SELECT source FROM edges WHERE {where} UNION SELECT target FROM edges WHERE {where}))"


@query(sql(f"SELECT 'all' AS types, {_alone('true')} AS n UNION ALL SELECT 'RELATED', {_alone("type = 'RELATED'")} UNION ALL SELECT 'PART_OF', {_alone("type = 'PART_OF'")}", "concept", "edges"))
def isolated_counts(s, d):
    c = W.concept(s, d)
    parts = [G.isolated(c, W.edges(s, d, *kinds)).agg(F.count("*").alias("n")).select(F.lit(label).alias("types"), "n") for label, kinds in (("all", ()), ("RELATED", ("RELATED",)), ("PART_OF", ("PART_OF",)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# the types that are searched when none are named: one of them has no direction
VIEWS["gd"] = "SELECT source, target, type FROM edges WHERE type IN ('PREREQUISITE', 'RELATED', 'SOLVES')"
VIEWS["near"] = "SELECT root, node, min(depth) AS depth FROM (SELECT name AS root, name AS node, 0 AS depth FROM concept UNION ALL SELECT c.name, g.target, 1 FROM concept c JOIN gd g ON g.source = c.name UNION ALL SELECT c.name, g.source, 1 FROM concept c JOIN gd g ON g.target = c.name) t GROUP BY root, node"
NEEDS |= {"gd": ["edges"], "near": ["concept", "gd"]}


def _around(s, d):
    seeds = W.concept(s, d).select(F.col("name").alias("root"), F.col("name").alias("node"))
    return G.subgraph(seeds, W.concept(s, d), W.edges(s, d), None, 1)


@query(sql("SELECT root, c.name, depth FROM near JOIN concept c ON c.name = near.node", "near"))
def subgraph_default_nodes(s, d):
    return _around(s, d)[0].select("root", "name", "depth")


@query(sql("SELECT DISTINCT x.root, CASE WHEN g.type = 'RELATED' THEN least(g.source, g.target) ELSE g.source END AS source, CASE WHEN g.type = 'RELATED' THEN greatest(g.source, g.target) ELSE g.target END AS target, g.type FROM near x JOIN gd g ON g.source = x.node JOIN near y ON y.root = x.root AND y.node = g.target", "near"))
def subgraph_default_edges(s, d):
    return _around(s, d)[1].select("root", "source", "target", "type")


@query(sql("SELECT root, c.name, depth FROM anc JOIN concept c ON c.name = anc.node", "anc"))
def prereq_subgraph_nodes(s, d):
    c = W.concept(s, d)
    return G.prereq_subgraph(c.select(F.col("name").alias("root")), c, W.prereq(s, d))[0].select("root", "name", "depth")


@query(sql("SELECT a.root, p.source, p.target FROM prereq p JOIN anc a ON a.node = p.source JOIN anc b ON b.node = p.target AND b.root = a.root", "anc"))
def prereq_subgraph_edges(s, d):
    c = W.concept(s, d)
    return G.prereq_subgraph(c.select(F.col("name").alias("root")), c, W.prereq(s, d))[1].select("root", "source", "target")


@query(sql("SELECT source, target, type FROM edges UNION ALL SELECT target, source, type FROM edges WHERE type = 'RELATED'", "edges"))
def adjacency(s, d):
    return G.adjacency(W.edges(s, d)).select("source", "target", "type")


PROBLEMS = "SELECT concat('O', CAST(o_orderkey AS VARCHAR)) AS pid, o_orderpriority AS stem, o_orderkey AS ord FROM orders"
VIEWS["problems"] = PROBLEMS


def _problems(s, d):
    o = W.table(s, d, "orders")
    return o.select(W.key("O", F.col("o_orderkey")).alias("pid"), F.col("o_orderpriority").alias("stem"), F.col("o_orderkey").alias("ord"), "o_orderstatus")


@query(sql("SELECT coalesce(e.id, k.id) AS id, k.label FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) e FULL OUTER JOIN (SELECT name AS id, 'Concept' AS label FROM concept UNION ALL SELECT concat('O', CAST(o_orderkey AS VARCHAR)), 'Problem' FROM orders WHERE o_orderstatus = 'O') k ON k.id = e.id", "edges", "concept"))
def phantom_nodes(s, d):
    return G.nodes_with_phantoms(W.concept(s, d), _problems(s, d).where("o_orderstatus = 'O'"), W.edges(s, d))


@query(sql("SELECT DISTINCT source AS name FROM tests", "tests"))
def missing_nodes(s, d):
    return G.missing_nodes(W.tests(s, d).select(F.col("source").alias("subject"), F.col("target").alias("object")), W.concept(s, d))


RENDER = "SELECT name FROM concept WHERE difficulty >= 2 UNION SELECT pid FROM problems"


@query(sql(f"SELECT DISTINCT CASE WHEN type = 'RELATED' THEN least(source, target) ELSE source END AS a, CASE WHEN type = 'RELATED' THEN greatest(source, target) ELSE target END AS b, type FROM edges WHERE source IN ({RENDER}) AND target IN ({RENDER}) AND (type <> 'RELATED' OR source <> target)", "edges", "concept", "problems"))
def edge_render_set(s, d):
    shown = W.concept(s, d).where("difficulty >= 2").select("name").union(_problems(s, d).select("pid"))
    return G.render_edges(W.edges(s, d), shown, True).select(F.col("source"), "target", "type").select(
        F.when(F.col("type") == "RELATED", F.least("source", "target")).otherwise(F.col("source")).alias("a"),
        F.when(F.col("type") == "RELATED", F.greatest("source", "target")).otherwise(F.col("target")).alias("b"),
        "type",
    )


@query(sql(f"SELECT type, count(*) AS n FROM edges WHERE type <> 'TESTS' AND source IN ({RENDER}) AND target IN ({RENDER}) GROUP BY type", "edges", "concept", "problems"))
def edge_render_counts(s, d):
    shown = W.concept(s, d).where("difficulty >= 2").select("name").union(_problems(s, d).select("pid"))
    return G.type_counts(G.render_edges(W.edges(s, d), shown, False))


@query(sql("SELECT type, count(*) AS n FROM edges WHERE type <> 'PREREQUISITE' GROUP BY type", "edges"))
def strip_type(s, d):
    return G.type_counts(E.strip_type(W.edges(s, d), "PREREQUISITE"))


@query(sql("SELECT p.name, c.n AS number FROM (SELECT name, chapter FROM concept) p JOIN (SELECT chapter, count(*) AS n FROM concept GROUP BY chapter) c ON c.chapter = p.chapter", "concept"))
def formula_chapters(s, d):
    c = W.concept(s, d)
    titles = c.groupBy(F.col("chapter").alias("title")).agg(F.count("*").alias("number"))
    return G.formula_chapters(c.select("name", F.col("chapter").alias("source")), titles).select("name", "number")


# diagnosis ---------------------------------------------------------------

REASON = "CASE WHEN depth = 0 THEN concat('错题 ', {p}, ' 直接考查「', {t}, '」，「', {n}, '」本身可能未掌握。') ELSE concat('错题 ', {p}, ' 考查「', {t}, '」，「', {n}, '」是其第 ', CAST(depth AS VARCHAR), ' 层先修概念，可能是错误根因。') END"


@query(sql(f"SELECT c.name, depth, root AS evidence_target_concept, {REASON.format(p=chr(39) * 2, t='root', n='c.name')} AS reason FROM anc JOIN concept c ON c.name = anc.node", "anc"))
def trace_concepts(s, d):
    c = W.concept(s, d)
    return D.trace_concepts(c.select("name"), c, W.prereq(s, d)).select("name", "depth", "evidence_target_concept", "reason")


@query(sql(f"SELECT learner, pid, target, name, {REASON.format(p='pid', t='target', n='name')} AS reason FROM wrongs", "wrongs"))
def trace_reasons(s, d):
    t = D.trace(W.attempts(s, d), base._tested(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d))
    return t.select("learner", F.col("evidence_pid").alias("pid"), F.col("evidence_target_concept").alias("target"), "name", "reason")


VIEWS["ranked"] = "SELECT *, row_number() OVER (PARTITION BY learner, name ORDER BY pid, depth, t_ord, target) AS i FROM wrongs"
VIEWS["firsts"] = "SELECT learner, name, string_agg(target, '、' ORDER BY i) AS targets FROM (SELECT learner, name, target, min(i) AS i FROM ranked GROUP BY learner, name, target) t GROUP BY learner, name"
NEEDS |= {"ranked": ["wrongs"], "firsts": ["ranked"]}


@query(sql("SELECT r.learner, r.name, string_agg(concat(pid, '/', target, '/', CAST(depth AS VARCHAR)), ',' ORDER BY i) AS evidences, concat('该概念被 ', CAST(count(*) AS VARCHAR), ' 条错题证据命中，关联考查概念包括「', any_value(f.targets), '」，建议优先排查。') AS reason FROM ranked r JOIN firsts f ON f.learner = r.learner AND f.name = r.name GROUP BY r.learner, r.name", "ranked", "firsts"))
def trace_evidences(s, d):
    a = D.aggregate(D.trace(W.attempts(s, d), base._tested(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d)))
    each = F.transform("evidences", lambda e: F.concat_ws("/", e["pid"], e["target_concept"], e["depth"].cast("string")))
    return a.select("learner", "name", F.array_join(each, ",").alias("evidences"), "reason")


VIEWS["why"] = "SELECT learner, name, string_agg(DISTINCT pid, ', ' ORDER BY pid) AS pids, string_agg(DISTINCT target, '、' ORDER BY target) AS targets FROM wrongs GROUP BY learner, name"
VIEWS["against"] = "SELECT a.learner, t.target AS name, string_agg(DISTINCT a.pid, ', ' ORDER BY a.pid) AS pids FROM attempts a JOIN tests t ON t.source = a.pid WHERE a.correct GROUP BY a.learner, t.target"
NEEDS |= {"why": ["wrongs"], "against": ["attempts", "tests"]}


@query(sql("SELECT m.learner, m.name, concat(CASE WHEN w.pids IS NULL THEN concat('概念「', m.name, '」暂无错题命中') ELSE concat('概念「', m.name, '」由错题 ', w.pids, ' 命中，关联考查概念包括「', w.targets, '」') END, '，weakness=', CAST(weakness AS VARCHAR), '，风险等级为 ', risk, CASE WHEN g.pids IS NULL THEN '' ELSE concat('；但正确题 ', g.pids, ' 提供了反证，因此已适当下调薄弱分') END, '。') AS reason FROM risked m JOIN concept c ON c.name = m.name LEFT JOIN why w ON w.learner = m.learner AND w.name = m.name LEFT JOIN against g ON g.learner = m.learner AND g.name = m.name", "risked", "why", "against"))
def mastery_reasons(s, d):
    return D.mastery_report(W.attempts(s, d), base._tested(s, d), W.concept(s, d), W.prereq(s, d), closure=L.closure(s, d)).select("learner", "name", "reason")


@query(sql("SELECT pid, stem, ord FROM problems WHERE pid IN (SELECT source FROM tests) ORDER BY ord LIMIT 2", "problems", "tests"))
def first_tested_pids(s, d):
    return D.first_tested_pids(_problems(s, d), W.tests(s, d)).select("pid", "stem", "ord")


@query(sql("SELECT DISTINCT t.source AS pid, p.stem FROM tests t LEFT JOIN problems p ON p.pid = t.source AND p.stem LIKE '%H'", "tests", "problems"))
def problem_lookup(s, d):
    return D.problems_by_pid(W.tests(s, d).select(F.col("source").alias("pid")), _problems(s, d).where("stem like '%H'")).select("pid", "stem")


@query(sql("SELECT p.pid, p.stem, coalesce(string_agg(t.target, ',' ORDER BY t.ord, t.target), '') AS tested FROM problems p LEFT JOIN (SELECT t.* FROM tests t JOIN concept c ON c.name = t.target) t ON t.source = p.pid GROUP BY p.pid, p.stem", "problems", "tests", "concept"))
def tested_summary(s, d):
    return D.tested_summary(_problems(s, d), base._tested(s, d)).select("pid", "stem", F.array_join("tested_concepts", ",").alias("tested"))


# edges -------------------------------------------------------------------

VIEWS["term"] = "SELECT alias AS term, arg_min(name, ord) AS canonical FROM concept GROUP BY alias UNION ALL SELECT name, name FROM concept"
VIEWS["worded"] = "SELECT CASE l_returnflag WHEN 'A' THEN concat('O', CAST(l_orderkey AS VARCHAR)) ELSE p_name END AS source, concat('P', CAST(l_suppkey AS VARCHAR)) AS target, CASE l_returnflag WHEN 'A' THEN 'TESTS' WHEN 'R' THEN 'SOLVES' ELSE 'CONFUSABLE' END AS type, l_linestatus AS dimensions FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"
NEEDS["term"] = ["concept"]


@query(sql("SELECT coalesce(CASE WHEN w.type <> 'TESTS' THEN t.canonical END, w.source) AS source, w.target, w.type, CASE WHEN w.type = 'CONFUSABLE' THEN dimensions END AS dimensions, count(*) AS n FROM worded w JOIN concept b ON b.name = w.target LEFT JOIN term t ON t.term = w.source LEFT JOIN concept a ON a.name = t.canonical WHERE CASE w.type WHEN 'TESTS' THEN w.source IN (SELECT pid FROM problems WHERE stem LIKE '%H') WHEN 'SOLVES' THEN a.node_role IN ('算法', '机制') ELSE a.name IS NOT NULL END AND coalesce(CASE WHEN w.type <> 'TESTS' THEN t.canonical END, w.source) <> w.target GROUP BY ALL", "worded", "concept", "term", "problems"))
def edge_validate_aliases(s, d):
    li = W.table(s, d, "lineitem").join(W.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    kind = F.when(F.col("l_returnflag") == "A", "TESTS").when(F.col("l_returnflag") == "R", "SOLVES").otherwise("CONFUSABLE")
    source = F.when(kind == "TESTS", W.key("O", F.col("l_orderkey"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit("\t")))
    raw = li.select(source.alias("source"), W.key("P", F.col("l_suppkey")).alias("target"), kind.alias("type"), F.lit("").alias("description"), F.col("l_linestatus").alias("dimensions"), F.col("l_orderkey").alias("ord"))
    c = W.concept(s, d)
    out = E.validate(raw, J.terms(c), c, _problems(s, d).where("stem like '%H'").select("pid"))
    return out.groupBy("source", "target", "type", "dimensions").agg(F.count("*").alias("n"))


@query(sql("SELECT source, target, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN description = 'O' THEN 1 ELSE 0 END, ord) AS r FROM raw_edges WHERE type = 'PREREQUISITE') t WHERE r <= 10 GROUP BY source, target", "raw_edges"))
def out_degree_trim_weak(s, d):
    worded = F.when(F.col("description") == "O", "与后者相关").otherwise("是其基础")
    raw = W.raw_edges(s, d).where("type = 'PREREQUISITE'").withColumn("description", worded)
    return E.trim_out_degree(raw).groupBy("source", "target").agg(F.count("*").alias("n"))


VIEWS["top"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY difficulty DESC, ord) AS r FROM concept) t WHERE r <= 25"
NEEDS["top"] = ["concept"]


@query(sql("SELECT x.a AS source_chapter, x.b AS target_chapter, s.name AS source, t.name AS target FROM (SELECT DISTINCT a.chapter AS a, b.chapter AS b FROM prereq p JOIN concept a ON a.name = p.source JOIN concept b ON b.name = p.target WHERE a.chapter <> b.chapter) x JOIN top s ON s.chapter = x.a JOIN top t ON t.chapter = x.b", "prereq", "top"))
def chapter_pairs(s, d):
    c = W.concept(s, d)
    a, b = (c.select(F.col("name").alias(x), F.col("chapter").alias(f"{x}_chapter")) for x in ("source", "target"))
    pairs = W.prereq(s, d).join(a, "source").join(b, "target").select("source_chapter", "target_chapter")
    return E.chapter_pairs(c, pairs).select("source_chapter", "target_chapter", "source", "target")


@query(sql("SELECT chapter, CAST(greatest(0, CAST(ceil((n - 20) / 15.0) AS INT)) + 1 AS BIGINT) AS batches, n AS concepts FROM (SELECT chapter, count(*) AS n FROM concept GROUP BY chapter) t", "concept"))
def batch_counts(s, d):
    return E.batch_counts(E.chapter_batches(W.concept(s, d)))


@query(sql("SELECT DISTINCT p.source, p.target FROM prereq p JOIN concept a ON a.name = p.source JOIN concept b ON b.name = p.target WHERE a.difficulty = 3 AND b.difficulty = 3 ORDER BY p.source, p.target LIMIT 30", "prereq", "concept"))
def known_pairs(s, d):
    return E.known_pairs(W.prereq(s, d), W.concept(s, d).where("difficulty = 3"))


@query("SELECT confidence, name_a, name_b FROM (SELECT 0.8 + l_discount AS confidence, concat('P', CAST(l_partkey AS VARCHAR)) AS name_a, concat('P', CAST(l_suppkey AS VARCHAR)) AS name_b FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N') t WHERE confidence >= 0.85 ORDER BY confidence DESC, name_a, name_b LIMIT 50")
def rejected_pairs(s, d):
    li = W.table(s, d, "lineitem")
    decision = F.when(F.col("l_returnflag") != "N", F.struct((F.col("l_linestatus") == "O").alias("merge")))
    report = li.select((F.lit(0.8) + F.col("l_discount")).alias("confidence"), W.key("P", F.col("l_partkey")).alias("name_a"), W.key("P", F.col("l_suppkey")).alias("name_b"), decision.alias("decision"))
    return E.rejected_pairs(report).select("confidence", "name_a", "name_b")


# concepts ----------------------------------------------------------------


@query(sql("SELECT alias AS name, string_agg(name, ',' ORDER BY name) AS aliases, arg_min(definition, ord) AS definition FROM concept GROUP BY alias", "concept"))
def concept_dedupe_aliases(s, d):
    c = W.concept(s, d).select(F.get("aliases", 0).alias("name"), F.array("name").alias("aliases"), "definition", "chapter", "difficulty", "node_role", "ord")
    return C.dedupe(c).select("name", F.array_join("aliases", ",").alias("aliases"), "definition")


@query(sql("SELECT h.name AS name_a, c.name AS name_b, lower(c.alias) AS matched_key, CAST(1 AS DOUBLE) AS confidence FROM concept c JOIN (SELECT alias, min(ord) AS o, arg_min(name, ord) AS name FROM concept GROUP BY alias) h ON h.alias = c.alias AND c.ord > h.o", "concept"))
def alias_candidate_keys(s, d):
    return C.alias_candidates(W.concept(s, d)).select("name_a", "name_b", "matched_key", "confidence")


VIEWS["asked_names"] = "SELECT DISTINCT concat(' ', upper(alias)) AS name, lower(alias) AS k FROM concept UNION ALL SELECT lower(name), lower(name) FROM concept UNION ALL SELECT concat(name, '?'), concat(lower(name), '?') FROM concept"
VIEWS["folded"] = "SELECT k, arg_min(name, ord) AS canonical FROM (SELECT lower(alias) AS k, name, ord FROM concept UNION ALL SELECT lower(name), name, ord FROM concept) t GROUP BY k"
NEEDS |= {"asked_names": ["concept"], "folded": ["concept"]}


@query(sql("SELECT a.name, f.canonical FROM asked_names a LEFT JOIN folded f ON f.k = a.k", "asked_names", "folded"))
def resolve_folded(s, d):
    c = W.concept(s, d)
    names = c.select(F.concat(F.lit(" "), F.upper(F.get("aliases", 0))).alias("name")).distinct().union(c.select(F.lower("name"))).union(c.select(F.concat("name", F.lit("?"))))
    return C.resolve_folded(names, c)


VIEWS["pairs_found"] = "SELECT h.o AS a, c.ord AS b, 0 AS kind, CAST(1 AS DOUBLE) AS conf FROM concept c JOIN (SELECT alias, min(ord) AS o FROM concept GROUP BY alias) h ON h.alias = c.alias AND c.ord > h.o UNION ALL SELECT p.ord // 2 // 2, p.ord // 2, 1, (80 + p.ord % 20) / CAST(100 AS DOUBLE) FROM prereq p WHERE p.ord % 2 = 0"
NEEDS["pairs_found"] = ["concept", "prereq"]


@query(sql("SELECT a AS idx_a, b AS idx_b, CASE kind WHEN 0 THEN 'alias_match' ELSE 'embedding' END AS source, CAST(p AS BIGINT) AS p_ord, CAST((p - 1) // 15 AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (ORDER BY kind, conf DESC, a, b) AS p FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY kind, conf DESC) AS r FROM pairs_found) t WHERE r = 1) u", "pairs_found"))
def review_order(s, d):
    c = W.concept(s, d)
    k = F.floor(F.col("ord") / 2)
    embed = W.prereq(s, d).where("ord % 2 = 0").select(F.floor(k / 2).alias("idx_a"), k.alias("idx_b"), F.col("source").alias("name_a"), F.col("target").alias("name_b"), ((80 + F.col("ord") % 20) / F.lit(100.0)).alias("confidence"))
    return C.review_batches(C.candidates(C.alias_candidates(c), embed)).select("idx_a", "idx_b", "source", F.col("p_ord").cast("long").alias("p_ord"), F.col("batch").cast("long").alias("batch"))


@query(sql("SELECT alias AS name, count(*) AS merged, arg_min(name, ord) AS first FROM (SELECT * FROM concept) t GROUP BY alias", "concept"))
def merge_by_alias(s, d):
    """Concepts that share an alias, all pairs approved: one concept an alias, named by its first."""
    c = W.concept(s, d)
    found = C.review_batches(C.candidates(C.alias_candidates(c), C.alias_candidates(c).limit(0)))
    decided = found.select(F.col("p_ord").cast("int").alias("p_ord"), "name_a", "name_b", F.lit(True).alias("merge"), F.col("name_a").alias("canonical"))
    out = C.apply_decisions(c, decided)
    shared = F.element_at(F.filter("aliases", lambda a: ~a.startswith("P")), 1)
    return out.select(shared.alias("name"), F.col("merged").cast("long").alias("merged"), F.col("name").alias("first"))


# sources -----------------------------------------------------------------


@query(sql("SELECT term, canonical FROM term", "term"))
def term_table(s, d):
    return J.terms(W.concept(s, d)).select("term", "canonical")


@query(sql("SELECT name AS canonical, name AS term FROM concept UNION SELECT name, alias FROM concept", "concept"))
def search_terms(s, d):
    return J.search_terms(W.concept(s, d)).select("canonical", "term")


def _halves(s, d):
    c = W.concept(s, d).select(F.get("aliases", 0).alias("alias"), "name", "difficulty", "ord")
    return c.where("difficulty = 1").drop("difficulty"), c.where("difficulty <> 1").drop("difficulty")


@query(sql("SELECT alias, arg_max(name, (CASE WHEN difficulty = 1 THEN 0 ELSE 1 END, ord)) AS name FROM concept GROUP BY alias", "concept"))
def upsert_last(s, d):
    old, new = _halves(s, d)
    return J.upsert(old, new, "alias").select("alias", "name")


@query(sql("SELECT alias, arg_min(name, (CASE WHEN difficulty = 1 THEN 0 ELSE 1 END, ord)) AS name FROM concept GROUP BY alias", "concept"))
def merge_incremental(s, d):
    old, new = _halves(s, d)
    return J.merge_incremental(old, new, ["alias"]).select("alias", "name")


@query(sql("SELECT alias AS chunk_id, name FROM concept WHERE difficulty = 1 UNION ALL SELECT alias, name FROM concept WHERE difficulty <> 1 AND alias NOT IN (SELECT alias FROM concept WHERE difficulty = 1)", "concept"))
def append_chunks(s, d):
    old, new = (x.withColumnRenamed("alias", "chunk_id").select("chunk_id", "name") for x in _halves(s, d))
    return J.append_chunks(old, new)


# texts -------------------------------------------------------------------


@query("SELECT p_partkey, p_type IN ('SMALL', 'ECONOMY') AS hit, left(p_name, 5) || CASE WHEN length(p_name) > 5 THEN '…' ELSE '' END AS cut, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS BIGINT) AS es, CASE WHEN p_size % 2 = 0 THEN concat('CH', CAST(p_size AS VARCHAR)) ELSE left(regexp_replace(p_brand, '\\W', '', 'g'), 8) END AS prefix, round(least(30, 10 + log2(p_size + 1) * 3.5), 6) AS size, repeat('█', p_size // 5) AS bar, printf('%.2f%%', p_size / CAST(7 AS DOUBLE) * 100) AS accuracy, concat(p_name, ';', p_brand) AS parts FROM part")
def text_columns(s, d):
    p = W.table(s, d, "part")
    n = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    role = F.when(F.col("p_type").isin("SMALL", "ECONOMY"), "机制").otherwise("concept")
    return p.select(
        "p_partkey",
        X.is_chinese(role).alias("hit"),
        X.truncate(F.col("p_name"), 5).alias("cut"),
        X.count_of(F.col("p_name"), F.lit("e")).alias("es"),
        X.pid_prefix(F.col("p_brand"), n).alias("prefix"),
        F.round(X.node_size(F.col("p_size"), 10.0, 3.5, 30.0), 6).alias("size"),
        X.percent_bar(F.col("p_size")).alias("bar"),
        X.format_accuracy(F.col("p_size") / F.lit(7.0)).alias("accuracy"),
        F.array_join(X.parse_csv(F.concat("p_name", F.lit("， "), "p_brand", F.lit(",,"))), ";").alias("parts"),
    )


CUT = f"\\n{WHITE}*习{WHITE}*题{WHITE}*\\n"


@query(f"SELECT doc_id, b AS body, CASE WHEN t IS NULL THEN '' ELSE substr(t, length(b) + 1) END AS exercises FROM (SELECT doc_id, t, regexp_extract(t, '(?s)^(.*?){CUT}', 1) AS b FROM (SELECT doc_id, text || chr(10) || ' 习 题 ' || chr(10) || text AS t FROM documents) x) y")
def split_exercises(s, d):
    text = F.concat("text", F.lit("\n 习 题 \n"), "text")
    return W.table(s, d, "documents").select("doc_id", X.split_exercises(text).alias("x")).select("doc_id", "x.body", "x.exercises")


@query(sql("SELECT name, concat('概念名称：', name, chr(10), '定义：', definition, chr(10), '所属章节：', chapter, chr(10), '节点角色：', node_role, chr(10), '难度：', CAST(difficulty AS VARCHAR), chr(10), '别名：', alias) AS document FROM concept", "concept"))
def concept_documents(s, d):
    return R.concept_document(W.concept(s, d))


@query(sql("SELECT name, definition, chapter, node_role, difficulty FROM concept", "concept"))
def concept_metadata(s, d):
    return R.concept_metadata(W.concept(s, d))


LINE = "concat('- 名称：', c.name, '；角色：', c.node_role, '；难度：', CAST(c.difficulty AS VARCHAR), '；章节：', c.chapter, '；定义：', c.definition)"


@query(sql(f"SELECT n.root, concat('【概念部分】', chr(10), n.t, chr(10), chr(10), '【关系部分】', chr(10), coalesce(e.t, '无')) AS context FROM (SELECT root, string_agg({LINE}, chr(10) ORDER BY c.name) AS t FROM s1 JOIN concept c ON c.name = s1.node GROUP BY root) n LEFT JOIN (SELECT root, string_agg(concat('- ', source, ' -[', type, ']-> ', target, '：'), chr(10) ORDER BY source, target, type) AS t FROM (SELECT DISTINCT x.root, g.source, g.target, g.type FROM s1 x JOIN g ON g.source = x.node JOIN s1 y ON y.root = x.root AND y.node = g.target) u GROUP BY root) e ON e.root = n.root", "s1"))
def graph_contexts(s, d):
    return R.graph_context(*base._around(s, d, 1))


@query(sql(f"SELECT t.chapter AS query, string_agg(concat('- 名称：', t.name, '；定义：', c.definition), chr(10) ORDER BY t.rank) AS context FROM ({ORACLE_SQL['problem_candidates80']}) t JOIN concept c ON c.name = t.name GROUP BY t.chapter", "concept"))
def vector_contexts(s, d):
    c = W.concept(s, d)
    hits = E.problem_candidates(c).join(c.select("name", "definition"), "name").withColumnRenamed("chapter", "query")
    return R.vector_context(hits)


@query(f"SELECT query, string_agg(concat('片段 ', CAST(r AS VARCHAR), '（来源：', source, '；涉及概念：', hits, '）', chr(10), left(text, 600), CASE WHEN length(text) > 600 THEN '…' ELSE '' END), chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT item_id % 4 AS query, id, string_agg(DISTINCT concat('B', CAST(item_id AS VARCHAR)), '、' ORDER BY concat('B', CAST(item_id AS VARCHAR))) AS hits, row_number() OVER (PARTITION BY item_id % 4 ORDER BY count(DISTINCT item_id) DESC, concat('D', CAST(id AS VARCHAR))) AS r FROM ({base.MENTIONS}) t GROUP BY item_id % 4, id) u JOIN documents ON doc_id = id WHERE r <= 4 GROUP BY query")
def chunk_contexts(s, d):
    docs = W.table(s, d, "documents")
    chunks = docs.select(W.key("D", F.col("doc_id")).alias("chunk_id"), "text", F.col("source").alias("chapter"))
    terms = W.lexicon(s, d)
    asked = terms.select((F.col("ord") % 4).alias("query"), "canonical")
    hits = R.chunks_by_concepts(asked, chunks, terms).join(chunks.select("chunk_id", "chapter"), "chunk_id")
    return A.chunk_context(hits)


@query(sql("SELECT query, CAST(r AS INT) AS rank, id, round(1 / (1 + (1 - c)), 6) AS score FROM (SELECT q.vec_id AS query, v.vec_id AS id, round(list_dot_product(q.v, v.v) / (q.n * v.n), 6) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, v.v) / (q.n * v.n), 6) DESC, v.vec_id) AS r FROM vec q, vec v WHERE q.vec_id % 20 = 0) t WHERE r <= 5", "vec"))
def vector_topk_scores(s, d):
    # as vector_topk, with the scores
    return R.top_k(base._vectors(s, d).where("id % 20 = 0"), base._vectors(s, d))


@query(sql("SELECT c.name, concat('<div style=''max-width:340px;font-family:sans-serif;''><b style=''font-size:14px;''>', c.name, '</b><br/><span style=''color:#888888;font-size:12px;''>', chapter, ' · ', node_role, ' · 难度 ', CAST(difficulty AS VARCHAR), ' · 度 ', CAST(coalesce(degree, 0) AS VARCHAR), '</span><br/><i>别名：', alias, '</i><br/><span style=''font-size:12px;''>', definition, '</span></div>') AS tooltip FROM concept c LEFT JOIN (" + base.DEGREE + ") d ON d.name = c.name", "concept", "edges"))
def tooltips(s, d):
    return A.tooltips(W.concept(s, d), G.degrees(W.edges(s, d)), "#888888")


# questions ---------------------------------------------------------------


def _sequence(kinds: tuple[str, ...], place: int, limit: int) -> str:
    t = [("pe" if k == Q.P else "se", f"t{i}") for i, k in enumerate(kinds)]
    nodes = ["t0.source", *[f"t{i}.target" for i in range(len(t))]]
    joins = " ".join(f"JOIN {v} {a} ON {a}.source = t{i}.target" for i, (v, a) in enumerate(t[1:]))
    apart = " AND ".join(f"{a} <> {b}" for i, a in enumerate(nodes) for b in nodes[:i])
    orders = [f"t{i}.ord" if i < len(t) else "0" for i in range(3)]
    kind = {(Q.P,): "PREREQUISITE_DIRECT", (Q.SV,): "SOLVES_DIRECT"}.get(kinds, "_".join(kinds))
    rows = f"SELECT concat_ws('>', {', '.join(nodes)}) AS path, {nodes[0]} AS a, {nodes[-1]} AS b, {len(t)} AS hops, '{kind}' AS type, {place} AS seq, {', '.join(f'{o} AS o{i}' for i, o in enumerate(orders))} FROM {t[0][0]} t0 {joins} WHERE {apart}"
    return f"(SELECT * FROM ({rows}) r QUALIFY row_number() OVER (PARTITION BY path ORDER BY o0, o1, o2) = 1 ORDER BY o0, o1, o2 LIMIT {limit})"


def questions_sql(over: str = "{}") -> str:
    """SQL over the question set (path, hops, type, grp)."""
    groups = [[(Q.P,), (Q.SV,)], [(Q.P, Q.P)], [(Q.P, Q.SV)], [(Q.SV, Q.SV)], list(Q.SEQUENCES)]
    limit, by, out = Q.PER_TYPE * Q.MULTIPLIER, "seq, o0, o1, o2", []
    for g, seqs in enumerate(groups):
        found = " UNION ALL ".join(_sequence(k, i, limit) for i, k in enumerate(seqs))
        top = f"SELECT * FROM (SELECT * FROM ({found}) f QUALIFY row_number() OVER (PARTITION BY path ORDER BY {by}) = 1) q ORDER BY {by} LIMIT {limit}"
        taken = " AND ".join(f"(a, b) NOT IN (SELECT (a, b) FROM chosen{i})" for i in range(g)) or "true"
        VIEWS[f"chosen{g}"] = f"SELECT *, {g} AS grp FROM (SELECT * FROM ({top}) t QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY {by}) = 1) u WHERE {taken} ORDER BY {by} LIMIT {Q.PER_TYPE}"
        NEEDS[f"chosen{g}"] = ["pe", "se", *[f"chosen{i}" for i in range(g)]]
        out.append(f"SELECT path, hops, type, grp FROM chosen{g}")
    return sql(over.format(" UNION ALL ".join(out)), *[f"chosen{g}" for g in range(len(groups))])


@query(questions_sql())
def multihop_set_paths(s, d):
    q = Q.question_set(W.edges(s, d, "PREREQUISITE", "SOLVES"), W.concept(s, d))
    return q.select(F.array_join("path", ">").alias("path"), "hops", "type", "grp")
