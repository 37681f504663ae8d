"""Results that do not depend on size, and what keeps their way small."""

from pyspark.sql import functions as F

from cairn.operators import concepts as C
from cairn.operators import diagnosis as D
from cairn.operators import graph as G
from cairn.operators import planning as P
from cairn.operators import retrieval as R


def test_links_of_a_name_are_a_row_a_concept(spark):
    c = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("name"), F.array(F.lit("Same")).alias("aliases"), F.col("id").alias("ord"))
    got = C.alias_links(c)
    assert [tuple(r) for r in got.groupBy("matched_key", "first", "links").count().collect()] == [("same", "c0", 1999, 2000)]


def test_a_definition_of_many_is_searched_once(spark, monkeypatch):
    c = spark.range(500).select(F.concat(F.lit("c"), "id", F.lit(".")).alias("name"), F.lit("about c7. only").alias("definition"), F.col("id").alias("ord"))
    seen, search = [], R.mentions
    monkeypatch.setattr(R, "mentions", lambda texts, terms: seen.append(texts.count()) or search(texts, terms))
    got = R.definition_candidates(c, c.select(F.col("name").alias("term"), F.col("name").alias("canonical")), spark.createDataFrame([("c7.", "c0.")], "source string, target string"), 1000)
    assert seen == [1]
    assert {(r["source"], r["target"]) for r in got.collect()} == {("c7.", f"c{i}.") for i in range(500) if i not in (0, 7)}


def _graph(spark):
    # a chain of 200 with a second way past every third
    ways = [(f"n{i}", f"n{i + 1}") for i in range(199)] + [(f"n{i}", f"n{i + 2}") for i in range(0, 198, 3)] + [("n5", "n5")]
    names = spark.range(200).select(F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("difficulty"), F.lit("k").alias("chapter"), F.lit("r").alias("node_role"), F.lit("d").alias("definition"))
    return names, spark.createDataFrame(ways, "source string, target string")


def test_plans_do_not_shuffle_what_learners_concepts_come_to(spark):
    names, prereq = _graph(spark)
    attempts = spark.range(50).select(F.col("id").alias("learner"), F.concat(F.lit("p"), F.col("id")).alias("pid"), F.lit(True).alias("wrong"), F.lit(False).alias("correct"))
    tested = spark.range(50).select(F.concat(F.lit("p"), "id").alias("pid"), F.concat(F.lit("n"), F.col("id") * 3).alias("target"), F.lit(1).alias("ord"))
    plan = D.mastery(attempts, tested, names, prereq)._jdf.queryExecution().optimizedPlan().toString()
    # one exchange by learner is asked for, below the explode: rows are taken apart where they stay
    assert plan.index("Generate explode(bases") < plan.index("RepartitionByExpression [learner")


def test_edges_at_the_end_of_a_subgraph(spark):
    names, prereq = _graph(spark)
    weak = spark.range(20, 200, 7).select((F.col("id") % 3).alias("learner"), F.concat(F.lit("n"), "id").alias("name"))
    closure = [tuple(r) for r in D.closure_of(names, prereq).select("root", "node").collect()]
    reach, want = {}, set()
    for r, n in closure:
        reach.setdefault(r, set()).add(n)
    for w in weak.collect():
        want |= {(w["learner"], s, t) for s, t in map(tuple, prereq.collect()) if {s, t} <= reach[w["name"]]}
    got = [tuple(r) for r in P.plan_edges(weak, names, prereq).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_pairs_in_large_blocks_of_tiles(spark):
    v = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("vec"))
    every = [tuple(r) for r in R.similar_pairs(v, 0.9).select("a", "b").collect()]
    few = [tuple(r) for r in R._all_blocks(R.usable(v), 2, 0.9, 40).where("round(confidence, 4) >= 0.9").select("a", "b").collect()]
    assert len(few) == len(set(few)) and set(few) == set(every) and len(every) > 300


def test_wide_tables_are_spread(spark):
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.range(100).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"), F.lit("RELATED").alias("type"), F.col("id").alias("ord"))
    assert G.neighbour_groups(edges).rdd.getNumPartitions() == n


def test_rounds_of_a_cycle_search_broadcast_nothing(spark, monkeypatch):
    plans, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name="table": plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e")], "source string, target string")
    assert {r[0] for r in G.cycle_residue(edges).collect()} == {"a", "b", "c"}
    assert plans and not any("BroadcastExchange" in p for p in plans)
