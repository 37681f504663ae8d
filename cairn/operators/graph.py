"""Graph queries as joins over an edge table (source, target, type, description, ord).

Bounded traversals unroll into one join a hop, with no action in between.
Fixpoints write each round to shared storage; only a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.session import materialize, spread
from cairn.sources.frames import keep_first, numbered_over_all


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected types in both directions, the others as they are."""
    back = edges.where(F.col("type").isin(*S.UNDIRECTED)).withColumns({"source": F.col("target"), "target": F.col("source")})
    return edges.unionByName(back)


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """Edges of the requested types; names that are no edge type are passed over."""
    wanted = S.DEFAULT_EDGE_TYPES if types is None else types
    return edges.where(F.col("type").isin(*[t for t in wanted if t in S.EDGE_TYPES]))


def nodes_with_phantoms(concepts: DataFrame, problems: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): concepts and problems, and with a null label the endpoints that neither table has.

    An id in both tables is a Problem, as the table that is loaded last has it.
    """
    known = concepts.select(F.col("name").alias("id"), F.lit("Concept").alias("label"), F.lit(1).alias("r")).unionByName(problems.select(F.col("pid").alias("id"), F.lit("Problem").alias("label"), F.lit(0).alias("r")))
    known = known.groupBy("id").agg(F.min_by("label", "r").alias("label"))
    return endpoints(edges).join(known, "id", "full_outer").select("id", "label")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def visited(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(root, node, depth): shortest distance from each root along edges in either direction, up to `hops`.

    seeds: (root, node). Roots are searched together, each by itself.
    """
    links = edges.select("source", "target").distinct()
    both = links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return _spread(seeds, both, hops)


def ancestors(roots: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS) -> DataFrame:
    """(root, node, depth): prerequisites of each root with their shortest distance; the root itself at 0.

    roots: one column, root.
    """
    up = prereq.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return _spread(roots.select("root", F.col("root").alias("node")), up, max_hops)


def _spread(seeds: DataFrame, steps: DataFrame, hops: int) -> DataFrame:
    """One chain of joins: what was reached stays, what the last level reached takes a step, and the least depth is kept."""
    found = seeds.distinct().withColumn("depth", F.lit(0))
    for d in range(1, hops + 1):
        went = found.join(steps, (found["node"] == steps["source"]) & (found["depth"] == d - 1), "left")
        both = F.array(F.struct("node", "depth"), F.struct(F.col("target").alias("node"), F.lit(d).alias("depth")))
        # a groupBy a level: the number of walks grows much faster than the number of nodes reached
        found = went.select("root", F.explode(both).alias("x")).where("x.node IS NOT NULL").groupBy("root", F.col("x.node").alias("node")).agg(F.min("x.depth").alias("depth"))
    return found


def subgraph(seeds: DataFrame, concepts: DataFrame, edges: DataFrame, types: list[str] | None = None, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """k-hop neighbourhood of seed nodes: (nodes, edges), for each root by itself.

    seeds: (root, node); those that are no node of the graph are passed over.
    Other nodes than concepts are walked through, not returned, but edges that
    touch them are. An undirected edge comes once, ends in string order; of
    parallel edges the first.
    """
    allowed = of_types(edges, types)
    known = concepts.select(F.col("name").alias("node")).unionByName(endpoints(edges).select(F.col("id").alias("node"))).distinct()
    reach = visited(seeds.join(known, "node", "left_semi"), allowed, hops)
    nodes = reach.join(concepts, reach["node"] == concepts["name"]).select("root", "name", "definition", "chapter", "difficulty", "node_role", "depth")
    a = reach.select("root", F.col("node").alias("source"))
    b = reach.select("root", F.col("node").alias("target"))
    inside = allowed.join(a, "source").join(b, ["root", "target"], "left_semi")
    flip = F.col("type").isin(*S.UNDIRECTED)
    ends = inside.select("root", F.when(flip, F.least("source", "target")).otherwise(F.col("source")).alias("source"), F.when(flip, F.greatest("source", "target")).otherwise(F.col("target")).alias("target"), "type", "description", "ord")
    return nodes, keep_first(ends, ["root", "source", "target", "type"], ["ord", "description"]).drop("ord")


def prereq_subgraph(roots: DataFrame, concepts: DataFrame, prereq: DataFrame, max_hops: int = S.MAX_HOPS) -> tuple[DataFrame, DataFrame]:
    """Ancestors that are concepts with their depth, and the prerequisite edges among all ancestors."""
    reach = ancestors(roots, prereq, max_hops)
    nodes = reach.join(concepts, reach["node"] == concepts["name"]).select("root", "name", "depth", "definition", "chapter", "difficulty", "node_role")
    inside = prereq.join(reach.select("root", F.col("node").alias("source")), "source").join(reach.select("root", F.col("node").alias("target")), ["root", "target"], "left_semi")
    return nodes, inside.select("root", "source", "target")


def cycle_residue(prereq: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(name): the nodes that remain when nodes without incoming edges are taken away until none is left: on or behind a cycle.

    A node with one predecessor goes or stays with it. So each round first passes
    such nodes on to the first node up their line that has none or several, by
    pointer doubling, and then takes away what has none: chains and trees of any
    depth take a logarithmic number of rounds, other graphs one for each layer in
    which lines meet. `rounds` is filled with the edges of each round.
    """
    edges = materialize(prereq.select("source", "target").distinct(), "cycle")
    nodes = materialize(endpoints(edges).select(F.col("id").alias("name"), F.col("id").alias("stands")), "stands")
    while True:
        into = edges.groupBy(F.col("target").alias("v")).agg(F.count("*").alias("n"), F.min("source").alias("up"))
        single = into.where("n = 1 AND v <> up").select("v", "up")
        top = _tops(single, rounds)
        # a node whose line leads round in a ring stands for itself, and the ring stays
        stood = nodes.join(top.select(F.col("v").alias("stands"), F.col("up").alias("_top")).hint("merge"), "stands", "left")
        nodes = materialize(stood.select("name", F.coalesce("_top", "stands").alias("stands")), "stands")
        a, b = (top.select(F.col("v").alias(x), F.col("up").alias(f"_{x}")).hint("merge") for x in ("source", "target"))
        moved = edges.join(a, "source", "left").join(b, "target", "left").select(F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"), F.col("_target").isNotNull().alias("inner"))
        # the one edge that led into a passed-on node is gone with it; one that leads back to its own line is a loop that stays
        moved = materialize(moved.where("NOT inner").select("source", "target").distinct(), "cycle")
        heads = moved.select(F.col("target").alias("source")).distinct()
        rest = materialize(moved.join(heads.hint("merge"), "source", "left_semi"), "cycle")
        left = rest.count()
        if rounds is not None:
            rounds.append(left)
        if left == moved.count() and top.isEmpty():
            alive = endpoints(rest).select(F.col("id").alias("stands"))
            return nodes.join(alive.hint("merge"), "stands", "left_semi").select("name")
        if not left:
            return nodes.select("name").limit(0)
        edges = rest


def _tops(single: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(v, up): for nodes with one way up (v, up), the node at which their ways end. Nodes whose way leads round in a ring are left out."""
    hop = materialize(single.withColumn("open", F.lit(True)), "hops")
    n = hop.count()
    for _ in range(n.bit_length() + 1):  # one more, in which the longest way is seen to have ended
        on = hop.select(F.col("v").alias("up"), F.col("up").alias("far"))
        hop = materialize(hop.join(on.hint("merge"), "up", "left").select("v", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("open")), "hops")  # not broadcast: a round's table would come to the driver
        if rounds is not None:
            rounds.append(n)
        if hop.where("open").isEmpty():
            break
    return hop.where("NOT open").select("v", "up")


def find_cycle(prereq: DataFrame) -> DataFrame:
    """(pos, source, target): the edges of one cycle in the order of its way, or no row where there is none.

    Of the residue each node takes its least predecessor in it: following these
    leads into a ring from everywhere. After as many steps as there are nodes, by
    doubling, only nodes of rings are met; the ring with the least node is given,
    from that node on.
    """
    edges = prereq.select("source", "target").distinct()
    residue = materialize(cycle_residue(prereq), "residue")
    inside = induced(edges, residue)
    back = materialize(inside.groupBy(F.col("target").alias("v")).agg(F.min("source").alias("up")), "back")
    n = back.count()
    if not n:
        return prereq.sparkSession.createDataFrame([], f"pos long, source {prereq.schema['source'].dataType.simpleString()}, target {prereq.schema['source'].dataType.simpleString()}")
    jump = back
    for _ in range(n.bit_length()):
        on = jump.select(F.col("v").alias("up"), F.col("up").alias("far"))
        jump = materialize(jump.join(on, "up").select("v", F.col("far").alias("up")), "jump")
    ring = materialize(back.join(jump.select(F.col("up").alias("v")).distinct(), "v", "left_semi"), "ring")
    # the least node of each ring, and how far up the way it is met
    low = ring.select("v", "up", F.least("v", "up").alias("low"))
    for _ in range(n.bit_length()):
        on = low.select(F.col("v").alias("up"), F.col("up").alias("far"), F.col("low").alias("more"))
        low = materialize(low.join(on, "up").select("v", F.col("far").alias("up"), F.least("low", "more").alias("low")), "low")
    start = low.agg(F.min("low")).first()[0]
    mine = low.where(F.col("low") == F.lit(start)).select("v")
    hop = ring.join(mine, "v", "left_semi").select("v", "up", F.lit(1).cast("long").alias("k"))
    # the start is nobody's further way: distances end there
    hop = materialize(hop.select("v", "up", F.when(F.col("v") == F.lit(start), 0).otherwise(F.col("k")).cast("long").alias("k")), "rank")
    total = hop.count()
    for _ in range(total.bit_length()):
        on = hop.where(F.col("v") != F.lit(start)).select(F.col("v").alias("up"), F.col("up").alias("far"), F.col("k").alias("more"))
        step = hop.where(F.col("v") != F.lit(start)).join(on, "up", "left")
        hop = materialize(step.select("v", F.coalesce("far", "up").alias("up"), (F.col("k") + F.coalesce("more", F.lit(0))).alias("k")).unionByName(hop.where(F.col("v") == F.lit(start)).select("v", "up", "k")), "rank")
    # k is the way from the start down to v, so v is the k-th node after it; its edge comes from the one before
    return ring.join(hop.select("v", "k"), "v").select(F.pmod(F.col("k") - 1, F.lit(total)).cast("long").alias("pos"), F.col("up").alias("source"), F.col("v").alias("target"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(name, component): the least node of each node's strongly connected component.

    Nodes that nothing leads to, or that lead nowhere, are components by
    themselves and are trimmed, chains of them as in cycle_residue(). Among the rest
    every node takes the colour of the least node that reaches it; the nodes of a
    colour that reach its node in turn are a component, and the others go on.
    """
    links = materialize(edges.select("source", "target").where("source <> target").distinct(), "links")
    every = endpoints(edges).select(F.col("id").alias("name"))
    found = None
    while True:
        # between cycles: behind one, and before one
        behind = cycle_residue(links)
        links = materialize(induced(links, behind), "links")
        turned = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
        links = materialize(induced(links, cycle_residue(turned)), "links")
        if links.isEmpty():
            break
        colour = _least_reaching(links, endpoints(links).select(F.col("id").alias("v"), F.col("id").alias("c")))
        ends = links.join(colour.select(F.col("v").alias("source"), F.col("c").alias("cs")), "source").join(colour.select(F.col("v").alias("target"), F.col("c").alias("ct")), "target")
        same = materialize(ends.where("cs = ct").select(F.col("target").alias("source"), F.col("source").alias("target"), "cs"), "same")
        mark = colour.select("v", F.when(F.col("v") == F.col("c"), F.col("c")).alias("c"))
        back = _least_reaching(same.select("source", "target"), mark).where("c IS NOT NULL").select(F.col("v").alias("name"), F.col("c").alias("component"))
        back = materialize(back, "component")
        found = back if found is None else found.unionByName(back)
        links = materialize(links.join(back.select(F.col("name").alias("source")), "source", "left_anti").join(back.select(F.col("name").alias("target")), "target", "left_anti"), "links")
    if found is None:
        return every.select("name", F.col("name").alias("component"))
    return every.join(found, "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def _least_reaching(links: DataFrame, start: DataFrame) -> DataFrame:
    """(v, c): the least c that reaches v along links, from start (v, c); null where none does. Ways get twice as long each round."""
    now = materialize(start, "colour")
    # pointers to the least known origin are followed as well as edges, so that long ways are not walked step by step
    while True:
        near = links.join(now.select(F.col("v").alias("source"), "c"), "source").select(F.col("target").alias("v"), "c")
        far = now.where("c IS NOT NULL").select("v", F.col("c").alias("_c")).join(now.select(F.col("v").alias("_c"), "c"), "_c").select("v", "c")
        next_ = materialize(now.unionByName(near).unionByName(far).groupBy("v").agg(F.min("c").alias("c")), "colour")
        if next_.join(now.select("v", F.col("c").alias("_old")), "v").where("NOT (c <=> _old)").isEmpty():
            return next_
        now = next_


def has_no_cycles(prereq: DataFrame) -> bool:
    return cycle_residue(prereq).isEmpty()


def isolated(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    return concepts.join(endpoints(edges), concepts["name"] == F.col("id"), "left_anti").select("name")


def degrees(edges: DataFrame) -> DataFrame:
    """(name, degree): ends of edges at each node; an undirected edge counts twice at both."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("name"), F.when(F.col("type").isin(*S.UNDIRECTED), 2).otherwise(1).alias("w"))
    return ends.groupBy("name").agg(F.sum("w").cast("long").alias("degree"))


def top_degrees(concepts: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    d = concepts.select("name").join(degrees(edges), "name", "left").select("name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return d.orderBy(F.desc("degree"), "name").limit(n)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among nodes (a column, name)."""
    return induced_at(induced_at(edges, nodes, "source"), nodes, "target")


def induced_at(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    return edges.join(nodes.select(F.col("name").alias(end)), end, "left_semi")


def type_counts(edges: DataFrame) -> DataFrame:
    """Edges of each type, an undirected one once."""
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def coverage(concepts: DataFrame, prereq: DataFrame) -> DataFrame:
    """(chapter, concepts, with_prereq) and, with a null chapter, the total; a missing chapter is 未知."""
    marked = _marked(concepts, prereq)
    return marked.rollup("chapter").agg(F.count("*").alias("concepts"), F.count_if("has").alias("with_prereq"))


def coverage_by_chapter(concepts: DataFrame, prereq: DataFrame) -> DataFrame:
    return _marked(concepts, prereq).groupBy("chapter").agg(F.count("*").alias("concepts"), F.count_if("has").alias("with_prereq"))


def _marked(concepts: DataFrame, prereq: DataFrame) -> DataFrame:
    chapter = F.coalesce(F.nullif(F.col("chapter"), F.lit("")), F.lit("未知"))
    ends = endpoints(prereq)
    return concepts.join(ends, concepts["name"] == ends["id"], "left").select(chapter.alias("chapter"), F.col("id").isNotNull().alias("has"))


def label_set(concepts: DataFrame, edges: DataFrame, target: int, min_degree: int = 3) -> DataFrame:
    """Which nodes show a label: all of up to 80, else the `target` of highest degree that have at least min_degree (1 up to 200 nodes)."""
    d = concepts.select("name").join(degrees(edges), "name", "left").select("name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    n = concepts.agg(F.count("*").alias("n"))
    least = F.when(F.col("n") <= 200, 1).otherwise(min_degree)
    # the target is a report's size, so the top is cut without ranking all rows in one task
    top = d.orderBy(F.desc("degree"), "name").limit(target).crossJoin(F.broadcast(n)).where((F.col("n") > 80) & (F.col("degree") >= least))
    every = d.crossJoin(F.broadcast(n)).where("n <= 80")
    return top.unionByName(every).select("name", "degree")


def neighbour_groups(edges: DataFrame) -> DataFrame:
    """(name, type, direction, neighbours, n): in, out, or both for undirected types."""
    undirected = F.col("type").isin(*S.UNDIRECTED)
    out = edges.select(F.col("source").alias("name"), "type", F.when(undirected, "both").otherwise("out").alias("direction"), F.col("target").alias("other"))
    into = edges.select(F.col("target").alias("name"), "type", F.when(undirected, "both").otherwise("in").alias("direction"), F.col("source").alias("other"))
    # a node's rows come together once, for what is distinct and for its groups
    return spread(out.unionByName(into), "name").distinct().groupBy("name", "type", "direction").agg(F.array_sort(F.collect_list("other")).alias("neighbours"), F.count("*").alias("n"))


def neighbour_pages(edges: DataFrame, size: int = 100) -> DataFrame:
    """(name, type, direction, page, neighbours): neighbour_groups() with the neighbours, in pages of `size` by name.

    A hub's neighbours are numbered by ranges over all, so that no task and no
    array holds more than a range or a page of them.
    """
    undirected = F.col("type").isin(*S.UNDIRECTED)
    out = edges.select(F.col("source").alias("name"), "type", F.when(undirected, "both").otherwise("out").alias("direction"), F.col("target").alias("other"))
    into = edges.select(F.col("target").alias("name"), "type", F.when(undirected, "both").otherwise("in").alias("direction"), F.col("source").alias("other"))
    group = ["name", "type", "direction"]
    placed = materialize(numbered_over_all(spread(out.unionByName(into), *group, "other").distinct(), [*group, "other"], "n"), "neighbours")
    first = placed.groupBy(*group).agg(F.min("n").alias("first"))
    paged = spread(placed, *group).join(first, group).withColumn("page", F.floor((F.col("n") - F.col("first")) / size).cast("int"))
    return paged.groupBy(*group, "page").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))


def missing_nodes(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Ends of relations (subject, object) that are no concept yet; empty and self relations make none."""
    r = relations.where("subject <> '' and object <> '' and subject <> object")
    ends = r.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    return ends.join(concepts.select("name"), "name", "left_anti")


def render_edges(edges: DataFrame, shown: DataFrame, with_problems: bool) -> DataFrame:
    """The edges that a drawing of `shown` (a column, name) has: both ends shown, an undirected edge once, TESTS only with problems."""
    known = edges.where(F.col("type").isin(*S.EDGE_TYPES))
    names = shown.toDF("name").distinct()
    inside = known if with_problems else known.where("type <> 'TESTS'")
    for end in ("source", "target"):
        inside = induced_at(spread(inside, end), names, end)
    flip = F.col("type").isin(*S.UNDIRECTED)
    once = keep_first(inside.where(flip), [F.least("source", "target"), F.greatest("source", "target"), "type"], ["ord", "source"])
    return inside.where(~flip).unionByName(once)


def formula_chapters(formulas: DataFrame, chapters: DataFrame) -> DataFrame:
    """(name, source, number): the chapters whose title is a formula's source. formulas: (name, source); chapters: (number, title)."""
    f = formulas.where("source <> ''")
    return f.join(chapters.select("number", F.col("title").alias("source")), "source").select("name", "source", "number")
