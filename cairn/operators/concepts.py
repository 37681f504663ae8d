"""Concepts: validation, names, aliases, and the merging of those that mean the same."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import calls, hooks
from cairn.functions.scalar import norm_key, strip
from cairn.session import materialize, spread
from cairn.sources.frames import keep_first, numbered_over_all

HAN = re.compile("[一-鿿]")


def validate(raw: DataFrame) -> DataFrame:
    """Trimmed concepts with a name and a definition of five characters or more; roles, difficulty and aliases put right."""
    d = F.coalesce(F.expr("try_cast(difficulty as int)"), F.lit(1))
    names = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: strip(a))
    c = raw.withColumns({"name": strip(F.col("name")), "definition": strip(F.col("definition")), "aliases": names, "difficulty": F.greatest(F.lit(1), F.least(F.lit(3), d))})
    c = c.where((F.col("name") != "") & (F.char_length("definition") >= 5))
    c = c.withColumns({"aliases": F.array_distinct(F.filter("aliases", lambda a: (a != "") & (a != F.col("name")))), "node_role": F.when(F.col("node_role").isin(*S.NODE_ROLES), F.col("node_role")).otherwise(S.DEFAULT_ROLE)})
    only = [x for x in ("preemptive", "starvation_free", "complexity", "scenario") if x in c.columns]
    return c.withColumns({x: F.when(F.col("node_role") == S.ALGORITHM, F.col(x)) for x in only})


def dedupe(concepts: DataFrame) -> DataFrame:
    """The first concept of each name, with the aliases of all; aliases that are some concept's name go.

    Aliases of a merged concept are sorted; those of an unmerged one keep their order.
    """
    first = keep_first(concepts.where("name <> ''"), ["name"], ["ord"])
    union = concepts.groupBy("name").agg(F.count("*").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(_names("aliases"))))).alias("_all"))
    merged = first.join(union, "name").withColumn("aliases", F.when(F.col("_n") > 1, F.array_remove("_all", F.col("name"))).otherwise(F.col("aliases"))).drop("_n", "_all")
    alias = merged.select("name", F.posexplode("aliases").alias("at", "alias"))
    free = alias.join(merged.select(F.col("name").alias("alias")), "alias", "left_anti")
    kept = free.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("_kept"))
    return merged.join(kept, "name", "left").withColumn("aliases", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")


def dedupe_problems(problems: DataFrame) -> DataFrame:
    return keep_first(problems, ["pid"], ["ord"])


def with_stem(problems: DataFrame) -> DataFrame:
    return problems.where(strip(F.col("stem")) != "")


def resolve(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, canonical): trimmed, case-sensitive; the name itself where no term matches."""
    t = terms.select(F.col("term"), "canonical")
    n = names.withColumn("_k", strip(F.col("name")))
    return n.join(t, n["_k"] == t["term"], "left").select("name", F.coalesce("canonical", "_k").alias("canonical"))


def resolve_exact(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name, canonical): neither trimmed nor folded; the first concept whose name or alias is the name, else null."""
    keys = concepts.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k"), F.col("name").alias("canonical"), "ord")
    first = keys.groupBy("k").agg(F.min_by("canonical", F.struct("ord", "canonical")).alias("canonical"))
    return names.select("name").join(first, F.col("name") == F.col("k"), "left").select("name", "canonical")


def in_chapters(concepts: DataFrame, chapters: list[str]) -> DataFrame:
    """The concepts of some chapters; no list keeps all."""
    return concepts.where(F.col("chapter").isin(*chapters)) if chapters else concepts


def resolve_folded(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name, canonical): trimmed and lower-cased; the first concept whose name or alias matches, else null."""
    keys = concepts.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k"), "name", "ord")
    first = keys.groupBy(norm_key(F.col("k")).alias("key")).agg(F.min_by("name", F.struct("ord", "name")).alias("canonical"))
    n = names.withColumn("_k", norm_key(F.col("name")))
    return n.join(first, n["_k"] == first["key"], "left").select("name", "canonical")


def alias_candidates(concepts: DataFrame) -> DataFrame:
    """(idx_a, idx_b, name_a, name_b, confidence, matched_key): pairs of concepts that share a name or alias.

    A key that many concepts share pairs each of them with the first: merging is
    transitive, so these pairs join what all pairs would.
    """
    keys = _keys(concepts)
    head = keys.groupBy("key").agg(F.min_by(F.struct("idx", "name"), F.struct("idx")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", "h")
    pairs = keys.join(head, "key").where(F.col("idx") > F.col("h.idx")).select(F.col("h.idx").alias("idx_a"), F.col("idx").alias("idx_b"), F.col("h.name").alias("name_a"), F.col("name").alias("name_b"), "key")
    return pairs.groupBy("idx_a", "idx_b", "name_a", "name_b").agg(F.min("key").alias("matched_key")).withColumn("confidence", F.lit(1.0))


#: Concepts of a key that meet as many others in one cell of alias_pairs().
CELL = 512


def alias_pairs(concepts: DataFrame) -> DataFrame:
    """(idx_a, idx_b, name_a, name_b, confidence, matched_key): all pairs of concepts that share a name or alias, each once, with the first key that they share.

    The pairs of a key grow with the square of its concepts. These are dealt over
    blocks of about CELL, and each two blocks meet in a cell of their own: a task
    holds a block, not a key, and pairs are not shuffled once they are made.
    """
    k = _keys(concepts)
    size = k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = k.join(size, "key").groupBy("idx", "name").agg(F.collect_set(F.struct("key", "n")).alias("_all"))
    of = shared.select("idx", "name", F.transform("_all", lambda x: x["key"]).alias("_keys"), F.explode("_all").alias("_k")).select("idx", "name", "_keys", "_k.*")
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    dealt = of.select("key", "idx", "name", F.filter("_keys", lambda x: x < F.col("key")).alias("_less"), F.pmod(F.xxhash64("idx", "name"), blocks).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    a = spread(dealt.select("key", F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.col("idx").alias("idx_a"), F.col("name").alias("name_a"), F.col("_less").alias("_a")), "key", "_i", "_j")
    b = dealt.select("key", F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.col("idx").alias("idx_b"), F.col("name").alias("name_b"), F.col("_less").alias("_b"))
    first = (F.size("_a") == 0) | (F.size("_b") == 0) | ~F.arrays_overlap("_a", "_b")
    return a.join(b, ["key", "_i", "_j"]).where(F.col("idx_a") < F.col("idx_b")).where(first).select("idx_a", "idx_b", "name_a", "name_b", F.lit(1.0).alias("confidence"), F.col("key").alias("matched_key"))


def alias_links(concepts: DataFrame) -> DataFrame:
    """(name, matched_key, idx, first, links): a row for each concept and each name or alias that others share with it.

    All concepts of a key are pairs for review one by one; first, by order,
    names the key's class, and links counts the others in it. A key that
    many share has a row for each, not for each two.
    """
    k = _keys(concepts)
    of = k.groupBy("key").agg(F.min_by("name", F.struct("idx", "name")).alias("first"), (F.count("*") - 1).alias("links")).where("links > 0")
    return k.join(of, "key").select("name", F.col("key").alias("matched_key"), "idx", "first", "links")


def _keys(concepts: DataFrame) -> DataFrame:
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts.select(F.col("ord").alias("idx"), "name", F.explode(F.array_distinct(F.transform(names, norm_key))).alias("key"))


def candidates(alias: DataFrame, embed: DataFrame) -> DataFrame:
    """Both kinds of candidate pairs, each pair once (alias first), alias pairs before others and these by confidence."""
    cols = ["idx_a", "idx_b", "name_a", "name_b", "confidence"]
    both = alias.select(*cols, F.lit("alias_match").alias("source"), "matched_key").unionByName(embed.select(*cols, F.lit("embedding").alias("source"), F.lit(None).cast("string").alias("matched_key")))
    both = keep_first(both, [F.least("idx_a", "idx_b"), F.greatest("idx_a", "idx_b")], [(F.col("source") != "alias_match").cast("int"), F.desc("confidence")])
    return both


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) join each node to.

    Each round hooks every component to the smallest one that a link leads to, and
    follows the hooks to their ends by doubling, so that a component is always
    named after a node that is in it: links are looked up by that node. A round is
    written to shared storage; only counts come to the driver.
    """
    label = nodes.select("id", F.col("id").alias("component"))
    while True:
        ends = links.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        links = materialize(ends.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return label
        hook = links.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")).withColumn("open", F.lit(True))
        while True:
            on = hook.select(F.col("from").alias("to"), F.col("to").alias("far"))
            hook = materialize(hook.join(on, "to", "left").select("from", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("open")), "hooks")
            if hook.where("open").isEmpty():
                break
        label = materialize(label.join(hook, F.col("component") == F.col("from"), "left").select("id", F.coalesce("to", "component").alias("component")), "classes")


#: Pairs that one component may settle in one task; more are first contracted over all tasks.
COMPONENT_PAIRS = 100_000
#: Rounds of contraction after which what is left is settled by components, however much it is.
CONTRACTIONS = 20


def _better(name: str, difficulty: int | None) -> tuple:
    """What makes a name stand for another: Chinese, length, difficulty."""
    return bool(HAN.search(name)), len(name), 1 if difficulty is None else difficulty


def _contract(names: DataFrame, pairs: DataFrame, few: int, rounds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, head) of all names after all pairs but at most `few` are merged in order, and those that are left, between heads.

    names: (id, difficulty), pairs: (p_ord, name_a, name_b, canonical) with unlike
    numbers. A pair may be merged as soon as no earlier one is open at either end.
    So in each round a group takes its pairs in order as long as each is the other
    group's first, and none of the groups that it took has an earlier one open: a
    name that a million others are merged into takes them all in one round, as a
    stream of sorted rows. Of two groups that are each other's first, the one with
    more pairs takes. Where the pairs of a group and of those that it takes alternate,
    each change takes a round; after CONTRACTIONS rounds the rest is left as it is.
    """
    rounds = [] if rounds is None else rounds
    group = names.select("id", F.col("id").alias("head"))
    worth = [names.select(F.col("id").alias(c), F.col("difficulty").alias(f"{c}_d")) for c in ("a", "b")]
    open_ = pairs.select("p_ord", F.col("name_a").alias("a"), F.col("name_b").alias("b"), "canonical").join(worth[0], "a").join(worth[1], "b")
    while True:
        # of several pairs between two groups only the first does anything
        open_ = materialize(keep_first(open_.where("a <> b"), [F.least("a", "b"), F.greatest("a", "b")], ["p_ord"]), "pairs")
        left = open_.count()
        rounds.append(left)
        if left <= few or len(rounds) > CONTRACTIONS:
            return group, open_
        both = F.array(*(F.struct(F.col(g).alias("g"), F.col(f"{g}_d").alias("gd"), F.col(o).alias("o"), F.col(f"{o}_d").alias("od"), F.lit(g == "a").alias("is_a")) for g, o in (("a", "b"), ("b", "a"))))
        w = Window.partitionBy("g").orderBy("p_ord")
        ends = open_.select("p_ord", "canonical", F.explode(both).alias("e")).select("p_ord", "canonical", "e.*")
        ends = materialize(ends.select("*", F.row_number().over(w).alias("place"), F.lead("p_ord").over(w).alias("next"), F.count("*").over(Window.partitionBy("g")).alias("size")), "ends")
        # a group can be taken by its first pair alone
        first = ends.where("place = 1").select("p_ord", F.col("g").alias("o"), F.col("next").alias("o_next"), F.col("size").alias("o_size"))
        may = (F.col("place") > 1) | (F.struct("size", "g") > F.struct("o_size", "o"))
        rows = ends.join(first, ["p_ord", "o"]).where(may).select("g", "p_ord", "o", "is_a", "canonical", "place", "o_next", "gd", "od").repartition("g").sortWithinPartitions("g", "p_ord")
        took = materialize(rows.mapInArrow(_take, "name string, by string, head string, difficulty int"), "took")
        moved = materialize(took.select("name", "by").join(took.where("head IS NOT NULL").select("by", "head", "difficulty"), "by").select("name", F.col("head").alias("new"), F.col("difficulty").alias("new_d")), "moved")
        for c in ("a", "b"):
            there = moved.select(F.col("name").alias(c), F.col("new").alias("_n"), F.col("new_d").alias("_d"))
            open_ = open_.join(there, c, "left").withColumns({c: F.coalesce("_n", c), f"{c}_d": F.when(F.col("_n").isNull(), F.col(f"{c}_d")).otherwise(F.col("_d"))}).drop("_n", "_d")
        group = materialize(group.join(moved.select(F.col("name").alias("head"), "new"), "head", "left").select("id", F.coalesce("new", "head").alias("head")), "groups")


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups' pairs in order: the groups that each takes (name, by), and the head that stands for all in the end (on the taker's own row).

    Rows are the pairs that are the other group's first; a place that is missing is a pair that is not, and ends the taking.
    """
    by = head = worth = limit = hard = None
    at, out = 0, []
    schema = pa.schema([("name", pa.string()), ("by", pa.string()), ("head", pa.string()), ("difficulty", pa.int32())])

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    for b in batches:
        for g, p, o, is_a, said, place, later, gd, od in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
            if g != by:
                if at:
                    out.append((by, by, head, hard))
                by, head, worth, hard, limit, at = g, g, _better(g, gd), gd, None, 0
            if place != at + 1 or (limit is not None and p >= limit):
                continue
            at = place
            out.append((o, g, None, None))
            limit = later if limit is None else limit if later is None else min(limit, later)
            said, other = (said or "").strip(), _better(o, od)
            # the proposed name if it heads either group, else the better head, the first of the pair among equals
            if said != head and (said == o or other > worth or (other == worth and not is_a)):
                head, worth, hard = o, other, od
        yield batch()
        out = []
    if at:
        out.append((by, by, head, hard))
        yield batch()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, head) of the names of components, each component's pairs in order: the name that stands for each once all pairs are merged.

    A pair joins two groups. The joint group's head is the proposed name if it is
    either group's head, else the better of the two by (Chinese, length,
    difficulty), the first of the pair among equals. Only one component is held.
    """
    up: dict[str, str] = {}  # a name towards the one that its group is kept under
    head: dict[str, tuple[str, tuple, int]] = {}  # there: the group's head, its worth, names
    now = None

    def top(n: str) -> str:
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(up, pa.string()), pa.array([head[top(n)][0] for n in up], pa.string())], ["id", "head"])

    for b in batches:
        for of, x, y, said, xd, yd in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
            if of != now:
                if len(up) > 10_000:
                    yield batch()
                    up.clear(), head.clear()
                now = of
            for n, d in ((x, xd), (y, yd)):
                if n not in up:
                    up[n], head[n] = n, (n, _better(n, d), 1)
            i, j = top(x), top(y)
            if i == j:
                continue
            one, other, said = head[i], head[j], (said or "").strip()
            best = one if said == one[0] else other if said == other[0] or other[1] > one[1] else one
            if one[2] < other[2]:
                i, j = j, i
            up[j] = i
            head[i] = (*best[:2], one[2] + other[2])
            del head[j]
    yield batch()


def _names(column: str) -> Column:
    """A list of names without nulls; a missing list has none."""
    return F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda a: a.isNotNull())


def _fold(members: DataFrame) -> DataFrame:
    """One concept for each head of (head, concept's columns).

    The head's own concept is the base (the first by ord where the head has none):
    its name, attributes and aliases stay. The others' names and aliases follow in
    order, each name once in any case; the longest definition is kept.
    """
    base = members.groupBy("head").agg(
        F.min_by(F.struct("name", "chapter", "difficulty", "node_role", "aliases", "ord"), F.struct(F.col("name") != F.col("head"), "ord")).alias("b"),
        F.count("*").cast("int").alias("merged"),
    )
    known = members.join(base, "head").withColumn("own", F.col("name") == F.col("b.name"))
    longest = known.groupBy("head").agg(F.max_by("definition", F.struct(F.char_length(F.coalesce("definition", F.lit(""))), "own", -F.col("ord"))).alias("definition"))
    names = known.select("head", "own", "ord", F.posexplode(F.concat(F.array("name"), _names("aliases"))).alias("pos", "alias"))
    # a name that the base has in any case is not added; of the others' spellings the first is
    once = names.groupBy("head", F.lower(strip(F.col("alias"))).alias("folded")).agg(F.max("own").alias("own"), F.min(F.struct("ord", "pos", "alias")).alias("first")).where("NOT own")
    more = once.groupBy("head").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["alias"]).alias("more"))
    out = base.join(longest, "head").join(more, "head", "left")
    return out.select("b.name", "definition", "b.chapter", "b.difficulty", "b.node_role", F.concat(_names("b.aliases"), _names("more")).alias("aliases"), "b.ord", "merged")


def apply_decisions(concepts: DataFrame, decided: DataFrame, component_pairs: int = COMPONENT_PAIRS, rounds: list[int] | None = None) -> DataFrame:
    """Concepts with approved pairs merged, transitively.

    decided: (p_ord, name_a, name_b, merge, canonical), no two with one p_ord.
    Pairs are merged over all tasks until at most component_pairs are left (see
    _contract()); pairs of different components cannot touch each other, so the
    names of each are then settled in the order of its decisions by themselves, and
    the concepts are folded by aggregation. Concepts in no pair pass by untouched.
    `merged` counts what went into each.
    """
    ok = decided.where("merge").select("p_ord", "name_a", "name_b", "canonical")
    ends = ok.select(F.explode(F.array("name_a", "name_b")).alias("id")).distinct()
    fields = ["name", "definition", "chapter", "difficulty", "node_role", "aliases", "ord"]
    c = concepts.select(*fields)
    names = materialize(ends.join(c.groupBy(F.col("name").alias("id")).agg(F.max("difficulty").alias("difficulty")), "id", "left"), "names")
    group, pairs = _contract(names, ok, component_pairs, rounds)
    # a name in no pair that is left stands as it is
    comp = components(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), pairs.select("a", "b"))
    of = pairs.join(comp.select(F.col("id").alias("a"), F.col("component").alias("of")), "a").select("of", "p_ord", "a", "b", "canonical", "a_d", "b_d")
    settled = of.repartition("of").sortWithinPartitions("of", "p_ord").mapInArrow(_settle, "id string, head string")
    heads = group.withColumnRenamed("head", "top").join(settled.select(F.col("id").alias("top"), "head"), "top", "left").select("id", F.coalesce("head", "top").alias("head"))
    members = materialize(c.join(heads, c["name"] == heads["id"]).drop("id"), "members")
    return c.join(ends, c["name"] == ends["id"], "left_anti").withColumn("merged", F.lit(1)).unionByName(_fold(members))


def review_batches(pairs: DataFrame, size: int = 15) -> DataFrame:
    """Pairs with a number from 1 (p_ord) and a batch number, alias pairs first, then by confidence."""
    order = [(F.col("source") != "alias_match").cast("int"), F.desc("confidence"), "idx_a", "idx_b"]
    return numbered_over_all(pairs, order, "p_ord").withColumn("batch", F.floor((F.col("p_ord") - 1) / size))


def normalize(concepts: DataFrame, embed: DataFrame | None, call: calls.Client | calls.Asker, size: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, report, counts): candidate pairs, reviewed in batches, and the approved ones merged.

    embed: similar pairs (idx_a, idx_b, name_a, name_b, confidence), or none for
    pairs by alias alone. The report is a row a candidate with its decision; counts
    is one row (input, output, candidates, alias, embedding, approved, rejected).
    """
    alias = alias_candidates(concepts)
    found = materialize(review_batches(candidates(alias, alias.limit(0) if embed is None else embed), size), "candidates")
    asked = found.select(F.col("batch"), F.col("p_ord").cast("int").alias("p_ord"), "name_a", "name_b")
    said = materialize(hooks.review(asked, call), "decisions")
    merged = apply_decisions(concepts, said)
    report = found.drop("batch").withColumn("p_ord", F.col("p_ord").cast("int")).join(said.select("p_ord", F.struct("merge", "canonical", "reason").alias("decision")), "p_ord")
    total = report.agg(F.count("*").alias("candidates"), F.count_if(F.col("source") == "alias_match").alias("alias"), F.count_if(F.col("source") != "alias_match").alias("embedding"), F.count_if("decision.merge").alias("approved"), F.count_if(~F.col("decision.merge")).alias("rejected"))
    n = concepts.agg(F.count("*").alias("input")).crossJoin(merged.agg(F.count("*").alias("output")))
    return merged, report, n.crossJoin(total)
