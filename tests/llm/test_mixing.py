"""The flow against every possible routing of small networks, targets against a level found by bisection."""

import itertools
import random

import pytest

from cairn.llm import mixing


def _cost(words, supply):
    """Of words taken from a pattern: the first time free, the second at 1 each, the third at 3."""
    return sum(max(0, min(supply, words - k * supply)) * c for k, c in enumerate((0, 1, 3)))


def _best(supply, quota):
    """Most words that can be routed, and the least cost of as many, over all routings."""
    ways = []
    for p, n in supply.items():
        ways.append([dict(zip(p, x, strict=True)) for x in itertools.product(*[range(min(3 * n, quota[s]) + 1) for s in p]) if sum(x) <= 3 * n])
    best = (0, 0)
    for routing in itertools.product(*ways):
        into = {s: sum(r.get(s, 0) for r in routing) for s in quota}
        if all(into[s] <= quota[s] for s in quota):
            cost = sum(_cost(sum(r.values()), n) for r, n in zip(routing, supply.values(), strict=True))
            best = max(best, (sum(into.values()), -cost))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_the_optimum(seed):
    rng = random.Random(seed)
    sources = ["a", "b", None][: rng.randrange(1, 4)]
    patterns = [p for k in range(1, len(sources) + 1) for p in itertools.combinations(sources, k)]
    supply = {p: rng.randrange(3) for p in rng.sample(patterns, min(len(patterns), rng.randrange(1, 4)))}
    quota = {s: rng.randrange(6) for s in sources}
    flow = mixing.min_cost_flow(supply, quota)
    taken = {p: sum(flow[p, s] for s in p) for p in supply}
    assert all(v >= 0 for v in flow.values()) and all(taken[p] <= 3 * supply[p] for p in supply)
    assert all(sum(v for (_, x), v in flow.items() if x == s) <= quota[s] for s in sources)
    assert (sum(flow.values()), -sum(_cost(taken[p], supply[p]) for p in supply)) == _best(supply, quota)


@pytest.mark.parametrize("seed", range(40))
def test_targets_lie_on_one_level(seed):
    """Every target is the same multiple of its weight, or three times its source's size where that is less."""
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 200, 3000]) for i in range(rng.randrange(1, 8))}
    weights = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    low, high = 0.0, 1e6
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * weights[s]) for s in sizes) < sum(sizes.values()) else (low, level)
    got = mixing.targets(sizes, weights)
    assert got == pytest.approx({s: min(3 * sizes[s], high * weights[s]) for s in sizes}, abs=1e-6)


def test_overlapping_sources_come_near_their_targets(spark):
    """Documents that several sources may take count once for each; none is taken more than three times."""
    rng = random.Random(3)
    kinds = [["a"], ["a", "b"], ["b", "c"], ["c"], [None, "a"]]
    d = spark.createDataFrame([(i, "w " * rng.randrange(1, 30), rng.choice(kinds)) for i in range(600)], "doc_id long, text string, source array<string>")
    got = mixing.copies(d).collect()
    words = sum(r["size"] for r in got)
    assert len(got) == 600 and all(0 <= r["copies"] <= 3 for r in got)
    assert abs(sum(r["copies"] * r["size"] for r in got) - words) <= 0.01 * words
