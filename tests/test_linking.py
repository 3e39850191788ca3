"""Links and components against comparing all pairs on small random portfolios."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import linking
from parcelscope.operators.linking import Closeness, components, components_within, links

MORTGAGES = Closeness(days=30, share="0.01")
LIENS = Closeness(days=7, difference="1")


def same(a, b, close):
    if a["doc"] and b["doc"]:
        return a["doc"].lower() == b["doc"].lower()
    if not a["name"] or a["name"] != b["name"]:
        return False
    if a["day"] is not None and b["day"] is not None and abs(a["day"] - b["day"]) > close.days:
        return False
    if a["amount"] is None or b["amount"] is None:
        return True
    gap = abs(a["amount"] - b["amount"])
    limit = D("0.01") * max(abs(a["amount"]), abs(b["amount"])) if close.share else D(1)
    return gap <= limit


def brute_force(nodes, close):
    parent = {n["node"]: n["node"] for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if a["property_id"] == b["property_id"] and same(a, b, close):
                low, high = sorted((find(a["node"]), find(b["node"])))
                parent[high] = low
    groups = {}
    for n in nodes:
        groups.setdefault(find(n["node"]), set()).add(n["node"])
    return {frozenset(group) for group in groups.values() if len(group) > 1}


def random_nodes(seed, count, close, spread):
    rng = random.Random(seed)
    nodes = []
    for at in range(count):
        base = D(rng.choice([100000, 100900, 101000, 102005, 103100, 0, -100500]))
        amount = base + D(rng.randrange(0, 2000)) / 10 if close.share else D(rng.randrange(-60, 90)) / 4
        nodes.append({
            "property_id": rng.choice([1, 2]), "node": f"n{at:04d}",
            "doc": rng.choice(["A1", "a1", "B2", "C3", "D4"]) if rng.random() < 0.35 else None,
            "name": rng.choice(["X", "Y", "Z"]) if rng.random() < 0.95 else None,
            "day": rng.randrange(0, spread) if rng.random() < 0.93 else None,
            "amount": amount if rng.random() < 0.93 else None,
        })
    return nodes


@pytest.mark.parametrize("seed,close,spread", [
    (1, MORTGAGES, 900), (2, MORTGAGES, 4000), (4, LIENS, 300)])
def test_components_match_all_pairs(spark, seed, close, spread):
    nodes = random_nodes(seed, 150, close, spread)
    schema = "property_id long, node string, doc string, name string, day int, amount decimal(16,2)"
    df = spark.createDataFrame([tuple(n.values()) for n in nodes], schema)
    found = components(links(df, close)).groupBy("component").agg(F.collect_list("node").alias("members")).collect()
    assert {frozenset(row.members) for row in found} == brute_force(nodes, close)


def test_a_long_chain_settles(spark):
    edges = spark.range(600).select(F.format_string("n%05d", "id").alias("u"),
                                     F.format_string("n%05d", F.col("id") + 1).alias("v"))
    out = components(edges)
    assert out.count() == 601 and out.select("component").distinct().collect()[0].component == "n00000"


def test_links_stay_linear_for_one_dense_property(spark):
    df = spark.range(3000).select(F.lit(1).alias("property_id"), F.format_string("n%05d", "id").alias("node"),
                                  F.lit(None).cast("string").alias("doc"), F.lit("X").alias("name"),
                                  (F.col("id") % 20).cast("int").alias("day"),
                                  F.lit(100000).cast("decimal(16,2)").alias("amount"))
    assert links(df, MORTGAGES).count() < 10 * 3000


@pytest.mark.parametrize("small", [4096, 6])
def test_components_within_owners(spark, monkeypatch, small):
    """Owners with few links are solved where they are, the others by rounds; chains, stars, repeated links and loops of one node."""
    monkeypatch.setattr(linking, "SMALL", small)
    rng = random.Random(small)
    edges = [(f"o{owner}", f"{owner}-{at:02d}", f"{owner}-{at + 1:02d}") for owner in range(5) for at in range(owner * 4)]
    edges += [(f"o{owner}", f"{owner}-{rng.randrange(40):02d}", f"{owner}-{rng.randrange(40):02d}") for owner in range(5, 9) for _ in range(8)]
    edges += [*edges[:3], ("o9", "9-01", "9-01")]
    parent = {node: node for _, u, v in edges for node in (u, v)}

    def find(node):
        return node if parent[node] == node else find(parent[node])

    for _, u, v in edges:
        low, high = sorted((find(u), find(v)))
        parent[high] = low
    linked = {node for _, u, v in edges if u != v for node in (u, v)}
    got = {(row.node, row.component) for row in components_within(spark.createDataFrame(edges, "owner string, u string, v string")).collect()}
    assert got == {(node, find(node)) for node in linked}
    assert components_within(spark.createDataFrame([], "owner string, u string, v string")).count() == 0


@pytest.mark.parametrize("few", [0, 12, 24])
@pytest.mark.parametrize("seed,close,spread", [(1, MORTGAGES, 900), (4, LIENS, 300)])
def test_names_with_few_and_with_many_entries(spark, monkeypatch, few, seed, close, spread):
    """Names compared directly and names linked by the rules give the components of all pairs together."""
    monkeypatch.setattr(linking, "FEW", few)
    nodes = random_nodes(seed, 110, close, spread)
    schema = "property_id long, node string, doc string, name string, day int, amount decimal(16,2)"
    df = spark.createDataFrame([tuple(n.values()) for n in nodes], schema)
    found = components(links(df, close)).groupBy("component").agg(F.collect_list("node").alias("members")).collect()
    assert {frozenset(row.members) for row in found} == brute_force(nodes, close)


def test_names_with_few_entries_take_one_join(spark):
    df = spark.createDataFrame([tuple(n.values()) for n in random_nodes(3, 40, LIENS, 300)],
                               "property_id long, node string, doc string, name string, day int, amount decimal(16,2)")
    plan = links(df, LIENS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Aggregate") == 0
