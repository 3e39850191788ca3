"""Same-entity links without comparing all pairs, and their connected components.

Two entries of a property are the same when both carry a document number and it agrees; otherwise when their
name agrees, their dates are close or one is unknown, and their amounts are close or one is unknown. Linking all
such pairs would be quadratic for a property with very many entries. The components only need enough links to
connect the same sets, and every rule below emits a bounded number of links per entry:

* entries with the same document number are tied to the smallest of them;
* along one sorted axis an entry is tied to the nearest partner on each side, which connects every close pair,
  because all entries between two close ones are close to both;
* for date and amount together, amounts are cut into cells whose members are all close. Inside a cell the date
  axis is enough. Towards another cell an entry looks at the half windows before and after its date and takes
  the member with the best amount; any other close member of a half window is close to that one;
* unknown dates or amounts fit everything, so those sets are tied through one member of each side.

A name that few entries of a property share is compared directly, which takes one join; the rules are for the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.session import materialize

BLOCK = 32
#: Entries of one name up to which they are compared directly.
FEW = 32
#: Links up to which the entries of one owner are solved in one task.
SMALL = 4096


@dataclass(frozen=True)
class Closeness:
    """Largest distance in days, and of amounts either as a share of the larger or as an absolute difference."""

    days: int
    share: str | None = None
    difference: str | None = None

    def amounts(self, a: Column, b: Column) -> Column:
        gap = F.abs(a - b)
        if self.share is not None:
            return gap <= F.greatest(F.abs(a), F.abs(b)) * F.expr(self.share)
        return gap <= F.expr(self.difference)

    def cell(self) -> Column:
        """Cell of an amount: all members of a cell are close to each other."""
        amount = F.col("amount")
        if self.share is not None:
            # One percent apart at most inside a cell; the sign keeps opposite amounts apart, zero is its own cell.
            width = 1.0 + float(self.share)
            step = F.floor(F.log(F.abs(amount).cast("double")) / F.log(F.lit(width)))
            return F.when(amount == 0, F.lit(None).cast("bigint")).otherwise(step.cast("bigint"))
        return F.floor(amount / F.expr(self.difference)).cast("bigint")

    def reach(self) -> int:
        """How many cells away a close amount can lie."""
        return 2 if self.share is not None else 1


def _pairs(df: DataFrame, *links: Column) -> DataFrame:
    """One row per non-null link from a node to another."""
    return (df.select(F.col("node").alias("u"), F.explode(F.array_compact(F.array(*links))).alias("v"))
            .where("u <> v"))


def _nearest(nodes: DataFrame, part: list[str], axis: str, close, left: Column, right: Column) -> DataFrame:
    """Tie every left member to the nearest right members on both sides of the axis, and the other way round."""
    rows = nodes.where(left | right).withColumn("left_", left).withColumn("right_", right)
    up = Window.partitionBy(*part).orderBy(axis, "node").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*part).orderBy(F.col(axis).desc(), F.col("node").desc()) \
                 .rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct(F.col(axis).alias("at"), F.col("node").alias("node"))
    seen = rows
    for name, window in (("before", up), ("after", down)):
        for side in ("left_", "right_"):
            seen = seen.withColumn(f"{name}_{side}", F.last(F.when(F.col(side), here), ignorenulls=True).over(window))
    links = []
    for own, other in (("left_", "right_"), ("right_", "left_")):
        for name in ("before", "after"):
            found = F.col(f"{name}_{other}")
            links.append(F.when(F.col(own) & close(F.col(axis), found["at"]), found["node"]))
    return _pairs(seen, *links)


def _blocked(rows: DataFrame, axis: str, close: Closeness) -> DataFrame:
    """Rows cut into blocks along an axis, those near a border in both blocks.

    Close entries always share a block, so a name with very many entries is spread over its blocks.
    """
    if axis == "day":
        unit, reach = F.floor(F.col("day") / close.days), 1
    else:
        unit, reach = F.coalesce(close.cell(), F.lit(-(1 << 40))), close.reach()
    places = F.array(*[F.floor((unit + offset) / BLOCK) for offset in (-reach, 0, reach)])
    return rows.where(F.col(axis).isNotNull()).withColumn("block", F.explode(F.array_distinct(places)))


def _stars(nodes: DataFrame, part: list[str], left: Column, right: Column) -> DataFrame:
    """Tie two sets that fit each other completely through the smallest member of each."""
    rows = nodes.where(left | right).withColumn("left_", left).withColumn("right_", right)
    ends = rows.groupBy(*part).agg(F.min(F.when(F.col("left_"), F.col("node"))).alias("first_left"),
                                   F.min(F.when(F.col("right_"), F.col("node"))).alias("first_right"))
    return _pairs(rows.join(ends, part), F.when(F.col("left_"), F.col("first_right")),
                  F.when(F.col("right_"), F.col("first_left")))


def _across_cells(nodes: DataFrame, part: list[str], close: Closeness) -> DataFrame:
    """Links between entries whose amounts fall into different cells.

    Members are first reduced to one row per cell and day, so that a sliding window holds at most a few rows
    per day however many entries a property has.
    """
    keys = [*part, "sign", "cell"]
    best = F.struct("amount", "node")
    days = (nodes.where("NOT has_doc").groupBy(*keys, "day")
            .agg(F.min(best).alias("lowest"), F.max(best).alias("highest")))
    offsets = [offset for offset in range(-close.reach(), close.reach() + 1) if offset != 0]
    asking = (nodes.select(*part, "sign", F.col("cell").alias("from_cell"), "day").distinct()
              .withColumn("offset", F.explode(F.array(*[F.lit(offset) for offset in offsets])))
              .withColumn("cell", F.col("from_cell") + F.col("offset")))
    both = asking.select(*keys, "day", "from_cell", "offset").unionByName(days, allowMissingColumns=True)
    base = Window.partitionBy(*keys).orderBy("day")
    seen = both.select(*keys, "day", "from_cell", "offset", *[
        function(column).over(base.rangeBetween(*span)).alias(f"{name}_{column}")
        for name, span in (("before", (-close.days, 0)), ("after", (0, close.days)))
        for column, function in (("lowest", F.min), ("highest", F.max))]).where("from_cell IS NOT NULL")
    found = seen.withColumn("cell", F.col("from_cell")).drop("from_cell")
    rows = nodes.join(found, [*part, "sign", "cell", "day"])
    # Magnitudes grow with the cell; towards a higher cell the smallest member is nearest.
    links = []
    for name in ("before", "after"):
        target = F.when(F.col("offset") > 0, F.col(f"{name}_lowest")).otherwise(F.col(f"{name}_highest"))
        links.append(F.when(close.amounts(F.col("amount"), target["amount"]), target["node"]))
    return _pairs(rows, *links)


def _direct(named: DataFrame, part: list[str], close: Closeness) -> DataFrame:
    """Every link between entries of the same name; for names with few entries."""
    other = named.select(*part, *[F.col(name).alias(f"{name}_") for name in ("node", "has_doc", "day", "amount")])
    met = named.join(other, part).where("node < node_ AND NOT (has_doc AND has_doc_)")
    near = F.coalesce(F.abs(F.col("day") - F.col("day_")) <= close.days, F.lit(True)) \
        & F.coalesce(close.amounts(F.col("amount"), F.col("amount_")), F.lit(True))
    return met.where(near).select(F.col("node").alias("u"), F.col("node_").alias("v"))


def links(nodes: DataFrame, close: Closeness) -> DataFrame:
    """Links (u, v) between entries of a property that are the same.

    ``nodes`` has property_id, node, doc, name, day (days as an integer) and amount; node ids are unique.
    """
    nodes = nodes.withColumn("has_doc", F.col("doc").isNotNull())
    documents = nodes.where("has_doc").withColumn("doc", F.lower("doc"))
    first = F.min("node").over(Window.partitionBy("property_id", "doc"))
    by_document = _pairs(documents.withColumn("first", first), F.col("first"))

    part = ["property_id", "name"]
    named = nodes.where("name IS NOT NULL").withColumn("amount", F.col("amount").cast("decimal(20,6)")) \
                 .withColumn("entries", F.count("*").over(Window.partitionBy(*part)))
    out = by_document.unionByName(_direct(named.where(F.col("entries") <= FEW).drop("entries"), part, close))
    many = named.where(F.col("entries") > FEW).drop("entries")
    # Most portfolios have no name with many entries; the plan of the rules is left out then.
    return out if many.limit(1).isEmpty() else out.unionByName(_by_rules(many, part, close))


def _by_rules(named: DataFrame, part: list[str], close: Closeness) -> DataFrame:
    """Links that connect the same sets as all links between entries of the same name, a bounded number per entry."""
    named = named.withColumn("sign", F.signum("amount").cast("int"))
    # Equal entries without a document are tied to one of them, and only that one goes on.
    named = named.withColumn("day_key", F.coalesce(F.col("day").cast("string"), F.lit("-"))) \
                 .withColumn("amount_key", F.coalesce(F.col("amount").cast("string"), F.lit("-")))
    alike = [*part, "day_key", "amount_key"]
    copies = _stars(named.where("NOT has_doc"), alike, F.lit(True), F.lit(True))
    kept = named.where("NOT has_doc").groupBy(*alike, "has_doc").agg(
        F.min("node").alias("node"), F.first("day").alias("day"), F.first("amount").alias("amount"), F.first("sign").alias("sign"))
    named = kept.unionByName(named.where("has_doc").select(*kept.columns))
    magnitude = named.withColumn("amount", F.abs("amount"))
    no_doc, any_doc = ~F.col("has_doc"), F.col("has_doc")
    has_day, has_amount = F.col("day").isNotNull(), F.col("amount").isNotNull()
    full, day_only = has_day & has_amount, has_day & ~has_amount
    amount_only, bare = ~has_day & has_amount, ~has_day & ~has_amount

    def days_close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= close.days

    def pairs_of(rows: DataFrame, axis: str, near, own: Column, others: Column) -> DataFrame:
        # Amounts of opposite sign are never close by share; by difference they may be.
        signed = ["sign"] if axis == "amount" and close.share is not None else []
        rows, place = _blocked(rows, axis, close), [*part, *signed, "block"]
        first = _nearest(rows, place, axis, near, own & no_doc, others)
        return first.unionByName(_nearest(rows, place, axis, near, own & any_doc, others & no_doc))

    if close.share is not None:
        celled = magnitude.where(full).withColumn("cell", F.coalesce(close.cell(), F.lit(-(1 << 40))))
    else:
        celled = named.where(full).withColumn("sign", F.lit(0)).withColumn("cell", close.cell())
    inside = _nearest(_blocked(celled, "day", close), [*part, "sign", "cell", "block"], "day", days_close, no_doc, F.lit(True))
    across = _across_cells(celled, part, close)
    by_day = pairs_of(named, "day", days_close, day_only, has_day)
    by_amount = pairs_of(named, "amount", close.amounts, amount_only, has_amount)
    mixed = _stars(named, part, day_only & no_doc, amount_only) \
        .unionByName(_stars(named, part, day_only & any_doc, amount_only & no_doc))
    open_ended = _stars(named, part, bare & no_doc, F.lit(True)) \
        .unionByName(_stars(named, part, bare & any_doc, no_doc))
    out = copies
    for more in (inside, across, by_day, by_amount, mixed, open_ended):
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every linked node, by alternating large-star and small-star rounds.

    Long chains shrink by a constant factor per round. Every round is written to the shared folder, so its lineage is
    cut and a lost executor repeats one round at most.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    current = materialize(ordered(edges), "links")
    mark = fingerprint(current)
    while mark[0]:  # every round that changes a link shortens a path to the smallest node, so the rounds end
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ordered(large)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(smallest.select("u", F.col("m").alias("v")))
        current = materialize(ordered(small), "links")
        following = fingerprint(current)
        if following == mark:
            break
        mark = following
    heads = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads).distinct()


def _smallest(links: list[tuple[str, str]]) -> dict[str, str]:
    """Smallest node of the component of every linked node."""
    above: dict[str, str] = {}

    def head(node: str) -> str:
        while (up := above.setdefault(node, node)) != node:
            above[node] = above[up]
            node = up
        return node

    for u, v in links:
        a, b = head(u), head(v)
        above[max(a, b)] = min(a, b)
    return {node: head(node) for node in list(above)}


def _solved(links: list[dict]) -> pa.RecordBatch:
    found = _smallest([(link["u"], link["v"]) for link in links])
    return pa.record_batch({"node": pa.array(list(found), pa.string()), "component": pa.array(list(found.values()), pa.string())})


def components_within(edges: DataFrame) -> DataFrame:
    """(node, component) as :func:`components`, for links (owner, u, v) that never leave their owner.

    An owner with few links is solved where its links meet, after one exchange. Only owners with more than ``SMALL`` links go
    through the rounds, so a portfolio without such owners takes none.
    """
    edges = materialize(edges.select("owner", "u", "v").where("u <> v").distinct(), "owned-links")
    large = materialize(edges.groupBy("owner").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("owner"), "large-owners")
    kind = edges.schema["u"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Links come in the order of their owners: all but the last owner at hand are complete.
        waiting: list[dict] = []
        for batch in batches:
            waiting += batch.to_pylist()
            last = waiting[-1]["owner"] if waiting else None
            if waiting and waiting[0]["owner"] != last:
                yield _solved([link for link in waiting if link["owner"] != last])
                waiting = [link for link in waiting if link["owner"] == last]
        yield _solved(waiting)

    dealt = edges.join(large, "owner", "left_anti").repartition("owner").sortWithinPartitions("owner")
    solved = dealt.mapInArrow(solve, f"node {kind}, component {kind}")
    if not large.limit(1).count():
        return solved
    return solved.unionByName(components(edges.join(large, "owner", "left_semi").select("u", "v")))
