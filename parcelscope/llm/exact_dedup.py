"""Exact duplicates by a tree of merges over sorted runs of digests; DataFrame functions only.

Every partition that reads documents makes a run: one row per document with the digests of its text without white space. Runs are
merged in rounds. A round joins ``FAN`` neighbouring runs (three rounds of a binomial tree in one exchange): their rows are dealt by
(lane, digest), sorted, and equal ones merged into the row that stays and the number of members. So no task ever receives more than
``FAN`` rows of a group beyond those it has merged itself, however many copies the group has, and one lane's rows are dealt over all
tasks. After the last round there is one lane. The verdicts of groups with two members or more then go the same way back, from a
lane to its ``FAN`` lanes, and at last to the documents of each run. Only digests and ids travel; every level is a written table.

Rows are sorted by a short digest (64 bits) and merge only if it and the SHA-256 digest are both equal, at every level.

Of a group the row with the most code points in the original text stays, then the smallest id (null after all others), then the
smallest hash of the original text, then the row read first; so exactly one row stays also among repeated rows. A null text counts
as empty, and empty texts are copies of each other. Texts are read whole. Only the named columns are read, so others can't clash.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.session import materialize

#: The characters left out of the comparison (fixed values): space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: Runs merged by one exchange.
FAN = 8
#: ``monotonically_increasing_id`` holds the number of the partition above this bit.
RUN_BIT = 33
KEY = ("lane", "short", "digest")


def _order() -> Column:
    """The least value of a group is the row that stays."""
    return F.struct((-F.col("size")).alias("shortest"), F.col("id").isNull().alias("no_id"), "id", "mark", "seq")


def _runs(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.regexp_replace(text, WHITE, "").alias("plain"),
                       F.monotonically_increasing_id().alias("seq"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []))
    rows = read.select("id", "seq", F.length("text").cast("long").alias("size"), F.xxhash64("text").alias("mark"),
                       F.xxhash64("plain").alias("short"), F.unhex(F.sha2("plain", 256)).alias("digest"), *(["row"] if carry else []))
    return materialize(rows, "digest-runs")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.min("best").alias("best"), F.sum("members").alias("members"))


def _told(below: DataFrame, verdicts: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of a level (its own lanes in ``under``) with the verdicts of the lane above."""
    return below.join(verdicts, list(KEY), how).withColumn("lane", F.col("under")).drop("under")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, and its columns ``carry`` as the struct ``row``."""
    runs = _runs(docs, id_col, text_col, carry or [])
    run = F.shiftright("seq", RUN_BIT)
    lanes = (runs.agg(F.max(run)).first()[0] or 0) + 1
    above = lambda lane: F.floor(lane / FAN).cast("long")
    level = runs.select(above(run).alias("lane"), "short", "digest", _order().alias("best"), F.lit(1).cast("long").alias("members"))
    levels = [materialize(_merged(level), "merged-0")]
    lanes = -(-lanes // FAN)
    while lanes > 1:
        levels.append(materialize(_merged(levels[-1].withColumn("lane", above(F.col("lane")))), f"merged-{len(levels)}"))
        lanes = -(-lanes // FAN)
    verdicts = levels[-1].where("members > 1")
    for level in reversed(levels[:-1]):
        below = level.select(above(F.col("lane")).alias("lane"), "short", "digest", F.col("lane").alias("under"))
        verdicts = materialize(_told(below, verdicts), "verdicts")
    leaves = runs.withColumn("lane", above(run)).withColumn("under", run)
    told = _told(leaves, verdicts, "left")
    alone = F.col("members").isNull()
    return told.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("members", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("best.seq") == F.col("seq"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *(["row"] if carry else []))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = marked(docs, id_col, text_col, docs.columns).where("kept")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM plain WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST)
"""
