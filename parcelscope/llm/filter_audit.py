"""Audit of five filters under every order of application.

A document's outcome under all orders depends only on the set of filters it fails, a mask of five bits. Every mask is mapped to one
big integer with a field of 64 bits for each of the 600 steps (120 orders of five steps), 1 where the step removes the document,
and further fields for the filters it fails, the only filter it fails, and itself. Documents are first counted per (part, mask,
labels); per part the integers times their counts are summed, once for all documents, once for good and once for toxic ones. A
field's sum is at most 120 times a count of documents, so no field runs into the next, and all counts of the audit are read off.

A null text is empty and has no words. The part of a null ``lang`` is the empty string. A document fails the copy filter if the same
text has a smaller id, whatever part that is in; a null id is neither smaller nor larger, so such a row never fails it, and rows
repeated with one id don't fail it through each other. A document is good or toxic if any of its label rows says so; several label
rows don't multiply it, and a null id has no label. Texts are read whole. Only the named columns are read, so others can't clash. An
empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.session import materialize

#: The filters (fixed values): least words; least distinct words and most capitals in percent; marks.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
WHITE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"

ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
#: Fields of an integer: the steps, the filters failed, the only filter failed, the document.
FAILS, ONLY, SELF = len(STEPS), len(STEPS) + len(FILTERS), len(STEPS) + 2 * len(FILTERS)
FIELDS, FIELD_BYTES = SELF + 1, 8


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def packed(mask: int) -> int:
    """The integer of a mask."""
    fields = [at for at, (order, k) in enumerate(STEPS) if mask & _bit(order[k]) and not any(mask & _bit(x) for x in order[:k])]
    fields += [FAILS + i for i in range(len(FILTERS)) if mask >> i & 1]
    fields += [ONLY + i for i in range(len(FILTERS)) if mask == 1 << i]
    return sum(1 << 8 * FIELD_BYTES * at for at in [*fields, SELF])


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of integers."""
    return np.frombuffer(total.to_bytes(FIELDS * FIELD_BYTES, "little"), "<i8")


PACKED = [packed(mask) for mask in range(1 << len(FILTERS))]
OUTCOME = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, " \
          "toxic_lost long, shapley long"


def _audited(part: str, rows: list[dict]) -> dict[str, object]:
    everyone, good, toxic = (unpacked(sum(r["n"] * PACKED[r["mask"]] for r in rows if r[of])) for of in ("all", "good", "toxic"))
    filter_at = np.array([FILTERS.index(order[k]) for order, k in STEPS])
    removed = everyone[:len(STEPS)]
    of_filter = np.zeros(len(FILTERS), np.int64)
    np.add.at(of_filter, filter_at, removed)
    return {
        "part": [part] * len(STEPS), "filter_order": [order for order, _ in STEPS], "step": np.array([k + 1 for _, k in STEPS], np.int32),
        "kept": everyone[SELF] - removed.reshape(-1, len(FILTERS)).cumsum(axis=1).ravel(), "removed": removed,
        "redundant": everyone[FAILS + filter_at] - removed, "unique_fails": everyone[ONLY + filter_at],
        "good_lost": good[:len(STEPS)], "toxic_lost": toxic[:len(STEPS)], "shapley": of_filter[filter_at]}


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    worded = read.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    fails = [F.size("words") < LEAST_WORDS, 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * F.size("words"),
             100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.length("text").cast("long"),
             F.col("text").rlike(MARKS)]
    own = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)), F.lit(0))
    rows = materialize(worded.select("id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-masks")
    # Only the first id of a text passes the copy filter, so the join is on the id too and a group of copies is no hot key.
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(fails)).otherwise(0)
    return rows.join(firsts, ["digest", "id"], "left").select("id", "part", (F.col("own") + copy).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, zeros included; ``labels`` has the id, ``quality`` and ``toxic``."""
    flags = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    judged = masks(docs, id_col, text_col, part_col).join(flags, "id", "left")
    counted = judged.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
                             F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))

    def per_part(key: tuple, rows: pa.Table) -> pa.Table:
        # At most 128 rows: masks times labels.
        return pa.table(_audited(key[0].as_py(), rows.append_column("all", pa.array([True] * len(rows))).to_pylist()))

    return counted.groupBy("part").applyInArrow(per_part, OUTCOME)


def _sql() -> str:
    steps = ",\n  ".join(f"('{order}', {k + 1}, {_bit(order[k])}, {sum(map(_bit, order[:k]))})" for order, k in STEPS)
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {MOST_CAPITALS} * length(text))::INT
         + 8 * regexp_matches(text, '{MARKS}')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
  FROM worded LEFT JOIN flags USING (doc_id)),
counted AS (SELECT part, mask, good, toxic, count(*) AS n FROM masked GROUP BY ALL),
steps(filter_order, step, bit, before) AS (VALUES
  {steps}),
summed AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(n) FILTER (good AND mask & bit > 0 AND mask & before = 0) AS good_lost,
         sum(n) FILTER (toxic AND mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM summed
"""


SQL = _sql()
