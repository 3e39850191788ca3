"""Codes of four bytes for vectors: one codebook per quarter, fitted by rounds of integer Lloyd over resident members.

Every part of a vector is a member of the entry it was last assigned to. Members lie in tables dealt by (position, entry, salt); the
salt splits an entry with many members, so that an owner holds a bounded share of them. In a round every task assigns the members it
holds; those that keep their entry stay in place, and only those that change it are shuffled to their new owner. Owners then sum
their members, at most 256 sums per position leave them, and the new codebooks (256 times the width of a vector, whatever the number
of rows) go to all tasks. All sums are of integers, so the result depends on neither the order of rows nor the number of tasks.

Dropped are vectors that are null, empty, or hold null or non-finite components, and those not as wide as the first kept one (the
smallest id, then the least width). Widths that four does not divide give the first parts one component more. Components whose
integers are too large for exact squared distances in 64 bits are cut to the largest such integer; that is about 190,000,000 for 64
components. Entries come from the smallest ids that occur, each once (the least vector of a repeated id); null comes after all ids.
A table with fewer than 256 ids has fewer entries. Rows that repeat are coded one by one, and null labels share one label error,
which stops at the largest 64-bit integer. Only the named columns are read, so others can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import join_small
from parcelscope.session import materialize

POSITIONS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Members moved to one task in a round, and owners a task has about.
TASK_MEMBERS, OWNERS = 1 << 20, 4
#: Distances computed at once.
BLOCK = 2048
LARGEST = (1 << 63) - 1


def cuts(width: int) -> list[tuple[int, int]]:
    """Start and length of the parts."""
    lengths = [width // POSITIONS + (p < width % POSITIONS) for p in range(POSITIONS)]
    return [(sum(lengths[:p]), lengths[p]) for p in range(POSITIONS)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part the first of the nearest entries and its squared distance, exactly."""
    largest = max(int(abs(parts).max(initial=0)), int(abs(entries).max(initial=0)))
    at, error = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    exact_floats = 4 * parts.shape[1] * largest * largest < 1 << 53
    lengths = (entries * entries).sum(axis=1)
    for a in range(0, len(parts), BLOCK if exact_floats else BLOCK // 32):
        own = parts[a:a + (BLOCK if exact_floats else BLOCK // 32)]
        if exact_floats:
            far = lengths.astype(np.float64) - 2 * (own.astype(np.float64) @ entries.T.astype(np.float64))
        else:
            far = ((own[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        here = far.argmin(axis=1)
        at[a:a + len(own)] = here
        error[a:a + len(own)] = ((own - entries[here]) ** 2).sum(axis=1)
    return at, error


def _assigned(batch: pa.RecordBatch, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    positions = batch.column("position").to_numpy()
    at, error = np.zeros(len(positions), np.int32), np.zeros(len(positions), np.int64)
    for p, entries in enumerate(codebooks):
        rows = np.flatnonzero(positions == p)
        parts = batch.column("part").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        at[rows], error[rows] = nearest(parts.reshape(len(rows), entries.shape[1]), entries)
    return at, error


def assign(members: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """The members with the entry they belong to now, and whether they had another."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at, _ = _assigned(batch, codebooks)
            before = batch.column("entry").fill_null(-1).to_numpy(zero_copy_only=False)
            kept = [batch.column(c) for c in ("seq", "id", "label", "position", "part")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at), pa.array(at != before)], ["seq", "id", "label", "position", "part", "entry", "moved"])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    return members.select("seq", "id", "label", "position", "part", "entry").mapInArrow(
        batches, f"seq long, id {kinds['id']}, label {kinds['label']}, position int, part array<long>, entry int, moved boolean")


def _settled(members: DataFrame, codebooks: list[np.ndarray], moving: int) -> DataFrame:
    """The members after a round's assignment: residents where they were, movers with their new owners."""
    spark = members.sparkSession
    found = materialize(assign(members, codebooks), "assigned", ("moved",))
    movers = found.where("moved")
    counts = {(r["position"], r["entry"]): r["count"] for r in movers.groupBy("position", "entry").count().collect()}  # 1024 rows at most
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-moving // TASK_MEMBERS))
    share = max(1, sum(counts.values()) // (OWNERS * tasks))
    salts = ", ".join(str(-(-counts.get((p, e), 1) // share)) for p in range(POSITIONS) for e in range(ENTRIES))
    salt = F.expr(f"pmod(xxhash64(seq), get(array({salts}), position * {ENTRIES} + entry))")
    arrived = materialize(movers.withColumn("salt", salt).repartition(tasks, "position", "entry", "salt").drop("salt"), "arrived")
    return found.where(~F.col("moved")).unionByName(arrived)


def _updated(members: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry with members becomes the floor of their mean; one row per entry comes to the driver, 1024 at most."""
    width = max(c.shape[1] for c in codebooks)
    sums = members.groupBy("position", "entry").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("part", F.lit(i))) for i in range(width))).alias("sums"))
    out = [c.copy() for c in codebooks]
    for row in sums.collect():
        entries = out[row["position"]]
        entries[row["entry"]] = [s // row["n"] for s in row["sums"][:entries.shape[1]]]
    return out


def _parts(vectors: DataFrame, width: int) -> DataFrame:
    most = math.isqrt(LARGEST // width) // 2
    whole = F.transform("vector", lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.lit(float(SCALE)) * x))))
    return vectors.where(F.size("vector") == width).select("id", "label", whole.alias("vector"))


def _first_entries(vectors: DataFrame, width: int) -> list[np.ndarray]:
    ids = [r[0] for r in vectors.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).collect()]
    some = [i for i in ids if i is not None]
    wanted = F.col("id").isin(some) if len(some) == len(ids) else F.col("id").isin(some) | F.col("id").isNull()
    seeds = {r["id"]: r["vector"] for r in vectors.where(wanted).groupBy("id").agg(F.min("vector").alias("vector")).collect()}
    whole = np.array([seeds[i] for i in ids], np.int64)
    return [whole[:, start:start + length] for start, length in cuts(width)]


def compress(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of every kept vector, and the codebooks, one array of entries per position."""
    read = frame.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = read.where((F.size("vector") > 0) & finite)
    first = kept.select("id", F.size("vector").alias("width")).orderBy(F.col("id").asc_nulls_last(), "width").limit(1).collect()
    if not first:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = first[0]["width"]
    vectors = materialize(_parts(kept, width).withColumn("seq", F.monotonically_increasing_id()), "vectors")
    codebooks = _first_entries(vectors, width)
    pieces = F.posexplode(F.array(*(F.slice("vector", start + 1, length) for start, length in cuts(width)))).alias("position", "part")
    members = vectors.select("seq", "id", "label", pieces).withColumn("entry", F.lit(None).cast("int"))
    moving = POSITIONS * vectors.count()
    for _ in range(ROUNDS):
        members = _settled(members, codebooks, moving)
        codebooks = _updated(members, codebooks)
    return _coded(members, codebooks), codebooks


def _coded(members: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at, error = _assigned(batch, codebooks)
            kept = [batch.column(c) for c in ("seq", "id", "label", "position")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at), pa.array(error)], ["seq", "id", "label", "position", "entry", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    found = members.select("seq", "id", "label", "position", "part", "entry").mapInArrow(
        batches, f"seq long, id {kinds['id']}, label {kinds['label']}, position int, entry int, error long")
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("entry"))).cast("long"))), 2, "0") for p in range(POSITIONS)]
    whole = found.groupBy("seq", "id", "label").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
    return materialize(whole.drop("seq"), "codes")


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and place in the part."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def report(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector."""
    coded, codebooks = compress(frame, id_col, vector_col, label_col)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    labels = materialize(coded.groupBy("label").agg(total.alias("label_error")), "label-errors")
    return join_small(coded, labels, "label").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT n, p, min(256 * (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) + e)::BIGINT AS best
  FROM parts JOIN book{k} USING (p) GROUP BY n, p)""")
        if k < ROUNDS:
            steps.append(f"""
means{k} AS (
  SELECT p, e, list(floor(total / members) ORDER BY i) AS c
  FROM (SELECT p, best % 256 AS e, i, sum(x[i]) AS total, count(*) AS members
        FROM near{k} JOIN parts USING (n, p), (SELECT unnest(range(1, 1 + (SELECT any_value(len(x)) FROM parts))) AS i) GROUP BY ALL)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))""")
    return """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT n, vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM parts WHERE n <= 256),""" + ",".join(steps) + f""",
coded AS (
  SELECT n, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near{ROUNDS} GROUP BY n),
digest AS (
  SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS value, generate_subscripts(c, 1) AS i FROM book{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (n), digest
"""


SQL = _sql()
