"""Near-duplicate vectors by sorted projection passes.

A pass orders the vectors of a label lexicographically by the concatenated bits of random hyperplanes, over partition edges, and compares
every vector with its ``WINDOW`` next neighbours in that order. Two vectors at the threshold share ``k`` leading bits with a known
probability, however the other vectors lie, and are then in one run of the order; the passes that leave such a pair apart with probability
``MISSED`` follow from ``k`` alone. A window reaches over a whole run of at most ``WINDOW + 1`` vectors. A longer run is compared whole
besides, in blocks, so no pair of a run is left out. ``k`` is chosen per label by the measured lengths of its runs, for the least work:
dense labels need more bits and passes; a label no larger than a window needs one pass. Equal vectors are one vector here.

The order carries a key, the bits and a sketch of 256 more signs. Neighbours whose sketches differ in more bits than a pair at the
threshold does (but for one in a million) are not compared; vectors follow only for rows that have such a neighbour. Pairs are verified
in double precision, and only links that join two trees are returned, never the pairs of a large group. The passes' links, united, give
the components.

The links themselves are then counted exactly: members of a component are compared with each other in blocks, so every linked pair
counts that the passes have brought into one component, whatever bucket it was in.

Only vectors with equal labels and dimensions are compared. A vector that is null, zero or holds a null or non-finite number, or whose
label is null, links with nothing. Rows that repeat an id, a label and a vector are one vector; an id with different vectors has the
links of all of them. Rows with a null id link with nothing and have a null component; ``kept`` is true for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import BROADCAST_ROWS
from parcelscope.operators.linking import components
from parcelscope.operators.ranking import global_positions
from parcelscope.session import materialize

NEAR = 0.93
BITS = 32
MISSED = 1e-4
SEED = 20_240_731
#: Members of a component, and vectors of a long run, in one block.
BLOCK, BUCKET_BLOCK = 1024, 4096
#: Next neighbours in the order that a vector is compared with, and positions of the order in one group.
WINDOW, STRETCH = 128, 8192
#: Leading bits that a label's runs may share, and the work of dealing out a row in compared pairs.
LEVELS = (4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32)
ROW_WORK = 500
#: Signs of a sketch, in bits, and the part of the pairs at the threshold that its filter may lose.
SKETCH, SKETCH_MISSED = 256, 1e-6


def sketch_limit() -> int:
    """Differing bits of two sketches that all but ``SKETCH_MISSED`` of the pairs at the threshold stay within."""
    p = math.acos(NEAR) / math.pi
    tail = 1.0
    for bits in range(SKETCH):
        tail -= math.comb(SKETCH, bits) * p ** bits * (1 - p) ** (SKETCH - bits)
        if tail <= SKETCH_MISSED:
            return bits
    return SKETCH


def passes_for(bits: int) -> int:
    """Passes after which at most ``MISSED`` of the pairs at the threshold have shared no bucket of so many bits."""
    if not bits:
        return 1
    shared = (1 - math.acos(NEAR) / math.pi) ** bits
    return math.ceil(math.log(MISSED) / math.log1p(-shared))


def _planes(turn: int, dimension: int, number: int = BITS) -> np.ndarray:
    return np.random.default_rng((SEED, turn, dimension, number)).standard_normal((dimension, number))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector array<double>), distinct, of the vectors that can link."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    plain = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(plain & some).distinct()


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: no square over- or underflows, no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _scaled(flat.reshape(len(column), -1))


def _projected(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every (key, label, vector, bits, passes) once per pass, with its signs and its sketch."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in rows:
        size, k, passes = np.diff(batch.column(2).offsets.to_numpy()), batch.column(3).to_numpy(), batch.column(4).to_numpy()
        for d, bits in np.unique(np.stack([size, k], axis=1), axis=0).tolist():
            chosen = (size == d) & (k == bits)
            part = batch.filter(pa.array(chosen))
            x, n = _matrix(part.column(2)), part.num_rows
            if (-1, d) not in planes:
                planes[-1, d] = _planes(0, d, SKETCH)
            sketches = np.packbits(x @ planes[-1, d] > 0, axis=1)
            sketch = pa.array([row.tobytes() for row in sketches], pa.binary())
            for turn in range(int(passes[chosen].max())):
                if (turn, d) not in planes:
                    planes[turn, d] = _planes(turn, d)
                signs = np.packbits(x @ planes[turn, d] > 0, axis=1).view(">u4").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, turn, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(signs),
                     pa.array(np.full(n, bits, np.int32)), part.column(0), part.column(1), sketch],
                    ["turn", "dimension", "signs", "bits", "key", "label", "sketch"])


def _prefix(bits: Column) -> Column:
    return F.call_function("shiftright", F.col("signs"), F.lit(BITS) - bits)


def _bits_by_label(rows: DataFrame) -> DataFrame:
    """(of_label, of_dimension, bits, passes): the leading bits with the least work, by the runs of one pass."""
    label_type = rows.schema["label"].dataType.simpleString()
    key = ("label", "dimension")
    sizes = materialize(rows.groupBy("label", F.size("vector").alias("dimension")).agg(F.count("*").alias("n")), "label-sizes")
    small = sizes.where(F.col("n") <= WINDOW + 1).select(*key, F.lit(0).alias("bits"), F.lit(1).alias("passes"))
    large = sizes.where(F.col("n") > WINDOW + 1).select(F.col("label").alias("of_label"), F.col("dimension").alias("of_dimension"))
    measured = _join_few(rows, large, (F.col("label") == F.col("of_label")) & (F.size("vector") == F.col("of_dimension")), "left_semi")
    ordered = measured.select("key", "label", "vector", F.lit(BITS).alias("bits"), F.lit(1).alias("passes")) \
        .mapInArrow(_projected, _keyed(label_type))
    # Rows are summed by their whole signs before they are dealt out to the levels.
    ordered = ordered.groupBy(*key, "signs").agg(F.count("*").alias("n"))
    levels = F.array(*(F.struct(F.lit(k).alias("bits"), F.lit(passes_for(k)).alias("passes")) for k in LEVELS))
    runs = ordered.withColumn("level", F.explode(levels)) \
        .groupBy(*key, "level", _prefix(F.col("level.bits")).alias("prefix")).agg(F.sum("n").cast("double").alias("n"))
    # A row of a long run is dealt out once more per block of the run.
    long = F.when(F.col("n") > WINDOW + 1, F.col("n") * F.col("n") + ROW_WORK * F.col("n") * F.ceil(F.col("n") / BUCKET_BLOCK)).otherwise(0.0)
    best = runs.groupBy(*key, "level").agg(F.sum(ROW_WORK * F.col("n") + long).alias("work")) \
        .groupBy(*key).agg(F.min(F.struct(F.col("level.passes") * F.col("work"), "level")).alias("best")) \
        .select(*key, "best.level.bits", "best.level.passes")
    return materialize(small.unionByName(best).withColumnsRenamed({"label": "of_label", "dimension": "of_dimension"}), "label-bits")


def _keyed(label_type: str) -> str:
    return f"turn int, dimension int, signs long, bits int, key long, label {label_type}, sketch binary"


def _join_few(rows: DataFrame, few: DataFrame, on: Column, how: str) -> DataFrame:
    """Join a table that most often has few rows, which is then broadcast."""
    return rows.join(F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few, on, how)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    length_x, length_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    near = np.empty((len(x), len(y)), bool)
    for a in range(0, len(x), 256):
        near[a:a + 256] = (x[a:a + 256] @ y.T) / (length_x[a:a + 256, None] * length_y[None, :]) >= NEAR
    return near


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their tree's first row, columns, their tree's first row) of the trees that link rows with columns."""
    back = np.ascontiguousarray(near.T)
    row_of, column_of = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for first in np.flatnonzero(near.any(axis=1)).tolist():
        if row_of[first] >= 0:
            continue
        row_of[first], rows = first, np.array([first])
        while len(rows):
            columns = np.flatnonzero(near[rows].any(axis=0) & (column_of < 0))
            column_of[columns] = first
            rows = np.flatnonzero(back[columns].any(axis=0) & (row_of < 0)) if len(columns) else columns
            row_of[rows] = first
    rows, columns = np.flatnonzero(row_of >= 0), np.flatnonzero(column_of >= 0)
    return rows, row_of[rows], columns, column_of[columns]


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a pack in the passes' order, with numbers of their stretches, positions, and sketches."""
    label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    keys = np.stack([table["at"].to_numpy(), *(table[c].to_numpy().astype(np.int64) for c in ("stretch", "turn", "dimension")), label])
    order = np.lexsort(keys)
    keys = keys[:, order]
    group = np.cumsum(np.append(False, (keys[1:, 1:] != keys[1:, :-1]).any(axis=0)))
    table = table.take(pa.array(order))
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(order), -1)
    return table, group, keys[0], sketches


def _neighbours(group: np.ndarray, at: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in one window whose sketches are near, by distance in the pack."""
    limit = sketch_limit()
    for shift in range(1, min(WINDOW + 1, len(at))):
        lower = np.flatnonzero((group[:-shift] == group[shift:]) & (at[shift:] - at[:-shift] <= WINDOW))
        if not len(lower):
            return
        differ = np.bitwise_count(sketches[lower] ^ sketches[lower + shift]).sum(axis=1, dtype=np.int64)
        lower = lower[differ <= limit]
        yield lower, lower + shift


def _asked(table: pa.Table) -> pa.Table:
    """The rows of a pack of stretches that have a near sketch in their window."""
    table, group, at, sketches = _in_order(table.combine_chunks())
    asked = np.zeros(len(at), bool)
    for lower, upper in _neighbours(group, at, sketches):
        asked[lower] = asked[upper] = True
    return table.filter(pa.array(asked))


def _compared(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between neighbours in a pack of stretches."""
    table, group, at, sketches = _in_order(table.combine_chunks())
    ids, size = table["id"].to_numpy(), table["dimension"].to_numpy()
    vectors = table["vector"].combine_chunks()
    place, matrices, lengths = np.empty(len(ids), np.int64), {}, {}
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        place[own] = np.arange(len(own))
        matrices[d] = _matrix(vectors.take(pa.array(own)))
        lengths[d] = np.sqrt((matrices[d] * matrices[d]).sum(axis=1))
    root = np.arange(len(ids))
    u, v = [], []
    for lower, upper in _neighbours(group, at, sketches):
        apart = root[lower] != root[upper]
        lower, upper = lower[apart], upper[apart]
        for d in np.unique(size[lower]).tolist():
            of = size[lower] == d
            a, b, x, length = place[lower[of]], place[upper[of]], matrices[d], lengths[d]
            near = np.einsum("ij,ij->i", x[a], x[b]) / (length[a] * length[b]) >= NEAR
            for i, j in zip(lower[of][near].tolist(), upper[of][near].tolist(), strict=True):
                one, two = i, j
                while root[one] != one:
                    one = root[one]
                while root[two] != two:
                    two = root[two]
                if one != two:
                    root[max(one, two)] = min(one, two)
                    u.append(ids[i])
                    v.append(ids[j])
        while not (root[root] == root).all():
            root = root[root]
    u, v = np.array(u, np.int64), np.array(v, np.int64)
    return pa.table({"u": u[u != v], "v": v[u != v]})


def _linked(table: pa.Table) -> pa.Table:
    """A spanning forest of the links of each long run, or of each pair of its blocks, in a pack."""
    table = table.combine_chunks()
    label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    keys = np.stack([label, *(table[c].to_numpy() for c in ("turn", "dimension", "prefix", "low", "high"))]).astype(np.int64)
    order = np.lexsort(keys)
    keys = keys[:, order]
    begins = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    sizes = np.diff(np.append(begins, len(order)))
    ids, block = table["id"].to_numpy()[order], table["block"].to_numpy()[order]
    vectors = table["vector"].combine_chunks().take(pa.array(order))
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        x, own, low, high = _matrix(vectors.slice(a, n)), ids[a:a + n], keys[4, a], keys[5, a]
        one = two = slice(None)
        if low != high:
            one, two = block[a:a + n] == low, block[a:a + n] == high
        near = _near(x[one], x[two])
        if low == high:
            np.fill_diagonal(near, False)
        if near.any():
            rows, row_of, columns, column_of = _forest(near)
            u += [own[one][row_of], own[one][column_of]]
            v += [own[one][rows], own[two][columns]]
    u, v = np.concatenate(u), np.concatenate(v)
    return pa.table({"u": u[u != v], "v": v[u != v]})


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """How many linked vectors each vector has in the other block, or in its own."""
    low, high = rows["low"].iat[0], rows["high"].iat[0]
    out = []
    for _, part in rows.groupby([rows["component"], rows["label"], rows["vector"].map(len)], sort=False):
        one, two = (part, part) if low == high else (part[part["block"] == low], part[part["block"] == high])
        if not len(one) or not len(two):
            continue
        x, y = _scaled(np.stack(one["vector"].to_numpy())), _scaled(np.stack(two["vector"].to_numpy()))
        length_x, length_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        of_two = np.zeros(len(two), np.int64)
        of_one = np.empty(len(one), np.int64)
        ids_x, ids_y = one["id"].to_numpy(), two["id"].to_numpy()
        for a in range(0, len(one), 256):
            near = (x[a:a + 256] @ y.T) / (length_x[a:a + 256, None] * length_y[None, :]) >= NEAR
            near &= ids_x[a:a + 256, None] != ids_y[None, :]
            of_one[a:a + 256] = near.sum(axis=1)
            of_two += near.sum(axis=0)
        out.append(pd.DataFrame({"id": ids_x, "links": of_one}))
        if low != high:
            out.append(pd.DataFrame({"id": ids_y, "links": of_two}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "links": []}).astype("int64")


def _by_windows(planned: DataFrame, vectors: DataFrame, label_type: str) -> DataFrame:
    """(u, v): links between neighbours of all passes, and those of the runs that are longer than a window."""
    order = ("turn", "label", "dimension")
    placed = global_positions(planned.mapInArrow(_projected, _keyed(label_type)), order, [F.col("signs"), F.col("key")], "at")
    run = (*order, "prefix")
    placed = placed.withColumn("prefix", _prefix(F.col("bits")))
    runs = materialize(placed.groupBy(*run).agg(F.count("*").alias("size")).where(F.col("size") > WINDOW + 1)
                       .withColumnsRenamed({c: f"of_{c}" for c in run}), "long-runs")
    # The first WINDOW rows of a stretch are also the last ones of the stretch before: windows reach over its edge.
    stretch = F.floor(F.col("at") / STRETCH)
    both = F.array(stretch, F.when((F.col("at") % STRETCH < WINDOW) & (stretch > 0), stretch - 1))
    packs = max(1, placed.count() // (2 * STRETCH))
    dealt = placed.select(*order, "key", "at", "sketch", F.explode(F.array_compact(both)).alias("stretch")) \
        .withColumn("pack", F.pmod(F.xxhash64(*order, "stretch"), F.lit(packs)))
    names = ("turn", "label", "dimension", "key", "at", "sketch", "stretch", "pack")
    asked = materialize(dealt.groupBy("pack").applyInArrow(
        _asked, ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in names)), "near-sketches")
    found = asked.join(vectors, "key").groupBy("pack").applyInArrow(_compared, "u long, v long")
    of_runs = runs.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BUCKET_BLOCK))).first()[0]
    if not of_runs:
        return found
    same = [F.col(c) == F.col(f"of_{c}") for c in run]
    cut = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    blocks = _join_few(placed.select(*run, "key"), runs, same[0] & same[1] & same[2] & same[3], "inner").join(vectors, "key") \
        .withColumn("block", F.pmod(F.xxhash64("key"), cut).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), cut - 1))) \
        .select(*run, "id", "vector", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    packs = max(1, int(of_runs) // (2 * BUCKET_BLOCK))
    return found.unionByName(blocks.groupBy(F.pmod(F.xxhash64(*run, "low", "high"), F.lit(packs)).alias("pack"))
                             .applyInArrow(_linked, "u long, v long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col, label_col), "vectors")
    label_type = rows.schema["label"].dataType.simpleString()
    # Equal vectors are linked with the least id among them, which stands for them in the passes.
    equal = materialize(rows.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("size"))
                        .withColumn("key", F.monotonically_increasing_id()), "equal-vectors")
    shared = equal.where("size > 1").select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), F.col("id").alias("u"))
    copies = _join_few(rows, shared, (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector")), "inner") \
        .where("id <> u").select("u", F.col("id").alias("v"))
    chosen = _bits_by_label(equal.select("key", "label", "vector"))
    planned = _join_few(equal, chosen, (F.col("label") == F.col("of_label")) & (F.size("vector") == F.col("of_dimension")), "inner") \
        .select("key", "label", "vector", "bits", "passes")
    found = _by_windows(planned, equal.select("key", "id", "vector"), label_type).unionByName(copies)
    links = materialize(found.distinct(), "vector-links")
    grouped = materialize(components(links).select(F.col("node").alias("id"), "component"), "vector-components")
    sizes = grouped.groupBy("component").agg(F.count("*").alias("size"))
    members = rows.join(grouped, "id").join(sizes, "component")
    # Small components share a group of about two blocks' size; a large one has a group per pair of its blocks.
    packs = max(1, grouped.count() // BLOCK)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.withColumn("pack", F.when(blocks > 1, F.col("component")).otherwise(
        -1 - F.pmod(F.xxhash64("component"), F.lit(packs)))) \
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("pack", "component", "id", "label", "vector", "block",
                F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    counted = placed.groupBy("pack", "low", "high").applyInPandas(_counted, "id long, links long") \
        .groupBy("id").agg(F.sum("links").alias("n_links"))
    results = grouped.join(counted, "id", "left").select(F.col("id").alias("own"), "component", "n_links")
    smallest = F.coalesce("component", "id")
    return vectors.select(F.col(id_col).cast("long").alias("id")).join(results, F.col("id") == F.col("own"), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), smallest.alias("component_id"),
        F.coalesce(smallest == F.col("id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
smallest AS (SELECT u, least(u, min(v)) AS component_id FROM reached GROUP BY u),
degrees AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN smallest s ON e.vec_id = s.u LEFT JOIN degrees d ON e.vec_id = d.u
"""
