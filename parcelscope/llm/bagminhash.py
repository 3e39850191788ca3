"""Near-duplicate documents by weighted Jaccard similarity of their word shingles (as multisets), with BagMinHash signatures.

A shingle that occurs c times covers the interval [0, c) of weights. Weights are cut into the dyadic intervals [0, 1), [1, 2),
[2, 4), [4, 8) ...; every (shingle, interval) has a Poisson process whose rate is the interval's length and whose points carry a
time, one of ``SIZE`` components and a level inside the interval. Points at a level of c or more are thinned out. The earliest
point of a component is its signature value; two documents share it with a probability equal to their weighted Jaccard similarity.
Points are made in order of time and only up to a bound that shrinks with a document's weight, so most shingles make none.

Bands of the signature give candidate pairs. A node is a content: all documents with equal multisets. In every band's bucket
a node is compared with the bucket's smallest node, and its best such pair is verified by the exact overlap; this ties large
groups of copies together without listing their pairs. What is left are pairs of one bucket in different components: these are
all compared by signature and verified exactly if the estimate is near the threshold; in blocks, where a bucket is large, and there
unless verified links of the block join the two already, so that a block gives a spanning forest instead of its pairs.

Classes are connected components; the class id is the smallest document id. Documents without words and documents with a null
id are alike to nothing (a null id has a null class). A repeated id is in one class, which joins those of its contents. ``distinct``
goes by the contents alone: unlike texts with one id both stay, and documents with a null id count. Very long texts are taken whole. Only the id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope.llm.common import chunks, held, mix64, rest, texts_of
from parcelscope.llm.shingles import BITS, WordHashes, overlaps, shingles
from parcelscope.operators.linking import components
from parcelscope.session import materialize

WORDS = 5
SIMILAR = 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99985; one at 0.25, as of short
#: documents with a common passage, with 0.0007.
BANDS, ROWS = 48, 8
SIZE = BANDS * ROWS
#: An estimate this many standard deviations below the threshold rules a pair out (2 in 10,000 of those at the threshold).
DEVIATIONS = 3.5
SURE_NO = SIMILAR - DEVIATIONS * (SIMILAR * (1 - SIMILAR) / SIZE) ** 0.5
CHUNK, DOCS = 1 << 20, 1024
#: Documents of a bucket compared by a join, and in one block of a larger bucket.
SMALL, BLOCK = 16, 1024
#: Bytes of the texts in one block, and shingles of the pairs verified at a time there.
BLOCK_BYTES, VERIFIED = 16 << 20, 1 << 20
#: Times are run through in steps, in units of the mean time between two points of a component. At the end of the first step
#: about a third of the documents have a point in every component, at the end of each further one a larger share of the rest.
FIRST_STEP, STEP = float(np.log(SIZE)), 0.75
#: Points made at once by few processes, the least number of points of a process, and what leads from one draw to the next.
AT_ONCE, LEAST_AHEAD = 1 << 15, 2
NEXT = np.uint64(0xE7037ED1A0B428DB)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int) -> np.ndarray:
    """(documents, SIZE) signature values as 16-bit hashes of the earliest points; rows of documents without shingles are 0."""
    weight = np.bincount(owner, count, docs)
    best = np.full(docs * SIZE, np.inf)
    running = []
    low, length = 0, 1
    while len(owner):
        seed = mix64(shingle * np.uint64(64) + np.uint64(low.bit_length() + 1))
        running.append((low, length, (owner, np.log(_uniform(mix64(seed))) / -length, seed, count)))
        more = count > low + length
        owner, shingle, count = owner[more], shingle[more], count[more]
        low, length = low + length, low + length
    left, until = weight > 0, FIRST_STEP
    while left.any():
        bound = np.where(left, SIZE * until / np.maximum(weight, 1), 0.0)
        running = [(low, length, _points(best, points, low, length, bound)) for low, length, points in running]
        left &= np.isinf(best.reshape(docs, SIZE)).any(axis=1)
        running = [(low, length, tuple(x[on] for x in points)) for low, length, points in running for on in [left[points[0]]]]
        until += STEP
    bits = mix64(best.view(np.uint64)) >> np.uint64(48)
    return np.where(np.isinf(best), 0, bits).astype(np.uint16).reshape(docs, SIZE)


def _points(best, points, low, length, bound):
    """Run the processes of one interval up to the bounds and keep each component's earliest point below the weight; the first
    points beyond the bounds. Few processes make many points at a time; a point's draw goes by its number alone."""
    owner, time, draw, weight = points
    later = []
    while True:
        on = time < bound[owner]
        off, on = np.flatnonzero(~on), np.flatnonzero(on)
        later.append((owner[off], time[off], draw[off], weight[off]))
        owner, time, draw, weight = owner[on], time[on], draw[on], weight[on]
        if not len(owner):
            return tuple(np.concatenate(x) for x in zip(*later, strict=True))
        ahead = min(max(AT_ONCE // len(owner), LEAST_AHEAD), 256)
        drawn = mix64(draw + NEXT * np.arange(ahead + 1, dtype=np.uint64)[:, None])
        times = np.empty(drawn.shape)
        times[0] = time
        times[1:] = np.log(_uniform(drawn[1:])) / -length
        times = np.cumsum(times, axis=0, out=times)
        early = times[:-1] < bound[owner]
        passed = early.sum(axis=0)
        at, process = np.nonzero(early)
        place = mix64(drawn[at, process] ^ np.uint64(0xA0761D6478BD642F))
        slot, first = owner[process] * SIZE + ((place >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64), times[at, process]
        if length > 1:  # the halves of an interval are chosen by the bits of a point's level
            kept = low + (place & np.uint64(length - 1)).astype(np.int64) < weight[process]
            slot, first = slot[kept], first[kept]
        np.minimum.at(best, slot, first)
        time = times[passed, np.arange(len(owner))]
        draw = draw + NEXT * passed.astype(np.uint64)


def _key(text: Column) -> Column:
    """Names a text; a null one is an empty one."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, content, signature): names of the text and of its multiset, and the signature; the last two null without words."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held("words", WordHashes)
        for batch in rows:
            texts = texts_of(batch.column(2))
            for a, b in ((i, j) for x, y in chunks([len(t) + 1 for t in texts], CHUNK) for i in range(x, y, DOCS)
                         for j in [min(y, i + DOCS)]):
                owner, shingle, count = shingles(texts[a:b], WORDS, known)
                signed = signatures(owner, shingle, count, b - a)
                at = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
                content = [xxhash.xxh3_128_digest(shingle[i:j].tobytes() + count[i:j].astype(np.int64).tobytes()) if i < j else None
                           for i, j in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(content, pa.binary()),
                     pa.array([s.tobytes() if c else None for s, c in zip(signed, content, strict=True)], pa.binary())],
                    ["id", "key", "content", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), _key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda part: rest(batches(part)), "id long, key string, content binary, signature binary")


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, SIZE) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    known, out = held("words", WordHashes), []
    first, second = list(a), list(b)
    for i, j in chunks([len(x) + len(y) for x, y in zip(first, second, strict=True)], CHUNK):
        least, greatest = overlaps(first[i:j], second[i:j], WORDS, known)
        out.extend((least * 5 >= greatest * 4).tolist())
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole texts overlap enough."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    read = texts.join(needed, "id", "left_semi")
    both = pairs.join(read.select(F.col("id").alias("u"), F.col("text").alias("left")), "u") \
        .join(read.select(F.col("id").alias("v"), F.col("text").alias("right")), "v")
    return both.where(_alike("left", "right")).select("u", "v")


def _blocks_of(rows: DataFrame) -> DataFrame:
    """Every row of a bucket once per pair of blocks that its block is in; blocks hold few rows and, on average, few bytes."""
    n = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    return rows.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), n - 1))) \
        .select("bucket", "band", "id", "component", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))


class Bags:
    """The shingles of some texts, to verify pairs of them."""

    def __init__(self, texts: list[str]):
        known, parts = held("words", WordHashes), []
        for a, b in chunks([len(t) + 1 for t in texts], CHUNK):
            owner, shingle, count = shingles(texts[a:b], WORDS, known)
            parts.append((owner + a, shingle, count))
        owner, self.shingle, self.count = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.start = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.size = np.diff(self.start)
        self.weight = np.bincount(owner, self.count, len(texts)).astype(np.int64)

    def _of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pair and shingle, count) of the texts that stand on one side of the pairs."""
        sizes = self.size[texts]
        pair = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(pair)) + np.repeat(self.start[texts] - (np.cumsum(sizes) - sizes), sizes)
        return pair.astype(np.uint64) << np.uint64(BITS) | self.shingle[at], self.count[at]

    def alike(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which pairs overlap enough; pairs whose weights alone rule it out are not compared."""
        low, high = np.sort([self.weight[first], self.weight[second]], axis=0)
        out = low * 5 >= high * 4
        left = np.flatnonzero(out)
        for a, b in chunks((self.size[first[left]] + self.size[second[left]]).tolist(), VERIFIED):
            pairs = left[a:b]
            (x, c), (y, d) = self._of(first[pairs]), self._of(second[pairs])
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            least = np.bincount((x[i] >> np.uint64(BITS)).astype(np.int64), np.minimum(c[i], d[j]), len(pairs)).astype(np.int64)
            out[pairs] = least * 5 >= (self.weight[first[pairs]] + self.weight[second[pairs]] - least) * 4
        return out


def _near_pairs(x: np.ndarray, one: np.ndarray, two: np.ndarray, groups: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of each block or both of the one block, of different groups with a near estimate, nearest first. A pair
    belongs to the first band it shares, so no other bucket gives it again."""
    us, vs, equals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, u in enumerate(one.tolist()):
        other = two[at + 1:] if one is two else two
        other = other[groups[other] != groups[u]]
        same = x[other] == x[u]
        equal = same.sum(axis=1)
        near = equal >= SURE_NO * SIZE
        near[near] = same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        us.append(np.full(int(near.sum()), u))
        vs.append(other[near])
        equals.append(equal[near])
    order = np.argsort(-np.concatenate(equals), kind="stable")
    return np.concatenate(us)[order], np.concatenate(vs)[order]


def _tied_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Verified links that join the components of a pair of blocks as all their near pairs would: a spanning forest. A pair is
    verified unless links found before it join its components already; pairs that fail never leave the task."""
    low, high, band = rows["low"].iat[0], rows["high"].iat[0], int(rows["band"].iat[0])
    rows = rows.sort_values("id")
    ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
    one = two = np.flatnonzero(block == low)
    if low != high:
        two = np.flatnonzero(block == high)
    group = np.unique(rows["component"], return_inverse=True)[1]
    x = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, SIZE)
    u, v = _near_pairs(x, one, two, group, band)
    if not len(u):
        return pd.DataFrame({"u": ids[:0], "v": ids[:0]})
    used = np.unique(np.concatenate([u, v]))
    bags = Bags([rows["text"].iat[i] for i in used.tolist()])
    out, step = [], 64
    while len(u):
        now = slice(0, step)
        good = np.flatnonzero(bags.alike(np.searchsorted(used, u[now]), np.searchsorted(used, v[now])))
        for k in good.tolist():
            a, b = group[u[k]], group[v[k]]
            if a != b:
                group[group == b] = a
                out.append((ids[u[k]], ids[v[k]]))
        u, v = u[step:], v[step:]
        apart = group[u] != group[v]
        u, v, step = u[apart], v[apart], min(2 * step, 1 << 14)
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def _open(shared: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, bucket, band, component, size, bytes) of the buckets that hold more than one component of the links."""
    placed = shared.select("id", "bucket", "band").join(components(links).withColumnRenamed("node", "id"), "id", "left") \
        .join(texts.select("id", F.octet_length("text").alias("bytes")), "id") \
        .select("id", "bucket", "band", F.coalesce("component", "id").alias("component"), "bytes")
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.min("component").alias("a"),
                                         F.max("component").alias("b")).where("a <> b").select("bucket", "size", "bytes")
    return placed.drop("bytes").join(mixed, "bucket")


def _content_classes(sketched: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(content, component) of every content of the sketched rows, which all have one."""
    # Every content has one text that stands for it. Numbers of nodes are written once, so they stay what they are.
    named = sketched.groupBy("content").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"), F.first("signature").alias("signature"))
    written = materialize(named.select(F.monotonically_increasing_id().alias("id"), "content", "signature",
                                       F.col("first.id").alias("of_id"), F.col("first.key").alias("key")), "contents")
    nodes = written.select("id", "signature")
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("signature", k * ROWS * 2 + 1, ROWS * 2)) for k in range(BANDS)))
    buckets = nodes.select("id", F.posexplode(bands).alias("band", "bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(buckets.join(heads, "bucket"), "buckets")
    first = shared.where("id <> head").select("id", "head").distinct()
    # The rows with a node's id and text are equal: one of them is read.
    def name(key: str, id_: str) -> Column:
        return F.concat_ws(":", F.col(key), F.col(id_).cast("string")).alias("name")

    wanted = shared.select("id").distinct().join(written.select("id", name("key", "of_id")), "id")
    read = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")) \
        .withColumn("key", _key(F.col("text"))).select(name("key", "row_id"), "text")
    texts = materialize(read.join(wanted, "name").groupBy("name", "id").agg(F.first("text").alias("text")).select("id", "text"), "texts")
    rated = first.join(nodes, "id").join(nodes.select(F.col("id").alias("head"), F.col("signature").alias("other")), "head") \
        .select("id", "head", _estimate("signature", "other").alias("estimate")).where(F.col("estimate") >= SURE_NO)
    best = rated.groupBy("id").agg(F.max(F.struct("estimate", (-F.col("head")).alias("minus"))).alias("best")) \
        .select(F.col("id").alias("u"), (-F.col("best.minus")).alias("v"))
    best = materialize(best, "best")
    links = materialize(_verified(best, texts), "links")
    tested = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    open_rows = _open(shared, links, texts)
    small = open_rows.where(F.col("size") <= SMALL)
    other = small.select("bucket", F.col("id").alias("v"), F.col("component").alias("theirs"))
    few = small.join(other, "bucket").where("id < v AND component <> theirs").select(F.col("id").alias("u"), "v").distinct()
    few = few.join(nodes.select(F.col("id").alias("u"), F.col("signature").alias("x")), "u") \
        .join(nodes.select(F.col("id").alias("v"), F.col("signature").alias("y")), "v") \
        .where(_estimate("x", "y") >= SURE_NO).select("u", "v")
    fresh = materialize(few.join(tested, ["u", "v"], "left_anti"), "rest")
    # Texts come to a block once; what is tied there leaves it as few links.
    large = _blocks_of(open_rows.where(F.col("size") > SMALL)).join(nodes.join(texts, "id"), "id")
    tied = materialize(large.groupBy("bucket", "low", "high").applyInPandas(_tied_in_block, "u long, v long"), "tied")
    links = materialize(links.unionByName(_verified(fresh, texts)).unionByName(tied), "links")
    found = components(links).withColumnRenamed("node", "id")
    return materialize(written.select("id", "content").join(found, "id", "left")
                       .select("content", F.coalesce("component", "id").alias("component")), "content-classes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept): one row per row of the input; kept where the id is the class's smallest."""
    sketched = materialize(sketch(docs, id_col, text_col), "sketch")
    known = sketched.where("id IS NOT NULL AND content IS NOT NULL")
    found = _content_classes(known, docs, id_col, text_col)
    placed = materialize(known.select("id", "content").distinct().join(found, "content").select("id", "component").distinct(), "placed-ids")
    # The classes of a repeated id's contents are one.
    several = placed.groupBy("id").agg(F.min("component").alias("u"), F.max("component").alias("top")).where("u <> top").select("id", "u")
    joins = materialize(placed.join(several, "id").where("component <> u").select("u", F.col("component").alias("v")).distinct(), "id-links")
    united = placed.join(components(joins).select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left") \
        .select("id", F.coalesce("whole", "component").alias("component"))
    names = united.groupBy("component").agg(F.min("id").alias("class_id"))
    of_id = united.distinct().join(names, "component").select("id", "class_id")
    smallest = F.coalesce("class_id", "id")
    return sketched.select("id").join(of_id, "id", "left") \
        .select(F.col("id").alias(id_col), smallest.alias("class_id"), (smallest == F.col("id")).alias("kept"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class of near-duplicate contents, whatever ids they have, with all columns: the one with the smallest id (null
    ids last), of equal ids the first text by its md5, of equal texts the least row. Of the texts without words, which are alike to
    nothing, all stay that differ in id or text, and all with a null id."""
    sketched = materialize(sketch(docs, id_col, text_col), "sketch")
    known = sketched.where("content IS NOT NULL")
    found = _content_classes(known, docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    least = known.groupBy("content").agg(first).join(found, "content").groupBy("component").agg(F.min("first").alias("first"))
    wordless = sketched.where("content IS NULL AND id IS NOT NULL").select("id", "key").distinct()
    chosen = least.select("first.id", "first.key").unionByName(wordless)
    kept = materialize(sketched.groupBy("id", "key").agg(F.count("*").alias("rows"))
                       .join(chosen.withColumnsRenamed({"id": "of_id", "key": "of_key"}),
                             F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_semi"), "kept")
    bare = materialize(sketched.where("content IS NULL AND id IS NULL").select("key").distinct().select(
        F.lit(None).cast("long").alias("id"), "key", F.lit(1).cast("long").alias("rows")), "kept-without-id")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(id_col).cast("long").alias("row_id"), _key(F.col(text_col)).alias("row_key"))
    own = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key"))
    once = rows.join(kept.where("rows = 1").unionByName(bare), own, "left_semi").select("row")
    again = rows.join(kept.where("rows > 1"), own, "left_semi").groupBy("row_id", "row_key").agg(F.min("row").alias("row")).select("row")
    return once.unionByName(again).select(*(F.col("row")[c].alias(c) for c in docs.columns))
