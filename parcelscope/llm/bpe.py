"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

``encode`` gives, per document, the token ids and the byte offset at which each token begins in the text's UTF-8 form;
``decode`` gives the bytes back. Texts are cut into slices by :mod:`pretokenize`; a slice is merged once per worker and then
taken from a cache of bounded size. A null text is an empty one and has no ids; repeated rows give repeated results; very long
texts are worked on in segments. Only the id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import chunks, held, rest, texts_of
from parcelscope.llm.pretokenize import pieces, segments

#: Code points worked on at once, and slices kept by a worker.
CHUNK = 1 << 18
CACHED = 200_000
#: Bytes from which a slice is merged on its own; the cost of a pair that forms no token.
LONG = 64
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of one slice: join the neighbouring parts of lowest rank (leftmost first) until none can be joined.

    Parts form a linked list and candidates a heap, so that a slice of any length takes n log n steps.
    """
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue  # one of the parts has grown since
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i:after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[piece[i:after[i]]] for i in range(n) if alive[i]]


class PairTable:
    """Rank of the token that two neighbouring ids form, for arrays of pairs: open addressing at a fifth of the places."""

    def __init__(self, ranks: dict[bytes, int]):
        split = [(ranks[a] << 32 | ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token))
                 if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        keys, values = np.array(split, np.int64).reshape(-1, 2).T
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of those that meet, the last stays
            own = left[self.keys[at[left]] == keys[left]]
            self.values[at[own]] = values[own]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = at[left] + 1 & (1 << self.bits) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first << 32 | second
        at = self._place(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NEVER)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Merges(dict):
    """Slice to its ids as packed 32-bit integers, at most ``CACHED`` of them; ``add`` merges many slices side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def add(self, slices: set[bytes]) -> None:
        missing = [s for s in slices if s not in self]
        if len(self) + len(missing) > CACHED:
            self.clear()
            missing = list(slices)
        short = []
        for s in missing:
            if len(s) > LONG:
                self[s] = np.array(merge(self.ranks, s), "<u4").tobytes()
            else:
                short.append(s)
        self.update(zip(short, self._side_by_side(short), strict=True))

    def _side_by_side(self, slices: list[bytes]) -> list[bytes]:
        """One merge per slice and round: the pair of lowest rank, the leftmost among equals."""
        if not slices:
            return []
        ids = self.of_byte[np.frombuffer(b"".join(slices), np.uint8)]
        row = np.repeat(np.arange(len(slices)), [len(s) for s in slices])
        cost = np.full(len(ids), NEVER)
        inner = np.flatnonzero(row[:-1] == row[1:])
        cost[inner] = self.pairs(ids[inner], ids[inner + 1])
        done_rows, done_ids = [], []
        while len(ids):
            begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lengths = np.diff(np.append(begins, len(row)))
            least = np.minimum.reduceat(cost, begins)
            final = np.repeat(least == NEVER, lengths)
            if final.any():
                done_rows.append(row[final])
                done_ids.append(ids[final])
                least = np.repeat(least, lengths)[~final]
                row, ids, cost = row[~final], ids[~final], cost[~final]
            else:
                least = np.repeat(least, lengths)
            at = np.flatnonzero(cost == least)
            if not len(at):
                break
            at = at[np.append(True, row[at][1:] != row[at][:-1])]
            ids[at] = cost[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the removal: one less for each earlier merge
            row, ids, cost = row[keep], ids[keep], cost[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            inside = touched < len(ids) - 1
            touched, last = touched[inside], touched[~inside]
            cost[last] = NEVER
            same = row[touched] == row[touched + 1]
            cost[touched[~same]] = NEVER
            touched = touched[same]
            cost[touched] = self.pairs(ids[touched], ids[touched + 1])
        rows, ids = np.concatenate(done_rows), np.concatenate(done_ids)
        order = np.argsort(rows, kind="stable")
        packed = ids[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(rows, minlength=len(slices))) * 4).tolist()
        return [packed[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def _merges(path: str) -> Merges:
    return held(("merges", path), lambda: Merges(read_ranks(path)))


@cache
def _vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens, np.array([len(t) for t in tokens], np.int64)


def packed_ids(texts: list[str], known: dict[bytes, bytes]) -> list[bytes]:
    """Ids of every text as packed 32-bit integers; ``known.add`` learns slices, ``known`` then holds their ids."""
    parts = [(i, part) for i, text in enumerate(texts) for part in segments(text)]
    found: list[list[bytes]] = [[] for _ in texts]
    for a, b in chunks([len(p) + 1 for _, p in parts], CHUNK):
        cut = pieces([p for _, p in parts[a:b]])
        known.add(set(chain.from_iterable(cut)))
        for (i, _), own in zip(parts[a:b], cut, strict=True):
            found[i].append(b"".join(map(known.__getitem__, own)))
    return [b"".join(x) for x in found]


def id_lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>, offsets array<int>): token ids and the byte at which each begins.

    With ``decoded`` also the bytes that the ids decode to, by the same worker: a task then needs one Python process, not two.
    """
    kind = docs.schema[id_col].dataType

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = _merges(ranks_path), _vocabulary(ranks_path)[1]
        for batch in rows:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                ids = id_lists(packed_ids(texts_of(part.column(1)), known))
                size = lengths[ids.values.to_numpy()]
                ends = np.cumsum(size)
                first = ids.offsets.to_numpy()
                before = np.append(0, ends)[first]
                starts = (ends - size - np.repeat(before[:-1], np.diff(first))).astype(np.int32)
                columns = [part.column(0), ids, pa.ListArray.from_arrays(ids.offsets, pa.array(starts))]
                if decoded:
                    columns.append(pa.array([_bytes(ranks_path, own.values) for own in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "offsets", "decoded"][:len(columns)])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(lambda rows: rest(batches(rows)), f"id {kind.simpleString()}, ids array<int>, offsets array<int>" + ", decoded binary" * decoded) \
        .withColumnRenamed("id", id_col)


def _bytes(ranks_path: str, ids: pa.Array) -> bytes:
    return b"".join(map(_vocabulary(ranks_path)[0].__getitem__, ids.to_numpy().tolist()))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Every row with its ids' bytes as ``decoded``; null ids decode to null."""
    @F.pandas_udf("binary")
    def joined(ids):
        tokens = _vocabulary(ranks_path)[0].__getitem__
        return ids.map(lambda row: None if row is None else b"".join(map(tokens, row.tolist())))

    return encoded.withColumn("decoded", joined(F.col(ids_col)))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids, and the hashes of the comma-joined ids and of the decoded bytes."""
    return decoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
