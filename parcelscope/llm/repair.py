"""Token ids in files compressed with Re-Pair grammars.

Documents are put in ascending order of their ids and cut into shards. A shard's ids (an end id after every document) are compressed
by itself: the pairs of neighbouring symbols that occur most often are replaced by new symbols, over and over, until no pair is frequent;
pairs never cross a document's end. A shard holds its rules, the number of ids that every rule expands to, where each document begins
in the compressed sequence, and the sequence, so any range of ids is decoded without the rest.

Layout of a shard, little-endian: magic, width of a symbol in bytes, first symbol of a rule, numbers of rules, documents and symbols;
then left and right symbols and expansion lengths of the rules, per document its first symbol and its number of ids, and the symbols.

A table of shards is a Parquet folder with a row per shard: Spark commits it as a whole, and any executor can read it from any store. A
null text is an empty one and has the end id only. Null ids come last; rows with equal ids are ordered by their text, and repeated rows
stay. Only the id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelscope.llm.bpe import packed_ids
from parcelscope.llm.common import BROADCAST_ROWS, held, text_bytes, texts_of

MAGIC = b"RPG1"
HEADER = struct.Struct("<4sIIIII")
END = 0
#: Ids of a shard, pairs replaced side by side in a round, and the least number of times a replaced pair occurs.
SHARD_IDS = 1 << 20
TOGETHER, LEAST = 2048, 32
TABLE_BITS = 18
#: Slices a worker keeps the ids of.
KEPT = 1_200_000
#: Bytes of the texts per range of ids.
RANGE_BYTES = 16 << 20


class LibraryIds(dict):
    """Slice to its ids by the tokenizers library, packed; at most ``KEPT`` are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text

    def add(self, slices: set[bytes]) -> None:
        missing = [s for s in slices if s not in self]
        if len(self) + len(missing) > KEPT:
            self.clear()
            missing = list(slices)
        if not missing:
            return
        found = self.library.encode_batch_fast([s.decode() for s in missing], add_special_tokens=False)
        ids = [e.ids for e in found]
        ends = np.cumsum([4 * len(i) for i in ids]).tolist()
        packed = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        self.update((s, packed[a:b]) for s, a, b in zip(missing, [0, *ends[:-1]], ends, strict=True))


def _library(path: str) -> LibraryIds:
    return held(("library", path), lambda: LibraryIds(path))


def _frequent(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys, most frequent first, equal ones by value; and all frequent keys in order."""
    ordered = np.sort(keys)
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ordered) - 1)
    times = np.diff(np.append(-1, ends))
    often = times >= LEAST
    pairs, times = ordered[ends[often]], times[often]
    return pairs[np.argsort(-times, kind="stable")[:TOGETHER]], pairs


def compress(ids: np.ndarray, documents: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, numbers of symbols per document, rules, expansion lengths); ``documents`` has the numbers of ids per document.

    Only places whose pair is frequent, or has just been made, are counted again: all places of a frequent pair are among them, and
    no other pair can become frequent.
    """
    symbols = ids.astype(np.uint32)
    owner = np.repeat(np.arange(len(documents), dtype=np.int32), documents)
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    live = np.flatnonzero(owner[:-1] == owner[1:])  # places of the pairs' left symbols
    while len(live):
        half = 16 if first_rule + len(rules) + TOGETHER <= 1 << 16 else 32
        kind, factor = (np.uint32, 0x9E3779B1) if half == 16 else (np.uint64, 0x9E3779B97F4A7C15)
        keys = symbols[live].astype(kind) << kind(half) | symbols[live + 1]
        chosen, frequent = _frequent(keys)
        # A chosen pair has a place in a hash table; of two that meet, the more frequent one is replaced in this round.
        place = (chosen * kind(factor)) >> kind(2 * half - TABLE_BITS)
        _, first = np.unique(place, return_index=True)
        first.sort()
        chosen, place = chosen[first], place[first]
        if not len(chosen):
            break
        used, pair_at, name_at = np.zeros(1 << TABLE_BITS, bool), np.zeros(1 << TABLE_BITS, kind), np.zeros(1 << TABLE_BITS, np.uint32)
        used[place], pair_at[place] = True, chosen
        name_at[place] = (first_rule + len(rules) + np.arange(len(chosen))).astype(np.uint32)
        own = np.stack([chosen >> kind(half), chosen & kind((1 << half) - 1)], axis=1).astype(np.int64)
        size = np.where(own < first_rule, 1, np.append(lengths, 0)[np.clip(own - first_rule, 0, len(lengths))]).sum(axis=1)
        rules, lengths = np.vstack([rules, own]), np.append(lengths, size)
        # Of pairs that overlap in a row, every second one is replaced, from the left.
        bucket = (keys * kind(factor)) >> kind(2 * half - TABLE_BITS)
        taken = np.flatnonzero((pair_at[bucket] == keys) & used[bucket])
        at = live[taken]
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        turn = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        taken, at = taken[turn % 2 == 0], at[turn % 2 == 0]
        symbols[at] = name_at[bucket[taken]]
        # Pairs that are left: frequent ones whose symbols both stayed, and those with a new symbol.
        keep, often = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
        keep[at + 1] = False
        tables = np.zeros(1 << TABLE_BITS, bool)
        tables[(frequent * kind(factor)) >> kind(2 * half - TABLE_BITS)] = True
        often[live[tables[bucket]]] = True
        symbols, owner, often = symbols[keep], owner[keep], often[keep]
        new = at - np.arange(len(at))
        often[new] = True
        often[new[new > 0] - 1] = True
        live = np.flatnonzero(often[:-1] & (owner[:-1] == owner[1:]))
    return symbols, np.bincount(owner, minlength=len(documents)), rules, lengths


def write_shard(ids: np.ndarray, documents: np.ndarray, first_rule: int) -> bytes:
    symbols, starts, rules, lengths = compress(ids, documents, first_rule)
    width = 2 if first_rule + len(rules) <= 1 << 16 else 4
    first = np.cumsum(starts) - starts
    return b"".join([
        HEADER.pack(MAGIC, width, first_rule, len(rules), len(documents), len(symbols)),
        rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        first.astype("<u4").tobytes(), documents.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()])


class Shard:
    """A written shard, opened for reading."""

    def __init__(self, data: bytes):
        magic, width, self.first_rule, rules, documents, symbols = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEADER.size

        def take(kind: str, number: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, number, at).astype(np.int64 if kind == "<u4" else np.int32)
            at += number * np.dtype(kind).itemsize
            return out

        self.left, self.right, self.lengths = (take("<u4", rules) for _ in range(3))
        self.left, self.right = self.left.astype(np.int32), self.right.astype(np.int32)
        self.first, self.numbers = take("<u4", documents), take("<u4", documents)
        self.symbols = take(f"<u{width}", symbols).astype(np.int32)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while (rule := symbols >= self.first_rule).any():
            place = np.arange(len(symbols)) + np.cumsum(rule) - rule
            out = np.empty(len(symbols) + int(rule.sum()), np.int32)
            which = symbols[rule] - self.first_rule
            out[place] = symbols
            out[place[rule]], out[place[rule] + 1] = self.left[which], self.right[which]
            symbols = out
        return symbols

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols).astype("<u4")

    def document(self, number: int) -> np.ndarray:
        """The ids of one document, with its end id."""
        stop = self.first[number + 1] if number + 1 < len(self.first) else len(self.symbols)
        return self._expand(self.symbols[self.first[number]:stop]).astype("<u4")

    def between(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the shard; only the symbols that cover them are expanded."""
        size = np.where(self.symbols < self.first_rule, 1,
                        np.append(self.lengths, 0)[np.clip(self.symbols - self.first_rule, 0, len(self.lengths))])
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = start - (ends[a - 1] if a else 0)
        return self._expand(self.symbols[a:b]).astype("<u4")[skipped:skipped + stop - start]


def write(docs: DataFrame, path: str, library_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards of all documents: (range, shard, ids array of document ids, n_ids, data)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def shards(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _library(library_path)
        first_rule = known.library.get_vocab_size(with_added_tokens=True)
        place, number, held, packed, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            documents = np.array([len(p) // 4 for p in packed], np.int64)
            data = write_shard(np.frombuffer(b"".join(packed), "<u4"), documents, first_rule)
            own = pa.concat_arrays(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([number], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([int(documents.sum())]), pa.array([data])],
                ["range", "shard", "ids", "n_ids", "data"])

        for batch in rows:
            own = [p + b"\0\0\0\0" for p in packed_ids(texts_of(batch.column(1)), known)]
            start = 0
            for i, p in enumerate(own):
                packed.append(p)
                size += len(p) // 4
                if size >= SHARD_IDS:
                    held.append(batch.column(0).slice(start, i + 1 - start))
                    yield shard()
                    held, packed, size, start, number = [], [], 0, i + 1, number + 1
            held.append(batch.column(0).slice(start))
        if packed:
            yield shard()

    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // RANGE_BYTES))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Ranges by the id alone: the sample that finds them goes to the driver, and texts must not.
    read.repartitionByRange(ranges, F.col("id").asc_nulls_last()) \
        .sortWithinPartitions(F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first()) \
        .mapInArrow(shards, f"range int, shard int, ids array<{kind}>, n_ids long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the shards."""
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    small = shards.select(F.col("range").alias("of_range"), F.col("shard").alias("of_shard"), "n_ids")
    running = Window.orderBy("of_range", "of_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.withColumn("start", F.coalesce(F.sum("n_ids").over(running), F.lit(0))).drop("n_ids")  # a row per shard
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = shards.join(starts, (F.col("range") == F.col("of_range")) & (F.col("shard") == F.col("of_shard")))

    def documents(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                shard = Shard(batch.column(2)[k].as_py())
                ids, data = batch.column(0).slice(k, 1).flatten(), shard.all_ids().tobytes()
                ends = np.cumsum(shard.numbers)
                starts = ends - shard.numbers
                checks = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts + batch.column(1)[k].as_py()), pa.array(shard.numbers), pa.array(checks, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"])

    return placed.select("ids", "start", "data").mapInArrow(documents, f"id {kind}, start long, n_tokens long, ids_crc32 long") \
        .withColumnRenamed("id", id_col)
