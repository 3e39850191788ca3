"""Language-model scores of whole texts by a weighted backoff automaton over word n-grams.

States are the words that the training texts hold (and the start of a text); a state's arcs are the bigrams seen there, with the log10
probability (c(v w) + MASS * p(w)) / (c(v) + MASS), where p is the unigram model. A word without an arc takes the failure arc,
weight MASS / (c(v) + MASS), to the root, which knows every word by p(w) = (c + 0.5) / (N + 0.5 (V + 1)). One traversal from left to
right carries the state and adds up the log probabilities. The arcs of a state and its failure arc sum to 1 over all words.

The automaton grows with the corpus, so no task holds all of it. Documents are dealt into chunks by a hash. A chunk sends its distinct
n-grams (as 64-bit hashes, sorted) to ranges of the hash, which add up the counts of all chunks and send the sums back; each chunk then
builds the part of the automaton that its own texts can reach, and runs them through it. Nothing is pruned.

A null text is an empty one: its only token is the end. Documents with a null id are learned from. Repeated rows are learned from as
often as they occur and get equal scores. A document is never cut. Only the id and text columns are read, so further ones can't clash.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import mix64, text_bytes, texts_of
from parcelscope.session import materialize

#: Weight of the unigram model in a state, in tokens.
MASS = 20.0
#: Bytes of the texts of a chunk, and chunks whose n-grams one range of the hash holds.
CHUNK_BYTES, CHUNKS_OF_RANGE = 8 << 20, 8
#: Tokens no text can hold: they contain white space.
START, END = b"\t", b"\n"
FOLD = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The tokens of a chunk's texts by number; its distinct unigrams and bigrams in the order of their hashes, with the numbers of
    times that the learned texts hold them."""

    def __init__(self, texts: list[str], learned: np.ndarray):
        number: dict[bytes, int] = {START: 0, END: 1}
        words = [t.encode().lower().split() for t in texts]  # bytes: ASCII letters and the six white characters only
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable((*w, END) for w in words)),
                               np.int64, int(self.lengths.sum()))
        self.size = len(number)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, self.size)
        self.words = np.argsort(hashes)
        self.word_hashes = hashes[self.words]
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = 0
        # One sort gives the distinct bigrams and how often the learned texts hold each.
        ordered = np.sort((before * self.size + self.ids) * 2 + np.repeat(learned, self.lengths))
        begins = np.flatnonzero(np.append(True, ordered[1:] >> 1 != ordered[:-1] >> 1))
        distinct, times = ordered[begins] >> 1, np.add.reduceat(ordered & 1, begins)
        first, second = np.divmod(distinct, self.size)
        pair_hashes = mix64(mix64(hashes[first]) * FOLD + hashes[second])
        order = np.argsort(pair_hashes)
        self.pairs, self.pair_counts, self.pair_hashes = distinct[order], times[order], pair_hashes[order]
        self.word_counts = np.bincount(self.ids[np.repeat(learned, self.lengths)], minlength=self.size)[self.words]


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal ranges of the hash begins, in sorted hashes."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(parts + 1))


def _pack(counts: np.ndarray) -> bytes:
    """A byte per count, and eight more bytes for each of 255 or above."""
    large = counts[counts >= 255].astype("<u8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _unpack(packed: bytes, number: int) -> np.ndarray:
    counts = np.frombuffer(packed, np.uint8, number).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<u8", offset=number).astype(np.int64)
    return counts


SENT = "part int, chunk int, words binary, word_counts binary, pairs binary, pair_counts binary"
SUMS = "chunk int, part int, word_counts binary, pair_counts binary, tokens long, types long"


def _send(parts: int):
    def send(rows: pa.Table) -> pa.Table:
        grams = Grams(texts_of(rows["text"]), rows["learned"].to_numpy())
        words, pairs = grams.word_counts, grams.pair_counts
        w, p = _ranges(grams.word_hashes, parts).tolist(), _ranges(grams.pair_hashes, parts).tolist()
        chunk = rows["chunk"][0].as_py()
        out = [(k, chunk, grams.word_hashes[a:b].tobytes(), _pack(words[a:b]), grams.pair_hashes[c:d].tobytes(), _pack(pairs[c:d]))
               for k, (a, b, c, d) in enumerate(zip(w, w[1:], p, p[1:], strict=False)) if a < b or c < d]
        columns = zip(*out, strict=True)
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                    names=[f.split()[0] for f in SENT.split(", ")])

    return send


def _summed(hashes: list[bytes], counts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sums over all chunks, per chunk in its own order, and per distinct hash."""
    own = [np.frombuffer(h, np.uint64) for h in hashes]
    _, place = np.unique(np.concatenate(own), return_inverse=True)
    each = np.concatenate([_unpack(c, len(h)) for c, h in zip(counts, own, strict=True)])
    totals = np.bincount(place, each, place.max() + 1 if len(place) else 0).astype(np.int64)
    return np.split(totals[place], np.cumsum([len(h) for h in own])[:-1]), totals


def _add_up(rows: pa.Table) -> pa.Table:
    columns = {name: rows[name].to_pylist() for name in rows.column_names}
    words, types = _summed(columns["words"], columns["word_counts"])
    pairs, _ = _summed(columns["pairs"], columns["pair_counts"])
    rest = [0] * (rows.num_rows - 1)
    return pa.table({
        "chunk": pa.array(columns["chunk"], pa.int32()), "part": pa.array(columns["part"], pa.int32()),
        "word_counts": pa.array([_pack(x) for x in words], pa.binary()), "pair_counts": pa.array([_pack(x) for x in pairs], pa.binary()),
        "tokens": pa.array([int(types.sum()), *rest], pa.int64()), "types": pa.array([int((types > 0).sum()), *rest], pa.int64())})


class Automaton:
    """The part of the automaton that a chunk's texts reach; state 0 is the start, other states are words by their number."""

    def __init__(self, size: int, pairs: np.ndarray, pair_counts: np.ndarray, word_counts: np.ndarray, tokens: int, types: int):
        self.size = size
        unigram = (word_counts + 0.5) / (tokens + 0.5 * (types + 1))
        self.root = np.log10(unigram)
        visits = word_counts.copy()
        visits[0] = word_counts[1]  # a text starts as often as one ends
        self.failure = np.log10(MASS / (visits + MASS))
        known = pair_counts > 0
        first, second = np.divmod(pairs[known], size)
        weight = np.log10((pair_counts[known] + MASS * unigram[second]) / (visits[first] + MASS))
        self.arcs = dict(zip(pairs[known].tolist(), weight.tolist(), strict=True))
        self._root, self._failure = self.root.tolist(), self.failure.tolist()

    def traverse(self, words: list[int]) -> float:
        state, total = 0, 0.0
        arc, size, root, failure = self.arcs.get, self.size, self._root, self._failure
        for word in words:
            weight = arc(state * size + word)
            total += failure[state] + root[word] if weight is None else weight
            state = word
        return total


def _score(tokens: int, types: int, kind: pa.DataType):
    names = ("id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def score(rows: pa.Table, sums: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=list(names))
        grams = Grams(texts_of(rows["text"]), rows["learned"].to_numpy())
        of_part = {p: (w, c) for p, w, c in zip(*(sums[n].to_pylist() for n in ("part", "word_counts", "pair_counts")), strict=True)}
        parts = rows["parts"][0].as_py()
        totals = []
        for at, hashes in enumerate((grams.word_hashes, grams.pair_hashes)):
            edges = _ranges(hashes, parts).tolist()
            totals.append(np.concatenate([_unpack(of_part[k][at], b - a) if b > a else np.zeros(0, np.int64)
                                          for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]))
        word_counts = np.empty(grams.size, np.int64)
        word_counts[grams.words] = totals[0]
        automaton = Automaton(grams.size, grams.pairs, totals[1], word_counts, tokens, types)
        ends = np.cumsum(grams.lengths)
        starts = ends - grams.lengths
        base = np.add.reduceat(automaton.root[grams.ids], starts)
        known = np.add.reduceat((word_counts > 0)[grams.ids].astype(np.int64), starts)
        ids = grams.ids.tolist()
        scores = [automaton.traverse(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = (rows["id"].combine_chunks(), rows["learned"].combine_chunks(), grams.lengths, known,
                   np.full(len(scores), tokens), base, scores)
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                    names=list(names))

    return score


def layout(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Chunks in proportion to the bytes of the texts, and ranges of the hash in proportion to the chunks."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(least, -(-text_bytes(docs, text_col) // CHUNK_BYTES))
    return chunks, max(least, -(-chunks // CHUNKS_OF_RANGE))


def score(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from the rows ``learned`` selects."""
    chunks, parts = layout(docs, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), learned.alias("learned"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")).withColumn("parts", F.lit(parts))
    sent = rows.groupBy("chunk").applyInArrow(_send(parts), SENT)
    sums = materialize(sent.groupBy("part").applyInArrow(_add_up, SUMS), "gram-sums")
    every = sums.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_col].dataType)
    found = rows.groupBy("chunk").cogroup(sums.select("chunk", "part", "word_counts", "pair_counts").groupBy("chunk")).applyInArrow(
        _score(every["tokens"] or 0, every["types"] or 0, kind),
        f"id {id_type}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("id", id_col)
