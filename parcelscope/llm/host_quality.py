"""Quality rules of documents, and of the hosts they come from.

A document's own rules count its words, symbols, repeated lines and repeated word windows. A host's rate of failing documents is
shrunk towards the rate of all hosts by a beta prior whose two parameters follow from the hosts' rates (their mean and variance,
weighed by documents), so that a host with few documents is not judged by chance. Documents of a host whose shrunk rate is above
``MOST_FAILING`` are not kept, nor are those that fail themselves.

A null text has no words. Documents without a host are judged by their own rules only. Rows are judged one by one, so repeated rows
and null ids need no rule; only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import chunks, join_small, texts_of
from parcelscope.session import materialize

#: Base rule (fixed values): least words, and the largest share of words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Further rules whose failures count for the host only: symbols per character of words, repeated lines per line with words.
MOST_SYMBOLS, MOST_SAME_LINES = 0.1, 0.3
#: A host is dropped above this shrunk rate of failing documents.
MOST_FAILING = 0.6
CHUNK, DOCS = 1 << 19, 2048
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def counts(texts: list[str]) -> np.ndarray:
    """(COUNTS, texts): the counts of every text, without hashing anything."""
    data = [t.encode() for t in texts]
    words = [d.split() for d in data]  # splits bytes at exactly the six characters of WHITE
    lengths = np.array([len(w) for w in words], np.int64)
    chars = [len(t) - (len(d) - len(d.translate(None, WHITE))) for t, d in zip(texts, data, strict=True)]
    symbols = [len(d) - len(d.translate(None, SYMBOLS)) for d in data]
    lines = [[line for line in d.split(b"\n") if line.strip(WHITE)] for d in data]
    same = [len(x) - len(set(x)) for x in lines]
    return np.array([lengths, chars, symbols, [len(x) for x in lines], same, _in_repeated_windows(words, lengths)], np.int64)


def _in_repeated_windows(words: list[list[bytes]], lengths: np.ndarray) -> np.ndarray:
    number: dict[bytes, int] = {}
    total = int(lengths.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), np.int64, total)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.flatnonzero(owner[:1 - WINDOW] == owner[WINDOW - 1:])
    window = owner[starts]
    for k in range(WINDOW):  # number the windows word by word, so that the numbers stay small
        window = np.unique(window * (len(number) + 1) + ids[starts + k], return_inverse=True)[1]
    repeated = starts[np.bincount(window)[window] > 1] if len(window) else starts
    inside = np.zeros(total, bool)
    for k in range(WINDOW):
        inside[repeated + k] = True
    return np.bincount(owner, inside, len(words)).astype(np.int64)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, COUNTS) of every row."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = texts_of(batch.column(2))
            for a, b in ((i, min(y, i + DOCS)) for x, y in chunks([len(t) + 1 for t in texts], CHUNK) for i in range(x, y, DOCS)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, counts(texts[a:b]))],
                    ["id", "host", *COUNTS])

    read = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return read.mapInArrow(batches, f"id {kinds[0]}, host {kinds[1]}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def any_failed() -> Column:
    return base_failed() | (F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | \
        (F.col("n_dup_lines") > MOST_SAME_LINES * F.col("n_lines"))


def hosts(measured: DataFrame) -> DataFrame:
    """(host, docs, failed, rate, dropped): the shrunk rate and verdict of every host that is not null."""
    summed = measured.where("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(any_failed().cast("int")).alias("failed"))
    summed = materialize(summed, "hosts")
    mean = summed.agg((F.sum("failed") / F.sum("docs")).alias("mean"))
    spread = summed.crossJoin(F.broadcast(mean)).groupBy("mean").agg(  # one row
        (F.sum(F.col("docs") * F.pow(F.col("failed") / F.col("docs") - F.col("mean"), 2)) / F.sum("docs")).alias("variance"))
    # The beta distribution with this mean and variance has mean * strength and (1 - mean) * strength as parameters.
    strength = F.when(F.col("variance") > 0, F.greatest(F.lit(1.0), F.least(
        F.lit(1e6), F.col("mean") * (1 - F.col("mean")) / F.col("variance") - 1))).otherwise(1e6)
    prior = spread.select("mean", strength.alias("strength"))
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    return summed.crossJoin(F.broadcast(prior)).select("host", "docs", "failed", rate.alias("rate"), (rate > MOST_FAILING).alias("dropped"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, COUNTS, base_failed, kept) of every row."""
    measured = materialize(measure(docs, id_col, text_col, host_col), "measured")
    verdicts = materialize(hosts(measured).select("host", "dropped"), "verdicts")
    judged = join_small(measured, verdicts, "host", how="left")
    failed = base_failed()
    return judged.select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"),
                         (~failed & ~F.coalesce("dropped", F.lit(False))).alias("kept"))


SQL = r"""
WITH tokens AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM tokens),
windows AS (SELECT doc_id, pos, words[pos] AS a, words[pos + 1] AS b, words[pos + 2] AS c FROM placed),
repeated AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
inside AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS same
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM tokens) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, t.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_lines,
         coalesce(l.same, 0)::BIGINT AS n_dup_lines, coalesce(i.n, 0)::BIGINT AS n_repeat_words
  FROM tokens t LEFT JOIN lines l USING (doc_id) LEFT JOIN inside i USING (doc_id)),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS docs,
         sum((base_failed OR n_symbols > 0.1 * word_chars OR n_dup_lines > 0.3 * n_lines)::INT) AS failed
  FROM ruled WHERE source IS NOT NULL GROUP BY source),
mean AS (SELECT sum(failed)::DOUBLE / sum(docs) AS mean FROM hosts),
spread AS (SELECT any_value(mean) AS mean, sum(docs * pow(failed::DOUBLE / docs - mean, 2)) / sum(docs) AS variance FROM hosts, mean),
prior AS (
  SELECT mean, CASE WHEN variance > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / variance - 1)) ELSE 1e6 END AS strength FROM spread),
verdicts AS (SELECT source, (failed + mean * strength) / (docs + strength) > 0.6 AS dropped FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dropped, false) AS kept
FROM ruled LEFT JOIN verdicts USING (source)
"""
