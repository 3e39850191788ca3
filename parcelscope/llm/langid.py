"""Language identification with a string kernel.

Two texts are compared by the n-grams of one to four letters that both hold (a blended-spectrum presence kernel, normalised by
the geometric mean of the numbers of n-grams; white space and other marks count as one letter). N-grams are hashed to
``BUCKETS`` places. Kernel values with ``LANDMARKS`` texts and the inverse root of the landmarks' own kernel matrix give Nyström
features; ridge regressions, one language against the rest, are fitted on them. Documents are scored in batches by matrix products.

The model is fitted on about ``PER_LANGUAGE`` different labelled texts per language, chosen by a hash of the text, so copies count
once; the driver sees only their bit vectors. Its size is fixed by the parameters and the number of languages.

A text that is null or has no letter gets ``und`` with score 0. With no labelled row every text does. Repeated rows get equal
results; very long texts are read whole. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import chunks, held, rest, texts_of
from parcelscope.llm.pretokenize import LETTER, code_point_classes

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
LANDMARKS = 128
PER_LANGUAGE = 500
RIDGE = 1e-3
CHUNK, DOCS = 1 << 19, 64


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # BUCKETS x landmarks, 0 or 1
    roots: np.ndarray  # square roots of the landmarks' numbers of n-grams
    whiten: np.ndarray  # inverse root of the landmarks' kernel matrix
    weights: np.ndarray  # landmarks x languages


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BUCKETS) marks of the n-grams present, and whether a text has a letter."""
    marks = np.zeros((len(texts), BUCKETS), np.uint8)
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    letters = code_point_classes()[points] == LETTER
    points = np.where(letters, points, np.uint32(0x20))
    ends = np.cumsum([len(t) for t in lowered])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, [len(t) for t in lowered])
    has_letter = np.add.reduceat(letters, np.append(0, ends[:-1]).astype(np.int64)) > 0
    limit = np.repeat(ends, [len(t) for t in lowered])
    flat, rolled = marks.ravel(), np.zeros(len(points), np.uint32)
    for n in ORDERS:
        rolled = rolled[:len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1:]
        value = (rolled ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS)
        inside = np.arange(len(value)) + n <= limit[:len(value)]
        flat[(owner[:len(value)] + value)[inside]] = 1
    return marks, has_letter


def _kernel(marks: np.ndarray, landmarks: np.ndarray, roots: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.int64), 1))
    return (marks.astype(np.float32) @ landmarks).astype(np.float64) / own[:, None] / roots[None, :]


def _features(marks: np.ndarray, landmarks: np.ndarray, roots: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    x = _kernel(marks, landmarks, roots) @ whiten
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]


def predict(model: Model, texts: list[str]) -> list[tuple[str, float]]:
    if not texts:
        return []
    marks, has_letter = presence(texts)
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    margins = _features(marks, model.landmarks, model.roots, model.whiten) @ model.weights
    best = margins.argmax(axis=1)
    score = np.clip((margins[np.arange(len(texts)), best] + 1) / 2, 0, 1)
    return [(model.languages[b], float(s)) if known else (UNKNOWN, 0.0) for b, s, known in zip(best, score, has_letter, strict=True)]


def _sample(labelled: DataFrame) -> list[tuple[str, int, bytes]]:
    """(language, hash of the text, bits), a bounded number per language."""
    labelled = labelled.select("lang", "text", F.xxhash64("text").alias("mark"))
    numbers = labelled.groupBy("lang").agg(F.approx_count_distinct("mark").alias("texts")).select(
        "lang", F.least(F.lit(1.0), PER_LANGUAGE / F.col("texts")).alias("share"))
    place = F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) / float(1 << 30)
    few = labelled.join(F.broadcast(numbers), "lang").where(place < F.col("share")).dropDuplicates(["lang", "mark"])

    def bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = texts_of(batch.column(2))
            for a, b in chunks([max(len(t), CHUNK // DOCS) for t in texts], CHUNK):
                packed = [m.tobytes() for m in np.packbits(presence(texts[a:b])[0], axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                                                  pa.array(packed, pa.binary())], ["lang", "mark", "bits"])

    found = few.select("lang", "mark", "text").mapInArrow(lambda part: rest(bits(part)), "lang string, mark long, bits binary").collect()
    return sorted((r.lang, r.mark, bytes(r.bits)) for r in found)


def fit(docs: DataFrame, rows: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled documents that ``rows`` selects."""
    labelled = docs.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = _sample(labelled)
    languages = tuple(sorted({lang for lang, _, _ in sample}))
    if not languages:
        return Model((), *(np.zeros((0, 0)) for _ in range(4)))
    marks = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for *_, b in sample]), axis=1)
    spoken = np.array([languages.index(lang) for lang, _, _ in sample])
    turn = np.zeros(len(sample), np.int64)
    for k in range(len(languages)):
        turn[spoken == k] = np.arange((spoken == k).sum())
    chosen = np.lexsort((spoken, turn))[:max(LANDMARKS, len(languages))]  # the languages take turns
    landmarks = np.ascontiguousarray(marks[chosen].T.astype(np.float32))
    roots = np.sqrt(np.maximum(landmarks.sum(axis=0, dtype=np.float64), 1))
    values, vectors = np.linalg.eigh(_kernel(marks[chosen], landmarks, roots))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    x = _features(marks, landmarks, roots, whiten)
    target = np.where(spoken[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    # Every language weighs the same, however many texts it has.
    weight = 1 / np.bincount(spoken)[spoken] / len(languages)
    gram = (x * weight[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
    return Model(languages, landmarks, roots, whiten, np.linalg.solve(gram, (x * weight[:, None]).T @ target))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row and column, and ``language`` (lang_pred string, score double)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts):
        import pandas as pd

        held("language", bool)  # gives up another operator's tables
        model = shared.value
        every, out = [t or "" for t in texts], []
        for a, b in chunks([max(len(t), CHUNK // DOCS) for t in every], CHUNK):
            out.extend(predict(model, every[a:b]))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("language", language(F.col(text_col)))
