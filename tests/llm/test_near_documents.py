"""Near-duplicate documents against the exact overlap of all pairs, with groups larger than a bucket's join and than a block."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from parcelscope.llm import backoff_lm, bagminhash, bpe, queries
from parcelscope.llm.common import text_bytes

LETTERS = "abcdefghij"


def word(number):
    return "".join(LETTERS[int(d)] for d in str(number))


def variants(rng, group, words, copies, edits):
    base = rng.integers(0, 10**9, words)
    for _ in range(copies):
        own = base.copy()
        places = rng.choice(words, int(rng.integers(1, edits + 1)), replace=False)
        own[places] = rng.integers(0, 10**9, len(places))
        yield group, " ".join(map(word, own.tolist()))


def bag(text):
    words = text.split()
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def exact(texts):
    """All links by the exact overlap, and the smallest member of every text's component."""
    bags, holders = [bag(t) for t in texts], defaultdict(list)
    for i, b in enumerate(bags):
        for shingle in b:
            holders[shingle].append(i)
    pairs = {p for found in holders.values() for p in combinations(found, 2)}
    links = []
    for i, j in pairs:
        least = sum((bags[i] & bags[j]).values())
        if least * 5 >= (bags[i].total() + bags[j].total() - least) * 4:
            links.append((i, j))
    head = list(range(len(texts)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in links:
        a, b = top(i), top(j)
        head[max(a, b)] = min(a, b)
    return links, [top(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    rows = [*variants(rng, 0, 120, 220, 3), *variants(rng, 1, 60, 60, 2)]
    for group in range(2, 120):
        rows += variants(rng, group, int(rng.integers(30, 300)), int(rng.integers(2, 9)), int(rng.integers(1, 9)))
    found = [t for _, t in rows]
    return found + found[::40]


@pytest.mark.parametrize("block", [1024, 64])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, texts, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    links, heads = exact(texts)
    assert len(links) > 2000
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in bagminhash.classes(frame).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)
    assert all(heads[i] == heads[c] for i, c in got.items())


def test_bags_verify_pairs_as_counted(texts):
    chosen = [*texts[:40], *texts[220:250], "", "a b", "a b", "x " * 50, "x " * 45, "x " * 30]
    bags = bagminhash.Bags(chosen)
    first, second = (np.array(x) for x in zip(*combinations(range(len(chosen)), 2), strict=True))
    wanted = []
    for i, j in zip(first.tolist(), second.tolist(), strict=True):
        a, b = bag(chosen[i]), bag(chosen[j])
        least = sum((a & b).values())
        wanted.append(least * 5 >= (a.total() + b.total() - least) * 4)
    assert bags.alike(first, second).tolist() == wanted


def test_signatures_go_by_the_text_alone(texts):
    rng = np.random.default_rng(1)
    some = [texts[i] for i in rng.choice(len(texts), 60)] + ["one", "", "x " * 3000]
    known = bagminhash.WordHashes()
    owner, shingle, count = bagminhash.shingles(some, 5, known)
    together = bagminhash.signatures(owner, shingle, count, len(some))
    for i, text in enumerate(some):
        own, one, times = bagminhash.shingles([text], 5, known)
        assert (bagminhash.signatures(own, one, times, 1)[0] == together[i]).all()


def test_one_of_each_class_stays(spark, texts):
    some = texts[:30] + texts[-10:] + [None, ""]
    _, heads = exact([t or "" for t in some])
    rows = [(i, t, "en") for i, t in enumerate(some)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.one_of_each(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(heads))


def test_pipeline_compares_with_brute_force(spark, tmp_path):
    """The run against: documents with letters, the smallest id of every class, base secrets masked, the mix, and a library's ids."""
    words = "the river keeps a long way from town and then it turns to meet the sea where boats lie still".split()
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(words, 40).tolist()) for _ in range(150)]
    near = [plain[k] + " once more" for k in range(20) for _ in range(4)]
    secret = 'token = "q8Zr2Lx7Pw4Tn9Vb3Kd6Ys1Hf5Jg0Mc"'
    found = [*plain, *near, plain[30] + " " + secret, None, "", "12 34 !!"]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(found)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, frame = dict(corpus_pipeline.STAGES), docs
    known = stages["language ID"](spark, frame, "")
    ids = {r.doc_id for r in known.collect()}
    assert known.columns == docs.columns and ids == set(range(len(found) - 3))
    one = stages["MinHash near-dedup"](spark, known, "")
    _, heads = exact([t or "" for t in found])
    assert {r.doc_id for r in one.collect()} == {heads[i] for i in ids}
    clean = {r.doc_id: r.text for r in stages["secret scans"](spark, one, "").collect()}
    assert set(clean) == {heads[i] for i in ids}
    for i, text in clean.items():
        assert text == found[i] or (secret in found[i] and "q8Zr2Lx7" not in text and text.startswith(plain[30]))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.BYTE_RANKS), special_tokens={})
    taken = Counter(r.doc_id for r in stages["mixing sources"](spark, stages["secret scans"](spark, one, ""), "").collect())
    assert set(taken) <= set(clean) and max(taken.values()) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == taken
    for r in out:
        assert r.ids == library.encode_ordinary(clean[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()


def test_scores_do_not_depend_on_chunks(spark, monkeypatch, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:200])], "doc_id long, text string")
    assert text_bytes(frame) == sum(len(t.encode()) for t in texts[:200])
    learned = F.col("doc_id") % 3 != 0
    wanted = {r.doc_id: r for r in backoff_lm.score(frame, learned).collect()}
    monkeypatch.setattr(backoff_lm, "CHUNK_BYTES", 1 << 12)
    chunks, ranges = backoff_lm.layout(frame)
    assert chunks > 2 * ranges
    got = {r.doc_id: r for r in backoff_lm.score(frame, learned).collect()}
    assert len(got) == 200
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (wanted[i].n_tokens, wanted[i].n_known, wanted[i].train_tokens)
        assert r.score == pytest.approx(wanted[i].score) and r.base_score == pytest.approx(wanted[i].base_score)
