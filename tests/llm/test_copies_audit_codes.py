"""Exact copies, the filter audit and vector codes against brute force: nulls, long texts, ties, repeats, clashing names, empty tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelscope.llm import exact_dedup, filter_audit, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 3001}" for i in range(60_000))


def texts():
    rows = [(i, f"text {i % 9}" + " " * (i % 4), "en") for i in range(200)]
    rows += [(300 + i, "one hot text", "en") for i in range(300)]
    rows += [(700, LONG, "fr"), (701, LONG.replace(" ", "\n\t"), None), (702, None, None), (703, "", "en"), (704, " \t\n\x0b\x0c\r", "en"),
             (705, "a b", "en"), (706, "ab", "en"), (707, "a b", "en"), (None, "a  b", "en"), (None, "alone", ""), (300, "one hot text", "en"),
             (300, "one hot text", "en"), (710, "🙂 é", "en"), (709, "🙂é ", "en"), (711, "same size x", "en"), (708, "same sizex ", "en")]
    return rows


@pytest.fixture(scope="module")
def copies(spark):
    frame = spark.createDataFrame(texts(), "doc_id long, text string, lang string").repartition(37)
    return frame.withColumns({c: F.lit(1) for c in ("id", "lane", "short", "digest", "members", "best", "seq", "size", "row", "under", "mask", "n")})


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("fan", [2, 8, 64])
def test_exact_copies(copies, monkeypatch, fan):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    groups = defaultdict(list)
    for r in texts():
        groups[plain(r[1])].append(r)
    wanted = Counter()
    for key, rows in groups.items():
        order = sorted(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        digest = hashlib.sha256(key.encode()).hexdigest()
        wanted.update((r[0], order[0][0], len(rows), k == 0, digest) for k, r in enumerate(order))
    got = exact_dedup.marked(copies)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    # Rows that repeat are alike in all columns but `kept`, which exactly one of them has.
    assert Counter(map(tuple, got.collect())) == wanted
    kept = exact_dedup.distinct(copies)
    assert kept.columns == copies.columns and Counter(r.text for r in kept.select("text").collect()) == Counter(
        max(rows, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))[1] for rows in groups.values())
    assert exact_dedup.marked(copies.where("false")).count() == 0


def test_exact_copies_plan_has_no_python(copies):
    plan = exact_dedup.marked(copies)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def audit_rows():
    few, shout, mark = "lorem ipsum dolor", "ABC DEF", "costs 5 $"
    varied = " ".join(f"v{i}" for i in range(120))
    same = "again " * 150
    rows = [(i, [few, shout, mark, varied, same, varied + " " + shout * 20, same + mark, None, ""][i % 9] if i % 5 else varied + f" n{i}",
             ["en", None, "", "de", "en"][i % 5]) for i in range(180)]
    return [*rows, (None, varied, "en"), (None, few, "xx"), (3, varied, "en"), (500, LONG, "de"), (501, LONG, "en"), (502, "\x0b\x1c  ", "en")]


def audit_labels():
    return [(i, i % 2 if i % 7 else None, int(i % 4 == 0)) for i in range(0, 180, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]


def test_filter_audit(spark):
    docs = spark.createDataFrame(audit_rows(), "doc_id long, text string, lang string").repartition(5)
    docs = docs.withColumns({c: F.lit(1) for c in ("part", "mask", "id", "good", "toxic", "n", "own", "digest", "words", "first")})
    labels = spark.createDataFrame(audit_labels(), "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    least, good, toxic, judged = {}, set(), set(), []
    for i, text, _ in audit_rows():
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, quality, bad in audit_labels():
        good |= {i} if quality == 1 and i is not None else set()
        toxic |= {i} if bad == 1 and i is not None else set()
    for i, text, part in audit_rows():
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": re.search(r"[#$%&*|]", text) is not None, "E": i is not None and least[text] < i}
        judged.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    wanted, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            everyone = left
            for k, f in enumerate(order):
                out = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[part, f] += len(out)
                wanted[part, "".join(order), k + 1] = (
                    len(left), len(out), sum(f in j[1] for j in everyone) - len(out), sum(j[1] == {f} for j in everyone), sum(j[2] for j in out), sum(j[3] for j in out))
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == wanted[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_packed_fields_do_not_overflow():
    n = (1 << 63) - 1
    for mask in (0, 1, 22, 31):
        assert np.array_equal(filter_audit.unpacked(n * filter_audit.PACKED[mask]), n * filter_audit.unpacked(filter_audit.PACKED[mask]))


def lloyd(rows, width):
    """Codes, errors and codebooks of rows (id, integers, label), one vector after the other."""
    lengths = [width // 4 + (p < width % 4) for p in range(4)]
    starts = [sum(lengths[:p]) for p in range(4)]
    ids = sorted({r[0] for r in rows if r[0] is not None})[:256]
    if len(ids) < 256 and any(r[0] is None for r in rows):
        ids.append(None)
    seeds = [min(r[1] for r in rows if r[0] == i) for i in ids]
    books = [[s[a:a + n] for s in seeds] for a, n in zip(starts, lengths, strict=True)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(4):
        for p, (a, n) in enumerate(zip(starts, lengths, strict=True)):
            members = defaultdict(list)
            for r in rows:
                members[near(r[1][a:a + n], books[p])[1]].append(r[1][a:a + n])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else c for e, c in enumerate(books[p])]
    found = [[near(r[1][a:a + n], books[p]) for p, (a, n) in enumerate(zip(starts, lengths, strict=True))] for r in rows]
    return ["".join(f"{e:02x}" for _, e in f) for f in found], [sum(x for x, _ in f) for f in found], books


def integers(vector):
    return [int(np.floor(1024 * float(np.float32(x)))) for x in vector]


@pytest.mark.parametrize("width,scale", [(8, 1.0), (6, 1e4), (3, 1.0)])
def test_vector_codes(spark, width, scale):
    rng = np.random.default_rng(width)
    hot = rng.standard_normal(width) * scale
    rows = [(i, (hot if i % 3 == 0 else rng.standard_normal(width) * scale).tolist(), [1, 2, None][i % 3] if i % 10 else 3) for i in range(420)]
    rows += [(5, rows[9][1], 1), rows[7], rows[7], (None, rows[8][1], 2)]
    bad = [(-1, None, 1), (-2, [float("nan")] * width, 1), (-3, [float("inf")] + [0.0] * (width - 1), 1), (-4, [None] + [1.0] * (width - 1), 1),
           (-5, [], 1), (600, [1.0] * (width + 4), 1)]
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int").repartition(6)
    frame = frame.withColumns({c: F.lit(1) for c in ("id", "seq", "vector", "entry", "position", "part", "moved", "code", "salt")})
    own = [(r[0], integers(r[1]), r[2]) for r in rows]
    codes, errors, books = lloyd(own, width)
    total = Counter()
    for r, e in zip(own, errors, strict=True):
        total[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    got = Counter(map(tuple, vector_codes.report(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    assert got == Counter((r[0], c, e, total[r[2]], digest) for r, c, e in zip(own, codes, errors, strict=True))


def test_vector_codes_of_few_extreme_and_no_rows(spark):
    rows = [(1, [1e30, -1e30, 0.0, 1.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (3, [1e30, -1e30, 0.0, 1.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_codes.report(frame).collect()}
    assert [got[i].code for i in (1, 2, 3)] == ["00000000", "01010101", "00000000"] and all(r.error == 0 for r in got.values())
    none = vector_codes.report(frame.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_nearest_is_exact_beyond_floats():
    rng = np.random.default_rng(3)
    parts, entries = (rng.integers(-2 ** 27, 2 ** 27, (n, 16)) for n in (70, 256))
    at, error = vector_codes.nearest(parts, entries)
    far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in entries] for a in parts]
    assert at.tolist() == [f.index(min(f)) for f in far] and error.tolist() == [min(f) for f in far]
