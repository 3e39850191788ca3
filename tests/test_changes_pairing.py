"""Entries of two snapshots are paired alike in lists and by distributed positions, and as a loop pairs them."""

from collections import defaultdict
from datetime import date

import numpy as np

from parcelscope.operators import changes


def test_pairing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    types = ["tax", "hoa", None]

    def side(n, seed):
        own = np.random.default_rng(seed)
        # Half of all entries share one property and key.
        return [(int(p) if k else 1, f"{i:04d}", types[int(t)] if k else "tax", date(2001, 1, 1 + int(d)) if d and k else None,
                 float(a) if a else None, "open")
                for i, (p, t, d, a, k) in enumerate(zip(rng.integers(1, 9, n), own.integers(0, 3, n), own.integers(0, 3, n),
                                                        own.integers(0, 5, n), own.integers(0, 2, n), strict=True))]

    schema = "property_id bigint, seq string, lien_type string, recording_date date, amount double, status string"
    before, after = side(120, 1), side(150, 2)
    wanted = defaultdict(lambda: ([], []))
    for which, rows in enumerate((before, after)):
        for r in sorted(rows, key=lambda r: r[1]):
            wanted[r[0], r[2], r[3]][which].append((r[4], r[5]))
    expected = []
    for key, (b, a) in wanted.items():
        for k in range(max(len(b), len(a))):
            expected.append((*key, k < len(b), k < len(a), *(b[k] if k < len(b) else (None, None)), *(a[k] if k < len(a) else (None, None))))
    columns = ["property_id", "lien_type", "recording_date", "was", "is", "b_amount", "b_status", "a_amount", "a_status"]
    frames = [spark.createDataFrame(rows, schema) for rows in (before, after)]
    for many in (4096, 20, 0):
        monkeypatch.setattr(changes, "MANY", many)
        got = changes.paired(*frames, ["lien_type", "recording_date"], ["amount", "status"]).select(*columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert changes.paired(*(f.where("false") for f in frames), ["lien_type", "recording_date"], ["amount"]).count() == 0
