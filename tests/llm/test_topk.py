import random

import numpy as np
import pytest

from featloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    import math
    kept = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault(i, []).append([math.floor(64 * float(np.float32(x))) for x in v])
    out = {}
    for q, vs in kept.items():
        if q % every == 0:
            for v in {tuple(x) for x in vs}:
                scored = [(-sum(a * b for a, b in zip(v, c)), i) for i, cs in kept.items() if i != q for c in cs]
                out.setdefault(q, []).append([(i, -s) for s, i in sorted(scored)[:k]])
    return out


@pytest.mark.parametrize("blocks", [(8192, 1024), (64, 3)])
def test_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)], 0) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(60)]                       # a common vector: ties
    rows += [(2000, None, 0), (2020, [], 0), (2040, [1.0, None], 0), (2060, [float("nan")], 0), (2080, [float("inf"), 1.0], 0),
             (None, [1.0], 0), (2100, [0.5, -0.5], 0), (40, rows[40][1], 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS id", "'c' AS cell", "2 AS v")
    v = topk.integers(df, "vec_id", "embedding")
    got = {}
    for x in topk.search(v, v.where("id % 20 = 0")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = brute(rows)
    assert set(got) == set(want)
    for q, lists in want.items():
        assert sorted(got[q]) == [(n + 1, i, s) for n, (i, s) in enumerate(lists[0])], q


def test_pruning_keeps_everything():
    r = np.random.default_rng(0)
    for spread in (1, 20):
        q, c = r.integers(-40, 40, (32, 30)), r.integers(-40, 40, (32, 5000)) // spread
        qid, cid = np.arange(30), np.arange(5000)
        qi, ci, s = topk.best_of_block(qid, q, cid, c, 20)
        full = (q.T @ c).astype(np.int64)
        full[qid[:, None] == cid[None, :]] = -np.iinfo(np.int64).max
        for i in range(30):
            best = np.lexsort((cid, -full[i]))[:20]
            assert ci[qi == i].tolist() == best.tolist() and s[qi == i].tolist() == full[i][best].tolist()


def test_large_components_stay_exact():
    q, c = np.array([[2**30], [3]]), np.array([[2**30, 2**30], [1, 2]])
    assert topk.best_of_block(np.array([0]), q, np.array([1, 2]), c, 2)[2].tolist() == [2**60 + 6, 2**60 + 3]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)
    v = topk.integers(df, "vec_id", "embedding")
    assert [tuple(r) for r in topk.search(v, v.where("id % 20 = 0")).collect()] == [(0, 1, 1, 64 * 128)]
    none = v.limit(0)
    assert topk.search(none, none).count() == 0 and topk.search(v, none).count() == 0
