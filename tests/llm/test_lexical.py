import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from featloom.llm import lexical

ITEMS = "item_id bigint, text string"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    tfs = [(i, Counter(words_of(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scored = []
        for i, c in tfs:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in words_of(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def made(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Ärger", "naïve", "x1", "日本"]
    text = lambda k: " ".join(r.choice(vocabulary[: r.choice((10, 40, 124))]) for _ in range(k))
    docs = [(i, text(r.choice((1, 3, 20, 60)))) for i in range(n)]
    items = [(i, text(r.choice((1, 4, 15)))) for i in range(25)]
    docs += [(1000, None), (1001, ""), (1002, "-- !"), (None, items[3][1]), (None, items[3][1]), (1003, items[4][1].upper()),
             (5, docs[5][1]), (5, docs[5][1]), (1004, " ".join([items[6][1]] * 2000))]
    docs += [(2000 + i, items[7][1]) for i in range(40)]                     # ties
    items += [(50, None), (51, ""), (52, "zzz"), (53, "w1 w1 w1"), (2, items[2][1]), (3, "w7 w8"), (None, "w9")]
    return docs, items


@pytest.mark.parametrize("bucket,seeds,entries", [(4096, 8192, 500_000), (7, 30, 500_000), (16, 8192, 40)])
def test_search(spark, docs, monkeypatch, bucket, seeds, entries):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    rows, items = made(bucket)
    table = spark.createDataFrame(items, ITEMS).repartition(3).selectExpr("*", "'a' AS name", "'b' AS term", "1 AS n", "2 AS doc_id")
    d = docs(rows, extra=True).selectExpr("*", "1.0 AS norm", "2 AS score", "'t' AS terms", "3 AS item")
    got = sorted(map(tuple, lexical.search(d, table, entries=entries).collect()), key=repr)
    assert got == sorted(brute(rows, items), key=repr)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b")], ITEMS)
    schema = lexical.search(docs([(1, "a")]), some).dtypes
    for d, i in ((docs([(1, "a")]), none), (docs([(1, "a")]).limit(0), some), (docs([(1, None)]), some)):
        found = lexical.search(d, i)
        assert found.count() == 0 and found.dtypes == schema


def test_terms():
    assert lexical.terms("Ab-c ÄB\t9_x\x00y\x7fz 日本".encode()) == [x.encode() for x in ("ab", "c", "Äb", "9", "x", "y", "z", "日本")]


def test_bucket_bounds_keep_every_reaching_row():
    """Any score to beat: the rows at or above it come out with exact scores, all others are left."""
    r = np.random.default_rng(3)
    sizes = r.integers(1, 30, 500)
    term = np.concatenate([np.sort(r.choice(60, n, replace=False)) for n in sizes]).astype(np.int32)
    impact = r.integers(1, 10**6, len(term))
    ends = np.cumsum(sizes)
    dense = np.zeros((500, 60), np.int64)
    for i, (b, e) in enumerate(zip(ends - sizes, ends)):
        dense[i, term[b:e]] = impact[b:e]
    bucket = lexical.Bucket(np.sqrt((dense.astype(float) ** 2).sum(axis=1)), sizes, term, impact)
    for n in (1, 3, 12):
        mine = np.sort(r.choice(60, n, replace=False)).astype(np.int32)
        weights = r.integers(1, 20_000, n)
        scores = dense[:, mine] @ weights
        for floor in [1, *np.quantile(scores, [0.5, 0.9, 0.99, 1]).astype(int).tolist(), int(scores.max()) + 1]:
            rows, found = bucket.search(mine, weights, floor)
            want = np.nonzero((scores >= floor) & (scores > 0))[0]
            assert rows.tolist() == want.tolist() and found.tolist() == scores[want].tolist()


def test_buckets_are_passed_by(monkeypatch):
    """A bucket whose documents are too short for an item is not searched."""
    met = []
    search = lexical.Bucket.search
    monkeypatch.setattr(lexical.Bucket, "search", lambda self, *a: met.append(self.longest) or search(self, *a))
    ranking = lexical.Ranking([(np.array([0, 1], np.int32), np.array([10, 10]))], [1], 1)
    for v in (1000, 900, 3):
        ranking.meet(lexical.Bucket(np.array([v * 2**0.5]), np.array([2]), np.array([0, 1], np.int32), np.array([v, v])), [v])
    assert ranking.best == [[(-20_000, False, 1000)]] and len(met) == 1
