import hashlib
import random
import re

import numpy as np
import pytest

from featloom.llm import linededup as L

BLANKS = "\x20\x09-\x0d"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(rf"^[{BLANKS}]+|[{BLANKS}]+$", "", line))


def brute(rows, min_chars=40, min_docs=5):
    held, last = {}, {}
    for n, (i, t) in enumerate(rows):
        own = -(1 << 63) if i is None else i
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, set()).add(n)
                last[k] = max(last.get(k, own), own)
    out = []
    for i, t in rows:
        own = -(1 << 63) if i is None else i
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and last[key(x)] != own)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


@pytest.fixture
def rows(prose):
    r = random.Random(5)
    shared = [prose(1000 + i, 12).upper() + f" line {i}" for i in range(12)] + ["é" * 40, "é" * 39, "A" * 40 + "\x85"]
    out = []
    for i in range(150):
        lines = [prose(i * 50 + j, r.randint(0, 15)) for j in range(r.randint(1, 6))]
        lines += [r.choice(["", " ", "\t"]) + (s.lower() if r.random() < 0.5 else s) + r.choice(["", "\r", " \x0b"])
                  for s in r.sample(shared, r.randint(0, 5))]
        lines += lines[-1:] if r.random() < 0.3 else []
        r.shuffle(lines)
        out.append((i, "\n".join(lines)))
    hot = shared[0]
    out += [(1000 + i, hot) for i in range(80)]
    out += [(2000, None), (2001, ""), (2002, "\n\n"), (None, shared[1] + "\nx"), (3, out[3][1]), (2003, (hot + "\n") * 5000)]
    return out


def test_against_brute_force(docs, rows):
    got = L.digests(docs(rows, extra=True)).collect()
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(order, map(tuple, got))) == sorted(map(order, brute(rows)))


def test_other_columns_pass(docs, rows):
    df = docs(rows[:20], extra=True)
    kept = L.drop_lines(df)
    assert [f.name for f in kept.schema["doc"].dataType] == [c for c in df.columns if c != "text"]
    assert kept.select("doc.*").where("shard = 'x' AND id = 'y'").count() == 20


def test_empty_table(docs):
    assert L.digests(docs([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    mph = L.MinimalHash.load(*L.MinimalHash.build(keys).dump())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    assert len(mph.bits) <= 5 * n + 64
    with pytest.raises(ValueError):
        L.MinimalHash.build(np.array([7, 7], np.uint64))


def test_foreign_keys_are_told_apart(spark, docs, rows):
    """Arrays built from some documents, probed by others: only lines that were built in count."""
    known = L.line_keys(docs(rows).selectExpr("pmod(doc_id, 3) AS shard", "doc_id AS id", "text").where("shard IS NOT NULL")
                        .selectExpr("cast(shard AS int) AS shard", "id", "text"), 4)
    other = L.line_keys(docs([(i, f"a line that nobody else has, number {i} of many" * 2) for i in range(2000)])
                        .selectExpr("1 AS shard", "doc_id AS id", "text"), 4)
    hits = L.probe(other, L.count_arrays(known), 1).collect()
    assert sum(len(r["keys"]) for r in hits) == 0
