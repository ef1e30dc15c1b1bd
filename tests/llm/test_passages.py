import hashlib
import random

import numpy as np
import pytest

from featloom.llm import passages as P, suffix


def brute(rows, width=50):
    low = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k:k + width]
            first[w] = min(low(i), first.get(w, low(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k:k + width]] < low(i):
                gone[k:k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i is None, i or 0, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture
def rows(prose):
    r = random.Random(6)
    parts = [prose(900 + i, r.randint(5, 60)) for i in range(10)] + ["é🙂" * 20, "a" * 300, "ab" * 90, "0123456789" * 5, "x" * 49]
    out = []
    for i in range(70):
        pieces = [prose(i * 9 + j, r.randint(0, 25)) for j in range(3)] + r.sample(parts, r.randint(0, 3))
        r.shuffle(pieces)
        out.append((i * 2, "".join(pieces)))
    for i in range(12):                                     # near copies
        t = out[5][1]
        at = r.randrange(len(t))
        out.append((300 + i, t[:at] + f"#{i}" + t[at + 2:]))
    out += [(400 + i, out[8][1]) for i in range(10)]        # copies
    out += [(500, None), (501, ""), (502, "q" * 49), (503, "q" * 49), (504, parts[11] * 40), (None, out[1][1] + "tail"), (2, out[1][1]),
            (2, out[7][1][:90] + "same id"), (505, prose(77, 4000) + out[3][1]), (506, "\0" * 120), (507, "\0" * 60 + "z")]
    return out


@pytest.mark.parametrize("hot,shard", [(P.HOT, P.SHARD), (3, 700)])
def test_against_brute_force(docs, rows, hot, shard):
    got = P.digests(docs(rows, extra=True), hot=hot, shard_bytes=shard).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == brute(rows)


def test_spans_and_bytes(docs):
    base = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    got = {r["doc_id"]: r for r in P.kept_bytes(docs([(1, base), (2, "<" + base + ">é")])).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(1, 1 + len(base))] and bytes(got[2]["kept"]) == "<>é".encode()
    assert got[1]["spans"] == []


def test_empty_table(docs):
    assert P.digests(docs([(1, "x")]).limit(0)).count() == 0
    assert [tuple(r)[:4] for r in P.digests(docs([(1, None)])).collect()] == [(1, 0, 0, 0)]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_suffix_arrays():
    r = random.Random(3)
    for trial in range(150):
        letters = r.choice([b"\0", b"\0\1", b"ab", bytes(range(256))])
        t = bytes(r.choice(letters) for _ in range(r.randrange(60))) * r.choice((1, 1, 3))
        x = np.frombuffer(t, np.uint8)
        order, rank = suffix.suffix_array(x)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want and (order[rank] == np.arange(len(t))).all()
        assert suffix.common_prefixes(x, order, rank).tolist() == [common(t[want[j - 1]:], t[want[j]:]) if j else 0 for j in range(len(t))]


def test_least_ids_across_shards():
    r = random.Random(8)
    data = [bytes(r.choice(b"ab\0") for _ in range(r.randint(6, 40))) for _ in range(60)]
    ids = np.array([r.randrange(1000) for _ in data])
    first = {}
    for d, i in zip(data, ids):
        for k in range(len(d) - 5):
            first[d[k:k + 6]] = min(i, first.get(d[k:k + 6], i))
    for shard in (10**6, 50, 7):
        got = P.least_ids(data, ids, 6, shard)
        assert [g.tolist() for g in got] == [[first[d[k:k + 6]] for k in range(len(d) - 5)] for d in data]


def test_ranges_of_a_bucket_are_compared_alone(monkeypatch):
    """Equal windows share a range, so suffix arrays stay small and nothing is merged; strings of several shards are one."""
    r, width, rows, sizes = random.Random(4), 8, [], []
    bases = [bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(90)) for _ in range(40)]
    cuts = [(i % 40, r.randrange(60), r.randint(width, 30)) for i in range(300)]
    passages, place = [bases[b][x:x + n] for b, x, n in cuts], [1000 * b for b, _, _ in cuts]
    for _ in range(6):
        own = sorted(r.sample(range(300), 120), key=lambda i: (place[i], i))
        rows.append(([passages[i] for i in own], np.array([r.randrange(10_000) for _ in own]), np.array([place[i] for i in own], np.uint16)))
    first = {}
    for data, ids, _ in rows:
        for d, i in zip(data, ids.tolist()):
            for k in range(len(d) - width + 1):
                first[d[k:k + width]] = min(i, first.get(d[k:k + width], i))
    groups = P.window_groups
    monkeypatch.setattr(P, "window_groups", lambda text, *a: (sizes.append(len(text)), groups(text, *a))[1])
    monkeypatch.setattr(P, "merge", None)
    got = P._least_of_bucket(rows, width, 10**6, size=1000)
    assert [g.tolist() for g in got] == [[first[d[k:k + width]] for d in data for k in range(len(d) - width + 1)] for data, _, _ in rows]
    assert len(sizes) > 5


def test_many_documents_of_a_shard_are_scanned_in_turn(docs, monkeypatch):
    """A group's documents are told apart by few bits; more of them make another group."""
    monkeypatch.setattr(P, "GROUP_DOCS", 3)
    texts = [b"x" * 60] * 4 + [b"", b"y"] + [b"x" * 60] * 2
    assert [len(g) for _, g in P._groups(texts)] == [3, 3, 2]
    keys, counts = P._shard_grams(texts, 50)
    assert counts.tolist() == [6] and len(P._merged([P.Marks(P.Windows(g, 50)).keys for _, g in P._groups(texts)])) == len(keys)
