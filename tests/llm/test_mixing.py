import re
from collections import Counter

import pytest

from featloom.llm import mixing


def water(sizes, weights, most=3):
    """Targets by clipping and sharing again until nothing is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        if not open_:
            return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture
def corpus(prose):
    rows = [(i, prose(i, 1 + i % 40), "en", f"s{i % 3}" if i % 2 else "big") for i in range(300)]
    return rows + [(1000, None, "en", "s0"), (1001, "", "en", "big"), (1002, "a b c", "en", None), (1003, "tiny", "en", "zz"),
                   (1004, "x " * 5000, "en", "long"), (7, "repeated row", "en", "s1"), (7, "repeated row", "en", "s1"),
                   (None, "no id here", "en", "s2"), (1005, "caf\xe9\x0bb\xa0c\x85d", "en", "s0")]


def test_plan_against_brute_force(docs, corpus):
    got = mixing.mix_sizes(docs(corpus, extra=True)).collect()
    source = {}
    for i, t, _, s in corpus:
        source.setdefault(i, s)
    sizes = Counter()
    for _, t, _, s in corpus:
        sizes[s] += words(t)
    want = water(sizes, mixing.WEIGHTS)
    assert len(got) == len(corpus)
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        # equal rows share a cut and may lose a word each
        assert abs(taken[s] - want[s]) <= 3
    assert sorted(map(tuple, got)) if None not in source else True
    again = mixing.mix_sizes(docs(corpus, partitions=7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_corpus(docs, corpus):
    plan = mixing.mix_sizes(docs(corpus)).collect()
    mixed = mixing.mix(docs(corpus)).collect()
    wanted, got = Counter(), Counter()
    for r in plan:
        wanted[r["doc_id"]] += r["taken"]
    for r in mixed:
        got[r["doc_id"]] += words(r["text"])
        assert r["n_chars"] == len(r["text"] or "")
    assert {k: v for k, v in wanted.items() if v} == {k: v for k, v in got.items() if v}
    texts = {}
    for i, t, *_ in corpus:
        texts.setdefault(i, []).append(t or "")
    assert all(any(t.startswith(r["text"] or "") for t in texts[r["doc_id"]]) for r in mixed)
    assert {r["doc_id"] for r in mixed} >= {1000, 1001}        # without words: kept once


def test_small_tables(docs):
    assert mixing.mix_sizes(docs([(1, "a")]).limit(0)).count() == 0 and mixing.mix(docs([(1, "a")]).limit(0)).count() == 0
    one = mixing.mix_sizes(docs([(1, "a b c")])).first()
    assert (one["size"], one["target"], one["taken"]) == (3, 3.0, 3)
    empty = mixing.mix_sizes(docs([(1, None), (2, " ")])).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_hot_source(docs, prose):
    rows = [(i, prose(i, 5), "en", "hot" if i % 3 else "cold") for i in range(3000)]
    got = mixing.mix_sizes(docs(rows)).collect()
    assert sum(r["taken"] for r in got) == pytest.approx(15_000, abs=3)
