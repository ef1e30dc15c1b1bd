import random
import re

import numpy as np
import pytest

from featloom.llm import jaccard as J, shingles


def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i is None, i or 0, len(s), least.get(find(n)) if s else i) for n, ((i, _), s) in enumerate(zip(rows, sets)))


def edits(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.random()
        if kind < 0.5:
            words[at] = f"w{r.randrange(10**6)}"
        elif kind < 0.75:
            words.insert(at, f"w{r.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def check(docs, rows, **kw):
    got = J.near_duplicates(docs(rows, **kw)).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in got) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    """Copies, chains of edits, common passages, and pairs right at the threshold."""
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(5000)}"
    passage = [word() for _ in range(50)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(1, 120))]
        if r.random() < 0.4:
            base = base[:8] + passage
        for _ in range(r.choice((1, 2, 3, 6))):
            rows.append(" ".join(base))
            base = edits(r, base, r.choice((0, 1, 1, 2, 4)))
    hub = [word() for _ in range(200)]
    rows += [" ".join(edits(r, hub, 5)) for _ in range(40)] + [" ".join(hub)]
    for k in range(8, 30):                                  # n sets that share close to 80 %
        rows += [" ".join(f"a{i}" for i in range(k + 40)), " ".join(f"a{i}" for i in range(k + 30)) + f" z{k}"]
    rows += [None, "", " \n", "one two", "One\ttwo", "one two three four five", "a b a b a b a b"]
    r.shuffle(rows)
    table = [(i * 3, t) for i, t in enumerate(rows)]
    table += [(6, rows[2]), (None, rows[4]), (None, "nobody else has this text at all"), (9999, " ".join(word() for _ in range(20_000)))]
    check(docs, table, extra=True)


def test_hot_group_is_not_paired(docs):
    """Copies with edits of one text: as many comparisons as documents, not their square."""
    r = random.Random(9)
    hub = [f"h{i}" for i in range(300)]
    rows = [(i, " ".join(edits(r, hub, 5))) for i in range(250)] + [(1000, " ".join(hub))]
    sets = J.members(docs(rows))
    built = J.index(docs(rows), sets).cache()
    pairs = J._first_round(built.where("token IS NOT NULL").drop("text"))
    assert pairs.count() <= 3 * len(rows)
    assert {x["component_id"] for x in J.near_duplicates(docs(rows)).collect()} == {0}


def test_empty_and_single(docs):
    assert J.near_duplicates(docs([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in J.near_duplicates(docs([(1, "a b")])).collect()] == [(1, 1, 1)]
    assert [tuple(r) for r in J.near_duplicates(docs([(1, None)])).collect()] == [(1, 0, 1)]


def test_shingles(prose):
    texts = [prose(i, i % 50) for i in range(300)] + [None, "", " \t\n\x0b\x0c\r ", "a", "É é A a", "x " * 30_000, "\x85\xa0 b"]
    sets, ends = shingles.shingle_sets(texts)
    sizes = np.diff(ends, prepend=0)
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]
    # equal shingles, and only those, are equal numbers
    starts = ends - sizes
    seen = {}
    for t, a, b in zip(texts, starts, ends):
        seen.setdefault(frozenset(shingle_set(t)), set()).add(tuple(sets[a:b].tolist()))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_components(spark):
    from featloom.llm.graph import components
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, 500 + i) for i in range(1, 60)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges for x in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
