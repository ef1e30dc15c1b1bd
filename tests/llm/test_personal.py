import hashlib
import random
import re

import numpy as np

from featloom.llm import boosting, personal
from featloom.llm.labelled_texts import labelled_text
from featloom.llm.personal import KINDS, Span


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The contract's base spans, by plain patterns."""
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


TEXTS = ["", "a@b", "a@b.c@d.e", "a@b@c.d", "x.@y..z", "@a.b", "a@b.c.", "é.34@mail7.example.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.4.5",
         "256.1.1.1.1", "0001.02.3.255", "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111 1111 1111", "4111111111111112",
         "+1 (017) 555-7713", "+1 (017) 555-7713 4736962573099581", "+1", "+12345678901", "++1 234 567 8901-", "+1 2", "٤١١١ ٠"]


def test_base_spans():
    r = random.Random(4)
    for i in range(3000):
        t = "".join(r.choice("ab1294.@-+ ()é\n%_") for _ in range(r.randint(0, 40)))
        assert personal.base_spans(t) == brute(t), t
        t = "".join(r.choice("0123456789 .-+()") for _ in range(r.randint(10, 60)))
        assert personal.base_spans(t) == brute(t), t
    for t in TEXTS:
        assert personal.base_spans(t) == brute(t), t
    for seed in range(300):
        assert personal.base_spans(labelled_text(seed)[0]) == brute(labelled_text(seed)[0])


def test_long_runs_take_one_pass():
    import time
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "1 " * 150_000, "+1 " * 100_000, "(" * 200_000, "12 at " * 50_000, ":" * 200_000):
        start = time.perf_counter()
        base = personal.base_spans(run)
        personal.detector().added(run, base)
        assert time.perf_counter() - start < 20, run[:6]


def test_held_out_accuracy():
    """On texts of other seeds: nearly all that is accepted is right, and nearly all there is is found."""
    d = personal.detector()
    right, accepted, there = np.zeros(4), np.zeros(4), np.zeros(4)
    for seed in range(10_000, 10_800):
        text, truth = labelled_text(seed)
        base = personal.base_spans(text)
        free = personal._Free(base)
        added = d.added(text, base)
        for k, kind in enumerate(KINDS):
            mine = {(kind, s.start, s.end) for s in added if s.kind == k}
            open_ = {t for t in truth if t[0] == kind and free.has(Span(t[1], k, t[2]))}
            accepted[k] += len(mine)
            right[k] += len(mine & truth)
            there[k] += len(open_)
    assert (right >= 0.95 * accepted).all() and (right >= 0.9 * there).all() and (there > 20).all(), (right, accepted, there)


def test_clean_texts_stay(prose):
    d = personal.detector()
    clean = [prose(i, 80) + f" version {i % 9}.{i % 7}, page {i}, {1900 + i}-{i % 12 + 1:02}-11, {i},500 items. At the dot we met." for i in range(150)]
    assert [t for t in clean if d.added(t, personal.base_spans(t))] == []


def expected(rows):
    d = personal.detector()
    out = []
    for i, t in rows:
        t = t or ""
        base = brute(t)
        added = [s for s in d.added(t, [Span(*s) for s in base])]
        say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        out.append((i, *(sum(k == n for _, n, _ in base) for k in range(4)), hashlib.sha256(say(base).encode()).hexdigest(),
                    say([*base, *map(tuple, added)]), len(added)))
    return out


def test_digests(spark, docs, prose):
    rows = [(i, labelled_text(i)[0]) for i in range(60)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "a@b.c"), (None, None), (500, None), (3, labelled_text(3)[0]), (501, prose(1, 30_000) + " a@b.cd " + prose(2, 100))]
    got = personal.digests(docs(rows, extra=True).selectExpr("*", "1 AS kind", "2 AS start", "'e' AS n_email", "3 AS n_added"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)
    assert personal.digests(docs(rows).limit(0)).count() == 0


def test_redacted_and_spans(spark, docs):
    rows = [(1, "Mail a.b@c.de or +1 (017) 555-7713 now"), (2, None), (3, "nothing"), (4, "1.2.3.4\na at b dot com")]
    got = dict(map(tuple, personal.redacted(docs(rows)).collect()))
    assert got[1] == "Mail <EMAIL> or <PHONE> now" and got[2] == "" and got[3] == "nothing" and got[4].startswith("<IP>\n")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in personal.spans(docs(rows)).collect()}
    assert found[1] == [("email", 5, 13), ("phone", 17, 34)] and found[2] == []


def test_trees_against_plain_split():
    """One tree of depth 1 takes the split of greatest gain; more rounds lower the loss; thresholds hold their precision."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 5))
    y = (x[:, 2] + 0.3 * x[:, 0] > 0.4).astype(float)
    one = boosting.fit(x, y, rounds=1, depth=1)
    assert one.trees[0].feature.tolist() == [2] and abs(one.trees[0].threshold[0] - 0.4) < 0.35
    loss = lambda m: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * m.margin(x)))))
    assert loss(boosting.fit(x, y, rounds=40)) < loss(boosting.fit(x, y, rounds=5)) < loss(one)
    p = r.random(400)
    label = (r.random(400) < p).astype(float)
    t = boosting.threshold_for(p, label, 0.9)
    assert label[p >= t].mean() >= 0.9
    assert boosting.threshold_for(p, np.zeros(400), 0.9) > 1


def test_calibration():
    r = np.random.default_rng(2)
    margin = r.normal(size=20_000) * 2
    y = (r.random(20_000) < 1 / (1 + np.exp(-(0.5 * margin + 1)))).astype(float)
    c = boosting.calibrate(margin, y)
    assert abs(c.slope - 0.5) < 0.05 and abs(c.offset - 1) < 0.05
