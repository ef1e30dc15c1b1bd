import hashlib
import random

import pytest

from featloom.llm import fingerprint as FP


def test_order_does_not_matter_but_content_does():
    a = FP.fingerprint("one.\ntwo. and more\nthree")
    assert a == FP.fingerprint("three\none.\ntwo. and more") and a.text() == FP.fingerprint("three\none.\ntwo. and more").text()
    for other in ("one.\ntwo. and more", "one.\ntwo. and more\nthree\nthree", "one.\ntwo. and More\nthree", "one.\n\ntwo. and more\nthree", ""):
        assert a != FP.fingerprint(other)


def test_insert_and_delete():
    a = FP.fingerprint("p\nq\nr")
    assert a - FP.Fingerprint.of(["q"]) + FP.Fingerprint.of(["s", "s"]) == FP.fingerprint("p\nr\ns\ns")
    assert FP.Fingerprint.read(a.text()) == a
    long = ["same"] * 70_000                               # more than a lane of 16 bits holds
    assert FP.Fingerprint.of(long) - FP.Fingerprint.of(long[1:]) == FP.Fingerprint.of(["same"])


def test_likeness():
    r = random.Random(1)
    lines = [" ".join(str(r.random()) for _ in range(5)) for _ in range(200)]
    one = FP.Fingerprint.of(lines)
    half = FP.Fingerprint.of(lines[:100] + [x + "!" for x in lines[100:]])
    other = FP.Fingerprint.of([x + "?" for x in lines])
    assert FP.likeness(one, one) == 1.0 and 0.35 < FP.likeness(one, half) < 0.65 and FP.likeness(one, other) < 0.25
    empty = FP.fingerprint("")
    assert FP.likeness(empty, empty) == 1.0 and 0 <= FP.likeness(empty, one) <= 1


@pytest.mark.parametrize("blank", ["", "  ", "\r"])
def test_blank_lines_do_not_make_texts_alike(blank):
    r = random.Random(5)
    text = lambda n: f"\n{blank}\n".join(". ".join(f"s{r.random()}" for _ in range(3)) for _ in range(n))
    one, other = text(40), text(40)
    a, b = FP.fingerprint(one), FP.fingerprint(other)
    assert FP.likeness(a, b) < 0.25 and FP.likeness(a, FP.fingerprint(one + "\nlast")) > 0.9
    # blank paragraphs still tell texts apart, and are inserted and deleted
    more = FP.fingerprint(one + f"\n{blank}")
    assert more != a and more - FP.Fingerprint.of([blank]) == a
    assert FP.likeness(FP.fingerprint("\n\n\n"), FP.fingerprint("\n")) == 0.0


def test_a_sentence_repeated_beyond_16_bits():
    a, b = FP.Fingerprint.of(["same"] * 40_000), FP.Fingerprint.of(["same"] * 20_000)
    assert 0.999 < FP.likeness(a, b) < 1
    assert FP.Fingerprint.read(a.text()) == a and a - b == b


@pytest.mark.parametrize("parts", ["1", "4", "50"])
def test_edited(spark, docs, prose, parts):
    r = random.Random(3)
    rows = [(i * 7 - 50, "\n".join(prose(i * 100 + j, r.randint(0, 30)) for j in range(r.randint(1, 8)))) for i in range(120)]
    rows += [(10_000, None), (10_001, ""), (10_002, "é🙂" * 2000), (10_003, "x"), (6, rows[8][1]), (None, "null id\nb")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r for r in FP.edited(docs(rows, extra=True)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda x: -10**9 if x[0] is None else x[0], reverse=True)
    # two rows of id 6: by descending text
    assert len({x[0] for x in rows}) == len(rows) - (1 if sum(x[0] == 6 for x in rows) == 2 else 0)
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]]):
        if i == 6 and sum(x[0] == 6 for x in rows) == 2:
            continue
        text, following = text or "", following or ""
        k = len(text) // 2
        edited = text[:len(text) - k] + following[:k]
        x = got[i]
        own, new = FP.fingerprint(text), FP.fingerprint(edited)
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert x["fingerprint"] == own.text() and x["edited_fingerprint"] == new.text()
        assert x["near_edited"] == FP.likeness(own, new)
        assert x["near_next"] == FP.likeness(own, FP.fingerprint(following))


def test_every_row_counts(docs):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, None)]
    got = FP.edited(docs(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == [
        (False, 1, 1), (False, 1, 1), (False, 1, 1), (False, 2, 1), (True, 0, 0), (True, 0, 1)]
    alone = FP.edited(docs([(1, "abcd")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0
    assert FP.edited(docs(rows).limit(0)).count() == 0
    plain = {r["doc_id"]: r["fingerprint"] for r in FP.fingerprints(docs([(1, "a\nb"), (2, "b\na"), (3, None)])).collect()}
    assert plain[1] == plain[2] != plain[3]
