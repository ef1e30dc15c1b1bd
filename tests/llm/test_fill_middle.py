import hashlib

import pytest

from featloom.llm import fill_middle as fim


def brute(doc_id, text):
    """The contract's output, in one string."""
    text = text or ""
    n = len(text)
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out, cut = "plain", text, (None, None)
    elif h4 % 100 < 20:
        form, out, cut = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", (a, b - a)
    else:
        form, out, cut = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", (a, b - a)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, n, form, *cut, sha(out), sha(text)), out


def rows_of(prose):
    rows = [(i, prose(i, i % 37)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "é日𝄞" * 900), (203, prose(1, 30_000)), (204, "a<P>b"), (205, "<" * 50), (206, "<P<S<M" * 30),
             (207, "x<M>"), (208, "\n"), (None, None), (None, "null id"), (None, "null id"), (None, "other"), (7, rows[7][1]), (7, "changed")]
    return rows + [(300, "copy " * 20)] * 90


@pytest.mark.parametrize("unit", [1, 3, 4096])
def test_digests(spark, docs, prose, unit):
    rows = [r for r in rows_of(prose) if unit > 1 or len(r[1] or "") < 5000]
    d = docs(rows, extra=True).selectExpr("*", "1 AS copy", "'p' AS place", "2 AS digest", "'f' AS form", "3 AS piece", "4 AS part")
    got = fim.digests(d, unit=unit)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute(*r)[0] for r in rows), key=repr)


def test_outputs(spark, docs, prose):
    rows = rows_of(prose)
    got = sorted((r["doc_id"], r["output"], r["form"]) for r in fim.outputs(docs(rows)).collect() if r["doc_id"] is not None)
    assert got == sorted((r[0], brute(*r)[1], brute(*r)[0][2]) for r in rows if r[0] is not None)
    assert {f for _, _, f in got} == {"plain", "psm", "spm"}
    for i, out, form in got:
        assert fim.restore(out, form) in {t or "" for j, t in rows if j == i}


def test_marker_over_piece_ends():
    for form, out, parts in (("psm", "<P>ab<<S><S<M><", ["ab<", "<", "<S"]), ("spm", "<S><P><M>", ["", "", ""])):
        for size in (1, 2, 3, 5, 100):
            found = ["", "", ""]
            for place, text in fim.parts((out[i:i + size] for i in range(0, len(out), size)), form):
                found[place] += text
            assert found == parts, size


def test_copies_are_spread(spark, docs):
    """Copies do not meet in one task, and one shuffle is all there is."""
    from pyspark.sql import functions as F
    d = docs([(1, "the same text")] * 400, partitions=2)
    sizes = [r["count"] for r in fim.pieces(d).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    plan = fim.digests(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_table(docs):
    assert fim.digests(docs([(1, "a")]).limit(0)).count() == 0
