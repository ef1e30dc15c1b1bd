"""Every stage of the pipeline against a brute-force version of its decision, then the whole run."""

import hashlib
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import test_bpe
import test_jaccard
import test_linededup
import test_mixing
from featloom.llm import langid
from featloom.llm.common import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(docs, prose):
    shared = prose(500, 14) + " shared by many documents"
    rows = [(i, prose(i, 5 + i % 50) + ("\n" + shared if i % 4 == 0 else ""), "en" if i % 5 else "de", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[7][1] + f" {i}") for i in range(6)] + [(300, rows[50][1]), (301, rows[50][1])]
    rows += [(400, None), (401, ""), (402, "12 !?"), (399, shared), (403, shared), (9, rows[9][1], "en", "s0"), (None, prose(77, 30)), (404, prose(78, 8000))]
    return rows, docs(rows)


def as_rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_language_id_keeps_documents_with_letters(spark, corpus):
    rows, df = corpus
    kept = as_rows(P.language_id(spark, df, ""))
    assert by_id(kept) == by_id([r for r in as_rows(df) if any(c.isalpha() for c in r[1] or "")])


def test_language_id_fills_missing_labels(spark, docs):
    """The prediction decides the label of documents that have none; given labels stay."""
    english, german = "the cat and the dog went with them to this house", "der hund und die katze gingen mit dem kind nach haus"
    rows = [(i, (english if i % 2 else german) + f" {chr(97 + i % 26)}", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, english, None), (101, german, None), (102, english, "de"), (103, "12", None), (None, german, None)]
    got = {(r["doc_id"], r["text"]): r["lang"] for r in P.language_id(spark, docs(rows), "").collect()}
    assert [got[k] for k in ((100, english), (101, german), (102, english), (None, german))] == ["en", "de", "de", "de"]
    assert (103, "12") not in got and len(got) == 64


def test_every_stage_keeps_columns_of_any_name(spark, corpus):
    """All names that the stages and their operators use inside, as extra columns: they come through as they were."""
    inside = """_letter _lang _score lang_pred lang_score has_letter _digest _id _of text_digest surplus_id surplus_of digest stays sid
        n first root token pos apart shard bucket doc key size range plan_source mix_source taken part epochs rest source_size target
        budget cut_key cut_words cut_total n_lines n_dropped id count rows value spans ids decoded""".split()
    rows, df = corpus
    wide = df.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in inside])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        kept = out.collect()
        assert kept and all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for r in kept for c in inside), name
        assert sorted(map(repr, as_rows(out))) == sorted(map(repr, as_rows(stage(spark, df, "")))), name
    assert P.byte_bpe(spark, wide, "").count() == len(rows)


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_id_without_a_model(spark, docs, lang):
    """Labels that teach nothing, or only 'und', and labelled rows that are all held out cost no document."""
    rows = [(1, "abc def", lang), (2, "Ünï 日本", lang), (None, "no id", lang), (3, "12 !?", lang), (4, None, lang), (5, "", lang)]
    held = docs([(i, "words of a held-out text", "en") for i in range(400)]).where(langid.held_out())
    df = docs(rows).unionByName(held)
    kept = as_rows(P.language_id(spark, df, ""))
    assert held.count() > 0 and by_id(kept) == by_id([r for r in as_rows(df) if any(c.isalpha() for c in r[1] or "")])


def test_line_dedup(spark, corpus):
    rows, df = corpus
    got = {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in as_rows(P.line_dedup(spark, df, ""))}
    want = {(i, digest) for i, lines, dropped, digest in test_linededup.brute([(r[0], r[1]) for r in rows]) if dropped < lines}
    assert got == want and len(got) < len({(r[0], r[1]) for r in rows})
    assert all(r[4] == len(r[1] or "") for r in as_rows(P.line_dedup(spark, df, "")))


def test_jaccard_join_keeps_one_of_each_group(spark, corpus):
    rows, df = corpus
    got = Counter(r[0] for r in as_rows(P.jaccard_join(spark, df, "")))
    want = Counter(dict.fromkeys([i for null, i, n, c in test_jaccard.brute([(r[0], r[1]) for r in rows]) if not null and i == c], 1))
    want[None] = 1
    assert got == want


def groups(rows):
    """Rows of each group of near duplicates; a row without words is a group."""
    sets = [test_jaccard.shingle_set(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            a = todo.pop()
            group.append(rows[a])
            near = {b for b in left if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]}
            left -= near
            todo += near
        out.append(group)
    return out


def test_jaccard_join_decides_by_row(spark, docs, prose):
    """Rows of one id with different texts, and copies without an id."""
    base = [prose(900 + i, 40 + i) for i in range(12)]
    rows = [(1, base[0]), (5, base[0] + " more"), (5, base[1])]                # an unrelated text under the id of a copy
    rows += [(7, base[2]), (7, base[2] + " more"), (7, base[3]), (7, base[3])]  # near copies and copies under one id
    rows += [(None, base[4])] * 4 + [(None, base[4] + " more")]                # a group without any id
    rows += [(None, base[5]), (None, base[5]), (9, base[5] + " more")]         # a group with one id
    rows += [(None, base[6]), (8, base[7]), (8, base[8]), (2, base[8]), (8, base[9] + " x"), (3, base[9]), (None, base[9])]
    rows += [(10, None), (10, None), (10, ""), (11, " "), (None, None), (None, None), (None, "")]
    want = Counter()
    got = Counter((r[0], r[1]) for r in as_rows(P.jaccard_join(spark, docs(rows), "")))
    for group in groups(rows):
        if test_jaccard.shingle_set(group[0][1]):
            least = min((i is None, i or 0) for i, _ in group)
            left = {r: got.pop(r) for r in set(group) if r in got}
            assert list(left.values()) == [1] and [(i is None, i or 0) for i, _ in left] == [least]
        elif group[0][0] is None:
            want[group[0]] += 1
        else:
            want[group[0]] = 1
    assert got == want


def test_mix_sources(spark, corpus):
    rows, df = corpus
    got = Counter()
    for r in as_rows(P.mix_sources(spark, df, "")):
        got[r[3]] += test_mixing.words(r[1])
    sizes = Counter()
    for r in as_rows(df):
        sizes[r[3]] += test_mixing.words(r[1])
    for s, target in test_mixing.water(sizes, (5, 2, 1)).items():
        assert abs(got[s] - target) <= 2


def test_byte_bpe(spark, corpus):
    rows, df = corpus
    for r in P.byte_bpe(spark, df, "").collect():
        text = b"".join(test_bpe.bpe.read_ranks(test_bpe.PATH)[t] for t in struct.unpack(f"<{r['n_tokens']}I", r["ids"])) if r["n_tokens"] < 50 else None
        if text is not None:
            assert hashlib.sha256(text).hexdigest() == r["decoded_sha256"]
    assert P.byte_bpe(spark, df, "").count() == df.count()


def test_run(spark):
    """The written stages give what the stages give one after the other, twice the same."""
    docs = read(spark, SF, "documents")
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mix_sources", "byte_bpe"]
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = sorted(map(tuple, P.byte_bpe(spark, docs, SF).select("doc_id", "n_tokens", "decoded_sha256").collect()))
    for _ in range(2):
        got = P.run(spark, SF)
        assert sorted(map(tuple, got.select("doc_id", "n_tokens", "decoded_sha256").collect())) == want


def test_empty_table(spark, corpus):
    none = corpus[1].limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0
