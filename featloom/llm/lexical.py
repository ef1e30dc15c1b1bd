"""Ranked lexical search: the k best documents of every item, by norm buckets and exact integer scores.

A document is a vector of impacts, one for each of its terms; an item is a vector of term weights; the score
is their inner product. Only coordinates that an item uses can add to a score, so a document keeps its impacts
of the items' terms and its length (norm) is taken over these.

Every task orders its documents by falling length and takes them bucket by bucket. An item passes a bucket by
if its own length times the greatest length there is below its k-th best score (Cauchy-Schwarz). Inside, the
greatest impacts of the bucket bound every coordinate: once the coordinates still to come cannot reach the k-th
best score, by their bounds or by the remaining lengths, only documents met so far stay candidates, and of
these only those whose own sum and remaining length still reach it. Survivors are scored again over all
coordinates in 64-bit integers. The documents of greatest length are searched first, on their own, and give
each item a score to beat that all tasks start from. The best k of every task meet in a last ranking.

Items come in blocks of about `ENTRIES` terms, and each block meets all documents. What the driver and every
task hold is one block: its terms, their counts in the corpus, and a score for each item.

Terms are runs of letters and digits of ASCII and of all other characters beyond it, only A-Z lower-cased. Null
text has no terms. A document without terms counts nowhere; an item without terms gets no rows. Scores are above
0. Equal scores go by ascending id, null ids last; repeated documents each take a rank. Items of one id and
different texts are ranked apart, equal items once. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from featloom.llm.common import small_batches, staged

#: Terms of items that are searched together.
ENTRIES = 500_000
#: Documents of a bucket, and documents of greatest length that give the first scores to beat.
BUCKET, SEEDS = 4096, 8192
SCALE, LENGTH_SHARE = 1_000_000_000, 75

_TERM_BYTES = (string.ascii_lowercase + string.digits).encode() + bytes(range(0x80, 0x100))
_FOLD = bytes((b + 32 if chr(b) in string.ascii_uppercase else b if b in _TERM_BYTES else 32) for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(df: int, n: int) -> int:
    """Weight of a term that `df` of `n` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_part(n: int, documents: int, words: int) -> int:
    """What a document of `n` terms adds to the denominator of its impacts, over 8."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // words


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, name (of the item's id and text), term, n: how often the item holds the term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, text in zip(*(b.column(c).to_pylist() for c in ("id", "text"))):
                name = hashlib.blake2b(repr(id_).encode() + b"\0" + (text or b""), digest_size=16).digest()
                out += [(id_, name, t, n) for t, n in Counter(terms(text or b"")).items()]
            yield pa.RecordBatch.from_pylist([dict(zip(_ITEM.names, r)) for r in out], schema=_ITEM)
    rows = _rows(items, id_col, text_col).dropDuplicates()
    return small_batches(rows).mapInArrow(run, "item_id bigint, name binary, term binary, n bigint")


_ITEM = pa.schema([("item_id", pa.int64()), ("name", pa.binary()), ("term", pa.binary()), ("n", pa.int64())])


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts of every document that has a term.

    `terms` are numbers of the vocabulary and `counts` their occurrences, as little-endian integers.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            ids, ns, ts, cs = [], [], [], []
            for id_, text in zip(*(b.column(c).to_pylist() for c in ("id", "text"))):
                found = terms(text or b"")
                if found:
                    mine = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                    ids.append(id_)
                    ns.append(len(found))
                    ts.append(np.array([t for t, _ in mine], "<i4").tobytes())
                    cs.append(np.array([c for _, c in mine], "<i8").tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(ts, pa.binary()),
                                   pa.array(cs, pa.binary())], names=["doc_id", "n", "terms", "counts"])
    return small_batches(_rows(docs, id_col, text_col)).mapInArrow(run, "doc_id bigint, n bigint, terms binary, counts binary")


def _document_counts(counts: DataFrame, size: int) -> dict[int, int]:
    """How many documents hold each term of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=size)
        held = np.nonzero(total)[0]
        yield pa.record_batch({"term": held.astype(np.int32), "df": total[held]})
    rows = counts.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df")).collect()
    return {t: d for t, d in rows}


def _vectors(counts: DataFrame, documents: int, words: int, weights: np.ndarray) -> DataFrame:
    """doc_id, norm, terms, impacts (32-bit integers) of every document that holds a term of some weight."""
    weighs = counts.sparkSession.sparkContext.broadcast(weights > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = weighs.value
        for b in batches:
            ids, norms, ts, vs = [], [], [], []
            for id_, n, t, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "n", "terms", "counts"))):
                t, c = np.frombuffer(t, "<i4"), np.frombuffer(c, "<i8")
                t, c = t[counting[t]], c[counting[t]]
                v = impacts(c, length_part(n, documents, words))
                if v.any():
                    ids.append(id_)
                    norms.append(float(np.sqrt((v.astype(np.float64) ** 2).sum())))
                    ts.append(t.tobytes())
                    vs.append(v.astype("<i4").tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(norms, pa.float64()), pa.array(ts, pa.binary()),
                                   pa.array(vs, pa.binary())], names=["doc_id", "norm", "terms", "impacts"])
    return counts.where("length(terms) > 0").mapInArrow(run, "doc_id bigint, norm double, terms binary, impacts binary")


def impacts(counts: np.ndarray, m: int) -> np.ndarray:
    """Impacts of terms by their counts; at most a million each."""
    return (SCALE * counts) // (1000 * counts + min(8 * m, (1 << 62) - 1))


class Bucket:
    """Documents of about the same length, by document and by term."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.lengths, self.longest = lengths, float(lengths.max(initial=0.0))
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.term, self.impact = term, impact
        order = np.argsort(term, kind="stable")
        self.row = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.value = impact[order].astype(np.float64)
        self.held, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(term))
        self.most = np.maximum.reduceat(self.value, first) if len(term) else np.zeros(0)

    def search(self, term: np.ndarray, weights: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of score `floor` at least (and above 0), and their scores; `term` is sorted."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.held, term)
        there = at < len(self.held)
        there[there] = self.held[at[there]] == term[there]
        at, w = at[there], weights[there].astype(np.float64)
        bound = w * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, w, bound = at[order], w[order], bound[order]
        # what the coordinates from the i-th on can add: by their greatest impacts, by the lengths
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        rest_length = np.sqrt(np.append(np.cumsum((w * w)[::-1])[::-1], 0.0))
        if not len(at) or _below(rest[0], floor):
            return none
        enough = np.nonzero(_below(np.minimum(rest, rest_length * self.longest), floor))[0]
        focus = int(enough[0]) if len(enough) else len(at)
        spans = [slice(self.first[i], self.first[i + 1]) for i in at[:focus]]
        if not spans:
            return none
        row = np.concatenate([self.row[s] for s in spans])
        value = np.concatenate([self.value[s] for s in spans])
        sums = np.bincount(row, value * np.repeat(w[:focus], [s.stop - s.start for s in spans]), len(self.lengths))
        if focus < len(at):
            mass = np.bincount(row, value * value, len(self.lengths))
            left = np.sqrt(np.maximum(self.lengths ** 2 * (1 + 1e-9) - mass, 0.0))
            reach = sums + np.minimum(rest[focus], rest_length[focus] * left)
        else:
            reach = sums
        rows = np.nonzero((sums > 0) & ~_below(reach, floor))[0]
        if not len(rows):
            return none
        scores = self._score(rows, term, weights)
        kept = (scores >= floor) & (scores > 0)
        return rows[kept], scores[kept]

    def _score(self, rows: np.ndarray, term: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores over all coordinates."""
        begin, size = self.begins[rows], self.begins[rows + 1] - self.begins[rows]
        ends = np.cumsum(size)
        entry = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        at = np.minimum(np.searchsorted(term, self.term[entry]), len(term) - 1)
        part = np.where(term[at] == self.term[entry], weights[at] * self.impact[entry], 0)
        return np.add.reduceat(part, ends - size)


def _below(bound, floor: int):
    """Whether an upper bound cannot reach a score; rounding must not lose a tie."""
    return bound * (1 + 1e-9) + 1 < floor


class Ranking:
    """The k best documents of every item, of all buckets that a task has met."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], floors: list[int], k: int):
        self.items, self.floors, self.k = items, list(floors), k
        self.lengths = np.array([float(np.sqrt((w.astype(np.float64) ** 2).sum())) for _, w in items])
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in items]

    def meet(self, bucket: Bucket, ids: list[int | None]) -> None:
        reach = self.lengths * bucket.longest
        for i in np.nonzero(~_below(reach, np.array(self.floors, np.float64)))[0].tolist():
            rows, scores = bucket.search(*self.items[i], self.floors[i])
            if len(rows):
                new = [(-s, ids[r] is None, ids[r] or 0) for r, s in zip(rows.tolist(), scores.tolist())]
                self.best[i] = sorted(self.best[i] + new)[:self.k]
                if len(self.best[i]) == self.k:
                    self.floors[i] = max(self.floors[i], -self.best[i][-1][0])


def _best_of_task(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], floors: list[int], k: int) -> DataFrame:
    """item (its number), doc_id, score: at least the k best of every task, longest documents first."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, floors))
    size = BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(*sent.value, k)
        waiting: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            t = [np.frombuffer(x, "<i4") for x in rows.column("terms").to_pylist()]
            v = np.frombuffer(b"".join(rows.column("impacts").to_pylist()), "<i4").astype(np.int64)
            bucket = Bucket(rows.column("norm").to_numpy(), np.array([len(x) for x in t]), np.concatenate(t), v)
            ranking.meet(bucket, rows.column("doc_id").to_pylist())

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                waiting.append(batch.slice(at, size))
                if sum(b.num_rows for b in waiting) >= size:
                    flush()
        if waiting and any(b.num_rows for b in waiting):
            flush()
        out = [(i, None if null else id_, -s) for i, best in enumerate(ranking.best) for s, null, id_ in best]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))],
                              names=["item", "doc_id", "score"])

    return vectors.sortWithinPartitions(F.desc("norm")).mapInArrow(run, "item int, doc_id bigint, score bigint")


def _ranked(found: DataFrame, k: int, *names: str) -> DataFrame:
    order = Window.partitionBy(*names).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """name, item_id, rank, doc_id, score of one block of items, given as rows of `item_terms`."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    counts = staged(counted(docs, vocabulary), "term-counts")
    documents, words = counts.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    df = _document_counts(counts, len(vocabulary))
    weights = np.array([weight(df.get(i, 0), documents) for i in range(len(vocabulary))], np.int64)
    vectors = staged(_vectors(counts, documents, words, weights), "impacts")
    names, items = {}, []
    for r in rows:
        names.setdefault((bytes(r["name"]), r["item_id"]), []).append((vocabulary[bytes(r["term"])], r["n"]))
    for entries in names.values():
        t, n = (np.array(x) for x in zip(*sorted((t, n) for t, n in entries if weights[t] > 0 and t in df))) \
            if any(weights[t] > 0 and t in df for t, _ in entries) else (np.zeros(0, int), np.zeros(0, int))
        items.append((t.astype(np.int32), weights[t] * n))
    floors = [1] * len(items)
    total = vectors.count()
    if total > SEEDS:
        longest = vectors.agg(F.percentile_approx("norm", 1 - SEEDS / total, 10_000)).first()[0]
        seeds = _ranked(_best_of_task(vectors.where(F.col("norm") >= longest), items, floors, k), k, "item")
        for i, floor in seeds.where(F.col("rank") == k).select("item", "score").collect():
            floors[i] = floor
    labels = spark.createDataFrame([(i, name, id_) for i, (name, id_) in enumerate(names)],
                                   "item int, name binary, item_id bigint")
    best = _ranked(_best_of_task(vectors, items, floors, k), k, "item")
    return best.join(F.broadcast(labels), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of `docs` (doc_id, text) for every one of `items` (item_id, text)."""
    wanted = staged(item_terms(items), "item-terms")
    blocks = max(1, math.ceil(wanted.count() / entries))
    place = F.pmod(F.xxhash64("name"), F.lit(blocks))
    found = None
    for i in range(blocks):
        rows = wanted.where(place == i).collect()  # a block
        part = _search_block(docs, rows, k) if rows else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if found is None else found


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
z AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
t AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, z GROUP BY term, docs),
i AS (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS n FROM i GROUP BY ALL),
s AS (SELECT item_id, doc_id, r, CAST(sum(q.n * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), z GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 10
"""
