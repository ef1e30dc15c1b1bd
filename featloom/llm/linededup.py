"""Line deduplication by sharded minimal perfect hashes.

Long lines that many documents hold are dropped everywhere but in the last of these documents. Documents are
dealt into shards; a shard sends each of its line keys once, as a 64-bit hash with the number of its
documents and the greatest id, to the key's range of hashes. There a minimal perfect hash over the distinct
hashes gives every key a slot in compact arrays of fingerprints, counts and last ids. Shards probe the arrays
with their hashes and learn which of them are to go; lines themselves never leave their documents.

A key is the line without blanks at both ends and with A-Z in lower case. Each row counts as a document,
also a repeated one; rows of one id are one document for keeping, so that all rows of the last id keep their
lines. A null id is the smallest. Null text is the empty text and stays null if no line is dropped.
Other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.llm.common import BLANKS, bucket_cuts, mix64, partitions, shard_of, staged

MIN_CHARS, MIN_DOCS = 40, 5
SMALLEST = -(1 << 63)
#: Slots for each key on a level of the hash.
SPARE = 2
LEVELS = 64


class MinimalHash:
    """A minimal perfect hash of distinct 64-bit keys in levels.

    On each level keys fall on bits; a bit hit by one key alone is that key's, the other keys go to the next
    level. A key's slot is the number of taken bits before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys ^ mix64(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        sizes, levels = [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("keys must be distinct")
            size = SPARE * len(keys) + 1
            place = cls._place(keys, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1, or any slot, for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = self.starts[level] + self._place(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return self.sizes.astype("<i8").tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> MinimalHash:
        n = np.frombuffer(sizes, "<i8")
        return cls(n, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n.sum())).astype(bool))


def key_hash(line: str, min_chars: int) -> int | None:
    """The hash of a line's key, None for a short one."""
    import xxhash
    key = line.strip(BLANKS)
    return xxhash.xxh3_64_intdigest(key.encode().lower()) if len(key) >= min_chars else None


def _short(key: np.ndarray) -> np.ndarray:
    """The compact fingerprint of a key: bits that neither its range nor its slots show."""
    return (mix64(key) >> np.uint64(32)).astype(np.uint32)


_KEYS = "shard int, bucket int, keys binary, docs binary, last binary"
_ARRAYS = "bucket int, sizes binary, bits binary, prints binary, docs binary, last binary"
_HITS = "shard int, keys binary, last binary"


def _column(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def _arrow(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)})


def line_keys(dealt: DataFrame, buckets: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """The distinct line keys of every shard, sorted, in the ranges of the hashes."""
    def run(docs: pa.Table) -> pa.Table:
        shard = docs.column("shard")[0].as_py()
        hashes, ids = [], []
        for doc_id, text in zip(_column(docs, "id"), _column(docs, "text")):
            own = {key_hash(line, min_chars) for line in (text or "").split("\n")} - {None}
            hashes += own
            ids += [SMALLEST if doc_id is None else doc_id] * len(own)
        keys = np.array(hashes, np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, last = keys[order], np.array(ids, np.int64)[order]
        keys, start, docs_of = np.unique(keys, return_index=True, return_counts=True)
        last = np.maximum.reduceat(last, start) if len(keys) else last
        cuts = bucket_cuts(keys, buckets)
        return _arrow(_KEYS, [
            (shard, b, keys[x:y].tobytes(), docs_of[x:y].astype(np.int64).tobytes(), last[x:y].tobytes())
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x])
    return dealt.groupBy("shard").applyInArrow(run, _KEYS)


def count_arrays(keys: DataFrame) -> DataFrame:
    """One row for each range of hashes: the minimal perfect hash and the arrays that it indexes."""
    def run(t: pa.Table) -> pa.Table:
        all_keys, docs, last = (np.frombuffer(b"".join(_column(t, c)), d)
                                for c, d in (("keys", np.uint64), ("docs", np.int64), ("last", np.int64)))
        order = np.argsort(all_keys, kind="stable")
        distinct, start = np.unique(all_keys[order], return_index=True)
        docs, last = np.add.reduceat(docs[order], start), np.maximum.reduceat(last[order], start)
        mph = MinimalHash.build(distinct)
        slots = mph.slots(distinct)
        arrays = [np.empty(len(distinct), d) for d in (np.uint32, np.int64, np.int64)]
        for a, values in zip(arrays, (_short(distinct), docs, last)):
            a[slots] = values
        return _arrow(_ARRAYS, [(t.column("bucket")[0].as_py(), *mph.dump(), *(a.tobytes() for a in arrays))])
    return keys.groupBy("bucket").applyInArrow(run, _ARRAYS)


def probe(keys: DataFrame, arrays: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """For each shard the hashes of its keys that at least `min_docs` documents hold, with the last of these."""
    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return _arrow(_HITS, [])
        row = found.to_pylist()[0]
        mph = MinimalHash.load(row["sizes"], row["bits"])
        prints, docs, last = (np.frombuffer(row[c], d) for c, d in (("prints", np.uint32), ("docs", np.int64), ("last", np.int64)))
        out = []
        for shard, data in zip(_column(asked, "shard"), _column(asked, "keys")):
            own = np.frombuffer(data, np.uint64)
            slots = mph.slots(own)
            hit = (slots >= 0) & (prints[slots] == _short(own)) & (docs[slots] >= min_docs)
            if hit.any():
                out.append((shard, own[hit].tobytes(), last[slots[hit]].tobytes()))
        return _arrow(_HITS, out)
    return keys.groupBy("bucket").cogroup(arrays.groupBy("bucket")).applyInArrow(run, _HITS)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS) -> DataFrame:
    """doc (a struct of the columns of `docs` but the text), text (what is left), n_lines, n_dropped."""
    spark = docs.sparkSession
    n = partitions(spark)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    dealt = docs.select(shard_of(id_col, n).alias("shard"), F.col(id_col).cast("bigint").alias("id"),
                        F.col(text_col).cast("string").alias("text"), rest.alias("doc"))
    keys = staged(line_keys(dealt.select("shard", "id", "text"), n, min_chars), "line-keys")
    hits = probe(keys, count_arrays(keys), min_docs)
    schema = dealt.select("doc", "text", F.lit(0).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped")).schema

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        gone: dict[int, int] = {}
        for k, v in zip(_column(found, "keys"), _column(found, "last")):
            gone.update(zip(np.frombuffer(k, np.uint64).tolist(), np.frombuffer(v, np.int64).tolist()))
        kept, lines_of, dropped_of = [], [], []
        for doc_id, text in zip(_column(texts, "id"), _column(texts, "text")):
            own = SMALLEST if doc_id is None else doc_id
            lines = (text or "").split("\n")
            stay = [x for x in lines if (h := key_hash(x, min_chars)) is None or gone.get(h, own) == own] if gone else lines
            lines_of.append(len(lines))
            dropped_of.append(len(lines) - len(stay))
            kept.append(text if len(stay) == len(lines) else "\n".join(stay))
        return pa.table({"doc": texts.column("doc"), "text": pa.array(kept, pa.string()),
                         "n_lines": pa.array(lines_of, pa.int64()), "n_dropped": pa.array(dropped_of, pa.int64())})

    return dealt.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    kept = drop_lines(docs.select("doc_id", "text"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, i, line, last IS NOT NULL AND last <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
