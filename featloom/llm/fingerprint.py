"""Document fingerprints that add up: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph becomes a wide vector. Four lanes of 64 bits are hashed from the whole paragraph and make
different texts differ. 256 lanes of 32 bits count the paragraph's sentences, each with signs hashed from
it, and make similar texts similar. Blank sentences are not counted, so blank lines make no texts alike; as
paragraphs they are hashed like any other. A text's fingerprint is the sum of its paragraphs' vectors, lane by
lane modulo 2^64 and 2^32, which no count of a text's sentences reaches: it does not depend on their order, and paragraphs are inserted and deleted by adding
and subtracting vectors. The inner product of the signed lanes estimates how many sentences two texts share.

Paragraphs end at line feeds. Null text is the empty text, which has one empty paragraph. Texts with the same
paragraphs in another order have the same fingerprint. Documents are ordered by descending id; a null id is
the smallest, equal ids go by descending text, then null text, and equal rows are interchangeable. Every row
counts, also repeated ones. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.llm.common import partitions, small_batches

SIGNS, STRONG = 256, 4
SMALLEST = -(1 << 63)
#: Ranges of ids for each shuffle partition: several, so that the ranges of a partition even out.
RANGES = 4


def _sum_of_signs(sentences: list[bytes]) -> np.ndarray:
    if not sentences:
        return np.zeros(SIGNS, np.uint32)
    digests = b"".join([blake2b(s, digest_size=SIGNS // 8).digest() for s in sentences])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(sentences), -1), axis=1)
    return (2 * bits.sum(axis=0, dtype=np.int64) - len(sentences)).astype(np.uint32)


class Fingerprint:
    """A sum of paragraph vectors; `+` and `-` insert and delete paragraphs."""

    __slots__ = ("signs", "strong")

    def __init__(self, signs: np.ndarray, strong: np.ndarray):
        self.signs, self.strong = signs, strong

    @classmethod
    def of(cls, paragraphs: list[str]) -> Fingerprint:
        data = [p.encode() for p in paragraphs]
        sentences = [s for p in data for s in p.split(b". ") if s.strip()]
        strong = b"".join([blake2b(p, digest_size=8 * STRONG, person=b"paragraph").digest() for p in data])
        total = np.frombuffer(strong, "<u8").reshape(len(data), STRONG).sum(axis=0, dtype=np.uint64)
        return cls(_sum_of_signs(sentences), total)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.signs + other.signs, self.strong + other.strong)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.signs - other.signs, self.strong - other.strong)

    def __eq__(self, other) -> bool:
        return bool((self.signs == other.signs).all() and (self.strong == other.strong).all())

    def text(self) -> str:
        return base64.b64encode(self.strong.astype("<u8").tobytes() + self.signs.astype("<u4").tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        data = base64.b64decode(text)
        return cls(np.frombuffer(data[8 * STRONG:], "<u4").astype(np.uint32),
                   np.frombuffer(data[:8 * STRONG], "<u8").astype(np.uint64))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Estimated cosine of two texts' sentence counts, 0 to 1; 1 for equal fingerprints, and for those only."""
    if a == b:
        return 1.0
    x, y = a.signs.astype(np.int32).astype(np.float64), b.signs.astype(np.int32).astype(np.float64)
    scale = float(np.sqrt((x @ x) * (y @ y)))
    return min(max(float(x @ y) / scale, 0.0), 1 - 1e-9) if scale else 0.0


def fingerprint(text: str | None) -> Fingerprint:
    return Fingerprint.of((text or "").split("\n"))


def _texts_to(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"),
                                   "fingerprint": [fingerprint(t).text() for t in b.column("text").to_pylist()]})
    return small_batches(_texts_to(docs, id_col, text_col)).mapInArrow(run, "doc_id bigint, fingerprint string")


def with_followers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """range, guest, key, doc_id, text: documents dealt by ranges of descending ids and sorted there.

    The first document of a range also goes to the range before it, as a guest at its end, so that every
    document is followed by its next one. The driver learns the edges of the ranges and the greatest id of
    each; they are a few for each shuffle partition.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    texts = _texts_to(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(SMALLEST)))
    ids = texts.select("key")
    wanted = n * RANGES
    edges = np.unique(np.array(ids.approxQuantile("key", [i / wanted for i in range(1, wanted)], 0.1 / wanted) or [], np.int64)) \
        if wanted > 1 else np.array([], np.int64)

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd
        return pd.Series((len(edges) - np.searchsorted(edges, key.to_numpy(np.int64), side="right")).astype(np.int32))

    firsts = dict(ids.groupBy(range_of("key").alias("range")).agg(F.max("key")).collect())
    order = sorted(firsts)
    hosts = {firsts[r]: order[i - 1] for i, r in enumerate(order)}  # the first of all follows the last

    @F.pandas_udf("array<int>")
    def places(key):
        """The own range, and for a range's first document the range that it closes."""
        import pandas as pd
        own = len(edges) - np.searchsorted(edges, key.to_numpy(np.int64), side="right")
        return pd.Series([[o, hosts[k]] if k in hosts else [o] for o, k in zip(own.tolist(), key.tolist())])

    placed = texts.select("doc_id", "text", "key", F.posexplode(places("key")).alias("guest", "range"))
    return (placed.repartition(n, "range")
            .sortWithinPartitions("range", "guest", F.desc("key"), F.col("text").desc_nulls_last())
            .select("range", "guest", "doc_id", "text"))


def edit_of(text: str, following: str) -> tuple[str, int]:
    """The text whose last floor(n / 2) characters give way to the first as many of the next; where it starts to differ."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k], len(text) - k


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text's fingerprint is that of the text, less the paragraphs that the edit deletes, plus those
    it inserts.
    """
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [x.split()[0] for x in schema.split(", ")]

    def one(doc_id, text: str, own: Fingerprint, following: str, other: Fingerprint):
        new, cut = edit_of(text, following)
        same = text.count("\n", 0, cut)  # paragraphs that end before the cut stay
        changed = (own - Fingerprint.of(text.split("\n")[same:])) + Fingerprint.of(new.split("\n")[same:])
        return (doc_id, len(text), sha256(new.encode()).hexdigest(), own.text(), changed.text(),
                likeness(own, changed), likeness(own, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, doc_id, text, fingerprint of the document that waits for its next one
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")))
            for place, guest, doc_id, text in rows:
                text = text or ""
                waits = before is not None and before[0] == place
                if guest and not waits:
                    continue  # another copy of a guest
                own = fingerprint(text)
                if waits:
                    out.append(one(*before[1:], text, own))
                before = None if guest else (place, doc_id, text, own)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_ARROW)

    return small_batches(with_followers(docs, id_col, text_col)).mapInArrow(run, schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])
