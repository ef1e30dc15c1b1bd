"""Fill-in-the-middle transformation of whole texts, assembled by a secondary sort.

A text is cut at two places that are hashed from its document's id into prefix, middle and suffix, and these
are put into another order between markers. A document becomes pieces of at most `UNIT` characters; a piece
is keyed by its document and its place in the output. One shuffle partitions the pieces by document and sorts
them by document and place (`repartition` and `sortWithinPartitions`: repartition-and-sort-within-partitions
in one pass). Output texts stream through each task piece by piece, so that a digest needs the memory of a piece,
whatever the length of the text. For restoration the outputs stream once more: the markers are found in the stream,
the pieces between them get their place in the original, and a second sort inside the partitions, without
a shuffle, brings them back in order.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` the text itself, for
texts that are empty, hold a marker, or are left as they are by their hash.

Null text is the empty text. A null id is hashed as the empty text. Rows of one id are told apart by a digest
of their texts; equal rows are counted where they meet and each gives a row. Equal rows of a task are numbered and
spread by their number, so copies do not meet in one task. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.llm.common import partitions, small_batches

P, S, M = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Most characters of a piece.
UNIT = 4096
#: Rows and characters that a task sends on together.
BATCH_ROWS, BATCH_CHARS = 2_000, 1_000_000


class Cut(NamedTuple):
    form: str
    prefix: int
    middle: int


def cut_of(doc_id: int | None, text: str) -> Cut:
    """Form of a document's output, and lengths of its prefix and middle."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or P in text or S in text or M in text or h3 % 100 >= PLAIN_FROM:
        return Cut("plain", 0, 0)
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return Cut("spm" if h4 % 100 < SPM_BELOW else "psm", first, second - first)


def pieces_of(doc_id: int | None, text: str, unit: int = UNIT) -> Iterator[str]:
    """The output of a document in pieces, each with the marker that goes before it."""
    cut = cut_of(doc_id, text)
    ends = cut.prefix, cut.prefix + cut.middle
    prefix, middle, suffix = (0, ends[0]), ends, (ends[1], len(text))
    order = {"plain": [("", (0, len(text)))], "psm": [(P, prefix), (S, suffix), (M, middle)],
             "spm": [(S, suffix), (P, prefix), (M, middle)]}[cut.form]
    for marker, (begin, end) in order:
        for at in range(begin, max(end, begin + 1), unit):
            yield (marker if at == begin else "") + text[at:min(at + unit, end)]


def parts(output: Iterable[str], form: str) -> Iterator[tuple[int, str]]:
    """(place of the part in the original, text) of pieces of an output, in whatever pieces it comes.

    The places are 0 for the prefix, 1 for the middle, 2 for the suffix; a plain text is one part.
    """
    if form == "plain":
        yield from ((0, x) for x in output if x)
        return
    place, markers, held = {P: 0, M: 1, S: 2}, [P, S, M] if form == "psm" else [S, P, M], ""
    current = None
    for piece in output:
        held += piece
        while markers and (at := held.find(markers[0])) >= 0:
            if current is not None and at:
                yield current, held[:at]
            current, held = place[markers[0]], held[at + len(markers[0]):]
            markers = markers[1:]
        keep = len(M) - 1 if markers else 0  # a marker may go on in the next piece
        if len(held) > keep:
            yield current, held[:len(held) - keep]
            held = held[len(held) - keep:]
    if held:
        yield current, held


def restore(output: str, form: str) -> str:
    """The text of an output."""
    found = ["", "", ""]
    for place, text in parts([output], form):
        found[place] += text
    return "".join(found)


KEY = ("doc_id", "digest", "copy")
_PIECE = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("copy", pa.int32()), ("place", pa.int32()),
                    ("form", pa.string()), ("n", pa.int64()), ("piece", pa.string())])


def _batched(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded rows and characters."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += len(row[text_at] or "")
        if len(waiting) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield _batch(waiting, schema)
            waiting, size = [], 0
    yield _batch(waiting, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, digest, copy, place, form, n, piece: outputs in pieces, dealt by document and sorted by place.

    `form` and `n` (characters of the text) stand with the first piece of each document only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            for batch in batches:
                for id_, text in zip(*(batch.column(c).to_pylist() for c in ("id", "text"))):
                    text = text or ""
                    digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
                    copy = seen[id_, digest[:8]]
                    seen[id_, digest[:8]] += 1
                    form = cut_of(id_, text).form
                    for place, piece in enumerate(pieces_of(id_, text, unit)):
                        yield (id_, digest, copy, place, None if place else form, None if place else len(text), piece)
        yield from _batched(rows(), _PIECE, 6)

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = small_batches(texts).mapInArrow(run, "doc_id bigint, digest binary, copy int, place int, form string, n bigint, piece string")
    return cut.repartition(partitions(docs.sparkSession), *KEY).sortWithinPartitions(*KEY, "place")


def _documents(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], place: int) -> Iterator[Iterator[tuple]]:
    """The sorted rows of a task, one stream for each document; its rows have to be taken before the next stream.

    Of rows that agree in key and place, which are copies of one another, the first one is told with their number.
    """
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))

    def counted(own):
        for _, same in groupby(own, key=lambda r: r[3:place + 1]):
            first = next(same)
            yield (*first, 1 + sum(1 for _ in same))

    for key, own in groupby(rows(), key=lambda r: r[:3]):
        yield counted(own)


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, form, output: the transformed text of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for own in _documents(batches, ("doc_id", "digest", "copy", "place", "form", "piece"), 3):
                got = list(own)
                yield from [(got[0][0], got[0][4], "".join(r[5] for r in got))] * got[0][6]
        yield from _batched(rows(), schema, 2)
    return small_batches(pieces(docs, id_col, text_col)).mapInArrow(run, "doc_id bigint, form string, output string")


_PART = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("copy", pa.int32()), ("part", pa.int32()),
                   ("place", pa.int64()), ("piece", pa.string()), ("form", pa.string()), ("n", pa.int64()),
                   ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()),
                   ("copies", pa.int64())])
#: Part of the row that ends a document.
END = 9


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Outputs in order, digested, and their parts with places in the original."""
        def rows():
            for own in _documents(batches, ("doc_id", "digest", "copy", "place", "form", "n", "piece"), 3):
                first = next(own)
                key, form, n, copies = first[:3], first[4], first[5], first[7]
                whole = hashlib.sha256(first[6].encode())

                def stream():
                    yield first[6]
                    for r in own:
                        whole.update(r[6].encode())
                        yield r[6]

                sizes = [0, 0, 0]
                for part, text in parts(stream(), form):
                    yield (*key, part, sizes[part], text, None, None, None, None, None, None)
                    sizes[part] += len(text)
                cut = (None, None) if form == "plain" else sizes[:2]
                yield (*key, END, 0, None, form, n, *cut, whole.hexdigest(), copies)
        yield from _batched(rows(), _PART, 5)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for own in _documents(batches, tuple(_PART.names), 4):
                text = hashlib.sha256()
                for r in own:
                    if r[3] == END:
                        yield from [(r[0], r[7], r[6], r[8], r[9], r[10], text.hexdigest())] * r[11]
                    else:
                        text.update(r[5].encode())
        yield from _batched(rows(), _DIGEST, 6)

    apart = small_batches(pieces(docs, id_col, text_col, unit)).mapInArrow(
        taken_apart, "doc_id bigint, digest binary, copy int, part int, place bigint, piece string, form string, n bigint, "
        "prefix_chars bigint, middle_chars bigint, output_sha256 string, copies bigint")
    return apart.sortWithinPartitions(*KEY, "part", "place").mapInArrow(
        put_together, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
        "output_sha256 string, restored_sha256 string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
