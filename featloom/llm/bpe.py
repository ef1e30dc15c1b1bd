"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranked byte strings.

Every byte stands as one code point (`FIRST + byte`), so a token is an ordinary piece of text. The model
gives each piece the score -rank and leaves text as it is; sentencepiece then merges the best-scored
neighbours first, which is merging by lowest rank. Pre-tokens are encoded one by one; one that is a token
itself is that token.

Null and empty texts have no tokens and decode to no bytes. Rows are independent: repeated rows, ties,
empty tables and other columns need no rule, and null ids stay null.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.llm.common import lean, small_batches

#: The code point of byte 0.
FIRST = 0x100
#: Characters of the texts that are encoded together.
GROUP = 500_000
#: Pre-tokens remembered by a task; beyond it the memory starts anew.
REMEMBERED = 150_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a file of `base64 rank` lines; ranks are 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 and so on without gaps")
    if not {bytes([b]) for b in range(256)} <= {t for _, t in pairs}:
        raise ValueError("a byte-level vocabulary needs all 256 bytes")
    return [t for _, t in pairs]


def to_text(data: bytes) -> str:
    return data.decode("latin-1").translate(_UP)


def from_text(piece: str) -> bytes:
    return piece.translate(_DOWN).encode("latin-1")


_UP = {b: FIRST + b for b in range(256)}
_DOWN = {FIRST + b: b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: text or message, integer, or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece r is the token of rank r; the unknown piece comes last."""
    unknown, bpe = 2, 2
    pieces = [_field(1, to_text(t).encode()) + _field(2, -float(rank)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    # no dummy prefix, no collapsing and no escaping of blanks
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts with one model; `pattern` cuts them into pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.rank = {t: i for i, t in enumerate(token_bytes(self.sp))}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; sentencepiece is asked in groups."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(self.cut(text))
            size += len(text)
            if size >= GROUP or i + 1 == len(texts):
                self._learn(set().union(*group))
                out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in group]
                group, size = [], 0
        return out

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, rank = self.known, self.rank
        merge, texts = [], []
        for piece in pieces:
            if piece not in known:
                data = piece.encode()
                if (r := rank.get(data)) is not None:
                    known[piece] = r.to_bytes(4, "little")
                else:
                    merge.append(piece)
                    texts.append(to_text(data))
        if merge:
            ids = self.sp.encode(texts, out_type=int, num_threads=1)
            known.update(zip(merge, (struct.pack(f"<{len(x)}I", *x) for x in ids)))


def token_bytes(sp) -> list[bytes]:
    """The inverse mapping: bytes of each rank."""
    return [from_text(sp.id_to_piece(i)) for i in range(sp.get_piece_size() - 1)]


def _with(df: DataFrame, column: str, to: list[str], make) -> DataFrame:
    """`df` with binary columns `to`; `make()` builds in each task a function from a list of values of `column`
    to a list for each of `to`."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out = [pa.array(x, pa.binary()) for x in f(batch.column(place).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *to])

    return small_batches(df).mapInArrow(lambda batches: lean(run(batches)), df.select("*", *[F.lit(b"").alias(c) for c in to]).schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class Decoder:
    """The inverse mapping of a model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.tokens = token_bytes(sentencepiece.SentencePieceProcessor(model_proto=model))

    def decode(self, rows: list[bytes | None]) -> list[bytes]:
        token = self.tokens.__getitem__
        return [b"".join(map(token, np.frombuffer(ids or b"", "<u4").tolist())) for ids in rows]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every whole text as little-endian unsigned 32-bit integers.

    The model is written once, on the driver, from the file `vocabulary`; its size is that of the file.
    """
    model = serialise(read_ranks(vocabulary))

    def make():
        encoder = Encoder(model, pattern)
        return lambda texts: [encoder.encode([x or "" for x in texts])]

    return _with(_texts(docs, id_col, text_col), "text", ["ids"], make).drop("text")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The rows of `encoded` with `decoded`, the bytes that the ids stand for (null: none)."""
    model = serialise(read_ranks(vocabulary))

    def make():
        decoder = Decoder(model)
        return lambda rows: [decoder.decode(rows)]

    return _with(encoded, ids_col, ["decoded"], make)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: `encode` and then `decode` of the ids, in one Python task."""
    model = serialise(read_ranks(vocabulary))

    def make():
        encoder, decoder = Encoder(model, pattern), Decoder(model)

        def both(texts):
            ids = encoder.encode([x or "" for x in texts])
            return [ids, decoder.decode(ids)]
        return both

    return _with(_texts(docs, id_col, text_col), "text", ["ids", "decoded"], make).drop("text")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, after a round trip."""
    both = round_trip(docs, vocabulary, pattern)
    return both.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
