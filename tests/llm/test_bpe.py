import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from featloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(1)
    pool = [*range(1, 0x250), *range(0x3040, 0x30FF), *range(0x4E00, 0x4F00), *range(0x1F300, 0x1F400)]
    return ["", " ", "a", "it's we'll I'M 'S", "<|endoftext|>", " \t\n\r\x0b\x0c  x \n", "\x00\x01\x1c\x1f\x85\xa0", "▁a ▁b", "ĀāĂ",
            "日本語、漢字。", "🙂🙃" * 40, "a" * 30_000, "ab" * 20_000 + " " * 5000, "".join(chr(r.choice(pool)) for _ in range(20_000))]


def test_equals_the_reference(reference, prose):
    encoder = bpe.Encoder(bpe.serialise(bpe.read_ranks(PATH)), PATTERN)
    texts = [*odd_texts(), prose(1, 5000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text)


def test_memory_starts_anew(reference, prose, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "GROUP", 50)
    encoder = bpe.Encoder(bpe.serialise(bpe.read_ranks(PATH)), PATTERN)
    texts = [prose(i, 30) for i in range(20)]
    assert [len(x) // 4 for x in encoder.encode(texts)] == [len(reference.encode_ordinary(t)) for t in texts]


def test_model_is_byte_complete(tmp_path):
    assert bpe.from_text(bpe.to_text(bytes(range(256)))) == bytes(range(256))
    bad = tmp_path / "v"
    bad.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(bad))
    bad.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(bad))


def test_query(docs, reference):
    texts = [None, *odd_texts()]
    df = docs([(i, t) for i, t in enumerate(texts)] + [(0, None), (1, ""), (None, "null id")], extra=True)
    got = bpe.digests(df, PATH, PATTERN).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_decode_alone(docs):
    df = docs([(i, t) for i, t in enumerate(odd_texts())])
    ids = bpe.encode(df, PATH, PATTERN)
    assert ids.columns == ["doc_id", "ids"]
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(ids, PATH).collect()}
    assert back == dict(enumerate(odd_texts()))
    assert bytes(bpe.decode(ids.selectExpr("doc_id", "cast(null AS binary) AS ids"), PATH).first()["decoded"]) == b""


def test_empty_table(docs):
    assert bpe.digests(docs([(1, "x")]).limit(0), PATH, PATTERN).count() == 0
