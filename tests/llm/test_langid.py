import random
import zlib

import numpy as np
import pytest

from featloom.llm import langid

SYLLABLES = {"aa": "ka to mi ra su ne".split(), "bb": "str ung ich ver lich ge".split(), "cc": "é ou tion que la ê".split()}


def text_of(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def phrases_by_hand(sample, text, piece):
    """Greedy longest matches, piece by piece; a character that the sample lacks is a phrase."""
    total = 0
    for at in range(0, len(text), piece):
        part, i = text[at:at + piece], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(j - 1, i + 1)
            total += 1
    return total


def test_parsing_is_longest_match():
    r = random.Random(4)
    sample = "".join(r.choice("ab c") for _ in range(300)).strip()
    points = lambda s: np.array([0 if c == " " else ord(c) for c in s], np.uint32)
    a = langid.Automaton("x", points(sample))
    for _ in range(200):
        text = "".join(r.choice("ab c") for _ in range(r.randint(1, 80)))
        codes = a.codes(points(text))
        matrix = np.full((langid.PIECE, 1), a.width - 1, codes.dtype)
        matrix[:len(codes), 0] = codes
        assert a.phrases(matrix)[0] == phrases_by_hand(sample, text, langid.PIECE)


def test_normalised():
    letters = langid.letter_table()
    got, ends = langid.normalised(["Ab,  c1D", "", "...", "  É x  ", "ﬁ"], letters)
    parts = np.split(got, ends[:-1])
    read = ["".join(" " if c == 0 else chr(c) for c in p) for p in parts]
    assert read == ["ab c d ", "", "", "é x ", "ﬁ"] or read[:4] == ["ab c d ", "", "", "é x "]


@pytest.fixture
def labelled(docs):
    rows = [(i, text_of(lang, i, 3 + i % 60), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 !? \n", "cc"), (503, text_of("bb", 1, 20_000), "bb"),
             (504, text_of("aa", 2, 30), None), (505, text_of("cc", 3, 1), "cc"), (None, text_of("aa", 4, 20), "aa"),
             (7, text_of("bb", 7, 30), "bb"), (7, text_of("bb", 7, 30), "bb"), (506, "日本", "aa")]
    return rows, docs(rows, extra=True)


def test_held_out_accuracy(labelled):
    rows, df = labelled
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        if r["doc_id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in SYLLABLES
    tested = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in tested) >= 0.95 * len(tested)


def test_labels_of_the_rows_do_not_matter(labelled, docs):
    rows, df = labelled
    automata = langid.learn(df.where(~langid.held_out()))
    assert [a.label for a in automata] == ["aa", "bb", "cc"]
    texts = [t for _, t, _ in rows]
    swapped = docs([(-i, t, "bb", "other") for i, t in enumerate(texts)])
    one = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(df.select("text"), automata).collect()}
    two = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(swapped, automata).collect()}
    assert one == two


def test_nothing_to_learn(docs):
    df = docs([(1, "abc", None), (2, "def", None)])
    assert {r["lang_pred"] for r in langid.predict(df, langid.learn(df)).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
    single = docs([(i, "words of one language", "en") for i in range(8)])
    assert {r["score"] for r in langid.identify(single).collect()} == {1.0}


def test_large_alphabet_stays_small():
    r = np.random.default_rng(3)
    sample = (0x4E00 + r.zipf(1.2, 24_000) % 2_900).astype(np.uint32)
    a = langid.Automaton("zh", sample)
    assert a.width > 2_000
    assert sum(x.nbytes for x in (a.base, a.owner, a.follow, a.root)) < 2_000_000
    known, text = "".join(map(chr, sample)), (0x4E00 + r.zipf(1.2, 700) % 3_000).astype(np.uint32)
    pieces = [text[i:i + langid.PIECE] for i in range(0, len(text), langid.PIECE)]
    matrix = np.full((langid.PIECE, len(pieces)), a.width - 1, np.uint16)
    for i, piece in enumerate(pieces[::-1]):
        matrix[:len(piece), i] = a.codes(piece)
    assert a.phrases(matrix).sum() == phrases_by_hand(known, "".join(map(chr, text)), langid.PIECE)


def test_too_many_labels_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 3)
    assert len(langid.learn(docs([(i, "some words", f"l{i % 3}") for i in range(9)]))) == 3
    with pytest.raises(ValueError):
        langid.learn(docs([(i, "some words", f"l{i % 4}") for i in range(9)]))
