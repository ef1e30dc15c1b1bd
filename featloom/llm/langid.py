"""Language identification by cross parsing.

For each language a suffix automaton recognises every substring of a bounded sample of its labelled text. A
text is parsed greedily: each phrase is the longest match of what follows in the sample. Phrases times the
logarithm of the sample's length, over the length of the text, estimate the cross entropy; the language
that needs the least wins. Only letters count: they are lower-cased, and what lies between words is one
blank. The text is parsed whole, in pieces of `PIECE` characters, so that all pieces of a batch of documents
step through the automaton together.

The sample: up to `SAMPLE_DOCS` documents of each label in the order of a hash of their text, short ones
first, cut at `SAMPLE_CHARS` characters of the label. The sample is what the driver sees; more than
`MOST_LABELS` labels are an error. Rows with a null label or without letters are not learned from.

Null text, and text without a letter, is `und` with score 0, and so is every text if nothing was learned; a
third column tells whether a text has a letter, whatever was learned.
Ties go to the label that comes first. With one label learned the score is 1, else it is 1 less the ratio of
the best to the second-best entropy. Every row is predicted on its own, whatever its other columns hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from featloom.llm.common import lean, small_batches

SAMPLE_DOCS, SHORT, SAMPLE_CHARS = 64, 4_000, 24_000
PIECE = 256
#: Characters of texts that are parsed together.
GROUP = 500_000
UNKNOWN_LANGUAGE = "und"
#: Most labels that are learned; more are an error, since every machine holds all automata.
MOST_LABELS = 256
#: Places that are looked at together for a row of steps.
_WINDOW = 2048


@cache
def letter_table() -> np.ndarray:
    """Code point -> lower-cased letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalised(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with 0 between words, and where each text ends; no 0 at a text's start."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = letters[_code_points("\n".join(texts) + "\n")]
    keep = low != 0
    keep[1:] |= low[:-1] != 0  # the first of several blanks
    starts = np.concatenate(([0], ends[:-1]))
    keep[starts] = low[starts] != 0  # the blank that ends the text before belongs to that text
    counts = np.concatenate(([0], np.cumsum(keep)))
    return low[keep], counts[ends]


class Automaton:
    """The suffix automaton of one sample, with all steps of all states in three arrays.

    The step of a state for a code lies at `at = base[state] + code` if `owner[at]` is the state, and leads to
    `follow[at]`. Without a step a new phrase starts with this character at `root[code]`; a character that the
    sample lacks is a phrase of its own. The arrays grow with the sample, not with its alphabet.
    """

    def __init__(self, label: str, sample: np.ndarray):
        self.label, self.length = label, len(sample)
        seen = np.unique(sample)
        self.alphabet = seen
        # codes: 0 for characters that the sample lacks, then the sample's, then the end of a piece
        self.width = len(seen) + 2
        links, lengths, edges = [-1], [0], [{}]
        last = 0
        for code in (np.searchsorted(seen, sample) + 1).tolist():
            current = len(edges)
            lengths.append(lengths[last] + 1)
            edges.append({})
            links.append(0)
            at = last
            while at >= 0 and code not in edges[at]:
                edges[at][code] = current
                at = links[at]
            if at >= 0:
                target = edges[at][code]
                if lengths[target] == lengths[at] + 1:
                    links[current] = target
                else:
                    split = len(edges)
                    lengths.append(lengths[at] + 1)
                    edges.append(dict(edges[target]))
                    links.append(links[target])
                    while at >= 0 and edges[at].get(code) == target:
                        edges[at][code] = split
                        at = links[at]
                    links[target] = links[current] = split
            last = current
        # the state without steps: before a piece, and behind a character that the sample lacks
        self.outside = len(edges)
        edges.append({})
        self.root = np.full(self.width, self.outside, np.int32)
        for code, to in edges[0].items():
            self.root[code] = to
        self.base, self.owner, self.follow = _packed(edges, self.width)

    def codes(self, letters: np.ndarray) -> np.ndarray:
        table = np.zeros(0x110000, np.uint8 if self.width < 256 else np.uint16)
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return table[letters]

    def phrases(self, pieces: np.ndarray) -> np.ndarray:
        """Phrases of every piece; `pieces` is characters x pieces, in codes, short ones filled with the last code."""
        lengths = (pieces != self.width - 1).sum(axis=0)
        order = np.argsort(-lengths, kind="stable")
        pieces = pieces[:, order]
        # pieces that are not over yet come first
        going = len(order) - np.searchsorted(lengths[order][::-1], np.arange(len(pieces)), side="right")
        # numbers of the machine's index width are taken without a conversion
        base, owner, follow, root = (x.astype(np.intp) for x in (self.base, self.owner, self.follow, self.root))
        state = np.full(len(order), self.outside, np.intp)
        begun = np.zeros(len(order), np.int32)
        for codes, n in zip(pieces, going.tolist()):
            if not n:
                break
            own, codes = state[:n], codes[:n]
            at = base.take(own)
            at += codes
            miss = owner.take(at) != own
            follow.take(at, out=own, mode="clip")
            np.copyto(own, root.take(codes), where=miss)
            begun[:n] += miss
        counts = np.empty_like(begun)
        counts[order] = begun
        return counts


def _packed(edges: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`base`, `owner`, `follow`: rows of steps laid over each other so that no two steps share a place.

    Rows with most steps go first, each to the first free place where it fits; rows of one step fill the gaps.
    """
    free = np.ones(2 * width + 2 * sum(map(len, edges)) + _WINDOW, bool)
    free[:width] = False  # so that no base is negative
    base = np.zeros(len(edges), np.int32)
    start = width
    for state in sorted((s for s, out in enumerate(edges) if len(out) > 1), key=lambda s: -len(edges[s])):
        codes = np.array(sorted(edges[state]))
        at, found = start, None
        while found is None:
            if at + _WINDOW + width > len(free):
                free = np.concatenate((free, np.ones(len(free), bool)))
            bases = at + np.flatnonzero(free[at:at + _WINDOW]) - codes[0]
            fits = np.flatnonzero(free[bases[:, None] + codes].all(axis=1))
            if len(fits):
                found = int(bases[fits[0]])
            else:
                at = start = at + _WINDOW
        base[state] = found
        free[found + codes] = False
    single = [s for s, out in enumerate(edges) if len(out) == 1]
    gaps = np.flatnonzero(free)[:len(single)]
    if len(gaps) < len(single):
        gaps = np.concatenate((gaps, np.arange(len(free), len(free) + len(single) - len(gaps))))
    base[single] = gaps - np.array([next(iter(edges[s])) for s in single], np.int64)
    size = int(base.max(initial=0)) + width
    owner, follow = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for state, out in enumerate(edges):
        for code, to in out.items():
            owner[base[state] + code], follow[base[state] + code] = state, to
    return base, owner, follow


def learn(docs: DataFrame, label_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
          sample_chars: int = SAMPLE_CHARS) -> list[Automaton]:
    """One automaton for each label of `docs`, in the order of the labels."""
    labelled = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    labelled = labelled.where(r"label IS NOT NULL AND rlike(text, '\\p{L}')")
    order = Window.partitionBy("label").orderBy(F.length("text") > SHORT, F.xxhash64("text"), "text")
    sample = (labelled.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_docs)
              .select("label", "place", F.substring("text", 1, sample_chars).alias("text"))
              .limit(MOST_LABELS * sample_docs + 1).collect())
    if len({row["label"] for row in sample}) > MOST_LABELS or len(sample) > MOST_LABELS * sample_docs:
        raise ValueError(f"more than {MOST_LABELS} labels")
    letters = letter_table()
    texts: dict[str, list[tuple[int, str]]] = {}
    for label, place, text in sample:
        texts.setdefault(label, []).append((place, text))
    out = []
    for label in sorted(texts):
        joined, _ = normalised([t for _, t in sorted(texts[label])], letters)
        out.append(Automaton(label, joined[:sample_chars]))
    return out


class Parser:
    """Predicts languages of many texts at once."""

    def __init__(self, automata: list[Automaton]):
        self.automata = automata
        self.letters = letter_table()

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Label, score, and whether there is a letter, of each text."""
        letters, ends = normalised(texts, self.letters)
        sizes = np.diff(ends, prepend=0)
        out = [(UNKNOWN_LANGUAGE, 0.0, size > 0) for size in sizes.tolist()]
        if not self.automata or not len(letters):
            return out
        pieces = -(-sizes // PIECE)
        first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
        # the place of every character in the matrix of pieces
        doc = np.repeat(np.arange(len(texts)), sizes)
        within = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
        row, column = within % PIECE, first[doc] + within // PIECE
        del doc, within
        total = int(pieces.sum())
        entropy = np.empty((len(self.automata), len(texts)))
        for i, a in enumerate(self.automata):
            codes = a.codes(letters)
            matrix = np.full((PIECE, total), a.width - 1, codes.dtype)
            matrix[row, column] = codes
            sums = np.concatenate(([0], np.cumsum(a.phrases(matrix).astype(np.int64))))
            entropy[i] = (sums[first + pieces] - sums[first]) * np.log2(max(2, a.length)) / np.maximum(1, sizes)
        best = entropy.argmin(axis=0)
        ranked = np.sort(entropy, axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = 1 - ranked[0] / ranked[1] if len(ranked) > 1 else np.ones(len(texts))
        for j in np.nonzero(sizes)[0]:
            out[j] = (self.automata[best[j]].label, float(score[j]), True)
        return out


def predict(docs: DataFrame, automata: list[Automaton], text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score", letter_col: str | None = None) -> DataFrame:
    """The rows of `docs` with two columns more: the language of every whole text, and the score.

    With `letter_col` a third column tells whether the text has a letter.
    The automata are bounded by the sample; every machine gets them once.
    """
    model = docs.sparkSession.sparkContext.broadcast(automata)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(model.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            found, group, size = [], [], 0
            for i, text in enumerate(texts):
                group.append(text)
                size += len(text)
                if size >= GROUP or i + 1 == len(texts):
                    found += parser.predict(group)
                    group, size = [], 0
            labels, scores, letters = zip(*found) if found else ((), (), ())
            added = {lang_col: pa.array(labels, pa.string()), score_col: pa.array(scores, pa.float64())}
            if letter_col:
                added[letter_col] = pa.array(letters, pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    added = {lang_col: F.lit(""), score_col: F.lit(0.0)} | ({letter_col: F.lit(True)} if letter_col else {})
    schema = docs.select("*", *[value.alias(name) for name, value in added.items()]).schema
    return small_batches(docs).mapInArrow(lambda batches: lean(run(batches)), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document of a table with doc_id, text and lang."""
    automata = learn(docs.where(~held_out()))
    texts = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(texts, automata).drop("text")
