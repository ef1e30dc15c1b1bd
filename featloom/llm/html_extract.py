"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is parsed into its leaf blocks: the runs of text between the beginnings and ends of block elements,
with character references decoded and white space turned into single blanks. Each block is part of the
article or not. Features come from the tags, classes, ids and roles of its ancestors and from its text; a
weight for each pair of neighbouring labels ties the blocks of a page together. The field is fitted by
gradient ascent on the likelihood of labelled pages (`labelled_pages`, a fixed number of them), and Viterbi's
algorithm finds the best labels of a page. The blocks of the article are joined by empty lines.

Null and empty html, and pages on which no block is chosen, give the empty text. Each row is extracted on
its own; repeated rows give equal results, null ids and urls stay null, and other columns are left out. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.llm.common import small_batches
from featloom.llm.html_blocks import Node, blocks_of, own_features
from featloom.llm.labelled_pages import labelled_blocks

PAGES, ROUNDS, STEP, PENALTY = 600, 150, 0.5, 0.0003
_ENDS = re.compile(r"[.!?…:;\"”»)]$")
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)


@functools.lru_cache(maxsize=50_000)
def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    """Tags and words of the ancestors, and the block's own element."""
    out: dict[str, None] = {"bias": None}
    for name in path:
        out |= dict.fromkeys(own_features(name))
    tags = [name.split(".")[0] for name in path[-2:]]
    return (*out, *leaf_features(*tags[::-1]))


def leaf_features(tag: str = "", parent: str = "") -> tuple[str, ...]:
    """Of the element that the block stands in and the one around it."""
    return ((f"own {tag}",) if tag else ()) + ((f"pair {parent} {tag}",) if parent else ())


def text_features(text: str, linked: float, place: int, blocks: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 25 else 4 if words < 60 else 5
    out = [f"size {size}", f"linked {int(linked * 3.99)}", f"ends {bool(_ENDS.search(text))}"]
    if place == 0:
        out.append("first")
    if place == blocks - 1:
        out.append("last")
    if words < 60 and _RIGHTS.search(text):
        out.append("rights")
    return tuple(out)


#: Blocks with the element they stand in (scored by one field only), or with the names of all around them.
Blocks = list[tuple["Node | tuple[str, ...]", str, float]]


class Field:
    """Weights of the features for "article" and of neighbouring labels; label 0 has weight 0."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def path_score(self, node: Node) -> float:
        """Score of the element around a block: that of its parent and of what it adds, each element's once."""
        get, chain = self.weights.get, []
        leaf = node
        while node.score is None:
            chain.append(node)
            if node.parent is None:
                break
            node = node.parent
        for n in reversed(chain):
            n.score = (n.parent.score if n.parent else 0.0) + sum([get(f, 0.0) for f in n.new])
        return leaf.score + sum([get(f, 0.0) for f in leaf_features(leaf.tag, leaf.parent.tag if leaf.parent else "")])

    def scores(self, blocks: Blocks) -> list[float]:
        get, out = self.weights.get, []
        for i, (where, text, linked) in enumerate(blocks):
            score = self.path_score(where) if isinstance(where, Node) else sum(get(f, 0.0) for f in path_features(where))
            out.append(score + sum([get(f, 0.0) for f in text_features(text, linked, i, len(blocks))]))
        return out

    def decode(self, blocks: Blocks) -> list[int]:
        """The most likely labels (Viterbi)."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        no, yes, back = 0.0, 0.0, []
        for i, score in enumerate(self.scores(blocks)):
            if i:
                from_no, from_yes = (no + s00 >= yes + s10, no + s01 > yes + s11)
                back.append((0 if from_no else 1, 0 if from_yes else 1))
                no, yes = max(no + s00, yes + s10), max(no + s01, yes + s11) + score
            else:
                no, yes = 0.0, score
        label = int(yes > no)
        out = [label] if blocks else []
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: int = PAGES, rounds: int = ROUNDS) -> Field:
    """The field of the labelled pages 0 .. pages - 1: all chains step through forward and backward sums together."""
    sample = [labelled_blocks(seed) for seed in range(pages)]
    names: dict[str, int] = {}
    rows, cols, first, labels = [], [], [], []
    for blocks, own in sample:
        for i, (path, text, linked) in enumerate(blocks):
            for f in (*path_features(path), *text_features(text, linked, i, len(blocks))):
                rows.append(len(labels))
                cols.append(names.setdefault(f, len(names)))
            first.append(i == 0)
            labels.append(own[i])
    rows, cols, y = np.array(rows), np.array(cols), np.array(labels)
    starts = np.nonzero(first)[0]
    sizes = np.diff(np.concatenate((starts, [len(y)])))
    longest = int(sizes.max())
    # block of each chain at each step, the last one again where the chain has ended
    grid = starts[:, None] + np.minimum(np.arange(longest), sizes[:, None] - 1)
    inside = np.arange(longest) < sizes[:, None]
    w, steps = np.zeros(len(names)), np.zeros((2, 2))
    seen_steps = np.zeros((2, 2))
    follows = np.nonzero(~np.array(first))[0]
    np.add.at(seen_steps, (y[follows - 1], y[follows]), 1)
    seen = np.bincount(cols, weights=y[rows], minlength=len(names))
    squares, step_squares = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        score = np.bincount(rows, weights=w[cols], minlength=len(y))
        unary = np.stack((np.zeros(len(y)), score), axis=1)[grid]
        forward = np.zeros((len(starts), longest, 2))
        backward = np.zeros_like(forward)
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps, axis=1) + unary[:, t]
            forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        expected_steps = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            after = steps + (unary[:, t + 1] + backward[:, t + 1])[:, None, :]
            both = np.exp(forward[:, t, :, None] + after - total[:, None, None])
            expected_steps += both[inside[:, t + 1]].sum(axis=0)
            backward[:, t] = np.where(inside[:, t + 1, None], np.logaddexp.reduce(after, axis=2), 0)
        chance = np.exp(forward + backward - total[:, None, None])[:, :, 1][inside]
        gradient = (seen - np.bincount(cols, weights=chance[rows], minlength=len(names))) / pages - PENALTY * w
        step_gradient = (seen_steps - expected_steps) / pages - PENALTY * steps
        squares += gradient**2
        step_squares += step_gradient**2
        w += STEP * gradient / np.sqrt(squares)
        steps += STEP * step_gradient / np.sqrt(step_squares)
    return Field(dict(zip(names, w.tolist())), steps)


def main_text(field: Field, html: str | None) -> str:
    blocks = blocks_of(html or "")
    return "\n\n".join(text for (_, text, _), label in zip(blocks, field.decode(blocks)) if label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = fit()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(field, html) for html in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return small_batches(rows).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
