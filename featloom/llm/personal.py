"""Personal data in whole texts: base patterns, and more spans by candidate gradient boosting.

Base spans follow strict patterns for each kind: email, ip, card, phone. They stay as they are.

Generators of high recall propose more spans, also overlapping ones: written-out and bracketed addresses of
any letters, IPv6 and bracketed IPv4 addresses, and runs of consecutive groups of digits, whatever stands
between or before them, as card and phone numbers. Each candidate is described by its format (digits, groups,
separators, check digit, known beginnings) and its context (neighbouring characters, cue words before and
behind it, digits around it). Boosted trees score it, a logistic calibration turns scores into probabilities,
and for each kind a threshold is set at the wanted precision on held-out texts (`labelled_texts` generates
the labelled texts from seeds, a fixed number of them). Of accepted candidates those with higher probability go
first; later ones that overlap a base span or a chosen one are left.

Spans are in code points, the end exclusive, and go by start, then kind, then end. Null text is the empty text
and has none. Each row is searched on its own, so repeated rows give equal results and null ids stay null. Other
columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featloom.llm import boosting
from featloom.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Labelled texts for fitting and for calibration, and the share of right ones among accepted candidates.
FIT_TEXTS, HELD_OUT_TEXTS, PRECISION = 2_000, 1_500, 0.99


class Span(NamedTuple):
    start: int
    kind: int  # place in KINDS
    end: int


# ---- base spans

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += int(d) * 2 - (9 if d > "4" else 0)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with what may stand before it, so that a long run of letters is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _small(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) < 4 and int(significant or 0) <= 255


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts of digits in a row, part by part in each run of digits and dots."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = list(_PARTS.finditer(text, run.start(), run.end()))
        i = 0
        while i + 3 < len(parts):
            four = parts[i:i + 4]
            if all(a.end() + 1 == b.start() for a, b in zip(four, four[1:])):
                if all(_small(p.group()) for p in four):
                    yield four[0].start(), four[3].end()
                i += 4
            else:
                i += 1


_PARTS = re.compile(r"[0-9]+")


def base_spans(text: str) -> list[Span]:
    out = [Span(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [Span(s, 1, e) for s, e in _ips(text)]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:  # at most one separator for each digit
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(Span(m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(Span(m.start(), 3, m.end()))
    return sorted(out)


# ---- candidates

_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s(?:at|AT)\s|\s?@\s?")
_NAME = re.compile(r"[\w.%+-]+\Z")
_HOST = re.compile(r"[\w-]+(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)[\w-]+)+")
_BRACKETED = re.compile(r"[0-9]{1,3}(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?[0-9]{1,3}){3}")
_SIX = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}|:):[0-9A-Fa-f:]*[0-9A-Fa-f:](?![\w:])")
#: Groups of digits with up to three separators between them.
_GROUPS = re.compile(r"[0-9]+(?:[  ().\-/–·]{1,3}[0-9]+)*")
#: Groups of a number at most: two digits to a group, but for one of a phone's.
MOST_GROUPS = 8
#: Characters before an @ that are looked at for a name.
_BEFORE = 80


def _addresses(text: str) -> Iterator[Span]:
    if "@" in text or "at" in text or "AT" in text:
        for m in _AT.finditer(text):
            begin = max(0, m.start() - _BEFORE)
            name = _NAME.search(text[begin:m.start()]) if text[max(0, m.start() - 1):m.start()].strip() else None
            host = _HOST.match(text, m.end()) if name else None
            if host:
                yield Span(begin + name.start(), 0, host.end())


def candidates(text: str) -> list[Span]:
    """Proposed spans of all kinds, each once."""
    out = set(_addresses(text))
    out |= {Span(m.start(), 1, m.end()) for m in _BRACKETED.finditer(text)}
    if "::" in text or text.count(":") > 2:
        out |= {Span(m.start(), 1, m.end()) for m in _SIX.finditer(text) if m.group().count(":") > 1}
    for run in _GROUPS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in _PARTS.finditer(text, run.start(), run.end())]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                count = j - i + 1
                if digits > 19 or count > MOST_GROUPS:
                    break
                start, end = groups[i][0], groups[j][1]
                if digits >= max(13, 3 * count):
                    out.add(Span(start, 2, end))
                if max(7, 2 * count - 1) <= digits <= 15 and (count > 1 or digits >= 9):
                    while start and text[start - 1] in "(+" and groups[i][0] - start < 2:
                        start -= 1
                    out.add(Span(start, 3, end))
    return sorted(out)


# ---- features

# Cue words of each kind, and of numbers that are no personal data.
CUES = (
    ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt", "write", "reach"),
    ("ip", "ipv4", "ipv6", "host", "address", "server", "adresse", "login", "client"),
    ("card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "payment", "paid", "debit"),
    ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "móvil", "whatsapp", "sms"),
    ("order", "invoice", "version", "isbn", "id", "ref", "no", "nr", "sku", "lot", "date", "page", "section", "serial",
     "account", "case", "ticket", "part", "build", "tracking", "time", "score", "total", "price", "released", "between"),
)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Characters before and behind a candidate that its context features see.
LEFT, RIGHT = 40, 24
_CUE_SETS = tuple(map(frozenset, CUES))
_KNOWN_TOPS = frozenset("com org net edu gov io de fr es uk info biz eu ch at it nl".split())


def _class(c: str) -> int:
    if not c or c.isspace():
        return 0
    if c.isalpha():
        return 3
    if c.isdigit():
        return 4
    return 1 if c in ".,;:!?)]}\"'" else 2


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    own = text[start:end]
    digits = "".join(_PARTS.findall(own))
    groups = [len(g) for g in _PARTS.findall(own)]
    between = set(re.sub(r"\w", "", own))
    left, right = text[max(0, start - LEFT):start], text[end:end + RIGHT]
    before, after = [w.lower() for w in _WORD.findall(left)][-4:], [w.lower() for w in _WORD.findall(right)][:2]
    cues = [sum((i + 1) for i, w in enumerate(before) if w in s) for s in _CUE_SETS]
    behind = [sum(w in s for w in after) for s in _CUE_SETS]
    top = _WORD.findall(own)[-1].lower() if kind == 0 and _WORD.search(own) else ""
    year = len(groups) == 3 and (groups in ([4, 2, 2], [2, 2, 4], [4, 1, 2], [4, 2, 1], [4, 1, 1], [1, 2, 4], [2, 1, 4], [1, 1, 4]))
    return [
        float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3),
        len(own), len(digits), len(groups), max(groups, default=0), min(groups, default=0), len(between),
        "+" in text[max(0, start - 1):start + 1], text[max(0, start - 2):start].endswith("+") or digits.startswith("00"),
        "(" in own, "." in between, "-" in between, "/" in between, " " in between or " " in between,
        kind == 2 and luhn(digits), int(digits[0]) if digits else -1, len(set(digits)),
        kind == 2 and digits.startswith(("978", "979")) and len(digits) == 13,
        groups[:3] == [4, 4, 4], year, all(g <= 3 for g in groups),
        "@" in own, " at " in own.lower(), bool(re.search(r"[\[({<]", own)) and kind < 2, " dot " in own.lower(), len(top),
        top in _KNOWN_TOPS, own.count(":"), "::" in own, sum(c.isalpha() for c in own) if kind == 1 else -1,
        _class(left[-1:]), _class(right[:1]), _class(right[1:2]) if right[:1] and not right[:1].isspace() else 0,
        sum(c.isdigit() for c in left), sum(c.isdigit() for c in right), "=" in left[-3:], "#" in left[-3:] or "№" in left[-3:],
        "$" in left[-2:] or "€" in left[-2:], *cues, *behind,
    ]


# ---- model

class Detector(NamedTuple):
    model: boosting.Model
    calibration: boosting.Calibration
    thresholds: tuple[float, ...]  # of each kind

    def probabilities(self, text: str, spans: list[Span]) -> np.ndarray:
        if not spans:
            return np.zeros(0)
        return self.calibration.probability(self.model.margin(np.array([features(text, s) for s in spans], np.float64)))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates that overlap neither base spans nor better ones."""
        free = _Free(base)
        found = [s for s in candidates(text) if free.has(s)] if _MAY.search(text) else []
        p = self.probabilities(text, found)
        order = sorted((-q, s) for q, s in zip(p.tolist(), found) if q >= self.thresholds[s.kind])
        return sorted(s for _, s in order if free.take(s))


_MAY = re.compile(r"[0-9@]|\b[Dd][Oo][Tt]\b")


class _Free:
    """Which spans overlap none of those taken; they are kept by blocks of characters."""

    BLOCK = 64

    def __init__(self, taken: list[Span]):
        self.blocks: dict[int, list[Span]] = {}
        for s in taken:
            self._put(s)

    def _put(self, s: Span) -> None:
        for b in range(s.start // self.BLOCK, (s.end - 1) // self.BLOCK + 1):
            self.blocks.setdefault(b, []).append(s)

    def has(self, s: Span) -> bool:
        return not any(s.start < t.end and t.start < s.end for b in range(s.start // self.BLOCK, (s.end - 1) // self.BLOCK + 1)
                       for t in self.blocks.get(b, ()))

    def take(self, s: Span) -> bool:
        free = self.has(s)
        if free:
            self._put(s)
        return free


def examples(seeds: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of the candidates of labelled texts; those that a base span settles are left out."""
    from featloom.llm.labelled_texts import labelled_text
    x, y, kinds = [], [], []
    for seed in seeds:
        text, truth = labelled_text(seed)
        free = _Free(base_spans(text))
        for s in candidates(text):
            if free.has(s):
                x.append(features(text, s))
                y.append((KINDS[s.kind], s.start, s.end) in truth)
                kinds.append(s.kind)
    return np.array(x, np.float64), np.array(y, np.float64), np.array(kinds)


@functools.lru_cache(maxsize=1)
def detector(fit_texts: int = FIT_TEXTS, held_out: int = HELD_OUT_TEXTS, precision: float = PRECISION) -> Detector:
    x, y, _ = examples(range(fit_texts))
    model = boosting.fit(x, y)
    x, y, kinds = examples(range(fit_texts, fit_texts + held_out))
    margin = model.margin(x)
    calibration = boosting.calibrate(margin, y)
    p = calibration.probability(margin)
    return Detector(model, calibration, tuple(max(0.5, boosting.threshold_for(p[kinds == k], y[kinds == k], precision))
                                              for k in range(len(KINDS))))


# ---- operators

def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def _found(docs: DataFrame, id_col: str, text_col: str, row, schema: str) -> DataFrame:
    """One row for each document: row(doc_id, text, base spans, all spans)."""
    sent = docs.sparkSession.sparkContext.broadcast(detector())
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [c.split()[0] for c in schema.split(", ")]
    empty = texts.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out = []
            for id_, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                text = text or ""
                base = base_spans(text)
                out.append(row(id_, text, base, sorted(base + known.added(text, base))))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
    return small_batches(texts).mapInArrow(run, schema)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end) of every document."""
    def row(id_, text, base, found):
        return id_, [{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in found]
    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return _found(docs, id_col, text_col, row, schema)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: every document with its spans replaced by their kinds; overlapping spans give one mark."""
    def row(id_, text, base, found):
        out, at = [], 0
        for s in found:
            if s.start >= at:
                out += [text[at:s.start], f"<{KINDS[s.kind].upper()}>"]
            at = max(at, s.end)
        return id_, "".join(out) + text[at:]
    return _found(docs, id_col, text_col, row, "doc_id bigint, text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans as text), n_added."""
    def row(id_, text, base, found):
        counts = [sum(s.kind == k for s in base) for k in range(len(KINDS))]
        return (id_, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found) - len(base))
    return _found(docs, "doc_id", "text", row, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                  "base_sha256 string, spans string, n_added bigint")
