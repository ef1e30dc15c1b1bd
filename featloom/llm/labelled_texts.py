"""Labelled texts with personal data and with numbers that look like it, each generated from a seed."""

from __future__ import annotations

import random
import string

from featloom.llm.personal import CUES, luhn

SYLLABLES = ("an", "be", "co", "da", "el", "fi", "go", "ha", "in", "jo", "ka", "lu", "mé", "no", "or", "pa", "re", "sa", "ti", "ü")
TOPS = ("com", "org", "net", "de", "fr", "es", "io", "edu")


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(r.choice(string.digits) for _ in range(n - 1))


def _checked(r: random.Random, n: int, valid: bool) -> str:
    """A number of n digits whose check digit is right, or wrong."""
    first = r.choice("3456") + "".join(r.choice(string.digits) for _ in range(n - 2))
    ends = [d for d in string.digits if luhn(first + d) == valid]
    return first + r.choice(ends)


def _grouped(digits: str, sizes: list[int], between: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at:at + n])
        at += n
    return between.join([*out, digits[at:]] if at < len(digits) else out)


def _email(r: random.Random) -> str:
    name = _word(r) + r.choice(("", f".{_word(r)}", str(r.randint(1, 99)), f"_{_word(r)}"))
    host = _word(r).replace("ü", "u").replace("é", "e")
    at = r.choice((" at ", " [at] ", "[at]", " (at) ", "(at)", "{at}", " @ ", "@", " AT "))
    dot = r.choice((" dot ", " [dot] ", "[dot]", "(dot)", " DOT ", "[.]", "."))
    if at == " at " and dot == ".":
        dot = " dot "
    if at == "@" and dot == ".":
        name += "é"  # else a base pattern finds it all
        return f"{name}@{host}é.{r.choice(TOPS)}"
    return f"{name}{at}{host}{dot}{r.choice(TOPS)}"


def _ip(r: random.Random) -> str:
    if r.random() < 0.5:
        return r.choice(("[.]", "(.)", "[dot]", " [.] ")).join(str(r.randint(0, 255)) for _ in range(4))
    parts = [f"{r.randint(0, 0xFFFF):x}" for _ in range(8)]
    if r.random() < 0.5:
        return ":".join(parts)
    return ":".join(parts[:r.randint(1, 4)]) + "::" + ":".join(parts[5:5 + r.randint(1, 3)])


def _card(r: random.Random) -> str:
    if r.random() < 0.25:
        return _checked(r, 13, True)
    return _grouped(_checked(r, 16, True), [4, 4, 4], r.choice((".", "/", "  ", " - ", " ", "–", "·")))


def _phone(r: random.Random) -> str:
    area, a, b = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"0{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 4)}",
                     f"00{_digits(r, 2)} {area} {_digits(r, 7)}", f"+{r.randint(1, 99)}/{area}/{_digits(r, 7)}",
                     f"0{_digits(r, 3)}/{_digits(r, 6)}", f"{area} {a} {b}"))


def _decoy(r: random.Random) -> tuple[int, str]:
    """(the cue that fits, 4 for none of the kinds; text)"""
    y, m, d = r.randint(1900, 2040), r.randint(1, 12), r.randint(1, 28)
    n = r.randint(0, 17)
    return (
        (4, f"{y}-{m:02}-{d:02}"), (4, f"{d:02}.{m:02}.{y}"), (4, f"{d:02}/{m:02}/{y}"), (4, f"{r.randint(1700, 2000)}-{r.randint(1700, 2030)}"),
        (2, _checked(r, 16, False)), (2, _checked(r, r.randint(13, 19), False)), (4, _checked(r, 13, r.random() < 0.3)),
        (2, _grouped(_checked(r, 16, False), [4, 4, 4], r.choice((".", "/", "–", "  ", " ")))),
        (4, _digits(r, r.randint(7, 12))), (4, f"978{_digits(r, 10)}"), (4, "".join(r.choice("0123456789abcdef") for _ in range(40))),
        (4, f'"{"".join(r.choice("0123456789abcdef") for _ in range(32))}"'), (4, f"{r.randint(0, 23):02}:{m:02}:{d:02}"),
        (4, ".".join(_digits(r, r.randint(1, 3)) for _ in range(r.choice((2, 3, 5, 6))))), (4, f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)},00"),
        (4, " ".join(_digits(r, r.randint(1, 5)) for _ in range(r.randint(4, 9)))),
        (0, f"{_word(r)} at {_word(r)} {_word(r)}. {_word(r)} dot {_word(r)}"), (0, f"{_word(r)} at {_word(r)}.{_word(r)}"),
    )[n]


def labelled_text(seed: int) -> tuple[str, set[tuple[str, int, int]]]:
    """A text, and the (kind, start, end) of its personal data."""
    r = random.Random(f"personal {seed}")
    text, truth = "", set()

    def filler(n):
        return " ".join(_word(r) for _ in range(n)) + r.choice((" ", " ", ". ", ".\n", ", ", "\n"))

    def cue(kind):
        word = r.choice(CUES[kind])
        return (word.capitalize() if r.random() < 0.3 else word) + r.choice((" ", ": ", " is ", ". ", " " + _word(r) + " "))

    for _ in range(r.randint(1, 3)):
        text += filler(r.randint(2, 12))
        kind = r.randint(0, 7)
        if kind < 4:
            value = (_email, _ip, _card, _phone)[kind](r)
            if r.random() < (0.9 if kind == 3 else 0.6):
                text += cue(kind)
            truth.add((("email", "ip", "card", "phone")[kind], len(text), len(text) + len(value)))
        elif kind == 4:
            # numbers side by side, which the base patterns take for one
            first, second = (_checked(r, 16, True) for _ in range(2))
            truth |= {("card", len(text), len(text) + 16), ("card", len(text) + 17, len(text) + 33)}
            value = f"{first} {second}"
            if r.random() < 0.5:
                phone = f"+1 ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}"
                truth -= {("card", len(text), len(text) + 16), ("card", len(text) + 17, len(text) + 33)}
                truth |= {("phone", len(text), len(text) + len(phone)), ("card", len(text) + len(phone) + 1, len(text) + len(phone) + 17)}
                value = f"{phone} {first}"
        else:
            fits, value = _decoy(r)
            if r.random() < 0.4:
                text += cue(4 if r.random() < 0.7 else fits)
        text += value
        text += r.choice((" ", " ", ". ", "\n", ", ", ") ", "*** "))
    return text + filler(r.randint(1, 6)), truth
