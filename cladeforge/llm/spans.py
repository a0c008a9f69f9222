"""Spans of personal data and of secrets found by fixed patterns, each in time linear in the text.

Kinds are searched apart; within a kind the leftmost match wins, matches don't overlap, and a
match that fails its test is dropped without another try at the same characters.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections.abc import Iterator

Span = tuple[str, int, int]

PII_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DIGITS = frozenset(string.digits)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")


def _anchored(text: str, anchor: re.Pattern, before: frozenset[str]) -> list[tuple[int, int]]:
    """Matches of a run of ``before`` and then the anchor. ``before`` lacks the anchor's first
    character, so the leftmost match is the whole run in front of the first anchor that has one."""
    found, end, at = [], 0, 0
    while m := anchor.search(text, at):
        start = m.start()
        while start > end and text[start - 1] in before:
            start -= 1
        if start < m.start():
            found.append((start, end := m.end()))
            at = end
        else:
            at = m.start() + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    return _anchored(text, _DOMAIN, _LOCAL) if "@" in text else []


def ips(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b in _anchored(text, _DOTTED, _DIGITS) if all(map(_small, text[a:b].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15] if "+" in text else []


def assigns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 8] if "=" in text or ":" in text else []


def accesses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]


def hexes(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def pii(text: str) -> list[Span]:
    return ordered([(k, a, b) for k, f in zip(PII_KINDS, (emails, ips, cards, phones), strict=True) for a, b in f(text)], PII_KINDS)


def secrets(text: str) -> list[Span]:
    return ordered([(k, a, b) for k, f in zip(SECRET_KINDS, (assigns, accesses, hexes), strict=True) for a, b in f(text)], SECRET_KINDS)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Cover:
    """The union of spans, to ask in logarithmic time whether a stretch of text meets it."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        last = bisect.bisect_left(self.starts, end) - 1
        return last >= 0 and self.ends[last] > start


def outside(pattern: re.Pattern, text: str, spans: list[Span]) -> Iterator[re.Match]:
    """The pattern's matches in the text that meet none of the spans."""
    meets = Cover(spans).meets
    return (m for m in pattern.finditer(text) if not meets(*m.span()))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each (replacement, start, end) put in; of overlapping spans the union goes, under
    the first one's replacement."""
    out, at = [], 0
    for new, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join([*out, text[at:]])
