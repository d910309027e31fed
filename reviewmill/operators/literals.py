"""What a pattern can't do without: literals of which any match holds one. They tell which patterns a text needs to meet."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

#: A literal of so many characters is as good as any longer one. A set of more alternatives than this counts as none.
LONG_ENOUGH, MOST_ALTERNATIVES = 6, 64
#: A literal that can be farther behind the start of a match than this has no bound.
FAR = 64


@cache
def _folds() -> dict[int, str]:
    """Characters that stand for others without regard to case: what lower-casing and case folding say, where it is one character."""
    out = {0x130: "i", 0x131: "i"}  # İ and ı match i
    for c in range(0x80, 0x20000):
        one = chr(c).casefold()
        if len(one) == 1 and one != chr(c):
            out[c] = one
    return out | {c: chr(c + 32) for c in range(0x41, 0x5B)}


@cache
def _unsure() -> set[str]:
    """Characters whose folded form is longer: what they match isn't told by _folds()."""
    return {chr(c) for c in range(0x80, 0x20000) if len(chr(c).casefold()) > 1 and c != 0x130} | {"ͅ", "ΐ", "ΰ", "ΐ", "ΰ", "ﬅ", "ﬆ"}


def fold(text: str) -> str:
    """The text as literals are compared with it, character by character."""
    return text.lower() if text.isascii() else text.translate(_folds())


#: A literal, and how far behind the start of a match it can begin at most (None: no bound).
Literals = dict[str, int | None]


def _plus(a: int | None, b: int | None) -> int | None:
    return None if a is None or b is None or a + b > FAR else a + b


def _better(a: Literals | None, b: Literals | None) -> Literals | None:
    """Of two sets, the one whose shortest literal is longer, then one of bounded places, then the smaller one."""
    rank = lambda x: (min(LONG_ENOUGH, min(map(len, x))), None not in x.values(), -len(x))
    some = [x for x in (a, b) if x and "" not in x and len(x) <= MOST_ALTERNATIVES]
    return max(some, key=rank, default=None)


class _Walk:
    """Goes through a parsed pattern from left to right: the literal that is growing, and the best set so far.

    at: how many characters a match can have up to here; start: up to the literal.
    """

    def __init__(self, at: int | None = 0) -> None:
        self.run, self.start, self.at = "", at, at
        self.best: Literals | None = None

    def cut(self) -> None:
        """What comes next isn't known: the literal ends."""
        self.best = _better(self.best, {self.run: self.start} if self.run else None)
        self.run = ""

    def grow(self, text: str) -> None:
        if not self.run:
            self.start = self.at
        self.run += text
        self.at = _plus(self.at, len(text))

    def over(self, items: Iterable[tuple]) -> _Walk:
        for kind, value in items:
            name = str(kind)
            if name in ("SUBPATTERN", "ATOMIC_GROUP"):
                self.over(value[3] if name == "SUBPATTERN" else value)
            elif name == "LITERAL" and (char := fold(chr(value))) not in _unsure():
                self.grow(char)
            elif name == "BRANCH":
                self.cut()
                each = [required_of(x, self.at) for x in value[1]]
                self.best = _better(self.best, _united(each) if all(each) else None)
                self.at = _plus(self.at, width([(kind, value)]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, inner = value
                if least and (text := plain(inner)):
                    self.grow(text)
                    if most > 1:  # what follows comes after the last copy
                        self.cut()
                        self.at = _plus(self.at, FAR + 1 if most * len(text) > FAR else (most - 2) * len(text))
                        self.grow(text)
                else:
                    self.cut()
                    self.best = _better(self.best, required_of(inner, self.at) if least else None)
                    self.at = _plus(self.at, width([(kind, value)]))
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):  # those take no characters
                self.cut()
                self.at = _plus(self.at, width([(kind, value)]))
        return self


def _united(each: list[Literals]) -> Literals:
    out: Literals = {}
    for found in each:
        for literal, far in found.items():
            out[literal] = far if literal not in out else None if far is None or out[literal] is None else max(far, out[literal])
    return out


def width(items: Iterable[tuple]) -> int | None:
    """The most characters that the items match; None: no bound, or beyond FAR."""
    out: int | None = 0
    for kind, value in items:
        name = str(kind)
        if name == "SUBPATTERN":
            one = width(value[3])
        elif name == "ATOMIC_GROUP":
            one = width(value)
        elif name == "BRANCH":
            each = [width(x) for x in value[1]]
            one = None if None in each else max(each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = width(value[2])
            one = 0 if inner == 0 else None if inner is None or value[1] > FAR else inner * value[1]
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            one = 0
        else:
            one = 1 if name in ("LITERAL", "NOT_LITERAL", "ANY", "IN") else None
        out = _plus(out, one)
    return out


def plain(items: Iterable[tuple]) -> str | None:
    """The text that is all that the items match, case aside."""
    out = ""
    for kind, value in items:
        if str(kind) == "SUBPATTERN" and (inner := plain(value[3])):
            out += inner
        elif str(kind) == "LITERAL" and fold(chr(value)) not in _unsure():
            out += fold(chr(value))
        else:
            return None
    return out


def required_of(items: Iterable[tuple], at: int | None = 0) -> Literals | None:
    walk = _Walk(at).over(items)
    walk.cut()
    return walk.best


def required(pattern: str) -> Literals | None:
    """Folded literals of which each match of a pattern, case aside, holds one; None where there is no such set."""
    try:
        from re import _parser as parser
    except ImportError:
        return None
    return required_of(parser.parse(pattern, re.IGNORECASE))


class PatternIndex:
    """Patterns with one automaton of their literals: search() tries each where its literals are, and nowhere else.

    A pattern without a literal, or of whose literal it isn't known how far behind a match's start it is, goes over the text.
    """

    def __init__(self, patterns: list[str]):
        self.compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
        self.always: list[int] = []
        by_literal: dict[str, list[tuple[int, int | None]]] = {}
        for i, p in enumerate(patterns):
            found = required(p)
            if found is None:
                self.always.append(i)
            for literal, far in (found or {}).items():
                by_literal.setdefault(literal, []).append((i, far))
        self.automaton = None
        if by_literal:
            try:
                import ahocorasick
            except ImportError:
                self.always = list(range(len(patterns)))
                return
            self.automaton = ahocorasick.Automaton()
            for literal, uses in by_literal.items():
                self.automaton.add_word(literal, (len(literal), uses))
            self.automaton.make_automaton()

    def possible(self, text: str) -> dict[int, list[tuple[int, int]] | None]:
        """Patterns that the text can match, with the ranges in which a match begins (None: anywhere)."""
        found: dict[int, list[tuple[int, int]] | None] = dict.fromkeys(self.always)
        if self.automaton is not None:
            for end, (size, uses) in self.automaton.iter(fold(text)):
                at = end + 1 - size
                for i, far in uses:
                    if far is None:
                        found[i] = None
                    elif (ranges := found.setdefault(i, [])) is not None:
                        ranges.append((max(0, at - far), at))
        return found

    def search(self, text: str) -> list[tuple[int, re.Match]]:
        """Number and first match of every pattern that is in the text, by number."""
        out = []
        for i, ranges in sorted(self.possible(text).items()):
            pattern = self.compiled[i]
            if ranges is None or sum(hi - lo + 1 for lo, hi in ranges) > len(text) // 4:
                m = pattern.search(text)
            else:
                starts = sorted({at for lo, hi in ranges for at in range(lo, hi + 1)})
                m = next((m for at in starts if (m := pattern.match(text, at))), None)
            if m:
                out.append((i, m))
        return out
