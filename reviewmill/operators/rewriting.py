"""Phrase maps of any size: an ordered rewriting of texts by one automaton, local to a row."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..sources.session import ship

#: (source, target, whole word?), as phrase_steps() makes them: in order of use.
Step = tuple[str, str, bool]


class Rewriter:
    """Replaces phrases step after step, each in what the steps before it have left, as clean_text() does.

    The automaton tells which steps' sources a text holds. Only those are run, in their order; where one has written
    its target, a window about the place is searched again, since the target and its neighbours can make the source of
    a later step. So a text costs one pass, and a replacement for each step that it has a use for, however large the map is.
    """

    def __init__(self, steps: list[Step]):
        self.steps = steps
        self.ranks: dict[str, list[int]] = {}
        for i, (source, _, _) in enumerate(steps):
            self.ranks.setdefault(source, []).append(i)
        self.reach = max(map(len, self.ranks), default=1) - 1
        self.whole: dict[int, re.Pattern] = {}
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for source, ranks in self.ranks.items():
                self.automaton.add_word(source, ranks)
            if self.ranks:
                self.automaton.make_automaton()
        except ImportError:
            self.automaton = None

    def uses(self, text: str, after: int = -1) -> set[int]:
        """Steps after a given one whose sources are in the text."""
        if not self.ranks:
            return set()
        found = (r for _, r in self.automaton.iter(text)) if self.automaton is not None else (r for s, r in self.ranks.items() if s in text)
        return {i for ranks in found for i in ranks if i > after}

    def places(self, i: int, text: str) -> list[int]:
        """Where step i replaces: from left to right, none inside another."""
        source, _, whole = self.steps[i]
        if whole:
            if i not in self.whole:
                self.whole[i] = re.compile(rf"(?<!\w){re.escape(source)}(?!\w)")
            return [m.start() for m in self.whole[i].finditer(text)]
        out, at = [], text.find(source)
        while at >= 0:
            out.append(at)
            at = text.find(source, at + len(source))
        return out

    def rewrite(self, text: str) -> str:
        waiting = sorted(self.uses(text))
        known = set(waiting)
        while waiting:
            i = heapq.heappop(waiting)
            places = self.places(i, text)
            if not places:
                continue
            source, target, _ = self.steps[i]
            parts, ends, last, size = [], [], 0, 0
            for at in places:
                size += at - last
                parts += [text[last:at], target]
                ends.append((size, size + len(target)))
                size += len(target)
                last = at + len(source)
            text = "".join([*parts, text[last:]])
            for lo, hi in self.windows(ends):
                for new in self.uses(text[lo:hi], i) - known:
                    known.add(new)
                    heapq.heappush(waiting, new)
        return text

    def windows(self, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """The spans with as much about them as a source can reach, those that meet in one."""
        first, last = None, None
        for lo, hi in spans:
            lo, hi = max(0, lo - self.reach), hi + self.reach
            if first is not None and lo <= last:
                last = max(last, hi)
                continue
            if first is not None:
                yield first, last
            first, last = lo, hi
        if first is not None:
            yield first, last


def rewritten(text: Column, steps: list[Step]) -> Column:
    """Rewriter on a column of lower-cased texts, in Arrow batches; the automaton is built once a task. Null stays null."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rewriter = Rewriter(steps)
        for texts in batches:
            yield pa.array([None if x is None else rewriter.rewrite(x) for x in texts.to_pylist()], pa.string())

    return of(text)


#: Steps up to which expressions do it: beyond, generated code grows too long to be compiled.
FEW_STEPS = 30


def with_clean_text(df: DataFrame, text: Column, out: str, steps: list[Step] = (), prefix: str | None = None) -> DataFrame:
    """Adds clean_text() of a text for a phrase map of any size: lower case, phrases, prefix, white space."""
    if len(steps) <= FEW_STEPS:
        return df.withColumn(out, clean_text(text, steps, prefix))
    ship(df.sparkSession)
    lower = F.lower(F.coalesce(text, F.lit("")))
    return df.withColumn(out, clean_text(rewritten(lower, list(steps)), (), prefix))
