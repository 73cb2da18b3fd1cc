"""Many selectors answered in one pass over a page's tokens, without a tree.

All selectors of a query are one automaton. A state is a compound of a selector with those before it matched; sets of states are the
bits of a number. The stack holds, for each open element, the states that its descendants and its children may match: opening an
element pushes, closing pops. Which states an element matches is looked up by its tag, classes and id, then tested on what is left.
A selector of scopes starts the automaton of the fields anew below each element that it matches.

The elements, their order and values are those of html_tree.select() and html_tree.value_of(), and so is the syntax. The work is
linear in the page for a given set of selectors, times the depth to which scopes stand inside each other. A selector that can't be
read raises ValueError when it is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

from pagewright.functions.html_tree import _SIMPLE, _TESTS, BLOCKS, CLOSES, VOID

_TOKENS = re.compile(r"(?:\[[^\]]*\]|[^\s>\[])+|>")
#: Elements that an implied end of another one doesn't reach beyond.
_STOPS = BLOCKS - {"p"} | {"select", "body"}
_NONE: frozenset = frozenset()


class Found(NamedTuple):
    """An element that a selector matched: which one, its attributes and its value."""

    selector: int
    attrs: dict[str, str]
    value: str


class Automaton:
    """Selectors, each with alternatives behind commas, compiled together."""

    def __init__(self, selectors: Sequence[str]) -> None:
        self.start = self.untagged = self.unclassed = self.unnamed = self.tested = 0
        self.tags: dict[str, int] = {}
        self.classes: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        #: state -> further tests, the states behind it below and right below, and the selector that ends there
        self.rest: list[tuple[list[str], list[tuple]]] = []
        self.below: list[int] = []
        self.right_below: list[int] = []
        self.ends: list[int | None] = []
        self.size = len(selectors)
        for number, selector in enumerate(selectors):
            for one in selector.split(","):
                self._chain(number, one)

    def _chain(self, number: int, text: str) -> None:
        child, before = False, None
        for token in _TOKENS.findall(text):
            if token == ">":
                child = True
                continue
            bit = 1 << len(self.rest)
            if before is None:
                self.start |= bit
            else:
                (self.right_below if child else self.below)[before] |= bit
            before, child = len(self.rest), False
            self._state(token, bit)
        if before is not None:
            self.ends[before] = number

    def _state(self, compound: str, bit: int) -> None:
        end, tags, classes, ids, attrs = 0, set(), set(), set(), []
        for m in _SIMPLE.finditer(compound):
            if m.start() != end:
                break
            end = m.end()
            tag, cls, ident, attr, test, value = m.groups()
            if tag and tag != "*":
                tags.add(tag.lower())
            elif cls:
                classes.add(cls)
            elif ident:
                ids.add(ident)
            elif attr:
                attrs.append((attr, _TESTS[test] if test else None, value.strip("\"'") if test else None))
        if end != len(compound) or not end:
            raise ValueError(f"not a selector: {compound}")
        for needed, by, without in ((tags, self.tags, "untagged"), (classes, self.classes, "unclassed"), (ids, self.ids, "unnamed")):
            if not needed:
                setattr(self, without, getattr(self, without) | bit)
            elif len(needed) == 1 or by is self.classes:
                least = min(needed)
                by[least] = by.get(least, 0) | bit
            # two tags or two ids: no element has both
        if len(classes) > 1 or attrs:
            self.tested |= bit
        self.rest.append((sorted(classes), attrs))
        self.below.append(0)
        self.right_below.append(0)
        self.ends.append(None)

    def step(self, states: int, tag: str, attrs: dict[str, str], classes: Sequence[str]) -> tuple[int, int, list[int]]:
        """States that an element may match -> those behind the ones it does, below and right below it, and the selectors it ends."""
        states &= self.tags.get(tag, 0) | self.untagged
        if not states:
            return 0, 0, []
        named = self.unclassed
        for c in classes:
            named |= self.classes.get(c, 0)
        states &= named & (self.ids.get(attrs.get("id"), 0) | self.unnamed)
        below = right_below = 0
        ended = set()
        while states:
            bit = states & -states
            states ^= bit
            i = bit.bit_length() - 1
            if bit & self.tested and not self._holds(i, attrs, classes):
                continue
            below |= self.below[i]
            right_below |= self.right_below[i]
            if self.ends[i] is not None:
                ended.add(self.ends[i])
        return below, right_below, sorted(ended)

    def _holds(self, i: int, attrs: dict[str, str], classes: Sequence[str]) -> bool:
        needed, tests = self.rest[i]
        return all(c in classes for c in needed) and all(a in attrs and (test is None or test(attrs[a], value)) for a, test, value in tests)


@lru_cache(maxsize=256)
def automaton(selectors: tuple[str, ...]) -> Automaton:
    return Automaton(selectors)


class Query:
    """What to look for: fields below each scope, or below the page where there are no scopes or (fallback) none is found.

    every: all elements that match a field, not the first only. raw: text as it stands, that of scripts too, and no content attribute.
    """

    def __init__(self, fields: Sequence[str], scopes: Sequence[str] = (), every: bool = False, raw: bool = False, fallback: bool = True) -> None:
        self.fields, self.scopes = automaton(tuple(fields)), automaton(tuple(scopes))
        self.every, self.raw, self.fallback = every, raw, fallback or not scopes


@dataclass(eq=False)
class _Run:
    """An automaton below one element: what it has found, or the runs of the scopes that it has."""

    query: Query
    of_scopes: bool = False
    hits: list = field(default_factory=list)
    seen: set[int] = field(default_factory=set)

    @property
    def automaton(self) -> Automaton:
        return self.query.scopes if self.of_scopes else self.query.fields

    @property
    def done(self) -> bool:
        return not self.of_scopes and not self.query.every and len(self.seen) == self.automaton.size


class _Pass(HTMLParser):
    """The tokens of a page; elements open and close as in html_tree."""

    def __init__(self, queries: Sequence[Query]) -> None:
        super().__init__(convert_charrefs=True)
        self.roots = [(_Run(q, True) if q.scopes.size else None, _Run(q) if q.fallback else None) for q in queries]
        self.tags = [""]
        self.active: list[list[tuple[_Run, int, int]]] = [[(r, r.automaton.start, 0) for pair in self.roots for r in pair if r]]
        #: tag -> where it is open; where stops and scripts or styles are
        self.open: dict[str, list[int]] = {}
        self.stops: list[int] = [0]
        self.hidden: list[int] = []
        #: (depth, parts, raw) of the elements whose text is being read
        self.read: list[tuple[int, list[str], bool]] = []

    def _opened(self, tag: str, attrs: list, leaf: bool) -> None:
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        depth, active = len(self.tags), []
        for run, below, right_below in self.active[-1]:
            if run.done:
                continue
            more, children, ended = run.automaton.step(below | right_below, tag, given, classes)
            active.append((run, below | more, children))
            for number in ended:
                if run.of_scopes:
                    inner = _Run(run.query)
                    run.hits.append((number, len(run.hits), inner))
                    active.append((inner, inner.automaton.start, 0))
                elif run.query.every or number not in run.seen:
                    run.seen.add(number)
                    parts: list[str] = []
                    run.hits.append((number, given, parts))
                    if not run.query.raw and given.get("content"):
                        parts.append(given["content"])
                    elif not leaf:
                        self.read.append((depth, parts, run.query.raw))
        if leaf:
            return
        self.tags.append(tag)
        self.active.append(active)
        self.open.setdefault(tag, []).append(depth)
        if tag in _STOPS:
            self.stops.append(depth)
        if tag in ("script", "style"):
            self.hidden.append(depth)

    def _closed(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.tags) > depth:
            self.open[self.tags.pop()].pop()
            self.active.pop()
        for depths in (self.stops, self.hidden):
            while depths and depths[-1] >= depth:
                depths.pop()
        while self.read and self.read[-1][0] >= depth:
            self.read.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        gone = CLOSES.get(tag, _NONE)
        last = max((self.open[t][-1] for t in ({*gone, "p"} if tag in BLOCKS else gone) if self.open.get(t)), default=0)
        if last > self.stops[-1]:
            self._closed(last)
        self._opened(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._opened(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self._closed(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        for depth, parts, raw in self.read:
            if raw:
                parts.append(data)
            elif not self.hidden or self.hidden[-1] <= depth:
                parts.append(data.strip())

    def answers(self) -> Iterator[list[list[Found]]]:
        shown = lambda run: [Found(number, attrs, "".join(parts)) for number, attrs, parts in run.hits]
        for scopes, page in self.roots:
            inner = [shown(run) for _, _, run in sorted(scopes.hits, key=lambda x: x[:2])] if scopes else []
            yield inner if inner or page is None else [shown(page)]


def answers(html: str | None, queries: Mapping[str, Query]) -> dict[str, list[list[Found]]]:
    """Each query's scopes, by selector and then in the page's order, each with what was found below it in the page's order."""
    one = _Pass(list(queries.values()))
    one.feed(html or "")
    one.close()
    return dict(zip(queries, one.answers(), strict=True))
