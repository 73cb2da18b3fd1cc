"""Many literal patterns at once: an Aho-Corasick automaton over bytes, stepped through many texts together.

The automaton is a dense table (state, class of byte) -> state, made level by level. Texts are cut into segments that
overlap by the longest pattern, and all segments of a batch take their next byte in the same numpy step, so the work per
byte doesn't depend on how many patterns there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.session import prepare_workers

#: Bytes of text that one step of a segment's own covers.
SEGMENT = 1024


class Automaton:
    """Patterns (byte strings, numbered in order; empty ones match nothing) as an automaton."""

    def __init__(self, patterns: Sequence[bytes]) -> None:
        self.longest = max(map(len, patterns), default=0)
        used = np.unique(np.frombuffer(b"".join(patterns), np.uint8))
        self.classes = np.zeros(256, np.uint8 if len(used) < 256 else np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        for number, pattern in enumerate(patterns):
            state = 0
            for byte in pattern:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                state = children[state][byte]
            if pattern:
                ends.setdefault(state, []).append(number)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        fail = np.zeros(len(children), np.int32)
        outputs: list[tuple[int, ...]] = [()] * len(children)
        level = [0]
        while level:
            below = []
            for state in level:
                link = fail[state]
                outputs[state] = tuple(ends.get(state, ())) + (outputs[link] if state else ())
                if state:
                    self.next[state] = self.next[link]
                for byte, child in children[state].items():
                    c = self.classes[byte]
                    fail[child] = self.next[link, c] if state else 0
                    self.next[state, c] = child
                    below.append(child)
            level = below
        self.found = np.array([len(x) > 0 for x in outputs])
        self.count = np.array([len(x) for x in outputs], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.numbers = np.array([n for x in outputs for n in x], np.int64)

    def states(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, state) of each place at which a pattern ends, once for each text and state."""
        lengths = np.diff(offsets)
        parts = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[:-1][text] + np.maximum(nth * SEGMENT - max(0, self.longest - 1), 0)
        end = np.minimum(offsets[:-1][text] + (nth + 1) * SEGMENT, offsets[1:][text])
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those which still run come first
        text, begin, size = text[order], begin[order], (end - begin)[order]
        classes = self.classes[data]
        state = np.zeros(len(text), np.int32)
        running, seen = len(text), []
        for i in range(int(size[0]) if len(size) else 0):
            while running and size[running - 1] <= i:
                running -= 1
            state[:running] = self.next[state[:running], classes[begin[:running] + i]]
            hit = np.flatnonzero(self.found[state[:running]])
            if len(hit):
                seen.append(text[hit] * len(self.found) + state[hit])
                if len(seen) % 256 == 0:
                    seen = [np.unique(np.concatenate(seen))]
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.divmod(np.unique(np.concatenate(seen)), len(self.found))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern), each pair once, ordered."""
        text, state = self.states(data, offsets)
        count = self.count[state]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[state], count)
        pairs = np.unique(np.repeat(text, count) * max(1, int(self.numbers.max(initial=0)) + 1) + self.numbers[at])
        return np.divmod(pairs, max(1, int(self.numbers.max(initial=0)) + 1))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, nulls empty, and where each begins."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


_BUILT: dict[tuple[bytes, ...], Automaton] = {}


def automaton(patterns: tuple[bytes, ...]) -> Automaton:
    """Built once in a worker, as long as the patterns are the same."""
    if patterns not in _BUILT:
        _BUILT.clear()
        _BUILT[patterns] = Automaton(patterns)
    return _BUILT[patterns]


def needles_in(text: Column, needles: Iterable[str]) -> Column:
    """The places in `needles` of those that a text holds, ascending (case counts; empty ones aren't held); null of a null text.

    The plan is the same for any number of needles.
    """
    prepare_workers(SparkSession.active())
    patterns = tuple(n.encode() for n in needles)

    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        data, offsets = text_bytes(values)
        text, number = automaton(patterns).matches(data, offsets)
        bounds = np.searchsorted(text, np.arange(len(values) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(number.astype(np.int32)), mask=values.is_null())

    return run(text)
