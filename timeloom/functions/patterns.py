"""Many literal patterns in one pass over each text: an automaton with failure links, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick


@lru_cache(4)
def automaton(patterns: tuple[str, ...]) -> ahocorasick.Automaton:
    """Compiled once in each worker; a pattern's value is its number."""
    a = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        a.add_word(p, (i, len(p)))
    a.make_automaton()
    return a


def counted(patterns: tuple[str, ...], texts: Iterable[str]) -> Iterator[dict[int, int]]:
    """For each text how often it holds each pattern that it holds, counted from the left without overlap. Patterns aren't empty."""
    if not patterns:
        yield from ({} for _ in texts)
        return
    found = automaton(patterns)
    for text in texts:
        n: dict[int, int] = {}
        free: dict[int, int] = {}  # where each pattern may begin again
        for end, (i, size) in found.iter(text):
            if end + 1 - size >= free.get(i, 0):
                n[i] = n.get(i, 0) + 1
                free[i] = end + 1
        yield n


def held(patterns: tuple[str, ...], text: str) -> set[int]:
    """Which of the patterns, by number, the text holds."""
    return {i for _, (i, _) in automaton(patterns).iter(text)} if patterns else set()
