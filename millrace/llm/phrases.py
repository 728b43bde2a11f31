"""Phrases of texts: words cut where their content says, so that equal passages are cut alike in every document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from millrace.llm.hashing import GOLDEN, INVERSE, INVERSES, PIECE, POWERS, mix, word_pieces

#: Words of the grams whose smallest hash names a phrase.
GRAM = 8


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, letters as they are, and the number of words of each text."""
    edges = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(raw), np.int64)
    for some, starts, _ in word_pieces(raw):
        hashes.append(some)
        own = np.searchsorted(edges, starts, side="right")
        if len(own):
            counts[own[0] : own[-1] + 1] += np.bincount(own - own[0])
    return np.concatenate(hashes), counts


@dataclass
class Windows:
    """All windows of some texts, by text and first word: ``texts``, ``starts``; ``anchors`` name the phrase that a window
    belongs to, ``hashes`` its words; ``heads`` are where phrases begin, ``phrases`` their hashes."""

    texts: np.ndarray
    starts: np.ndarray
    anchors: np.ndarray
    hashes: np.ndarray
    heads: np.ndarray
    phrases: np.ndarray


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[Windows]:
    """The windows of ``width`` words of texts, given the hashes of their words, some ten thousand at a time.

    A window's anchor is the smallest hash of its grams, so equal windows have equal anchors. Windows in a row with one
    anchor are a phrase. Long texts are cut at the same places, counted from their start, whatever stands beside them.
    """
    gram = min(GRAM, width)
    most = PIECE // 2
    first = np.cumsum(counts) - counts
    todo, held = [], 0
    for text in np.flatnonzero(counts >= width).tolist():
        n = int(counts[text]) - width + 1
        for at in range(0, n, most):
            m = min(most, n - at)
            if todo and held + m + width > PIECE:
                yield block(hashes, first, todo, width, gram)
                todo, held = [], 0
            todo.append((text, at, m))
            held += m + width - 1
    if todo:
        yield block(hashes, first, todo, width, gram)


def block(hashes: np.ndarray, first: np.ndarray, todo: list[tuple[int, int, int]], width: int, gram: int) -> Windows:
    """``todo``: text, first window, number of windows."""
    texts, ats, sizes = (np.array(c, np.int64) for c in zip(*todo))
    x = np.concatenate([hashes[first[t] + a : first[t] + a + m + width - 1] for t, a, m in todo])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * POWERS[: len(x)])])

    def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * INVERSES[starts] + (ends - starts).astype(np.uint64) * GOLDEN)

    every = np.arange(len(x) - gram + 1)
    low = spans(every, every + gram)
    span, reach = 1, width - gram + 1  # the least of ``reach`` grams, from runs of doubled length
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    lead = np.cumsum(sizes + width - 1) - (sizes + width - 1)
    own = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = lead[own] + local
    anchors = low[at]
    heads = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (local[1:] == 0)]))
    lasts = np.append(heads[1:], len(own)) - 1
    return Windows(texts[own], ats[own] + local, anchors, mix(spans(at, at + width) ^ GOLDEN), heads, spans(at[heads], at[lasts] + width))
