"""Hashes of the words and word n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 2**64)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that part words: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes that part words: every ASCII character but letters and digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUES = mix(np.arange(256, dtype=np.uint64) + GOLDEN)
#: Bytes hashed at once; the table of powers is of this length, whatever the texts.
PIECE = 1 << 18


def powers(base: int) -> np.ndarray:
    p = np.full(PIECE + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


POWERS, INVERSES = powers(BASE), powers(INVERSE)


@dataclass
class Words:
    """Of each word: its hash, the bytes of its text where it starts and ends, and its text; of each text: how many."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    texts: np.ndarray
    counts: np.ndarray


def plain_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def word_pieces(raw: list[bytes], parting: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, first bytes and ends of the words of all texts as if joined by one blank each, PIECE bytes at a time.

    A word's hash follows from differences of a running sum over the piece's bytes. A word that crosses a border
    carries its sum and length on, so a piece needs the same memory whatever a text's or a word's length.
    """
    at, carried, length = 0, 0, 0  # bytes before the piece; sum and length of the word that is open where it begins
    top = (1 << 64) - 1
    for text in grouped(raw):
        for cut in range(0, len(text), PIECE):
            codes = np.frombuffer(text, np.uint8, min(PIECE, len(text) - cut), cut)
            part = parting[codes]
            before = np.concatenate([[length == 0], part[:-1]])
            starts, ends = np.flatnonzero(~part & before), np.flatnonzero(part & ~before)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[codes] * POWERS[: len(codes)])])
            hashes, firsts, lasts = [], [], ends + at
            if length:
                end = int(ends[0]) if len(ends) else len(codes)
                carried = (carried + int(total[end]) * pow(BASE, length, 1 << 64)) & top
                length += end
                if len(ends):
                    hashes.append(np.array([(carried + length * int(GOLDEN)) & top], np.uint64))
                    firsts.append(np.array([at + end - length]))
                    ends, carried, length = ends[1:], 0, 0
            some = starts[: len(ends)]
            hashes.append((total[ends] - total[some]) * INVERSES[some] + (ends - some).astype(np.uint64) * GOLDEN)
            firsts.append(some + at)
            if len(starts) > len(ends):
                open_ = int(starts[-1])
                carried = (int(total[-1]) - int(total[open_])) * int(INVERSES[open_]) & top
                length = len(codes) - open_
            yield mix(np.concatenate(hashes)), np.concatenate(firsts), lasts
            at += len(codes)


def grouped(raw: list[bytes]) -> Iterator[bytes]:
    """Short texts joined to about PIECE bytes, a blank after each text; a longer one by itself, without a copy."""
    held, size = [], 0
    for r in raw:
        if held and size + len(r) > PIECE:
            yield b" ".join(held) + b" "
            held, size = [], 0
        if len(r) > PIECE:
            yield r
            yield b" "
        else:
            held.append(r)
            size += len(r) + 1
    if held:
        yield b" ".join(held) + b" "


def hash_words(texts: list[str | None], parting: np.ndarray = SPACE) -> Words:
    """The words of each text, lower-cased in A-Z."""
    raw = [plain_bytes(t) for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.cumsum(sizes) - sizes
    found = list(word_pieces(raw, parting))
    hashes, starts, ends = (np.concatenate([f[i] for f in found]) if found else np.empty(0, (np.uint64, np.int64, np.int64)[i]) for i in range(3))
    own = np.searchsorted(first, starts, side="right") - 1
    return Words(hashes, starts - first[own], ends - first[own], own, np.bincount(own, minlength=len(raw)))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n in ``hashes``, by first word; those that cross a border are for the caller to leave out."""
    m = max(0, len(hashes) - n + 1)
    out = np.full(m, np.uint64(n))
    for j in range(n):
        out = mix(out * GOLDEN + hashes[j : j + m])
    return out


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; with fewer words the whole sequence is one; without words none."""
    raw = [plain_bytes(t) for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    edges = np.cumsum(sizes)
    hashes, counts = [], np.zeros(len(raw), np.int64)
    for some, starts, _ in word_pieces(raw):
        hashes.append(some)
        own = np.searchsorted(edges, starts, side="right")
        if len(own):
            counts[own[0] : own[-1] + 1] += np.bincount(own - own[0])
    hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    every = grams(hashes, n)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(every[at : at + count - n + 1]))
        elif count:
            out.append(grams(hashes[at : at + count], count))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out
