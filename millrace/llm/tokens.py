"""Token ids of texts by a public tokenizer file, word by word with a bounded memory of words."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words kept with their ids by one Python worker, and of what a word takes besides its letters and ids.
REMEMBERED, ENTRY = 120_000_000, 200


def _kinds() -> bytes:
    """For each Latin-1 character: a letter or number, white space, a full stop or comma, other marks, or one that ``str.split`` alone takes for white space."""
    kinds = bytearray()
    for c in map(chr, range(256)):
        odd = "\x1c" <= c <= "\x1f"
        kinds += b"o" if odd else b" " if c.isspace() else b"a" if unicodedata.category(c)[0] in "LN" else b"." if c in ".," else b"p"
    return bytes(kinds)


KINDS = _kinds()
ODD = re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, exactly as the tokenizer's own.

    ``marks_as_text`` takes the strings of special tokens in a text for ordinary text; else they are these tokens.

    For tokenizers that lower-case, drop white space and keep letters, numbers and runs of other marks apart: a text's
    ids are then its words' ids in turn, and a word's ids are looked up from its last occurrence. In Latin-1 texts,
    which lower case and normalization treat letter by letter, words are also lower-cased and parted from a comma or
    full stop behind them beforehand, so fewer differ. New words of a batch are encoded in one call and told apart by
    offsets. Texts on which the two notions of white space differ, or with special tokens, go in whole. Words are kept
    in two generations of half the memory each, so the frequent ones stay.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, marks_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = marks_as_text
        #: Strings that are one id wherever they stand, also inside a word.
        self.marks = [] if marks_as_text else sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # forgotten next, unless met again
        self.held, self.remembered = 0, remembered

    def remember(self, words: list[str], ids: list[bytes]) -> None:
        self.held += sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)
        self.known.update(zip(words, ids))

    def learn(self, new: list[str]) -> None:
        for letters in (True, False):  # a word of letters alone ends where its last token does; others by offsets
            chosen = [w for w in new if w.isalpha() == letters]
            for at in range(0, len(chosen), 20_000):
                some = chosen[at : at + 20_000]
                text = " ".join(some)
                if letters:
                    ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                    cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
                if not letters or len(cuts) != len(some) + 1:
                    code = self.tokenizer.encode(text, add_special_tokens=False)
                    offsets = np.fromiter((a for a, _ in code.offsets), np.int64, len(code.ids))
                    ids = np.asarray(code.ids, "<u4")
                    cuts = (np.searchsorted(offsets, np.cumsum([0] + [len(w) + 1 for w in some])) * 4).tolist()
                packed = ids.tobytes()
                self.remember(some, [packed[a:b] for a, b in zip(cuts, cuts[1:])])

    def words(self, text: str) -> list[str] | None:
        if any(mark in text for mark in self.marks):
            return None
        try:
            kinds = text.encode("latin-1").translate(KINDS)
        except UnicodeEncodeError:
            return None if ODD.search(text) else text.split()
        if b"o" in kinds:
            return None
        text = text.lower()
        if any(mark in text for mark in self.marks):
            return None
        if not (b"p. " in kinds or b".. " in kinds or kinds[-2:] in (b"p.", b"..")):
            text = f"{text} ".replace("\n", " ").replace(", ", " , ").replace(". ", " . ")
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        flat: list[str] = []
        cuts, whole = [0], {}
        for i, text in enumerate(texts):
            own = self.words(text) if text else []
            if own is None:
                whole[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                flat += own
            cuts.append(len(flat))
        if 2 * self.held > self.remembered:
            self.older, self.known, self.held = self.known, {}, 0
        ids = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = {flat[i] for i in missing}
            met = [w for w in new if w in self.older]
            self.remember(met, [self.older[w] for w in met])
            self.learn(list(new.difference(met)))
            for i in missing:
                ids[i] = self.known[flat[i]]
        return [whole[i] if i in whole else b"".join(ids[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def batches(column: pa.Array, chars: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column in runs of about ``chars`` bytes (a longer text by itself), each with its first index; only a run is in Python at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, before + chars, side="right")))
        yield at, column.slice(at, to - at).to_pylist()
        at, before = to, int(sizes[to - 1])
