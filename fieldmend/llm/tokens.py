"""Token ids of whole texts by the tokenizers library, with a bounded store of pieces.

A tokenizer file splits a text into pieces (words, digit runs, punctuation) and encodes each by itself. So each
distinct piece is encoded once: the pieces of a batch that are not in the store yet are joined into one text,
which the library encodes whole. Texts with characters outside the range for which the splitting below is the
library's own, or with something that looks like a special token, go through the library as they are. Both ways
give the ids of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Pieces kept per Python worker; about 150 bytes each.
STORED_PIECES = 400_000


def _class(test) -> str:
    return "".join(f"\\u{i:04x}" for i in range(0x250) if test(chr(i)))


_LETTER = _class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = _class(lambda c: unicodedata.category(c)[0] == "N")
_SPACE = _class(lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f")
#: Texts of characters below LIMIT are split here. There are no combining marks among them. A tokenizer of words lowers
#: case first, so it leaves those out whose lower case is longer or lies beyond LIMIT (U+0130, U+0181, U+023A and others).
LIMIT = 0x250
_AWAY = _class(lambda c: len(c.lower()) != 1 or ord(c.lower()) >= LIMIT)
_OUTSIDE = re.compile("[^\\x00-\\x1b\\x20-\\u024f]|<\\|")
_OUTSIDE_WORDS = re.compile(f"[{_AWAY}]|{_OUTSIDE.pattern}")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PIECE = re.compile(f"{_CONTRACTIONS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_PIECE = re.compile(f"{_CONTRACTIONS}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_LETTERS = re.compile(f" ?[{_LETTER}]+")


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        words = model.get("end_of_word_suffix") == "</w>"
        self.split = (lambda t: _WORD_PIECE.findall(t.lower())) if words else _BYTE_PIECE.findall
        self.words = words
        self.outside = _OUTSIDE_WORDS if words else _OUTSIDE
        # Which ids end a piece ("</w>") or begin one (the byte-level sign of a leading space).
        self.edge = np.zeros(max(model["vocab"].values()) + 1 + 16, bool)
        for token, i in model["vocab"].items():
            self.edge[i] = token.endswith("</w>") if words else token.startswith("Ġ")
        self.store: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece; those of letters only are joined and encoded together."""
        runs = [p for p in pieces if _LETTERS.fullmatch(p) and (self.words or p[0] == " ")]
        out = {}
        for k in range(0, len(runs), 4096):
            some = runs[k : k + 4096]
            ids = np.asarray(self.library.encode((" " if self.words else "").join(some), add_special_tokens=False).ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(some):  # not as expected: one by one
                out.update((p, self._plain(p)) for p in some)
                continue
            bounds = [0, *(edges + 1)] if self.words else [*edges, len(ids)]
            data = ids.tobytes()
            out.update((p, data[4 * a : 4 * b]) for p, a, b in zip(some, bounds, bounds[1:], strict=False))
        out.update((p, self._plain(p)) for p in pieces if p not in out)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if self.outside.search(t) else self.split(t) for t in texts]
        store = self.store
        new = set().union(*(s for s in split if s)).difference(store)
        made = self._encode_pieces(list(new)) if new else {}
        full = len(store) + len(made) > STORED_PIECES
        store.update(made)
        out = [self._plain(t) if s is None else b"".join(map(store.__getitem__, s)) for t, s in zip(texts, split, strict=True)]
        if full:  # these texts' own pieces go again; none of those already stored is in made
            for p in made:
                del store[p]
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """The encoder of a file, one per Python worker."""
    return Encoder(path)


def in_slices(texts: list[str], most: int = 4_000_000):
    """Consecutive runs of texts of about so many characters, by index."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
