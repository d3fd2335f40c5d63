"""Byte-level BPE of whole texts: the tokenizer's merges run once for each piece that is new."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from tabcascade.llm.common import chunks, remember
from tabcascade.llm.piece_table import PieceTable, padded

#: Bytes of text that are cut at once: the arrays of a slice stay in the processor's cache.
SLICE = 1 << 18
# Classes of bytes of plain texts: letters, digits, white space, anything else that prints. A text
# of these bytes alone is cut alike by every version of the Unicode tables: ASCII and the
# Latin-1 letters, whose first byte is 0xC3. All others are 0.
LETTER, DIGIT, SPACE, MARK = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = MARK
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = LETTER


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def plain(buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the texts between ``bounds`` have only bytes of the classes above."""
    own = buffer[: bounds[-1]]
    bad = _CLASS[own] == 0
    signs = np.flatnonzero((own[:-1] == 0xC3) & ((own[1:] == 0x97) | (own[1:] == 0xB7)))  # no letters
    bad[signs] = True
    before = np.append(0, np.cumsum(bad))
    return before[bounds[1:]] == before[bounds[:-1]]


def piece_starts(buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the public pattern of byte-level vocabularies cuts plain texts.

    Runs of one class are pieces, with a space before them if there is one. A longer run of white
    space is one piece up to its last character, unless the text ends with it. After anything
    but a space or a mark, an apostrophe and one of s, t, m, d, re, ve, ll are a piece.
    """
    own = buffer[: bounds[-1]]
    if not len(own):
        return np.empty(0, np.int64)
    kind = _CLASS[own]
    white = kind == SPACE
    start = np.ones(len(own), bool)
    start[1:] = (kind[1:] != kind[:-1]) & (own[:-1] != 32)
    follows = np.zeros(len(own), bool)
    follows[:-1] = ~white[1:]
    follows[bounds[1:][np.diff(bounds) > 0] - 1] = False
    first_white = np.ones(len(own), bool)
    first_white[1:] = ~white[:-1]
    start[white] = (first_white | follows)[white]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    start[firsts] = True
    cut_contractions(buffer, bounds, kind, start)
    return np.flatnonzero(start)


def classes(own: np.ndarray) -> np.ndarray:
    """Letter, digit, white space or mark, for each byte of plain texts."""
    return _CLASS[own]


def cut_contractions(buffer: np.ndarray, bounds: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """Where a piece begins with an apostrophe and s, t, m, d, re, ve or ll, it ends after these."""
    own = buffer[: bounds[-1]]
    at = np.flatnonzero((own == 39) & start)
    if not len(at):
        return
    ends = bounds[np.searchsorted(bounds, at, "right")]
    one, two = buffer[at + 1], buffer[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    size = np.where(short, 2, np.where(long, 3, 0))
    held = (size > 0) & (at + size <= ends)
    at, size, ends = at[held], size[held], ends[held]
    start[at + 1] = False
    after = at + size
    letters = (after < ends) & (kind[np.minimum(after, len(own) - 1)] == LETTER)
    start[after[letters]] = True


class ByteLevel:
    """Ids of texts under a byte-level BPE file of the tokenizers library.

    ``plain_specials`` reads the strings of special tokens inside texts as ordinary text; else
    each is its own id. A file with a normaliser, or another way of cutting, and a text with
    characters beyond Latin-1 or a special string go through the whole tokenizer.
    """

    def __init__(self, path: str, plain_specials: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cut = told["pre_tokenizer"] or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        model = told["model"]
        self.by_piece = bool(usual and told["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout"))
        self.marks = [t["content"].encode() for t in told["added_tokens"] if not (plain_specials and t["special"])]
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = PieceTable(self._piece)

    def _piece(self, piece: bytes) -> bytes:
        mapped = piece.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        parts = [self._slice(part) for part in chunks(texts, len, SLICE)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buffer, bounds = padded(texts)
        cut = plain(buffer, bounds) if self.by_piece else np.zeros(len(texts), bool)
        for mark in self.marks:
            cut &= np.fromiter((mark not in t for t in texts), bool, len(texts))
        if cut.all():
            return self._cut(buffer, bounds)
        ids, counts = self._cut(*padded([t for t, c in zip(texts, cut, strict=True) if c]))
        easy = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        out = [next(easy) if c else self._whole(t) for t, c in zip(texts, cut, strict=True)]
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _cut(self, buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = piece_starts(buffer, bounds)
        ids, counts = self.pieces.ids(buffer, starts, np.diff(np.append(starts, bounds[-1])))
        before = np.append(0, np.cumsum(counts, dtype=np.int64))
        return ids, np.diff(before[np.searchsorted(starts, bounds)])

    def entries(self) -> list[bytes]:
        """Bytes of each id."""
        back = {letter: b for b, letter in self.letters.items()}
        out = [b""] * self.tokenizer.get_vocab_size()
        for entry, number in self.tokenizer.get_vocab().items():
            out[number] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        return out


_loaded: dict[tuple[str, bool], ByteLevel] = {}
remember("byte_tokens", _loaded.clear)


def loaded(path: str, plain_specials: bool) -> ByteLevel:
    """The encoder of this worker; only the last one is kept."""
    if (path, plain_specials) not in _loaded:
        _loaded.clear()
        _loaded[path, plain_specials] = ByteLevel(path, plain_specials)
    return _loaded[path, plain_specials]
