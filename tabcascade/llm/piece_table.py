"""Ids of very many short pieces of text: each distinct piece is encoded once, the rest is numpy.

A piece of up to 23 bytes is three 64-bit numbers, its bytes and its length, so that equal keys
are equal pieces. The table is open addressing over flat arrays: a million pieces take tens of
megabytes, and a batch is looked up without a Python step per piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tabcascade.llm.common import mix

LONGEST = 23
PAD = 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


class PieceTable:
    """Piece -> its ids; begins anew when ``limit`` pieces are known.

    ``encode`` says the ids of a piece's bytes as little-endian 32-bit numbers.
    """

    def __init__(self, encode: Callable[[bytes], bytes], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.size = 1 << int(limit * 1.6).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(self.size, np.uint64) for _ in range(3)]  # an empty slot has length 0
        self.at, self.count = np.zeros(self.size, np.int64), np.zeros(self.size, np.int32)
        self.known = self.used = 0
        self.arena = np.zeros(1 << 16, np.int32)

    def _store(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Append ids to the arena: where each lies and how many."""
        new = np.frombuffer(b"".join(found), "<i4")
        while self.used + len(new) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        self.arena[self.used : self.used + len(new)] = new
        count = np.fromiter(map(len, found), np.int32, len(found)) // 4
        at = self.used + np.cumsum(count, dtype=np.int64) - count
        self.used += len(new)
        return at, count

    def _slots(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(slot, known): the slot that holds each key, or the empty one where its search ended."""
        low = np.int64(self.size - 1)
        slot = (mix(keys[0] ^ mix(keys[1] ^ mix(keys[2]))) & np.uint64(low)).astype(np.int64)
        known = np.zeros(len(slot), bool)
        open_ = np.arange(len(slot))
        while len(open_):
            s = slot[open_]
            third = self.keys[2][s]
            same = third == keys[2][open_]
            for own, asked in zip(self.keys[:2], keys[:2], strict=True):
                same &= own[s] == asked[open_]
            known[open_[same]] = True
            open_ = open_[~same & (third != 0)]
            slot[open_] = (slot[open_] + 1) & low
        return slot, known

    def _learn(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: list[np.ndarray]) -> None:
        """Encode the distinct pieces among those given, none of them known."""
        order = np.lexsort(keys)
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        own = order[fresh]
        raw = buffer.data
        at, count = self._store([self.encode(bytes(raw[a : a + n])) for a, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)])
        self.known += len(own)
        while len(own):
            mine = [k[own] for k in keys]
            slot, _ = self._slots(mine)
            winner = np.unique(slot, return_index=True)[1]  # one new piece a slot, the others look on
            for column, key in zip(self.keys, mine, strict=True):
                column[slot[winner]] = key[winner]
            self.at[slot[winner]], self.count[slot[winner]] = at[winner], count[winner]
            rest = np.ones(len(own), bool)
            rest[winner] = False
            own, at, count = own[rest], at[rest], count[rest]

    def find(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``arena``, number of ids) of each piece, valid until the next call.

        ``buffer`` are bytes with ``PAD`` zero bytes behind the last piece; no piece is empty.
        """
        short = np.flatnonzero(sizes <= LONGEST)
        a, n = starts[short], sizes[short]
        words = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
        keys = [words[a] & _MASKS[np.minimum(n, 8)]]
        for k in (1, 2):
            more = np.zeros(len(a), np.uint64)
            far = np.flatnonzero(n > 8 * k)
            more[far] = words[a[far] + 8 * k] & _MASKS[np.minimum(n[far] - 8 * k, 8)]
            keys.append(more)
        keys[2] |= n.astype(np.uint64) << np.uint64(56)
        if self.known > self.limit // 2 and self.known + len(a) // 8 > self.limit:
            self.clear()
        slot, known = self._slots(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            # many new pieces come in portions, so that the table is never full
            for part in np.array_split(new, max(1, -(-len(new) // max(1, self.limit // 4)))):
                if self.known + len(part) > self.limit * 3 // 2:
                    self.clear()
                    return self._piecewise(buffer, starts, sizes)
                missing = part[~self._slots([k[part] for k in keys])[1]]
                if len(missing):
                    self._learn(buffer, a[missing], n[missing], [k[missing] for k in keys])
            slot[new] = self._slots([k[new] for k in keys])[0]
        at, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int32)
        at[short], count[short] = self.at[slot], self.count[slot]
        if len(short) < len(starts):
            long = np.flatnonzero(sizes > LONGEST)
            raw, used = buffer.data, self.used
            at[long], count[long] = self._store([self.encode(bytes(raw[s : s + m])) for s, m in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)])
            self.used = used  # room for them is taken back by the next call
        return at, count

    def _piecewise(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """More new pieces at once than the table takes: each is encoded, none is kept."""
        raw = buffer.data
        found = self._store([self.encode(bytes(raw[s : s + m])) for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)])
        self.used = 0
        return found

    def ids(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each piece)."""
        at, count = self.find(buffer, starts, sizes)
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(at - ends + count, count)
        return self.arena[place], count


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts and ``PAD`` zeros, where each text begins and the last one ends)."""
    buffer = np.frombuffer(b"".join(texts) + b"\0" * PAD, np.uint8)
    return buffer, np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
