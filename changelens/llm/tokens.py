"""Token ids of whole texts, by the tokenizers library.

A text is cut where its tokenizer always cuts: before white space, after a
lone line feed, and after a letter that a plain ASCII character follows.
Natural text repeats such pieces, so each distinct piece is encoded once and
its ids are looked up by the fingerprint of its bytes.  Pieces of letters alone
go to the library's BPE model directly, the others through all its steps; texts
that hold the string of a special token are one piece.
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import textkernel as tk

#: Distinct pieces kept between calls; the store starts anew beyond it.
KEEP = 1_500_000
#: Bytes of text encoded at once.
PIECE_BYTES = 1 << 20
_made: dict[str, Encoder] = {}

_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_SPACE = ~tk.NON_SPACE
_PLAIN = np.array([0x21 <= b <= 0x7E for b in range(256)])


def _byte_symbols() -> dict[int, str]:
    """The printable character by which byte-level BPE writes each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, keep: int = KEEP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = Tokenizer.from_file(path).model
        self.special = [t["content"].encode() for t in said["added_tokens"]]
        #: the word kind drops white space and lower-cases
        self.word = "Lowercase" in json.dumps(said["normalizer"])
        self.symbols = np.array([ord(_byte_symbols()[b]) for b in range(256)], np.uint16)
        self.reset()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def reset(self) -> None:
        #: open addressing: fingerprint and number of the piece in each slot; 0 marks a free one
        self.slots = 1 << max(10, (2 * self.keep).bit_length())
        self.keys = np.zeros(self.slots, np.uint64)
        self.piece = np.zeros(self.slots, np.int32)
        self.first = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.pieces = self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where it is new."""
        mask = np.uint64(self.slots - 1)
        slot = (keys & mask).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.piece[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.piece[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def _put(self, keys: np.ndarray, number: np.ndarray) -> None:
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last stays
            won = self.keys[at] == keys[left]
            self.piece[at[won]] = number[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> None:
        """Adds pieces; keys are distinct and new."""
        order = np.argsort(~simple, kind="stable")
        keys, starts, ends, n = keys[order], starts[order], ends[order], int(simple.sum())
        low = data
        if self.word:  # letters of U+0041 to U+00FF only, see simple
            low = tk.LOWER[data]
            at = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
            low[at] += 0x20
        shown = self.symbols[low].tobytes().decode("utf-16-le")
        model, flat, size = self.model.tokenize, [], []
        for a, b in zip(starts[:n].tolist(), ends[:n].tolist(), strict=True):
            found = model(shown[a:b])
            flat += [t.id for t in found]
            size.append(len(found))
        raw = data.tobytes()
        for found in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[n:].tolist(), ends[n:].tolist(), strict=True)], add_special_tokens=False):
            flat += found.ids
            size.append(len(found))
        size, ids = np.array(size, np.int32), np.array(flat, np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used // 2), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += len(ids)
        if self.pieces + len(size) > len(self.size):
            more = max(len(size), self.pieces // 2)
            self.first, self.size = (np.concatenate([x[: self.pieces], np.zeros(more, x.dtype)]) for x in (self.first, self.size))
        number = np.arange(self.pieces, self.pieces + len(size))
        self.first[number], self.size[number] = first, size
        self.pieces += len(size)
        self._put(keys, number.astype(np.int32))

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Where pieces start, which bytes belong to letters of U+0041 to U+00FF, and whether a special token's string occurs."""
        letter = _LETTER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        space, plain = _SPACE[data], _PLAIN[data] | letter
        cut = np.zeros(len(data) + 1, bool)
        # after a letter, before an ASCII character that is none; after any plain character, before white space
        cut[1:-1] = (letter[:-1] & ~letter[1:] & (data[1:] < 0x80)) | (plain[:-1] & space[1:] & (data[1:] != 0x20))
        # before a blank that stands alone, and on both sides of a line feed that does
        cut[1:-2] |= (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
        cut[2:-1] |= (data[1:-1] == 0x0A) & plain[:-2] & plain[2:]
        # a blank after a letter but before more white space is no place to cut: the blanks belong together
        cut[offsets[offsets < len(data)]] = True
        special = False
        if b"<|" in (raw := data.tobytes()):
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    special = True
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    cut[offsets[row] + 1 : offsets[row + 1]] = False
                    at = raw.find(s, int(offsets[row + 1]))
        return np.flatnonzero(cut[:-1]), letter, special

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, letter, special = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        of = np.diff(np.searchsorted(starts, offsets))
        blank = (data[starts] == 0x20) & (ends - starts > 1)
        solid = np.concatenate([[0], np.cumsum(letter)])
        inner = starts + blank
        simple = (solid[ends] - solid[inner] == ends - inner) & (ends > inner)
        if self.word:
            starts = np.where(simple, inner, starts)
        keys = tk.fingerprints(data, starts, ends, lower=self.word and not special)
        keys[keys == 0] = 1
        number = self._find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, where = np.unique(keys[new], return_index=True)
            if self.pieces + len(distinct) > self.keep and self.pieces:
                self.reset()
                new = np.arange(len(keys))
                distinct, where = np.unique(keys, return_index=True)
            if len(distinct) > self.keep:
                self.keep = len(distinct)
                self.reset()
            first = new[where]
            self._learn(distinct, data, starts[first], ends[first], simple[first])
            number[new] = self._find(keys[new])
        size = self.size[number].astype(np.int64)
        ids = self.ids[tk.gather(self.first[number], size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(of)])])


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text, and the new counts."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1
