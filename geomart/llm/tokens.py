"""Token ids of whole texts by a public tokenizer file.

The ids of a text are those of its pieces between single spaces, one after
the other, because the tokenizers used here never merge across a space that
stands between two non-space characters; nor do they merge a run of letters
with ASCII that follows and is no letter. Pieces and letter runs repeat, so each
Python worker remembers their ids; texts with any other white space, or with an
added token of the tokenizer (``<|endoftext|>``, one id), are encoded whole.

Remembered pieces are a table that is looked up for all pieces of a pass at
once: a piece of up to 32 bytes is four numbers, its bytes, which are compared;
the ids of a pass are one gather from the pool of all ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from operator import add

import numpy as np

from geomart.llm.words import mix

#: Pieces, and letter runs, that a worker remembers before it starts anew
#: (about 100 MB).
REMEMBERED = 800_000

#: White space other than space and line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Latin letters up to the end or to ASCII that is no letter; without U+0130,
#: which a tokenizer that lowers case takes apart.
_RUN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+(?=[\\x21-\\x40\\x5b-\\x60\\x7b-\\x7e\\n]|\\Z)")
#: Letter runs that are encoded in one go.
_TOGETHER = 4000
#: How the tokenizer files write the space before a word and the end of a word.
_SPACE, _WORD_END = "\u0120", "</w>"

def _byte_letters() -> dict[int, str]:
    """Bytes as the letters that byte-level tokenizer files write for them: those
    that print stand for themselves, the others follow from U+0100 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
#: Leading bits of a hash that the table is entered by.
_HEAD_BITS = 19
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

_encoders: dict[str, "PieceEncoder"] = {}


def _single_spaced(text: str) -> bool:
    """Every space stands between two characters that are no white space."""
    return not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text))


@dataclass
class Pieces:
    """Pieces as numbers: four of eight bytes each (zero beyond their end), the
    length in bytes, and a hash of these."""

    parts: list[np.ndarray]
    length: np.ndarray
    hashes: np.ndarray

    def take(self, which: np.ndarray) -> "Pieces":
        return Pieces([p[which] for p in self.parts], self.length[which], self.hashes[which])


class PieceTable:
    """Ids of remembered pieces. ``hashes`` are in order, with the row of each in
    ``rows``; ``heads`` says where the hashes with some leading bits begin.
    Pieces of more than 32 bytes, and the second of two with the same hash, are
    not held."""

    def __init__(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.heads = np.zeros((1 << _HEAD_BITS) + 1, np.int64)
        self.parts, self.length = [np.zeros(0, np.uint64)] * 4, np.zeros(0, np.int64)
        self.offset, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def __len__(self) -> int:
        return len(self.length)

    def words(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> Pieces:
        eights = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        parts = [eights[starts + 8 * k] & _MASKS[np.clip(length - 8 * k, 0, 8)] for k in range(4)]
        return Pieces(parts, length, mix(sum(p * m for p, m in zip(parts, _MULTIPLIERS)) + length.astype(np.uint64)))

    def find(self, pieces: Pieces) -> np.ndarray:
        """Row of each piece, or -1."""
        out = np.full(len(pieces.length), -1)
        head = (pieces.hashes >> np.uint64(64 - _HEAD_BITS)).astype(np.int64)
        at, end = self.heads[head], self.heads[head + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.hashes[at[left]] == pieces.hashes[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        some = np.flatnonzero(out >= 0)
        rows = out[some]
        same = self.length[rows] == pieces.length[some]
        for mine, theirs in zip(self.parts, pieces.parts):
            same &= mine[rows] == theirs[some]
        out[some[~same]] = -1
        return out

    def keep(self, ids: bytes) -> tuple[int, int]:
        """Put ids into the pool; where they are and how many."""
        n = len(ids) // 4
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
        self.pool[self.used : self.used + n] = np.frombuffer(ids, "<u4")
        self.used += n
        return self.used - n, n

    def add(self, pieces: Pieces, ids: list[bytes]) -> None:
        """Remember ``ids`` of ``pieces``, whose hashes differ from each other."""
        taken = np.append(self.hashes, np.uint64(0))[np.searchsorted(self.hashes, pieces.hashes)] == pieces.hashes
        new = np.flatnonzero((pieces.length <= 32) & ~(taken & (len(self) > 0)))
        some, ids = pieces.take(new), [ids[i] for i in new.tolist()]
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        start, _ = self.keep(b"".join(ids))
        hashes, rows = np.append(self.hashes, some.hashes), np.append(self.rows, np.arange(len(self), len(self) + len(new)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rows = hashes[order], rows[order]
        self.parts = [np.append(a, b) for a, b in zip(self.parts, some.parts)]
        self.length = np.append(self.length, some.length)
        self.offset, self.count = np.append(self.offset, start + np.cumsum(counts) - counts), np.append(self.count, counts)
        self.heads = np.searchsorted(self.hashes >> np.uint64(64 - _HEAD_BITS), np.arange((1 << _HEAD_BITS) + 1, dtype=np.uint64))


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # The empty string is in every text: one that is looked for in
        # normalised text need not stand in the text as it is.
        self.added = ["" if t.normalized else t.content for t in added]
        self.runs: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}
        self.firsts: dict[str, tuple[int, int]] = {}
        self.others: dict[str, tuple[int, int]] = {}
        self.table = PieceTable()
        (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        # Tokens that begin a word with its space, or that end a word.
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(1 + max(vocab.values()), bool)
        self.closes = self.begins.copy()
        self.begins[[i for token, i in vocab.items() if token[0] == _SPACE]] = True
        self.closes[[i for token, i in vocab.items() if token.endswith(_WORD_END)]] = True
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.lowers, self.lead = one(" A") == one(" a"), "" if self.closes.any() else _SPACE
        # The short way is taken if it gives the same ids for every letter, alone,
        # doubled and within a word.
        letters = [chr(c) for c in range(0x250) if _RUN.fullmatch(chr(c))]
        probe = [x for c in letters for x in (c, 2 * c, f"the{c}ing", f"{c}on")]
        self.direct = self._merged(probe) == self._together(probe)

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in done)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, run: str) -> str:
        """A letter run after a space as the merges of the tokenizer see it: its
        bytes as letters, in lower case if the tokenizer lowers case."""
        word = run.lower() if self.lowers else run
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return self.lead + word

    def _merged(self, runs: list[str]) -> list[bytes]:
        """Ids of letter runs by the merges alone, without normalising and
        splitting again what is known to be one word."""
        tokenize, out = self.tokenizer.model.tokenize, []
        for run in runs:
            ids = [t.id for t in tokenize(self._word(run))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of letter runs that follow a space."""
        return self._merged(runs) if self.direct else self._together(runs)

    def _together(self, runs: list[str]) -> list[bytes]:
        """Ids of letter runs that follow a space, many in one go.

        Each run has at least one token that begins a word, or one that ends
        a word, if the tokenizer marks them; as many such tokens as runs
        therefore tell where each run's ids are. Other runs are encoded with a
        bar after each, a token of its own that no letter run has."""
        out: list[bytes] = []
        for i in range(0, len(runs), _TOGETHER):
            some = runs[i : i + _TOGETHER]
            ids = self._ids(" " + " ".join(some))
            starts, ends = np.flatnonzero(self.begins[ids]), np.flatnonzero(self.closes[ids]) + 1
            if len(starts) == len(some) and starts[0] == 0:
                ends = np.append(starts[1:], len(ids))
            elif len(ends) == len(some) and ends[-1] == len(ids):
                starts = np.append([0], ends[:-1])
            else:
                ids = self._ids(" " + "| ".join(some) + "|")
                ends = np.flatnonzero(ids == self.bar)
                starts = np.append([0], ends[:-1] + 1)
                if len(ends) != len(some):
                    raise ValueError("the tokenizer does not keep letters and bars apart")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space."""
        heads, rest = [], []
        match = _RUN.match
        for p in pieces:
            # What follows a run is encoded as it stands, what has none after its space.
            m = match(p)
            if m:
                head = m[0]
                heads.append(head)
                rest.append(p[len(head) :])
            else:
                heads.append("")
                rest.append(" " + p)
        runs = list(set(heads).difference(self.runs))
        self.runs.update(zip(runs, self._encode_runs(runs)))
        new = list(set(rest).difference(self.rests))
        self.rests.update(zip(new, self._encode(new)))
        return list(map(add, map(self.runs.__getitem__, heads), map(self.rests.__getitem__, rest)))

    def _forget(self) -> None:
        """Start a memory anew that has grown too large."""
        if len(self.runs) > REMEMBERED or not self.runs:
            self.runs = {"": b""}
        if len(self.rests) > REMEMBERED or not self.rests:
            self.rests = {"": b""}
        if max(len(self.table), len(self.firsts), len(self.others)) > REMEMBERED or not self.table.used:
            self.table = PieceTable()
            # Places in the pool of pieces that the table does not hold: those
            # that begin a text, and long ones.
            self.firsts, self.others = {}, {}

    def _joined(self, raws: list[bytes]) -> list[bytes]:
        """Ids of single-spaced texts, given as their bytes."""
        table = self.table
        joined = b" ".join(raws) + b" "
        buf = np.frombuffer(joined + bytes(32), np.uint8)
        stops = np.flatnonzero(buf[: len(joined)] == 32)
        starts = np.concatenate([[0], stops[:-1] + 1])
        begins = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
        first = np.searchsorted(starts, begins)
        found = table.words(buf, starts, stops - starts)
        row = table.find(found)
        missing = row < 0
        missing[first] = False
        where = np.flatnonzero(missing)
        if len(where):
            _, at = np.unique(found.hashes[where], return_index=True)
            some = where[at]
            names = [joined[a:b].decode() for a, b in zip(starts[some].tolist(), stops[some].tolist())]
            table.add(found.take(some), self._learn(names))
            row[where] = table.find(found.take(where))
        held = row >= 0
        off, count = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        off[held], count[held] = table.offset[row[held]], table.count[row[held]]
        for memory, which in ((self.firsts, first), (self.others, where[row[where] < 0])):
            names = [joined[a:b].decode() for a, b in zip(starts[which].tolist(), stops[which].tolist())]
            new = list(set(names).difference(memory))
            for name, ids in zip(new, self._encode(new) if memory is self.firsts else self._learn(new)):
                memory[name] = table.keep(ids)
            if names:
                own = np.array([memory[name] for name in names], np.int64)
                off[which], count[which] = own[:, 0], own[:, 1]
        ends = np.cumsum(count)
        ids = table.pool[np.repeat(off - ends + count, count) + np.arange(ends[-1])]
        cut = [0, *ends[np.append(first[1:], len(starts)) - 1].tolist()]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null
        text has none. Give a few MB of text at a time."""
        self._forget()
        spaced = [bool(t) and " " in t and _single_spaced(t) and not any(a in t for a in self.added) for t in texts]
        whole = iter(self._encode([t or "" for t, s in zip(texts, spaced) if not s]))
        pieced = iter(self._joined([t.encode() for t, s in zip(texts, spaced) if s]) if any(spaced) else [])
        return [next(pieced if s else whole) for s in spaced]


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker for the tokenizer file at ``path``."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
