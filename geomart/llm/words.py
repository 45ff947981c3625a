"""Rolling (Rabin-Karp) hashes of words and word windows, a pass of many
texts at a time with numpy. All arithmetic is modulo 2**64."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_BYTE_INVERSE = pow(_BYTE_BASE, -1, 1 << 64)
_WORD_BASE = U(0xD6E8FEB86659FD93)

#: Classes of bytes: 0 white space, 1 part of a word, 2 punctuation.
WHITE = np.ones(256, np.uint8)
WHITE[[0x20, *range(0x09, 0x0E)]] = 0
_PUNCT = [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x5F]
WORD_PUNCT = WHITE.copy()
WORD_PUNCT[_PUNCT] = 2
#: Punctuation parts words and is no token.
WORDS_ONLY = WHITE.copy()
WORDS_ONLY[_PUNCT] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole of a 64-bit value."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


#: Bytes that are hashed at a time; the tables of powers have this size.
SLICE = 1 << 18


def _powers(base: int) -> np.ndarray:
    """``base**0 .. base**(SLICE-1)``."""
    out = np.full(SLICE, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_POWERS, _INVERSES = _powers(_BYTE_BASE), _powers(_BYTE_INVERSE)


def _run_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of bytes, a slice of ``buf`` at a time; a run
    that goes on in the next slice is the sum of its parts there."""
    out = np.zeros(len(starts), U)
    total = np.zeros(SLICE + 1, U)
    for a in range(0, len(buf), SLICE):
        b = min(a + SLICE, len(buf))
        i, j = np.searchsorted(stops, a, "right"), np.searchsorted(starts, b)
        if i == j:
            continue
        np.cumsum((buf[a:b].astype(U) + U(1)) * _POWERS[: b - a], out=total[1 : b - a + 1])
        low, high = np.maximum(starts[i:j], a) - a, np.minimum(stops[i:j], b) - a
        part = (total[high] - total[low]) * _INVERSES[low]
        if starts[i] < a:
            part[:1] *= U(pow(_BYTE_BASE, a - int(starts[i]), 1 << 64))
        out[i:j] += part
    return out


def _part(kind: np.ndarray, buf: np.ndarray, parting: np.ndarray) -> None:
    """Make the UTF-8 bytes of characters in the table ``parting`` (by code
    point, up to U+FFFF) white space."""
    for n, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0)):
        at = np.flatnonzero((buf >= low) & (buf < high))
        code = buf[at].astype(np.int64) & (0xFF >> (n + 1))
        for i in range(1, n):
            code = code << 6 | buf[at + i] & 63
        at = at[parting[code]]
        for i in range(n):
            kind[at + i] = 0


def token_hashes(texts: Sequence[str | None], classes: np.ndarray = WHITE, parting: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of ``texts`` and the token offsets of each text.

    A token is a run of bytes of one class other than white space; characters
    beyond ASCII that are true in ``parting`` are white space too. Returns
    ``(hashes, offsets)``; text ``i`` has ``hashes[offsets[i]:offsets[i + 1]]``.
    A null text has no tokens.
    """
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = classes[buf]
    if parting is not None:
        _part(kind, buf, parting)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([np.zeros(1, np.int64), edge])
    stops = np.concatenate([edge, np.array([len(buf)])])
    keep = kind[starts] != 0
    starts, stops = starts[keep], stops[keep]
    return mix(_run_hashes(buf, starts, stops)), np.concatenate([[0], np.searchsorted(starts, ends)])


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` consecutive tokens within one text, and
    the offsets of each text's windows."""
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    if len(hashes) < width:
        return np.zeros(0, U), out_offsets
    rolled = np.zeros(len(hashes) - width + 1, U)
    for k in range(width):
        rolled *= _WORD_BASE
        rolled += hashes[k : len(hashes) - width + 1 + k]
    at = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], count)
    return mix(rolled[at]), out_offsets
