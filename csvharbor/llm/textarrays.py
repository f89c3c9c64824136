"""Words and shingles of many texts at once, as numpy arrays over the UTF-8 bytes that Arrow holds.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Words and shingles are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_AS_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


@dataclass
class Block:
    """Whole texts ``first`` to ``last`` of a batch: their bytes and the places where each begins and the last ends."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts, null as empty, in blocks of about ``size`` bytes; a longer text is a block of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, content = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield Block(first, last, content[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers.get(name, ())) < n:
        each = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        each[0] = 1
        kept = np.cumprod(each)
        if n > 4 * BLOCK_BYTES:
            return kept
        _powers[name] = kept
    return _powers[name][:n]


@dataclass
class Words:
    """In text order: where each word begins and ends, and the text (counted in the block) that it belongs to."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    counts: np.ndarray


def words(block: Block) -> Words:
    solid = np.take(_SOLID, block.data)
    heads = block.bounds[:-1][np.diff(block.bounds) > 0]
    before = np.zeros_like(solid)
    before[1:] = solid[:-1]
    before[heads] = False
    after = np.zeros_like(solid)
    after[:-1] = solid[1:]
    after[heads[1:] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    cuts = np.searchsorted(starts, block.bounds)
    counts = np.diff(cuts)
    return Words(starts, ends, np.repeat(np.arange(len(counts)), counts), counts)


def word_hashes(block: Block, found: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash per word; ``lower`` reads A-Z as a-z."""
    n = len(block.data)
    each = np.take(_BYTE_AS_LOWER if lower else _BYTE, block.data)
    each *= _power("up", _BASE, n + 1)[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(each, out=sums[1:])
    parts = np.take(sums, found.ends)
    parts -= np.take(sums, found.starts)
    parts *= np.take(_power("down", pow(_BASE, -1, 1 << 64), n + 1), found.starts)
    parts += (found.ends - found.starts).astype(np.uint64)
    return mix(parts)


def shingles(hashes: np.ndarray, found: Words, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct shingles of ``width`` words; of fewer words the whole sequence as one; of none, none."""
    step = np.uint64(0x2545F4914F6CDD1D)
    cuts = np.concatenate([[0], np.cumsum(found.counts)])
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width if n else 0):
        rolled = mix(rolled * step + hashes[k : n + k])
    out = []
    for row, count in enumerate(found.counts.tolist()):
        at = cuts[row]
        if count >= width:
            out.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            whole = np.full(1, count, np.uint64)
            for k in range(count):
                whole = mix(whole * step + hashes[at + k : at + k + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
