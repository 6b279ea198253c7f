"""Simple-8b: ids in 64-bit words, four bits of selector and sixty of values.

Selector s below 14 holds COUNTS[s] values of WIDTHS[s] bits, the first lowest; selector 15
is an escape, whose sixty bits are the index of a value over sixty bits in a table of its own.
Ids are cut into blocks, whose word offsets are kept: a word never reaches over a block's end,
so blocks are encoded side by side and decoded from any offset on.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the coding: values in a word, and bits of each.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024
#: Ids that are encoded at a time.
AT_ONCE = 1 << 18
MAGIC = b"TSS8B001"


_SHORT = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 64 at most; token ids mostly fit sixteen, which a table answers."""
    if ids.max(initial=0) < len(_SHORT):
        return _SHORT[ids.astype(np.uint16)]
    bits = np.zeros(len(ids), np.uint8)
    rest = ids
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        more = high != 0
        bits += np.where(more, step, 0).astype(np.uint8)
        rest = np.where(more, high, rest)
    return bits + (rest != 0)


def encode(ids: np.ndarray, block: int = BLOCK, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offsets of the blocks with the end, escaped values) of unsigned ids, about ``at_once`` of them at a time."""
    step = max(1, at_once // block) * block
    parts, ends, escaped, n = [], [np.zeros(1, np.uint64)], [], np.uint64(0)
    for at in range(0, len(ids), step):
        words, offsets, values = _encode(ids[at : at + step], block)
        words[words >> np.uint64(60) == ESCAPE] += np.uint64(sum(map(len, escaped)))
        parts.append(words)
        ends.append(offsets[1:] + n)
        escaped.append(values)
        n += offsets[-1]
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(parts or none), np.concatenate(ends), np.concatenate(escaped or none)


def _encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    bits = _widths(ids)
    place = np.arange(n, dtype=np.int32)
    room = np.minimum(np.minimum(block - place % block, n - place), 60).astype(np.uint8)
    most = {1: bits}  # the widest of the next k values; short of k at the end, which room rules out
    choice = np.where(bits > 60, ESCAPE, 13).astype(np.uint8)
    for s in range(12, -1, -1):
        k = COUNTS[s]
        a = max(x for x in most if x <= k)
        b = k - a
        if b and b not in most:
            b = max(x for x in most if x >= b)  # overlapping windows have the same maximum
        wide = most[a].copy()
        if b and (shift := k - b) < n:
            wide[: n - shift] = np.maximum(wide[: n - shift], most[b][shift:])
        most[k] = wide
        np.copyto(choice, np.uint8(s), where=(wide <= WIDTHS[s]) & (room >= k))
    counts = np.array([*COUNTS, 1, 1], np.int64)
    at = np.arange(blocks, dtype=np.int64) * block
    ends = np.minimum(at + block, n)
    owners, starts = [], []
    live = np.arange(blocks)
    while len(live):  # each round takes a word from every block that isn't done
        owners.append(live)
        starts.append(at.copy())
        at += counts[choice[at]]
        keep = at < ends[live]
        live, at = live[keep], at[keep]
    owner, start = np.concatenate(owners), np.concatenate(starts)
    order = np.argsort(start)
    owner, start = owner[order], start[order]
    selector = choice[start]
    words = np.empty(len(start), np.uint64)
    for s in range(14):
        where = np.flatnonzero(selector == s)
        if len(where):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            own, word = start[where], np.full(len(where), s << 60, np.uint64)
            for k, shift in enumerate(shifts):  # a column at a time: words of one selector have as many values
                word |= ids[own + k] << shift
            words[where] = word
    where = np.flatnonzero(selector == ESCAPE)
    words[where] = np.arange(len(where), dtype=np.uint64) | np.uint64(ESCAPE << 60)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))]).astype(np.uint64)
    return words, offsets, ids[start[where]]


def decode(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The ids of whole words, as unsigned 64-bit integers; words of any run of blocks will do."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array([*COUNTS, 0, 1], np.int64)[selector]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s in range(14):
        where = np.flatnonzero(selector == s)
        if len(where):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            own, word, mask = starts[where], words[where], np.uint64((1 << WIDTHS[s]) - 1)
            for k, shift in enumerate(shifts):
                out[own + k] = word >> shift & mask
    where = np.flatnonzero(selector == ESCAPE)
    if len(where):
        out[starts[where]] = escaped[(words[where] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard: header, documents (null flag, id, length), block offsets, words, escaped values; all little-endian."""
    words, offsets, escaped = encode(ids, block)
    head = MAGIC + struct.pack("<6Q", len(doc_ids), len(ids), block, len(offsets) - 1, len(words), len(escaped))
    return b"".join([
        head, np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes(),
    ])


class Shard:
    """Reads what to_file wrote; ``ids`` decodes any run of ids from the block offsets."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        docs, self.n_ids, self.block, blocks, words, escaped = struct.unpack_from("<6Q", data, 8)
        at = 56

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        null = part("u1", docs)
        self.doc_ids = [None if z else int(d) for z, d in zip(null, part("<i8", docs), strict=True)]
        self.lengths = part("<u8", docs).astype(np.int64)
        self.offsets = part("<u8", blocks + 1).astype(np.int64)
        self.words, self.escaped = part("<u8", words), part("<u8", escaped)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint64)
        first, last = start // self.block, -(-end // self.block)
        found = decode(self.words[self.offsets[first] : self.offsets[last]], self.escaped)
        return found[start - first * self.block : end - first * self.block]
