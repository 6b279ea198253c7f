"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

Text is cut into words, each with the white-space marks before it, which no piece reaches across; distinct words
are encoded once for each worker. Words of equal length advance together: hashes of all their substrings
probe the sorted keys of the pieces, and for each end position the best start is taken by vectorised maxima and stored as a backpointer.

A unigram model's score is the sum of its pieces' scores. A merge model (BPE, whose pieces have to come in the order of their merges) has no such sum: its encoding is the one
path on which no two neighbours would have been merged otherwise, so a transition is allowed only between such neighbours,
which the pieces' merge trees tell; exactly one start is then left at each position that a path reaches.

A long word is cut where no piece holds the two characters that meet, which changes nothing. In a merge model what is longer still
is searched in overlapping stretches of one length, all advanced together, and their paths are joined where they have a border in common whose
two pieces may be neighbours: all neighbours of the joined path are allowed then, so it is the one path.

Defined results: null text is empty; empty text has no ids; characters without a piece fall back to bytes, or to the unknown id in
models without bytes; a literal mark character reads back as a space, as in the library.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LONGEST_KEPT, bounded_batches, worker_state

MARK = "▁"
UNIGRAM, MERGES = 1, 2
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Words encoded at once, in characters.
AT_ONCE = 400_000
NEVER = np.iinfo(np.int64).max
#: Longer words are cut; the stretches of one, and how far each reaches into the next.
LONG, STRETCH, OVERLAP = 64, 128, 48


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """Pieces of a model and what the search needs of them. ``entries``: (piece, score, type) by id; types as in the model file."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6

    def __init__(self, entries: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.entries, self.kind, self.dummy_prefix = entries, kind, dummy_prefix
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(entries) if t == self.BYTE}
        self.unknown = next((i for i, e in enumerate(entries) if e[2] == self.UNKNOWN), 0)
        usable = {p: i for i, (p, _, t) in enumerate(entries) if t in (self.NORMAL, self.USER)}
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("a piece reaches across the start of a word")
        extra = sorted({c for p in usable for c in p} - usable.keys()) if kind == MERGES else []
        self.symbols = usable | {c: len(entries) + k for k, c in enumerate(extra)}  # characters that stand in pieces only
        self.longest = max(map(len, self.symbols), default=1)
        self.meets = {p[j : j + 2] for p in self.symbols for j in range(len(p) - 1)}  # characters that stand together in a piece
        self.lone_newline = not any("\n" in p for p in usable)
        texts = list(self.symbols)
        hashes = np.array([self._hash(np.array([ord(c) for c in p], np.uint64)) for p in texts], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(list(self.symbols.values()), np.int64)[order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        size = len(entries) + len(extra)
        self.sizes = np.ones(size, np.int64)
        for p, i in self.symbols.items():
            self.sizes[i] = len(p)
        self.score = np.zeros(size)
        for p, i in usable.items():
            self.score[i] = entries[i][1]
        self.unknown_score = min((e[1] for e in entries if e[2] == self.NORMAL), default=0.0) - 10
        if kind == MERGES:
            self._trees(usable, size)

    @staticmethod
    def _hash(codes: np.ndarray) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                h = (h ^ (c + np.uint64(1))) * _FACTOR
                h ^= h >> np.uint64(32)
        return int(h)

    def _trees(self, usable: dict[str, int], size: int) -> None:
        """Birth (place in the order of merges; -1 for characters), last merge of each piece, and every pair that would merge."""
        several = sorted((p for p in usable if len(p) > 1), key=lambda p: (-self.entries[usable[p]][1], usable[p]))
        rank = {p: k for k, p in enumerate(several)}
        self.birth = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.whole = np.ones(size, bool)  # pieces that merges make of their own characters
        for p, k in rank.items():
            i = usable[p]
            self.birth[i] = k
            parts = list(p)
            last = None
            while len(parts) > 1:
                best = min((rank.get(a + b, NEVER), j) for j, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == NEVER:
                    break
                j = best[1]
                last = parts[j], parts[j + 1]
                parts[j : j + 2] = [parts[j] + parts[j + 1]]
            if len(parts) == 1 and last:
                self.left[i], self.right[i] = self.symbols[last[0]], self.symbols[last[1]]
            else:
                self.whole[i] = False
        made = np.flatnonzero(self.left != np.arange(size))
        if (np.maximum(self.birth[self.left[made]], self.birth[self.right[made]]) >= self.birth[made]).any():
            raise ValueError("a piece comes before the pieces that it is merged from")
        pairs = {(self.symbols[p[:j]], self.symbols[p[j:]]): k for p, k in rank.items() for j in range(1, len(p)) if p[:j] in self.symbols and p[j:] in self.symbols}
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.size = keys[order], np.array(list(pairs.values()), np.int64)[order], size

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece a before piece b stays as it is: taking both merge trees apart, latest merge first, no pair that
        meets across the border would have been merged before one of its sides was."""
        fine = np.ones(len(a), bool)
        limit = np.full(len(a), NEVER)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
            meets = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit) if len(self.pair_keys) else np.zeros(len(key), bool)
            fine[live[meets]] = False
            born_a, born_b = self.birth[a], self.birth[b]
            more = ~meets & (np.maximum(born_a, born_b) >= 0)
            live, a, b, born_a, born_b = live[more], a[more], b[more], born_a[more], born_b[more]
            first = born_a > born_b  # of equal merges the left one comes first, so the right one is undone first
            limit = np.where(first, born_a, born_b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return fine

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word, whose first characters may be marks."""
        short = [w for w in words if len(w) <= LONG]
        paths = dict(zip(short, self._paths_of(short), strict=True))
        for w in words:
            if len(w) > LONG:
                paths[w] = self._long(w)
        return [self._ids(w, paths[w]) for w in words]

    def _long(self, word: str) -> np.ndarray:
        """The path of a long word: by parts between characters that no piece holds together, and those in stretches."""
        cuts = [0, *(j + 1 for j in range(len(word) - 1) if word[j : j + 2] not in self.meets), len(word)]
        parts = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        short = list({p for p in parts if len(p) <= STRETCH or self.kind != MERGES})
        paths = dict(zip(short, self._paths_of(short), strict=True))
        for p in parts:
            if p not in paths:
                paths[p] = self._joined(p)
        return np.concatenate([paths[p] for p in parts])

    def _joined(self, part: str) -> np.ndarray:
        step = STRETCH - OVERLAP
        starts = [*range(0, len(part) - STRETCH, step), len(part) - STRETCH]
        path, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start, own in zip(starts, self._paths_of([part[s : s + STRETCH] for s in starts]), strict=True):
            own_ends = start + np.cumsum(self._sizes(own))
            if start:
                # Borders of both paths, from the middle of the overlap outwards.
                both, i, j = np.intersect1d(ends, own_ends, assume_unique=True, return_indices=True)
                for k in np.argsort(np.abs(both - start - OVERLAP // 2)):
                    if j[k] + 1 < len(own) and both[k] < ends[-1]:
                        a, b = path[i[k]], own[j[k] + 1]
                        if a < 0 or b < 0 or self.neighbours(np.array([a]), np.array([b]))[0]:
                            path, ends = np.concatenate([path[: i[k] + 1], own[j[k] + 1 :]]), np.concatenate([ends[: i[k] + 1], own_ends[j[k] + 1 :]])
                            break
                else:
                    return self._paths_of([part])[0]
            else:
                path, ends = own, own_ends
        return path

    def _sizes(self, path: np.ndarray) -> np.ndarray:
        return np.where(path >= 0, self.sizes[path], 1)

    def _paths_of(self, words: list[str]) -> list[np.ndarray]:
        """The path of each word: symbols, -1 for a character without one."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            groups.setdefault(len(w), []).append(k)
        for length, rows in groups.items():
            step = max(1, AT_ONCE // max(length, 1))
            for at in range(0, len(rows) if length else 0, step):
                part = rows[at : at + step]
                for k, path in zip(part, self._equal(length, [words[k] for k in part]), strict=True):
                    out[k] = path
        return out

    def _equal(self, length: int, words: list[str]) -> list[np.ndarray]:
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64)
        found: list[np.ndarray] = []  # by piece length, [word, start] ids or -1
        h = np.zeros((n, length), np.uint64)
        for size in range(1, min(length, self.longest) + 1):
            h = (h[:, : length - size + 1] ^ (codes[:, size - 1 :] + np.uint64(1))) * _FACTOR
            h ^= h >> np.uint64(32)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found.append(np.where(self.keys[at] == h, self.ids[at], -1))
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -1, np.int64)  # piece that ends there; -1: start, or a character without a piece
        back = np.zeros((length + 1, n), np.int32)
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                start = end - size
                piece = found[size - 1][:, start]
                if self.kind == MERGES:
                    fits = (piece >= 0) & (best[start] > -np.inf)
                    if size > 1:
                        fits[fits] = self.whole[piece[fits]]
                    check = np.flatnonzero(fits & (last[start] >= 0))
                    if len(check):
                        fits[check] = self.neighbours(last[start][check], piece[check])
                    total = np.where(fits, 0.0, -np.inf)
                    if size == 1:
                        total = np.where((piece < 0) & (best[start] > -np.inf), 0.0, total)
                else:
                    total = best[start] + np.where(piece >= 0, self.score[piece], self.unknown_score if size == 1 else -np.inf)
                better = total > best[end]
                best[end][better], last[end][better], back[end][better] = total[better], piece[better], size
        return self._paths(length, n, last, back)

    def _paths(self, length: int, n: int, last: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        at, rows = np.full(n, length), np.arange(n)
        steps: list[np.ndarray] = []
        while len(rows):
            piece = np.full(n, -2, np.int64)
            piece[rows] = last[at[rows], rows]
            steps.append(piece)
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        turned = np.array(steps[::-1]).T  # [word, step], -2: none
        used = turned != -2
        return [turned[k][used[k]] for k in range(n)]

    def _ids(self, word: str, path: np.ndarray) -> bytes:
        plain = not len(path) or (path.min() >= 0 and path.max() < len(self.entries))
        return path.astype("<u4").tobytes() if plain else self._fallback(word, path)

    def _fallback(self, word: str, ids: np.ndarray) -> bytes:
        """A path with characters that have no piece, as bytes or unknown ids (a run of which is one in unigram models)."""
        out: list[int] = []
        at = 0
        for i in ids.tolist():
            if 0 <= i < len(self.entries):
                out.append(i)
                at += len(self.entries[i][0])
                continue
            raw = word[at].encode("utf-8", "replace")
            at += 1
            if self.bytes:
                out += [self.bytes[b] for b in raw]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()


def load(path: str) -> Pieces:
    """Pieces of a model file that has no normalisation rules but the white-space mark (name identity)."""
    entries, kind, normal = [], UNIGRAM, {}
    with open(path, "rb") as file:
        for number, value in proto_fields(file.read()):
            if number == 1:
                own = dict(proto_fields(value))
                entries.append((own[1].decode("utf-8"), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
            elif number == 2:
                kind = dict(proto_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normal = dict(proto_fields(value))
    if kind not in (UNIGRAM, MERGES):
        raise ValueError(f"a model of type {kind}")
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("a model that rewrites characters or white space")
    return Pieces(entries, kind, bool(normal.get(3, 1)))


class Codec:
    """Encodes and decodes whole texts; words are kept for each worker, in two generations."""

    def __init__(self, pieces: Pieces, remembered: int = 900_000):
        self.pieces, self.limit = pieces, remembered // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.texts = [p.replace(MARK, " ").encode() if t in (Pieces.NORMAL, Pieces.USER) else bytes([int(p[3:5], 16)]) if t == Pieces.BYTE else " ⁇ ".encode() if t == Pieces.UNKNOWN else b"" for p, _, t in pieces.entries]

    def words(self, text: str) -> list[str]:
        """Words with their marks. A newline begins a word where no piece holds one, so that lines share words."""
        if not text:
            return []
        if self.pieces.dummy_prefix and "  " not in text and text[0] != " " and MARK not in text:
            if "\n" in text and self.pieces.lone_newline:
                parts = text.replace("\n", " \n").split(" ")
                return [p if p[:1] == "\n" else MARK + p for p in parts] if text[0] != "\n" else [MARK, *(p if p[:1] == "\n" else MARK + p for p in parts[1:])]
            return [MARK + p for p in text.split(" ")]
        return _WORDS.findall(MARK * self.pieces.dummy_prefix + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.words(t) for t in texts]
        new, old = self.new, self.old
        absent: dict[str, None] = {}
        for words in parts:
            for w in set(words):
                if w not in new:
                    if w in old:
                        new[w] = old[w]
                    else:
                        absent[w] = None
        todo = iter(absent)
        while batch := list(islice(todo, 50_000)):
            new.update(zip(batch, self.pieces.encode_words(batch), strict=True))
        find = new.__getitem__
        out = [b"".join(map(find, words)) for words in parts]
        for w in absent:
            if len(w) > LONGEST_KEPT:
                del new[w]
        if len(new) > self.limit:
            self.new, self.old = {}, new
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.pieces.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One for each worker process."""
    return worker_state(("pieces", path), lambda: Codec(load(path)))


DIGEST = "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encoded(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of ints) of each whole text."""

    @F.pandas_udf("array<int>")
    def run(texts):
        import pandas as pd

        from tessera.llm.tokens import in_groups

        return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for _, group in in_groups(texts.tolist()) for x in codec(model_path).encode(group)])

    return documents.select("doc_id", run(F.col("text").cast("string")).alias("ids"))


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give null."""

    @F.pandas_udf("string")
    def run(ids):
        import pandas as pd

        return pd.Series([None if x is None else codec(model_path).decode(np.asarray(x, "<u4").tobytes()) for x in ids])

    return rows.select("doc_id", run("ids").alias("text"))


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """Rows of DIGEST: each whole text is encoded, its ids decoded again, and both summed up."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.tokens import in_groups

        own = codec(model_path)
        for batch in batches:
            ids = batch.column(0)
            for at, texts in in_groups(batch.column(1).to_pylist()):
                found = own.encode(texts)
                back = [own.decode(x) for x in found]
                columns = [[len(x) // 4 for x in found], [zlib.crc32(x) for x in found], [zlib.crc32(t.encode()) for t in back]]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), *(pa.array(c, pa.int64()) for c in columns), pa.array([a == b for a, b in zip(texts, back, strict=True)])], names=[x.split()[0] for x in DIGEST.split(", ")])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)
