"""Removal of passages that repeat across or within documents, by line hashing and, inside lines, by winnowed word windows.

Units are lines of 20 words or more, normalised and hashed, and marks: every window of ``WINDOW`` words is hashed, and of any ``WITHIN``
neighbours the smallest hash is a mark, so each repeated stretch of 20 words or more holds a mark that both of its places have, whatever lines, sentences or script it stands in.
Digests are grouped globally; the earliest ranked occurrence is kept: the smallest (doc_id, hash of the text, position). A later line goes as it is. A later mark
is extended on both sides, word by word, against the words around the kept one, and joined with its neighbours of
the same alignment. What is removed is thus whole repeated lines and contiguous stretches of one earlier document, of ``least_words`` words at least.

Words are compared without regard to case and white space. Removed stretches are returned as offsets (code points, end exclusive) into the original text.

Defined results: null text gives null text and no removals; empty text stays; rows with a null doc_id take no part
and come back whole; repeated rows (one doc_id and text) count as one document; other columns are kept
by ``deduplicated`` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LONGEST_KEPT, bounded_batches, drop_stored, fresh, stored, worker_state

#: Repeated stretches of fewer words stay.
LEAST_WORDS = 20
SPANS = "array<struct<start:int,end:int>>"
#: WINDOW + WITHIN - 1 is the length from which on a repeated stretch is sure to hold a common mark: LEAST_WORDS.
WINDOW, WITHIN = 12, 9
#: Words on each side of a kept mark that later ones are held against; the next mark is at most WITHIN words away.
AROUND = 24
REMEMBERED = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\S+")


def text_hash(text: str) -> int:
    """Spark's xxhash64 of a text."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(text, 42)).view(np.int64))


def _hashed(words: list[str], known: dict | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    known = {} if known is None else known
    if len(known) > REMEMBERED:
        known.clear()
    long = []
    for w in set(words):
        if w not in known:
            known[w] = xxh64_intdigest(w)
            if len(w) > LONGEST_KEPT:
                long.append(w)
    out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    for w in long:
        del known[w]
    return out


def word_hashes(text: str, known: dict | None = None) -> np.ndarray:
    return _hashed(text.lower().split(), known)


def units(text: str, known: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, lengths in words, signed 64-bit digests) of a text's marks and of its lines of LEAST_WORDS words or more."""
    parts = [line.split() for line in text.lower().split("\n")]
    words = _hashed(list(chain.from_iterable(parts)), known)
    at, found = marks(words)
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    long = n >= LEAST_WORDS
    if not long.any():
        return at, np.full(len(at), WINDOW, np.int32), found
    starts = (np.cumsum(n) - n)[long]
    n = n[long]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = (words[np.repeat(starts, n) + place] + place.astype(np.uint64)) * _P
    own = (own ^ (own >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    own ^= own >> np.uint64(29)
    lines = (np.add.reduceat(own, np.cumsum(n) - n) + n.astype(np.uint64)) * _P
    lines ^= lines >> np.uint64(31)
    return np.concatenate([at, starts]).astype(np.int32), np.concatenate([np.full(len(at), WINDOW), n]).astype(np.int32), np.concatenate([found, lines.view(np.int64)])


def _extreme(h: np.ndarray, size: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) over every ``size`` neighbours, by windows of twice the size each time."""
    span = 1
    while 2 * span <= size:
        h, span = of(h[:-span], h[span:]), 2 * span
    return of(h[: len(h) - (size - span)], h[size - span :]) if span < size else h


def marks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, signed 64-bit digests) of a text's marks."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = (h + words[i : i + n]) * _P
        h ^= h >> np.uint64(29)
    size = min(WITHIN, n)
    least = _extreme(h, size, np.minimum)
    # A hash is a mark if it is the smallest of some stretch that it stands in: not above the largest of their smallest ones.
    wide = np.concatenate([np.zeros(size - 1, np.uint64), least, np.zeros(size - 1, np.uint64)])
    at = np.flatnonzero(h <= _extreme(wide, size, np.maximum)).astype(np.int32)
    return at, h[at].view(np.int64)


def _usable(documents: DataFrame) -> DataFrame:
    some = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return some.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def occurrences(documents: DataFrame) -> DataFrame:
    """(digest, doc_id, text_hash, position, length) of every mark and long line of every text."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = worker_state(("passages",), dict)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                held = []
                for doc_id, value in zip(batch.column(0).slice(start, 500).to_pylist(), batch.column(1).slice(start, 500), strict=True):
                    text = value.as_py()
                    at, length, found = units(text, known)
                    if len(at):
                        held.append((found, doc_id, text_hash(text), at, length))
                if held:
                    n = [len(x[0]) for x in held]
                    columns = [np.concatenate([x[0] for x in held]), np.repeat([x[1] for x in held], n), np.repeat([x[2] for x in held], n), np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "doc_id", "text_hash", "position", "length"])

    return _usable(documents).mapInArrow(run, "digest long, doc_id long, text_hash long, position int, length int")


def chains(later: DataFrame) -> DataFrame:
    """The later units of each text (doc_id, text_hash, marks): marks joined where they touch at one alignment with one source, as the first and last
    of each chain; a line by itself, without digests, as it needs no extension. ``end`` is behind the last word."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                for r in batch.slice(start, 500).to_pylist():
                    own = sorted((m["source"], m["position"] - m["of_position"], m["position"], m["digest"]) for m in r["marks"] if m["length"] == WINDOW)
                    rows += [(r["doc_id"], r["text_hash"], m["source"], m["position"] - m["of_position"], m["position"], m["position"] + m["length"], None, None) for m in r["marks"] if m["length"] != WINDOW]
                    first = 0
                    for i, m in enumerate(own):
                        after = own[i + 1] if i + 1 < len(own) else None
                        if after is None or after[:2] != m[:2] or after[2] > m[2] + WINDOW:
                            rows.append((r["doc_id"], r["text_hash"], m[0], m[1], own[first][2], m[2] + WINDOW, own[first][3], m[3]))
                            first = i + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if 3 <= k <= 5 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "text_hash", "source", "shift", "first", "end", "first_digest", "last_digest"])

    return later.mapInArrow(run, "doc_id long, text_hash long, source long, shift int, first int, end int, first_digest long, last_digest long")


def surroundings(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """(digest, before, after) of kept marks (digest, of_doc, of_text, of_position): the words around them, as 32-bit hashes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = worker_state(("passages",), dict)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                rows: list[tuple] = []
                for r in batch.slice(start, 100).to_pylist():
                    words = (word_hashes(r["text"], known) >> np.uint64(32)).astype("<u4")
                    for m in r["marks"]:
                        p = m["of_position"]
                        rows.append((m["digest"], words[max(0, p - AROUND) : p].tobytes(), words[p + WINDOW : p + WINDOW + AROUND].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["digest", "before", "after"])

    per_text = kept.groupBy("of_doc", "of_text").agg(F.collect_list(F.struct("digest", "of_position")).alias("marks"))
    own = _usable(documents)
    met = own.join(per_text, (F.col("doc_id") == F.col("of_doc")) & (F.xxhash64("text") == F.col("of_text"))).select("text", "marks")
    return met.mapInArrow(run, "digest long, before binary, after binary").dropDuplicates(["digest"])


def later_chains(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, chains) of the units that are later occurrences: each chain with the words around the kept one."""
    every = stored(occurrences(documents), "marks")
    place = F.struct("doc_id", "text_hash", "position")
    # Counts and first places are made in each task before they are dealt out, so a hot mark costs no task more.
    firsts = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter(F.col("n") > 1)
    firsts = stored(firsts.select("digest", F.col("first.doc_id").alias("of_doc"), F.col("first.text_hash").alias("of_text"), F.col("first.position").alias("of_position")), "repeated")
    later = every.join(firsts, "digest").filter(place != F.struct("of_doc", "of_text", "of_position"))
    mark = F.struct("position", "length", "digest", F.xxhash64("of_doc", "of_text").alias("source"), "of_position")
    found = stored(chains(later.groupBy("doc_id", "text_hash").agg(F.collect_set(mark).alias("marks"))), "chains")
    drop_stored(every)
    # Only the ends of chains are extended, so only their words are fetched.
    ends = found.select(F.explode(F.array("first_digest", "last_digest")).alias("digest")).filter("digest is not null").distinct()
    around = stored(surroundings(documents, firsts.join(ends, "digest", "left_semi")), "around")
    drop_stored(firsts)
    met = found.join(around.select(F.col("digest").alias("first_digest"), "before"), "first_digest", "left").join(around.select(F.col("digest").alias("last_digest"), "after"), "last_digest", "left")
    own = stored(met.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "end", "source", "shift", "before", "after")).alias("chains")), "later")
    drop_stored(found)
    drop_stored(around)
    return own


def _left(words: np.ndarray, p: int, before: bytes) -> int:
    b = np.frombuffer(before, "<u4")
    m = min(p, len(b))
    other = np.flatnonzero(words[p - m : p] != b[len(b) - m :])
    return m - 1 - int(other[-1]) if len(other) else m


def _right(words: np.ndarray, e: int, after: bytes) -> int:
    a = np.frombuffer(after, "<u4")
    m = min(len(words) - e, len(a))
    other = np.flatnonzero(words[e : e + m] != a[:m])
    return int(other[0]) if len(other) else m


def stretches(words: np.ndarray, later, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(first word, end) of the stretches to remove, in order and apart, by chains (first, end, source, shift, words before, words after)."""
    runs: list[tuple[int, int]] = []
    by: dict = {}
    for c in later:
        by.setdefault((c[2], c[3]), []).append(c)
    for group in by.values():
        start = end = None
        for first, last, _, _, before, after in sorted(group, key=lambda c: c[0]):
            reach = first - _left(words, first, before or b"")
            if end is not None and reach > end:
                runs.append((start, end))
                end = None
            if end is None:
                start, end = reach, last
            start, end = min(start, reach), max(end, last + _right(words, last, after or b""))
        runs.append((start, end))
    out: list[tuple[int, int]] = []
    for a, b in sorted(r for r in runs if r[1] - r[0] >= least_words):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, later, least_words: int = LEAST_WORDS, known: dict | None = None) -> tuple[str, list[tuple[int, int]], int, int]:
    """(text that is left, removed spans, words, words removed) when the chains ``later`` are later occurrences."""
    if not len(later):
        return text, [], len(text.split()), 0
    words = (word_hashes(text, known) >> np.uint64(32)).astype("<u4")
    runs = stretches(words, later, least_words)
    if not runs:
        return text, [], len(words), 0
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    removed = [(at[a][0], at[b - 1][1]) for a, b in runs]
    parts, end = [], 0
    for a, b in [*removed, (len(text), len(text))]:
        parts.append(text[end:a])
        end = b
    out = parts[0].rstrip() if removed[0][0] else ""
    for i, after in enumerate(parts[1:], 1):  # of the white space on both sides of a cut, one newline or space stays
        body = after.strip() if i < len(parts) - 1 else after.lstrip()
        before = parts[i - 1]
        space = before[len(before.rstrip()) :] + after[: len(after) - len(after.lstrip())]
        out += (("\n" if "\n" in space else " ") if out and body else "") + body
    return out, removed, len(words), sum(b - a for a, b in runs)


def _cut_column(least_words: int):
    @F.pandas_udf(f"text string, n_units int, n_removed_units int, removed_spans {SPANS}")
    def run(texts, later):
        import pandas as pd

        known = worker_state(("passages",), dict)
        rows = []
        for t, p in zip(texts, later, strict=True):
            own = [] if p is None else [(c["first"], c["end"], c["source"], c["shift"], c["before"], c["after"]) for c in p]
            text, spans, n, gone = (None, [], 0, 0) if t is None else cut(t, own, least_words, known)
            rows.append((text, n, gone, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=["text", "n_units", "n_removed_units", "removed_spans"])

    return run


def _met(documents: DataFrame, least_words: int) -> DataFrame:
    if least_words < WINDOW + WITHIN - 1:
        raise ValueError(f"passages of at least {WINDOW + WITHIN - 1} words are found")
    doc_id, of, chains_, cut_ = fresh(documents, "_doc_id", "_text_hash", "_chains", "_cut")
    later = later_chains(documents).select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(of), F.col("chains").alias(chains_))
    own = (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(of))
    return documents.join(later, own, "left").select(*documents.columns, _cut_column(least_words)(F.col("text").cast("string"), F.col(chains_)).alias(cut_))


def removals(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, the text that is left, numbers of units (words) and of removed units, and removed spans, for every document."""
    return _met(documents.select("doc_id", "text"), least_words).select("doc_id", "_cut.*")


def deduplicated(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with repeated passages cut out of ``text`` (n_chars follows it, if there is such a column); all rows and columns stay."""
    met = _met(documents, least_words)
    (cut_,) = set(met.columns) - set(documents.columns)
    taken = {"text": F.col(f"{cut_}.text")}
    if "n_chars" in documents.columns:
        taken["n_chars"] = F.length(f"{cut_}.text").cast(documents.schema["n_chars"].dataType)
    return met.select(*(taken[c].alias(c) if c in taken else F.col(c) for c in documents.columns))
