"""SimHash fingerprints of documents and all links within a Hamming distance, by the generalised pigeonhole principle.

Bits that go together are grouped into partitions. Of partition thresholds whose sum is
distance - partitions + 1 (-1: the partition is left out), each fingerprint takes those with the
fewest candidates, found by dynamic programming over counts estimated from a fixed-size
summary of all fingerprints. It probes the index by every value within a partition's threshold, and pairs met are verified.

The number of partitions follows the number of fingerprints (``partitions_for``): fewer and wider ones as it grows, so that a probe keeps meeting few others.

Work is over distinct fingerprints, so copies cost nothing. In a crowd of near fingerprints, which no partition thins out, a fingerprint whose probes would
meet more than ``dense`` others isn't probed by its partitions: all such ones (their share is logged)
instead write down the fingerprints within half the distance, and two within the distance share one of them.
A pair with one dense member is found from the other, so no link is lost, and rows stay linear in the input.

Defined results: null text counts as empty, whose fingerprint is zero and links like any other; a null doc_id is
kept in its component and never names one unless it has no other; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, drop_stored, fresh, stored

BITS = 64
#: Others that a fingerprint's probes may meet before it counts as dense.
DENSE = 64
#: Bits of a block of the summary: 2 ** 11 counters.
SUMMARY_BITS = 11
SPACE = " \t\n\v\f\r"
_LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    import re

    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) < 3:
        h = np.array([xxh64_intdigest(" ".join(words), 42)], "<u8")
    else:
        h = np.fromiter((xxh64_intdigest(f"{a} {b} {c}", 42) for a, b, c in zip(words, words[1:], words[2:], strict=False)), "<u8", len(words) - 2)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes, as an unsigned integer; zero for none."""
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(texts) -> np.ndarray:
    """Fingerprints as signed 64-bit integers, which Spark's longs are."""
    return np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)


def with_fingerprint(documents: DataFrame, name: str = "_fp") -> DataFrame:
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("long")
    def run(texts):
        import pandas as pd

        return pd.Series(fingerprints(texts))

    return documents.withColumn(name, run(F.col("text").cast("string")))


# -- partitions and thresholds


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partitions_for(n: int, distance: int) -> int:
    """The number of partitions at which ``n`` fingerprints cost least: the probes of one, and what they would meet if bits were even.

    With m partitions thresholds sum up to distance - m + 1; they are dealt evenly here, partitions beyond that sum being left out.
    """

    def cost(m: int) -> float:
        total, out = distance + 1, 0.0
        for i in range(m):
            width = BITS // m
            t = total // m + (i < total % m) - 1
            probes = sum(comb(width, r) for r in range(t + 1))
            out += probes + probes * n / 2.0**width
        return out

    return min(range(1, distance + 2), key=cost)


def co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number, 64 x 64 counts of bits set together) of all fingerprints; sums of tasks, a fixed size each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells.astype(np.int64))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, together: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits dealt to partitions of even size, each next one to the bits that it goes with most."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(strength, 0)
    left, out = list(range(BITS)), []
    for k in range(partitions):
        size = len(left) // (partitions - k)
        sub = strength[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.sum(axis=1)))]]
        left.remove(group[0])
        while len(group) < size:
            best = left[int(np.argmax(strength[np.ix_(left, group)].sum(axis=1)))]
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def _packed(bits: np.ndarray, which: list[int]) -> np.ndarray:
    """The named bits of rows of bits, as integers."""
    return bits[:, which].astype(np.int64) @ (1 << np.arange(len(which), dtype=np.int64))


def blocks_of(groups: list[list[int]]) -> list[list[list[int]]]:
    """Each partition's bits in blocks of SUMMARY_BITS at most."""
    return [[list(b) for b in np.array_split(g, -(-len(g) // SUMMARY_BITS))] for g in groups]


def summary(fps: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """For each partition's blocks, how many fingerprints have each value: at most 2 ** SUMMARY_BITS counters a block."""
    blocks = blocks_of(groups)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = [[np.zeros(1 << len(b), np.int64) for b in p] for p in blocks]
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            for p, own in zip(blocks, sums, strict=True):
                for b, s in zip(p, own, strict=True):
                    s += np.bincount(_packed(x, b), minlength=len(s))
        at = 0
        for s in (s for own in sums for s in own):
            used = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(used + at, pa.int32()), pa.array(s[used])], names=["cell", "n"])
            at += len(s)

    flat = np.zeros(sum(1 << len(b) for p in blocks for b in p), np.int64)
    for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[r["cell"]] = r["n"]
    out, at = [], 0
    for p in blocks:
        out.append([])
        for b in p:
            out[-1].append(flat[at : at + (1 << len(b))])
            at += 1 << len(b)
    return out


@lru_cache(maxsize=64)
def _masks(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64).view(np.int64)


def _near_share(counts: np.ndarray, width: int, radius: int, n: int) -> list[np.ndarray]:
    """For each value of a block, the share of fingerprints at distance 0, 1, ... radius exactly."""
    values, out = np.arange(1 << width), []
    for r in range(radius + 1):
        masks = np.setdiff1d(_masks(width, r), _masks(width, r - 1) if r else np.array([], np.int64))
        out.append(sum(counts[values ^ m] for m in masks) / max(n, 1) if len(masks) else np.zeros(len(values)))
    return out


def estimates(groups: list[list[int]], sums: list[list[np.ndarray]], n: int, radius: int):
    """A function from rows of bits to estimated candidates [partition][threshold 0 .. radius], blocks taken as independent."""
    blocks = blocks_of(groups)
    shares = [[_near_share(s, len(b), radius, n) for b, s in zip(p, own, strict=True)] for p, own in zip(blocks, sums, strict=True)]

    def run(bits: np.ndarray) -> np.ndarray:
        out = np.empty((len(groups), radius + 1, len(bits)))
        for i, (p, own) in enumerate(zip(blocks, shares, strict=True)):
            exact = [np.ones(len(bits))] + [np.zeros(len(bits))] * radius
            for b, share in zip(p, own, strict=True):
                at = _packed(bits, b)
                exact = [sum(exact[r - q] * share[q][at] for q in range(r + 1)) for r in range(radius + 1)]
            out[i] = np.cumsum(exact, axis=0) * n
        return out

    return run


def allocated(estimate: np.ndarray, widths: list[int], distance: int, probe_cost: float = 1.0) -> np.ndarray:
    """Thresholds [partition, row] of least cost (estimated candidates and probes) whose sum is distance - partitions + 1."""
    m, radii, rows = estimate.shape
    total = distance + 1  # each threshold counts one more than itself, so -1 is 0 and the sums are distance + 1
    best = np.full((total + 1, rows), np.inf)
    best[0] = 0
    took = np.zeros((m, total + 1, rows), np.int8)
    for i in range(m):
        cost = [np.zeros(rows)] + [estimate[i, t] + probe_cost * len(_masks(widths[i], t)) for t in range(radii)]
        after = np.full_like(best, np.inf)
        for s in range(total + 1):
            for t in range(min(s, radii) + 1):
                c = best[s - t] + cost[t]
                better = c < after[s]
                after[s] = np.where(better, c, after[s])
                took[i, s] = np.where(better, t, took[i, s])
        best = after
    out, s = np.empty((m, rows), np.int8), np.full(rows, total)
    for i in range(m - 1, -1, -1):
        t = took[i, s, np.arange(rows)]
        out[i] = t - 1
        s = s - t
    return out


# -- links


def links(fps: DataFrame, distance: int = 2, partitions: int | None = None, dense: int = DENSE, crowds: bool = True) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): every pair within ``distance`` is linked, directly
    or, where both are dense, through a chain of such pairs. ``fps`` is read several times and should be stored.

    Without ``crowds`` pairs of two dense ones are left to the caller, and any distance can be asked for.
    """
    n, together = co_occurrence(fps)
    partitions = partitions or partitions_for(n, distance)
    groups = grouped_bits(n, together, partitions)
    widths = [len(g) for g in groups]
    radius = distance
    guess = estimates(groups, summary(fps, groups), n, radius)

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            x = _bits(fp)
            for i, g in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i), pa.int32()), pa.array(_packed(x, g)), pa.array(fp)], names=["part", "value", "fp"])

    def probes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                x = _bits(fp)
                thresholds = allocated(guess(x), widths, distance)
                for i, g in enumerate(groups):
                    value = _packed(x, g)
                    for t in range(radius + 1):
                        rows = np.flatnonzero(thresholds[i] == t)
                        if len(rows):
                            masks = _masks(len(g), t)
                            probe = (value[rows, None] ^ masks).ravel()
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(probe), i), pa.int32()), pa.array(probe), pa.array(np.repeat(fp[rows], len(masks)))], names=["part", "value", "q"])

    index = fps.select("fp").mapInArrow(keys, "part int, value long, fp long")
    asked = stored(fps.select("fp").mapInArrow(probes, "part int, value long, q long"), "probes")
    sizes = stored(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")), "sizes")
    met = asked.join(sizes, ["part", "value"]).groupBy("q").agg(F.sum("n").alias("n"))
    crowded = stored(met.filter(F.col("n") > dense).select("q"), "dense")
    logging.getLogger(__name__).info("%d of %d fingerprints are dense in %d partitions", crowded.count(), n, partitions)
    # Probes of the others meet only values that at most ``dense`` fingerprints have.
    sparse = asked.join(crowded, "q", "left_anti")
    thin = index.join(sizes.filter(F.col("n") > dense).select("part", "value"), ["part", "value"], "left_anti")
    pairs = sparse.join(thin, ["part", "value"]).filter((F.col("q") != F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= distance))
    pairs = pairs.select(F.col("q").alias("a"), F.col("fp").alias("b"))
    pairs._tessera_parts = (asked, sizes, crowded)  # for drop_stored, once the pairs have been read
    if not crowds:
        return pairs

    half = (distance + 1) // 2
    marks = _masks(BITS - 1, half) if half else np.zeros(1, np.int64)

    def around(batches: Iterator) -> Iterator:
        import pyarrow as pa

        top = np.int64(-(1 << 63))
        masks = np.concatenate([marks, np.array([m ^ top for m in _masks(BITS - 1, half - 1)], np.int64)]) if half else marks
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ masks).ravel()), pa.array(np.repeat(fp, len(masks)))], names=["near", "fp"])

    if distance % 2:
        raise ValueError("an even distance is asked for: the balls of dense fingerprints have half of it")
    balls = crowded.mapInArrow(around, "near long, fp long")
    least = balls.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("_most")).filter(F.col("a") != F.col("_most"))
    # A ball's centre has few members, of any data, so they are met without a hot key.
    dense_pairs = balls.join(least.select("near", "a"), "near").filter(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(dense_pairs)


def components(documents: DataFrame, distance: int = 2, partitions: int | None = None, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id linked by any chain) of each document."""
    fps, labels = _labels(documents, distance, partitions, dense)
    out = fps.join(labels, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labels(documents: DataFrame, distance: int, partitions: int | None, dense: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp of each document), (fp, root, component_id, n: rows of the component that have its component_id)."""
    from tessera.llm.components import components as connected

    rows = with_fingerprint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp").select("doc_id", "fp")
    rows = stored(rows, "fingerprints")

    def first(column: str) -> Column:
        """The smallest id, null last, with its number of rows."""
        return F.min(F.struct(F.col(column).isNull().alias("z"), F.col(column).alias("id"), "n"))

    by_id = rows.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = by_id.groupBy("fp").agg(first("doc_id").alias("f")).select("fp", F.col("f.id").alias("first"), F.col("f.n").alias("n"))
    firsts = stored(firsts, "distinct")
    roots = connected(links(firsts, distance, partitions, dense))
    tied = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    per_id = tied.groupBy("root", "first").agg(F.sum("n").alias("n"))
    least = per_id.groupBy("root").agg(first("first").alias("f"))
    least = stored(least.select("root", F.col("f.id").alias("component_id"), F.col("f.n").alias("n")), "least")
    labels = stored(tied.select("fp", "root").join(least, "root").select("fp", "root", "component_id", "n"), "labels")
    drop_stored(firsts, roots, least)
    return rows, labels


def keep_first(documents: DataFrame, distance: int = 2, partitions: int | None = None, dense: int = DENSE) -> DataFrame:
    """The documents, with all their columns, that come first (by doc_id) in their component: one row for each."""
    _, labels = _labels(documents, distance, partitions, dense)
    of, fp, root, component_id, n = fresh(documents, "_print", *labels.columns)
    own = labels.select(*(F.col(c).alias(a) for c, a in zip(labels.columns, (fp, root, component_id, n), strict=True)))
    met = with_fingerprint(documents, of).join(own, F.col(of) == F.col(fp))
    met = met.filter(F.col("doc_id").eqNullSafe(F.col(component_id)))
    once, again = met.filter(F.col(n) == 1), met.filter(F.col(n) > 1).dropDuplicates([root])
    return once.unionByName(again).select(*documents.columns)
