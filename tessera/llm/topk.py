"""Exact top-k inner products by a bit-sliced index.

Components are quantised to floor(256 x). The index holds blocks of vectors as bit slices: for each
dimension and binary place a bitmap over the block's rows. A query's weights are added in
bitmap arithmetic: each set bit of a weight puts a dimension's slices, shifted, on a pile by
binary place, and full adders over whole piles turn three bitmaps into two until a sum of one bitmap a place is left.
Negative weights take the complemented slices, so all terms are positive and a
constant brings the sum back. The k best rows are selected from the most significant slice downward; the boundary
rows, which tie, are resolved by vec_id. Of the blocks' results, each task keeps a query's k best before they are dealt out by query.

The query set meets all rows in a grid of blocks (``BLOCK`` rows, ``ASKED`` queries), so no task holds more than one
block of each, however many there are and however alike.

Defined results: vectors that are null, hold null or non-finite components, or have a null vec_id take no part;
vectors of unequal dimension are filled up with zeros; rows, not ids, are asked and found: each row of a repeated query id is a query with ranks of its
own, and only that row is no candidate of it; rows with equal scores and ids come in any order; fewer candidates give fewer rows; a block whose scores might not fit in a long
raises an error; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of the index.
BLOCK = 4096
#: Queries that meet a block in one task.
ASKED = 8192
SCHEMA = "query_row long, query_id long, vec_id long, score long"


class SlicedBlock:
    """The bit slices of a block of quantised vectors (rows of integers)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        """``rows`` numbers the vectors; a vector's own id does where it isn't given."""
        order = np.argsort(ids, kind="stable")  # rows by id: the first of tied rows is the smallest id
        self.ids, self.n = ids[order], len(ids)
        self.place = {int(r): i for i, r in enumerate((ids if rows is None else rows)[order])}
        vectors = vectors[order]
        self.low = int(vectors.min()) if vectors.size else 0
        self.bits = max(1, int(vectors.max() - self.low).bit_length()) if vectors.size else 1
        self.words = -(-self.n // 64)
        shifted = (vectors - self.low).astype(np.uint64).T  # [dimension, row], never negative
        padded = np.zeros((shifted.shape[0], self.words * 64), np.uint64)
        padded[:, : self.n] = shifted
        slices = [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(self.bits)]
        self.slices = np.stack(slices, axis=1)  # [dimension, bit, word]
        self.inverse = ~self.slices
        used = np.zeros(self.words * 64, np.uint8)
        used[: self.n] = 1
        self.rows = np.packbits(used, bitorder="little").view(np.uint64)

    def added(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(bitmaps of the sum's binary places, lowest first; what to add to it for the inner product)."""
        places = self.bits + int(np.abs(query).max(initial=0)).bit_length()
        piles: list[list[np.ndarray]] = [[] for _ in range(places + 1)]
        constant = self.low * int(query.sum())
        top = (1 << self.bits) - 1
        size = np.abs(query)
        for sign, slices in ((1, self.slices), (-1, self.inverse)):
            own = np.sign(query) == sign
            if sign < 0:
                constant -= top * int(size[own].sum())
            for j in range(int(size.max(initial=0)).bit_length()):
                dims = np.flatnonzero(own & (size >> j & 1 == 1))
                if len(dims):
                    for b in range(self.bits):
                        piles[j + b].append(slices[dims, b])
        out, carried = [], []
        place = 0
        while place < len(piles) or carried:
            pile = np.concatenate([*(piles[place] if place < len(piles) else []), *carried]) if place < len(piles) and piles[place] or carried else None
            carried = []
            if pile is None:
                out.append(np.zeros(self.words, np.uint64))
            else:
                while len(pile) > 1:
                    third = len(pile) // 3
                    if third:
                        a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                        half = a ^ b
                        carried.append(a & b | half & c)
                        pile = np.concatenate([half ^ c, pile[3 * third :]])
                    else:
                        carried.append((pile[0] & pile[1])[None])
                        pile = (pile[0] ^ pile[1])[None]
                out.append(pile[0])
            place += 1
        return out, constant

    def best(self, query: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k rows of the highest inner product with the query, ties to the smaller id; the row numbered ``without`` isn't looked at."""
        sums, constant = self.added(query)
        alive = self.rows.copy()
        if without in self.place:
            r = self.place[without]
            alive[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        chosen, tied, need = np.zeros_like(alive), alive, min(k, int(np.bitwise_count(alive).sum()))
        for slice_ in reversed(sums):  # the rows that are surely in, and those still level, place by place
            ones = tied & slice_
            n = int(np.bitwise_count(ones).sum())
            if n > need:
                tied = ones
            else:
                chosen, need, tied = chosen | ones, need - n, tied & ~slice_
                if not need:
                    break
        rows = _positions(chosen)
        if need:
            rows = np.concatenate([rows, _positions(tied)[:need]])
        scores = np.full(len(rows), constant, np.int64)
        for b, slice_ in enumerate(sums):
            scores += (slice_[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
        order = np.lexsort((self.ids[rows], -scores))
        return self.ids[rows[order]], scores[order]


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _range(vectors: np.ndarray) -> int:
    """A bound of a component's size once the smallest is taken off."""
    return 2 * int(np.abs(vectors).max(initial=0)) + 1


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v: quantised components) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter("vec_id is not null and embedding is not null")
    return own.filter(~F.coalesce(bad.alias("bad"), F.lit(True))).select("vec_id", F.transform("embedding", lambda e: F.floor(e * 256).cast("long")).alias("v"))


def search(embeddings: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best others of each vector for which ``is_query``, of vec_id, holds."""
    from tessera.llm.common import stored

    own = stored(usable(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = stored(own.filter(is_query), "queries")
    blocks, parts = (max(1, -(-x.count() // y)) for x, y in ((own, block), (queries, asked)))

    def dealt(df: DataFrame, name: str, n: int, other: str, copies: int) -> DataFrame:
        """Rows of a stored table by turns into ``n`` groups, so that equal rows spread; then a copy for each group of the other side.

        The turn is taken in a projection of its own: beside the copies it would differ from copy to copy.
        """
        turn = df.select("row", "vec_id", "v", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias(name))
        return turn.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    index = dealt(own, "block", blocks, "part", parts)
    questions = dealt(queries, "part", parts, "block", blocks)

    def rows(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = table.column("v").combine_chunks()
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        wide = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
        wide[np.arange(wide.shape[1]) < lengths[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        return table.column("row").to_numpy(), table.column("vec_id").to_numpy(), wide

    def run(left, right):
        import pyarrow as pa

        (own_rows, ids, vectors), (q_rows, q_ids, q_vectors) = rows(left), rows(right)
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(ids) and len(q_ids):
            width = max(vectors.shape[1], q_vectors.shape[1])
            vectors, q_vectors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, q_vectors))
            if width * _range(vectors) * _range(q_vectors) >= 1 << 62:
                raise ValueError("inner products might not fit in a long")
            sliced = SlicedBlock(ids, vectors, own_rows)
            for r, q, v in zip(q_rows, q_ids, q_vectors, strict=True):
                found, scores = sliced.best(v, k, int(r))
                for x, y in zip(out, (np.full(len(found), r), np.full(len(found), q), found, scores), strict=True):
                    x.append(y)
        return pa.table([pa.array(np.concatenate(x or [np.zeros(0)]).astype(np.int64)) for x in out], names=[x.split()[0] for x in SCHEMA.split(", ")])

    cell = ("block", "part")
    met = index.groupBy(*cell).cogroup(questions.groupBy(*cell)).applyInArrow(run, SCHEMA)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # Spark keeps the k best of each task before the exchange
    return ranked.select("query_id", "rank", "vec_id", "score")
