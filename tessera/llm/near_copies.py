"""Near copies as pairs of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 at least.

SimHash fingerprints of the sets come first: those within ``REACH`` bits meet by the generalised pigeonhole of ``simhash``. At this similarity fingerprints can
differ in 16 bits, where partitions leave out hardly any pair, so MinHash bands bring the other candidates together: a pair
at the limit shares one of the 24 bands of 5 values with probability 0.99993, a closer one more surely. Each candidate's similarity is worked out on the whole sets.

Documents with equal sets count once. In a bucket of at most ``PIVOTS`` documents all pairs are tried. Documents that stand in a larger one, or among crowds of near
fingerprints, meet by prefixes instead (``prefix_pairs``), which is exact: every pair of them that reaches the similarity is met, whatever bucket or fingerprint they
share. Two that share only common passages aren't met there, so rows don't grow with the square of a bucket. A pair that is already joined by links isn't tried:
with the fingerprints' pairs goes one of each set with the most central set of its large buckets, which joins most of a crowd.

Defined results: null text counts as empty, and empty texts are copies of each other; a text under five words has itself as its only
shingle; a null doc_id is kept only in a component that has no other; one row of repeated ones is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import LONGEST_KEPT, bounded_batches, drop_stored, fresh, stored, worker_state
from tessera.llm.components import components

SHINGLE = 5
BANDS, ROWS = 24, 5
PIVOTS = 16
#: Bits in which the fingerprints of candidates differ at most.
REACH = 4
#: The least similarity, as a fraction of integers.
OF, OUT_OF = 4, 5
#: Cells that count the shingles of crowds, and tasks that count them.
CELLS, COUNTERS = 1 << 18, 8
_P = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS, _SHIFTS = (np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1))
REMEMBERED = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chained(parts) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h + p) * _P
        h = h ^ (h >> np.uint64(29))
    return _mixed(h)


def shingles(text: str | None, known: dict | None = None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; ``known`` remembers hashes of words."""
    from xxhash import xxh64_intdigest

    known = {} if known is None else known
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    long = []
    for w in set(words):
        if w not in known:
            known[w] = xxh64_intdigest(w)
            if len(w) > LONGEST_KEPT:
                long.append(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    for w in long:
        del known[w]
    k = min(SHINGLE, len(words))
    return np.unique(_chained([*(h[i : len(h) - k + 1 + i] for i in range(k)), np.uint64(k)]))


def bands(own: np.ndarray) -> np.ndarray:
    """The buckets of a set of shingle hashes, none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, (own[at : at + 2048] * _MULTIPLIERS + _SHIFTS).min(axis=1))
    rows = (least >> np.uint64(20)).reshape(BANDS, ROWS)
    return _chained([*rows.T, np.arange(BANDS, dtype=np.uint64)]).view(np.int64)


def alike(a: bytes, b: bytes) -> bool:
    """Whether two stored sets reach the least similarity."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    met = len(np.intersect1d(x, y, assume_unique=True))
    return OUT_OF * met >= OF * (len(x) + len(y) - met)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set: digest of the shingles, fp: their SimHash fingerprint, bands, shingles: sorted 32-bit hashes) of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        known = worker_state(("near copies",), dict)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets, prints, buckets, stores = [], [], [], []
                for text in part.column(2):
                    if len(known) > REMEMBERED:
                        known.clear()
                    own = shingles(text.as_py(), known)
                    buckets.append(bands(own))
                    prints.append(simhash.majority(own))
                    sets.append(xxh64_intdigest(own.tobytes()))
                    stores.append(np.unique((own >> np.uint64(32)).astype("<u4")).tobytes())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(buckets)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64)), lists, pa.array(stores, pa.binary())], names=["doc_id", "text_hash", "set", "fp", "bands", "shingles"])

    bounded_batches(documents.sparkSession)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text_hash long, set long, fp long, bands array<long>, shingles binary")


def _even(k: Column, other: Column) -> Column:
    """Sets of too unequal sizes can't reach the similarity."""
    return OUT_OF * F.least(k, other) >= OF * F.greatest(k, other)


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that reach the least similarity. Only sets that stand in a pair bring their shingles."""

    @F.pandas_udf("boolean")
    def same(x, y):
        import pandas as pd

        return pd.Series([alike(a, b) for a, b in zip(x, y, strict=True)], dtype=bool)

    tried = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    wanted = tried.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    own = stored(rows.select("set", "shingles").join(wanted, "set", "left_semi").dropDuplicates(["set"]), "sets")
    one = own.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    two = own.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    found = stored(tried.join(one, "a").join(two, "b").filter(same("x", "y")).select("a", "b"), "near")
    drop_stored(tried, own)
    return found


def fingerprint_pairs(rows: DataFrame, reach: int = REACH) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs (a, b) of sets with fingerprints within ``reach`` bits, tables to drop once they have been read). A fingerprint's smallest set stands for all
    that have it, and meets each of them. The sets of which pairs are left by that are in ``pairs._tessera_crowd`` (set), for ``prefix_pairs``: those of crowds
    of near fingerprints, and those of fingerprints that have several sets or meet one that has."""
    fps = stored(rows.groupBy("fp").agg(F.min("set").alias("set"), (F.min("set") != F.max("set")).alias("many")), "fingerprints")
    met = simhash.links(fps, reach, crowds=False)
    one, two = (fps.select(F.col("fp").alias(of), F.col("set").alias(to), F.col("many").alias(f"many_{of}")) for of, to in (("a", "x"), ("b", "y")))
    across = met.filter(F.col("a") < F.col("b")).unionByName(met.filter(F.col("a") > F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    across = stored(across.join(one, "a").join(two, "b"), "across")
    several = rows.select("fp", "set").distinct().join(fps.filter("many").select("fp", F.col("set").alias("b")), "fp")
    within = several.filter(F.col("set") != F.col("b")).select(F.col("set").alias("a"), "b")
    pairs = across.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(within)
    dense = met._tessera_parts[-1].select(F.col("q").alias("fp"))
    beside = across.filter(F.col("many_a") | F.col("many_b")).select(F.explode(F.array("a", "b")).alias("fp"))
    crowd = rows.select("fp", "set").join(dense.unionByName(beside).distinct(), "fp").select("set").unionByName(several.select("set"))
    pairs._tessera_crowd = crowd.distinct()
    return pairs, [fps, across, *met._tessera_parts]


def _rarity(sets: DataFrame) -> np.ndarray:
    """For each cell of shingle hashes, the bits of the number of shingles in ``sets`` that fall to it: a fixed size, however many there are."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for own in batch.column(0):
                np.add.at(counts, np.frombuffer(own.as_buffer(), "<u4") % CELLS, 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())], names=["counts"])

    total = np.zeros(CELLS, np.int64)
    for r in sets.select("shingles").coalesce(COUNTERS).mapInArrow(run, "counts binary").collect():
        total += np.frombuffer(r["counts"], "<u4")
    return np.array([int(n).bit_length() for n in total], np.uint8)


def prefix(own: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """A set's shingles that may be the first one shared with a set alike to it, in the order of all sets: rare ones first, then by a hash."""
    most = len(own) - -(-OF * len(own) // OUT_OF) + 1
    return own[np.lexsort((own, own * np.uint32(0x9E3779B1), rarity[own % CELLS]))[:most]]


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (set, shingles, root) with different roots, among them all that reach the least similarity.

    Two such sets share at least OF / (OF + OUT_OF) of the sum of their sizes. In one order of all shingles nothing shared stands before the first shared one, so that is among
    the first of both, with enough left behind it in both. With rare shingles first, passages that many sets hold stand behind, where they bring nothing together.
    The order changes only how many others are met. Sets of one root, size and place go as one list: a crowd that is joined meets another set by few rows.
    """
    rarity = _rarity(sets)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (b for b in batches if b.num_rows):
            found = [(prefix(own, rarity), len(own)) for own in (np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(1))]
            n = [len(p) for p, _ in found]
            keys, places = np.concatenate([p for p, _ in found]), np.concatenate([np.arange(m) for m in n])
            of = pa.array(np.repeat(np.arange(len(n)), n))
            sizes = np.repeat([k for _, k in found], n)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(places.astype(np.int64)), batch.column(0).take(of), batch.column(2).take(of)], names=["key", "k", "place", "set", "root"])

    firsts = stored(sets.select("set", "shingles", "root").mapInArrow(run, "key long, k long, place long, set long, root long"), "prefixes")
    mixed = firsts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter(F.col("lo") != F.col("hi")).select("key")
    lists = stored(firsts.join(mixed, "key", "left_semi").groupBy("key", "k", "place", "root").agg(F.collect_list("set").alias("sets")), "lists")
    # The smaller set of a pair has its key in the first ninth or so, where it can meet one of its own size.
    left = F.least(F.col("k") - F.col("place"), F.col("k2") - F.col("place2"))
    early = lists.filter(OF * 2 * F.col("k") <= (OF + OUT_OF) * (F.col("k") - F.col("place")))
    other = lists.select("key", *(F.col(c).alias(f"{c}2") for c in ("k", "place", "root", "sets")))
    met = (F.col("k") <= F.col("k2")) & (F.col("root") != F.col("root2")) & (OF * (F.col("k") + F.col("k2")) <= (OF + OUT_OF) * left)
    pairs = early.join(other, (early["key"] == other["key"]) & met).select("sets", "sets2")
    pairs = stored(pairs.select(F.explode("sets").alias("a"), "sets2").select("a", F.explode("sets2").alias("b")), "candidates")
    drop_stored(firsts, lists)
    return pairs


def _first(column: str) -> Column:
    """The smallest id, null last, with its set and number of rows."""
    return F.min(F.struct(F.col(column).isNull().alias("z"), F.col(column).alias("id"), "set", "n"))


def _groups(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """(set, root, kept: the set with the first doc_id, component_id, n) of every set."""
    roots = components(links)
    tied = firsts.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    per_id = tied.groupBy("root", "first").agg(F.min("set").alias("set"), F.sum("n").alias("n"))
    least = per_id.groupBy("root").agg(_first("first").alias("f")).select("root", F.col("f.set").alias("kept"), F.col("f.id").alias("component_id"), F.col("f.n").alias("n"))
    out = stored(tied.select("set", "root").join(least, "root"), "groups")
    drop_stored(roots)
    return out


def groups(rows: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``_groups`` of stored ``sketches``."""
    by_id = rows.groupBy("set", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = by_id.groupBy("set").agg(_first("doc_id").alias("f")).select("set", F.col("f.id").alias("first"), F.col("f.n").alias("n"))
    firsts = stored(firsts, "firsts")
    sets = rows.select("set", "bands", F.octet_length("shingles").alias("k")).dropDuplicates(["set"])

    def shared(members: DataFrame) -> DataFrame:
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
        return stored(members.join(sizes, "bucket").select("bucket", "set", "k", "size"), "buckets")

    def ranked(members: DataFrame) -> DataFrame:
        central = members.groupBy("set").agg(F.sum("size").alias("central"))
        return members.join(central, "set")

    members = shared(sets.select("set", "k", F.explode("bands").alias("bucket")))
    close, scratch = fingerprint_pairs(rows)
    large = members.filter(F.col("size") > pivots)
    most = ranked(large).groupBy("bucket").agg(F.max(F.struct("central", "set", "k")).alias("m"))
    most = large.select("bucket", "set", "k").join(most, "bucket").groupBy("set", "k").agg(F.max("m").alias("m"))
    most = most.filter((F.col("set") != F.col("m.set")) & _even(F.col("k"), F.col("m.k"))).select(F.col("set").alias("a"), F.col("m.set").alias("b"))
    links = _verified(close.unionByName(most), rows)
    crowd = stored(close._tessera_crowd.unionByName(large.select("set")).distinct(), "crowd")
    drop_stored(*scratch)
    out = _groups(firsts, links)
    # Pairs of one group need no trial, and those of two sets of crowds have theirs by prefixes. The sets of a small bucket come as one list, and a set's lists from all its buckets are made one before they
    # become pairs: near copies share most buckets.
    group = out.select("set", "root").join(crowd.withColumn("crowd", F.lit(True)), "set", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    small = members.filter(F.col("size") <= pivots).select("bucket", "set", "k").join(group, "set")
    lists = small.groupBy("bucket").agg(F.collect_list(F.struct("set", "k", "root", "crowd")).alias("others"))
    tried = F.filter("others", lambda o: (o["set"] < F.col("set")) & ~(o["crowd"] & F.col("crowd")) & (o["root"] != F.col("root")) & _even(F.col("k"), o["k"]))
    met = small.join(lists, "bucket").select("set", F.transform(tried, lambda o: o["set"]).alias("others")).filter(F.size("others") > 0)
    met = met.groupBy("set").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    crowded = stored(rows.select("set", "shingles").dropDuplicates(["set"]).join(group.filter("crowd").select("set", "root"), "set"), "crowded")
    candidates = prefix_pairs(crowded)
    found = _verified(met.select(F.col("set").alias("a"), F.explode("others").alias("b")).unionByName(candidates), rows)
    both = stored(links.unionByName(found), "near")
    drop_stored(links, found, out, members, crowd, crowded, candidates)
    out = _groups(firsts, both)
    drop_stored(firsts, both)
    return out


def keep_first(documents: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """The documents, with all their columns, that come first (by doc_id) among their near copies: one row for each group."""
    rows = stored(sketches(documents), "sketches")
    out = groups(rows, pivots)
    of_text = stored(rows.select("text_hash", "set").distinct().join(out, "set"), "labels")
    drop_stored(rows, out)
    own_hash, component_id, root, n, text = fresh(documents, "_hash", "_component_id", "_root", "_n", "_text")
    labels = of_text.select(F.col("text_hash").alias(own_hash), F.col("component_id").alias(component_id), F.col("root").alias(root), F.col("n").alias(n))
    met = documents.withColumn(text, _text_hash()).join(labels, F.col(text) == F.col(own_hash))
    met = met.filter(F.col("doc_id").cast("long").eqNullSafe(F.col(component_id)))
    once, again = met.filter(F.col(n) == 1), met.filter(F.col(n) > 1).dropDuplicates([root])
    return once.unionByName(again).select(*documents.columns)
