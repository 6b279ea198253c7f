"""Crowds of near copies: no link between sets of large buckets or of near fingerprints is left out, and pairs don't grow with the square of a bucket."""

import random

import pytest
from conftest import WORDS, prose
from test_near_copies import jaccard, plain_set

from tessera.llm import near_copies

SHAPE = "doc_id long, text string"


def first_of_all_pairs(rows):
    """The smallest id of each component of all pairs that are alike."""
    sets, roots = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = roots[a], roots[b]
                roots = {i: min(x, y) if r in (x, y) else r for i, r in roots.items()}
    return set(roots.values())


@pytest.fixture(scope="module")
def drifting():
    """Each text is alike to the next one and to hardly any other; ids are dealt at random, so groups meet by members that aren't kept."""
    rng = random.Random(21)
    own, texts = prose(rng, WORDS, 300).split(), []
    for k in range(48):
        texts.append(" ".join(own))
        own = list(own)
        for j in range(5):
            own[(7 * k + 60 * j) % 300] = f"drift{k}x{j}"
    ids = list(range(48))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("pivots", [1, 4])
def test_links_of_members_that_are_not_kept(spark, drifting, pivots):
    kept = {r.doc_id for r in near_copies.keep_first(spark.createDataFrame(drifting, SHAPE), pivots).collect()}
    assert kept == first_of_all_pairs(drifting)


def test_every_alike_pair_of_near_fingerprints(spark, monkeypatch):
    """Fingerprints that count as dense leave the partitions' pairs; all of their alike pairs are among those of prefixes, and nearly nothing else."""
    rng, rows = random.Random(22), []
    base = prose(rng, WORDS, 900).split()
    for k in range(90):
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(900)] = f"own{k}"
        rows.append((k, " ".join(own)))
    rows.extend((1000 + k, prose(rng, WORDS, 120)) for k in range(40))
    sketches = near_copies.stored(near_copies.sketches(spark.createDataFrame(rows, SHAPE)), "test")
    plain = near_copies.simhash.links
    monkeypatch.setattr(near_copies.simhash, "links", lambda fps, reach, crowds: plain(fps, reach, dense=8, crowds=crowds))
    pairs, scratch = near_copies.fingerprint_pairs(sketches)
    found = sketches.select("doc_id", "set", "fp", "shingles").collect()
    sets, of = {r.set: plain_set(dict(rows)[r.doc_id]) for r in found}, {r.set: r.fp for r in found}
    crowd = {r.set for r in pairs._tessera_crowd.collect()}
    assert len(crowd) > 40
    own = sketches.select("set", "shingles", near_copies.F.col("set").alias("root")).dropDuplicates(["set"])
    own = near_copies.stored(own.filter(near_copies.F.col("set").isin(list(crowd))), "test")
    met = {frozenset((r.a, r.b)) for r in pairs.select("a", "b").collect()} | {frozenset((r.a, r.b)) for r in near_copies.prefix_pairs(own).collect()}
    near = [(a, b) for a in of for b in of if a < b and ((of[a] ^ of[b]) & (2**64 - 1)).bit_count() <= near_copies.REACH]
    alike = [p for p in near if jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    assert len(alike) > 100 and all(frozenset(p) in met for p in alike)


def test_pairs_of_a_common_passage(spark, monkeypatch):
    """Texts of one passage and as much of their own fill whole buckets and are no near copies: hardly any pair of them is tried."""
    rng = random.Random(23)
    passage = prose(rng, WORDS, 110)
    rows = [(k, " ".join([passage, *(f"own{k}x{j}" for j in range(40 + k % 20))])) for k in range(160)]
    rows.append((1000, rows[7][1] + " end"))
    seen, plain = [], near_copies._verified

    def counted(pairs, own):
        pairs = near_copies.stored(pairs, "counted")
        seen.append(pairs.count())
        return plain(pairs, own)

    monkeypatch.setattr(near_copies, "_verified", counted)
    kept = near_copies.keep_first(spark.createDataFrame(rows, SHAPE)).collect()
    assert {r.doc_id for r in kept} == set(range(160))
    assert sum(seen) < 4 * len(rows), seen
