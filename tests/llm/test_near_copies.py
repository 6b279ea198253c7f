"""Near copies by 5-word shingles against all pairs, and recall on planted ones."""

import random

import pytest
from conftest import WORDS, prose

from tessera.llm import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def planted():
    """Texts of 300 words, and copies of each with one, two or three words changed far apart: similarity 0.9 to 0.97."""
    rng, rows = random.Random(5), []
    for k in range(60):
        words = prose(rng, WORDS, 300).split()
        rows.append((k, " ".join(words)))
        for j, changes in enumerate((1, 2, 3)):
            own = list(words)
            for at in range(changes):
                own[40 + 100 * at] = f"changed{k}x{j}x{at}"
            rows.append((1000 + 10 * k + j, " ".join(own)))
    return rows


def test_stage_meets_planted_near_copies(spark, planted):
    import corpus_pipeline

    docs = spark.createDataFrame(planted, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    sets = {i: plain_set(t) for i, t in planted}
    assert all(jaccard(sets[k], sets[1000 + 10 * k + j]) >= 0.8 for k in range(60) for j in range(3))
    assert kept == set(range(60))


@pytest.mark.parametrize("pivots", [1, 16])
def test_kept_against_all_pairs(spark, documents, nothing, rows, planted, pivots):
    """Small buckets and large ones: no two kept documents are alike, and what is dropped hangs on a kept one."""
    base = planted[0][1].split()
    rng, more = random.Random(6), []
    for k in range(30):  # a hot group: each is alike to the first, hardly to one another
        own = list(base)
        for _ in range(6):
            own[rng.randrange(len(own))] = f"new{k}"
        more.append((5000 + k, " ".join(own)))
    every = [*planted[:40], *more]
    kept = {r.doc_id: r.text for r in near_copies.keep_first(spark.createDataFrame(every, "doc_id long, text string"), pivots).collect()}
    sets, roots = {i: plain_set(t) for i, t in every}, {i: i for i, _ in every}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = roots[a], roots[b]
                roots = {i: min(x, y) if r in (x, y) else r for i, r in roots.items()}
    assert not [(a, b) for a in kept for b in kept if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert set(roots.values()) <= kept.keys()
    if pivots == 16:
        assert set(roots.values()) == kept.keys()
    out = near_copies.keep_first(documents, pivots)
    assert out.columns == documents.columns and near_copies.keep_first(nothing, pivots).count() == 0
    found = out.collect()
    texts = {r.text or "" for r in found}
    assert len(texts) == len(found) and {0, 1} <= {r.doc_id for r in found} and None not in {r.doc_id for r in found if r.text is None}


def test_fingerprints_meet_close_sets(spark, documents, planted):
    """The stage's SimHash step: every pair of fingerprints within its reach, and sets of one fingerprint."""
    rows = near_copies.stored(near_copies.sketches(spark.createDataFrame(planted, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))), "test")
    sets = {r.set: r.fp for r in rows.select("set", "fp").collect()}
    least = {}
    for s, fp in sets.items():
        least[fp] = min(s, least.get(fp, s))
    near = {frozenset((least[a], least[b])) for a in least for b in least if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= near_copies.REACH}
    same = {frozenset((s, least[fp])) for s, fp in sets.items() if s != least[fp]}
    pairs, scratch = near_copies.fingerprint_pairs(rows)
    got = pairs.collect()
    assert len(near) > 20 and {frozenset((r.a, r.b)) for r in got} == near | same and len(got) == len(near | same)
    near_copies.drop_stored(rows, *scratch)


def test_pairs_of_a_crowd(spark, monkeypatch):
    """A crowd of near copies is joined by one pair each; what stands outside of it is tried against the most central ones."""
    rng = random.Random(9)
    base = prose(rng, WORDS, 300).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        own = list(base)
        for at in (20, 120, 220)[: 1 + k % 3]:
            own[at + rng.randrange(60)] = f"new{k}x{at}"
        rows.append((k, " ".join(own)))
    rows.append((1000, " ".join([*base[:270], *prose(rng, WORDS, 12).split()])))  # alike to some of the crowd
    rows.append((2000, prose(rng, WORDS, 200)))
    seen, plain = [], near_copies._verified

    def counted(pairs, own):
        pairs = near_copies.stored(pairs, "counted")
        seen.append(pairs.count())
        return plain(pairs, own)

    monkeypatch.setattr(near_copies, "_verified", counted)
    kept = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2000]
    assert sum(seen) < 3 * len(rows), seen
