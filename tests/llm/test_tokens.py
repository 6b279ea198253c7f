"""The chunked encoder, packing, token files and length histograms against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, simple8b, token_counts, token_files
from tessera.llm.tokens import TextEncoder, in_groups


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(byte_bpe, rows):
    mine, theirs = TextEncoder(byte_bpe, remembered=50), library(byte_bpe)
    rng = random.Random(1)
    parts = ["a", "B", " ", " ", "\n", "\n", "'s", "'", "1", "é", "\t", "\r", " ", "　", ".", "ll", "<|endoftext|>", "$", "²", "\x0b", "\x85", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(3000)] + [r[1] or "" for r in rows]
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], mine.encode(texts[at : at + 500]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == theirs(text), text


def test_groups_hold_every_text():
    texts = ["abc", None, "", "x" * 50, "y"]
    found = [(at, g) for at, g in in_groups(texts, 10)]
    assert [t for _, g in found for t in g] == ["abc", "", "", "x" * 50, "y"]
    assert all(texts[at + i] in (t, None) for at, g in found for i, t in enumerate(g))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=80), st.integers(1, 30), st.sampled_from([8, 32, 100]))
def test_packer_places_each_id_once(lengths, most_open, window):
    packer, n = packing.Packer(5, window, most_open), 0
    for doc, length in enumerate(lengths):
        packer.add(doc, np.arange(n, n + length, dtype="<u4").tobytes())
        n += length
        assert packer.n_open == packer.levels.sum() <= most_open + 1
    packer.recut(last=True)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for doc, start, length, check, total, sequence, offset, _ in packer.taken():
        sequences[sequence].append((offset, length))
        pieces[doc].append((start, length))
        first = sum(lengths[:doc]) + start
        assert check == crc(range(first, first + length)) and total == lengths[doc]
    for doc, length in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces[doc]):
            assert start == at and k > 0
            at += k
        assert at == length
    for own in sequences.values():
        at = 0
        for offset, k in sorted(own):
            assert offset == at
            at += k
        assert at == window or at < window and at & (at - 1) == 0


def test_packer_takes_the_least_sum_of_squares():
    rng = random.Random(2)
    packer = packing.Packer(0, 16, 1000)
    for doc in range(300):
        n = rng.randint(1, 15)
        counts = packer.levels.copy()
        level = packer.best_level(n)

        def after(h, counts=counts, n=n):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            return int((c**2).sum())

        allowed = [h for h in range(16 - n + 1) if not h or counts[h]]
        assert level in allowed and after(level) == min(map(after, allowed))
        packer.add(doc, np.zeros(n, "<u4").tobytes())


def test_pack(documents, nothing, byte_bpe, rows):
    ids = library(byte_bpe)
    found = packing.pack(documents, byte_bpe).collect()
    want = Counter((r[0], crc([*ids(r[1]), 1])) for r in rows)
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    for doc in {r[0] for r in rows}:
        texts = [[*ids(r[1]), 1] for r in rows if r[0] == doc]
        assert sum(p.length for p in pieces[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            for p in pieces[doc]:
                assert crc(texts[0][p.start : p.start + p.length]) == p.ids_crc32 and p.doc_tokens == len(texts[0])
    whole = Counter((r.doc_id, r.ids_crc32) for r in found if r.length == r.doc_tokens)
    assert not whole - want
    sizes = Counter()
    for r in found:
        sizes[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 and n < 2048 for n in sizes.values())
    assert packing.pack(nothing, byte_bpe).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    ids = np.array(values, np.uint64)
    words, offsets, escaped = simple8b.encode(ids, block)
    assert (simple8b.decode(words, escaped) == ids).all()
    for b in range(len(offsets) - 1):
        own = simple8b.decode(words[int(offsets[b]) : int(offsets[b + 1])], escaped)
        assert (own == ids[b * block : (b + 1) * block]).all()
    shard = simple8b.Shard(simple8b.to_file([None, 4], [0, len(ids)], ids, block))
    assert shard.doc_ids == [None, 4] and (shard.ids(len(ids) // 3, len(ids)) == ids[len(ids) // 3 :]).all()


def test_simple8b_packs_small_values():
    assert len(simple8b.encode(np.zeros(960, np.uint64), 1024)[0]) == 16
    with pytest.raises(ValueError):
        simple8b.Shard(b"nothing of ours, but long enough to hold a header of fifty-six bytes")


def test_token_files(documents, nothing, byte_bpe, rows, tmp_path):
    ids = library(byte_bpe)
    path = f"file://{tmp_path}/shards"
    found = token_files.read(documents.sparkSession, path, token_files.write(documents, path, byte_bpe, 2, shard_ids=3000)).orderBy("start").collect()
    assert len(list((tmp_path / "shards").glob("*.s8b"))) > 3 and not list((tmp_path / "shards").glob("_*"))
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((r[0], len(x), crc(x)) for r in rows for x in [[*ids(r[1]), 2]])
    assert token_files.round_trip(nothing, byte_bpe).collect() == []


def test_length_histogram(documents, nothing, byte_bpe, rows):
    ids = library(byte_bpe)
    lengths = sorted(len(ids(r[1])) for r in rows)
    hist = token_counts.histogram(token_counts.lengths(documents, byte_bpe)).persist()
    found = {r.length: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in found.items()} == Counter(lengths)
    for limit, r in found.items():
        assert r.docs_at_least == sum(x >= limit for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= limit)
        assert r.docs_up_to == sum(x <= limit for x in lengths) and r.truncated_total == sum(min(x, limit) for x in lengths)
    for limit in (0, 3, 100, 2048, 10**9):
        assert token_counts.truncated_total(hist, limit) == sum(min(x, limit) for x in lengths)
    for share in (0.1, 0.5, 1.0):
        assert token_counts.quantile(hist, share) == next(x for x in lengths if sum(y <= x for y in lengths) >= share * len(lengths))
    empty = token_counts.histogram(token_counts.lengths(nothing, byte_bpe))
    assert empty.collect() == [] and token_counts.truncated_total(empty, 5) == 0 and token_counts.quantile(empty, 0.5) is None
