"""Encoding and decoding against the sentencepiece library, and Viterbi search against all segmentations."""

import random
import zlib
from functools import cache

import numpy as np
import pytest

from tessera.llm.sentencepieces import MARK, MERGES, UNIGRAM, Codec, Pieces, decoded, digests, encoded, load


@pytest.fixture(scope="module")
def theirs(piece_bpe):
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe)


def test_codec_equals_the_library(piece_bpe, theirs, rows):
    own = Codec(load(piece_bpe), remembered=100)
    rng = random.Random(2)
    parts = ["a", "the", "B", " ", " ", "\n", "ing", "1", "é", "\t", MARK, "  ", ".", "ll", "漢", "字", "𒀀", "<0x0A>", "</s>", "hello", "()", "==", "aa", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [r[1] or "" for r in rows]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = theirs.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == theirs.decode(want)


def entries(pieces):
    return [("<unk>", 0.0, Pieces.UNKNOWN), *((p, s, Pieces.NORMAL) for p, s in pieces)]


def test_unigram_takes_the_best_sum():
    rng = random.Random(5)
    scores = {p: -rng.uniform(1, 9) for p in ["a", "b", MARK, "ab", "ba", "aba", MARK + "a", MARK + "ab", "bb", "abab"]}
    model = Pieces(entries(scores.items()), UNIGRAM)

    def best(word):
        @cache
        def upto(end):
            if not end:
                return 0.0
            return max((upto(s) + scores.get(word[s:end], model.unknown_score if end - s == 1 else -1e9) for s in range(end)), default=0)

        return upto(len(word))

    words = [MARK + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    for word, ids in zip(words, model.encode_words(words), strict=True):
        found = [model.entries[i] for i in np.frombuffer(ids, "<u4")]
        if "c" not in word:
            assert "".join(p for p, _, _ in found) == word and np.isclose(sum(s for _, s, _ in found), best(word))
        else:
            assert 0 in np.frombuffer(ids, "<u4")


def merged(word, pieces):
    """The parts of a word after merging the earliest piece, leftmost first, until none is left."""
    parts = list(word)
    while True:
        options = [(pieces.index(a + b), j) for j, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in pieces]
        if not options:
            return parts
        j = min(options)[1]
        parts[j : j + 2] = [parts[j] + parts[j + 1]]


def test_merges_equal_merging():
    rng = random.Random(6)
    pieces = ["a", "b", "c", MARK]
    while len(pieces) < 50:  # as training makes them: from earlier pieces, and only what merging makes of its characters
        new = rng.choice(pieces) + rng.choice(pieces)
        if MARK not in new.lstrip(MARK) and len(new) < 8 and new not in pieces and len(merged(new, pieces)) == 2:
            pieces.append(new)
    model = Pieces(entries([(p, -float(k)) for k, p in enumerate(pieces)]), MERGES)
    words = [MARK + "".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for word, ids in zip(words, model.encode_words(words), strict=True):
        assert [model.entries[i][0] for i in np.frombuffer(ids, "<u4")] == merged(word, pieces), word


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="merged from"):
        Pieces(entries([(p, -float(k)) for k, p in enumerate(["abc", "ab", "a", "b", "c"])]), MERGES)


def test_frames(documents, nothing, piece_bpe, theirs, rows):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_pieces, r.ids_crc32, r.decoded_crc32, r.round_trip) for r in digests(documents, piece_bpe).collect())
    want = []
    for r in rows:
        ids = theirs.encode(r[1] or "")
        back = theirs.decode(ids)
        want.append((r[0] is None, r[0] or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(back.encode()), back == (r[1] or "")))
    assert found == sorted(want)
    back = decoded(encoded(documents, piece_bpe), piece_bpe).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r[0] or -1, theirs.decode(theirs.encode(r[1] or ""))) for r in rows)
    assert digests(nothing, piece_bpe).collect() == []
