"""Long words without spaces against the library, and in reasonable time."""

import random
import time

import numpy as np
import pytest
from conftest import WORDS

from tessera.llm import sentencepieces


def test_long_words_equal_the_library(piece_bpe):
    import sentencepiece

    rng = random.Random(6)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=piece_bpe), sentencepieces.Codec(sentencepieces.load(piece_bpe))
    texts = ["".join(rng.choice(WORDS) for _ in range(n)) for n in (15, 40, 100, 400)]
    texts += ["".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(n)) for n in (65, 128, 129, 700)]
    texts += ["a" * n for n in (64, 65, 300, 1000)] + ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(500)), "=-" * 300, "the" * 200, "\n" * 200 + "x"]
    for t, found in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(t), t[:40]


def test_unigram_cuts_change_nothing():
    entries = [("<unk>", 0.0, 2), *((c, -3.0, 1) for c in "abcd"), ("ab", -4.0, 1), ("bc", -4.5, 1), ("abc", -6.0, 1), ("▁", -2.0, 1)]
    pieces = sentencepieces.Pieces(entries, sentencepieces.UNIGRAM)
    rng = random.Random(1)
    for n in (70, 200, 333):
        word = "".join(rng.choice("abcdz") for _ in range(n))
        assert pieces._ids(word, pieces._long(word)) == pieces._ids(word, pieces._paths_of([word])[0])


@pytest.mark.parametrize("alphabet", ["ABCDEFGHabcdefgh01234567+/", "漢字仮名交文章言語処理"])
def test_time_of_a_long_word(piece_bpe, alphabet):
    rng = random.Random(2)
    codec = sentencepieces.Codec(sentencepieces.load(piece_bpe))
    codec.encode(["warm up"])
    began = time.process_time()
    codec.encode(["".join(rng.choice(alphabet) for _ in range(20_000))])
    assert time.process_time() - began < 6
