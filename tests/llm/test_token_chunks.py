"""Texts are cut into chunks as columns: only distinct chunks become Python strings, and every text has the library's ids."""

import random
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "a", "Word", "é", "straße", "語", "😀", ",", "!?", "'s", "12", "<|endoftext|>", "<|end", "x" * 70, "\x00"]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_repeated_chunks_make_no_strings(path):
    from tessera.llm.tokens import TextEncoder

    encoder = TextEncoder(path)
    texts = ["first words", "some words stand here\nand there " * 10_000]
    chunks = 60_001
    expected = encoder.encode(texts)
    tracemalloc.start()
    try:
        assert encoder.encode(texts) == expected
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 * chunks, peak / chunks  # 68 measured; 142 when each chunk was a string


def test_any_mixture_equals_the_library(path):
    from tessera.llm.tokens import TextEncoder

    mine, rng = TextEncoder(path, remembered=60), random.Random(4)
    for _ in range(60):
        texts = ["".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(40)]
        for text, ids in zip(texts, mine.encode(texts), strict=True):
            assert ids == mine.whole(text), text
    assert mine.encode([]) == [] and mine.encode(["", ""]) == [b"", b""]


def test_cuts():
    from tessera.llm.tokens import _cut

    texts = ["", "\n\na b", "c\n", "", "\nd  e", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    chunks, first = _cut(data, np.cumsum([0, *map(len, texts)]))
    found = [bytes(data[a:b]).decode() for a, b in zip(chunks, chunks[1:])]
    assert found == ["\n\na", " b", "c", "\n", "\nd", " ", " e"]
    assert first.tolist() == [0, 0, 2, 4, 4, 7, 7]
