import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, fp string, _fp string, n_words int"

#: Fixed texts of the edge cases; a long one is made below.
EDGES = [None, "", " ", "\n", "\n\n  \n", "a", "a b", "a  b\n\n\nc ", "stupid", "Ä ö\tß\r\n x", "漢字 かな", "<|endoftext|> end", "▁ mark ▁▁", "123 !!", " x y", "𒀀𒀁 x"]


def vocabulary(n: int, seed: int, syllables: str) -> list[str]:
    rng = random.Random(seed)
    parts = syllables.split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    out = []
    while n > 0:
        k = min(n, rng.randint(4, 12))
        sentence = [rng.choice(words) for _ in range(k)]
        out.append(" ".join(sentence).capitalize() + ".")
        n -= k
    return "".join(s + (" " if rng.random() < 0.7 else "\n") for s in out).strip()


WORDS = vocabulary(400, 1, "the an er on in to re at ed nd st en of is it ou ing tion ha th")


@pytest.fixture(scope="session")
def rows():
    """Rows of DOCUMENTS: prose, exact and near copies, the edge cases, a long text, null ids, repeated rows."""
    rng = random.Random(3)
    texts = [prose(rng, WORDS, rng.randint(30, 150)) for _ in range(40)]
    texts += [texts[0]] * 5
    for k in range(6):
        words = texts[1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += EDGES
    texts.append(prose(rng, WORDS, 8_000))
    out = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, None if t is None else len(t), 0.5, 7, "x", "y", 1) for i, t in enumerate(texts)]
    out += [(None, "no id", None, None, 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return [*out, out[2], out[2], out[60]]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def byte_bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")
