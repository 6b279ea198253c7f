"""Kneser-Ney probabilities against a plain form, and held-out accuracy on invented languages."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import prose, vocabulary

from tessera.llm import language
from tessera.llm.language import END, START, Models, Scorer, log_probabilities, symbols, train_models

SOUNDS = {"aa": "the an er on in to re at ed nd st", "bb": "sch ung keit ver der ein lich ge", "cc": "ção nho que os da ar ei ão", "dd": "ка ло не по во та ри"}


def text_of(lang, rng, n):
    return prose(rng, vocabulary(200, 3, SOUNDS[lang]), n)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return {k: [text_of(k, rng, rng.randint(20, 80)) for _ in range(30)] for k in SOUNDS}


def plain_model(words, order=3):
    """P(symbol | context) by recursion over occurrences and distinct continuations."""
    counts = [defaultdict(lambda: defaultdict(float)) for _ in range(order + 1)]
    lefts = [defaultdict(lambda: defaultdict(set)) for _ in range(order + 1)]
    starts = [defaultdict(lambda: defaultdict(float)) for _ in range(order + 1)]
    for w, n in words.items():
        s = [START, *map(ord, w), END]
        for i in range(1, len(s)):
            for o in range(1, order + 1):
                if i - o + 1 < 0:
                    continue
                c, x = tuple(s[i - o + 1 : i]), s[i]
                if o == order:
                    counts[o][c][x] += n
                elif i - o < 0:
                    starts[o][c][x] += n
                else:
                    lefts[o][c][x].add(s[i - o])
    for o in range(1, order):
        for c in set(lefts[o]) | set(starts[o]):
            for x in set(lefts[o][c]) | set(starts[o][c]):
                counts[o][c][x] = len(lefts[o][c][x]) + starts[o][c][x]
    discount = {}
    for o in range(1, order + 1):
        flat = [v for c in counts[o].values() for v in c.values()]
        ones, twos = flat.count(1), flat.count(2)
        discount[o] = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)

    def p(context, x, o):
        if o == 0:
            return language.UNSEEN
        c = context[len(context) - o + 1 :] if o > 1 else ()
        own = counts[o].get(c)
        if not own:
            return p(context, x, o - 1)
        d, total = discount[o], sum(own.values())
        return max(own.get(x, 0) - d, 0) / total + sum(min(v, d) for v in own.values()) / total * p(context, x, o - 1)

    return lambda context, x: p(context, x, min(order, len(context) + 1))


def test_probabilities_equal_the_plain_form():
    rng = random.Random(2)
    corpora = {"x": [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(40))], "y": [" ".join("".join(rng.choice("bc") for _ in range(rng.randint(1, 4))) for _ in range(40))]}
    models = train_models(corpora, order=3)
    for j, k in enumerate(models.languages):
        words = defaultdict(int)
        for w in corpora[k][0].split():
            words[w] += 1
        plain = plain_model(words)
        for w in ["ab", "bbb", "abcc", "cab", "c", "zz", "abz"]:
            codes, place, _ = symbols([w])
            found = log_probabilities(models, codes, place)[:, j]
            s = [START, *map(ord, w), END]
            for i in range(1, len(s)):
                assert math.isclose(found[i], math.log(plain(tuple(s[max(0, i - 2) : i]), s[i])), rel_tol=1e-6, abs_tol=1e-6), (k, w, i)


def test_held_out_accuracy_and_rejection(texts):
    models = train_models(texts)
    scorer, rng = Scorer(models, remembered=50), random.Random(7)
    held = [(k, text_of(k, rng, rng.randint(15, 60))) for k in SOUNDS for _ in range(40)]
    names, scores, rejected = scorer.judged([t for _, t in held])
    assert np.mean([a == k for a, (k, _) in zip(names, held, strict=True)]) > 0.98 and not rejected.any() and ((scores >= 0) & (scores <= 1)).all()
    names, scores, rejected = scorer.judged([None, "", "12 !!", "漢字かな交じり文 " * 20, "x" * 200_000])
    assert names[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and rejected.tolist() == [True] * 5 and names[3] in SOUNDS


def test_no_language():
    assert Scorer(Models([], [], [])).judged(["abc"])[0] == ["und"]


def test_frames(spark, documents, nothing, rows, texts):
    data = [(i, t, k) for i, (k, t) in enumerate((k, t) for k in texts for t in texts[k])]
    docs = spark.createDataFrame([(i, t, k, 1.0, True) for i, t, k in data] + [(None, "abc", "aa", None, None), (500, None, "aa", None, None), (501, "x", None, None, None), (2, data[2][1], "aa", 1.0, True)], "doc_id long, text string, lang string, score double, rejected boolean")
    models = language.train(docs)
    found = language.identified(docs, models).collect()
    right = {i: k for i, _, k in data}
    assert len(found) == len(data) + 4 and np.mean([r.lang_pred == right[r.doc_id] for r in found if r.doc_id in right]) > 0.98
    assert next(r for r in found if r.doc_id == 500).lang_pred == "und"
    kept = language.accepted(docs, models)
    assert kept.columns == docs.columns and {i for i, _, _ in data} <= {r.doc_id for r in kept.collect()}
    assert len(language.identified(documents, models).collect()) == len(rows)
    none = language.train(nothing)
    assert {r.lang_pred for r in language.identified(documents, none).collect()} == {"und"} and language.identified(nothing, models).collect() == []
