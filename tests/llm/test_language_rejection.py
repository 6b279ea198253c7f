"""Rejection of a language that wasn't learnt and shares the script of those that were."""

import random

import numpy as np
from conftest import prose, vocabulary

from tessera.llm.language import LENGTHS, Scorer, train_models

SOUNDS = {"aa": "the an er on in to re at ed nd st", "bb": "sch ung keit ver der ein lich ge"}
#: Mostly the sounds of the first one.
LEFT_OUT = "the an er on in to re at hat nit"


def texts_of(sounds, rng, n):
    return [prose(rng, vocabulary(200, 3, sounds), rng.randint(40, 120)) for _ in range(n)]


def test_a_left_out_language_of_the_same_script_is_rejected():
    rng = random.Random(1)
    texts = {k: texts_of(s, rng, 60) for k, s in SOUNDS.items()}
    scorer = Scorer(train_models(texts))
    assert scorer.judged(texts_of(LEFT_OUT, rng, 60))[2].mean() > 0.95
    assert not any(scorer.judged(texts_of(s, rng, 60))[2].any() for s in SOUNDS.values())


def test_one_odd_text_moves_no_limit():
    rng = random.Random(2)
    texts = {k: texts_of(s, rng, 60) for k, s in SOUNDS.items()}
    before = train_models(texts).reach
    texts["aa"][5] = "xqzj wvkq jjxq " * 10  # of every fifth, which calibrate
    after = train_models(texts).reach
    assert before.shape == (2, len(LENGTHS)) and (after <= 1.5 * before + 0.05).all() and (np.diff(after, axis=1) <= 0).all()
