"""The random field against enumeration of all taggings, and held-out accuracy on planted words."""

import random
from itertools import product

import numpy as np
from conftest import WORDS, prose

from tessera.llm import toxicity
from tessera.llm.toxicity import Field, Scorer, fit, marginals


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = Field(np.zeros(4), start=-0.7, moves=np.array([[0, -1.2], [0, 0.8]]))
    lengths = np.array([3, 0, 1, 6, 2])
    scores = rng.normal(0, 2, lengths.sum())
    found, at = marginals(scores, lengths, model), 0
    for n in lengths:
        own = scores[at : at + n]
        total, sums = 0.0, np.zeros(n)
        for tags in product((0, 1), repeat=int(n)):
            e = sum(own[t] for t in range(n) if tags[t]) + (model.start * tags[0] if n else 0) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:], strict=False))
            total += np.exp(e)
            sums += np.exp(e) * np.array(tags)
        assert np.allclose(found[at : at + n], sums / total)
        at += n


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, WORDS, rng.randint(20, 120)).split(" ")
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["Grumbleworth,", "vilespawn", "rotfang" + rng.choice(WORDS)])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_spans():
    train, test = labelled(800, 1), labelled(400, 2)
    model = fit([t for _, t, _ in train], np.array([y for _, _, y in train]), 1 / 8)
    scorer = Scorer(model)
    predicted = scorer.scores([t for _, t, _ in test]) >= 0.3
    assert np.mean(predicted == np.array([y == 1 for _, _, y in test])) > 0.97
    text = "Fine words, Grumbleworth, and more vilespawn"
    assert [text[a:b] for a, b, _ in scorer.spans(text)] == ["Grumbleworth,", "vilespawn"]
    assert scorer.spans(None) == [] and scorer.spans("  ") == []
    long = " ".join(["the", "an"] * 20_000)
    assert scorer.scores([long, None, "", "vilespawn " + long])[1] == model.base
    assert (scorer.scores(["!! ?"])[0] < 0.3) and np.all(np.diff(scorer.scores(["a", "vilespawn", "vilespawn vilespawn Grumbleworth"])) >= 0)


def test_frames(spark, documents, nothing, rows):
    data = labelled(300, 4)
    docs = spark.createDataFrame([(i, t, 0.1, "x") for i, t, _ in data] + [(None, None, None, None), (9999, "", None, None), (3, data[3][1], 0.1, "x")], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(0, 0, 1), (None, 1, 1), (5, None, 1), (77777, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    found = toxicity.scored(docs, model).collect()
    assert len(found) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    right = {i: y for i, _, y in data}
    assert np.mean([r.predicted == right[r.doc_id] for r in found if r.doc_id in right]) > 0.95
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in found)
    assert {r.doc_id for r in toxicity.spans(docs, model).filter("size(toxic_spans) > 0").collect()} >= {r.doc_id for r in found if r.predicted}
    none = toxicity.train(nothing, labels.limit(0))
    assert [r.score for r in toxicity.scored(documents, none).collect()] == [0.0] * len(rows)
    assert toxicity.scored(nothing, model).collect() == []


def test_ids_and_labels_of_the_held_out_part_are_not_learnt(spark):
    from tessera.llm.common import id_remainder

    data = labelled(200, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    learn = id_remainder("doc_id", 4) != 2
    one = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    import zlib

    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in data], "doc_id long, toxic int")
    a, b = toxicity.train(docs, one, learn), toxicity.train(docs, other, learn)
    assert (a.weights == b.weights).all() and a.base == b.base
