"""Toxic spans and document scores from a linear-chain conditional random field with two tags.

Labels are of documents. A word gets the toxic tag in toxic documents if it, or its stem, stands there in more
distinct contexts, against clean documents, than chance allows; contexts rather than counts, as a copied document
repeats its words in the same places. The field (weights of hashed words and stems, transitions) is fitted to these tags
by gradient steps on its likelihood over a bounded sample of labelled documents. Forward-backward marginals
of whole texts give offending offsets and, as a fitted logistic function of their
sums, the score.

Defined results: null and empty texts, and any text if there are no labels of both kinds, score the base rate; repeated and
contradicting labels count as toxic; labels without a document are ignored; other columns are ignored (``scored``) or kept (``clean``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LONGEST_KEPT, bounded_batches, ordered_sample, worker_state

BUCKETS = 1 << 18
#: Letters of a word's beginnings that are traits.
STEMS = (4, 5, 6, 7)
#: Labelled documents that the fit reads at most: toxic, clean; the longest text among them, in characters; and, of their pieces
#: without a toxic tag, how many the weights are fitted on at least (twice those with one, if that is more).
TOXIC_ROWS, CLEAN_ROWS, LONGEST, CLEAN_PIECES = 1200, 2400, 20_000, 4000
THRESHOLD = 0.3
#: Marginals below this are no sign of anything: else the length of a clean text would add up to one.
FLOOR = 0.02
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_WORDS = re.compile(r"\S+")


def normal(token: str) -> str:
    return _EDGES.sub("", token.lower())


def traits(word: str) -> list[str]:
    """What a word is known by: itself, and its beginnings, as a stem may carry many endings."""
    return [f"{word}$", *(word[:k] for k in STEMS if len(word) > k)] if word else []


def buckets(word: str) -> list[int]:
    """Hashed traits, 1 .. BUCKETS - 1, filled up with 0, which has no weight."""
    from xxhash import xxh32_intdigest

    own = [1 + xxh32_intdigest(t) % (BUCKETS - 1) for t in traits(word)]
    return own + [0] * (1 + len(STEMS) - len(own))


@dataclass
class Field:
    """Weights of the tag 'toxic' against 'clean' by trait's bucket, a start weight, transitions [from, to], and the score's logistic function."""

    weights: np.ndarray
    start: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    base: float = 0.0
    logit: np.ndarray | None = None  # intercept; weights of the features of ``features``


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by falling length, number of rows longer than each position)."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return order, active


def marginals(scores: np.ndarray, lengths: np.ndarray, model: Field) -> np.ndarray:
    """P(toxic) of every token; ``scores`` are rows of token weights one after another, all rows advanced together."""
    order, active = ragged(lengths)
    starts = (np.cumsum(lengths) - lengths)[order]
    m, alpha, out = model.moves, np.zeros(len(scores)), np.empty(len(scores))
    # Log odds of the tag suffice with two tags: forward and backward messages are one number each.
    if len(active):
        at = starts[: active[0]]
        odds = model.start + scores[at]
        alpha[at] = odds
        for t in range(1, len(active)):
            at = starts[: active[t]] + t
            odds = odds[: active[t]]
            odds = scores[at] + np.logaddexp(m[0, 1], m[1, 1] + odds) - np.logaddexp(m[0, 0], m[1, 0] + odds)
            alpha[at] = odds
        beta = np.zeros(0)
        for t in range(len(active) - 1, -1, -1):
            if len(beta) < active[t]:
                beta = np.concatenate([beta, np.zeros(active[t] - len(beta))])
            at = starts[: active[t]] + t
            out[at] = alpha[at] + beta
            down = scores[at] + beta
            beta = np.logaddexp(m[1, 0], m[1, 1] + down) - np.logaddexp(m[0, 0], m[0, 1] + down)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each row: log odds of any toxic token, capped, and log of the expected number of them. Marginals below FLOOR don't count."""
    ends = np.cumsum(lengths)
    rest, sums = np.zeros(len(lengths)), np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        starts = (ends - lengths)[some]
        rest[some] = np.add.reduceat(np.log1p(-np.minimum(np.where(p < FLOOR, 0, p), 1 - 1e-9)), starts)
        sums[some] = np.add.reduceat(np.where(p > 0.5, p, 0), starts)
    any_toxic = np.clip(np.log(-np.expm1(np.minimum(rest, -1e-12))) - rest, -8, 8)
    return np.column_stack([any_toxic, np.log1p(sums)])


def _toxic_traits(words: list[str], ids: np.ndarray, before: np.ndarray, toxic: np.ndarray, least: int = 4, z: float = 5.0, ratio: float = 8.0) -> set[str]:
    """Traits that stand in more distinct contexts (word before, word) in toxic documents than their share in clean ones explains.

    ``ids`` and ``before`` number each token and the one before it in ``words``; ``toxic`` tells the token's document's label.
    """
    from collections import defaultdict

    seen: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
    sizes = [0, 0]
    for label in (1, 0):  # clean documents' counts are wanted for traits of toxic ones only
        pairs = np.unique((before * np.int64(len(words) + 1) + ids)[toxic == label]) % (len(words) + 1)
        sizes[label] = len(pairs)
        counts = np.bincount(pairs, minlength=len(words))
        for k in np.flatnonzero(counts):
            for t in traits(words[k]):
                if label or t in seen[1]:
                    seen[label][t] += int(counts[k])
    share = sizes[1] / max(1, sum(sizes))
    odds = share / max(1 - share, 1e-9)
    out = set()
    for t, n1 in seen[1].items():
        n0 = seen[0].get(t, 0)
        expected = (n1 + n0) * share
        if n1 >= least and n1 > ratio * n0 * odds and (n1 - expected) / np.sqrt(max(expected * (1 - share), 0.25)) > z:
            out.add(t)
    return out


def fit(texts: list[str], labels: np.ndarray, base: float, steps: int = 60, piece: int = 64, clean_pieces: int = CLEAN_PIECES) -> Field:
    """A field for texts with document labels; ``base`` is the share of toxic documents outside the sample's balance. Of the sample's pieces without
    a toxic tag an even choice of about ``clean_pieces`` (or twice those with one) is fitted on; all tokens count for the tags and the score."""
    model = Field(np.zeros(BUCKETS), base=base)
    if len(set(labels.tolist())) < 2:
        return model
    numbers: dict[str, int] = {}
    tokens = [np.array([numbers.setdefault(normal(t), len(numbers)) for t in text.split()], np.int32) for text in texts]
    words = list(numbers)
    lengths = np.array([len(d) for d in tokens], np.int64)
    x = np.concatenate(tokens).astype(np.int64)
    del tokens, numbers
    before = np.concatenate([[len(words)], x[:-1]])[: len(x)]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(words)
    in_toxic = np.repeat(labels == 1, lengths)
    toxic = _toxic_traits(words, x, before, in_toxic.astype(np.int8))
    known = np.array([buckets(w) for w in words], np.int64).reshape(len(words), 1 + len(STEMS))  # traits' buckets of each distinct word
    y = np.array([any(t in toxic for t in traits(w)) for w in words], bool)[x] & in_toxic
    del before, in_toxic
    # Pieces of a bounded length are chains of their own, which the fit advances together.
    cuts = np.concatenate([np.minimum(piece, n - np.arange(0, n, piece)) for n in lengths if n] or [np.zeros(0, np.int64)])
    if not len(cuts):
        return model
    starts = np.cumsum(cuts) - cuts
    rows = np.zeros((len(cuts), piece), np.int64)
    tags = np.zeros((len(cuts), piece), np.int8)
    mask = np.arange(piece) < cuts[:, None]
    rows[mask], tags[mask] = x, y
    del y
    # Most pieces have clean tags only; those with a toxic one and as many others again are enough for the transitions and weights.
    holds = tags.any(axis=1)
    others = np.flatnonzero(~holds)
    chosen = np.concatenate([np.flatnonzero(holds), others[:: max(1, len(others) // max(clean_pieces, 2 * int(holds.sum())))]])
    rows, tags, mask, n = rows[chosen], tags[chosen], mask[chosen], cuts[chosen]
    theta = np.zeros(BUCKETS + 3)  # start, enter (0 to 1), stay (1 to 1)
    theta[BUCKETS : BUCKETS + 3] = -3, -3, -1
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    flat, total = known[rows[mask]], mask.sum()
    for step in range(1, steps + 1):
        w = theta[:BUCKETS][known].sum(axis=1)[rows] * mask
        model.start, model.moves = theta[BUCKETS], np.array([[0, theta[BUCKETS + 1]], [0, theta[BUCKETS + 2]]])
        p, pair = _expected(w, mask, n, model)
        gradient = np.zeros_like(theta)
        gradient[:BUCKETS] = np.bincount(flat.ravel(), weights=np.repeat((tags - p)[mask], flat.shape[1]), minlength=BUCKETS)
        gradient[BUCKETS] = (tags[:, 0] - p[:, 0]).sum()
        both = mask[:, 1:]
        for k, a in ((1, 0), (2, 1)):
            gradient[BUCKETS + k] = ((tags[:, :-1] == a) & (tags[:, 1:] == 1) & both).sum() - (pair[a] * both).sum()
        gradient -= 0.05 * theta  # a Gaussian prior
        gradient[0] = 0
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6 * total)
    model.weights, model.start = theta[:BUCKETS].copy(), float(theta[BUCKETS])
    model.moves = np.array([[0, theta[BUCKETS + 1]], [0, theta[BUCKETS + 2]]])
    f = features(marginals(model.weights[known].sum(axis=1)[x], lengths, model), lengths)
    # The sample's balance isn't the corpus's: rows are weighted back before the logistic function is fitted.
    weight = np.where(labels == 1, base / max(labels.mean(), 1e-9), (1 - base) / max(1 - labels.mean(), 1e-9))
    model.logit = _logistic(f, labels, weight)
    return model


def _expected(w: np.ndarray, mask: np.ndarray, n: np.ndarray, model: Field) -> tuple[np.ndarray, list[np.ndarray]]:
    """P(tag 1) [row, t]; P(tag a then 1) [row, t] for a in 0, 1, of padded rows."""
    rows, length = w.shape
    m = model.moves
    odds, beta = np.zeros((length, rows)), np.zeros((length, rows))
    odds[0] = model.start + w[:, 0]
    for t in range(1, length):
        odds[t] = w[:, t] + np.logaddexp(m[0, 1], m[1, 1] + odds[t - 1]) - np.logaddexp(m[0, 0], m[1, 0] + odds[t - 1])
    for t in range(length - 2, -1, -1):
        down = w[:, t + 1] + beta[t + 1]
        beta[t] = (np.logaddexp(m[1, 0], m[1, 1] + down) - np.logaddexp(m[0, 0], m[0, 1] + down)) * mask[:, t + 1]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    p = sigmoid(odds + beta).T
    down = (w[:, 1:].T + beta[1:])
    pair = []
    for a in (0, 1):  # P(tag t = a) by what is before, then P(tag t + 1 = 1 given a)
        after = sigmoid(m[a, 1] - m[a, 0] + down)
        pair.append((after * (sigmoid(odds + beta)[:-1] if a else 1 - sigmoid(odds + beta)[:-1])).T)
    return p, pair


def _logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40) -> np.ndarray:
    x = np.column_stack([np.ones(len(f)), f])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * beta)
    return beta


class Scorer:
    """Scores and spans of texts; words' weights are kept for each worker, up to a bound."""

    def __init__(self, model: Field, remembered: int = 200_000):
        self.model, self.limit, self.known = model, remembered, {}

    def _weights(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
        long = []
        for t in set(tokens):
            if t not in known:
                known[t] = float(self.model.weights[buckets(normal(t))].sum())
                if len(t) > LONGEST_KEPT:
                    long.append(t)
        out = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        for t in long:
            del known[t]
        return out

    def scores(self, texts) -> np.ndarray:
        rows = [(t or "").split() for t in texts]
        lengths = np.array([len(r) for r in rows], np.int64)
        if self.model.logit is None:
            return np.full(len(rows), self.model.base)
        weights = np.concatenate([self._weights(r) for r in rows] or [np.zeros(0)])
        f = features(marginals(weights, lengths, self.model), lengths)
        out = 1 / (1 + np.exp(-np.clip(self.model.logit[0] + f @ self.model.logit[1:], -30, 30)))
        return np.where(lengths > 0, out, self.model.base)

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, highest marginal) of runs of tokens tagged toxic, as code point offsets."""
        found = list(_WORDS.finditer(text or ""))
        if not found:
            return []
        p = marginals(self._weights([m[0] for m in found]), np.array([len(found)]), self.model)
        out: list[tuple[int, int, float]] = []
        for k in np.flatnonzero(p >= least):
            if out and k and p[k - 1] >= least:
                out[-1] = (out[-1][0], found[k].end(), max(out[-1][2], float(p[k])))
            else:
                out.append((found[k].start(), found[k].end(), float(p[k])))
        return out


def train(documents: DataFrame, labels: DataFrame, learn: Column | None = None, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, longest: int = LONGEST, clean_pieces: int = CLEAN_PIECES) -> Field:
    """Fits a field on at most that many labelled documents (those whose ids hash lowest) of at most ``longest`` characters for which ``learn``, of doc_id,
    holds; where ids repeat with other texts, on at most twice as many texts (those whose ids and texts hash lowest)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    if learn is not None:
        marked = marked.filter(learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    base = (toxic or 0) / n if n else 0.0
    chosen = ordered_sample(marked.filter("toxic = 1"), "doc_id", toxic_rows).unionByName(ordered_sample(marked.filter("toxic = 0"), "doc_id", clean_rows))
    chosen = documents.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen.collect()], "_own_id long, _own_toxic int")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= longest))
    rows = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_own_id")).select("doc_id", "text", "_own_toxic", F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(2 * (toxic_rows + clean_rows)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["h"]))
    return fit([r["text"] for r in rows], np.array([r["_own_toxic"] for r in rows], np.int64), base, clean_pieces=clean_pieces)


def score_column(spark, model: Field, text: Column) -> Column:
    """The score of a text column; the model, of a fixed size, is broadcast."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        scorer = _scorer(shared)
        return pd.Series(np.concatenate([scorer.scores(texts.iloc[a : a + 512].tolist()) for a in range(0, len(texts), 512)] or [np.zeros(0)]))

    return run(text.cast("string"))


def _scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model."""
    model = shared.value
    return worker_state(("toxicity", hash(model.weights.tobytes()), model.start, model.base), lambda: Scorer(model))


def scored(documents: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on) of each document."""
    out = documents.select("doc_id", score_column(documents.sparkSession, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def spans(documents: DataFrame, model: Field, least: float = 0.5) -> DataFrame:
    """doc_id and offending stretches of each document: start, end (code points), p (highest marginal)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,p:double>>")
    def run(texts):
        import pandas as pd

        return pd.Series([[{"start": a, "end": b, "p": p} for a, b, p in _scorer(shared).spans(t, least)] for t in texts])

    return documents.select("doc_id", run(F.col("text").cast("string")).alias("toxic_spans"))


def clean(documents: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below ``threshold``."""
    return documents.filter(score_column(documents.sparkSession, model, F.col("text")) < threshold)
