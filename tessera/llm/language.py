"""Language identification by interpolated Kneser-Ney character models, one for each language.

Characters are lower-cased letters within words, with a word's start and end as symbols of their own. The models
share sorted arrays of n-gram hashes, one for each order; a row holds every language's
interpolated log probability, worked out at training, and rows of contexts hold the weights that
unseen continuations are scaled by. A text's language is that of the lowest cross-entropy per character. Rejection is
calibrated on documents left out of the counts: for pieces of them of each length in ``LENGTHS``, median and spread of their excess
over the language's mean are taken, and a text is rejected if its own lies more than ``SPREADS`` spreads beyond the median at its length.

Defined results: null text and texts without a letter give 'und' with score 0; with no document to learn from every text
is 'und'; of languages that are equally near the first by name is taken; languages are learnt from rows with non-null text and lang; repeated rows are allowed; other columns are ignored
(``identified``) or kept (``accepted``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LONGEST_KEPT, bounded_batches, fresh, ordered_sample, worker_state

ORDER = 4
#: Documents of each language that the fit reads at most, and the longest text among them, in characters.
ROWS, LONGEST = 400, 40_000
START, END = 1, 2  # symbols; letters are their code points
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Characters of the pieces that rejection is calibrated on, and how much of a text is cut into them.
LENGTHS, CALIBRATED = (8, 15, 30, 60, 125, 250, 500), 5_000
#: Spreads (standard deviations by the median distance, so that an odd text moves nothing) above the median excess. Held out at sf0.1
#: this is the 0.995 quantile of whole documents: 12 of 2344 of the learnt languages lie beyond, and 599 of 600 of a language left out.
SPREADS = 12.0
UNSEEN = 1e-7  # share of an unseen character in the lowest order


def letters(token: str) -> str:
    """The letters of a token, lower-cased; what stands between them is left out."""
    low = token.lower()
    return low if low.isalpha() else "".join(c for c in _NOT_LETTERS.sub("", low) if c.isalpha())


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all words with start and end, place of each within its word, number of the word)."""
    n = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(n)
    codes = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), n)
    return codes, np.arange(len(codes)) - np.repeat(ends - n, n), word


def hashes(codes: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """The hash of the ``order`` symbols that end at each place; 0 where the word has fewer up to there."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.zeros_like(codes)
        shifted[back:] = codes[: len(codes) - back] if back else codes
        h = (h + shifted + np.uint64(1)) * _PRIME
        h ^= h >> np.uint64(29)
    h[place < order - 1] = 0
    return h


@dataclass
class Models:
    """For each order: sorted hashes and log probabilities [row, language]; sorted context hashes and log weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float = float(np.log(UNSEEN))
    mean: np.ndarray | None = None
    reach: np.ndarray | None = None  # [language, length of LENGTHS] the highest excess over the mean that is not rejected


def _rows(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(models: Models, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """[place, language] log P(symbol | up to ORDER - 1 before it); 0 at word starts."""
    out = np.zeros((len(codes), len(models.languages)))
    todo = np.flatnonzero(place > 0)
    for order in range(len(models.grams), 0, -1):
        h = hashes(codes, place, order)
        keys, logs = models.grams[order - 1]
        at, found = _rows(keys, h[todo])
        found &= h[todo] != 0
        out[todo[found]] += logs[at[found]]
        todo = todo[~found]
        if order > 1 and len(todo):  # the context, if it is known, gives its weight to the next lower order
            before = hashes(codes, place, order - 1)
            keys, logs = models.contexts[order - 1]
            at, known = _rows(keys, before[todo - 1])
            known &= before[todo - 1] != 0
            out[todo[known]] += logs[at[known]]
    if models.contexts and len(models.contexts[0][1]):
        out[todo] += models.contexts[0][1][0]  # the weight of what no order has seen
    out[todo] += models.unseen
    return out


def train_models(texts: dict[str, list[str]], order: int = ORDER) -> Models:
    """Models of each language's texts; every fifth text calibrates rejection and isn't counted (with under five, all serve both)."""
    from collections import Counter

    languages = sorted(texts)
    counted = {k: Counter(w for i, t in enumerate(texts[k]) if len(texts[k]) < 5 or i % 5 for w in map(letters, t.split()) if w) for k in languages}
    per_order: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for k in languages:
        words, n = list(counted[k]), np.array(list(counted[k].values()), np.float64)
        codes, place, word = symbols(words)
        own = [hashes(codes, place, o) for o in range(1, order + 1)]
        for o in range(1, order + 1):
            # Highest order: occurrences. Lower orders: distinct symbols before, or occurrences where nothing can stand before.
            use = place >= max(1, o - 1)
            whole = own[o - 1][use]
            ctx = (own[o - 2][np.flatnonzero(use) - 1]) if o > 1 else np.zeros(len(whole), np.uint64)
            amount = n[word[use]]
            if o < order:
                longer = own[o][use]
                first = longer == 0  # at the word's start
                _, at = np.unique(longer, return_index=True)
                distinct = np.zeros(len(longer))
                distinct[at] = 1
                amount = np.where(first, amount, distinct)
            keys, at, inverse = np.unique(whole, return_index=True, return_inverse=True)
            per_order[o - 1].append((keys, np.bincount(inverse, weights=amount, minlength=len(keys)), ctx[at]))
    models = Models(languages, [], [])
    for o in range(1, order + 1):
        every = np.unique(np.concatenate([x[0] for x in per_order[o - 1]] or [np.zeros(0, np.uint64)]))
        contexts = np.unique(np.concatenate([x[2] for x in per_order[o - 1]] or [np.zeros(0, np.uint64)]))
        logs, weights = np.empty((len(every), len(languages))), np.zeros((len(contexts), len(languages)))
        # The next lower order's probability of each gram is found through its own shorter hash.
        lower = _lower(models, counted, languages, o, every)
        for j, (keys, counts, ctx) in enumerate(per_order[o - 1]):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))
            at_ctx = np.searchsorted(contexts, ctx)
            total = np.bincount(at_ctx, weights=counts, minlength=len(contexts))
            kinds = np.bincount(at_ctx, weights=np.minimum(counts, discount), minlength=len(contexts))
            weight = np.where(total > 0, kinds / np.maximum(total, 1e-12), 1.0)
            base = np.exp(lower[:, j])
            where = np.searchsorted(every, keys)
            own = np.zeros(len(every))
            own[where] = np.maximum(counts - discount, 0) / total[at_ctx]
            ctx_of_all = _contexts_of(per_order[o - 1], every)
            row = np.searchsorted(contexts, ctx_of_all)
            logs[:, j] = np.log(np.maximum(own + weight[row] * base, 1e-12))
            weights[:, j] = np.log(np.maximum(weight, 1e-12))
        models.grams.append((every, logs))
        models.contexts.append((contexts, weights))
    _calibrate(models, texts)
    return models


def _contexts_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], every: np.ndarray) -> np.ndarray:
    """The context hash of each gram of the union."""
    out = np.zeros(len(every), np.uint64)
    for keys, _, ctx in parts:
        out[np.searchsorted(every, keys)] = ctx
    return out


def _lower(models: Models, counted: dict, languages: list[str], o: int, every: np.ndarray) -> np.ndarray:
    """[gram, language] log probability of each gram's last symbol by the next lower order."""
    if o == 1:
        return np.full((len(every), len(languages)), np.log(UNSEEN))
    out = np.zeros((len(every), len(languages)))
    short = Models(languages, models.grams[: o - 1], models.contexts[: o - 1], models.unseen)
    for k in languages:
        codes, place, _ = symbols(list(counted[k]))
        h = hashes(codes, place, o)
        keys, at = np.unique(h, return_index=True)
        if len(keys) and keys[0] == 0:
            keys, at = keys[1:], at[1:]
        logs = log_probabilities(short, codes, place)
        row, found = _rows(every, keys)
        out[row[found]] = logs[at[found]]
    return out


def _pieces(text: str, length: int) -> list[str]:
    """Stretches of whole words of at least ``length`` scored symbols, one after another."""
    out, own, n = [], [], 0
    for t in text[:CALIBRATED].split():
        own.append(t)
        k = len(letters(t))
        n += k + 1 if k else 0
        if n >= length:
            out.append(" ".join(own))
            own, n = [], 0
    return out


def _calibrate(models: Models, texts: dict[str, list[str]]) -> None:
    scorer = Scorer(models)
    models.mean, models.reach = np.zeros(len(models.languages)), np.zeros((len(models.languages), len(LENGTHS)))
    for j, k in enumerate(models.languages):
        held = [t for i, t in enumerate(texts[k]) if len(texts[k]) < 5 or i % 5 == 0]
        sums, chars = scorer.sums(held)
        some = chars > 0
        if not some.any():
            continue
        h = -sums[some, j] / chars[some]
        models.mean[j] = np.average(h, weights=np.minimum(chars[some], 500))
        for i, length in enumerate(LENGTHS):
            sums, chars = scorer.sums([p for t in held for p in _pieces(t, length)])
            if len(chars) > 1:
                excess = -sums[:, j] / chars - models.mean[j]
                models.reach[j, i] = max(0.0, float(np.median(excess) + SPREADS * 1.4826 * np.median(np.abs(excess - np.median(excess)))))
            elif i:  # no text is as long: the limit of shorter ones
                models.reach[j, i] = models.reach[j, i - 1]
        models.reach[j] = np.maximum.accumulate(models.reach[j][::-1])[::-1]


def limits(models: Models, language: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The highest excess that is not rejected, between LENGTHS in proportion to the logarithm, below them to the root of the length."""
    n, at = np.maximum(chars, 1), np.log(LENGTHS)
    out = np.empty(len(n))
    for j in range(len(models.languages)):
        own = language == j
        out[own] = np.interp(np.log(n[own]), at, models.reach[j])
    return out * np.sqrt(np.maximum(LENGTHS[0] / n, 1))


class Scorer:
    """Sums of log probabilities of texts, word by word; words are kept for each worker, up to a bound."""

    def __init__(self, models: Models, remembered: int = 200_000):
        self.models, self.limit = models, remembered
        self.known: dict[str, int] = {}
        self.used = 0  # rows of the table
        self.table = np.zeros((1024, len(models.languages) + 1), np.float32)

    def _learn(self, tokens: set[str]) -> None:
        if self.used > self.limit:
            self.known.clear()
            self.used = 0
        new = [t for t in tokens if t not in self.known]
        at = self.used
        self.used += len(new)
        if at + len(new) > len(self.table):
            grown = np.zeros((max(at + len(new), 2 * len(self.table)), self.table.shape[1]), np.float32)
            grown[:at] = self.table[:at]
            self.table = grown
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            words = [letters(t) for t in part]
            codes, place, word = symbols(words)
            logs = log_probabilities(self.models, codes, place)
            first = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])[:-1]]).astype(np.int64)
            rows = self.table[at + a : at + a + len(part)]
            rows[:, :-1] = np.add.reduceat(logs, first, axis=0)
            n = np.array([len(w) for w in words])
            rows[:, -1] = np.where(n > 0, n + 1, 0)
            rows[n == 0] = 0
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def sums(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """([text, language] log likelihoods, scored symbols) of whole texts."""
        out, chars = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            tokens = (text or "").split()
            try:
                at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
            except KeyError:
                own = set(tokens)
                self._learn(own)
                at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
                for t in own:
                    if len(t) > LONGEST_KEPT:
                        self.known.pop(t, None)
            rows = self.table[at].sum(axis=0, dtype=np.float64)
            out[i], chars[i] = rows[:-1], rows[-1]
        return out, chars

    def judged(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', score, rejected) of each text."""
        m = self.models
        if not m.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sums, chars = self.sums(texts)
        h = -sums / np.maximum(chars, 1)[:, None]
        best = np.argmin(h, axis=1)
        rows = np.arange(len(h))
        gap = -(h - h[rows, best][:, None]) * np.minimum(chars, 60)[:, None]
        score = 1 / np.exp(np.maximum(gap, -50)).sum(axis=1)
        far = h[rows, best] - m.mean[best] > limits(m, best, chars)
        none = chars == 0
        return [("und" if z else m.languages[b]) for b, z in zip(best, none, strict=True)], np.where(none, 0.0, score), far | none


def train(documents: DataFrame, learn: Column | None = None, rows: int = ROWS, longest: int = LONGEST) -> Models:
    """Fits models on at most ``rows`` documents of each language (those whose ids hash lowest) of at most ``longest`` characters for which ``learn``,
    of doc_id, holds; where ids repeat with other texts, on at most twice as many texts (those whose ids and texts hash lowest)."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = own.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    if learn is not None:
        usable = usable.filter(learn)
    chosen = ordered_sample(usable.select("doc_id", "lang"), "doc_id", rows, "lang").distinct().collect()
    if not chosen:
        return Models([], [], [])
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(r["doc_id"], r["lang"]) for r in chosen], "_own_id long, _own_lang string")
    found = usable.join(F.broadcast(wanted), (F.col("doc_id") == F.col("_own_id")) & (F.col("lang") == F.col("_own_lang")))
    texts: dict[str, list[str]] = {}
    few = found.select("lang", "text", "doc_id").distinct().withColumn("h", F.xxhash64("doc_id", "text")).orderBy("h", "lang").limit(2 * len(chosen)).collect()
    for r in sorted(few, key=lambda r: (r["doc_id"], r["h"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return train_models(texts)


def _scorer(shared) -> Scorer:
    """The worker's scorer of broadcast models."""
    m = shared.value
    key = ("language", *m.languages, *(len(k) for k, _ in m.grams), m.mean.tobytes() if m.mean is not None else b"")
    return worker_state(key, lambda: Scorer(m))


def language_column(spark, models: Models, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column; the models, whose size the sample bounds, are broadcast."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts):
        import pandas as pd

        lang, score, rejected = _scorer(shared).judged(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    return run(text.cast("string"))


def identified(documents: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred (a learnt language, or und), score, rejected of each document."""
    (own,) = fresh(documents, "_own")
    return documents.select("doc_id", language_column(documents.sparkSession, models, F.col("text")).alias(own)).select("doc_id", f"{own}.*")


def accepted(documents: DataFrame, models: Models) -> DataFrame:
    """The documents, with all their columns, that aren't rejected."""
    return documents.filter(~language_column(documents.sparkSession, models, F.col("text")).getField("rejected"))
