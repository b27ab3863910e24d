"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel compares the letters of two words by their common subsequences of three, each weighted by DECAY to the power
of its span, so that gaps and inserted characters only weaken a match (Lodhi et al., 2002). Landmark words span a
feature space in which a linear machine with squared hinge loss is trained; since the kernel is an inner product over
subsequences, the trained machine is one weight per subsequence, and scoring a word costs a few table look-ups, no
kernel evaluations.

Labels belong to texts, not to words, and so does the loss: a toxic text is to have one word on the toxic side, its
worst, and a clean text none (Andrews, Tsochantaridis, Hofmann, 2003). Training goes in rounds: each toxic text is
represented by the word that the last machine scores highest, the clean ones by NEGATIVES of their words and by the two
words of each text that any machine so far has scored highest; then the next machine is trained on these. The first
round starts from how much more often runs of letters stand in toxic texts than in clean ones.
A logistic curve over what the machine says on a text's words (its three worst words, how many are on the toxic
side and by how much, and how many words there are, since long texts hold more chance resemblances), fitted on the
same labelled texts, gives the probability.

Training takes at most TRAIN_TEXTS labelled texts of each class, chosen by hash, each with all its words; every text is
scored in whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled texts of each class that training takes at most, and words of clean texts that it takes besides the worst ones,
#: half of them the most frequent ones, half by hash.
TRAIN_TEXTS, NEGATIVES = 3000, 12_000
DECAY, ALPHABET, WINDOW = 0.7, 64, 14
LANDMARKS, ROUNDS, GRAM = 256, 6, 4
CACHE = 1 << 19
START = "^"
RUN = re.compile(r"[^\W\d_]+")
FOLDS = 5


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of classes: a-z and the mark have their own, all other characters share the rest."""
    x = np.array(words, dtype=f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.int64)
    return np.where((x >= 97) & (x <= 122), x - 97, np.where(x == ord(START), ALPHABET - 1, 26 + x % (ALPHABET - 27)))


def units(token: str) -> list[str]:
    """The words in a token: its runs of letters, and their concatenation if other characters were put between them,
    each after a mark for its beginning. Long ones give overlapping windows."""
    runs = RUN.findall(token)
    if len(runs) > 1:
        runs.append("".join(runs))
    out = []
    for r in runs:
        r = START + r
        if len(r) <= WINDOW:
            out.append(r)
        else:
            out += [r[k : k + WINDOW] for k in range(0, len(r) - WINDOW // 2, WINDOW // 2)]
    return [u for u in out if len(u) >= 4]


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case tokens; letters that stand alone in a row also give one token together."""
    words = (text or "").lower().split()
    found = set(words)
    singles = "".join(w if len(w) == 1 and w.isalpha() else " " for w in words)
    return found.union(x for x in singles.split() if len(x) >= 4)


def _triples(length: int) -> tuple[list[tuple[int, int, int]], np.ndarray, float]:
    """Places of the subsequences of a word, their weights, and the norm of a word of that length."""
    places = list(combinations(range(length), 3))
    weights = np.array([DECAY ** (k - i + 1) for i, _, k in places])
    return places, weights, float(np.sqrt((weights**2).sum()))


TRIPLES = {n: _triples(n) for n in range(3, WINDOW + 1)}


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, codes) of the words of each length."""
    at = defaultdict(list)
    for k, w in enumerate(words):
        at[len(w)].append(k)
    for ks in at.values():
        yield np.array(ks), _codes([words[k] for k in ks])


def _indices(codes: np.ndarray, place: tuple[int, int, int]) -> np.ndarray:
    i, j, k = place
    return (codes[:, i] * ALPHABET + codes[:, j]) * ALPHABET + codes[:, k]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(subsequences that occur, normalised feature vectors over those) of a few words."""
    groups = [(ks, codes, TRIPLES[codes.shape[1]]) for ks, codes in _by_length(words)]
    used = np.unique(np.concatenate([_indices(codes, p) for _, codes, (places, _, _) in groups for p in places]))
    out = np.zeros((len(words), len(used)), dtype=np.float32)
    for ks, codes, (places, weights, norm) in groups:
        for p, w in zip(places, weights, strict=True):
            np.add.at(out, (ks, np.searchsorted(used, _indices(codes, p))), w / norm)
    return used, out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, words by landmarks."""
    used, dense = features(landmarks)
    column = np.full(ALPHABET**3, len(used))
    column[used] = np.arange(len(used))
    rows = np.vstack([dense.T, np.zeros((1, len(landmarks)), dtype=np.float32)])
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for ks, codes in _by_length(words):
        places, weights, norm = TRIPLES[codes.shape[1]]
        for p, w in zip(places, weights, strict=True):
            out[ks] += np.float32(w / norm) * rows[column[_indices(codes, p)]]
    return out.astype(float)


def spread(words: list[str], n: int) -> list[str]:
    """Landmarks: each next one is the word least like those chosen before."""
    if len(words) <= n:
        return list(words)
    chosen, near = [words[0]], None
    for _ in range(n - 1):
        k = kernel(words, chosen[-1:])[:, 0]
        near = k if near is None else np.maximum(near, k)
        chosen.append(words[int(np.argmin(near))])
    return chosen


def machine(positive: list[str], negative: list[str], landmarks: list[str], heavy: np.ndarray, usual: np.ndarray, ridge: float = 1e-4, steps: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the Nystroem space: (weight per subsequence, bias). Both
    classes count alike; heavy weights the positive words, usual the negative ones."""
    own = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.hstack([kernel(positive + negative, landmarks) @ root, np.ones((len(positive) + len(negative), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.r_[0.5 * heavy / heavy.sum(), 0.5 * usual / usual.sum()]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(z.shape[1] - 1, ridge), 1e-9]
    for _ in range(steps):
        active = y * (z @ w) < 1
        a = z[active] * c[active, None]
        new = np.linalg.solve(a.T @ z[active] + np.diag(penalty), a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    weights = np.zeros(ALPHABET**3, dtype=np.float32)
    used, dense = features(landmarks)
    weights[used] = (root @ w[:-1]) @ dense
    return weights, float(w[-1])


def word_scores(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(words))
    for ks, codes in _by_length(words):
        places, scale, norm = TRIPLES[codes.shape[1]]
        total = np.zeros(len(ks))
        for (i, j, k), w in zip(places, scale, strict=True):
            total += w * weights[(codes[:, i] * ALPHABET + codes[:, j]) * ALPHABET + codes[:, k]]
        out[ks] = total / norm
    return out + bias


def summary(scores: np.ndarray) -> np.ndarray:
    """What a curve over texts reads of the scores of a text's words, at least one."""
    worst = np.full(3, -2.0)
    worst[: min(3, len(scores))] = -np.sort(-scores)[:3]
    over, hits, sure, n = np.clip(scores, 0, 1).sum(), (scores > 0).sum(), (scores > 0.5).sum(), len(scores)
    return np.r_[np.clip(worst, -2, 2), np.log1p([over, hits, sure]), np.log(n), np.log1p([100 * over / n, 100 * sure / n])]


def bag(text: str | None) -> str:
    """The distinct words of a text, a space between them."""
    return " ".join(sorted({u for w in tokens(text) for u in units(w)}))


class Scorer:
    """Probabilities of texts, with a bounded cache of word scores."""

    def __init__(self, model: dict):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        self.place: dict[str, int] = {}
        self.scores = np.zeros(0)

    def _learn(self, new: Iterable[str]) -> None:
        fresh: list[str] = []
        for token in new:
            at = []
            for u in units(token):
                if (k := self.place.get(u)) is None:
                    k = self.place[u] = len(self.scores) + len(fresh)
                    fresh.append(u)
                at.append(k)
            self.words[token] = tuple(at)
        if fresh:
            self.scores = np.r_[self.scores, word_scores(fresh, self.model["weights"], self.model["bias"])]

    def __call__(self, texts: Iterable[str | None]) -> np.ndarray:
        """A text without words has the probability 0."""
        found = [tokens(t) for t in texts]
        if len(self.words) > CACHE:
            self._clear()
        self._learn(set().union(*found).difference(self.words))
        out = np.zeros(len(found))
        at = [set().union(*map(self.words.__getitem__, f)) for f in found]
        some = [k for k, x in enumerate(at) if x]
        if some:
            out[some] = self.model["curve"](np.array([summary(self.scores[np.fromiter(at[k], dtype=np.int64)]) for k in some]))
        return out


class Curve:
    """Logistic regression on standardised features, both classes counting alike; features beyond those of the training
    texts count as the nearest of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.low, self.high, self.mean, self.width = x.min(0), x.max(0), x.mean(0), x.std(0) + 1e-9
        z, n = self._plane(x), y.sum()
        c = np.where(y == 1, 0.5 / n, 0.5 / (len(y) - n))
        ridge = np.r_[np.full(x.shape[1], max(1e-3, 0.1 / n)), 1e-9]
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (c * (p - y)) + ridge * w)
            w -= step / max(1.0, np.abs(step).max())
        self.w = w

    def _plane(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(np.clip(x, self.low, self.high) - self.mean) / self.width, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._plane(x) @ self.w, -30, 30)))


def _runs(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of letters of each word, as numbers, and where each word's begin: runs of GRAM letters, and of up to twice
    as many at its beginning."""
    counts = np.array([len(u) - GRAM + 1 + max(0, min(len(u), 2 * GRAM) - GRAM) for u in vocabulary])
    starts = np.r_[0, np.cumsum(counts)]
    flat = np.zeros(starts[-1], dtype=np.int64)
    for ks, codes in _by_length(vocabulary):
        n = codes.shape[1]
        for i in range(n - GRAM + 1):
            flat[starts[ks] + i] = codes[:, i : i + GRAM] @ ALPHABET ** np.arange(GRAM)
        for i, m in enumerate(range(GRAM + 1, min(n, 2 * GRAM) + 1), n - GRAM + 1):
            flat[starts[ks] + i] = codes[:, :m] @ ALPHABET ** np.arange(m) + m * ALPHABET ** (2 * GRAM)
    return np.unique(flat, return_inverse=True)[1].astype(np.int32), starts


def _first_scores(vocabulary: list[str], toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """Where training starts, for words of toxic texts: by how many deviations the most telling run of letters in a word
    stands in more toxic texts than clean ones let expect."""
    runs, starts = _runs(vocabulary)

    def texts_with(bags: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(runs.max() + 1)
        for t in bags:
            out[np.concatenate([runs[starts[k] : starts[k + 1]] for k in t])] += 1  # once a text, however often
        return out

    in_toxic, expected = texts_with(toxic), (texts_with(clean) + 1) * len(toxic) / len(clean)
    score = (in_toxic - expected) / np.sqrt(expected + in_toxic + 1)
    best = np.maximum.reduceat(score[runs], starts[:-1])
    seen = np.zeros(len(vocabulary), dtype=bool)
    seen[np.concatenate(toxic)] = True
    return np.where(seen, best, -np.inf)


def train(toxic: list[str], clean: list[str]) -> dict | None:
    """The model from the bags of labelled texts: subsequence weights, bias and the curve; None without words of both
    classes to learn from."""
    toxic, clean = [b for b in toxic if b], [b for b in clean if b]
    if not toxic or not clean:
        return None
    vocabulary = sorted({u for b in (*toxic, *clean) for u in b.split(" ")})
    place = {u: k for k, u in enumerate(vocabulary)}
    toxic, clean = ([np.array([place[u] for u in b.split(" ")], dtype=np.int32) for b in x] for x in (toxic, clean))
    del place
    in_clean = np.bincount(np.concatenate(clean), minlength=len(vocabulary))
    by_hash = sorted(np.flatnonzero(in_clean).tolist(), key=lambda k: zlib.crc32(vocabulary[k].encode()))
    usual = {*sorted(by_hash, key=lambda k: -in_clean[k])[: NEGATIVES // 2], *by_hash[: NEGATIVES // 2]}
    scores, worst = _first_scores(vocabulary, toxic, clean), {}
    for _ in range(ROUNDS):
        speaks = Counter(int(t[np.argmax(scores[t])]) for t in toxic)
        positive = sorted(speaks, key=lambda k: (-speaks[k], k))
        if not (negative := sorted(usual.union(worst).difference(speaks))):
            return None
        word = lambda ks: [vocabulary[k] for k in ks]
        closest = [k for k in worst if k not in speaks] or negative
        landmarks = spread(word(positive), LANDMARKS * 2 // 3) + spread(word(closest), LANDMARKS // 3)
        heavy, often = np.sqrt([speaks[k] for k in positive]), np.sqrt(np.maximum(1, in_clean[negative]))
        weights, bias = machine(word(positive), word(negative), landmarks, heavy, often)
        scores = word_scores(vocabulary, weights, bias)
        for t in clean:
            worst.update(dict.fromkeys(t[np.argsort(-scores[t], kind="stable")[:2]].tolist()))
    x = np.array([summary(scores[t]) for t in (*toxic, *clean)])
    return {"weights": weights, "bias": bias, "curve": Curve(x, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])}


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def training_bags(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """The words of at most TRAIN_TEXTS toxic and as many clean texts of labels(doc_id, toxic) outside the held-out fold;
    of several rows with one doc_id one trains."""
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(bag, na_action=None)

    bags = {}
    for y in (1, 0):
        some = rows.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_TEXTS).select("doc_id")
        own = docs.join(F.broadcast(some), "doc_id").select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("t"))
        got = own.groupBy("doc_id").agg(F.min("t.h").alias("h"), F.min_by("t.text", "t.h").alias("text")).select("doc_id", words("text").alias("bag"))
        bags[y] = [r["bag"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])]  # at most TRAIN_TEXTS
    return bags[1], bags[0]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted.

    A text without words, null and empty ones too, scores 0; repeated rows score alike; a null id is not held out and never a
    training row; without labelled texts with words of both classes every score is 0. A long text is scored by all its
    words. Only the text is read for a score;
    further columns of either table don't matter, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(*training_bags(docs, labels)))  # a weight per subsequence: 1 MB

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            parts = [scorer(batch.iloc[k : k + 64]) for k in range(0, len(batch), 64)] if scorer else []
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(len(batch)))

    rated = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.pandas_udf(score, "double")("text").alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
