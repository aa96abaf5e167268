"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of a fixed lexicon and of one learned from the labelled training rows (words
and word beginnings), the share of lexicon words near a second-person pronoun, rates of capitals, of punctuation and of
obfuscation (signs or digits within words, repeated letters), and lexicon words that show once the disguise is undone.
Trees split on quantile bins and are grown on the driver from a bounded sample; isotonic regression on a fold that
neither the lexicon nor the trees saw turns their sum into a probability. Labels are read only where crc32(doc_id) mod 3 is not 1; the
other rows are held out.

Bound: ``TRAIN_ROWS`` labelled rows, those whose ids hash lowest; the learned lexicon has at most ``LEXICON_ROWS``
entries.

Edge cases: null and empty texts have features of zero and get a score like any other; a null id is not held out and
never trains; with one class only or no labels, the score is the share of that class (0 without labels); repeated rows
score alike and train once; very long texts are read whole; equal gains split on the first feature and lowest cut, and
sums that tie share a step of the calibration; further columns are left alone but for one named ``toxicity_score``, which
:func:`with_toxicity` replaces (:func:`drop_toxic` adds none); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

TRAIN_ROWS = 20_000
LEXICON_ROWS = 4_000
DECISION = 0.7
PREFIX = 5

#: Insults and second-person words.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash garbage scum clown clowns filth vermin imbecile fool creep jerk freak hate kill shut ugly".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos usted ustedes tú ti vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de]")
ODD = re.compile(r"(?<![^\W_])(?:[^\W\d_]+(?:[\d@$!*|._-]+[^\W\d_]+)+|\d+[^\W\d_]+[\d@$]*[^\W\d_]*)")
NAMES = (
    "words", "insult_count", "insult_rate", "learned_count", "learned_rate", "begin_count", "begin_rate", "weight_top",
    "near_you", "you_rate", "capital_rate", "capital_words", "exclaim_rate", "question_rate", "punct_rate", "odd_rate",
    "undone_count", "run_rate",
)


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of word beginnings that training rows show mostly in toxic texts."""

    words: dict[str, float]
    begins: dict[str, float]
    all_words: frozenset[str] = INSULTS  # insults and words

    def __post_init__(self):
        object.__setattr__(self, "all_words", INSULTS | self.words.keys())


def letter_runs(low: str) -> int:
    """How often one of a to z stands three times or more in a row."""
    a = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    same = np.flatnonzero((a[1:] == a[:-1]) & (a[1:] >= 97) & (a[1:] <= 122))
    pairs = same[1:][np.diff(same) == 1]  # where a third equal letter stands
    return int(len(pairs) and 1 + np.count_nonzero(np.diff(pairs) > 1))


def features(text: str | None, lex: Lexicon) -> list[float]:
    """The dense features of one whole text."""
    if not text:
        return [0.0] * len(NAMES)
    low = text.lower()
    words = WORD.findall(low)
    n, chars = max(1, len(words)), len(text)
    insults, learned, near = 0, [], 0
    if not lex.all_words.isdisjoint(words):
        hits = [i for i, w in enumerate(words) if w in lex.all_words]
        insults = sum(words[i] in INSULTS for i in hits)
        learned = [lex.words[words[i]] for i in hits if words[i] in lex.words]
        if you := [i for i, w in enumerate(words) if w in YOU]:
            at, of = np.array(hits), np.array(you)
            near = int((np.abs(at[:, None] - of[_nearest(of, at)]) <= 5).any(axis=1).sum())
    begins = list(filter(None, map(lex.begins.get, [w[:PREFIX] for w in words]))) if lex.begins else []
    odd = ODD.findall(low)
    undone = 0
    for x in odd:
        plain = "".join(WORD.findall(x.translate(LEET)))
        undone += plain in lex.all_words
    upper = len(UPPER.findall(text))
    shout = sum(w.isupper() and len(w) > 2 for w in text.split()) if upper > 3 else 0
    exclaim, question = text.count("!"), text.count("?")
    punct = exclaim + question + sum(map(text.count, ".,;:'\"-()"))
    you_words = sum(map(YOU.__contains__, words))
    return [
        float(len(words)), insults, 100 * insults / n, len(learned), 100 * len(learned) / n, len(begins), 100 * len(begins) / n,
        max(learned, default=0.0), near, 100 * you_words / n, upper / chars, shout / n, 100 * exclaim / chars,
        100 * question / chars, 100 * punct / chars, 100 * len(odd) / n, undone, 100 * letter_runs(low) / n,
    ]


def _nearest(sorted_at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each place, the indexes of the listed places just below and just above it."""
    hi = np.searchsorted(sorted_at, to)
    return np.stack([np.maximum(hi - 1, 0), np.minimum(hi, len(sorted_at) - 1)], axis=1)


# --- trees ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Complete binary trees on binned features, a prior, and the steps of the calibration."""

    cuts: list[np.ndarray]
    feature: np.ndarray  # tree x inner node
    bin: np.ndarray
    leaf: np.ndarray
    prior: float
    steps_x: np.ndarray
    steps_y: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, b, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (binned[rows, f[node]] > b[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps_x, self.steps_y), 0.0, 1.0)


def _boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, bins: int, least: float):
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, inner = np.full(len(y), prior), 2**depth - 1
    features_, bins_, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node, feat, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, width)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                here = node == k
                if not here.any():
                    continue
                size = x.shape[1] * width
                g = np.bincount(flat[here].ravel(), np.repeat(grad[here], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                h = np.bincount(flat[here].ravel(), np.repeat(hess[here], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                gain[(h < least) | (h_all - h < least)] = 0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-9:
                    feat[k], cut[k] = j, b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feat[node]] > cut[node])
        leaf = np.array([rate * grad[at].sum() / (hess[at].sum() + 1) for at in (node - inner == i for i in range(inner + 1))])
        score += leaf[node - inner]
        features_.append(feat)
        bins_.append(cut)
        leaves.append(leaf)
    return cuts, np.array(features_), np.array(bins_), np.array(leaves), prior


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function nearest to ``y``, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # of [mean, weight, least x, largest x]
    for at, value in zip(x[order], y[order], strict=True):
        blocks.append([value, 1.0, at, at])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            mean, weight, _, hi = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + mean * weight) / (last[1] + weight)
            last[1] += weight
            last[3] = hi
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] for b in blocks for _ in (0, 1)])
    return xs, ys


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2) -> Trees:
    """Trees on the rows outside ``calibrate``, isotonic steps on those inside."""
    if len(y) == 0 or y.min() == y.max() or not calibrate.any() or y[~calibrate].min() == y[~calibrate].max():
        share = float(y.mean()) if len(y) else 0.0
        none = np.zeros((0, 7), np.int64)
        return Trees([np.zeros(0)] * x.shape[1], none, none, np.zeros((0, 8)), 0.0, np.array([0.0]), np.array([share]))
    cuts, feat, cut, leaf, prior = _boost(x[~calibrate], y[~calibrate].astype(float), rounds, depth, rate, 64, 1.0)
    bare = Trees(cuts, feat, cut, leaf, prior, np.array([0.0]), np.array([0.0]))
    xs, ys = isotonic(bare.raw(x[calibrate]), y[calibrate].astype(float))
    return Trees(cuts, feat, cut, leaf, prior, xs, ys)


# --- Spark ---------------------------------------------------------------------------------------------------------


def held_out(doc_id):
    """Whether a row's label must stay unseen."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic and calibration fold of the training sample: one row for each of at most ``rows`` ids.

    Of rows that share an id, the least text counts; of labels that share one, the greatest. A fifth of the sample, by
    hash of the id, is the fold.
    """
    usable = labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    sample = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # at most ``rows`` ids
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")), "toxicity-sample")


def learn_lexicon(train: DataFrame, keep: int = LEXICON_ROWS, support: int = 6, lift: float = 8.0) -> Lexicon:
    """Words and beginnings far more frequent, by documents, in the toxic training rows."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1))
    total = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return Lexicon({}, {})

    def learn(terms) -> dict[str, float]:
        rows = train.select("toxic", F.explode(terms).alias("term")).groupBy("term").agg(
            F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("good")
        )
        odds = F.log((F.col("bad") / total[1]) / ((F.col("good") + 0.5) / total[0]))
        top = rows.filter(F.col("bad") >= support).withColumn("odds", odds).filter(F.col("odds") >= float(np.log(lift)))
        return {r["term"]: r["odds"] for r in top.orderBy(F.desc("odds"), F.desc("bad"), "term").limit(keep).collect()}

    begins = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= PREFIX), lambda w: F.substring(w, 1, PREFIX)))
    return Lexicon(learn(words), learn(begins))


def train_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Lexicon, Trees]:
    """Lexicon and calibrated trees. Neither sees the rows of the calibration fold."""
    with scratch():
        train = training_rows(docs, labels, rows)
        lex = learn_lexicon(train.filter("NOT fold"))

        @F.pandas_udf("array<double>")
        def dense(text: pd.Series) -> pd.Series:
            return pd.Series([features(t, lex) for t in text])

        got = train.select(dense("text").alias("x"), "toxic", "fold", "doc_id").toPandas().sort_values("doc_id")  # at most ``rows`` rows
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return lex, fit(x, got["toxic"].to_numpy(), got["fold"].to_numpy(bool))


def score_column(lex: Lexicon, trees: Trees):
    """A function from the text column to the score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.array([features(t, lex) for t in text], float).reshape(-1, len(NAMES))))

    return score.asNondeterministic()  # else a filter on it is pushed down and runs it twice


def with_toxicity(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """``docs`` with a column ``toxicity_score``; trained on the labelled rows of ``train_on``, by default ``docs``."""
    lex, trees = train_model(docs if train_on is None else train_on, labels)
    return docs.withColumn("toxicity_score", score_column(lex, trees)(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, decision: float = DECISION) -> DataFrame:
    """The rows of ``docs`` that score below ``decision``, with the columns they had."""
    lex, trees = train_model(docs, labels)
    return docs.filter(score_column(lex, trees)(F.col("text")) < decision)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_toxicity(docs.select("doc_id", "text"), labels)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= DECISION).cast("int").alias("predicted"),
    )
