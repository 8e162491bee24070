"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts (P) and unlabelled texts (U) only; labels of clean
texts are never used as negatives. The risk is corrected by the class prior pi and kept non-negative (nnPU):

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))

with the sigmoid loss; when the bracket is negative, its gradient is followed upwards. Features are whether a text has a word, or a
word that begins with certain 4 to 6 letters, hashed; those are kept whose rates in P and U differ beyond
chance. Presence, unlike shares, doesn't fade in long texts.

Training happens on the driver over bounded samples of rows (about MOST_P and MOST_U at most, drawn by hash). What features are
chosen from is counted over all rows that may be learnt from, and scoring runs over all documents. What counts as beyond chance and the
regularisation were chosen by training on fold 0 and validating on fold 2, and the other way round; fold 1 had no part in it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_texts

#: Bounds of the training samples.
MOST_P, MOST_U = 4000, 12_000
BITS = 20
FEATURES = 4096
#: Texts of P that a feature must be in.
IN_P = 3
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[int, ...]:
    h = lambda s: zlib.crc32(s.encode()) & ((1 << BITS) - 1)
    return (h("=" + word), *(h("^" + word[:n]) for n in (4, 5, 6) if len(word) > n))


def present(text: str | None) -> list[int]:
    return sorted({f for w in set(_WORD.findall((text or "").lower())) for f in features(w)})


def fold(id: Column) -> Column:
    """crc32(id as text) mod 3; 1 is held out."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 3


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, drawn by a hash of their place (so rows that repeat are drawn apart); all of them where there are fewer."""
    n = rows.count()
    u = F.shiftrightunsigned(F.xxhash64(F.lit(3), "_row"), 11) / F.lit(float(1 << 53))
    return rows if n <= most else rows.where(u < F.lit(0.95 * most / n))


def _features(rows: DataFrame) -> list[np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"f": [np.array(present(t), np.int32).tobytes() for t in b["_text"]]})

    return [np.frombuffer(r[0], np.int32) for r in rows.select("_text").mapInPandas(run, "f binary").collect()]


class Among:
    """The features of texts that are in a table; remembers what words gave."""

    def __init__(self, table: dict[int, float]) -> None:
        self.table, self.memo = table, {}

    def __call__(self, text: str | None) -> set[int]:
        seen, table, memo = set(), self.table, self.memo
        for w in set(_WORD.findall((text or "").lower())):
            f = memo.get(w)
            if f is None:
                if len(memo) > 150_000:
                    memo.clear()
                f = memo[w] = tuple(x for x in features(w) if x in table)
            if f:
                seen.update(f)
        return seen


def _counted(rows: DataFrame, asked: np.ndarray) -> np.ndarray:
    """In how many of all rows each of the features `asked` is: one number a feature reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        among, n = Among({int(f): i for i, f in enumerate(asked)}), np.zeros(len(asked), np.int64)
        for b in batches:
            for t in b["_text"]:
                for f in among(t):
                    n[among.table[f]] += 1
        yield pd.DataFrame({"i": np.flatnonzero(n), "n": n[n > 0]})

    out = np.zeros(len(asked))
    for r in rows.select("_text").mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def in_many(p: list[np.ndarray], least: int = IN_P) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts): those in at least `least` of the texts."""
    n = np.bincount(np.concatenate(p), minlength=1 << BITS) if p else np.zeros(1, np.int64)
    return np.flatnonzero(n >= least), n[n >= least].astype(float)


def select_features(asked: np.ndarray, a: np.ndarray, n: int, b: np.ndarray, m: int, most: int = FEATURES) -> np.ndarray:
    """Of the features `asked`, in `a` of `n` positive and `b` of `m` unlabelled texts, those whose rates differ beyond chance, the most telling `most` of them.

    Beyond chance: a likelihood ratio statistic of 2 ln(number of features asked), which of so many about one reaches by chance.
    """
    if not n or not m or not len(asked):
        return np.zeros(0, np.int64)

    def g(k: np.ndarray, of: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (of * rate)), 0) + np.where(k < of, (of - k) * np.log((1 - k / of) / (1 - rate)), 0)

    rate = (a + b) / (n + m)
    stat = np.where(rate < 1, 2 * (g(a, n) + g(b, m)), 0)
    best = np.argsort(-stat, kind="stable")[:most]
    return np.sort(asked[best[stat[best] >= 2 * np.log(len(asked))]])


def train(p: list[np.ndarray], u: list[np.ndarray], prior: float, chosen: np.ndarray, steps: int = 1200, rate: float = 0.02, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk (Adam, mini-batches, fixed seed)."""
    at = np.full(1 << BITS, -1, np.int64)
    at[chosen] = np.arange(len(chosen))

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(chosen) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(rows):
            k = at[r]
            x[i, k[k >= 0]] = 1
        return x

    random = np.random.default_rng(0)
    w = np.zeros(len(chosen) + 1, np.float64)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    if not p or not u:
        return w[:-1], float(w[-1])
    for step in range(1, steps + 1):
        xp = dense([p[i] for i in random.integers(0, len(p), 128)])
        xu = dense([u[i] for i in random.integers(0, len(u), 384)])
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (xp, xu))
        # sigmoid loss: positive 1 - s, negative s
        gp, gu = (s * (1 - s) for s in (sp, su))
        plus = -(gp @ xp) / len(xp)
        minus = (gu @ xu) / len(xu) - prior * (gp @ xp) / len(xp)
        gap = su.mean() - prior * sp.mean()
        g = prior * plus + minus if gap >= 0 else -minus
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) learnt from the rows whose `fold` is not 1. The prior is the share of toxic labels among those."""
    told = labels.where(fold(F.col(id)) != 1).groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_y"))
    counts = told.agg(F.sum((F.col("_y") == 1).cast("long")).alias("p"), F.count("_y").alias("n")).first()
    prior = min(0.5, max(0.01, (counts["p"] or 0) / max(counts["n"], 1)))
    known = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")).where(fold(F.col("_id")) != 1)
    # about MOST_P ids at most are broadcast, so no text is shuffled; their rows are drawn once more, for ids may repeat
    ids = _drawn(told.where("_y = 1").select("_id", F.xxhash64("_id").alias("_row")), MOST_P).select("_id")
    p = _features(_drawn(known.join(F.broadcast(ids), "_id", "left_semi"), MOST_P))
    asked, a = in_many(p)
    m = known.count()
    chosen = select_features(asked, a, len(p), _counted(known, asked), m) if len(asked) else asked
    u = _features(_drawn(known, MOST_U))
    weights, bias = train(p, u, prior, chosen)
    return chosen, weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for every text (null counts as empty), from the text alone."""
    chosen, weights, bias = model
    table = dict(zip(map(int, chosen), map(float, weights), strict=True))

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        among = Among(table)
        for texts in series:
            out = np.array([bias + sum(table[f] for f in sorted(among(t))) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    rate = F.pandas_udf(run, "double")
    return docs.withColumn(into, rate(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `held_out` (fold 1), `score` (0 to 1) and `predicted` (1 from `threshold` on).

    Labels of held-out rows are never read. Without toxic labels every score is the same, below one half. Null, empty and
    repeated texts score like any other, equal texts alike; no rows in, no rows out. Columns of those names are replaced.
    """
    whole_texts(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    out = score(docs, fit(docs, labels, id, text), text)
    return out.withColumn("held_out", fold(F.col(id)) == 1).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
