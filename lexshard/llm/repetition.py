"""Problem 5: how much of a page's text repeats what the page has said before.

The measure is exact: the share of runs of RUN successive words that equal an earlier run of the page. Only pages that
a classifier finds possibly repetitive are measured: logistic regression over hashed word and character n-grams, trained
on labelled pages (the label is whether the share reaches the threshold, measured on a bounded sample), calibrated on
held-out ones, scored in Arrow batches against fixed thresholds of the probability.

The features of a page are its hashed words and their character n-grams, as means over its words, and how many of its
word n-grams fall into a slot of a table that an earlier one has taken. The former are linear, so a word's part in the
score is worked out once per different word of a batch; the latter need no sorting. So scoring costs less than measuring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.functions.words import bytes_of, coded, hashes, mixed, pieces, split_words
from lexshard.plans.sql import words_sql
from lexshard.session import single, spread, table

#: A page counts whose share of repeated runs of RUN words is at least 1/SHARE.
RUN, SHARE = 5, 4
#: Labelled pages the classifier is fitted and calibrated on, at most.
TRAIN_ROWS = 2000
#: Pages are reported as repetitive from this calibrated probability on.
PROBABLE = 0.5
#: Pages below this calibrated probability are not measured.
POSSIBLE = 0.01
#: Slots of the tables that tell repeated n-grams, for each n-gram of a page: the more, the less seems to repeat by chance.
ROOM = 8
_BITS = 8
BAG = 1 << _BITS
WORD_GRAMS, CHAR_GRAMS = (2, RUN), (2, 3)
SHARES = len(WORD_GRAMS)
#: Penalties of the weights: the shares tell most and are let free.
_RIDGE = np.append(np.full(BAG, 1.0), np.full(SHARES, 0.01))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _distinct(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of n pages has."""
    if not len(of):
        return np.zeros(n, np.int64)
    order = np.lexsort((values, of))
    o, v = of[order], values[order]
    new = np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1]))
    return np.bincount(o[new], minlength=n)


def repeated_share(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, repeated runs) of each page, exactly: runs are numbered by doubling, so nothing is hashed."""
    ends, code, _ = coded(words)
    lengths, n = np.diff(ends), len(words)
    of = np.repeat(np.arange(n), lengths)

    def joined(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the runs of length, from those of its two overlapping parts a and b."""
        if not len(a):
            return a
        return np.unique(a * np.int64(max(int(b.max()), 0) + 1) + b, return_inverse=True)[1].reshape(-1)

    two = joined(code[:-1], code[1:], 2)
    four = joined(two[:-2], two[2:], 4)
    five = joined(four[:-1], code[4:], 5) if len(code) >= RUN else np.empty(0, np.int64)
    inside = of[: len(five)] == of[RUN - 1 : RUN - 1 + len(five)]
    runs = np.maximum(lengths - RUN + 1, 0)
    return runs, runs - _distinct(of[: len(five)][inside], five[inside], n)


class Grams:
    """The n-grams of a batch of pages: what the classifier's features are made of."""

    def __init__(self, words: pa.ListArray) -> None:
        self.ends, self.code, names = coded(words)
        self.lengths = np.diff(self.ends)
        self.hashed = hashes(names).view(np.uint64)
        raw, at = bytes_of(names)
        chars, of = raw.astype(np.uint64), np.repeat(np.arange(len(names)), np.diff(at))
        # the bag's slots of each different word: the word itself, then its character n-grams
        slots, owner = [self.hashed], [np.arange(len(names))]
        for length in CHAR_GRAMS:
            m = max(len(chars) - length + 1, 0)
            gram = np.full(m, length, np.uint64)
            for k in range(length):
                gram = gram * _MIX + chars[k : k + m]
            inside = of[:m] == of[length - 1 : length - 1 + m]
            slots.append(mixed(gram[inside]))
            owner.append(of[:m][inside])
        self.slots = (np.concatenate(slots) >> np.uint64(64 - _BITS)).astype(np.int64)
        self.owner = np.concatenate(owner)

    def bags(self) -> np.ndarray:
        """pages x BAG: hashed words and character n-grams, as means over a page's words; dense, for the training pages."""
        out = np.zeros((len(self.lengths), BAG))
        order = np.argsort(self.owner, kind="stable")
        slots, starts = self.slots[order], np.searchsorted(self.owner[order], np.arange(len(self.hashed) + 1))
        for page, (a, b) in enumerate(zip(self.ends[:-1], self.ends[1:])):
            words, many = np.unique(self.code[a:b], return_counts=True)
            for w, n in zip(words.tolist(), many.tolist()):
                np.add.at(out[page], slots[starts[w] : starts[w + 1]], n)
        return out / np.maximum(self.lengths, 1)[:, None]

    def bag_scores(self, weights: np.ndarray) -> np.ndarray:
        """bags() @ weights without the bags: a word's part is worked out once."""
        value = np.bincount(self.owner, weights[self.slots], len(self.hashed))
        total = np.append(0.0, np.cumsum(value[self.code]))
        return (total[self.ends[1:]] - total[self.ends[:-1]]) / np.maximum(self.lengths, 1)

    def shares(self) -> np.ndarray:
        """pages x SHARES: of each length in WORD_GRAMS the share of n-grams whose slot an earlier one took.

        Equal n-grams share a slot, so it is never below the true share.
        """
        hashed, out = self.hashed[self.code], np.zeros((len(self.lengths), SHARES))
        gram = np.zeros(len(hashed), np.uint64)
        for length in range(1, RUN + 1):
            m = max(len(hashed) - length + 1, 0)
            gram = gram[:m] * _MIX + hashed[length - 1 : length - 1 + m]
            if length in WORD_GRAMS:
                total = np.maximum(self.lengths - length + 1, 0)
                bits = np.ceil(np.log2(np.maximum(total, 1) * ROOM)).astype(np.uint64)
                first = np.append(0, np.cumsum(1 << bits.astype(np.int64)))
                at = np.repeat(self.ends[:-1], total) + np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
                taken = np.zeros(first[-1], np.uint8)
                taken[np.repeat(first[:-1], total) + (mixed(gram[at]) >> np.repeat(np.uint64(64) - bits, total)).astype(np.int64)] = 1
                different = np.add.reduceat(taken, first[:-1], dtype=np.int64) if len(total) else total
                out[:, WORD_GRAMS.index(length)] = np.where(total > 0, 1 - different / np.maximum(total, 1), 0)
        return out


def features(words: pa.ListArray) -> np.ndarray:
    """Per page the BAG and the SHARES, for training."""
    grams = Grams(words)
    return np.hstack([grams.bags(), grams.shares()])


@dataclass
class Classifier:
    """Weights of the features, and the scale and shift that turn a score into a probability."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    fitted: bool = True

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Classifier:
        """Fitted on all rows; calibrated on scores that each row got from the other two thirds of the rows.

        Calibration has the usual smoothed targets, so that few rows of a label don't make it sure of itself. Where
        there is too little to learn from, or a row of the label falls below POSSIBLE when held out, nothing is fitted:
        every page then has probability 1/2 and is measured.
        """
        none = cls(np.zeros(BAG + SHARES), 0.0, 1.0, 0.0, False)
        part = np.arange(len(y)) % 3
        if len(y) < 30 or any(min(y[part != k].sum(), (1 - y[part != k]).sum()) < 2 for k in range(3)):
            return none
        held_out = np.zeros(len(y))
        for k in range(3):
            w, b = _logistic(x[part != k], y[part != k], _RIDGE)
            held_out[part == k] = x[part == k] @ w + b
        yes, no = y.sum(), (1 - y).sum()
        scale, shift = _logistic(held_out[:, None], np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2)), np.array([1e-2]))
        w, b = _logistic(x, y, _RIDGE)
        model = cls(w, b, max(float(scale[0]), 1e-3), float(shift))
        return model if (model.probability(held_out)[y > 0] >= POSSIBLE).all() else none

    def scores(self, grams: Grams) -> np.ndarray:
        return grams.bag_scores(self.weights[:BAG]) + grams.shares() @ self.weights[BAG:] + self.bias

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * score + self.shift, -700, 700)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps, halved where they overshoot."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(ridge, 1e-6)
    w = np.zeros(x1.shape[1])

    def loss(v):
        z = x1 @ v
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ v**2

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -500, 500)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (p - y) + penalty * w)
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, gain, now = w - step, now - new, new
        if gain < 1e-7:
            break
    return w[:-1], float(w[-1])


def deliveries(wiki: DataFrame) -> DataFrame:
    """(id, seen, text): every delivery of a page; ids that aren't numbers are dropped."""
    return spread(wiki.select(F.expr("try_cast(id AS bigint)").alias("id"), F.col("fetched_at").alias("seen"), "text").where(F.col("id").isNotNull()))


def trained(pages: DataFrame) -> Classifier:
    """Fitted on at most TRAIN_ROWS deliveries, those with the smallest hashes of id and text, as far as they have a run."""

    def label(batches):
        for batch in batches:
            words = split_words(batch.column("text"))
            runs, repeated = repeated_share(words)
            x = features(words).astype(np.float32)[runs > 0]
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), BAG + SHARES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array((repeated * SHARE >= runs)[runs > 0].astype(np.int32)), rows], ["y", "x"])

    texts = pages.where(F.col("text").isNotNull()).withColumn("place", F.xxhash64("id", "text"))
    (many,) = single(pages.agg(F.count(F.lit(1))))
    # a part of the places holds about twice the rows wanted: the sort sees few
    some = texts.where(F.pmod("place", F.lit(max(many // (2 * TRAIN_ROWS), 1))) == 0)
    got = some.orderBy("place", "id", "seen").limit(TRAIN_ROWS).mapInArrow(label, "y int, x array<float>").toArrow().combine_chunks()
    x = got.column("x").combine_chunks()
    flat = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().reshape(-1, BAG + SHARES) if got.num_rows else np.empty((0, BAG + SHARES))
    return Classifier.fit(flat.astype(np.float64), got.column("y").to_numpy().astype(np.float64))


def last_of(pages: DataFrame, measure, columns: str) -> DataFrame:
    """(id, columns): one row per page, as its last delivery has it; measure maps the words of a batch to the columns."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                values = measure(split_words(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("seen"), *map(pa.array, values)], ["id", "seen", *names])

    names = [c.split()[0] for c in columns.split(", ")]
    rows = pages.mapInArrow(run, f"id long, seen timestamp, {columns}")
    return rows.groupBy("id").agg(F.max(F.struct("seen", *names)).alias("x")).select("id", *(f"x.{c}" for c in names))


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(id): the pages whose share of repeated runs is at least 1/4: measured where the classifier finds that possible.

    A page with fewer than RUN words has no runs and is not found; an empty table gives no rows.
    """
    pages = deliveries(table(spark, data_dir, "wiki"))
    shared = spark.sparkContext.broadcast(trained(pages))

    def measure(words):
        model, found = shared.value, np.zeros(len(words), bool)
        at = np.flatnonzero(model.probability(model.scores(Grams(words))) >= POSSIBLE) if model.fitted else np.arange(len(words))
        runs, repeated = repeated_share(words.take(pa.array(at)))
        found[at] = (runs > 0) & (repeated * SHARE >= runs)
        return (found,)

    return last_of(pages, measure, "found boolean").where("found").select("id")


def p5_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    """(id, runs, repeated): the measure itself for every page."""
    return last_of(deliveries(table(spark, data_dir, "wiki")), repeated_share, "runs long, repeated long")


def p5_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    """(id, probability, repetitive): the calibrated judgement of the classifier for every page."""
    pages = deliveries(table(spark, data_dir, "wiki"))
    shared = spark.sparkContext.broadcast(trained(pages))
    judged = last_of(pages, lambda words: (shared.value.probability(shared.value.scores(Grams(words))),), "probability double")
    return judged.withColumn("repetitive", F.col("probability") >= PROBABLE)


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares, "p5_quality": p5_quality}

_RUNS = f"""WITH d AS (SELECT try_cast(id AS BIGINT) AS id, fetched_at, {words_sql('text')} AS w FROM wiki),
    l AS (SELECT id, arg_max(w, fetched_at) AS w FROM d WHERE id IS NOT NULL GROUP BY id),
    r AS (SELECT id, greatest(len(w) - {RUN - 1}, 0) AS runs, list_transform(range(1, greatest(len(w) - {RUN - 2}, 1)), lambda i: array_to_string(w[i:i + {RUN - 1}], ' ')) AS rs FROM l),
    m AS (SELECT id, runs::BIGINT AS runs, (runs - len(list_distinct(rs)))::BIGINT AS repeated FROM r)"""
SQL = {
    "p5_found": f"{_RUNS} SELECT id FROM m WHERE runs > 0 AND repeated * {SHARE} >= runs",
    "p5_shares": f"{_RUNS} SELECT id, runs, repeated FROM m",
}
