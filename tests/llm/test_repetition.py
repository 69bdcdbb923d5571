import datetime
import random

import numpy as np
import pyarrow as pa
import pytest

from lexshard.llm import repetition
from tests.llm.conftest import NOW


def made(n=400, seed=2):
    pick, texts = random.Random(seed), []
    for _ in range(n):
        words = [f"w{pick.randrange(3000)}" for _ in range(pick.randint(0, 120))]
        for _ in range(pick.choice([0, 0, 0, 1, 3, 8])):
            at = pick.randrange(len(words) + 1)
            words += words[at : at + pick.randint(5, 30)]
        texts.append(words)
    return texts + [[], ["a"] * 4, ["a"] * 5, ["a"] * 6, ["a", "b", "c", "d", "e", "a", "b", "c", "d", "e"], ["x"] * 30_000]


def share(words):
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len(runs), len(runs) - len(set(runs))


def test_measure_and_pages_found(spark, tables):
    texts = made()
    rows = [(str(i), None, None, "  ".join(w).title(), NOW) for i, w in enumerate(texts)] + [("0", None, None, "z " * 50, datetime.datetime(2020, 1, 1)), ("9000", "t", None, None, NOW)]
    data = tables(wiki=rows)
    got = {r.id: (r.runs, r.repeated) for r in repetition.p5_shares(spark, data).collect()}
    assert got.pop(9000) == (0, 0)
    assert got == {i: share(w) for i, w in enumerate(texts)}
    expected = {i for i, w in enumerate(texts) if share(w)[0] and 4 * share(w)[1] >= share(w)[0]}
    assert sorted(r.id for r in repetition.p5_found(spark, data).collect()) == sorted(expected) and len(expected) > 40
    judged = {r.id: r.probability for r in repetition.p5_quality(spark, data).collect()}
    held_out = [i for i in expected if len(texts[i]) > 20]
    assert sum(judged[i] >= 0.5 for i in held_out) > 0.7 * len(held_out)


def as_words(texts):
    return pa.array(texts, pa.list_(pa.string()))


def natural(n, seed):
    """Texts of which few repeat themselves, as in a corpus."""
    pick, texts = random.Random(seed), []
    for i in range(n):
        words = [f"w{int(pick.paretovariate(0.5)) % 5000}" for _ in range(pick.randint(0, 150))]
        for _ in range(pick.choice([1, 3, 8]) if i % 12 == 0 else 0):
            at = pick.randrange(len(words) + 1)
            words += words[at : at + pick.randint(5, 40)]
        texts.append(words)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_the_classifier_loses_no_page_and_leaves_few_to_measure(seed):
    """Fitted on some pages, tried on others: what it lets through holds all cases, and most of the rest never gets measured."""
    fitted = as_words(natural(700, seed))
    runs, repeated = repetition.repeated_share(fitted)
    y = (repeated * 4 >= runs)[runs > 0].astype(float)
    model = repetition.Classifier.fit(repetition.features(fitted)[runs > 0], y)
    assert model.fitted
    others = natural(1500, seed + 50)
    probability = model.probability(model.scores(repetition.Grams(as_words(others))))
    measured = probability >= repetition.POSSIBLE
    case = np.array([n > 0 and 4 * again >= n for n, again in map(share, others)])
    assert case.sum() > 20 and measured[case].all()
    assert measured[~case].mean() < 0.3
    assert (probability[case] >= 0.5).mean() > 0.8 and (probability[~case] < 0.5).mean() > 0.95


def test_words_parts_add_up_to_the_bag():
    words = as_words(made(60, 3))
    weights = np.random.default_rng(1).normal(size=repetition.BAG)
    grams = repetition.Grams(words)
    assert np.allclose(grams.bags() @ weights, grams.bag_scores(weights))
    assert np.allclose(grams.bags().sum(1)[[i for i, w in enumerate(made(60, 3)) if w == ["x"] * 30_000]], 1)


def test_hashed_shares_are_never_below_the_exact_ones():
    texts = made(200, 7)
    x = repetition.Grams(as_words(texts)).shares()
    for i, w in enumerate(texts):
        n, again = share(w)
        assert n == 0 or x[i, repetition.WORD_GRAMS.index(repetition.RUN)] >= again / n - 1e-12


def test_too_little_to_learn_from():
    """Nothing is fitted, and every page counts as possible."""
    x = np.random.default_rng(3).normal(size=(50, repetition.BAG + repetition.SHARES))
    for y in (np.zeros(50), np.ones(50), np.append(np.zeros(49), 1)):
        model = repetition.Classifier.fit(x, y)
        assert not model.fitted and (model.probability(np.zeros(3)) >= repetition.POSSIBLE).all()
    assert not repetition.Classifier.fit(x[:0], np.zeros(0)).fitted


def test_a_small_part_of_the_pages_is_labelled(spark, tables, monkeypatch):
    texts = natural(900, 8)
    data = tables(wiki=[(str(i), None, None, " ".join(w), NOW) for i, w in enumerate(texts)])
    monkeypatch.setattr(repetition, "TRAIN_ROWS", 300)
    assert repetition.trained(repetition.deliveries(spark.read.parquet(f"{data}/wiki.parquet"))).fitted
    assert {r.id for r in repetition.p5_found(spark, data).collect()} == {i for i, w in enumerate(texts) if share(w)[0] and 4 * share(w)[1] >= share(w)[0]}
