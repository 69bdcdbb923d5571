import random

import numpy as np
from pyspark.sql import functions as F

from lexshard.llm import elite, frequency
from tests.llm.conftest import NOW


def messy(seed=3, pages=60):
    """Postings with repeated deliveries, spellings, nulls, a page of a tenth of the rows and terms in all pages; and the truth."""
    pick, clean = random.Random(seed), {}
    for d in range(pages):
        for t in ["the", "of"] + [f"w{int(pick.paretovariate(0.6)) % 90}" for _ in range(25 if d else 160)]:
            clean[t, d] = clean.get((t, d), 0) + (pick.randint(1, 4) if d % 3 else 1)
    rows = []
    for (t, d), tf in clean.items():
        rows.append((t if pick.random() < 0.9 else f" {t.upper()}\t", d, tf if pick.random() < 0.9 else None, list(range(tf)), 0, NOW))
        if pick.random() < 0.2:
            rows.append((t.capitalize(), d, tf, None, 7, None))
    lengths = {d: sum(tf for (_, x), tf in clean.items() if x == d) for d in range(pages)}
    stats = [(d, None, None, n if d % 5 else None) for d, n in lengths.items()] * 2
    return clean, lengths, rows + [(None, 1, 1), ("a", None, 1), ("!", 2, 1)], stats


def test_frequencies_and_marks(spark, tables):
    clean, lengths, rows, stats = messy()
    data = tables(postings=rows, docstats=stats, dictionary=[(0, "the", 5), (1, " THE ", 7), (1, "the", None), (0, "only", None)])
    pages, total = {}, {}
    for (t, _), tf in clean.items():
        pages[t], total[t] = pages.get(t, 0) + 1, total.get(t, 0) + tf
    expected = {(t, "rare") for t, n in pages.items() if n <= 2} | {(t, "common") for t, n in pages.items() if n * 10 > len(lengths)}
    found = [tuple(r) for r in frequency.p1_found(spark, data).collect()]
    assert len(found) == len(expected) and set(found) == expected
    got = {r.term: (r.total_tf, r.pages, r.listed_pages) for r in frequency.p1_frequencies(spark, data).collect()}
    assert got.pop("only") == (0, 0, None) and got["the"] == (total["the"], pages["the"], 12)
    assert {t: g[:2] for t, g in got.items()} == {t: (total[t], pages[t]) for t in pages}


def test_standing_out(spark, tables):
    clean, lengths, rows, stats = messy()
    data = tables(postings=rows, docstats=stats)
    total, pages, everything = {}, {}, sum(clean.values())
    for (t, _), tf in clean.items():
        pages[t], total[t] = pages.get(t, 0) + 1, total.get(t, 0) + tf
    rule = {(d, t) for (t, d), tf in clean.items() if tf >= 3 and pages[t] >= 2 and tf * everything >= 20 * total[t] * lengths[d]}
    found = [(r.doc_id, r.term) for r in elite.p2_found(spark, data).collect()]
    assert rule and sorted(found) == sorted(rule)
    scores = {(r.term, r.doc_id): r.score for r in elite.p2_scores(spark, data).collect()}
    assert set(scores) == set(clean) and all(0 <= s <= 1 for s in scores.values())


def test_mixture_finds_its_two_rates():
    """EM on a histogram drawn from a known mixture; scores rise with occurrences; degenerate histograms stay finite."""
    draw = np.random.default_rng(1)
    tf = np.where(draw.random(20_000) < 0.2, draw.poisson(6, 20_000), draw.poisson(0.3, 20_000))
    k, n = np.unique(tf[tf > 0], return_counts=True)
    share, low, high = elite.fit(k, n, np.array([0]), 20_000)
    assert abs(share[0] - 0.2) < 0.02 and abs(low[0] - 0.3) < 0.05 and abs(high[0] - 6) < 0.3
    ks, ns, starts = np.array([1, 1, 500, 0, 3]), np.array([1, 10, 1, 4, 7]), np.array([0, 1, 3, 4])
    for out in elite.fit(ks, ns, starts, 10):
        assert np.isfinite(out).all()
    alone = [elite.fit(ks[a:b], ns[a:b], np.array([0]), 10) for a, b in ((0, 1), (1, 3), (3, 4), (4, 5))]
    together = elite.fit(ks, ns, starts, 10)
    assert all(np.allclose(np.concatenate([x[i] for x in alone]), together[i]) for i in range(3))


def test_distinctive_terms_score_higher(spark, tables):
    rows = [("the", d, 5, None, 0, NOW) for d in range(200)] + [("comet", d, 9 if d < 5 else 1, None, 0, NOW) for d in range(40)]
    scores = {(r.term, r.doc_id): r.score for r in elite.p2_scores(spark, tables(postings=rows, docstats=[(d, None, None, 30) for d in range(200)])).collect()}
    assert scores["comet", 0] > 0.99 and scores["comet", 0] > scores["comet", 30]


def test_the_posterior_decides_and_loses_nothing(spark, tables):
    """Of the candidates the cut on the posterior leaves the stated cases; the whole-number rule finds nothing more to remove."""
    clean, lengths, rows, stats = messy(seed=9, pages=90)
    counts, docstats, pages = elite._inputs(spark, tables(postings=rows, docstats=stats))
    everything = sum(clean.values())
    total = {}
    for (t, _), tf in clean.items():
        total[t] = total.get(t, 0) + tf
    all_ = [(r.doc_id, r.term, r.tf) for r in elite.candidates(counts, docstats, pages).collect()]
    left = {(r.doc_id, r.term) for r in elite.standing_out(elite.candidates(counts, docstats, pages), F.lit(everything)).collect()}
    assert left == {(d, t) for d, t, tf in all_ if tf * everything >= 20 * total[t] * lengths[d]}
    assert 0 < len(left) < len(all_)


def test_counts_beyond_a_long_product(spark):
    """20 * 10^13 * 10^13 is more than a long; of two equal rates one is on the rule, one just below."""
    model = F.struct(F.lit(0.01).alias("share"), F.lit(1.0).alias("lam0"), F.lit(50.0).alias("lam1"))
    rows = spark.createDataFrame([(1, 2 * 10**12), (2, 2 * 10**12 - 1)], "doc_id long, tf long").withColumns({"total_tf": F.lit(10**13), "length": F.lit(10**13), "model": model})
    everything = F.lit(10**15)
    got = elite.standing_out(rows, everything).where(elite.exact(F.col("tf")) * elite.exact(everything) >= F.lit(20) * (elite.exact(F.col("total_tf")) * elite.exact(F.col("length"))))
    assert [r.doc_id for r in got.collect()] == [1]
