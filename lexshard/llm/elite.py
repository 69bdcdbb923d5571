"""Problem 2: how distinctive a term is of a page, by a mixture of two Poisson distributions per term.

Pages are about what a term names (elite pages, where it occurs at rate lam1) or only mention it (rate lam0).
The mixture of each term is fitted by expectation-maximisation on its frequency histogram: how many pages hold it
once, twice and so on, and how many don't. The posterior probability of the elite component at a given number of
occurrences is the score. A histogram has as many entries as a term has different frequencies, so it is small even
where a term holds a third of all postings; it is built by counting, which combines on the map side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexshard.operators.postings import clean_docstats, clean_postings
from lexshard.plans.sql import CLEAN_DOCSTATS, CLEAN_POSTINGS
from lexshard.session import single, table

#: What p2_found asks for: so many occurrences, so many pages, so many times the rate of the whole collection.
MIN_TF, MIN_PAGES, RATIO = 3, 2, 20
ROUNDS = 40
#: Share of the log-odds by which rounding may be wrong.
SLACK = 1e-9
_TINY = 1e-9


def fit(ks: np.ndarray, ns: np.ndarray, starts: np.ndarray, pages: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of elite pages, lam0, lam1) of each histogram; all histograms at once.

    Histogram i is ns[j] pages with ks[j] occurrences each, for j from starts[i] up to the next start; the rest of
    all pages hold none.
    """
    ks, ns = ks.astype(float), ns.astype(float)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ks))))
    held, total = np.add.reduceat(ns, starts), np.add.reduceat(ns * ks, starts)
    everything = np.maximum(pages, held)
    none = everything - held
    lam1 = np.maximum(total / held, _TINY) * 1.5
    lam0 = np.maximum(total / everything, _TINY) / 2
    share = np.clip(held / everything / 2, _TINY, 1 - _TINY)
    for _ in range(ROUNDS):
        prior, slope, gap = np.log(share / (1 - share)), np.log(lam1 / lam0), lam1 - lam0
        post = 1 / (1 + np.exp(-np.clip((prior - gap)[of] + ks * slope[of], -700, 700)))
        post_none = 1 / (1 + np.exp(-np.clip(prior - gap, -700, 700)))
        elite = np.add.reduceat(ns * post, starts) + none * post_none
        occurs = np.add.reduceat(ns * ks * post, starts)
        share = np.clip(elite / everything, _TINY, 1 - _TINY)
        lam1 = np.maximum(occurs / np.maximum(elite, _TINY), _TINY)
        lam0 = np.maximum((total - occurs) / np.maximum(everything - elite, _TINY), _TINY)
        flip = lam1 < lam0
        lam0, lam1, share = np.where(flip, lam1, lam0), np.where(flip, lam0, lam1), np.where(flip, 1 - share, share)
    return share, lam0, lam1


MODEL = T.StructType([T.StructField(x, T.DoubleType()) for x in ("share", "lam0", "lam1")])


@F.arrow_udf(MODEL)
def _mixture(ks: pa.Array, ns: pa.Array, pages: pa.Array) -> pa.Array:
    """Terms with equal histograms (most are rare) share one fit within a batch."""
    offsets = ks.offsets.to_numpy()
    k, n = ks.values.to_numpy().astype(np.int64), ns.values.to_numpy().astype(np.int64)
    seen: dict[bytes, int] = {}
    which, first = np.empty(len(ks), np.int64), []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        key = k[a:b].tobytes() + n[a:b].tobytes()
        if (at := seen.setdefault(key, len(first))) == len(first):
            first.append(i)
        which[i] = at
    spans = [np.arange(offsets[i], offsets[i + 1]) for i in first]
    starts = np.cumsum([0, *map(len, spans)])[:-1]
    cells = np.concatenate(spans) if spans else np.empty(0, np.int64)
    fitted = fit(k[cells], n[cells], starts, float(pages[0].as_py())) if first else (np.empty(0),) * 3
    return pa.StructArray.from_arrays([pa.array(x[which]) for x in fitted], ["share", "lam0", "lam1"])


def term_models(counts: DataFrame, all_pages: int) -> DataFrame:
    """(term, pages, total_tf, model) from (term, doc_id, tf), one row per term and page."""
    cells = counts.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))
    by_term = cells.groupBy("term").agg(
        F.sort_array(F.collect_list(F.struct(F.col("tf").alias("k"), "n"))).alias("h"), F.sum("n").alias("pages"), F.sum(F.col("n") * F.col("tf")).cast("long").alias("total_tf")
    )
    return by_term.select("term", "pages", "total_tf", _mixture(F.col("h.k"), F.col("h.n"), F.lit(all_pages)).alias("model"))


def log_odds(model: Column, tf: Column) -> Column:
    """Of the elite component at tf occurrences; never falls as tf grows, as lam1 >= lam0."""
    share, lam0, lam1 = (model.getField(x) for x in ("share", "lam0", "lam1"))
    return F.log(share / (1 - share)) - (lam1 - lam0) + tf * F.log(lam1 / lam0)


def elite_probability(model: Column, tf: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds(model, tf)))


def scored(counts: DataFrame, all_pages: int) -> DataFrame:
    """(term, doc_id, tf, pages, total_tf, model): every posting beside the mixture of its term.

    Each term is one row on the right, so a hot term's postings may be split over tasks as skewed joins are.
    """
    return counts.join(term_models(counts, all_pages), "term")


def page_lengths(counts: DataFrame, docstats: DataFrame) -> DataFrame:
    """(doc_id, length): as docstats has it, else the sum of tf over the page's postings."""
    summed = counts.groupBy("doc_id").agg(F.sum("tf").alias("summed"))
    return summed.join(clean_docstats(docstats), "doc_id", "left").select("doc_id", F.coalesce("length", "summed").alias("length"))


def _inputs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame, int]:
    docstats = table(spark, data_dir, "docstats")
    (pages,) = single(docstats.agg(F.countDistinct("doc_id")))
    return clean_postings(table(spark, data_dir, "postings")), docstats, pages


def p2_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    """(term, doc_id, tf, score): the posterior probability that the page is an elite page of the term, for every clean posting."""
    counts, _, pages = _inputs(spark, data_dir)
    return scored(counts, pages).select("term", "doc_id", "tf", elite_probability(F.col("model"), F.col("tf")).alias("score"))


def exact(number: Column) -> Column:
    """For products that a long can't hold."""
    return number.cast("decimal(19,0)")


def least_count(total_tf: Column, length: Column, everything: Column) -> Column:
    """From how many occurrences on a term stands out in a page of this length; needn't be whole."""
    return F.greatest(F.lit(float(MIN_TF)), RATIO * total_tf.cast("double") / everything.cast("double") * length.cast("double"))


def standing_out(postings: DataFrame, everything: Column) -> DataFrame:
    """The rows of (tf, total_tf, length, model, ...) whose elite log-odds reach those of the least count.

    Log-odds are linear in the count and don't fall, so none is lost; SLACK covers the rounding of doubles.
    """
    at, cut = (log_odds(F.col("model"), x) for x in (F.col("tf"), least_count(F.col("total_tf"), F.col("length"), everything)))
    return postings.where(at >= cut - SLACK * (1 + F.abs(cut)))


def candidates(counts: DataFrame, docstats: DataFrame, pages: int) -> DataFrame:
    """(term, doc_id, tf, pages, total_tf, model, length): postings of MIN_TF or more, of terms in MIN_PAGES or more pages."""
    models = term_models(counts, pages).where(F.col("pages") >= MIN_PAGES)
    return counts.where(F.col("tf") >= MIN_TF).join(models, "term").join(page_lengths(counts, docstats), "doc_id")


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, term): the terms that clearly stand out in a page, by the posterior against the cut of each posting.

    What rounding might let through is tested in whole numbers after.
    """
    counts, docstats, pages = _inputs(spark, data_dir)
    everything = counts.agg(F.sum("tf")).scalar()
    rule = exact(F.col("tf")) * exact(everything) >= F.lit(RATIO) * (exact(F.col("total_tf")) * exact(F.col("length")))
    return standing_out(candidates(counts, docstats, pages), everything).where(rule).select("doc_id", "term")


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}

SQL = {
    "p2_found": f"""WITH {CLEAN_POSTINGS}, {CLEAN_DOCSTATS},
        t AS (SELECT term, count(*) AS pages, sum(tf) AS total FROM clean GROUP BY term), s AS (SELECT doc_id, sum(tf) AS summed FROM clean GROUP BY doc_id)
        SELECT doc_id, term FROM clean JOIN t USING (term) JOIN s USING (doc_id) LEFT JOIN pages p USING (doc_id)
        WHERE tf >= {MIN_TF} AND t.pages >= {MIN_PAGES} AND tf * (SELECT sum(tf) FROM clean) >= {RATIO} * total * coalesce(p.length, summed)""",
}
