"""Where documents come from: JSON lines, the tables at hand, and a synthetic corpus of topics."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexshard.session import table

_JSON = "title string, url string, text string"


def load_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, title, url, body) of a file or folder of JSON lines.

    Blank lines, lines that are no object, and blank texts are skipped; a missing or null field is an empty string; an
    id in the data is ignored. doc_id counts the rest from 0 in the order of files and lines. limit 0 or None: all.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.where(F.col("value").rlike("(?U)\\S")).select(F.from_json("value", _JSON).alias("j"), "file", "block", "line")
    docs = rows.select(F.coalesce("j.title", F.lit("")).alias("title"), F.coalesce("j.url", F.lit("")).alias("url"), F.coalesce("j.text", F.lit("")).alias("body"), "file", "block", "line")
    docs = docs.where(F.col("body").rlike("(?U)\\S"))
    # lines of a block are in order within their partition; blocks are numbered by how many lines come before
    counts = docs.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) - 1
    out = docs.withColumn("within", within).join(before.select("file", "block", "before"), ["file", "block"]).select((F.col("before") + F.col("within")).alias("doc_id"), "title", "url", "body")
    return out.where(F.col("doc_id") < limit) if limit else out


def documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """The documents table as (doc_id, title, url, body); rows without an id are none."""
    return table(spark, data_dir, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "title", "url", F.col("text").alias("body"))


# A synthetic corpus. Words are made from syllables, so no word lists are needed; draws are hashes of (seed, document,
# place), so every document can be made anywhere, and again.

# The names of the topics, and the connecting words (all but a few of them stop words).
TOPICS = ("machine_learning", "astronomy", "cooking", "music", "medicine", "finance", "history", "geography", "sports", "law", "chemistry", "computing")
CONNECTORS = ("the", "of", "and", "to", "in", "is", "was", "for", "with", "that", "as", "on", "by", "an", "this", "from", "at", "which", "has", "are", "it", "its", "been", "their")
_CONSONANTS, _VOWELS = "bcdfghklmnprstvw", "aeiou"


def made_word(number: int, syllables: int) -> str:
    """The number-th word of so many consonant-vowel syllables."""
    out = ""
    for _ in range(syllables):
        number, s = divmod(number, len(_CONSONANTS) * len(_VOWELS))
        out += _CONSONANTS[s // len(_VOWELS)] + _VOWELS[s % len(_VOWELS)]
    return out


def background_vocabulary(n: int = 4000) -> list[str]:
    """n different words of two or three syllables, sorted."""
    return sorted({made_word(i * 7 + 3, 2) for i in range(n // 4)} | {made_word(i * 131 + 17, 3) for i in range(n - n // 4)})[:n]


def topic_vocabulary(topic: int, n: int = 24) -> list[str]:
    """n words of four syllables that only this topic has."""
    return [made_word(topic * 1_000_003 + i * 7919 + 11, 4) for i in range(n)]


def zipf_cumulative(n: int) -> list[float]:
    """Sums of 1/1, 1/2, ... 1/n, as shares of the last."""
    total, out = 0.0, []
    for i in range(n):
        total += 1.0 / (i + 1)
        out.append(total)
    return [x / total for x in out]


def _draw(seed: int, what: int, *keys: Column) -> Column:
    """Evenly from 0 to 1, the same for the same keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(words: list[str], u: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(words)), " "), F.floor(u * len(words)).cast("int"))


def _zipf(words: list[str], u: Column) -> Column:
    """By rank: the first word whose cumulative Zipf weight exceeds u, which is below 1.

    A table at even steps of u bounds the rank, from both sides; the few weights between are compared with u.
    """
    cumulative, steps = zipf_cumulative(len(words)), 4096
    at = [bisect_right(cumulative, s / steps) for s in range(steps)] + [len(words) - 1]
    row = lambda values, kind: F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")
    step = F.floor(u * steps).cast("int")
    low = F.get(row(at[:-1], "int"), step)
    between = F.slice(row(cumulative, "double"), low + 1, F.get(row([b - a for a, b in zip(at, at[1:])], "int"), step))
    return F.get(F.split(F.lit(" ".join(words)), " "), low + F.size(F.filter(between, lambda c: c <= u)))


def synthetic_corpus(spark: SparkSession, n_docs: int = 20000, seed: int = 7, min_len: int = 60, max_len: int = 260, n_spam: int = 250, spam_len: int = 1800) -> DataFrame:
    """(doc_id, title, url, body, topic): n_docs of twelve topics, then n_spam long ones of all topics' words (topic spam).

    A word is a connector (40 %), of the topic (28 %), of one other topic (7 %) or Zipfian background (25 %); in spam a
    word of any topic (70 %) or a connector.
    """
    doc, spam = F.col("doc_id"), F.col("doc_id") >= n_docs
    topics = [topic_vocabulary(t) for t in range(len(TOPICS))]
    per, every = len(topics[0]), [w for t in topics for w in t]
    rows = spark.range(n_docs + n_spam).withColumnRenamed("id", "doc_id")
    topic = F.floor(_draw(seed, 1, doc) * len(TOPICS)).cast("int")
    other = F.pmod(topic + 1 + F.floor(_draw(seed, 2, doc) * (len(TOPICS) - 1)).cast("int"), F.lit(len(TOPICS)))
    length = F.when(spam, spam_len).otherwise(min_len + F.floor(_draw(seed, 3, doc) * (max_len - min_len + 1)).cast("int"))
    rows = rows.select("doc_id", topic.alias("t"), other.alias("o"), length.alias("n"))
    of_topic = lambda t, u: F.get(F.split(F.lit(" ".join(every)), " "), t * per + F.floor(u * per).cast("int"))

    def word(i: Column) -> Column:
        r, u = _draw(seed, 4, doc, i), _draw(seed, 5, doc, i)
        plain = F.when(r < 0.40, _pick(CONNECTORS, u)).when(r < 0.68, of_topic(F.col("t"), u)).when(r < 0.75, of_topic(F.col("o"), u)).otherwise(_zipf(background_vocabulary(), u))
        return F.when(spam, F.when(r < 0.7, _pick(every, u)).otherwise(_pick(CONNECTORS, u))).otherwise(plain)

    name = F.get(F.array(*map(F.lit, TOPICS)), F.col("t"))
    title = F.when(spam, F.concat(F.lit("Spam page "), doc)).otherwise(F.concat(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" article "), doc))
    url = F.concat(F.lit("https://example.org/"), F.when(spam, "spam/").otherwise("doc/"), doc)
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), word), " ")
    return rows.select("doc_id", title.alias("title"), url.alias("url"), body.alias("body"), F.when(spam, "spam").otherwise(name).alias("topic"))


def topic_queries(per_topic: int = 3) -> list[tuple[int, str]]:
    """A query of each topic's first words."""
    return [(t, " ".join(topic_vocabulary(t)[:per_topic])) for t in range(len(TOPICS))]


def topic_qrels(corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents are relevant to the query of their topic; spam to none."""
    ids = F.create_map(*(x for i, t in enumerate(TOPICS) for x in (F.lit(t), F.lit(i).cast("long"))))
    return corpus.select(ids[F.col("topic")].alias("query_id"), "doc_id").where(F.col("query_id").isNotNull())
