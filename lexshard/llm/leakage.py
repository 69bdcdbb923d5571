"""Problem 7: evaluation passages inside documents, by Wu-Manber multi-pattern search over words.

The patterns are all runs of RUN successive words of the held-out items. A shift table tells for each block of two words
how far the search may jump ahead: the least distance from that block to the end of any pattern that holds it, and
RUN - 1 where no pattern does. Where the jump is 0 the block ends some pattern: the bucket that the hash of the whole
run falls into tells whether any pattern may end here. The runs that are left are compared, word by word, with the
patterns. The documents of a batch are cut into overlapping segments and all segments jump in step, on arrays; outside
of leaked passages a text of n words takes about n / 9 looks.

The corpus is read once, however many items there are: shift table and buckets are tables of bounded size, indexed by
hashes, and they are all that is broadcast. Items beyond what the tables are made for only make them less selective. The
patterns themselves stay a table; what the search lets through is joined with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.functions.words import coded, distinct, hashes, mixed, pieces, split_words
from lexshard.plans.sql import words_sql
from lexshard.session import single, spread, table

#: So many successive words in common are a leak.
RUN = 10
#: Shift table: slots for each word of the items, and their least and greatest number (64 KiB to 4 MiB).
SLOTS_A_WORD, LEAST_SLOTS, MOST_SLOTS = 8, 1 << 16, 1 << 22
#: Buckets: bits for each word of the items, how many of them a pattern sets, and their least and greatest number (8 KiB to 32 MiB).
BITS_A_WORD, PROBES, LEAST_BITS, MOST_BITS = 32, 3, 1 << 16, 1 << 28
#: Words of a segment, besides the RUN - 1 it shares with the next.
SEGMENT = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PROBES = [np.uint64(k * int(_MIX) % (1 << 64)) for k in range(PROBES)]


def _blocks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _MIX + second)


def _runs(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN words that end at the given places."""
    out = np.zeros(len(last), np.uint64)
    for k in range(RUN - 1, -1, -1):
        out = out * _MIX + words[last - k]
    return mixed(out)


def _places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place of the last word) of every run."""
    many = np.maximum(np.diff(ends) - RUN + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    return text, np.repeat(ends[:-1], many) + RUN - 1 + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)


@dataclass
class Patterns:
    """Shift table and buckets of all patterns, by hash."""

    shifts: np.ndarray
    bits: np.ndarray  # 64 to an entry

    @staticmethod
    def sizes(words: int) -> tuple[int, int]:
        power = lambda n, low, high: min(max(low, 1 << max(int(n) - 1, 0).bit_length()), high)
        return power(words * SLOTS_A_WORD, LEAST_SLOTS, MOST_SLOTS), power(words * BITS_A_WORD, LEAST_BITS, MOST_BITS)

    @staticmethod
    def entries(words: np.ndarray, ends: np.ndarray, slots: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slot, shift) with the least shift of each, and (entry, its bits), of the patterns of some items."""
        _, last = _places(ends)
        least = np.full(slots, RUN - 1, np.int64)
        for shift in range(RUN - 2, -1, -1):  # the nearest block is set last
            at = last - shift
            least[(_blocks(words[at - 1], words[at]) & np.uint64(slots - 1)).astype(np.int64)] = shift
        slot = np.flatnonzero(least < RUN - 1)
        spots = distinct(np.concatenate([Patterns._spot(_runs(words, last), k, bits) for k in range(PROBES)]))
        entry, starts = np.unique(spots >> np.uint64(6), return_index=True)
        held = np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), starts) if len(spots) else np.empty(0, np.uint64)
        return slot, least[slot], entry.astype(np.int64), held

    @staticmethod
    def _spot(run: np.ndarray, k: int, bits: int) -> np.ndarray:
        return mixed(run + _PROBES[k]) & np.uint64(bits - 1)

    def search(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the last word, hash) of every run that may be a pattern; text t is words[ends[t]:ends[t + 1]]."""
        lengths = np.diff(ends)
        cuts = np.maximum(-(-(lengths - RUN + 1) // SEGMENT), 0)
        text = np.repeat(np.arange(len(lengths)), cuts)
        first = ends[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        at, stop = first + RUN - 1, np.minimum(first + SEGMENT + RUN - 1, ends[text + 1])
        texts, places, mask = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.uint64(len(self.shifts) - 1)
        while len(at):
            shift = self.shifts[(_blocks(words[at - 1], words[at]) & mask).astype(np.int64)]
            hit = shift == 0
            if hit.any():
                texts.append(text[hit])
                places.append(at[hit])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop, text = at[live], stop[live], text[live]
        text, place = np.concatenate(texts), np.concatenate(places)
        run = _runs(words, place)
        for k in range(PROBES):
            spot = self._spot(run, k, 64 * len(self.bits))
            held = (self.bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
            text, place, run = text[held], place[held], run[held]
        return text, place, run


def _numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(hash of every word, where each text ends, the words)."""
    words = split_words(texts)
    ends, code, names = coded(words)
    return hashes(names).view(np.uint64)[code], ends, words


def _said(words: pa.ListArray, places: np.ndarray) -> list[str]:
    """The runs that end at the given places, as text."""
    flat = words.values.slice(words.offsets[0].as_py())
    span = flat.take(pa.array((places[:, None] + np.arange(1 - RUN, 1)).reshape(-1))).to_pylist()
    return [" ".join(span[i : i + RUN]) for i in range(0, len(span), RUN)]


def built(items: DataFrame, slots: int, bits: int) -> Patterns:
    """The tables of the items (a column text). What comes to the driver is bounded by their sizes."""

    def entries(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words, ends, _ = _numbers(part.column("text"))
                slot, shift, entry, held = Patterns.entries(words, ends, slots, bits)
                cols = [np.append(np.zeros(len(slot), np.int32), np.ones(len(entry), np.int32)), np.append(slot, entry), np.append(RUN - shift, held.view(np.int64))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["kind", "place", "value"])

    found = items.select("text").mapInArrow(entries, "kind int, place long, value long")
    merged = found.groupBy("kind", "place").agg(F.when(F.col("kind") == 0, F.max("value")).otherwise(F.bit_or("value")).alias("value")).toArrow()
    kind, place, value = (merged.column(c).to_numpy() for c in ("kind", "place", "value"))
    out = Patterns(np.full(slots, RUN - 1, np.uint8), np.zeros(bits // 64, np.uint64))
    out.shifts[place[kind == 0]] = RUN - value[kind == 0]
    out.bits[place[kind == 1]] = value[kind == 1].view(np.uint64)
    return out


def pattern_runs(items: DataFrame) -> DataFrame:
    """(run, item_id): every run of RUN words of every item, once each."""

    def said(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = split_words(part.column("text"))
                text, places = _places(words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(_said(words, places), pa.string()), part.column("item_id").take(pa.array(text))], ["run", "item_id"])

    return items.mapInArrow(said, "run string, item_id long").distinct()


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): every document and item with at least RUN successive words in common, once each.

    Every item that has the words counts: copies, and items within others. Null texts have no words, null keys are
    dropped; repeated rows of a key are taken together. Texts or items shorter than RUN words match nothing. Other
    columns, also of equal names on both sides, don't matter.
    """
    spark = documents.sparkSession
    held = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    (length,) = single(held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))))
    shared = spark.sparkContext.broadcast(built(held, *Patterns.sizes(length // 4)))
    texts = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def search(batches):
        patterns = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                numbers, ends, words = _numbers(part.column("text"))
                text, place, run = patterns.search(numbers, ends)
                keys = part.column("doc_id").to_numpy()[text]
                order = np.lexsort((run, keys))  # a run that a document repeats is sent once
                keys, place, run = keys[order], place[order], run[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (run[1:] != run[:-1]))[: len(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(_said(words, place[new]), pa.string()), pa.array(keys[new])], ["run", "doc_id"])

    return spread(texts).mapInArrow(search, "run string, doc_id long").join(pattern_runs(held), "run").select("doc_id", "item_id").distinct()


def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return leaks(table(spark, data_dir, "documents"), table(spark, data_dir, "eval_items"))


def p7_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """(item_id, documents): the items that leaked, and into how many documents."""
    return p7_found(spark, data_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}

_RUNS = """WITH d AS (SELECT doc_id, {text} AS w FROM documents), e AS (SELECT item_id, {text} AS w FROM eval_items),
    dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {last}), lambda i: array_to_string(w[i:i + {last}], ' '))) AS r FROM d WHERE len(w) > {last}),
    er AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {last}), lambda i: array_to_string(w[i:i + {last}], ' '))) AS r FROM e WHERE len(w) > {last}),
    found AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r) WHERE doc_id IS NOT NULL AND item_id IS NOT NULL)""".format(text=words_sql("text"), last=RUN - 1)
SQL = {
    "p7_found": f"{_RUNS} SELECT doc_id, item_id FROM found",
    "p7_items": f"{_RUNS} SELECT item_id, count(*) AS documents FROM found GROUP BY item_id",
}
