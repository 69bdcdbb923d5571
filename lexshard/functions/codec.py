"""Gaps and variable-byte codes: seven bits a byte, highest first, the last byte of a number marked by its top bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIMITS = [1 << (7 * i) for i in range(1, 9)]


def vbyte_length(n: Column) -> Column:
    """Bytes of the code of a number, without making it."""
    out = F.lit(9)
    for i, limit in reversed(list(enumerate(_LIMITS, 1))):
        out = F.when(n < limit, i).otherwise(out)
    return out


def _groups(n: Column, length: int) -> Column:
    parts = [F.lpad(F.hex(F.shiftright(n, 7 * (length - 1 - i)).bitwiseAND(127) + (128 if i == length - 1 else 0)), 2, "0") for i in range(length)]
    return F.concat(*parts)


def vbyte_hex(n: Column) -> Column:
    """The code of one number in hexadecimal digits; an error for a negative one."""
    out = _groups(n, 9)
    for i, limit in reversed(list(enumerate(_LIMITS, 1))):
        out = F.when(n < limit, _groups(n, i)).otherwise(out)
    return F.when(n < 0, F.raise_error(F.lit("only numbers from 0 up have a code")).cast("string")).otherwise(F.lower(out))


def vbyte_digits(numbers: Column) -> Column:
    """The codes of an array of numbers, one after the other, in hexadecimal digits."""
    return F.array_join(F.transform(numbers.cast("array<bigint>"), vbyte_hex), "")


def vbyte_encode(numbers: Column) -> Column:
    """The codes of an array of numbers, one after the other; empty for an empty array."""
    return F.unhex(vbyte_digits(numbers))


def decoded(data: np.ndarray) -> np.ndarray:
    """All numbers in a run of bytes; a number without a last byte at the end is dropped."""
    ends = np.flatnonzero(data & 0x80)
    if not len(ends):
        return np.empty(0, np.int64)
    data = data[: ends[-1] + 1].astype(np.int64) & 0x7F
    starts = np.append(0, ends[:-1] + 1)
    lengths = ends - starts + 1
    power = np.repeat(ends, lengths) - np.arange(len(data))
    return np.add.reduceat(data << (7 * power), starts)


@F.arrow_udf(T.ArrayType(T.LongType()))
def vbyte_decode(data: pa.Array) -> pa.Array:
    return pa.array([None if b is None else decoded(np.frombuffer(b, np.uint8)).tolist() for b in data.to_pylist()], pa.list_(pa.int64()))


def decode_stream(data: bytes, pos: int, count: int) -> tuple[list[int], int]:
    """Exactly count numbers from byte pos on, and where the next begins; IndexError if the bytes end before."""
    if count <= 0:
        return [], pos
    view = np.frombuffer(data, np.uint8)[pos:]
    ends = np.flatnonzero(view & 0x80)
    if len(ends) < count:
        raise IndexError("the bytes end before the last number")
    stop = int(ends[count - 1]) + 1
    return decoded(view[:stop]).tolist(), pos + stop


_STREAM = T.StructType([T.StructField("numbers", T.ArrayType(T.LongType())), T.StructField("next", T.IntegerType())])


@F.arrow_udf(_STREAM)
def vbyte_decode_stream(data: pa.Array, pos: pa.Array, count: pa.Array) -> pa.Array:
    """decode_stream for columns: (numbers, where the next begins); null where an argument is; an error if bytes are missing."""
    rows = [None if None in r else dict(zip(("numbers", "next"), decode_stream(*r))) for r in zip(data.to_pylist(), pos.to_pylist(), count.to_pylist())]
    return pa.array(rows, pa.struct([("numbers", pa.list_(pa.int64())), ("next", pa.int32())]))


def gap_encode(numbers: Column) -> Column:
    """The first number, then the distances."""
    return F.transform(numbers, lambda x, i: x - F.when(i > 0, F.get(numbers, i - 1)).otherwise(0))


@F.arrow_udf(T.ArrayType(T.LongType()))
def gap_decode(gaps: pa.Array) -> pa.Array:
    offsets = gaps.offsets.to_numpy().astype(np.int64)
    flat = np.append(0, np.cumsum(gaps.values.to_numpy().astype(np.int64)))
    base = np.repeat(flat[offsets[:-1]], np.diff(offsets))
    values = flat[1:][offsets[0] : offsets[-1]] - base
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(values))


#: Documents of a term are put in order within ranges of so many ids, so a term that all documents hold fills no task.
RANGE = 1 << 16


def _carried(rows: DataFrame, value: Column, how) -> tuple[DataFrame, Column]:
    """rows with before, what the earlier ranges of the same term leave; and the column for order within a range."""
    ranged = rows.withColumn("range", F.floor(F.col("doc_id") / RANGE))
    kept = ranged.groupBy("term", "range").agg(how(value).alias("left"))
    w = Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.select("term", "range", F.coalesce(how("left").over(w), F.lit(0)).alias("before"))
    return ranged.join(before, ["term", "range"]), Window.partitionBy("term", "range").orderBy("doc_id")


def doc_gaps(postings: DataFrame) -> DataFrame:
    """postings with gap: the distance of doc_id from the term's previous one, the first counting from 0."""
    rows, w = _carried(postings, F.col("doc_id"), F.max)
    return rows.withColumn("gap", F.col("doc_id") - F.coalesce(F.lag("doc_id").over(w), F.col("before"))).drop("range", "before")


def docs_from_gaps(gaps: DataFrame) -> DataFrame:
    """gaps with decoded: the sum of the term's gaps up to each row."""
    rows, w = _carried(gaps, F.col("gap"), F.sum)
    return rows.withColumn("decoded", F.col("before") + F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("range", "before")


def encoded_postings(postings: DataFrame) -> DataFrame:
    """(term, range, base, n, code): the posting lists in bytes, cut where RANGE ids are full, so that no list fills a task.

    Per posting the gap of doc_id, tf, the number of positions and their gaps. base is the id before the range (0 at the
    start), where reading may begin; the codes of a term's ranges after each other are its whole list.
    """
    rows, w = _carried(postings, F.col("doc_id"), F.max)
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(w), F.col("before"))
    numbers = F.concat(F.array(gap, F.col("tf").cast("long"), F.size("positions").cast("long")), gap_encode(F.col("positions")).cast("array<bigint>"))
    coded = rows.select("term", "range", "before", "doc_id", vbyte_digits(numbers).alias("digits"))
    lists = coded.groupBy("term", "range").agg(F.first("before").alias("base"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", "digits"))).alias("l"))
    return lists.select("term", "range", "base", "n", F.unhex(F.array_join("l.digits", "")).alias("code"))


def _postings_in(code: bytes, base: int) -> tuple[list[int], list[int], list[np.ndarray]]:
    numbers = decoded(np.frombuffer(code, np.uint8))
    ids, tfs, positions, i, doc = [], [], [], 0, base
    while i < len(numbers):
        gap, tf, many = numbers[i : i + 3].tolist()
        doc += gap
        ids.append(doc)
        tfs.append(tf)
        positions.append(np.cumsum(numbers[i + 3 : i + 3 + many]))
        i += 3 + many
    return ids, tfs, positions


def decoded_postings(lists: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) from encoded lists; each range is read alone."""

    def run(batches):
        for batch in batches:
            for term, base, code in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, tfs, positions = _postings_in(code, base)
                ends = np.cumsum([0, *map(len, positions)]).astype(np.int32)
                flat = pa.array(np.concatenate([np.empty(0, np.int64), *positions]).astype(np.int32))
                cols = [pa.array([term.as_py()] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(tfs, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)]
                yield pa.RecordBatch.from_arrays(cols, ["term", "doc_id", "tf", "positions"])

    return lists.select("term", F.col("base").cast("long"), "code").mapInArrow(run, "term string, doc_id long, tf int, positions array<int>")


def position_bytes(positions: Column) -> Column:
    return F.aggregate(gap_encode(positions), F.lit(0), lambda acc, g: acc + vbyte_length(g))


def encoded_postings_bytes(postings: DataFrame) -> DataFrame:
    """One number: bytes of all terms' lists, each coded as df, then (doc gap, tf, number of positions, position gaps) per posting.

    Positions are measured before the shuffle. Gaps are taken within ranges of ids; one row per range then tells the
    gap between ranges.
    """
    size = F.size("positions")
    rest = vbyte_length(F.col("tf")) + vbyte_length(size) + position_bytes(F.col("positions"))
    rows = postings.select("term", F.floor(F.col("doc_id") / RANGE).alias("range"), "doc_id", rest.alias("rest"))
    gap = F.col("doc_id") - F.lag("doc_id").over(Window.partitionBy("term", "range").orderBy("doc_id"))
    ranges = rows.withColumn("gap", gap).groupBy("term", "range").agg(
        F.sum(F.col("rest") + F.when(F.col("gap").isNotNull(), vbyte_length(F.col("gap"))).otherwise(0)).alias("body"),
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
    )
    between = F.col("first") - F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("range"))
    terms = ranges.withColumn("between", between).groupBy("term").agg(F.sum(F.col("body") + vbyte_length(F.col("between"))).alias("body"), F.sum("n").alias("df"))
    return terms.agg(F.coalesce(F.sum(F.col("body") + vbyte_length(F.col("df"))), F.lit(0)).cast("long").alias("postings_bytes"))


def uncompressed_bytes(postings: DataFrame) -> DataFrame:
    """One number: four bytes each for doc_id, tf and number of positions, and for every position."""
    return postings.agg(F.coalesce(F.sum(12 + 4 * F.size("positions")), F.lit(0)).cast("long").alias("uncompressed_bytes"))
