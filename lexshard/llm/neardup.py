"""Problem 3: pages that are the same but for small edits, found exactly by BK-trees over Hamming distances.

Two pages are near-duplicates if the distinct words both have make up at least 7/10 of those either has. For word
sets A and B that is |A xor B| <= 3/17 (|A| + |B|), and |A xor B| is the Hamming distance of the sets' bit vectors.
Each set is folded into a parity sketch: every word flips one of W bits. Common words cancel, so the Hamming distance
of two sketches never exceeds |A xor B|: a search within the radius on sketches loses no pair. The sketches of a shard
form a BK-tree (children keyed by their integer distance to the parent); a search follows only edges within the radius.

One tree over all pages would neither fit a task nor, with pages far apart from each other, prune much. So the pages
are first put into shards that no similar pair can escape: order all words from rare to common; two similar sets share
a word among the first n - ceil(0.7 n) + 1 of each (prefix filtering). The order needs no exact counts, only one and
the same for all: counts in a table of bounded size serve, and they are what is broadcast - trees are not, as they grow
with the data; each tree is built in the task that searches it. Shards of too many pages are split into blocks, and
each pair of blocks is searched as a task of its own. All trees of a batch are built level by level and searched in step,
on arrays.

Pages with equal word sets are one class, so copies cost nothing; classes are searched, and pairs of pages follow from
class pairs and membership. What is kept between the steps are the texts of the classes, which take less room than
their hashed words and are split again where words are needed; sketches are of hashed words, pairs are compared by the
words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.functions.words import bytes_of, distinct, hashes, mixed, pieces, split_words
from lexshard.operators.components import components
from lexshard.plans.sql import words_sql
from lexshard.session import settled, single, spread, table

#: Word counts are kept in a table of so many buckets, at 4 bytes 1 to 16 MiB; the more, the better the order of the words.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 18, 1 << 22
#: Pages of a shard that are searched against each other in one task.
BLOCK = 2000
#: So many deliveries that stand for no class are broadcast, to be left out.
FEW = 1_000_000
#: Bits that tell which texts are to be compared: 8 KiB to 32 MiB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Nodes that the searches which run in step may visit at most, together.
VISITS = 1 << 21
#: A row's block, then side (its lowest bit), whether the block is searched within itself, left and n (31 bits each).
_SHARDS = "block long, packed long, id long, sketch binary"
#: Sizes of word sets in steps of 10/7: a similar smaller set is of the same step or one of the two before.
STEPS = [1]
while STEPS[-1] < 1 << 40:
    STEPS.append(-(-STEPS[-1] * 10 // 7))
_STEPS = np.array(STEPS)


def deliveries(wiki: DataFrame) -> DataFrame:
    """(id, seen, title, text): every delivery of a page with a text; ids that aren't numbers are dropped."""
    rows = wiki.select(F.expr("try_cast(id AS bigint)").alias("id"), F.col("fetched_at").cast("timestamp").alias("seen"), F.coalesce("title", F.lit("")).alias("title"), "text")
    return spread(rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()))


class Sets:
    """The distinct words of each row's title and text, hashed: row i has words[ends[i]:ends[i + 1]], in order."""

    def __init__(self, title: pa.Array, text: pa.Array) -> None:
        split = [split_words(text), split_words(title)]
        lengths = [np.diff(w.offsets.to_numpy().astype(np.int64)) for w in split]
        self.has_text = lengths[0] > 0
        self.rows = len(text)
        coded = pa.concat_arrays([w.values for w in split]).dictionary_encode()
        of = np.concatenate([np.repeat(np.arange(self.rows), n) for n in lengths])
        hashed = hashes(coded.dictionary)
        order = np.argsort(hashed, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        size = max(len(order), 1)
        keys = distinct(of * size + rank[coded.indices.to_numpy()])
        self.of = keys // size
        self.code, self.hashed = keys - self.of * size, hashed[order]
        self.words = self.hashed[self.code]
        self.ends = np.searchsorted(self.of, np.arange(self.rows + 1))
        self.n = np.diff(self.ends)


def _buckets(pages: DataFrame) -> int:
    """A power of two that grows with the texts, well above the number of words that are often enough to matter."""
    (chars,) = single(pages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))))
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << int(chars // 64).bit_length()))


def classes(wiki: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(members (id, class), texts (class, title, text), counts): pages with equal word sets; class is their smallest id.

    Only pages with a word in their text. A page delivered several times counts as it came last. counts tells for each
    bucket of words how many deliveries hold them. The deliveries are written to the shared folder, numbered; texts are
    those that stand for a class. Where only few don't, these are left out as the deliveries are read; else the texts are
    picked by a join and written again.
    """
    import xxhash
    from pyspark import TaskContext

    pages = deliveries(wiki)
    buckets = _buckets(pages)
    names = ["row", "id", "seen", "key", "title", "text", "bucket", "n"]

    def keyed(batches):
        """Each delivery with a word in its text, with a number and the 128-bit hash of its word set; in the end the counts."""
        total, done = np.zeros(buckets, np.int64), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = Sets(part.column("title"), part.column("text"))
                total += np.bincount(_slot(sets.words, buckets), minlength=buckets)
                at = np.flatnonzero(sets.has_text)
                keys = [xxhash.xxh3_128_digest(sets.words[sets.ends[i] : sets.ends[i + 1]].tobytes()) for i in at.tolist()]
                ident, seen, title, text = part.select(["id", "seen", "title", "text"]).take(pa.array(at)).columns
                yield pa.RecordBatch.from_arrays([pa.array(done + np.arange(len(at))), ident, seen, pa.array(keys, pa.binary()), title, text, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], names)
                done += len(at)
        at = np.flatnonzero(total)
        none = [pa.nulls(len(at), k) for k in (pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(total[at])], names)

    rows = settled(pages.mapInArrow(keyed, "row long, id long, seen timestamp, key binary, title string, text string, bucket int, n long"))
    counts, rows = _summed(rows.where(F.col("bucket").isNotNull()).select("bucket", "n"), buckets), rows.where(F.col("bucket").isNull())
    last = settled(rows.groupBy("id").agg(F.max(F.struct("seen", "key", "row")).alias("x")).select("id", "x.key", "x.row"))
    reps = last.groupBy("key").agg(F.min(F.struct("id", "row")).alias("x")).select("key", F.col("x.id").alias("class"), "x.row")
    members = settled(last.select("id", "key").join(reps.select("key", "class"), "key").select("id", "class"))
    spare = settled(rows.select("row").join(reps.select("row"), "row", "left_anti"))
    if spare.count() <= FEW:
        texts = rows.join(F.broadcast(spare), "row", "left_anti")
        return members, texts.select(F.col("id").alias("class"), "title", "text"), counts
    texts = rows.select("row", F.col("id").alias("class"), "title", "text").join(reps.select("row"), "row", "left_semi")
    return members, settled(texts.drop("row")), counts


def _summed(counts: DataFrame, buckets: int) -> np.ndarray:
    """The sums per bucket of (bucket, n): one table of so many buckets comes to the driver."""
    summed = counts.groupBy("bucket").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(buckets, np.int32)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def _slot(words: np.ndarray, buckets: int) -> np.ndarray:
    return words & (buckets - 1)


def prefixes(sets: Sets, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, how many words from it on) of the rarest words of each set, as many as any similar set must share one of."""
    take = sets.n - (7 * sets.n + 9) // 10 + 1
    order = np.lexsort((sets.hashed, counts[_slot(sets.hashed, len(counts))]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = max(len(order), 1)
    sorted_ = np.sort(sets.of * size + rank[sets.code])
    place = np.arange(len(sorted_)) - np.repeat(sets.ends[:-1], sets.n)
    kept = place < np.repeat(take, sets.n)
    row = sets.of[kept]
    return row, sets.hashed[order[sorted_[kept] - row * size]], sets.n[row] - place[kept]


def sketches(sets: Sets) -> pa.BinaryArray:
    """Parity of each set's words over W bits, W the power of two from 2n up, at least 256."""
    width = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(2 * sets.n, 1))).astype(np.int64))
    starts = np.append(0, np.cumsum(width))
    flips = np.bincount(starts[:-1][sets.of] + ((sets.words >> 20) & (width[sets.of] - 1)), minlength=starts[-1]) & 1
    return pa.Array.from_buffers(pa.binary(), sets.rows, [None, pa.py_buffer((starts // 8).astype(np.int32)), pa.py_buffer(np.packbits(flips.astype(np.uint8), bitorder="little"))])


def _slices(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... many[0] of them, then those of starts[1], and so on."""
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())


class Trees:
    """BK-trees over sketches of one width. Row i lies in the tree named of[i], rows of a tree follow each other.

    A node is a row; the first of a tree is its root. Rows look for their place together: each is at a node, and steps
    down the edge of its distance, or becomes the child there if there is none.
    """

    def __init__(self, lanes: list[np.ndarray], of: np.ndarray) -> None:
        self.lanes = lanes
        self.names, self.roots = np.unique(of, return_index=True)
        self.sizes = np.diff(np.append(self.roots, len(of)))
        at = np.repeat(self.roots, self.sizes)
        parent, edge = np.full(len(of), -1), np.full(len(of), -1)
        left = np.flatnonzero(at != np.arange(len(of)))
        wide = 64 * len(lanes) + 1
        while len(left):
            d = self.distance(left, at[left])
            _, first, where = np.unique(at[left] * wide + d, return_index=True, return_inverse=True)
            child = left[first][where.reshape(-1)]
            new = child == left
            parent[left[new]], edge[left[new]] = at[left[new]], d[new]
            at[left] = child
            left = left[~new]
        order = np.argsort(parent, kind="stable")
        self.child, self.edge = order, edge[order]
        self.first = np.searchsorted(parent[order], np.arange(len(of) + 1))

    def distance(self, a: np.ndarray, b: np.ndarray, lanes: list[np.ndarray] | None = None) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for x, y in zip(lanes or self.lanes, self.lanes):
            out += np.bitwise_count(x[a] ^ y[b])
        return out

    def near(self, lanes: list[np.ndarray], query: np.ndarray, name: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, distance) of the rows within a query's radius in the tree it names, if there is one; all searches in step."""
        tree = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        there = self.names[tree] == name
        query, tree, radius = query[there], tree[there], radius[there]
        part = np.cumsum(self.sizes[tree]) // VISITS
        for k in np.unique(part):
            now = part == k
            q, node, r = query[now], self.roots[tree[now]], radius[now]
            while len(q):
                d = self.distance(q, node, lanes)
                hit = d <= r
                yield q[hit], node[hit], d[hit]
                start, many = self.first[node], self.first[node + 1] - self.first[node]
                edge = _slices(start, many)
                q, r, d, node = np.repeat(q, many), np.repeat(r, many), np.repeat(d, many), self.child[edge]
                follow = np.abs(self.edge[edge] - d) <= r
                q, r, node = q[follow], r[follow], node[follow]


def _lanes(packed: pa.Array, rows: np.ndarray, width: int) -> list[np.ndarray]:
    """The sketches of some rows, all of so many bits, as columns of 64 bits."""
    raw, _ = bytes_of(packed.take(pa.array(rows)))
    flat = np.frombuffer(raw.tobytes(), "<u8").reshape(len(rows), width // 64)
    return [np.ascontiguousarray(flat[:, k]) for k in range(width // 64)]


def block_pairs(block: np.ndarray, within: np.ndarray, side: np.ndarray, n: np.ndarray, left: np.ndarray, ident: np.ndarray, packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller id, larger id) of the rows of a block (within) or between a block's two sides.

    left counts the words of a page from the shard's word on, in the order of rarity. If the shard's word is the first
    that two pages share, they share at most left of either; they must share 7/17 of their sizes together. So a page
    needs to be in a tree only if left is 14/17 of its size: the page that searches is no smaller. There is a tree for
    each width and step of size; a similar smaller page has the same width or half of it, and a sketch folds to half its
    width.
    """
    raw_ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    width = 8 * np.diff(raw_ends).astype(np.int64)
    step = np.searchsorted(_STEPS, n, "right")
    low = np.searchsorted(_STEPS, -(-7 * n // 10), "right")
    name = lambda rows, sides, steps: (block[rows] * 2 + sides) * 64 + steps
    found = []
    for w in np.unique(width):
        inside = np.flatnonzero((width == w) & (17 * left >= 14 * n))
        if not len(inside):
            continue
        inside = inside[np.argsort(name(inside, side[inside], step[inside]), kind="stable")]
        trees = Trees(_lanes(packed, inside, w), name(inside, side[inside], step[inside]))
        for v in (w, 2 * w):
            rows = np.flatnonzero(width == v)
            if not len(rows):
                continue
            lanes = _lanes(packed, rows, v)
            if v > w:
                lanes = [a ^ b for a, b in zip(lanes[: len(lanes) // 2], lanes[len(lanes) // 2 :])]
            searched = np.where(within[rows], side[rows], 1 - side[rows])
            for back in range(3):
                at = np.flatnonzero(step[rows] - back >= low[rows])
                q = rows[at]
                radius = 3 * (n[q] + np.minimum(n[q], _STEPS[step[q] - back] - 1)) // 17
                for i, node, d in trees.near(lanes, at, name(q, searched[at], step[q] - back), radius):
                    x, y = rows[i], inside[node]
                    both = n[x] + n[y]
                    ok = (17 * d <= 3 * both) & (17 * np.minimum(left[x], left[y]) >= 7 * both) & ((n[y] < n[x]) | (n[y] == n[x]) & (ident[y] < ident[x]))
                    found.append(np.stack([np.minimum(ident[x[ok]], ident[y[ok]]), np.maximum(ident[x[ok]], ident[y[ok]])], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, each block wholly in one partition; blocks may span batches."""
    rest: pa.Table | None = None

    def pairs(t: pa.Table, last: bool):
        block, packed = t.column("block").to_numpy(), t.column("packed").to_numpy()
        new = np.append(True, block[1:] != block[:-1])
        done = len(block) if last else int(np.flatnonzero(new)[-1])
        packed = packed[:done]
        columns = ((packed >> 1 & 1).astype(bool), packed & 1, packed >> 2 & 0x7FFFFFFF, packed >> 33, t.column("id").to_numpy()[:done])
        a, b = block_pairs(np.cumsum(new)[:done], *columns, t.column("sketch").slice(0, done).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), t.slice(done)

    for batch in batches:
        if batch.num_rows:
            now = pa.Table.from_batches([batch])
            found, rest = pairs(pa.concat_tables([rest, now]).combine_chunks() if rest is not None and rest.num_rows else now, False)
            yield found
    if rest is not None and rest.num_rows:
        yield pairs(rest.combine_chunks(), True)[0]


def alike(title_a: pa.Array, text_a: pa.Array, title_b: pa.Array, text_b: pa.Array) -> np.ndarray:
    """Whether the distinct words both have are at least 7/10 of those either has, by the words themselves."""
    rows = len(text_a)
    split = [split_words(x) for x in (title_a, text_a, title_b, text_b)]
    coded = pa.concat_arrays([w.values for w in split]).dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    of = [np.repeat(np.arange(rows), np.diff(w.offsets.to_numpy().astype(np.int64))) for w in split]
    cut = len(of[0]) + len(of[1])
    a, b = (distinct(np.concatenate(o) * size + c) for o, c in ((of[:2], code[:cut]), (of[2:], code[cut:])))
    many = lambda keys: np.bincount(keys // size, minlength=rows)
    common = many(np.intersect1d(a, b, assume_unique=True))
    return (common > 0) & (10 * common >= 7 * (many(a) + many(b) - common))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text_a"):
            ok = alike(*(part.column(c) for c in ("title_a", "text_a", "title_b", "text_b")))
            yield part.select(["a", "b"]).take(pa.array(np.flatnonzero(ok)))


def _spots(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    spots = np.concatenate([mixed(ids.view(np.uint64) + np.uint64(k)) & np.uint64(bits - 1) for k in (1, 2)])
    return (spots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spots & np.uint64(63))


def _that_occur(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts without most of those that no pair names, so that they aren't shuffled to be compared.

    A table of bits, of bounded size, is broadcast; the joins that follow are exact.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * pairs.count()).bit_length()))

    def named(batches):
        for batch in batches:
            entry, bit = _spots(np.concatenate([batch.column(c).to_numpy() for c in "ab"]), bits)
            order = np.argsort(entry, kind="stable")
            different, starts = np.unique(entry[order], return_index=True)
            held = np.bitwise_or.reduceat(bit[order], starts) if len(starts) else bit
            yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(held.view(np.int64))], ["entry", "bits"])

    rows = pairs.mapInArrow(named, "entry long, bits long").groupBy("entry").agg(F.bit_or("bits").alias("bits")).toArrow()
    table_ = np.zeros(bits // 64, np.uint64)
    table_[rows.column("entry").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table_)

    def kept(batches):
        for batch in batches:
            ids = batch.column("class").to_numpy()
            entry, bit = _spots(ids, bits)
            yield batch.filter(pa.array(((shared.value[entry] & bit) != 0).reshape(2, len(ids)).all(0)))

    return texts.mapInArrow(kept, texts.schema)


def class_pairs(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(a, b), a < b: all pairs of classes at least 7/10 alike; texts is (class, title, text), settled."""
    spark, buckets = texts.sparkSession, len(counts)
    texts = spread(texts)
    order = spark.sparkContext.broadcast(counts)

    def sizes_of(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                total += np.bincount(_slot(prefixes(Sets(part.column("title"), part.column("text")), order.value)[1], buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sizes = spark.sparkContext.broadcast(_summed(texts.mapInArrow(sizes_of, "bucket int, n long"), buckets))

    def shards(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = Sets(part.column("title"), part.column("text"))
                row, word, left = prefixes(sets, order.value)
                size = sizes.value[_slot(word, buckets)]
                row, word, left, size = (x[size > 1] for x in (row, word, left, size))
                ident = part.column("class").to_numpy()[row]
                blocks = -(-size.astype(np.int64) // BLOCK)
                own = (ident * np.int64(0x1E3779B97F4A7C15) & np.int64(2**62 - 1)) % blocks
                at = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine = own[at]
                low, high = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
                block = np.where(blocks[at] > 1, mixed(mixed(word[at].view(np.uint64) + low) + high).view(np.int64), word[at])
                packed = (mine > other) | (mine == other) << 1 | sets.n[row[at]] << 2 | left[at] << 33
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(packed), pa.array(ident[at]), sketches(sets).take(pa.array(row[at]))], ["block", "packed", "id", "sketch"])

    blocks = texts.mapInArrow(shards, _SHARDS).repartition("block").sortWithinPartitions("block")
    candidates = blocks.mapInArrow(_search, "a long, b long").distinct()
    candidates = settled(candidates)
    texts = _that_occur(texts, candidates)
    left, right = (texts.select(F.col("class").alias(x), F.col("title").alias(f"title_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return candidates.join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long")


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(id_a, id_b): all pairs of different pages whose words are at least 7/10 the same.

    The pairs of k copies are k (k - 1) / 2 rows, as asked for; p3_groups says the same with one row per page.
    """
    members, texts, counts = classes(table(spark, data_dir, "wiki"))
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("class").alias(x)) for x in "ab")
    different = class_pairs(texts, counts).join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    same = a.join(b, F.col("a") == F.col("b")).where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
    return different.unionAll(same)


def p3_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """(id, class_id, group_id, links): one row per page; links counts the other classes its class is similar to.

    A group is a connected component of similar pages; class and group are named by their smallest id.
    """
    members, texts, counts = classes(table(spark, data_dir, "wiki"))
    pairs = settled(class_pairs(texts, counts))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    groups = components(pairs).select(F.col("node").alias("class"), "component")
    rows = members.join(groups, "class", "left").join(links, "class", "left")
    return rows.select("id", F.col("class").alias("class_id"), F.coalesce("component", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

_PAIRS = f"""d AS (SELECT try_cast(id AS BIGINT) AS id, {words_sql('text')} AS w, {words_sql('title')} AS t, fetched_at FROM wiki),
    p AS (SELECT id, arg_max(list_sort(list_distinct(list_concat(w, t))), fetched_at) AS s FROM d WHERE id IS NOT NULL AND len(w) > 0 GROUP BY id),
    e AS (SELECT id, len(s) AS n, unnest(s) AS w FROM p),
    c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.w = b.w AND a.id < b.id
        AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n GROUP BY ALL),
    pairs AS (SELECT id_a, id_b FROM c WHERE 10 * k >= 7 * (na + nb - k))"""
SQL = {
    "p3_found": f"WITH {_PAIRS} SELECT id_a, id_b FROM pairs",
    "p3_groups": f"""WITH RECURSIVE {_PAIRS}, k AS (SELECT id, min(id) OVER (PARTITION BY s) AS class FROM p),
        l AS (SELECT DISTINCT a.class AS a, b.class AS b FROM pairs JOIN k a ON a.id = id_a JOIN k b ON b.id = id_b WHERE a.class <> b.class),
        ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT DISTINCT class AS node, class AS root FROM k UNION SELECT ways.b, root FROM reach JOIN ways ON ways.a = node)
        SELECT id, class AS class_id, (SELECT min(root) FROM reach WHERE node = class) AS group_id, (SELECT count(*) FROM ways WHERE a = class) AS links FROM k""",
}
