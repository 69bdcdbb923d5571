import datetime
import random

import numpy as np
import pyarrow as pa
import pytest

from lexshard.llm import neardup
from tests.llm.conftest import NOW


def alike(a, b):
    return a and b and 10 * len(a & b) >= 7 * len(a | b)


def pages(seed=1):
    """Copies, edited copies at all distances around the limit, reordered ones, tiny pages and a few long ones."""
    pick, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(4000)]
    for family in range(25):
        words = pick.sample(vocabulary, pick.choice([1, 2, 3, 10, 40, 150, 900]))
        for _ in range(pick.randint(1, 7)):
            edited = [w for w in words if pick.random() > pick.choice([0, 0.02, 0.1, 0.15])] or words[:1]
            edited += pick.sample(vocabulary, int(len(words) * pick.choice([0, 0.02, 0.1, 0.2])))
            pick.shuffle(edited)
            out.append(edited)
    out += [["common"]] * 3 + [["common", "rare"]] + [["a", "b", "c", f"x{i}"] for i in range(5)]
    rows = [(str(i + 1), w[0] if i % 4 == 0 else None, None, " ".join(w[1:] if i % 4 == 0 and len(w) > 1 else w)) for i, w in enumerate(out)]
    return rows, {i + 1: set(w) for i, w in enumerate(out)}


def test_all_pairs_against_brute_force(spark, tables, monkeypatch):
    rows, sets = pages()
    rows = [(*r, NOW) for r in rows] + [(rows[0][0], rows[0][1], None, f"  {rows[0][3]} ", datetime.datetime(2023, 1, 1)), ("900", "title only", None, None, NOW), ("901", "t", None, " ", NOW)]
    expected = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    data = tables(wiki=rows)
    found = [tuple(r) for r in neardup.p3_found(spark, data).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 60
    groups = {r.id: (r.class_id, r.group_id) for r in neardup.p3_groups(spark, data).collect()}
    assert set(groups) == set(sets)
    assert all((groups[a][0] == groups[b][0]) == (sets[a] == sets[b]) for a in sets for b in sets)
    assert all(groups[a][1] == groups[b][1] for a, b in expected)
    monkeypatch.setattr(neardup, "BLOCK", 3)  # every shard is split into blocks
    monkeypatch.setattr(neardup, "FEW", 0)  # classes are picked by a join
    monkeypatch.setattr(neardup, "MOST_BITS", 64)  # and hardly a text is left out before they are compared
    monkeypatch.setattr(neardup, "LEAST_BITS", 64)
    assert {tuple(r) for r in neardup.p3_found(spark, data).collect()} == expected


def test_last_delivery_counts(spark, tables):
    rows = [("1", None, None, "a b c d e f g h i j", NOW), ("2", None, None, "k l m", datetime.datetime(2023, 1, 1)), ("2", None, None, "a b c d e f g h i z", NOW), ("3", None, None, "a b c d e f g h i", None)]
    assert sorted(tuple(r) for r in neardup.p3_found(spark, tables(wiki=rows)).collect()) == [(1, 2), (1, 3), (2, 3)]


def sets_of(rows):
    texts = [" ".join(f"w{x}" for x in r) for r in rows]
    return neardup.Sets(pa.array([""] * len(texts)), pa.array(texts))


def test_sketches_never_exceed_the_difference():
    draw = np.random.default_rng(2)
    for n in (1, 5, 100, 127, 128, 129, 1000):
        base = np.unique(draw.integers(0, 2**62, n))
        other = np.unique(np.concatenate([base[: int(n * 0.8)], draw.integers(0, 2**62, int(n * 0.15))]))
        sets = sets_of([base, other])
        assert sets.n.tolist() == [len(base), len(other)]
        a, b = neardup.sketches(sets).to_pylist()
        width = min(len(a), len(b)) * 8
        fold = lambda s: ((k := int.from_bytes(s, "little")) >> width) ^ (k & ((1 << width) - 1)) if len(s) * 8 > width else int.from_bytes(s, "little")
        assert (fold(a) ^ fold(b)).bit_count() <= len(set(base.tolist()) ^ set(other.tolist()))


@pytest.mark.parametrize("visits", [1 << 21, 50])
def test_trees_find_all_within_the_radius(visits, monkeypatch):
    monkeypatch.setattr(neardup, "VISITS", visits)
    pick = random.Random(4)
    keys = [pick.getrandbits(128) for _ in range(300)]
    keys += [k ^ (1 << pick.randrange(128)) ^ (1 << pick.randrange(64)) for k in keys[:100]] + keys[:20]
    lanes = [np.array([k >> s & (2**64 - 1) for k in keys], np.uint64) for s in (0, 64)]
    of = np.repeat([3, 7, 9], 140)
    trees = neardup.Trees(lanes, of)
    asked = np.arange(0, len(keys), 10)
    name = np.array([3, 7, 9, 5])[asked % 4]
    got = {(q, x) for i, node, d in trees.near(lanes, asked, name, np.full(len(asked), 20)) for q, x in zip(i.tolist(), node.tolist())}
    assert got == {(q, x) for q, t in zip(asked.tolist(), name.tolist()) for x in range(len(keys)) if of[x] == t and (keys[q] ^ keys[x]).bit_count() <= 20}
    far = {(q, x) for i, node, d in trees.near(lanes, asked, name, np.full(len(asked), 60)) for q, x in zip(i.tolist(), node.tolist())}
    assert far == {(q, x) for q, t in zip(asked.tolist(), name.tolist()) for x in range(len(keys)) if of[x] == t and (keys[q] ^ keys[x]).bit_count() <= 60}


def test_pairs_are_compared_by_words():
    a, b = ["a b c d e f g", "x", "a b", ""], ["A b c d é f g h i j", "y", "b a a", ""]
    assert neardup.alike(pa.array(["", "", "t", ""]), pa.array(a), pa.array(["", "", "T", "t"]), pa.array(b)).tolist() == [True, False, True, False]
    assert not neardup.alike(pa.array([""]), pa.array(["a b c d e f"]), pa.array([""]), pa.array(["a b c d e f g h i"])).any()
