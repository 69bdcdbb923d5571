import random

import numpy as np
import pyarrow as pa
import pytest

from lexshard.functions.text import words_of
from lexshard.llm import leakage


def made(seed=5):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[pick.choice(vocabulary) for _ in range(pick.randint(0, 60))] for _ in range(30)]
    items += [items[3], items[4][5:30], ["a"] * 12, items[5][:9], items[6][:10]]
    docs = []
    for _ in range(200):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 90))]
        for _ in range(pick.choice([0, 1, 3])):
            source = pick.choice(items)
            at, n, to = pick.randrange(len(source) + 1), pick.randint(8, 14), pick.randrange(len(words) + 1)
            words[to:to] = source[at : at + n]
        docs.append(words)
    return docs + [items[0], ["a"] * 3000, ["x"] * 5000 + items[1] + ["y"] * 700 + items[2]], items


def brute(docs, items):
    runs = [{tuple(w[i : i + 10]) for i in range(len(w) - 9)} for w in items]
    return {(d, i) for d, w in enumerate(docs) for mine in [{tuple(w[j : j + 10]) for j in range(len(w) - 9)}] for i, r in enumerate(runs) if mine & r}


def test_pairs_against_brute_force(spark, tables, monkeypatch):
    docs, items = made()
    rows = [(d, None, None, ", ".join(w).upper()) for d, w in enumerate(docs)] + [(0, None, None, " ".join(items[0])), (None, None, None, " ".join(items[0]))]
    held = [(i, " — ".join(w)) for i, w in enumerate(items)] + [(7, " ".join(items[7])), (900, None), (None, " ".join(items[1]))]
    expected = brute(docs, items) | {(0, i) for i in [b for _, b in brute([items[0]], items)]}
    data = tables(documents=rows, eval_items=held)
    found = [tuple(r) for r in leakage.p7_found(spark, data).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 100
    counts = {r.item_id: r.documents for r in leakage.p7_items(spark, data).collect()}
    assert counts == {i: sum(x == i for _, x in expected) for i in {x for _, x in expected}}
    for name, size in (("LEAST_SLOTS", 64), ("MOST_SLOTS", 64), ("LEAST_BITS", 64), ("MOST_BITS", 64)):
        monkeypatch.setattr(leakage, name, size)  # tables far too small: every block may end a pattern, every run be one
    assert {tuple(r) for r in leakage.p7_found(spark, data).collect()} == expected


def tables_of(items, slots, bits):
    words, ends, _ = leakage._numbers(pa.array([" ".join(w) for w in items]))
    slot, shift, entry, held = leakage.Patterns.entries(words, ends, slots, bits)
    out = leakage.Patterns(np.full(slots, leakage.RUN - 1, np.uint8), np.zeros(bits // 64, np.uint64))
    out.shifts[slot], out.bits[entry] = shift, held
    return out


@pytest.mark.parametrize("segment", [1, 7, 256])
@pytest.mark.parametrize("slots, bits", [(64, 64), (1 << 16, 1 << 18)])
def test_search_jumps_over_nothing(segment, slots, bits, monkeypatch):
    monkeypatch.setattr(leakage, "SEGMENT", segment)
    docs, items = made(segment)
    words, ends, split = leakage._numbers(pa.array([" ".join(d) for d in docs]))
    text, place, _ = tables_of(items, slots, bits).search(words, ends)
    runs = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    got = {(t, said) for t, said in zip(text.tolist(), leakage._said(split, place)) if tuple(said.split()) in runs}
    assert got == {(d, " ".join(w[i : i + 10])) for d, w in enumerate(docs) for i in range(len(w) - 9) if tuple(w[i : i + 10]) in runs}
    if bits > 64:
        assert len(text) < 1.1 * sum(tuple(w[i : i + 10]) in runs for w in docs for i in range(len(w) - 9)) + 5


def test_tables_are_bounded():
    assert leakage.Patterns.sizes(0) == (1 << 16, 1 << 16)
    assert leakage.Patterns.sizes(20_000_000) == (1 << 22, 1 << 28) == leakage.Patterns.sizes(10**15)
    assert all(n & (n - 1) == 0 for words in (5000, 123_457) for n in leakage.Patterns.sizes(words))


def test_accents_and_case_don_t_matter():
    assert words_of("CAFÉ No. 1") == ["cafe", "no", "1"]
