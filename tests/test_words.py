import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexshard.functions import words
from lexshard.functions.text import words_of

ODD = ["", "İSTANBUL K Å", "ﬁne ½ ㎒", "é" * 3, None, "áb", "x", "ǅ ß ſt", "\U0001d400b", "a", "", "b‍c", "plain Text 12", "ą́b\nc", "ﷺ٣"]


def test_odd_texts_split_as_defined():
    expected = [words_of(t) for t in ODD]
    assert words.split_words(pa.array(ODD)).to_pylist() == expected
    assert words.split_words(pa.array(ODD).slice(3, 9)).to_pylist() == expected[3:12]
    assert words.split_words(pa.array(ODD, pa.large_string())).to_pylist() == expected
    assert words.split_words(pa.array([], pa.string())).to_pylist() == []
    assert words.split_words(pa.array([None, None], pa.string())).to_pylist() == [[], []]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=("Cs",)), max_size=20), st.text("abZ9 é-́", max_size=20)), max_size=8))
def test_any_texts_split_as_defined(texts):
    assert words.split_words(pa.array(texts, pa.string())).to_pylist() == [words_of(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=("Cs",)), max_size=20), st.text("abZ9 é-́", max_size=20)), max_size=8))
def test_words_without_folding(texts):
    assert words.split_words(pa.array(texts, pa.string()), fold=False).to_pylist() == [words_of(t, fold=False) for t in texts]


def test_pieces_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 10)
    texts = ["a" * n for n in (0, 3, 8, 25, 1, 1, 9, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [p.column("text").to_pylist() for p in words.pieces(batch, "text")]
    assert sum(parts, []) == texts and len(parts) > 3
    assert list(words.pieces(batch.slice(0, 0), "text")) == []


def test_codes_and_hashes_are_those_of_the_words():
    ends, code, names = words.coded(words.split_words(pa.array(["b a b", None, "a c"])).slice(0, 3))
    assert ends.tolist() == [0, 3, 3, 5] and [names[i].as_py() for i in code.tolist()] == ["b", "a", "b", "a", "c"]
    again = words.hashes(pa.array(["c", "a"]))
    assert words.hashes(names)[code].tolist()[-2:] == again[::-1].tolist()


def test_no_combining_mark_lies_beyond_the_table():
    import sys
    import unicodedata

    assert not any(unicodedata.combining(chr(c)) for c in range(0x20000, sys.maxunicode + 1))


def test_distinct_numbers():
    import numpy as np

    assert words.distinct(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3] and len(words.distinct(np.empty(0, np.int64))) == 0


def test_hashes_of_different_words_differ():
    import numpy as np

    names = sorted({f"w{i}" for i in range(200_000)} | {"ab" * n for n in range(1, 200)} | {"a" * n for n in range(1, 300)} | {"x" * 64 + c + "y" * 64 for c in "abc"} | {"x" * 128 + c for c in "abc"})
    got = words.hashes(pa.array(names))
    assert len(np.unique(got)) == len(names)
    assert words.hashes(pa.array(names[5:9])).tolist() == got[5:9].tolist() == words.hashes(pa.array(names).slice(5, 4)).tolist()
    bits = np.unpackbits(got.view(np.uint8)).reshape(-1, 64).mean(0)
    assert (abs(bits - 0.5) < 0.01).all()
    assert words.hashes(pa.array([""])).tolist() == [0] and len(words.hashes(pa.array([], pa.string()))) == 0
