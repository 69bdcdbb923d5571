import os
import random

import pytest

from lexshard.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})


def texts():
    pick = random.Random(1)
    vocabulary = [t.decode("utf-8", "ignore") for t in bpe.load_ranks(bpe.VOCABULARY)]
    out = ["".join(pick.choices(vocabulary, k=pick.randint(1, 30))) for _ in range(1500)]
    out += ["".join(pick.choice("abeinorst  \n\t--==éñ日本🐝́​1290'") for _ in range(pick.randint(1, 80))) for _ in range(1500)]
    out += [c * n for c in (" ", "a", "-", "=", "ab", "\n", "é", "日") for n in (1, 2, 3, 63, 64, 65, 1000, 20_000)]
    return out + ["", " ", "\n", "<|endoftext|> don't we'll", "tail ", "a\u0085b", "x" * 200_000]


def test_words_against_the_library(oracle):
    """Also with a guess that is mostly wrong: verification must catch it."""
    import regex

    words = sorted({w for t in texts() for w in regex.findall(bpe.PATTERN, t)})
    v = bpe.vocabulary(bpe.VOCABULARY)
    got = v.encode_words(words)
    assert got == [oracle.encode_ordinary(w) for w in words]
    assert sum(v.guess(w.encode()) != g for w, g in zip(words, got)) > 1000
    assert all(bpe.merged(w.encode(), v.ranks)[0] == g for w, g in list(zip(words, got))[::7])


def test_column(spark, oracle, tables):
    rows = [(i, None, None, t) for i, t in enumerate(texts())] + [(7, None, None, "again"), (7, None, None, "again"), (None, None, None, "no id"), (8, None, None, None)]
    got = [(r.doc_id, r.ids) for r in bpe.p6_ids(spark, tables(documents=rows)).collect()]
    expected = [(r[0], oracle.encode_ordinary(r[3]) if r[3] else []) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_round_trip(oracle):
    v = bpe.vocabulary(bpe.VOCABULARY)
    tokens = {i: t for t, i in v.ranks.items()}
    for t in texts()[:500]:
        ids = [i for w in v.encode_words(__import__("regex").findall(bpe.PATTERN, t)) for i in w]
        assert b"".join(tokens[i] for i in ids).decode() == t


def test_size_is_checked(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TOKENS", 10)
    with pytest.raises(ValueError):
        bpe.load_ranks(bpe.VOCABULARY)
