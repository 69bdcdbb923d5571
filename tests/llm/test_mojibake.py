import random

import numpy as np
import pyarrow as pa
import pytest

from lexshard.llm import mojibake
from lexshard.llm.mojibake import LOST

CLEAN = {
    "fr": "La rivière près du château était fermée jusqu’à l’été où le café protégé fut rebâti à côté de la forêt étroite par des élèves célèbres",
    "de": "Die hölzerne Mühle über der großen Brücke gehört später für Gäste während schöne Körbe täglich müssen geprüft größer Straße",
    "pl": "Wokół wieży rośnie piękna ścieżka a później mówią że łódź była żółta więc każdy młyn stał się droższy najczęściej tę łąkę",
    "ru": "Старая мельница около реки была высокая но зимой здесь тихая башня и люди называют её новая лодка потом свеча исчезли мастер сделал",
    "en": "The façade of the café is naïve — its décor costs £12 or €40 and “the deck” isn’t a cliché… It’s 4\xa0days × 7\xa0miles at 20°",
    "pt": "A estação não é uma tradição antiga pois o coração da canção romântica está na construção do pão já também lá",
}
GARBLED = [
    ("fr", lambda t: t.encode().decode("latin-1")), ("en", lambda t: t.encode().decode("cp1252", "replace").replace("�", "")), ("de", lambda t: t.encode().decode("mac_roman")), ("pt", lambda t: t.encode().decode("cp437")),
    ("fr", lambda t: t.encode().decode("cp850")), ("ru", lambda t: t.encode("cp1251").decode("latin-1")), ("ru", lambda t: t.encode("koi8_r").decode("cp1251")), ("pl", lambda t: t.encode("cp1250").decode("cp1252")),
    ("pl", lambda t: t.encode("iso8859_2").decode("latin-1")), ("de", lambda t: t.encode().decode("latin-1").encode().decode("latin-1")), ("fr", lambda t: t.encode("latin-1", "ignore").decode("utf-8", "replace")),
    ("de", lambda t: t.encode().decode("latin-1").lower()), ("ru", lambda t: t.encode().decode("cp1251", "replace").replace("�", "")),
]


def documents(n=600, seed=3):
    """Clean texts in six languages, traps that only look odd, and every tenth text garbled wholly or in one passage."""
    pick, rows, bad = random.Random(seed), [], {}
    for i in range(n):
        lang = pick.choice(sorted(CLEAN))
        sentence = lambda t: " ".join(pick.sample(CLEAN[t].split(" "), 9))
        parts = [sentence(lang) + "." for _ in range(pick.randint(2, 5))]
        if i % 5 == 1:
            parts.append(pick.choice(["ÂNGULO: 45° ± 3′.", "NÃO HÁ CORAÇÃO.", "Statol™ e mepik®", "PÂTÉ À LA carte", "¡¿Qué!? § ¶", "x² + √y ½", "一盏灯笼。", "โคมไฟ", "🐝🏮", "Река Серая", "​‍", "Â, Ã e Õ"]))
        if i % 10 == 0:
            lang, garble = GARBLED[i // 10 % len(GARBLED)]
            whole = " ".join(sentence(lang) + "." for _ in range(4))
            bad[i] = whole
            parts.append(garble(whole))
            pick.shuffle(parts) if i % 20 else None
        rows.append((i, None, None, pick.choice([" ", "\n"]).join(parts)))
    return rows, bad


def test_garbled_records_are_found_and_undone(spark, tables):
    rows, bad = documents()
    rows += [(9000, None, None, None), (9001, None, None, ""), (9002, None, None, "plain ascii"), (rows[0][0], None, None, rows[0][3])]
    data = tables(documents=rows)
    found = [r.doc_id for r in mojibake.p8_found(spark, data).collect()]
    assert len(found) == len(set(found)) and set(found) == set(bad)
    repairs = {r.doc_id: r for r in mojibake.p8_repairs(spark, data).collect()}
    undone = [i for i in bad if repairs[i].whole and i // 10 % len(GARBLED) in (0, 2, 3, 4, 5, 6, 7, 8, 9)]
    right = sum(bad[i] in repairs[i].repaired.replace("\n", " ") for i in undone)
    assert len(undone) > 30 and right >= 0.85 * len(undone)
    assert all(repairs[i].chains for i in bad)


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r"])
def test_utf8_sequences_are_put_together(codec):
    for word in ("café", "naïve", "“décor”", "€40", "Größe"):
        try:
            garbled = word.encode().decode(codec)
        except UnicodeDecodeError:
            continue
        if codec in mojibake.CYRILLIC and word != "€40":
            continue
        assert mojibake.undo_utf8(garbled, codec) == word
    assert mojibake.undo_utf8("clean", codec) == "clean"


def test_byte_chains_and_damage():
    assert mojibake.undo_bytes("Òðàâà", "latin-1", "cp1251") == "Трава" and mojibake.undo_bytes("日", "latin-1", "cp1251") is None
    assert mojibake.undo_utf8("naã¯ve", "latin-1") == "naïve" and mojibake.undo_utf8("25Â", "latin-1") == "25\xa0"
    assert mojibake.garbled_words("a é\nb é ü\xa0x") == ["é", "ü\xa0x"]


def test_long_text(spark, tables):
    rows, _ = documents(120)
    text = " ".join(t for _, _, _, t in rows[1:9]) * 300
    rows = [r for r in rows if r[0] % 10] + [(7000, None, None, text), (7001, None, None, text + " " + "façade décor naïve".encode().decode("latin-1"))]
    assert [r.doc_id for r in mojibake.p8_found(spark, tables(documents=rows)).collect()] == [7001]


@pytest.mark.parametrize("written_in, read_as, lang", [("cp1251", "latin-1", "ru"), ("utf-8", "cp437", "fr"), ("cp1252", "mac_roman", "fr")])
def test_one_source_garbled_alike_does_not_train(spark, tables, written_in, read_as, lang):
    pick = random.Random(5)
    sentence = lambda t: " ".join(pick.sample(CLEAN[t].split(" "), 9)) + "."
    langs = sorted(set(CLEAN) - {lang})
    rows = [(i, None, None, " ".join(sentence(lang if i % 15 == 0 else langs[i % 5]) for _ in range(3))) for i in range(300)]
    bad = {1000 + i: " ".join(sentence(lang) for _ in range(4)) for i in range(150)}
    copies = {2000 + i: bad[1000] for i in range(40)}
    rows += [(i, None, None, t.encode(written_in, "ignore").decode(read_as)) for i, t in (bad | copies).items()]
    found = {r.doc_id for r in mojibake.p8_found(spark, tables(documents=rows)).collect()}
    assert found == set(bad | copies)


@pytest.mark.parametrize("passage, chain", [("café, cliché, protégé, décor, été", ("cp1252", "mac_roman")), ("była mała stała łódka miała", ("cp1250", "cp1252"))])
def test_passage_with_one_kind_of_letter(passage, chain):
    model = model_of([passage, *CLEAN.values()] * 40)
    garbled = passage.encode(chain[0]).decode(chain[1])
    chains, whole, fixes = model.judge("Plain words before. " + garbled)
    assert chains and whole and " ".join(fixes.get(w, w) for w in garbled.split(" ")) == passage and model.judge(passage)[0] == []


def model_of(texts):
    tables = [np.zeros(n, np.int64) for n in mojibake.SLOTS]
    for text in texts:
        for t, s in zip(tables, mojibake._slots(mojibake._codes(f" {text.lower()} "))):
            t[np.unique(s)] += 1
    return mojibake.Model(*tables, records=len(texts))


def test_margin_is_not_decided_by_copies_or_by_one_record(spark):
    """Every different text counts once, and all do: copies of one text leave the margin as it is."""
    assert mojibake.least_margin(10_000, [5, 4, 4, 3]) == 4.0 and mojibake.least_margin(10_000, [40, 30, 9, 3]) == 6.0 and mojibake.least_margin(0, [0] * 4) == 4.0
    rows, _ = documents(150)
    few = spark.createDataFrame([(t,) for _, _, _, t in rows], "text string")
    many = few.union(spark.createDataFrame([(rows[0][3],)] * 1500, "text string"))
    a, b = mojibake.trained(few), mojibake.trained(many)
    assert a.margin == b.margin and a.records == b.records and all((x == y).all() for x, y in ((a.three, b.three), (a.two, b.two), (a.one, b.one)))


def test_only_the_garbled_passages_are_changed():
    model = model_of([*CLEAN.values()] * 40)
    wrong = {
        "ru": CLEAN["ru"].encode("cp1251").decode("latin-1"), "de": CLEAN["de"].encode().decode("latin-1"), "pl": CLEAN["pl"].encode("iso8859_2").decode("cp1252", "ignore"),
    }
    for langs in (("ru",), ("ru", "de"), ("ru", "pl")):
        chains, whole, fixes = model.judge("\n".join([CLEAN["fr"], *(wrong[x] for x in langs), CLEAN["en"]]))
        undo = lambda t: " ".join(fixes.get(w, w) for w in t.split(" "))
        assert whole and len(chains) == len(langs)
        assert undo(CLEAN["fr"]) == CLEAN["fr"] and undo(CLEAN["en"]) == CLEAN["en"]
        assert [x for x in langs if x != "pl" and undo(wrong[x]) != CLEAN[x]] == []


def test_clean_records_are_found_again_once_garbled():
    """Every chain over several words of clean records; the clean records themselves gain too little."""
    model = model_of([*CLEAN.values()] * 40)
    pick, found, tried = random.Random(8), 0, 0
    for lang, garble in GARBLED:
        for _ in range(20):
            words = pick.sample([w for w in CLEAN[lang].split(" ") if not w.isascii()], 5)
            assert model.judge("Plain words, then " + " ".join(words))[0] == []
            tried, found = tried + 1, found + bool(model.judge("Plain words, then " + " ".join(map(garble, words)))[0])
    assert found >= 0.97 * tried


def test_words_are_judged_together_as_alone():
    model, again = model_of([*CLEAN.values()] * 40), model_of([*CLEAN.values()] * 40)
    words = sorted({g for lang, garble in GARBLED for w in CLEAN[lang].split(" ") for g in (w, garble(w)) if g and not g.isascii()})
    for w, u in zip(words, model.learned(words)):
        alone = again.learned([w])[0]
        assert (u.word, u.chains) == (alone.word, alone.chains) and abs(u.gain - alone.gain) < 1e-9
        assert [(p, c) for p, _, c in u.bytewise] == [(p, c) for p, _, c in alone.bytewise] and np.allclose([g for _, g, _ in u.bytewise], [g for _, g, _ in alone.bytewise])
        for (read_as, written_in), gain, _ in u.bytewise:
            assert abs(gain - (model.known(mojibake.undo_bytes(w, read_as, written_in)) - model.known(w))) < 1e-9
        every = {(r, x) for r in mojibake.READ_AS for x in mojibake.WRITTEN_IN if r != x and (v := mojibake.undo_bytes(w, r, x)) is not None and LOST not in w and v != w and model.known(v) > model.known(w) + 1e-9}
        assert every <= {p for p, _, _ in u.bytewise}


def test_texts_are_split_into_odd_words_as_one_by_one():
    texts = ["a é\nb é ü\xa0x", "", "plain", " é", "日本 x é", "\té\r\n"]
    row, code, names = mojibake.odd_words(pa.array(texts))
    got = [{names[c].as_py() for r, c in zip(row.tolist(), code.tolist()) if r == i} for i in range(len(texts))]
    assert got == [set(mojibake.garbled_words(t)) for t in texts]
