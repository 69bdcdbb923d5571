"""Problem 8: text that was read in the wrong encoding, found and undone by character n-gram models.

A chain is a pair of encodings: bytes written in one and read in the other. Undoing it encodes a word in the wrong
one and decodes it in the right one; where that is UTF-8, single garbled sequences within a word are undone alone.
Character trigram models, trained on the clean records of the collection itself, score the word before and after each
chain; the likeliest chain is accepted if it gains more than a margin, and undone again as long as that gains (text
garbled twice). The margin is validated on clean records: they must keep what they have. How many records are found again
when clean ones are garbled has been measured; the README has the figures.

The models count in how many records an n-gram stands, not how often: one garbled record weighs as one. They are
kept in hash tables of fixed size, so what is broadcast doesn't grow with the data.

Words are judged, on arrays: what every chain makes of every word of a batch is scored at once. The words that stand in
most batches are judged once for all and their verdicts broadcast, as many as KNOWN; the others where they occur.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from functools import lru_cache
from unicodedata import category, name

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.functions.words import bytes_of, distinct, mixed, pieces
from lexshard.session import settled, spread, table

#: Encodings a text may have been read in by mistake, and those it may have been written in (besides UTF-8).
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "iso8859_15", "mac_cyrillic", "iso8859_5", "iso8859_9")
WRITTEN_IN = ("cp1252", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1250", "iso8859_2", "cp1257", "iso8859_7", "cp1253", "mac_roman", "cp437", "cp850")
#: Slots of the hash tables for trigrams, bigrams and characters.
SLOTS = (1 << 20, 1 << 18, 1 << 16)
#: The margins that may come out, and the share of clean records by which one may change more than the largest.
MARGINS = (4.0, 5.0, 6.0, 8.0)
STRAY = 0.001
NOT_ASCII = "[^\\x00-\\x7F]"
LOST = "�"
#: Words whose verdicts are broadcast, those in the most batches; how many are judged at a time; verdicts a task keeps of the rest.
KNOWN, TOGETHER, KEPT = 100_000, 2000, 50_000
#: Bytes of text whose n-grams are sorted at a time: few enough for a core's cache.
PART = 1 << 17
#: What a byte chain must gain over the different words of a record: more than any clean record gains by chance.
EVIDENCE = 20.0
PUNCTUATION = ".,;:!?()[]{}\"'«»„“”‘’…–—-"
#: What a lost character may have been.
LETTERS = "éèêëàâáãäåæçíìîïñóòôöõøúùûüýßąćęłńśźżёабвгдежзийклмнопрстуфхцчшщъыьэюя’“”–—…€£°×«»\xa0½§"
#: Share of a word's other characters that a chain read as Cyrillic must put together: there every letter is garbled.
CYRILLIC, WHOLLY = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5"), 0.7
#: What a capital after a small letter costs a word.
ODD_CASE = 4.0
#: Log of the share of records that hold a usual trigram: commoner ones speak for a word, rarer ones against it.
USUAL = -4.6
_PRIMES = (1_000_003, 7_368_787)


def _decoded(codec: str) -> str:
    """The 256 characters of an encoding; bytes it leaves undefined stand for themselves."""
    return "".join(b if (b := bytes([i]).decode(codec, "ignore")) else chr(i) for i in range(256))


BYTES_OF = {c: {ch: i for i, ch in reversed(list(enumerate(_decoded(c)))) if i >= 0x80} for c in READ_AS}
CHARS_OF = {c: _decoded(c) for c in WRITTEN_IN}
_NEED = np.zeros(256, np.int8)
_NEED[0xC2:0xE0], _NEED[0xE0:0xF0], _NEED[0xF0:0xF5] = 1, 2, 3


_SEQUENCE = re.compile("[\xc2-\xf4][\x80-\xbf]|[0-9A-Za-z]\xc2$")
#: Characters as the byte they were read from (as a Latin-1 character), as they are and in upper case; others as NUL.
_AS_BYTES = {
    c: ({**{i: 0 for i in range(0x80, 0x100)}, **{ord(ch): b for ch, b in m.items()}}, {**{i: 0 for i in range(0x80, 0x100)}, **{ord(ch): m.get(ch.upper(), b) for ch, b in m.items()}})
    for c, m in BYTES_OF.items()
}


def _some(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


def _possible(m: dict[str, int]) -> str:
    """What a word must hold so that undo_utf8 can change it: a lead character and as many tails as it needs."""

    def of(low: int, high: int) -> str:
        return _some({x for ch, b in m.items() if low <= b < high or low <= m.get(ch.upper(), b) < high for x in (ch, ch.lower()) if len(x) == 1})

    tail = of(0x80, 0xC0)
    return f"{of(0xC2, 0xE0)}{tail}|{of(0xE0, 0xF0)}{tail}{{2}}|{of(0xF0, 0xF5)}{tail}{{3}}|[0-9A-Za-z]{of(0xC2, 0xC3)}$"


_POSSIBLE = {c: re.compile(_possible(m)) for c, m in BYTES_OF.items()}
_ANY_POSSIBLE = re.compile("|".join(dict.fromkeys(p.pattern for p in _POSSIBLE.values())))


def undo_utf8(word: str, read_as: str) -> str:
    """The word with every UTF-8 sequence that was read as single bytes put together again.

    Case may have been changed since: a character counts as its upper case where only that continues a sequence. A
    no-break space may have become the blank after the word.
    """
    raw, upper = _AS_BYTES[read_as]
    if not _SEQUENCE.search(word.translate(raw)) and not _SEQUENCE.search(word.translate(upper)):
        return word
    codes = BYTES_OF[read_as]
    byte = [codes.get(c, -1) for c in word]
    out, i, n, used = [], 0, len(word), 0
    while i < n:
        done = False
        for lead in (byte[i], codes.get(word[i].upper(), -1) if byte[i] >= 0 and word[i].upper() != word[i] else -1):
            if lead < 0 or not (need := int(_NEED[lead])):
                continue
            tail = []
            for j in range(i + 1, i + 1 + need):
                b = byte[j] if j < n else -1
                if not 0x80 <= b < 0xC0 and j < n:
                    b = codes.get(word[j].upper(), -1) if len(word[j].upper()) == 1 else -1
                if j == n and need == 1 and lead == 0xC2 and i and word[i - 1].isalnum() and word[i - 1].isascii():
                    b = 0xA0
                if not 0x80 <= b < 0xC0:
                    break
                tail.append(b)
            if len(tail) == need:
                try:
                    out.append(bytes([lead, *tail]).decode("utf-8"))
                except UnicodeDecodeError:
                    continue
                i, done, used = i + 1 + need, True, used + 1 + need
                break
        if not done:
            out.append(word[i])
            i += 1
    if read_as in CYRILLIC and used < WHOLLY * sum(c >= "\x80" for c in word):
        return word
    return "".join(out)


def undo_bytes(word: str, read_as: str, written_in: str) -> str | None:
    """The word with each character replaced by what its byte means in the other encoding; None if it has no byte."""
    codes, chars = BYTES_OF[read_as], CHARS_OF[written_in]
    out = []
    for c in word:
        if c < "\x80":
            out.append(c)
        elif (b := codes.get(c)) is None:
            return None
        else:
            out.append(chars[b])
    return "".join(out)


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigrams, bigrams and characters of a text given as code points."""
    c = codes.astype(np.int64)
    three = (c[:-2] * _PRIMES[0] * 31 + c[1:-1] * _PRIMES[1] + c[2:] * 97) % SLOTS[0] if len(c) > 2 else np.empty(0, np.int64)
    two = (c[:-1] * _PRIMES[0] + c[1:] * 97) % SLOTS[1] if len(c) > 1 else np.empty(0, np.int64)
    return three, two, c % SLOTS[2]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def garbled_words(text: str) -> list[str]:
    """The words (between ASCII white space) that hold more than ASCII, each once."""
    return list(dict.fromkeys(w for w in re.split(r"[ \t\r\n]+", text) if not w.isascii()))


def _signs() -> re.Pattern:
    """What garbled text shows without a model: lost and control characters, UTF-8 sequences of the usual scripts as every
    encoding reads them, in lower case too, and what letters of one single-byte encoding become in another: symbols or
    capitals within a word, two scripts in it, many accented letters in a row."""
    some = _some
    parts = ["[\ufffd\x80-\x84\x86-\x9f]"]
    for c in READ_AS:
        lead, tail = ({ch for ch, b in BYTES_OF[c].items() if b in at} for at in ((0xC2, 0xC3, 0xC4, 0xC5, 0xCE, 0xCF, 0xD0, 0xD1), range(0x80, 0xC0)))
        if c in CYRILLIC:
            parts += [f"(?:{some(lead)}{some(tail)}){{2}}", f"{some(lead)}{some(ch for ch in tail if category(ch)[0] == 'S')}"]
        else:
            parts += [f"{some(lead | {ch.lower() for ch in lead if ch.isalpha()})}{some(tail)}"]
        parts.append(re.escape(_decoded(c)[0xE2] + _decoded(c)[0x80]))
    every = {ch for m in BYTES_OF.values() for ch in m}
    letters = {ch for ch in every if ch.isalpha() and ch not in "ªºµ"}
    script = {k: {ch for ch in letters if name(ch).startswith(k)} for k in ("LATIN", "CYRILLIC", "GREEK")}
    symbols = {ch for ch in every if not ch.isalnum() and ch not in "’‘–—…·\xad\xa0«»“”" and ch.isprintable()}
    low, up = some(ch for ch in letters if ch.islower()), some(ch for ch in letters if ch.isupper())
    word = some(letters)[:-1] + "A-Za-z]"
    parts += [f"{word}{some(symbols)}+{word}", f"{low[:-1]}a-z]{up}", f"{low}[A-Z]", f"{some(script['LATIN'])}{{4}}"]
    for k in ("CYRILLIC", "GREEK"):
        parts += [f"{some(letters - script[k])[:-1]}A-Za-z]{some(script[k])}", f"{some(script[k])}{some(letters - script[k])[:-1]}A-Za-z]"]
    return re.compile("|".join(parts))


_SIGNS = _signs()


def looks_clean(text: str) -> bool:
    """Whether a record may train the models at first: it shows no sign of garbling. Many that do are clean after all."""
    return text.isascii() or not _SIGNS.search(text)


def odd_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(text, number) of every word that holds more than ASCII, once per text, and the different words; as garbled_words."""
    raw, ends = bytes_of(texts)
    inside = ~np.isin(raw, np.frombuffer(b" \t\r\n", np.uint8), kind="table")
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = ends[1:-1]
    borders = borders[(borders > 0) & (borders < len(raw))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    held = np.zeros(len(starts) + 1, bool)
    held[np.searchsorted(starts, np.flatnonzero(raw >= 0x80), "right")] = True
    starts, many = starts[held[1:]], (np.flatnonzero(last) + 1 - starts)[held[1:]]
    offsets = np.append(0, np.cumsum(many))
    data = raw[np.repeat(starts - offsets[:-1], many) + np.arange(offsets[-1])]
    names = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
    size = max(len(names.dictionary), 1)
    keys = distinct((np.searchsorted(ends, starts, "right") - 1) * size + names.indices.to_numpy())
    return keys // size, keys % size, names.dictionary


@lru_cache(maxsize=1)
def _cases() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its small letter (itself if that is several characters), whether it is small, whether a capital."""
    low = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    small, capital = np.zeros(len(low), bool), np.zeros(len(low), bool)
    for i in range(0x20000):  # no letter with case stands beyond
        c = chr(i)
        if c.isupper() or c.islower() or c.lower() != c:
            small[i], capital[i] = c.islower(), c.isupper()
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
    return low, small, capital


@lru_cache(maxsize=1)
def _chain_numbers() -> dict[tuple[str, str], int]:
    return {p: i for i, p in enumerate(_byte_chains()[0])}


@lru_cache(maxsize=1)
def _byte_chains() -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
    """(pairs of encodings (read as, written in), place of each character beyond ASCII in an alphabet (0: in none), what each
    pair makes of each place (0: nothing))."""
    alphabet = {c: i for i, c in enumerate(sorted({c for m in BYTES_OF.values() for c in m}), 1)}
    pairs = [(r, w) for r in READ_AS for w in WRITTEN_IN if r != w]
    made = np.zeros((len(pairs), len(alphabet) + 1), np.uint32)
    for k, (r, w) in enumerate(pairs):
        for c, b in BYTES_OF[r].items():
            made[k, alphabet[c]] = ord(CHARS_OF[w][b])
    place = np.zeros(0x10000, np.int64)
    place[[ord(c) for c in alphabet]] = list(alphabet.values())
    return pairs, place, made


#: Odd numbers for the places within a word, to tell results apart.
_SALT = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words with a blank before and after each, where each begins and the last ends)."""
    ends = np.cumsum([0, *(len(w) + 2 for w in words)])
    return _codes("".join(f" {w} " for w in words)), ends


@dataclass
class Undone:
    """A word without UTF-8 chains, the chains, their gain, and the byte chains that gain: (encodings, gain, whether a control character goes)."""

    word: str
    chains: list[str]
    gain: float
    bytewise: list[tuple[tuple[str, str], float, bool]]

    @property
    def alone(self) -> bool:
        """Whether the word may be enough for its text to be garbled."""
        return bool(self.chains) or any(control for _, _, control in self.bytewise)


class Verdicts:
    """Verdicts of many words, as arrays; a word's own is put together when it is asked for."""

    def __init__(self, rows: pa.Table) -> None:
        self.words = rows.column("word").combine_chunks()
        self.alone, self.gain = (rows.column(c).to_numpy() for c in ("alone", "gain"))
        pairs, gains = (rows.column(c).combine_chunks() for c in ("pair", "gains"))
        self.first = pairs.offsets.to_numpy().astype(np.int64) - pairs.offsets[0].as_py() if len(pairs) else np.zeros(1, np.int64)
        self.pairs, self.gains = pairs.flatten().to_numpy().astype(np.int64), gains.flatten().to_numpy()
        self.rest = rows.select(["undone", "chains", "gain", "pair", "gains", "controls"]).combine_chunks()
        self.place: dict[str, int] = {}
        self.made: dict[str, Undone] = {}

    def find(self, words: pa.StringArray) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def of(self, word: str) -> Undone | None:
        if not self.place:
            self.place = {w: i for i, w in enumerate(self.words.to_pylist())}
        if (got := self.made.get(word)) is not None or (i := self.place.get(word)) is None:
            return got
        r, pairs = self.rest.slice(i, 1).to_pylist()[0], _byte_chains()[0]
        got = self.made[word] = Undone(r["undone"], r["chains"], r["gain"], [(pairs[k], g, c) for k, g, c in zip(r["pair"], r["gains"], r["controls"])])
        return got

    @staticmethod
    def row(word: str, u: Undone) -> tuple:
        number = _chain_numbers()
        return word, u.alone, u.word, u.chains, u.gain, [number[p] for p, _, _ in u.bytewise], [g for _, g, _ in u.bytewise], [c for _, _, c in u.bytewise]


_VERDICT = "word string, alone boolean, undone string, chains array<string>, gain double, pair array<short>, gains array<double>, controls array<boolean>"


@dataclass
class Model:
    """In how many records each trigram, bigram and character stands, hashed, and how many records there are."""

    three: np.ndarray
    two: np.ndarray
    one: np.ndarray
    records: int
    margin: float = 6.0
    seen: dict[str, Undone] = field(default_factory=dict, repr=False)
    verdicts: Verdicts | None = field(default=None, repr=False)

    def scores_of(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of words given as code points with a blank before and after each; word i is codes[ends[i]:ends[i + 1]].

        In small letters; for each trigram, smoothed by its bigrams and characters.
        """
        low, small, capital = _cases()
        three, two, one = _slots(low[codes])
        n = self.records + 1.0
        p1 = (self.one[one] + 0.5) / n
        p2 = np.maximum((self.two[two] - 0.5) / n, 0) + 0.1 * np.minimum(p1[:-1], p1[1:])
        p3 = np.maximum((self.three[three] - 0.5) / n, 0) + 0.1 * np.minimum(p2[:-1], p2[1:])
        gain = np.append(np.log(p3) - USUAL, [0.0, 0.0])
        odd = np.append(small[codes[:-1]] & capital[codes[1:]], False)
        gain[np.concatenate([ends[1:] - 1, ends[1:] - 2])] = 0.0
        return np.add.reduceat(gain, ends[:-1]) - ODD_CASE * np.add.reduceat(odd, ends[:-1], dtype=np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        """Of words that aren't empty."""
        if not words:
            return np.empty(0)
        return self.scores_of(*_padded(words))

    def known(self, word: str) -> float:
        return float(self.scores([word])[0])

    def filled(self, word: str) -> str:
        """The word with every lost character replaced by the likeliest one."""
        while (at := word.find(LOST)) >= 0:
            tried = [word[:at] + c + word[at + 1 :] for c in LETTERS]
            word = tried[int(np.argmax(self.scores(tried)))]
        return word

    def chained(self, words: list[str], start: np.ndarray) -> list[Undone]:
        """What the likeliest UTF-8 chains or fillings make of each word, each accepted if it gains more than the margin.

        All words take their next step together, as long as one gains.
        """
        out = [Undone(w, [], 0.0, []) for w in words]
        base = start.tolist()
        live = [i for i, w in enumerate(words) if not w.isascii() and (LOST in w or _ANY_POSSIBLE.search(w))]
        while live:
            tried: list[tuple[int, str, str]] = []
            for i in live:
                now, found = out[i].word, {}
                if LOST in now:
                    found[self.filled(now)] = "lost"
                for r in READ_AS:
                    if _POSSIBLE[r].search(now) and (v := undo_utf8(now, r)) != now:
                        found[v] = max(found.get(v, ""), f"utf-8 as {r}")
                tried += [(i, v, chain) for v, chain in found.items()]
            best: dict[int, tuple[float, str, str]] = {}
            for (i, v, chain), score in zip(tried, self.scores([v for _, v, _ in tried]).tolist()):
                if (step := (score - base[i], v, chain)) > best.get(i, (self.margin,)):
                    best[i] = step
            for i, (gain, v, chain) in best.items():
                base[i] += gain
                out[i] = Undone(v, [*out[i].chains, chain], out[i].gain + gain, [])
            live = list(best)
        return out

    def bytewise(self, codes: np.ndarray, ends: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, chain, gain, undoes a control character) of every byte chain that makes a likelier word; all words and chains at once.

        Words are given as in scores_of, start are their scores. Chains that make the same of a word are scored once.
        """
        pairs, place, made = _byte_chains()
        at = np.flatnonzero(codes >= 0x80)
        char = codes[at]
        letter = np.where(char < 0x10000, place[np.minimum(char, 0xFFFF)], 0)
        word = np.searchsorted(ends, at, "right") - 1
        first = np.searchsorted(word, np.arange(len(ends) - 1))
        salt = _SALT[(at - ends[word]) & 63]
        sets, chains, marks = [], [], []
        for k in range(len(pairs)):
            out = made[k, letter]
            ok = np.logical_and.reduceat(out > 0, first) & np.logical_or.reduceat(out != char, first)
            found = np.flatnonzero(ok)
            sets.append(found)
            chains.append(np.full(len(found), k))
            marks.append(np.add.reduceat(out.astype(np.uint64) * salt, first)[found])
        words, chain, mark = map(np.concatenate, (sets, chains, marks))
        _, kept, same = np.unique(mixed(mark + mixed(words.astype(np.uint64))), return_index=True, return_inverse=True)
        if not len(kept):
            return words, chain, np.empty(0), np.empty(0, bool)
        # the different results, as code points
        w, k = words[kept], chain[kept]
        many = np.diff(ends)[w]
        offsets = np.append(0, np.cumsum(many))
        results = codes[np.repeat(ends[w] - offsets[:-1], many) + np.arange(offsets[-1])].copy()
        odd = np.flatnonzero(results >= 0x80)
        of = np.searchsorted(offsets, odd, "right") - 1
        was = results[odd]
        results[odd] = made[k[of], place[was]]
        control = np.zeros(len(kept), bool)
        control[of[(was >= 0x80) & (was < 0xA0) & (was != 0x85) & (results[odd] != was)]] = True
        same = same.reshape(-1)
        gain = (self.scores_of(results, offsets) - start[w])[same]
        better = gain > 0
        return words[better], chain[better], gain[better], control[same][better]

    def learned(self, words: list[str], bytewise: bool = True) -> list[Undone]:
        """What UTF-8 chains or fillings make of each word, and what each byte chain would."""
        out: list[Undone] = []
        pairs = _byte_chains()[0]
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            codes, ends = _padded(part)
            start = self.scores_of(codes, ends)
            found = self.chained(part, start)
            if bytewise:
                for w, c, gain, control in zip(*(x.tolist() for x in self.bytewise(codes, ends, start))):
                    if LOST not in part[w]:
                        found[w].bytewise.append((pairs[c], gain, control))
            out += found
        return out

    def undone(self, word: str) -> Undone:
        """As learned; a verdict is looked up, or worked out and kept."""
        if self.verdicts and (got := self.verdicts.of(word)) is not None:
            return got
        if (got := self.seen.get(word)) is None:
            if len(self.seen) > KEPT:
                self.seen.clear()
            got = self.seen[word] = self.learned([word])[0]
        return got

    def suspects(self, texts: pa.Array) -> np.ndarray:
        """The texts that judge may find garbled; the others it doesn't: no word is enough alone and no byte chain gains
        EVIDENCE. New words are judged together."""
        row, code, names = odd_words(texts)
        alone, start, many = np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        at = self.verdicts.find(names) if self.verdicts else np.full(len(names), -1)
        pairs, gains = [np.empty(0, np.int64)], [np.empty(0)]
        if self.verdicts:
            v, known = self.verdicts, at >= 0
            alone[known], start[known], many[known] = v.alone[at[known]], v.first[at[known]], v.first[at[known] + 1] - v.first[at[known]]
            pairs, gains = [v.pairs], [v.gains]
        rest = np.flatnonzero(at < 0)
        listed = names.take(pa.array(rest)).to_pylist()
        new = [w for w in listed if w not in self.seen]
        if len(self.seen) + len(new) > KEPT:
            self.seen.clear()
            new = listed
        self.seen.update(zip(new, self.learned(new)))
        number, filled = _chain_numbers(), len(pairs[0])
        for i, w in zip(rest.tolist(), listed):
            u = self.seen[w]
            alone[i], start[i], many[i] = u.alone, filled, len(u.bytewise)
            if u.bytewise:
                filled += len(u.bytewise)
                pairs.append(np.array([number[p] for p, _, _ in u.bytewise]))
                gains.append(np.array([g for _, g, _ in u.bytewise]))
        pairs, gains = np.concatenate(pairs), np.concatenate(gains)
        found = np.bincount(row, alone[code], len(texts)) > 0
        each = many[code]
        entry = np.repeat(start[code] - np.cumsum(each) + each, each) + np.arange(each.sum())
        total = np.bincount(np.repeat(row, each) * len(number) + pairs[entry], gains[entry], len(texts) * len(number)).reshape(len(texts), -1)
        return np.flatnonzero(found | (total.max(1, initial=0) >= EVIDENCE - 1e-6))

    def judge(self, text: str) -> tuple[list[str], bool, dict[str, str]]:
        """(chains, whole, {word: word undone}): no chains if nothing is garbled, whole if nothing was lost.

        A byte chain turns characters into others that are possible too, so one word proves little: it must gain
        EVIDENCE over the different words of the record together (the margin, if a control character is among them, which
        no text has); only words vote that it serves better than the UTF-8 chains do. It is undone where it gains; the
        next chain, if any, is sought among the words that are left, and the other words keep their UTF-8 repairs.
        """
        words = {w: self.undone(w) for w in garbled_words(text)}
        fixes: dict[str, str] = {}
        chains: list[str] = []
        while True:
            votes: dict[str, dict[str, tuple[float, str, bool]]] = {}
            for w, u in words.items():
                for (read_as, written_in), gain, control in u.bytewise if w not in fixes else ():
                    if gain > u.gain:
                        votes.setdefault(f"{written_in} as {read_as}", {}).setdefault(w.strip(PUNCTUATION), (gain, w, control))
            best = max(votes, key=lambda c: (sum(g for g, _, _ in votes[c].values()), c), default=None)
            if best is None:
                break
            gain = sum(g for g, _, _ in votes[best].values())
            controls = any(c for _, _, c in votes[best].values())
            left = {w: u.gain for w, u in words.items() if w not in fixes}
            if gain <= sum({w.strip(PUNCTUATION): g for w, g in left.items()}.values()):  # words with UTF-8 repairs keep them
                gain, controls = sum(g for g, w, _ in votes[best].values() if not words[w].chains), False
                left = {w: g for w, g in left.items() if not words[w].chains}
            if not (gain >= EVIDENCE or gain >= self.margin and controls):
                break
            chains.append(best)
            fixes |= self.passages(text, best, left)
        for w, u in words.items():
            if u.chains and w not in fixes:
                fixes[w] = u.word
                chains += u.chains
        chains = list(dict.fromkeys(chains))
        return chains, "lost" not in chains, fixes

    def passages(self, text: str, chain: str, left: dict[str, float]) -> dict[str, str]:
        """{word: word undone} of the words that gain by a byte chain more than left says, and of those that stand only between such words and lose little."""
        written_in, _, read_as = chain.partition(" as ")
        undone = {w: v for w in left if (v := undo_bytes(w, read_as, written_in)) is not None and v != w and LOST not in w}
        gains = dict(zip(undone, (self.scores(list(undone.values())) - self.scores(list(undone))).tolist()))
        gaining = {w for w, g in gains.items() if g > left[w]}
        order = [w for w in re.split(r"[ \t\r\n]+", text) if not w.isascii()]
        inside = dict.fromkeys(order, True)
        for before, w, after in zip(["", *order], order, [*order[1:], ""]):
            inside[w] &= before in gaining and after in gaining
        return {w: v for w, v in undone.items() if w in gaining or inside[w] and left[w] <= 0 and gains[w] > -self.margin}


def _ngrams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of the trigrams, bigrams and characters of each text, each once per text; white space counts as one blank."""
    out = [([np.empty(0, np.int64)], [np.empty(0, np.int64)]) for _ in SLOTS]
    done = 0
    for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text", PART):
        listed = part.column(0).to_pylist()
        codes = _codes("".join(f" {t} " for t in listed))
        of = np.repeat(np.arange(len(listed)), [len(t) + 2 for t in listed])
        blank = (codes == 32) | (codes == 10) | (codes == 13) | (codes == 9)
        kept = np.append(True, ~(blank[1:] & blank[:-1] & (of[1:] == of[:-1])))
        codes, of = np.where(blank, np.uint32(32), codes)[kept], of[kept]
        for length, (rows, found), (slots, size) in zip((3, 2, 1), out, zip(_slots(_cases()[0][codes]), SLOTS)):
            m = max(len(of) - length + 1, 0)
            keys = distinct((of[:m] * size + slots)[of[:m] == of[length - 1 : length - 1 + m]])
            rows.append(done + keys // size)
            found.append(keys % size)
        done += len(listed)
    return [(np.concatenate(rows), np.concatenate(found)) for rows, found in out]


def _signless(texts: pa.Array, known: dict[str, bool]) -> np.ndarray:
    """looks_clean of each text, by its different words, as no sign reaches beyond a word."""
    row, code, names = odd_words(texts)
    listed = names.to_pylist()
    if len(known) > 10 * KEPT:
        known.clear()
    for w in listed:
        if w not in known:
            known[w] = bool(_SIGNS.search(w))
    return np.bincount(row, np.array([known[w] for w in listed], bool)[code], len(texts)) == 0


def _counted(texts: DataFrame, picked, clean=None) -> pa.Table:
    """(kind, slot, n, every): in how many clean texts and in how many of all each n-gram stands; kind 3 counts the texts.

    picked gives the texts of a batch that count, clean tells which of those are clean (all if there is none). What comes
    to the driver are tables of fixed size.
    """

    def count(batches):
        tables = [np.zeros((2, s), np.int64) for s in (*SLOTS, 1)]
        for batch in batches:
            for part in pieces(batch, "text"):
                chosen = picked(part.column("text"))
                dirty = ~clean(chosen) if clean else np.zeros(len(chosen), bool)
                for t, (row, slot) in zip(tables, [*_ngrams(chosen), (np.arange(len(chosen)), np.zeros(len(chosen), np.int64))]):
                    t[1] += np.bincount(slot, minlength=t.shape[1])
                    t[0] += np.bincount(slot[dirty[row]], minlength=t.shape[1])
        at = [np.flatnonzero(t[1]) for t in tables]
        every, less = (np.concatenate([t[k, a] for t, a in zip(tables, at)]) for k in (1, 0))
        cols = [np.repeat(np.arange(4, dtype=np.int32), [len(a) for a in at]), np.concatenate(at), every - less, every]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["kind", "slot", "n", "every"])

    return spread(texts).mapInArrow(count, "kind int, slot long, n long, every long").groupBy("kind", "slot").agg(F.sum("n").alias("n"), F.sum("every").alias("every")).toArrow()


def _table(*signed: tuple[pa.Table, str, int]) -> Model:
    """The models of the sums of (counts, column, sign)."""
    counts = [np.zeros(s, np.int64) for s in (*SLOTS, 1)]
    for rows, column, sign in signed:
        kind, slot, n = (rows.column(c).to_numpy() for c in ("kind", "slot", column))
        for k, c in enumerate(counts):
            c[slot[kind == k]] += sign * n[kind == k]
    return Model(*(np.minimum(c, 2**31 - 1).astype(np.int32) for c in counts[:3]), records=int(counts[3][0]))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word): the KNOWN words beyond ASCII that stand in the most batches. The choice matters for speed only."""

    def found(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                _, _, names = odd_words(part.column("text"))
                yield pa.RecordBatch.from_arrays([names], ["word"])

    counts = texts.mapInArrow(found, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return settled(counts.orderBy(F.desc("n"), "word").limit(KNOWN).select("word"))


def with_verdicts(model: Model, words: DataFrame, bytewise: bool = True) -> Model:
    """The model with the verdicts of some words, which are worked out on the cluster and are as many as KNOWN at most."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            listed = batch.column(0).to_pylist()
            rows = list(zip(*(Verdicts.row(w, u) for w, u in zip(listed, shared.value.learned(listed, bytewise)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows or [()] * 8, schema)], schema=schema)

    kinds = (pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.list_(pa.int16()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
    schema = pa.schema([(c.split()[0], k) for c, k in zip(_VERDICT.split(", "), kinds)])
    cores = words.sparkSession.sparkContext.defaultParallelism
    found = words.repartition(cores).mapInArrow(judge, _VERDICT).toArrow()
    shared.destroy()
    return Model(model.three, model.two, model.one, model.records, model.margin, verdicts=Verdicts(found))


def least_margin(records: int, over: list[int]) -> float:
    """The least of MARGINS that changes few more clean records than the largest does; over: how many gain more than each."""
    return next(m for m, n in zip(MARGINS, over) if n - over[-1] <= STRAY * records)


def trained(texts: DataFrame) -> Model:
    """The models, counted over all clean records of texts (a column text), and the margin validated on them.

    A text counts once, however many records hold it. The first models are counted over the texts that show no sign of
    garbling and judge all; the models that stay are counted over the texts that no chain of the first improves.
    What comes to the driver are tables of fixed size. The margin is validated on
    every text that the first models don't suspect (records that are garbled after all gain far more than any margin).
    """
    spark = texts.sparkSession
    different = settled(texts.where(F.col("text").isNotNull() & (F.length("text") > 0)).select("text").distinct())
    odd = spread(different.where(F.col("text").rlike(NOT_ASCII)))
    words = vocabulary(odd)
    signs: dict[str, bool] = {}
    counts = _counted(different, lambda texts: texts, lambda texts: _signless(texts, signs))
    first = spark.sparkContext.broadcast(with_verdicts(_table((counts, "n", 1)), words))

    def garbled(texts):
        suspects = texts.take(pa.array(first.value.suspects(texts)))
        return suspects.filter(pa.array([bool(first.value.judge(t)[0]) for t in suspects.to_pylist()], pa.bool_()))

    model = _table((counts, "every", 1), (_counted(odd, garbled), "every", -1))
    model.margin = 0.0
    strict = with_verdicts(model, words, bytewise=False)
    shared = spark.sparkContext.broadcast(strict)

    def gains(batches):
        strict, over = shared.value, np.zeros(len(MARGINS) + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text")
                row, code, names = odd_words(texts)
                at = strict.verdicts.find(names)
                gain = np.zeros(len(names))
                gain[at >= 0] = strict.verdicts.gain[at[at >= 0]]
                rest = np.flatnonzero(at < 0)
                gain[rest] = [u.gain for u in strict.learned(names.take(pa.array(rest)).to_pylist(), False)]
                top = np.zeros(len(texts))
                np.maximum.at(top, row, gain[code])
                ok = np.ones(len(texts), bool)
                ok[first.value.suspects(texts)] = False
                over += [ok.sum(), *((top[ok] > m).sum() for m in MARGINS)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in over], ["records", *(f"over{i}" for i in range(len(MARGINS)))])

    counted = odd.mapInArrow(gains, ", ".join(f"{c} long" for c in ["records", *(f"over{i}" for i in range(len(MARGINS)))]))
    records, *over = (n or 0 for n in counted.agg(*(F.sum(c) for c in counted.columns)).first())
    model.margin = least_margin(records, over)
    first.destroy()
    shared.destroy()
    return with_verdicts(model, words)


def repaired(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chains, whole, repaired): the records that are garbled, wholly or in part, each with its text undone.

    chains names what was undone; whole is false where characters were lost, then repaired holds the likeliest ones.
    Null, empty and pure ASCII texts are never garbled; repeated rows are judged each; other columns don't matter.
    """
    kind = dict(documents.dtypes)[key]
    texts = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    shared = documents.sparkSession.sparkContext.broadcast(trained(texts))

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                out, suspects = [], part.take(pa.array(model.suspects(part.column("text"))))
                for k, t in zip(suspects.column("key"), suspects.column("text").to_pylist()):
                    chains, whole, fixes = model.judge(t)
                    if chains:
                        out.append((k.as_py(), chains, whole, "".join(fixes.get(p, p) for p in re.split(r"([ \t\r\n]+)", t))))
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string())], [key, "chains", "whole", "repaired"])

    return texts.where(F.col("text").rlike(NOT_ASCII)).mapInArrow(run, f"`{key}` {kind}, chains array<string>, whole boolean, repaired string")


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return repaired(table(spark, data_dir, "documents")).select("doc_id").distinct()


def p8_repairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, chains, whole, repaired): the garbled documents with their texts as far as they can be had back."""
    return repaired(table(spark, data_dir, "documents")).withColumn("chains", F.array_join("chains", ", "))


QUERIES = {"p8_found": p8_found, "p8_repairs": p8_repairs}
SQL: dict[str, str] = {}
