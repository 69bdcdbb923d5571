"""From text to (term, position): lower case, accent folding, words, stop words, stems; one configuration for both sides."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexshard.functions import porter
from lexshard.functions.text import tokens, words_of

# The English stop words of the original pipeline. Those with an apostrophe never equal a word.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below between
    both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from
    further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his
    how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor
    not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should
    shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd
    they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were
    weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you
    you'd you'll you're you've your yours yourself yourselves
    """.split()
)


@dataclass(frozen=True)
class Analyzer:
    """Which stages run. Positions are those of the raw words, so gaps left by stop words stay visible in documents."""

    remove_stopwords: bool = True
    do_stem: bool = True
    do_fold_accents: bool = True

    def occurrences(self, text: Column) -> Column:
        """array<struct<term, pos>> of a text, before stemming; stays inside the JVM."""
        words = F.transform(tokens(text, self.do_fold_accents), lambda w, i: F.struct(w.alias("term"), i.cast("int").alias("pos")))
        return F.filter(words, lambda w: ~w.term.isin(*STOPWORDS)) if self.remove_stopwords else words

    def terms_of(self, occurrences: Column) -> Column:
        terms = occurrences.getField("term")
        return porter.stemmed(terms) if self.do_stem else terms

    def analyze(self, text: str | None) -> list[tuple[str, int]]:
        """The same on the driver, for queries."""
        kept = [(w, i) for i, w in enumerate(words_of(text, self.do_fold_accents)) if not self.remove_stopwords or w not in STOPWORDS]
        return [(porter.stem(w) if self.do_stem else w, i) for w, i in kept]

    def terms(self, text: str | None) -> list[str]:
        return [t for t, _ in self.analyze(text)]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Analyzer:
        return cls(**json.loads(text))


RAW = Analyzer(False, False, False)
FOLDED = Analyzer(False, False, True)
UNSTEMMED = Analyzer(True, False, True)
DEFAULT = Analyzer()
