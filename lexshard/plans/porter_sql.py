"""The Porter stemmer in regular expressions of SQL: an independent statement of lexshard.functions.porter."""

from __future__ import annotations

from lexshard.functions.porter import STEP2, STEP3, STEP4

# A leading y is a consonant: it is written Y meanwhile. Any other y is a consonant after a vowel.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _m(x: str, least: int) -> str:
    return f"regexp_matches({x}, '^({_C})?{_V}{_C}{f'{_V}{_C}' if least > 1 else ''}')"


def _m_is_1(x: str) -> str:
    return f"regexp_matches({x}, '^({_C})?{_V}{_C}({_V})?$')"


def _vowel(x: str) -> str:
    return f"regexp_matches({x}, '[aeiouy]')"


def _short(x: str) -> str:
    return f"regexp_matches({x}, '([^aeiouy]|[aeiou]y)[aeiouy][^aeiouwxy]$')"


def _double(x: str) -> str:
    return f"(len({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND regexp_matches({x}, '[^aeiou]$'))"


def _less(x: str, n: int) -> str:
    return f"left({x}, len({x}) - {n})"


def _suffixes(rules: dict[str, str], condition) -> str:
    cases = "".join(
        f" WHEN w LIKE '%{s}' THEN CASE WHEN {condition(s)} THEN {_less('w', len(s))} || '{rules[s]}' ELSE w END" for s in sorted(rules, key=lambda s: -len(s))
    )
    return f"CASE{cases} ELSE w END"


def porter_sql(source: str) -> str:
    """CTEs that end in vocab (tok, term), from a relation with a column tok of distinct words."""
    participle = f"""CASE WHEN w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' AND {_vowel(_less('w', 2))} THEN {_less('w', 2)}
        WHEN w LIKE '%ing' AND {_vowel(_less('w', 3))} THEN {_less('w', 3)} END"""
    mended = f"""CASE WHEN w LIKE '%eed' THEN CASE WHEN {_m(_less('w', 3), 1)} THEN {_less('w', 1)} ELSE w END WHEN r IS NULL THEN w
        WHEN r LIKE '%at' OR r LIKE '%bl' OR r LIKE '%iz' THEN r || 'e'
        WHEN {_double('r')} THEN CASE WHEN regexp_matches(r, '[lsz]$') THEN r ELSE {_less('r', 1)} END
        WHEN {_m_is_1('r')} AND {_short('r')} THEN r || 'e' ELSE r END"""
    final = f"""CASE WHEN w LIKE '%e' AND ({_m('w', 2)} OR {_m_is_1('w')} AND NOT {_short(_less('w', 1))}) THEN {_less('w', 1)}
        WHEN w LIKE '%ll' AND {_m('w', 2)} THEN {_less('w', 1)} ELSE w END"""
    step4 = _suffixes(dict.fromkeys(STEP4, ""), lambda s: _m(_less("w", len(s)), 2) + (" AND regexp_matches(" + _less("w", 3) + ", '[st]$')" if s == "ion" else ""))
    step = lambda rules: _suffixes(rules, lambda s: _m(_less("w", len(s)), 1))
    return f"""
    v0 AS (SELECT tok, regexp_replace(tok, '^y', 'Y') AS w FROM {source}),
    v1 AS (SELECT tok, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_less('w', 2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_less('w', 1)} ELSE w END AS w FROM v0),
    v2 AS (SELECT tok, w, {participle} AS r FROM v1),
    v3 AS (SELECT tok, {mended} AS w FROM v2),
    v4 AS (SELECT tok, CASE WHEN w LIKE '%y' AND {_vowel(_less('w', 1))} THEN {_less('w', 1)} || 'i' ELSE w END AS w FROM v3),
    v5 AS (SELECT tok, {step(STEP2)} AS w FROM v4),
    v6 AS (SELECT tok, {step(STEP3)} AS w FROM v5),
    v7 AS (SELECT tok, {step4} AS w FROM v6),
    v8 AS (SELECT tok, {final} AS w FROM v7),
    vocab AS (SELECT tok, CASE WHEN len(tok) <= 2 THEN tok ELSE replace(w, 'Y', 'y') END AS term FROM v8)"""
