"""Porter's algorithm as SQL over a list of words, for holding the stemmed queries against DuckDB.

Written from the algorithm's description, step by step as common table expressions; it shares nothing with the stemmer
of `functions.text`. A `y` that is a consonant is set in upper case first, so each condition is one regular expression:
what stands before an ending never changes its kind when the ending goes.
"""

from __future__ import annotations

_V, _C = "[aeiouy]", "[^aeiouy]"
_SOME = f"^{_C}*{_V}+{_C}"  # m > 0
_MORE = f"^{_C}*{_V}+{_C}+{_V}+{_C}"  # m > 1
_ONE = f"^{_C}*{_V}+{_C}+{_V}*$"  # m = 1
_CVC = f"{_C}{_V}[^aeiouywxY]$"

_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _replaced(x: str, rules: str) -> str:
    """The first rule whose ending the word has, longer endings first among those that end alike, if m > 0 before it."""
    pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
    return "CASE " + " ".join(f"WHEN suffix({x}, '{a}') THEN CASE WHEN {_is(_cut(x, len(a)), _SOME)} THEN {_cut(x, len(a))} || '{b}' ELSE {x} END" for a, b in pairs) + f" ELSE {x} END"


def _dropped(x: str) -> str:
    cases = [f"WHEN suffix({x}, '{a}') THEN CASE WHEN {_is(_cut(x, len(a)), _MORE)} THEN {_cut(x, len(a))} ELSE {x} END" for a in sorted(_STEP4.split(), key=lambda a: -len(a))]
    ion = f"WHEN suffix({x}, 'sion') OR suffix({x}, 'tion') THEN CASE WHEN {_is(_cut(x, 3), _MORE)} THEN {_cut(x, 3)} ELSE {x} END"
    return "CASE " + " ".join([ion, *cases]) + f" ELSE {x} END"


def stems(words: str) -> str:
    """Expressions for a WITH clause that end in the table `stems` (word, stem); words: a table with a column word."""
    ing = f"(suffix(s, 'ed') AND {_is(_cut('s', 2), _V)}) OR (suffix(s, 'ing') AND {_is(_cut('s', 3), _V)})"
    steps = [
        "CASE WHEN suffix(s, 'sses') OR suffix(s, 'ies') THEN left(s, length(s) - 2) WHEN suffix(s, 's') AND NOT suffix(s, 'ss') THEN left(s, length(s) - 1) ELSE s END",
        f"CASE WHEN suffix(s, 'eed') THEN CASE WHEN {_is(_cut('s', 3), _SOME)} THEN {_cut('s', 1)} ELSE s END WHEN {ing} THEN '<' || CASE WHEN suffix(s, 'ed') THEN {_cut('s', 2)} ELSE {_cut('s', 3)} END ELSE s END",
        f"""CASE WHEN left(s, 1) <> '<' THEN s ELSE (SELECT CASE WHEN suffix(b, 'at') OR suffix(b, 'bl') OR suffix(b, 'iz') THEN b || 'e'
          WHEN length(b) > 1 AND lower(right(b, 1)) = lower(substr(b, length(b) - 1, 1)) AND {_is('b', _C + '$')} THEN CASE WHEN {_is('b', '[lsz]$')} THEN b ELSE {_cut('b', 1)} END
          WHEN {_is('b', _ONE)} AND {_is('b', _CVC)} THEN b || 'e' ELSE b END FROM (SELECT substr(s, 2) AS b)) END""",
        f"CASE WHEN {_is('s', '[yY]$')} AND {_is(_cut('s', 1), _V)} THEN {_cut('s', 1)} || 'i' ELSE s END",
        _replaced("s", _STEP2),
        _replaced("s", _STEP3),
        _dropped("s"),
        f"CASE WHEN suffix(s, 'e') AND ({_is('s', _MORE)} OR ({_is('s', _ONE)} AND NOT {_is(_cut('s', 1), _CVC)})) THEN {_cut('s', 1)} ELSE s END",
        f"CASE WHEN suffix(s, 'll') AND {_is('s', _MORE)} THEN {_cut('s', 1)} ELSE s END",
    ]
    first = f"regexp_replace(regexp_replace(word, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    out = [f"p0 AS (SELECT word, {first} AS s FROM {words} WHERE length(word) > 2)"]
    out += [f"p{k} AS (SELECT word, {x} AS s FROM p{k - 1})" for k, x in enumerate(steps, 1)]
    out.append(f"stems AS (SELECT word, replace(s, 'Y', 'y') AS stem FROM p{len(steps)} UNION ALL SELECT word, word FROM {words} WHERE length(word) <= 2)")
    return ",\n".join(out)
