"""Content tokens: lower case, without diacritics, split at what is no letter, number or mark, and stemmed by Porter's rules.

The rules are applied to distinct tokens only; `STEM_SQL` is the same in SQL, for checks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

TOKEN = r"[\p{L}\p{N}\p{M}]+"
_WORD = re.compile(r"\w+")

STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
for _rules in (STEP2, STEP3, STEP4):
    _rules.sort(key=lambda r: -len(r if isinstance(r, str) else r[0]))
#: All endings of a step: most words have none, and one look tells.
_ENDS2, _ENDS3, _ENDS4 = tuple(s for s, _ in STEP2), tuple(s for s, _ in STEP3), tuple(STEP4)


def fold(word: str) -> str:
    """Lower case without diacritics; letters like ß and œ stay."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


class _Kinds(dict):
    """By code point: V for vowels, C for other ASCII characters, K for the rest; y is looked at apart."""

    def __missing__(self, c: int) -> str:
        kind = self[c] = chr(c) if c == ord("y") else "V" if chr(c) in "aeiou" else "C" if c < 128 else "K"
        return kind


_KINDS = _Kinds()
_SYLLABLE = re.compile("V[CK]")


def _shape(word: str) -> str:
    """V for vowels (and y after a consonant), C for other ASCII characters, K for characters of several bytes: they count as
    several consonants."""
    out = word.translate(_KINDS)
    if "y" in out:
        for at in [i for i, c in enumerate(out) if c == "y"]:
            out = out[:at] + ("V" if out[:at].endswith(("C", "K")) else "C") + out[at + 1 :]
    return out


def _measure(stem: str) -> int:
    return len(_SYLLABLE.findall(_shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith(("CVC", "KVC")) and stem[-1] not in "wxy"


@lru_cache(1 << 18)
def porter(word: str) -> str:
    """The stem of a folded word of 3 to 64 bytes; others stay."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        n = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if n and "V" in _shape(w[:-n]):
            w = w[:-n]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "C" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, ends in ((STEP2, _ENDS2), (STEP3, _ENDS3)):
        for suffix, new in rules if w.endswith(ends) else ():
            if w.endswith(suffix):
                w = w[: -len(suffix)] + new if _measure(w[: -len(suffix)]) > 0 else w
                break
    for suffix in STEP4 if w.endswith(_ENDS4) else ():
        if w.endswith(suffix):
            n = 3 if suffix in ("sion", "tion") else len(suffix)
            w = w[:-n] if _measure(w[:-n]) > 1 else w
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems(text: str) -> list[str]:
    """The content tokens of a short text, such as a query's phrase."""
    return [porter(x) for w in _WORD.findall(re.sub(r"_", " ", text)) if (x := fold(w))]


def _sql_shape(w: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^\\x00-\\x7F]', 'K', 'g'), '[^VKy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        x = f"regexp_replace(regexp_replace({x}, '([CK])y', '\\1V', 'g'), 'Vy', 'VC', 'g')"
    return x


def _sql_rules(rules: list[tuple[str, str]], least: int) -> str:
    cases = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN len(regexp_extract_all(left(s, len(w) - {len(s) if s not in ('sion', 'tion') or least == 0 else 3}), 'V[CK]')) > {least} THEN left(w, len(w) - {len(s) if s not in ('sion', 'tion') or least == 0 else 3}) || '{new}' ELSE w END" for s, new in rules)
    return f"CASE WHEN NOT ok THEN w {cases} ELSE w END"


def stem_sql(words: str = "voc") -> str:
    """CTEs p0 to p8 and st(w, stem) over a table of distinct lower-case words w."""
    m = lambda cut: f"len(regexp_extract_all(left(s, len(w) - {cut}), 'V[CK]'))"
    has = lambda cut: f"contains(left(s, len(w) - {cut}), 'V')"
    o = lambda cut: f"(regexp_matches(left(s, len(w) - {cut}), '[CK]VC$') AND NOT regexp_matches(left(w, len(w) - {cut}), '[wxy]$'))"
    steps = [
        "CASE WHEN NOT ok THEN w WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, len(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, len(w) - 1) ELSE w END",
        f"CASE WHEN NOT ok THEN w WHEN ends_with(w, 'eed') THEN CASE WHEN {m(3)} > 0 THEN left(w, len(w) - 1) ELSE w END WHEN ends_with(w, 'ed') AND {has(2)} THEN left(w, len(w) - 2) || '+' WHEN ends_with(w, 'ing') AND {has(3)} THEN left(w, len(w) - 3) || '+' ELSE w END",
        # + marks what lost its ending
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN left(w, len(w) - 1) || 'e' WHEN len(w) > 2 AND w[-2] = w[-3] AND left(s, len(w) - 1)[-1] = 'C' AND w[-2] NOT IN ('l', 's', 'z') THEN left(w, len(w) - 2) WHEN {m(1)} = 1 AND {o(1)} THEN left(w, len(w) - 1) || 'e' ELSE left(w, len(w) - 1) END",
        f"CASE WHEN ok AND ends_with(w, 'y') AND {has(1)} THEN left(w, len(w) - 1) || 'i' ELSE w END",
        _sql_rules(STEP2, 0),
        _sql_rules(STEP3, 0),
        _sql_rules([(s, "") for s in STEP4], 1),
        f"CASE WHEN ok AND ends_with(w, 'e') AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {o(1)})) THEN left(w, len(w) - 1) ELSE w END",
        f"CASE WHEN ok AND ends_with(w, 'll') AND {m(1)} > 1 THEN left(w, len(w) - 1) ELSE w END",
    ]
    out = [f"p0 AS (SELECT w AS term, strip_accents(w) AS w, strlen(strip_accents(w)) BETWEEN 3 AND 64 AS ok FROM {words})"]
    for i, step in enumerate(steps):
        out.append(f"p{i + 1} AS (SELECT term, ok, {step} AS w FROM (SELECT *, {_sql_shape('w')} AS s FROM p{i}))")
    return ", ".join([*out, f"st AS (SELECT term, w AS stem FROM p{len(steps)})"])
