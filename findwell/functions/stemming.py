"""Porter's suffix stripping as SQL expressions that Spark and DuckDB both read.

M. F. Porter, An algorithm for suffix stripping, 1980, with the usual extensions:
words of up to two letters stay, a short list of irregular words, and the endings
bli, fulli and logi. A step is an expression over the column `w`; a leading y is
upper-case while the steps run, since it is a consonant there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Irregular words and their stems.
IRREGULAR = {
    "skies": "sky",
    "sky": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}
# Endings and what replaces them, in the order of trial.
STEP_2 = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "fulli": "ful",
    "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_OVER_0 = f"^({_C})?{_V}{_C}"
M_OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
M_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL = "[aeiouy]"
ENDS_CONSONANT = f"^({_C})?({_V}{_C})*$"
SHORT_END = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"


def steps(match: str) -> list[str]:
    """The expressions; `match` is the engine's function for a regular expression found in a string."""

    def has(text: str, pattern: str) -> str:
        return f"{match}({text}, '{pattern}')"

    def stem(n: int) -> str:
        return f"substr(w, 1, length(w) - {n})" if n else "w"

    def ends(suffix: str) -> str:
        return f"w LIKE '%{suffix}'"

    def cases(rules: list[tuple[str, str, str]]) -> str:
        """The first ending that fits decides; where its condition fails the word stays."""
        parts = [f"WHEN {ends(s)} THEN CASE WHEN {c} THEN concat({stem(len(s))}, '{r}') ELSE w END" for s, r, c in rules]
        return "CASE WHEN length(w) <= 2 THEN w " + " ".join(parts) + " ELSE w END"

    def positive(n: int) -> str:
        return has(stem(n), M_OVER_0)

    step_1a = f"CASE WHEN length(w) <= 2 THEN w WHEN {ends('ies')} THEN CASE WHEN length(w) = 4 THEN concat({stem(3)}, 'ie') ELSE concat({stem(3)}, 'i') END WHEN {ends('sses')} THEN {stem(2)} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {stem(1)} ELSE w END"
    # a word whose -ed or -ing goes is marked with a dot for the repairs
    step_1b = (
        f"CASE WHEN length(w) <= 2 THEN w WHEN {ends('ied')} THEN CASE WHEN length(w) = 4 THEN concat({stem(3)}, 'ie') ELSE concat({stem(3)}, 'i') END "
        f"WHEN {ends('eed')} THEN CASE WHEN {positive(3)} THEN {stem(1)} ELSE w END "
        f"WHEN {ends('ed')} AND {has(stem(2), HAS_VOWEL)} THEN concat({stem(2)}, '.') "
        f"WHEN {ends('ing')} AND {has(stem(3), HAS_VOWEL)} THEN concat({stem(3)}, '.') ELSE w END"
    )
    bare = "substr(w, 1, length(w) - 1)"
    last, before = "substr(w, length(w) - 1, 1)", "substr(w, length(w) - 2, 1)"
    repair = (
        f"CASE WHEN w NOT LIKE '%.' THEN w WHEN w LIKE '%at.' OR w LIKE '%bl.' OR w LIKE '%iz.' THEN concat({bare}, 'e') "
        f"WHEN length(w) >= 3 AND {last} = {before} AND {has(bare, ENDS_CONSONANT)} THEN CASE WHEN {last} IN ('l', 's', 'z') THEN {bare} ELSE substr(w, 1, length(w) - 2) END "
        f"WHEN {has(bare, SHORT_END)} THEN concat({bare}, 'e') ELSE {bare} END"
    )
    step_1c = f"CASE WHEN {ends('y')} AND length(w) > 2 AND {has(stem(1), ENDS_CONSONANT)} THEN concat({stem(1)}, 'i') ELSE w END"
    # -alli becomes -al first and is then tried again
    step_2a = f"CASE WHEN {ends('alli')} AND {positive(4)} THEN {stem(2)} ELSE w END"
    step_2 = cases([(s, r, has(stem(3), M_OVER_0) if s == "logi" else positive(len(s))) for s, r in STEP_2.items()])
    step_3 = cases([(s, r, positive(len(s))) for s, r in STEP_3.items()])
    step_4 = cases([(s, "", has(stem(len(s)), M_OVER_1) + (f" AND {has(stem(len(s)), '[st]$')}" if s == "ion" else "")) for s in STEP_4])
    step_5a = f"CASE WHEN length(w) > 2 AND {ends('e')} THEN CASE WHEN {has(stem(1), M_OVER_1)} THEN {stem(1)} WHEN {has(stem(1), M_IS_1)} AND NOT {has(stem(1), SHORT_END)} THEN {stem(1)} ELSE w END ELSE w END"
    step_5b = f"CASE WHEN {ends('ll')} AND {has(stem(1), M_OVER_1)} THEN {stem(1)} ELSE w END"
    return [step_1a, step_1b, repair, step_1c, step_2a, step_2, step_3, step_4, step_5a, step_5b]


def _irregular(word: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {word} = '{a}' THEN '{b}'" for a, b in IRREGULAR.items()) + f" WHEN length({word}) <= 2 THEN {word} ELSE {other} END"


def with_stem(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """Adds the stem of a column of lower-case words. Null stays null."""
    out = words.withColumn("w", F.expr(f"CASE WHEN {word} LIKE 'y%' THEN concat('Y', substr({word}, 2)) ELSE {word} END"))
    for step in steps("regexp_like"):
        out = out.withColumn("w", F.expr(step))
    return out.withColumn(stem, F.expr(_irregular(f"`{word}`", "lower(w)"))).drop("w")


def stem_ctes(source: str, word: str = "word", name: str = "stems") -> str:
    """DuckDB common table expressions that end in `name` (word, stem) of the distinct words of `source`."""
    parts = [f"{name}_0 AS (SELECT DISTINCT {word} AS word, CASE WHEN {word} LIKE 'y%' THEN concat('Y', substr({word}, 2)) ELSE {word} END AS w FROM {source})"]
    all_steps = steps("regexp_matches")
    parts += [f"{name}_{k} AS (SELECT word, {step} AS w FROM {name}_{k - 1})" for k, step in enumerate(all_steps, 1)]
    parts.append(f"{name} AS (SELECT word, {_irregular('word', 'lower(w)')} AS stem FROM {name}_{len(all_steps)})")
    return ",\n".join(parts)


def stem(word: str) -> str:
    """The stem of one word, in Python, step by step as above; for queries on the driver."""
    import re

    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    if w[0] == "y":
        w = "Y" + w[1:]

    def over(s: str, pattern: str) -> bool:
        return re.search(pattern, s) is not None

    def apply(w: str, rules: dict[str, str], test) -> str:
        for suffix, new in rules.items():
            if w.endswith(suffix):
                return w[: -len(suffix)] + new if test(w, suffix) else w
        return w

    if w.endswith("ies"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if len(w) > 2:
        if w.endswith("ied"):
            w = w[:-3] + ("ie" if len(w) == 4 else "i")
        elif w.endswith("eed"):
            w = w[:-1] if over(w[:-3], M_OVER_0) else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and over(w[: -len(suffix)], HAS_VOWEL):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) >= 2 and w[-1] == w[-2] and over(w, ENDS_CONSONANT):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif over(w, SHORT_END):
                        w += "e"
                    break
    if w.endswith("y") and len(w) > 2 and over(w[:-1], ENDS_CONSONANT):
        w = w[:-1] + "i"
    if w.endswith("alli") and over(w[:-4], M_OVER_0):
        w = w[:-2]

    def positive(w: str, s: str) -> bool:
        return over(w[:-3] if s == "logi" else w[: -len(s)], M_OVER_0)

    if len(w) > 2:
        w = apply(w, STEP_2, positive)
    if len(w) > 2:
        w = apply(w, STEP_3, positive)
    if len(w) > 2:
        w = apply(w, dict.fromkeys(STEP_4, ""), lambda w, s: over(w[: -len(s)], M_OVER_1) and (s != "ion" or w[:-3][-1:] in ("s", "t")))
    if len(w) > 2 and w.endswith("e") and (over(w[:-1], M_OVER_1) or over(w[:-1], M_IS_1) and not over(w[:-1], SHORT_END)):
        w = w[:-1]
    if w.endswith("ll") and over(w[:-1], M_OVER_1):
        w = w[:-1]
    return w.lower()
