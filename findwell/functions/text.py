"""Text functions: words, stop words, url depth, tag weights."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from findwell.functions.stemming import stem

SEPARATOR = "[^a-zA-Z0-9]+"
LOWER_SEPARATOR = "[^a-z0-9]+"
URL_PATH = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"

# Words left out of queries.
STOP_WORDS = (
    "a able about across after all almost also am among an and any are as at be because been "
    "but by can cannot could dear did do does either else ever every for from get got had has "
    "have he her hers him his how however i if in into is it its just least let like likely "
    "may me might most must my neither no nor not of off often on only or other our own rather "
    "said say says she should since so some than that the their them then there these they "
    "this tis to too twas us wants was we were what when where which while who whom why will "
    "with would yet you your"
).split()


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order. Only A-Z are lowered, as that may turn other letters into ASCII ones."""
    return F.array_remove(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), LOWER_SEPARATOR), "")


def split_words(text: str) -> list[str]:
    return [w.lower() for w in re.split(SEPARATOR, text or "") if w]


def path_parts(url: Column) -> Column:
    """Components of a url's path between slashes: 1 without a path, 2 for /."""
    return F.size(F.split(F.regexp_extract(url, URL_PATH, 1), "/")).cast("bigint")


def depth_score(parts: Column, weight: float) -> Column:
    return F.lit(weight) / parts


def tag_score(tags: Column, weights: dict[str, float], weight: float) -> Column:
    """weight * (1 + the weights of the distinct tags)."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    total = F.aggregate(tags, F.lit(1.0), lambda acc, t: acc + F.coalesce(F.try_element_at(table, t), F.lit(0.0)))
    return F.lit(weight) * total


def stop_stems() -> set[str]:
    return {stem(w) for w in STOP_WORDS}


def prepare_query(text: str, stemmed: bool = True) -> tuple[list[str], int]:
    """(distinct terms in order, tolerance): stop words go unless all are; the tolerance is their number + 1."""
    terms = [stem(w) if stemmed else w for w in split_words(text)]
    stops = stop_stems() if stemmed else set(STOP_WORDS)
    kept = [t for t in terms if t not in stops]
    if not kept:
        kept = terms
    return list(dict.fromkeys(kept)), len(terms) - len(kept) + 1
