"""String similarity kernels that Spark lacks, as Arrow-batched functions of distinct pairs."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel_ratio(one, two)
    return max(best, indel_ratio(both, one), indel_ratio(both, two)) if both else best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [b[j] for j in range(len(b)) if taken[j]]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro)


def most_jaro_winkler(a: str, b: str) -> float:
    """No less than ``jaro_winkler``: all characters in common match, in order."""
    if a == b:
        return 1.0
    m = sum(min(a.count(ch), b.count(ch)) for ch in set(a))
    if not m:
        return 0.0
    jaro = (m / len(a) + m / len(b) + 1) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro) + 1e-9


def hard_kinds(a: str, b: str, x: str, y: str, number: bool, conflict: bool, words: float) -> int:
    """Bits of the kinds of a pair of names and addresses; the similarities are only worked out where a bound of theirs leaves a kind open."""
    order = lambda: token_sort_ratio(x, y) if x and y else 0.0
    top = most_jaro_winkler(a, b)
    trap, near, clash = number and (words >= 0.7 or order() >= 0.85), top >= 0.9, conflict and words >= 0.3 and top >= 0.85
    if (trap and top > 0.7) or near or clash:
        top = jaro_winkler(a, b)
    return (trap and top <= 0.7) + 2 * (near and top >= 0.9 and (words >= 0.4 or order() >= 0.7)) + 4 * (clash and top >= 0.85)


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


INDIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
SIGNS = {"ANUSVARA": "n", "CANDRABINDU": "n", "VISARGA": "h"}


@functools.cache
def _roman(ch: str) -> str:
    """Latin spelling of a character, by the name that Unicode gives it: a consonant loses the vowel of its name."""
    script, _, rest = unicodedata.name(ch, "").partition(" ")
    if script not in INDIC:
        return ch
    kind, last = rest.rpartition(" ")[0], rest.rpartition(" ")[2].lower()
    if rest.startswith("DIGIT"):
        return str(unicodedata.digit(ch))
    if "VOWEL SIGN" in kind or (kind.startswith("LETTER") and not set(last) - set("aeiou")):
        return last
    return last.removesuffix("a") if kind.startswith("LETTER") else SIGNS.get(last.upper(), "")


def romanize(text: str) -> str:
    """Indic scripts in Latin letters; every other character stays."""
    return "".join(map(_roman, text))


def _vectorised(f):
    @pandas_udf(DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return udf


token_sort_udf, token_set_udf, jaro_winkler_udf, ratio_udf = map(_vectorised, (token_sort_ratio, token_set_ratio, jaro_winkler, indel_ratio))


@pandas_udf(IntegerType())
def hard_kinds_udf(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series, number: pd.Series, conflict: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([hard_kinds(*row) for row in zip(a, b, x, y, number, conflict, words, strict=True)], dtype="int32")


@pandas_udf(StringType())
def strip_accents_udf(c: pd.Series) -> pd.Series:
    return c.map(lambda t: strip_accents(t) if t is not None else None)


@pandas_udf(StringType())
def romanize_udf(c: pd.Series) -> pd.Series:
    return c.map(lambda t: romanize(t) if t is not None else None)
