"""Full-text search: weighted vectors by language, queries, rank.

Stemmers follow the published Snowball algorithms for English and German.
Vectors are made once, at write time; matching and ranking are native.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionaries import ENGLISH_WORDS, GERMAN_WORDS
from .text import in_slices

#: Our choice: what a title's, a company's and a description's words count.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
_WORD = re.compile(r"[^\W_]+")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant behind a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


@lru_cache(maxsize=200_000)
def german_stem(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.lower().replace("ß", "ss")
    w = re.sub(f"(?<=[{vowels}])u(?=[{vowels}])", "U", w)
    w = re.sub(f"(?<=[{vowels}])y(?=[{vowels}])", "Y", w)
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    r1 = max(r1, 3)
    for end in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "s" or (at and w[at - 1] in "bdfghklmnrt")):
                w = w[:at]
                if end in ("e", "en", "es") and w.endswith("niss"):
                    w = w[:-1]
            break
    for end in ("est", "en", "er", "st"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "st" or (at >= 4 and w[at - 1] in "bdfghklmnt")):
                w = w[:at]
            break
    for end in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2:
                if end in ("end", "ung"):
                    w = w[:at]
                    if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                        w = w[:-2]
                elif end in ("ig", "ik", "isch"):
                    if at == 0 or w[at - 1] != "e":
                        w = w[:at]
                elif end in ("lich", "heit"):
                    w = w[:at]
                    if w[-2:] in ("er", "en") and len(w) - 2 >= r1:
                        w = w[:-2]
                else:
                    w = w[:at]
                    for more in ("lich", "ig"):
                        if w.endswith(more) and len(w) - len(more) >= r2:
                            w = w[: -len(more)]
                            break
            break
    return w.lower().translate(str.maketrans("äöü", "aou"))


_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _short(w: str, r1: int) -> bool:
    v = "aeiouy"
    ends = (len(w) > 2 and w[-1] not in v + "wxY" and w[-2] in v and w[-3] not in v) or (len(w) == 2 and w[0] in v and w[1] not in v)
    return ends and r1 >= len(w)


@lru_cache(maxsize=200_000)
def english_stem(word: str) -> str:
    v = "aeiouy"
    w = word.lower()
    if len(w) <= 2:
        return w
    w = ("Y" + w[1:] if w[0] == "y" else w)
    w = re.sub(f"(?<=[{v}])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, v)
    r2 = _region(w, v, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{v}]", w[:-2]):
        w = w[:-1]
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            at = len(w) - len(end)
            if end in ("eedly", "eed"):
                w = w[:at] + "ee" if at >= r1 else w
            elif re.search(f"[{v}]", w[:at]):
                w = w[:at]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    w = w[:-1]
                elif _short(w, min(r1, len(w)) if r1 <= len(w) else r1):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if at and w[at - 1] == "l" else w
                elif end == "li":
                    w = w[:at] if at and w[at - 1] in "cdeghkmnrt" else w
                else:
                    w = w[:at] + _STEP2[end]
            break
    for end in sorted(_STEP3, key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + _STEP3[end]
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or (at and w[at - 1] in "st")):
                w = w[:at]
            break
    if w.endswith("e"):
        stem = w[:-1]
        short = len(stem) > 2 and stem[-1] not in v + "wxY" and stem[-2] in v and stem[-3] not in v or len(stem) == 2 and stem[0] in v and stem[1] not in v
        if len(stem) >= r2 or (len(stem) >= r1 and not short):
            w = stem
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str, configuration: str) -> list[str]:
    """Stems of a text's words, without the configuration's stop words, in order; configuration simple has neither."""
    if configuration == "simple":
        return _WORD.findall(text.lower())
    stem, stop = (german_stem, set(GERMAN_WORDS)) if configuration == "german" else (english_stem, set(ENGLISH_WORDS))
    return [stem(w) for w in _WORD.findall(text.lower()) if w not in stop]


VECTOR = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("weight", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def search_vector(title: Column, company: Column, description: Column, configuration: Column) -> Column:
    """Sorted (lexeme, weight, positions) of title (A), company (B) and description (C); nulls count as empty."""

    def convert(*columns: list) -> pa.Array:
        names, weights, places = [], [], array("i")
        ends, rows = array("i", [0]), array("i", [0])
        for *parts, k in zip(*columns, strict=True):
            found: dict[tuple[str, str], list[int]] = {}
            at = 0
            for weight, part in zip("ABC", parts, strict=True):
                for lexeme in lexemes(part or "", k):
                    at += 1
                    found.setdefault((lexeme, weight), []).append(at)
            for (lexeme, weight), p in sorted(found.items()):
                names.append(lexeme)
                weights.append(weight)
                places.extend(p)
                ends.append(len(places))
            rows.append(len(names))
        ints = lambda x: pa.array(memoryview(x) if len(x) else [], pa.int32())
        each = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(weights, pa.string()), pa.ListArray.from_arrays(ints(ends), ints(places))], names=["lexeme", "weight", "positions"])
        return pa.ListArray.from_arrays(ints(rows), each)

    # as columns: a Python object for each lexeme of a batch would be several times its texts
    @F.arrow_udf(VECTOR)
    def run(a: pa.Array, b: pa.Array, c: pa.Array, conf: pa.Array) -> pa.Array:
        return in_slices(convert, a, b, c, conf)

    return run(title, company, description, configuration)


def parse_query(query: str, configuration: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives (or) of terms: (wanted, lexemes in a row). Quotes make phrases, a minus excludes."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and word.lower() == "or":
            groups.append([])
            continue
        if found := lexemes(quoted or word, configuration):
            groups[-1].append((not minus, found))
    return [g for g in groups if g]


def _has(vector: Column, row: list[str]) -> Column:
    at = lambda lexeme: F.flatten(F.transform(F.filter(vector, lambda x: x["lexeme"] == lexeme), lambda x: x["positions"]))
    places = at(row[0])
    back = lambda k: lambda p: p - k  # noqa: E731  a default argument would be taken for the index
    for k, lexeme in enumerate(row[1:], 1):
        places = F.array_intersect(places, F.transform(at(lexeme), back(k)))
    return F.size(places) > 0


def matches(vector: Column, query: str, configuration: str) -> Column:
    """Whether a vector fits a query of its own configuration. A query without words matches nothing."""
    out = F.lit(False)
    for group in parse_query(query, configuration):
        fits = F.lit(True)
        for wanted, row in group:
            fits = fits & (_has(vector, row) if wanted else ~_has(vector, row))
        out = out | fits
    return out


def rank(vector: Column, query: str, configuration: str) -> Column:
    """Sum over the query's lexemes of their weight times ln(1 + occurrences)."""
    wanted = sorted({x for g in parse_query(query, configuration) for yes, row in g if yes for x in row})
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    hits = F.filter(vector, lambda x: x["lexeme"].isin(wanted) if wanted else F.lit(False))
    return F.aggregate(hits, F.lit(0.0), lambda s, x: s + F.try_element_at(weight, x["weight"]) * F.log1p(F.size(x["positions"])))


def postings(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Inverted index: lexeme, key, weight, positions. A query reads its lexemes only, if stored sorted by lexeme."""
    return rows.select(key, F.explode(vector).alias("x")).select("x.lexeme", key, "x.weight", "x.positions")
