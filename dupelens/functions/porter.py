"""Porter's stemming algorithm (1980) with its author's two later changes (bli, logi), applied to distinct words."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Words whose stems a worker remembers.
REMEMBERED = 500_000

# The suffix tables of the published algorithm, with bli for abli, and logi.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


class _Letters(dict):
    def __missing__(self, letter: int) -> str:
        return "c"


_LETTERS = _Letters({ord(x): "v" for x in "aeiou"})


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    if "y" not in word:
        return word.translate(_LETTERS)
    shape = ""
    for k, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and k > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return _shape(stem).count("vc")


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(tuple(suffixes)) else None


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (s := _longest(word, table)) and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    if (s := _longest(word, STEP_4)) and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@functools.lru_cache(maxsize=REMEMBERED)
def _remembered(word: str) -> str:
    return stem(word)


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.arrow_udf(ArrayType(StringType()))
def _array_stems(tokens: pa.Array) -> pa.Array:
    flat = tokens.flatten().dictionary_encode()
    stems = pa.array([None if w is None else _remembered(w) for w in flat.dictionary.to_pylist()], pa.string())
    sizes = [0]
    for x in tokens:
        sizes.append(sizes[-1] + (len(x) if x.is_valid else 0))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), stems.take(flat.indices), mask=tokens.is_null())


@F.arrow_udf(ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))
def _array_counts(tokens: pa.Array) -> pa.Array:
    flat = tokens.flatten().dictionary_encode()
    sizes = np.array([len(x) if x.is_valid else 0 for x in tokens], np.int64)
    width = max(len(flat.dictionary), 1)
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    ends = np.concatenate(([0], np.cumsum(np.bincount(keys // width, minlength=len(sizes)))))
    pairs = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(keys % width)), pa.array(counts, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=tokens.is_null())


def term_counts(tokens: Column) -> Column:
    """The distinct tokens of an array with their counts, as (term, tf): counted where the document is, not shuffled by term."""
    return _array_counts(tokens)


def stemmed(tokens: Column) -> Column:
    """The tokens of an array as stems. A batch's distinct words are stemmed once, and workers remember stems; nothing is shuffled."""
    return _array_stems(tokens)


def with_stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """The rows of `terms` with the column replaced by stems; each distinct word is stemmed once and joined back."""
    table = terms.select(F.col(term).alias("_word")).distinct().withColumn("_stem", _stems("_word"))
    return terms.join(table, terms[term] == table["_word"], "left").drop("_word").withColumn(term, F.col("_stem")).drop("_stem")
