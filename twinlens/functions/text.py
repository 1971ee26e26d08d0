"""Text columns: look-alike letters, normal form, tokens, n-grams and set similarities."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Cyrillic letters and the Latin letters that look like them.
FOLD_CYRILLIC, FOLD_LATIN = "асеорхукмнвт", "aceopxykmhbt"
PAIR_LATIN, PAIR_CYRILLIC = "aceopxyABCEHKMOPTXY", "асеорхуАВСЕНКМОРТХУ"

#: Letters of one alphabet that have no look-alike in the other.
_ONLY_CYRILLIC = rf"(?![{PAIR_CYRILLIC}])[А-Яа-яЁё]"
_ONLY_LATIN = rf"(?![{PAIR_LATIN}])[A-Za-z]"
_TO_CYRILLIC, _TO_LATIN = str.maketrans(PAIR_LATIN, PAIR_CYRILLIC), str.maketrans(PAIR_CYRILLIC, PAIR_LATIN)
#: Words, which are found fastest, and the runs of letters in them; letter-like numbers count as letters, digits don't.
_WORD, _RUN = re.compile(r"(\w+)"), re.compile(r"[^\W\d_]+")


def blank_safe(c: Column) -> Column:
    """The column as text; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def replace_letters(c: Column, old: str, new: str) -> Column:
    """What ``translate`` gives, if no letter is both in ``old`` and ``new``. It searches bytes for a letter at a time, where ``translate`` looks each character up as a text."""
    if set(old) & set(new) or len(old) != len(new):
        raise ValueError("letters can't be replaced one after another")
    for a, b in zip(old, new, strict=True):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold_confusables(c: Column) -> Column:
    """Lower-case Cyrillic look-alikes as Latin letters."""
    return replace_letters(c, FOLD_CYRILLIC, FOLD_LATIN)


def _repaired(run: re.Match) -> str:
    cyrillic, latin = re.search(_ONLY_CYRILLIC, run[0]), re.search(_ONLY_LATIN, run[0])
    return run[0].translate(_TO_CYRILLIC if cyrillic else _TO_LATIN) if bool(cyrillic) != bool(latin) else run[0]


class _Repairs(dict):
    """Words with their runs repaired; the words of a language repeat, so most are found. Long words aren't kept, and no more than KEPT others."""

    KEPT, LONGEST = 1 << 18, 64

    def __missing__(self, word: str) -> str:
        repaired = _RUN.sub(_repaired, word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[word] = repaired
        return repaired


@F.arrow_udf(StringType())
def _repair(texts: pa.Array) -> pa.Array:
    """Runs of letters repaired; plain ASCII has nothing to repair. Arrays of runs are several times slower in Spark than this."""
    known, out = _Repairs(), []
    for t in texts.to_pylist():
        if t is not None and not t.isascii():
            parts = _WORD.split(t)
            parts[1::2] = [known[word] for word in parts[1::2]]
            t = "".join(parts)
        out.append(t)
    return pa.array(out, pa.string())


def restore_homoglyphs(c: Column) -> Column:
    """Repair each run of letters to the alphabet of its unambiguous letters; runs with both or none stay."""
    return _repair(blank_safe(c))


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility normal form, for which Spark has no function; most texts are in it already."""
    return pa.array([t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


#: Characters of which any sequence is in NFKC already: ASCII, Latin letters and Cyrillic without compatibility forms, common punctuation, CJK ideographs.
_NFKC_STABLE = r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u048a-\u052f\u2010\u2012-\u2016\u2018-\u2023\u2030-\u2032\u2039\u203a\u20ac\u20bd\u4e00-\u9fff"


def to_nfkc(c: Column) -> Column:
    """The column in NFKC; only texts that may not be in it already go through Python. The long class is matched against what isn't ASCII alone."""
    other = F.regexp_replace(c, r"[\x00-\x7f]+", "")
    return F.coalesce(nfkc(F.when(other.rlike(f"[^{_NFKC_STABLE}]"), c)), c)


def normalize(c: Column, *, fold: bool = True, stable: bool = False) -> Column:
    """NFKC (left out if the texts are ``stable``), lower case, look-alikes folded, everything but letters and digits as single spaces."""
    text = F.lower(blank_safe(c) if stable else to_nfkc(blank_safe(c)))
    return F.trim(F.regexp_replace(fold_confusables(text) if fold else text, r"[^\p{L}\p{N}]+", " "))


def vocabulary(df: DataFrame, text: str, mapped: Callable[[Column], Column]) -> DataFrame:
    """token, mapped and n: every run of letters and digits in ``text``, what ``mapped`` makes of it, and how often it occurs.

    ``mapped`` is evaluated once for each distinct token, not for each occurrence.
    """
    words = df.select(F.explode(F.regexp_extract_all(blank_safe(F.col(text)), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), 0)).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).select("token", mapped(F.col("token")).alias("mapped"), "n")


def tokens(norm: Column) -> Column:
    """Words of a normalised text; none for the empty one."""
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def token_set(norm: Column) -> Column:
    return F.array_distinct(tokens(norm))


def char_ngrams(norm: Column, n: int = 3) -> Column:
    """The set of a normalised text's n-grams; a shorter text is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - (n - 1), F.lit(1))), lambda i: F.substring(norm, i, F.lit(n)))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def digit_tokens(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike(r"^\p{Nd}+$"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def lcp_ratio(a: Column, b: Column) -> Column:
    """Common prefix over the longer length; 0 if either is empty."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(first == 0, 1.0).otherwise((first - 1) / longest)


#: Characters of a description that go into the encoder's text.
ENCODED = 128


def encoder_text(title: Column, description: Column, chars: int = ENCODED) -> Column:
    """"title. description", repaired after the description is cut, without outer white space."""
    both = F.concat(restore_homoglyphs(title), F.lit(". "), restore_homoglyphs(F.substring(blank_safe(description), 1, chars)))
    return F.regexp_replace(both, r"^\s+|\s+$", "")


@F.arrow_udf(StructType([StructField("ngram", DoubleType()), StructField("lcp", DoubleType())]))
def long_text_overlap(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
    """n-gram Jaccard and prefix ratio of long normalised texts: sets in Python are several times faster here than arrays of strings."""
    known: dict[str, set[str]] = {}

    def grams(t: str, size: int) -> set[str]:
        if t not in known:
            if len(known) >= 4096:
                known.clear()
            known[t] = {t[i : i + size] for i in range(len(t) - size + 1)} or ({t} if t else set())
        return known[t]

    ngram, lcp = [], []
    for x, y, size in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), strict=True):
        gx, gy = grams(x, size), grams(y, size)
        shared = len(gx & gy)
        ngram.append(shared / (len(gx) + len(gy) - shared) if gx or gy else 0.0)
        if not x or not y:
            lcp.append(0.0)
        elif x == y:
            lcp.append(1.0)
        else:
            least = min(len(x), len(y))
            lcp.append(next((i for i in range(least) if x[i] != y[i]), least) / max(len(x), len(y)))
    return pa.StructArray.from_arrays([pa.array(ngram, pa.float64()), pa.array(lcp, pa.float64())], ["ngram", "lcp"])


#: Characters of the texts whose sets :func:`whole_text_overlap` keeps; a text's n-grams take some hundred bytes for each.
KEPT_CHARS = 1 << 19
_COUNTS = ("shared", "base_words", "cand_words", "base_title", "cand_title")


def _prefix(x: str, y: str) -> int:
    """Characters that two texts have in common at their start, found by halves."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
    return low


@F.arrow_udf(StructType([StructField(k, DoubleType()) for k in ("ngram", "lcp")] + [StructField(k, LongType()) for k in _COUNTS]))
def whole_text_overlap(a: pa.Array, b: pa.Array, n: pa.Array, a_title: pa.Array, b_title: pa.Array) -> pa.Array:
    """What :func:`long_text_overlap` gives, words that normalised texts share and have, and how many words of each title are in the other's text.

    Sets are made here, so only the texts themselves are moved; neighbouring pairs share texts, whose sets are kept.
    """
    known: dict[str, tuple[set[str], set[str]]] = {}
    kept = 0

    def sets(t: str, size: int) -> tuple[set[str], set[str]]:
        nonlocal kept
        if t not in known:
            if kept + len(t) > KEPT_CHARS:
                known.clear()
                kept = 0
            known[t] = {t[i : i + size] for i in range(len(t) - size + 1)} or ({t} if t else set()), set(t.split(" ")) if t else set()
            kept += len(t)
        return known[t]

    out = []
    for x, y, size, tx, ty in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), a_title.to_pylist(), b_title.to_pylist(), strict=True):
        (gx, wx), (gy, wy) = sets(x, size), sets(y, size)
        shared = len(gx & gy)
        lcp = 0.0 if not x or not y else _prefix(x, y) / max(len(x), len(y))
        out.append((shared / (len(gx) + len(gy) - shared) if gx or gy else 0.0, lcp, len(wx & wy), len(wx), len(wy), sum(w in wy for w in tx), sum(w in wx for w in ty)))
    columns = list(zip(*out, strict=True)) or [()] * 7
    types = [pa.float64()] * 2 + [pa.int64()] * 5
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["ngram", "lcp", *_COUNTS])
