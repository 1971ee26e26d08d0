"""JSON, price, count, flag, category and photo attributes of a pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_safe

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    """The column as a double; what isn't a plain number is null."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def clean_price(c: Column) -> Column:
    """Positive prices; null otherwise."""
    value = number(c)
    return F.when(value > 0, value)


def parse_params(c: Column) -> Column:
    """A JSON object as a map of canonical value texts; empty for anything else.

    Repeated keys make the object invalid, and true isn't 1; numbers that are equal as 1 and 1.0 are one text.
    """
    values = F.try_variant_get(F.try_parse_json(c.cast("string")), "$", "map<string,variant>")
    texts = F.transform_values(values, lambda _, v: F.regexp_replace(F.coalesce(F.to_json(v), F.lit("null")), r"^(-?\d+)\.0$", "$1"))
    return F.coalesce(texts, F.create_map().cast("map<string,string>"))


def params_block(b: Column, c: Column) -> dict[str, Column]:
    """Features of two maps from :func:`parse_params`."""
    kb, kc = F.map_keys(b), F.map_keys(c)
    common = F.array_intersect(kb, kc)
    n = F.size(common)
    either = (F.size(b) == 0) | (F.size(c) == 0)
    equal = F.size(F.filter(common, lambda k: b[k] == c[k]))
    return {
        "params_n_common_keys": F.when(either, 0).otherwise(n),
        "params_key_jaccard": F.when(either, 0.0).otherwise(n / F.greatest(F.size(b) + F.size(c) - n, F.lit(1))),
        "params_value_match_ratio": F.when(either | (n == 0), -1.0).otherwise(equal / F.greatest(n, F.lit(1))),
        "params_n_base": F.size(b),
        "params_n_cand": F.size(c),
    }


def price_block(base: Column, cand: Column) -> dict[str, Column]:
    b, c = clean_price(base), clean_price(cand)
    both = b.isNotNull() & c.isNotNull()
    lo, hi = F.when(both, F.least(b, c)), F.when(both, F.greatest(b, c))
    return {
        "price_ratio": lo / hi,
        "price_log_diff": F.abs(F.log1p(b) - F.log1p(c)),
        "price_abs_diff": F.abs(b - c),
        "price_min": lo,
        "price_max": hi,
        "price_missing": (~both).cast("int"),
    }


def images_block(base: Column, cand: Column) -> dict[str, Column]:
    b, c = F.coalesce(number(base), F.lit(0.0)), F.coalesce(number(cand), F.lit(0.0))
    return {"images_abs_diff": F.abs(b - c), "images_min": F.least(b, c), "images_max": F.greatest(b, c), "images_equal": (b == c).cast("int")}


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False)).cast("int")


def category_block(name: str, base: Column, cand: Column) -> dict[str, Column]:
    b, c = blank_safe(base), blank_safe(cand)
    return {f"same_{name}": (b == c).cast("int"), f"{name}_missing": ((b == "") | (c == "")).cast("int")}


def title_image_block(base: Column, cand: Column) -> dict[str, Column]:
    b, c = blank_safe(base), blank_safe(cand)
    return {"title_image_both_present": ((b != "") & (c != "")).cast("int"), "title_image_equal": (b == c).cast("int")}


def side_numbers(price: Column, images: Column, title: Column, description: Column | None = None, *, chars: Column | None = None) -> Column:
    """log1p price, price known, images, log1p of the raw text lengths, as an array; fails on non-finite values. ``chars`` is the length of a description that isn't at hand."""
    p = clean_price(price)
    described = F.length(blank_safe(description)) if chars is None else F.coalesce(chars, F.lit(0))
    values = F.array(
        F.log1p(F.coalesce(p, F.lit(0.0))), p.isNotNull().cast("double"), F.coalesce(number(images), F.lit(0.0)), F.log1p(F.length(blank_safe(title)).cast("double")), F.log1p(described.cast("double"))
    )
    finite = F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, values).otherwise(F.raise_error(F.lit("a side's numbers are not finite")).cast("array<double>"))


def nested_keys(category: Column, subcategory: Column, param1: Column, param2: Column) -> dict[str, Column]:
    """Keys of buckets from wide to narrow; lengths keep parts apart."""
    parts, out = [], {}
    for name, c in (("category", category), ("subcategory", subcategory), ("param1", param1), ("param2", param2)):
        text = blank_safe(c)
        parts += [F.length(text).cast("string"), F.lit(":"), text]
        out[name] = F.md5(F.concat(*parts).cast("binary"))
    return out


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def draw(*parts: Column) -> Column:
    """A repeatable non-negative draw of 60 bits from the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")
