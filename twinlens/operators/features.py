"""Similarity features of listing pairs: one projection without a shuffle, and lookups joined to it by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import text as T
from .lookup import embedding_pair_features
from .photos import photo_pair_features

#: Text fields: n of the character n-grams, and raw characters that are looked at.
TEXT_FIELDS = {"title": (3, None), "description": (4, 512)}
#: Characters of descriptions that features look at; those of longer ones needn't be moved.
DESCRIPTION = TEXT_FIELDS["description"][1]
CATEGORIES = ("category_name", "subcategory_name", "param1", "param2")


def prepare_texts(df: DataFrame, prefix: str = "", *, stable: bool = False, whole: bool = False) -> DataFrame:
    """``df`` with what the features need of the texts ``{prefix}{field}``, each evaluated once: the normal form ``_{prefix}{field}``, and sets of its words
    (``_w``), digit words (``_d``) and, of short texts, n-grams (``_g``). With ``whole`` no text is cut.

    A listing is in several pairs, so this is cheaper on listings, before they are paired: see :func:`~twinlens.sources.pairs.derived_pairs`. Texts are cut in
    a step of their own, so that no whole description goes through the Python worker's queue.
    """
    cut = {f"_{prefix}{f}": T.blank_safe(F.substring(f"{prefix}{f}", 1, chars) if chars and not whole else F.col(f"{prefix}{f}")) for f, (_, chars) in TEXT_FIELDS.items()}
    df = df.withColumns(cut).withColumns({t: T.normalize(F.col(t), stable=stable) for t in cut})
    df = df.withColumns({f"{t}_w": T.token_set(F.col(t)) for t in cut})
    grams = {f"_{prefix}{f}_g": T.char_ngrams(F.col(f"_{prefix}{f}"), n) for f, (n, chars) in TEXT_FIELDS.items() if not chars}
    return df.withColumns({f"{t}_d": T.digit_tokens(F.col(f"{t}_w")) for t in cut} | grams)


def prepare_whole_texts(df: DataFrame) -> DataFrame:
    """:func:`prepare_texts` of whole texts."""
    return prepare_texts(df, whole=True)


def _compared(pairs: DataFrame, stable: bool, whole: bool) -> DataFrame:
    """``pairs`` with both sides' texts prepared, unless they are so already, and their long texts compared. Words of ``whole`` ones are compared with their n-grams, so no set of them is moved."""
    for side in ("base_", "cand_"):
        if f"_{side}title_w" not in pairs.columns:
            pairs = prepare_texts(pairs, side, stable=stable, whole=whole)
    titles = (F.col("_base_title_w"), F.col("_cand_title_w")) if whole else ()
    compare = T.whole_text_overlap if whole else T.long_text_overlap
    return pairs.withColumns({f"_{f}_long": compare(F.col(f"_base_{f}"), F.col(f"_cand_{f}"), F.lit(n), *titles) for f, (n, chars) in TEXT_FIELDS.items() if chars})


def _ratio(shared: Column, a: Column, b: Column, least: bool = False) -> Column:
    """Shared elements over those of the union, or of the smaller set; 0 without any."""
    whole = F.least(a, b) if least else a + b - shared
    return F.when(whole > 0, shared / F.greatest(whole, F.lit(1))).otherwise(0.0)


def text_block(field: str, long: bool, whole: bool = False) -> dict[str, Column]:
    """Nine features of two normal forms; all but ``both_empty`` are 0 if both are empty. Words of ``whole`` long texts are counted already."""
    b, c = F.col(f"_base_{field}"), F.col(f"_cand_{field}")
    words, digits, grams = ((F.col(f"_base_{field}_{k}"), F.col(f"_cand_{field}_{k}")) for k in "wdg")
    sizes = lambda x: (F.size(F.array_intersect(*x)), F.size(x[0]), F.size(x[1]))
    w = tuple(F.col(f"_{field}_long.{k}") for k in ("shared", "base_words", "cand_words")) if long and whole else sizes(words)
    d = sizes(digits)
    features = {
        "exact": ((b == c) & (b != "")).cast("double"),
        "jaccard_tok": _ratio(*w),
        "containment_tok": _ratio(*w, least=True),
        "jaccard_ngram": F.col(f"_{field}_long.ngram") if long else _ratio(*sizes(grams)),
        "digits_jaccard": F.when(d[1] + d[2] == 0, -1.0).otherwise(_ratio(*d)),
        "lcp_ratio": F.col(f"_{field}_long.lcp") if long else T.lcp_ratio(b, c),
        "len_ratio": F.least(F.length(b), F.length(c)) / F.greatest(F.length(b), F.length(c), F.lit(1)),
        "len_diff": F.abs(F.length(b) - F.length(c)).cast("double"),
    }
    empty = (b == "") & (c == "")
    return {f"{field}_{k}": F.when(empty, 0.0).otherwise(v) for k, v in features.items()} | {f"{field}_both_empty": empty.cast("double")}


def cross_block(whole: bool = False) -> dict[str, Column]:
    """How much of each side's title lies in the other's description."""
    words = lambda c: F.col(f"_{c}_w")
    if whole:
        counted = lambda c: F.col(f"_description_long.{c}")
        inside = lambda s, other: _ratio(counted(f"{s}_title"), F.size(words(f"{s}_title")), counted(f"{other}_words"), least=True)
        return {f"cross_{s}_title_in_{other}_desc": inside(s, other) for s, other in (("base", "cand"), ("cand", "base"))}
    return {
        "cross_base_title_in_cand_desc": T.containment(words("base_title"), words("cand_description")),
        "cross_cand_title_in_base_desc": T.containment(words("cand_title"), words("base_description")),
    }


def build_features(pairs: DataFrame, keep: tuple[str, ...] = ("base_item_id", "cand_item_id"), *, stable: bool = False, whole: bool = False) -> DataFrame:
    """All row-local features of ``pairs`` beside the ``keep`` columns, of ``whole`` descriptions or of their beginnings. A block whose columns are absent is left out. Texts that :func:`prepare_texts` has seen on both sides aren't prepared again."""
    has = lambda *names: all(f"{s}_{n}" in pairs.columns for s in ("base", "cand") for n in names)
    side = lambda name: (F.col(f"base_{name}"), F.col(f"cand_{name}"))
    df = _compared(pairs, stable, whole)
    out: dict[str, Column] = {}
    for field, (_, chars) in TEXT_FIELDS.items():
        out |= text_block(field, bool(chars), whole)
    if has("json_params"):
        df = df.withColumns({f"_{s}_params": A.parse_params(F.col(f"{s}_json_params")) for s in ("base", "cand")})
        out |= A.params_block(F.col("_base_params"), F.col("_cand_params"))
    out |= A.price_block(*side("price")) | A.images_block(*side("count_images"))
    out |= {c: A.flag(F.col(c)) for c in ("is_same_location", "is_same_region") if c in pairs.columns}
    for name in CATEGORIES:
        if has(name):
            out |= A.category_block(name, *side(name))
    if has("title_image"):
        out |= A.title_image_block(*side("title_image"))
    out |= cross_block(whole)
    return df.select(*keep, *(c.cast("double").alias(k) for k, c in out.items()))


def build_all_features(pairs: DataFrame, vectors: DataFrame, images: DataFrame, keep: tuple[str, ...] = ("pair_id",), *, key: str = "vec_id", stable: bool = False) -> DataFrame:
    """All 58 features of ``pairs`` in one row each: the row-local ones of whole texts, those of the sides' ``vectors`` (``key``, embedding) and of their photos in
    ``images`` (image_key, dhash, embedding, found).

    The lookups run over narrow columns; their blocks are joined to the row-local one by pair_id, so no text is shuffled more than once.
    """
    keep = tuple(dict.fromkeys(("pair_id", *keep)))
    local = build_features(pairs, keep, stable=stable, whole=True)
    embedded = embedding_pair_features(pairs, vectors, key, f"base_{key}", f"cand_{key}", ("pair_id",))
    photos = photo_pair_features(pairs, images, "base_title_image", "cand_title_image", ("pair_id",))
    return local.join(embedded, "pair_id").join(photos, "pair_id")


def drop_groups(features: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Without the columns that start with one of ``prefixes``."""
    return features.select(*(c for c in features.columns if not c.startswith(prefixes)))
