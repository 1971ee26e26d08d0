"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_submission(scored: DataFrame, path: str) -> None:
    """base_id, cand_id and probability as CSV with a header."""
    scored.select("base_id", "cand_id", F.col("probability").cast("double")).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(oof: DataFrame, path: str) -> None:
    """Out-of-fold predictions: y, base_id and one score per model."""
    oof.write.mode("overwrite").parquet(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON object with an array of rows for each section; sections are reports of a few rows."""
    parts = [df.agg(F.collect_list(F.struct(*df.columns)).alias(name)) for name, df in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part)
    out.coalesce(1).write.mode("overwrite").json(path)
