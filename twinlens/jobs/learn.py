"""Cross-fitted models on pair features with spark.ml: stacking, out-of-fold scores, ablation, importances."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import draw
from ..operators.features import drop_groups
from ..operators.folds import group_folds
from ..operators.ranking import auc_metrics

MISSING = -999.0


def _ready(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(MISSING, subset=columns)


def _weights(df: DataFrame, y: str) -> DataFrame:
    """``df`` with ``weight``: negatives over positives for positives, 1 for negatives."""
    one = F.broadcast(df.agg((F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1))).alias("_w")))  # one row
    return df.join(one).withColumn("weight", F.when(F.col(y) == 1, F.col("_w")).otherwise(1.0)).drop("_w")


def fit_gbt(train: DataFrame, columns: list[str], y: str = "is_double", trees: int = 20, depth: int = 4, seed: int = 42, key: str = "pair_id"):
    """Boosted trees with class weights; a tenth of the training rows, by a draw of ``key``, not the validation fold, stops the boosting."""
    ready = _weights(_ready(train, columns), y).withColumn("_stop", draw(F.col(key).cast("string"), F.lit(str(seed))) % 10 == 0)
    gbt = GBTClassifier(labelCol=y, featuresCol="_features", weightCol="weight", validationIndicatorCol="_stop", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep"), gbt]).fit(ready)


def predict(model, df: DataFrame, columns: list[str], out: str) -> DataFrame:
    scored = model.transform(_ready(df, columns))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, columns: list[str], y: str = "is_double", fold: str = "fold", n_splits: int = 5, **kw) -> tuple[DataFrame, list]:
    """``df`` with ``score`` from the model of the other folds, and the models."""
    parts, models = None, []
    for k in range(n_splits):
        model = fit_gbt(df.where(F.col(fold) != k), columns, y, **kw)
        part = predict(model, df.where(F.col(fold) == k), columns, "score")
        models.append(model)
        parts = part if parts is None else parts.unionByName(part)
    return parts, models


def average_prediction(models: list, test: DataFrame, columns: list[str]) -> DataFrame:
    """``test``, its missing ``columns`` filled, with the mean ``score`` of the fold models. Rows are assembled once for all of them."""
    scored = models[0].stages[0].transform(_ready(test, columns))
    for k, model in enumerate(models):
        trees = model.stages[-1]
        scored = trees.copy({trees.rawPredictionCol: "", trees.predictionCol: "", trees.probabilityCol: f"_p{k}"}).transform(scored)
    each = [f"_p{k}" for k in range(len(models))]
    return scored.withColumn("score", sum((vector_to_array(p)[1] for p in each), F.lit(0.0)) / len(models)).drop("_features", *each)


def importances(models: list, columns: list[str], top: int = 20) -> DataFrame:
    """feature and mean gain of the ``top`` features over the fold models."""
    from pyspark.sql import SparkSession

    rows = [(c, float(v)) for m in models for c, v in zip(columns, m.stages[-1].featureImportances.toArray(), strict=True)]
    table = SparkSession.getActiveSession().createDataFrame(rows, "feature string, gain double")
    return table.groupBy("feature").agg(F.avg("gain").alias("gain")).orderBy(F.desc("gain"), "feature").limit(top)


def _fit_linear(train: DataFrame, vector: str, y: str):
    learner = LogisticRegression(labelCol=y, featuresCol="_features", weightCol="weight", maxIter=10, regParam=0.01)
    return learner.fit(_weights(train.withColumn("_features", array_to_vector(vector)), y))


def _score_linear(model, df: DataFrame, vector: str, out: str) -> DataFrame:
    scored = model.transform(df.withColumn("_features", array_to_vector(vector)))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def stack(df: DataFrame, group: str, vector: str, others: tuple[DataFrame, ...] = (), y: str = "is_double", n_splits: int = 4, seed: int = 43, out: str = "stack_sim", dealt: bool = False, known: str | None = None) -> list[DataFrame]:
    """``df`` with a cross-fitted score ``out`` of a linear learner on the array ``vector``, then ``others`` scored by a learner of all of ``df``.

    Every row of ``df`` is scored by a learner that hasn't seen its group; the others (validation and test rows) by the full one. Rows
    without a vector score null. Give ``df`` stored: it is read once for each fold. With ``dealt`` it has its ``fold`` already, so vectors needn't be moved to get it.
    ``known`` is a column that tells whether a row has a vector, where vectors are worked out when they are read.
    """
    has = F.col(known) if known else F.col(vector).isNotNull()
    folded = df if dealt else group_folds(df, group, n_splits, seed)
    fit = folded.where(has)
    parts = folded.where(~has).drop("fold").withColumn(out, F.lit(None).cast("double"))
    for k in range(n_splits):
        model = _fit_linear(fit.where(F.col("fold") != k), vector, y)
        parts = parts.unionByName(_score_linear(model, fit.where(F.col("fold") == k), vector, out).drop("fold"))
    if not others:
        return [parts]
    full = _fit_linear(fit, vector, y)
    scored = lambda d: _score_linear(full, d.where(has), vector, out)
    return [parts, *(scored(d).unionByName(d.where(~has).withColumn(out, F.lit(None).cast("double"))) for d in others)]


def ablation(df: DataFrame, columns: list[str], groups: dict[str, tuple[str, ...]], y: str = "is_double", fold: str = "fold", valid: int = 0, **kw) -> DataFrame:
    """name and pr_auc on fold ``valid`` without each group of columns (given by prefixes)."""
    out = None
    for name, prefixes in {"all": (), **groups}.items():
        left = [c for c in columns if c in drop_groups(df.select(*columns), prefixes).columns] if prefixes else columns
        model = fit_gbt(df.where(F.col(fold) != valid), left, y, **kw)
        row = auc_metrics(predict(model, df.where(F.col(fold) == valid), left, "score"), "score", y).select(F.lit(name).alias("name"), F.lit(len(left)).alias("features"), "pr_auc")
        out = row if out is None else out.unionByName(row)
    return out
