"""Detectors with fitted models. Fitting is distributed (MLlib); scoring is a projection."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import base_amount, blank, plain
from . import features as X
from .learn import signed_log

FEATURES = ["f_amount", "f_hour", "f_weekday", "f_period_end", "f_backdated", "f_manual", "f_unapproved", "f_text"]


def model_features(gl: DataFrame) -> DataFrame:
    """Numeric inputs of every line, without nulls."""
    x = X.pattern_features(X.time_features(gl))
    f = {
        "f_amount": F.log1p(base_amount()), "f_hour": F.hour("posting_date"), "f_weekday": F.weekday("posting_date"), "f_period_end": F.col("is_period_end").cast("int"), "f_backdated": signed_log(F.col("days_backdated")), "f_manual": F.col("is_manual_je").cast("int"),
        "f_unapproved": blank("approved_by").cast("int"), "f_text": F.length(plain("line_text")),
    }
    return x.select("row_id", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in f.items()))


def reconstruction_errors(x: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(row_id, error): the squared distance of a standardised row from the plane of the first k principal components."""
    p = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="_c")]).fit(x)
    y = p.transform(x).select("row_id", vector_to_array("_z").alias("z"), vector_to_array("_c").alias("c"))
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    # the components are orthonormal, so what they leave is the difference of the squared lengths
    return y.select("row_id", F.greatest(F.lit(0.0), sq(F.col("z")) - sq(F.col("c"))).alias("error"))


def supervised(train: DataFrame, columns: list[str], label: str):
    """A fitted pipeline; its transform() adds probability. Standardised logistic regression."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, regParam=0.01)]).fit(train)


def scored(model, x: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(x).select(*keep, vector_to_array("probability")[1].alias("score"))
