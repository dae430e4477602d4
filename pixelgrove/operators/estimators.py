"""Spark ML estimators behind one contract: rows are pixels, features are columns, masked rows do not train."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import balance_weights
from .lineage import shared_folder


def boosted_trees(leaves: int = 31, trees: int = 100, rate: float = 0.1, subsample: float = 1.0, bins: int = 256, seed: int = 1, **more):
    """Leaf counts map to depths: the smallest depth whose full tree has as many leaves."""
    return GBTClassifier(maxDepth=max(1, (leaves - 1).bit_length()), maxIter=trees, stepSize=rate, subsamplingRate=subsample, maxBins=bins, seed=seed, **more)


def forest(leaves: int = 31, trees: int = 100, subsample: float = 1.0, bins: int = 256, seed: int = 1, **more):
    return RandomForestClassifier(maxDepth=max(1, (leaves - 1).bit_length()), numTrees=trees, subsamplingRate=subsample, maxBins=bins, seed=seed, **more)


def linear(loss: str = "hinge", penalty: str = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, steps: int = 100, **more):
    """hinge: linear support vectors; log and modified_huber (smooth stand-in): logistic regression."""
    if loss == "hinge":
        return LinearSVC(regParam=alpha, maxIter=steps, **more)
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]
    return LogisticRegression(regParam=alpha, elasticNetParam=mix, maxIter=steps, **more)


def naive_bayes(**more):
    return NaiveBayes(modelType="gaussian", **more)


REGISTRY: dict[str, Callable] = {"gbt": boosted_trees, "rf": forest, "sgd": linear, "gaussian_nb": naive_bayes}


def make(name: str, **params):
    """Estimator by registered name."""
    if name not in REGISTRY:
        raise KeyError(f"unknown estimator {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**params)


def fit(df: DataFrame, estimator, features: Sequence[str], label: str = "label", mask_label: int | None = -1, balanced: bool = False, weight: str | None = None) -> PipelineModel:
    """Rows with the mask label, nulls, NaN or infinite features do not train; balanced: class weights n / (k n_c); weight: own weight column."""
    rows = df.where(F.col(label) != mask_label) if mask_label is not None else df
    rows = rows.where(_finite(features))
    rows = rows.select(*features, F.col(label).cast("double").alias("label"), *([weight] if weight else [])).dropna()
    if balanced:
        rows = balance_weights(rows, "label", "_weight")
        weight = "_weight"
    est = estimator.copy().setLabelCol("label").setFeaturesCol("features")
    if weight:
        est = est.setWeightCol(weight)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")  # predict tells which rows have no features
    return _without_summary(Pipeline(stages=[assembler, est]).fit(rows), df.sparkSession)


def _finite(features: Sequence[str]) -> Column:
    """Whether every feature is there and a finite number; never null."""
    return reduce(Column.__and__, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in features])


def _without_summary(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model as it is stored: a training summary goes to the tasks with its model and holds the session, which cannot be sent once
    an observation was made in it."""
    if not any(getattr(s, "hasSummary", False) for s in model.stages):
        return model
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save(model, path)
    out = load(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # a model is read whole
    return out


def predict(model: PipelineModel, df: DataFrame, probabilities: bool = False) -> DataFrame:
    """df with prediction (and, if asked, an array of class probabilities); works on streams as well.

    Rows with null, NaN or infinite features stay; their prediction and probabilities are null.
    """
    out, known = model.transform(df), _finite(model.stages[0].getInputCols())
    if probabilities and "probability" in out.columns:
        out = out.withColumn("probabilities", F.when(known, vector_to_array("probability")))
    return out.drop("features", "rawPrediction", "probability").withColumn("prediction", F.when(known, F.col("prediction").cast("int")))


def fit_per_channel(df: DataFrame, estimator: Callable[[], object], channels: Sequence[str], label: str = "label") -> dict[str, PipelineModel]:
    return {c: fit(df, estimator(), [c], label) for c in channels}


def predict_per_channel(models: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    """<band>-label columns."""
    for c, m in models.items():
        df = predict(m, df).withColumnRenamed("prediction", f"{c}-label")
    return df


def per_group(df: DataFrame, keys: Sequence[str], fit_predict: Callable, schema: str) -> DataFrame:
    """One local model per group (a chip), by a function of a pandas frame; groups are chips, whose size is fixed."""
    return df.groupBy(*keys).applyInPandas(fit_predict, schema)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_splits(df: DataFrame, model: PipelineModel, path: str, keys: Sequence[str]) -> None:
    """Stores probabilities of all splits, one folder per split."""
    predict(model, df, probabilities=True).select("split", *keys, "prediction", "probabilities").write.partitionBy("split").mode("errorifexists").parquet(path)
