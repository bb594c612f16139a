"""A random forest that tells the substrate from the frame features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.operators.imaging import FEATURES
from reefline.operators.training import seeded_hash

LEAST_SAMPLES = 10


def with_class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * n of the class), as balanced class weights are defined."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # the class table is one row per class
    totals = sizes.groupBy().agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k")).first()
    if (totals["_all"] or 0) < LEAST_SAMPLES:
        raise ValueError(f"need at least {LEAST_SAMPLES} samples, got {totals['_all'] or 0}")
    balance = float(totals["_all"]) / float(totals["_k"])
    return rows.join(sizes, label).withColumn("weight", F.lit(balance) / F.col("_n")).drop("_n")


def split(rows: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark a reproducible share of the rows as test rows by a hash of their key."""
    part = F.pmod(seeded_hash(seed, key), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("is_test", part < test_share)


def train(
    rows: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = "label",
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> PipelineModel:
    """Index labels, scale features, fit the forest with balanced class weights."""
    clean = rows.na.fill(0.0, list(features))
    indexer = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc").fit(
        clean
    )
    stages = [
        indexer,
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        RandomForestClassifier(
            featuresCol="scaled",
            labelCol="label_idx",
            weightCol="weight",
            numTrees=trees,
            maxDepth=depth,
            seed=seed,
        ),
        IndexToString(inputCol="prediction", outputCol="substrate_type", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(with_class_weights(clean, label))


def predict(model: PipelineModel, rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Substrate and the probability of the winning class."""
    scored = model.transform(rows.na.fill(0.0, list(features)))
    return scored.withColumn(
        "confidence", F.array_max(vector_to_array("probability"))
    ).drop("raw", "scaled", "rawPrediction", "probability")


def report(model: PipelineModel, test: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Precision, recall and support per class on test rows, with the overall accuracy."""
    scored = predict(model, test, features)
    hit = F.col("label") == F.col("substrate_type")
    named = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("support"), F.count_if(hit).alias("hits")
    )
    guessed = scored.groupBy(F.col("substrate_type").alias("label")).agg(
        F.count(F.lit(1)).alias("guesses")
    )
    accuracy = MulticlassClassificationEvaluator(
        labelCol="label_idx", predictionCol="prediction", metricName="accuracy"
    ).evaluate(scored)
    return named.join(guessed, "label", "left").select(
        "label",
        "support",
        F.coalesce(F.try_divide(F.col("hits"), F.col("guesses")), F.lit(0.0)).alias("precision"),
        (F.col("hits") / F.col("support")).alias("recall"),
        F.lit(float(accuracy)).alias("accuracy"),
    )
