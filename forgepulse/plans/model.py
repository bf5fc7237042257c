"""Train and apply the binary bot model on feature tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from forgepulse import schema as S

# Features of an empty series are NULL; the model sees the training median instead.
_INPUTS = [f"in_{name}" for name in S.FEATURES]


def _inputs(features: DataFrame) -> DataFrame:
    return features.select(
        "*", *[F.col(name).cast("double").alias(f"in_{name}") for name in S.FEATURES]
    )


def train(labelled: DataFrame, label: str = "is_bot", rounds: int = 20, seed: int = 7, bins: int = 32) -> PipelineModel:
    """Gradient-boosted trees on the 38 features; `label` is 1 for bots and 0 for humans.

    `labelled` is read several times: pass a stored feature table, not a plan over raw events.
    """
    stages = [
        Imputer(strategy="median", inputCols=_INPUTS, outputCols=_INPUTS),
        VectorAssembler(inputCols=_INPUTS, outputCol="feature_vector"),
        GBTClassifier(
            featuresCol="feature_vector", labelCol="label", maxIter=rounds, maxDepth=3, maxBins=bins, seed=seed
        ),
    ]
    prepared = _inputs(labelled).withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=stages).fit(prepared)


def scorer(model: PipelineModel):
    """A function that adds `p_bot`, the probability that the account is a bot."""

    def score(features: DataFrame) -> DataFrame:
        scored = model.transform(_inputs(features))
        return scored.select(
            *features.columns, vector_to_array("probability").getItem(1).alias("p_bot")
        )

    return score


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
