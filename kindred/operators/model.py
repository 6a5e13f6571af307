"""Gradient-boosted pair scorers on Spark ML."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features

#: The 14 features, in the order of the model's inputs.
INPUTS = [
    "levenshtein_ratio", "jaro_winkler", "token_sort_ratio", "token_set_ratio", "exact_name_match", "domain_match_flag", "number_overlap_ratio",
    "exact_number_match", "number_conflict_flag", "address_token_jaccard", "address_token_sort_ratio", "missing_address_flag", "name_length_diff", "token_count_ratio",
]


def featured(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with the model's inputs; the string kernels see each pair of records once."""
    return featured_of(pairs, features.described(records))


def featured_of(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """``featured`` of records that are described."""
    wide = features.sides(pairs, d)
    return wide.select(*pairs.columns, *features.set_features(), *features.kernel_features()).select(*pairs.columns, *INPUTS)


def train(pairs: DataFrame, trees: int = 60, held: str = "held", inputs: list[str] | None = None) -> PipelineModel:
    """A boosted model of ``label`` on the inputs.  Rows where ``held`` is true are not learned from; they stop the boosting early."""
    inputs = inputs or INPUTS
    trees_ = GBTClassifier(labelCol="label", maxIter=trees, stepSize=0.05, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, validationIndicatorCol=held)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), trees_]).fit(pairs)


def retrained(pairs: DataFrame, negatives: DataFrame, trees: int = 60) -> PipelineModel:
    """A model of the pairs and of hard negatives that are not among them; negatives of held-out records are left out."""
    more = negatives.join(pairs.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").where("NOT held").dropDuplicates(["s1_id", "cand_id"])
    columns = ["s1_id", "cand_id", "label", "held", *INPUTS]
    return train(pairs.select(*columns).union(more.withColumn("label", F.lit(0.0)).select(*columns)), trees)


def predict(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    out = model.transform(pairs).withColumn("p", F.round(vector_to_array("probability")[1], 6))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, most: int = 8) -> list[tuple[str, float]]:
    """The inputs that the trees lean on most."""
    assembler, trees = model.stages
    return sorted(zip(assembler.getInputCols(), trees.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:most]


def metadata(model: PipelineModel, **measured) -> str:
    """Inputs, number of trees and what was measured, as JSON."""
    return json.dumps({"inputs": model.stages[0].getInputCols(), "trees": model.stages[1].getNumTrees} | measured, sort_keys=True)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
