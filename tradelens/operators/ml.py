"""Feature table, classifier and column typing for the label of trades before price jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(labels: DataFrame, trades: DataFrame, profiles: DataFrame, iax: DataFrame, markets: DataFrame) -> DataFrame:
    """One row a labelled trade: side, market type, wallet statistics and edge features."""
    own = labels.groupBy("trade_id").agg(F.max("is_pre_jump").alias("label"))
    x = trades.select("trade_id", "wallet", "condition_id", "side").join(own, "trade_id")
    x = x.join(markets.select("condition_id", F.col("category").alias("market_type")), "condition_id", "left")
    p = profiles.select("wallet", F.col("trades").alias("total_trades"), "winrate")
    return x.join(p, "wallet").join(iax.drop("iax_level"), "wallet").drop("condition_id")


NUMBERS = ("total_trades", "winrate", "iax_score", "total_edge", "avg_conviction", "avg_obscurity", "avg_urgency")


def _pipeline(seed: int, rounds: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    index = StringIndexer(inputCols=["side", "market_type"], outputCols=["side_i", "type_i"], handleInvalid="keep")
    join = VectorAssembler(inputCols=["side_i", "type_i", *NUMBERS], outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=4, seed=seed)
    return Pipeline(stages=[index, join, trees])


def train(data: DataFrame, seed: int = 7, rounds: int = 10):
    """A fitted pipeline of indexers, assembler and gradient-boosted trees; every stage runs on Spark."""
    return _pipeline(seed, rounds).fit(data)


def predict(model, data: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(data)
    return out.select("trade_id", "label", F.round(vector_to_array("probability")[1], 6).alias("probability"), F.col("prediction").cast("int").alias("prediction"))


def time_folds(data: DataFrame, starts: DataFrame, folds: int = 3) -> DataFrame:
    """``data`` with ``fold``: wallets cut by the time of their first trade into parts of like size, so no wallet is in two.

    ``starts(wallet, first_t)``. The cuts, ``folds - 1`` numbers, reach the driver.
    """
    own = data.select("wallet").distinct().join(starts, "wallet")
    cuts = own.approxQuantile("first_t", [k / folds for k in range(1, folds)], 0.001)
    fold = sum((F.when(F.col("first_t") > F.lit(x), 1).otherwise(0) for x in cuts), F.lit(0)).cast("int")
    return data.join(own.select("wallet", fold.alias("fold")), "wallet")


def out_of_fold(data: DataFrame, folds: int = 3, seed: int = 7, rounds: int = 10) -> DataFrame:
    """Each row of ``data(..., label, fold)`` predicted by a model that saw no row of its fold.

    Models of gradient-boosted trees with their indexers are fitted by a cross-validation over the fold column; every stage runs on Spark.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    cross = CrossValidator(
        estimator=_pipeline(seed, rounds), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="label"),
        numFolds=folds, foldCol="fold", collectSubModels=True, seed=seed,
    )
    out = None
    for k, (model,) in enumerate(cross.fit(data).subModels):
        part = predict(model, data.where(F.col("fold") == k)).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def area_under_curve(predicted: DataFrame) -> float:
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability").evaluate(predicted)


def categorical_columns(df: DataFrame, max_categories: int = 100, approximate: bool = False) -> DataFrame:
    """(name, distinct, categorical): string columns of at most ``max_categories`` values are categories."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(*[count(c).alias(c) for c in df.columns])
    kinds = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("distinct"), F.lit(kinds[c] == "string").alias("text")) for c in df.columns])
    x = one.select(F.explode(rows).alias("x")).select("x.*")
    return x.select("name", "distinct", (F.col("text") & (F.col("distinct") <= max_categories)).alias("categorical"))
