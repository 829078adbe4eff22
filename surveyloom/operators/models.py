"""Clustering, projection and forests on ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from surveyloom.session import cut_lineage

SEED = 42

#: Rows that a task of a forest learns from.
FOREST_ROWS = 25_000


def scaled_features(df: DataFrame, columns: list[str], out: str = "features", impute: bool = False) -> DataFrame:
    """Assembled columns with zero mean and unit deviation; median imputation on request."""
    stages, names = [], columns
    if impute:
        names = ["_i_" + c for c in columns]
        stages.append(Imputer(strategy="median", inputCols=columns, outputCols=names))
    stages += [
        VectorAssembler(inputCols=names, outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True),
    ]
    made = Pipeline(stages=stages).fit(df).transform(df)
    return made.drop("_raw", *(["_i_" + c for c in columns] if impute else []))


def best_kmeans(df: DataFrame, features: str = "features", ks: range = range(2, 7), out: str = "cluster") -> tuple[DataFrame, int]:
    """k-means with the number of clusters of the best silhouette."""
    judge = ClusteringEvaluator(featuresCol=features, predictionCol=out)
    rows, best = cut_lineage(df), None
    for k in ks:
        model = KMeans(k=k, seed=SEED, featuresCol=features, predictionCol=out).fit(rows)
        made = model.transform(rows)
        score = judge.evaluate(made) if sum(s > 0 for s in model.summary.clusterSizes) > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, made, k)
    return best[1], best[2]


def cluster_profile(clustered: DataFrame, features: list[str], measure: str, sector: str, cluster: str = "cluster") -> DataFrame:
    """Size, share, means, dominant sector and name of each cluster."""
    total = clustered.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = clustered.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in features], F.avg(measure).alias("avg_" + measure)
    ).withColumn("percentage", F.col("size") / total * 100)
    sectors = clustered.groupBy(cluster, sector).agg(F.count(F.lit(1)).alias("_n"))
    top = sectors.groupBy(cluster).agg(F.max(F.struct("_n", sector)).alias("_t")).select(
        cluster, F.col("_t." + sector).alias("dominant_sector"), F.col("_t._n").alias("_n")
    )
    out = base.join(top, cluster).withColumn("dominant_sector_pct", F.col("_n") / F.col("size") * 100).drop("_n")
    if all(c in features for c in ("governance_pct", "strategy_pct", "implementation_pct", "risk_mgmt_pct", "metrics_pct")):
        name = (
            F.when(F.greatest(*features) < 30, "Climate Beginners")
            .when((F.col("governance_pct") > 70) & (F.col("strategy_pct") > 70), "Strategic Leaders")
            .when(F.col("implementation_pct") > 70, "Implementation Focused")
            .when(F.col("risk_mgmt_pct") > 70, "Risk Management Focused")
            .when(F.col("metrics_pct") > 70, "Metrics & Targets Focused")
            .otherwise(F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
        )
        out = out.withColumn("name", name)
    return out


def mixture(df: DataFrame, k: int = 4, features: str = "features") -> DataFrame:
    return GaussianMixture(k=k, seed=SEED, featuresCol=features, predictionCol="mixture", probabilityCol="_p").fit(df).transform(df).drop("_p")


def principal_components(df: DataFrame, k: int = 2, features: str = "features") -> tuple[DataFrame, list[float]]:
    """Rows with ``pc1..pck`` and the explained shares of variance."""
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(df)
    made = model.transform(df).withColumn("_a", vector_to_array("_pc"))
    return made.select(*df.columns, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)]), [float(v) for v in model.explainedVariance]


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str | None = None) -> DataFrame:
    """0/1 column per listed value."""
    return df.withColumns({f"{prefix or column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def binary_metrics(scored: DataFrame, truth: str, predicted: str, times: str | None = None) -> DataFrame:
    """``accuracy, precision, recall, f1`` of 0/1 predictions, one row; a measure without a case is 0.

    ``times``: how many cases a row stands for.
    """
    each = F.col(times) if times else F.lit(1)
    count = lambda y, h: F.coalesce(F.sum(F.when((F.col(truth) == y) & (F.col(predicted) == h), each)), F.lit(0)).cast("double")
    c = scored.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    precision = zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    recall = zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.select(
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"),
    )


def forest_adoption(
    df: DataFrame, year: str, target: str, numeric: list[str], categorical: list[str], split_year: int,
    first: int, last: int, observed_until: int, trees: int = 100,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Random forest of one target action.

    Returns (metrics on the later years, feature importances, adoption by year):
    observed shares up to ``observed_until``, predicted shares of the test rows
    moved to the later years.
    """
    return forest_adoptions(df, year, [target], numeric, categorical, split_year, first, last, observed_until, trees)[0]


def forest_adoptions(
    df: DataFrame, year: str, targets: list[str], numeric: list[str], categorical: list[str], split_year: int,
    first: int, last: int, observed_until: int, trees: int = 100,
) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """:func:`forest_adoption` of each target.

    Features are made once for all targets. Every forest learns from all rows, which are dealt
    out evenly; test rows that agree in all features are predicted once and counted.
    """
    features = Pipeline(stages=[
        StringIndexer(inputCols=categorical, outputCols=["_x_" + c for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=["_x_" + c for c in categorical], outputCols=["_o_" + c for c in categorical], dropLast=True),
        VectorAssembler(inputCols=[*numeric, year, *["_o_" + c for c in categorical]], outputCol="_f", handleInvalid="keep"),
    ])
    rows = df.fillna(0, subset=[*numeric, *targets])
    train, test = rows.filter(F.col(year) < split_year), rows.filter(F.col(year) >= split_year)
    made = features.fit(train)
    learned = cut_lineage(made.transform(train).select("_f", *targets))
    # The table is small in bytes, and a forest works long on a row: its tasks are cut by rows.
    parts = -(-learned.count() // FOREST_ROWS)
    dealt = learned.repartition(parts) if parts > 1 else learned
    attrs = learned.schema["_f"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    alike = cut_lineage(test.groupBy(*numeric, *categorical, year, *targets).agg(F.count(F.lit(1)).alias("_n")))
    # The test rows in every later year, predicted in one pass.
    kind = dict(df.dtypes)[year]
    later = F.explode(F.sequence(F.lit(observed_until + 1).cast(kind), F.lit(last).cast(kind)))
    moved = alike.groupBy(*numeric, *categorical).agg(F.sum("_n").alias("_n"))
    moved = moved.withColumn(year, later) if last > observed_until else moved.withColumn(year, F.lit(None).cast(kind)).limit(0)
    tested, moved = made.transform(alike), made.transform(moved)

    out = []
    for target in targets:
        model = RandomForestClassifier(featuresCol="_f", labelCol=target, predictionCol="_hat", numTrees=trees, seed=SEED).fit(dealt)
        metrics = binary_metrics(model.transform(tested).select(F.col(target).cast("double").alias("y"), F.col("_hat").alias("h"), "_n"), "y", "h", "_n")
        weights = model.featureImportances
        importances = df.sparkSession.createDataFrame(
            [(target, names.get(i, str(i)), float(weights[i])) for i in range(weights.size)], "target string, feature string, importance double"
        )
        seen = rows.filter(F.col(year).between(first, observed_until)).groupBy(F.col(year).cast("int").alias("year")).agg((F.avg(target) * 100).alias("adoption_pct"))
        share = F.sum(F.col("_hat") * F.col("_n")) / F.sum("_n") * 100
        future = model.transform(moved).groupBy(F.col(year).cast("int").alias("year")).agg(share.alias("adoption_pct"))
        out.append((metrics.select(F.lit(target).alias("target"), "*"), importances, seen.unionByName(future)))
    return out
