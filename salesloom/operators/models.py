"""Model training and scoring with pyspark.ml. Inputs are per-customer or per-category-day tables.

Training reads its input many times, so the input is written out first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesloom.functions.money import dbl, ratio
from salesloom.operators.ordering import with_running_sum
from salesloom.session import cut_lineage

RFM = ("recency_days", "frequency", "monetary")
CHURN = ("recency_days", "frequency", "monetary", "tenure_days")
EXACT = "decimal(18,2)"
SALES = ("lag_1", "lag_7", "lag_28", "day_of_week", "month", "category_index")


def _doubles(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    return df.select(*keep, *[dbl(c).alias(c) for c in columns])


def _scaled(columns: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(columns), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def behavior_clusters(rfm: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Customers grouped by scaled recency, frequency and money."""
    table = cut_lineage(_doubles(rfm, RFM, "customer_id"))
    model = Pipeline(stages=[*_scaled(RFM), KMeans(k=k, seed=seed, predictionCol="cluster")]).fit(table)
    return model.transform(table).select("customer_id", *RFM, "cluster")


def fit_churn(labels: DataFrame) -> PipelineModel:
    table = cut_lineage(_doubles(labels, CHURN, "customer_id", "churned"), "churn")
    return Pipeline(stages=[*_scaled(CHURN), LogisticRegression(labelCol="churned", maxIter=20)]).fit(table)


@dataclass(frozen=True)
class LinearScore:
    """A fitted logistic regression in the terms of its unscaled inputs: what scoring needs, and all that is stored."""

    intercept: float
    weights: tuple[tuple[str, float], ...]

    @classmethod
    def of(cls, model: PipelineModel) -> LinearScore:
        assembler, scaler, regression = model.stages
        out, weights = float(regression.intercept), []
        for name, mean, std, w in zip(assembler.getInputCols(), scaler.mean, scaler.std, regression.coefficients):
            per_unit = float(w) / float(std) if std else 0.0
            weights.append((name, per_unit))
            out -= per_unit * float(mean)
        return cls(out, tuple(weights))

    def probability(self) -> Column:
        """One expression of plain columns: no vectors, no Python."""
        z = reduce(lambda a, b: a + b, [dbl(name) * F.lit(w) for name, w in self.weights], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("", self.intercept), *self.weights]
        spark.createDataFrame(rows, "input string, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearScore:
        rows = dict(spark.read.schema("input string, weight double").parquet(path).collect())  # one row per input
        return cls(rows.pop(""), tuple(sorted(rows.items())))


def churn_scores(score: LinearScore, labels: DataFrame) -> DataFrame:
    """Scores of customers at a cut later than the one that was learnt from."""
    probability = score.probability()
    return labels.select(
        "customer_id",
        "churned",
        probability.alias("churn_probability"),
        (probability > 0.5).cast("int").alias("predicted"),
    )


def auc(scored: DataFrame, label: str, score: str) -> float | None:
    """Area under the ROC curve by ranks: the share of pairs of a 1 and a 0 that the score orders rightly, ties half;
    None without such a pair.

    Rows are counted per distinct score first; their running count is taken without a single-task window.
    """
    counts = scored.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_ones"), F.count_if(F.col(label) == 0).alias("_zeros")
    )
    ran = with_running_sum(counts, ["_s"], "_zeros", "_below", "_all")
    right = F.sum(dbl("_ones") * (dbl("_below") - dbl("_zeros") / 2))
    return ran.agg(F.try_divide(right, dbl(F.sum("_ones")) * dbl(F.max("_all")))).first()[0]


def sales_features(by_category: DataFrame) -> DataFrame:
    """Lags and calendar columns per category and day; ``by_category`` has a row for every day, so lags are days."""
    w = Window.partitionBy("category").orderBy("date")
    lags = {f"lag_{n}": dbl(F.lag("revenue", n).over(w)) for n in (1, 7, 28)}
    return (
        by_category.withColumns(lags)
        .withColumns(
            {"day_of_week": F.dayofweek("date").cast("double"), "month": F.month("date").cast("double")}
        )
        .withColumn("actual", dbl("revenue"))
        .dropna(subset=list(lags))
    )


#: Depth and step of the trees that rolling origins choose among.
GRID = ({"maxDepth": 3, "stepSize": 0.1}, {"maxDepth": 5, "stepSize": 0.1})


def rolling_folds(
    df: DataFrame, day: str, first: dt.date, step_days: int, folds: int, horizon_days: int
) -> DataFrame:
    """Each row once for every fold it belongs to, with ``fold`` and ``role``: one frame for all origins.

    The origin of fold k is ``first`` plus k steps. Rows before it train, those of the horizon from it on test, and
    later ones are not in the fold, so that no fold learns from its future.
    """
    origins = [first + dt.timedelta(days=k * step_days) for k in range(folds)]
    horizon = dt.timedelta(days=horizon_days)

    def member(k: int, origin: dt.date) -> Column:
        role = F.when(F.col(day) < F.lit(origin), "train").when(F.col(day) < F.lit(origin + horizon), "test")
        return F.struct(F.lit(k).alias("fold"), role.alias("role"))

    marked = F.array(*[member(k, origin) for k, origin in enumerate(origins)])
    every = df.withColumn("_m", F.explode(F.filter(marked, lambda m: m["role"].isNotNull())))
    return every.select(*df.columns, "_m.fold", "_m.role")


def fold_errors(tested: DataFrame, forecasts: Mapping[str, str], actual: str = "actual") -> DataFrame:
    """Rows, RMSE, MAE and MAPE per fold and model; ``forecasts`` names each model's column. Sums are exact."""
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).cast(EXACT).alias("forecast")) for m, c in forecasts.items()]
    )
    long = tested.select("fold", F.col(actual).cast(EXACT).alias("actual"), F.explode(models).alias("_m"))
    miss = F.col("actual") - F.col("_m.forecast")
    share = F.try_divide(dbl(F.abs(miss)), dbl("actual")).cast("decimal(18,8)")
    sums = long.groupBy("fold", F.col("_m.model").alias("model")).agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum((miss * miss).cast("decimal(38,4)")).alias("_squares"),
        F.sum(F.abs(miss)).alias("_absolute"),
        F.sum(share).alias("_share"),
        F.count(share).alias("_shares"),
    )
    return sums.select(
        "fold",
        "model",
        "periods",
        F.sqrt(ratio("_squares", "periods")).cast(EXACT).alias("rmse"),
        ratio("_absolute", "periods").cast(EXACT).alias("mae"),
        (ratio("_share", "_shares") * 100).cast("decimal(18,4)").alias("mape"),
    )


def choose_parameters(
    features: DataFrame, until: dt.date, grid: Sequence[Mapping] = GRID, folds: int = 2, horizon_days: int = 90
) -> tuple[dict, DataFrame]:
    """The parameters with the least mean RMSE over rolling origins that end at ``until``, and the errors of all."""
    first = until - dt.timedelta(days=folds * horizon_days)
    known = features.where(F.col("date") < F.lit(until))
    members = cut_lineage(rolling_folds(known, "date", first, horizon_days, folds, horizon_days), "folds")
    parts = []
    for k in range(folds):
        train = members.where((F.col("fold") == k) & (F.col("role") == "train"))
        test = members.where((F.col("fold") == k) & (F.col("role") == "test"))
        for n, params in enumerate(grid):
            scored = fit_sales(train, first + dt.timedelta(days=k * horizon_days), params=params).transform(
                test.withColumn("_late", F.lit(False))
            )
            parts.append(fold_errors(scored, {str(n): "prediction"}))
    errors = cut_lineage(reduce(DataFrame.unionByName, parts), "fold-errors")
    best = errors.groupBy("model").agg(F.avg(dbl("rmse")).alias("_e")).orderBy("_e", "model").first()
    return dict(grid[0 if best is None else int(best.model)]), errors


def fit_sales(features: DataFrame, cut: dt.date, seed: int = 42, params: Mapping | None = None) -> PipelineModel:
    """Boosted trees on the days before the cut; the last tenth of those days stops the boosting."""
    span = features.filter(F.col("date") < F.lit(cut)).agg(F.min("date"), F.max("date")).first()
    held_from = span[1] - (span[1] - span[0]) / 10
    train = cut_lineage(
        features.filter(F.col("date") < F.lit(cut)).withColumn("_late", F.col("date") >= F.lit(held_from))
    )
    stages = [
        StringIndexer(inputCol="category", outputCol="category_index", handleInvalid="keep"),
        VectorAssembler(inputCols=list(SALES), outputCol="features"),
        GBTRegressor(
            **{"labelCol": "actual", "maxIter": 10, "maxDepth": 4, "seed": seed, "validationIndicatorCol": "_late", **(params or {})}
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def forecast_gbt(features: DataFrame, cut: dt.date) -> DataFrame:
    """Forecast against actual for the days from the cut on, with the parameters that rolling origins before it favour."""
    features = cut_lineage(features, "features")
    params, _ = choose_parameters(features, cut)
    model = fit_sales(features, cut, params=params)
    later = features.filter(F.col("date") >= F.lit(cut)).withColumn("_late", F.lit(False))
    return model.transform(later).select("category", "date", "actual", F.col("prediction").alias("forecast"))


def save_model(model: PipelineModel, root: str, name: str) -> str:
    path = f"{root.rstrip('/')}/models/{name}"
    model.write().overwrite().save(path)
    return path


def predict(df: DataFrame, root: str, name: str) -> DataFrame:
    """Score rows with a model saved under a name."""
    return PipelineModel.load(f"{root.rstrip('/')}/models/{name}").transform(df)


def evaluate(scored: DataFrame, model: str) -> DataFrame:
    """A status row of a forecast: periods, RMSE, MAE and MAPE (over actuals other than 0) of (actual, forecast)."""
    known = scored.where("actual IS NOT NULL AND forecast IS NOT NULL").select(F.lit(0).alias("fold"), "actual", "forecast")
    return fold_errors(known, {model: "forecast"}).drop("fold").withColumn("auc", F.lit(None).cast("double"))


def evaluate_scores(scored: DataFrame, model: str, label: str, score: str) -> DataFrame:
    """A status row of a classifier: rows and the area under its ROC curve."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("rmse", EXACT), ("mae", EXACT), ("mape", "decimal(18,4)"))]
    rows = scored.agg(F.count(F.lit(1)).alias("periods"))
    return rows.select(F.lit(model).alias("model"), "periods", *nothing, F.lit(auc(scored, label, score)).cast("double").alias("auc"))


def stability_index(
    df: DataFrame, column: str, is_reference: "F.Column", edges: Sequence[float]
) -> DataFrame:
    """Population stability index of a column, reference rows against the rest, on fixed bins.

    Empty bins count as a share of one in a million. Both counts come from one pass.
    """
    bin_no = F.lit(0)
    for i, edge in enumerate(edges, start=1):
        bin_no = F.when(F.col(column) >= F.lit(edge), F.lit(i)).otherwise(bin_no)
    counts = df.groupBy(bin_no.alias("bin")).agg(
        F.count_if(is_reference).alias("reference_rows"), F.count_if(~is_reference).alias("current_rows")
    )
    every = Window.partitionBy()  # one row per bin

    def share(rows: str):
        return F.greatest(F.try_divide(dbl(rows), dbl(F.sum(rows).over(every))), F.lit(1e-6))

    shares = counts.withColumns({"_r": share("reference_rows"), "_c": share("current_rows")})
    part = (F.col("_c") - F.col("_r")) * F.log(F.col("_c") / F.col("_r"))
    return shares.select("bin", "reference_rows", "current_rows", part.cast("decimal(18,8)").alias("psi"))
