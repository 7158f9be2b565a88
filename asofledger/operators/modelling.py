"""Chronological model evaluation with Spark ML and own trees: fit on train, select on validation, touch test once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialize, with_row_number
from ..functions.patterns import evaluation_partition
from ..schema import CORE_FEATURES, ENHANCED_FEATURES, NULLABLE_FEATURES, PARTITIONS
from . import metrics
from .boosting import Boosting
from .integrity import IntegrityError
from .quantiles import quantiles

SEED = 904
MAX_ITERATIONS = 1000
#: Validation rows that importance is measured on, at most.
IMPORTANCE_ROWS = 10_000


class ConvergenceError(RuntimeError):
    """A model whose fit did not end by itself."""


@dataclass(frozen=True)
class Spec:
    name: str
    columns: tuple[str, ...]
    kind: str


SPECS = [Spec("prevalence", tuple(CORE_FEATURES), "baseline"), Spec("core_logistic", tuple(CORE_FEATURES), "logistic"), Spec("core_boosting", tuple(CORE_FEATURES), "boosting"), Spec("enhanced_logistic", tuple(ENHANCED_FEATURES), "logistic"), Spec("enhanced_boosting", tuple(ENHANCED_FEATURES), "boosting")]


def model_data(features: DataFrame) -> DataFrame:
    """Features as doubles, label, partition; decimals become floats here and nowhere before."""
    return features.select("*", evaluation_partition(F.col("step")).alias("evaluation_partition"), F.col("is_fraud").cast("int").alias("label")).withColumns({c: F.col(c).cast("double") for c in ENHANCED_FEATURES if c in features.columns})


def require_model_data(data: DataFrame, partitions: dict[str, int] | None = None) -> dict:
    """What a model is about to see, as facts; raises for rows that it must not: other partition sizes than approved ones (or an empty partition), labels other than 0 and 1, missing values of features that always have one, and infinities that a conversion to double left."""
    given = [c for c in ENHANCED_FEATURES if c in data.columns]
    infinite = [F.count_if(F.abs(c) == float("inf")).alias(f"infinite_{c}") for c in given]
    nulls = [F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"null_{c}") for c in given]
    parts = [F.count_if(F.col("evaluation_partition") == p).alias(p) for p, _, _ in PARTITIONS]
    seen = data.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("labels"), *parts, *nulls, *infinite).first().asDict()
    sizes = {p: seen[p] for p, _, _ in PARTITIONS}
    wrong = [f"partition {p}: {n} rows" + (f", not {partitions[p]}" if partitions else "") for p, n in sizes.items() if (n != partitions.get(p) if partitions else not n)]
    wrong += [f"{seen['labels']} labels other than 0 and 1"] * bool(seen["labels"])
    wrong += [f"{seen[f'null_{c}']} missing values of {c}" for c in given if seen[f"null_{c}"] and c not in NULLABLE_FEATURES]
    wrong += [f"{seen[f'infinite_{c}']} infinities of {c}" for c in given if seen[f"infinite_{c}"]]
    if wrong:
        raise IntegrityError("; ".join(wrong))
    return {"rows": seen["rows"], "partitions": sizes, "missing": {c: seen[f"null_{c}"] for c in given}, "features": given, "matrix_bytes": 8 * len(given) * seen["rows"]}


def tier_matrix(features: DataFrame, tier: str, key: str) -> DataFrame:
    """Key and the vector of a tier's columns (core: 9, enhanced: 11) in their order; nulls become NaN."""
    columns = {"core": CORE_FEATURES, "enhanced": ENHANCED_FEATURES}[tier]
    filled = features.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])
    return VectorAssembler(inputCols=columns, outputCol="vector", handleInvalid="keep").transform(filled).select(key, "vector")


def sample_rows(rows: DataFrame, most: int = 10_000, seed: int = SEED, key: str = "txn_key") -> DataFrame:
    """most rows at random without replacement (all, if there are fewer), the same for the same seed and keys: those with the least hashes."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def prepare(train: DataFrame, columns: tuple[str, ...]) -> tuple[dict[str, float], dict[str, tuple[float, float]], int]:
    """Medians (exact, interpolated; 0 for a column without values), population mean and deviation after filling, and the number of rows, from train only."""
    medians = {c: 0.0 if v is None else v for c, (v,) in quantiles(train, list(columns), [0.5]).items()}
    filled = train.fillna(medians)
    moments = filled.agg(F.count("*").alias("rows__n"), *[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]).first()
    return medians, {c: (moments[f"{c}__m"], moments[f"{c}__s"] or 1.0) for c in columns}, moments["rows__n"]


def standardised(df: DataFrame, columns: tuple[str, ...], medians: dict[str, float], scales: dict[str, tuple[float, float]]) -> DataFrame:
    ready = df.fillna(medians).withColumns({c: (F.col(c) - m) / s for c, (m, s) in scales.items()})
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(ready)


def boosting() -> Boosting:
    return Boosting(iterations=100, leaves=15, least_rows=50, rate=0.1, l2=1.0, bins=255)


class Fitted:
    """A fitted model that scores any rows of the same columns."""

    def __init__(self, spec: Spec, train: DataFrame):
        """Raises ConvergenceError where a logistic model is not done after MAX_ITERATIONS."""
        self.spec = spec
        if spec.kind == "baseline":
            self.rate = float(train.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0)
        elif spec.kind == "logistic":
            self.medians, self.scales, n = prepare(train, spec.columns)
            # L2 with C = 1 over sums of losses is regParam = 1 / n over their mean
            self.model = LogisticRegression(labelCol="label", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=MAX_ITERATIONS, tol=1e-8).fit(standardised(train, spec.columns, self.medians, self.scales))
            if self.model.summary.totalIterations >= MAX_ITERATIONS:
                raise ConvergenceError(f"{spec.name} is not done after {MAX_ITERATIONS} iterations")
        else:
            self.model = boosting().fit(train, list(spec.columns))

    def coefficients(self) -> dict[str, float]:
        """A logistic model's coefficients of the standardised columns."""
        return dict(zip(self.spec.columns, map(float, self.model.coefficients)))

    def score(self, df: DataFrame) -> DataFrame:
        if self.spec.kind == "baseline":
            return df.select(*[c for c in df.columns if c not in self.spec.columns], F.lit(self.rate).alias("score"))
        kept = [c for c in df.columns if c not in self.spec.columns]
        if self.spec.kind == "boosting":
            return self.model.score(df, list(self.spec.columns)).select(*kept, "score")
        return self.model.transform(standardised(df, self.spec.columns, self.medians, self.scales)).select(*kept, vector_to_array("probability")[1].alias("score"))


def fit_and_select(train: DataFrame, validation: DataFrame, specs: list[Spec] = SPECS) -> tuple[list[tuple[Fitted, float, float]], int]:
    """Each model with its validation AP and its best-F1 threshold, and the index of the one with the largest AP (the first of equals). Test rows have no way in."""
    made = []
    for spec in specs:
        fitted = Fitted(spec, train)
        scored = fitted.score(validation)
        ap = metrics.average_precision(scored).first()[0]
        made.append((fitted, ap if ap is not None else 0.0, metrics.best_threshold(scored).first()[0]))
    return made, max(range(len(made)), key=lambda i: (made[i][1], -i))


def prevalence_baseline(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows scored with train's share of positives."""
    return rows.crossJoin(F.broadcast(train.agg(F.avg(F.col("label").cast("double")).alias("score"))))


def evaluate(scored: DataFrame, threshold: float) -> DataFrame:
    """One row of threshold metrics, AP and ROC-AUC."""
    return metrics.threshold_metrics(scored, threshold).join(metrics.average_precision(scored)).join(metrics.roc_auc(scored))


def permuted(rows: DataFrame, columns: list[str], key: str, repeats: int = 3, seed: int = SEED) -> DataFrame:
    """All rows once for each column and repeat, with that column's values dealt to them by the order of a seeded hash of the key, and once as they are (column null). Adds column and repeat.

    Both sides are numbered in parallel, once for all columns.
    """
    held = materialize(rows, "permuted")
    ordered = with_row_number(held, [key], "__a", 0)
    values = [with_row_number(held.select(*[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)], F.xxhash64(F.lit(seed + r), key).alias("__h"), F.col(key).alias("__k")), ["__h", "__k"], "__a", 0).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    both = materialize(ordered.join(reduce(DataFrame.unionByName, values).drop("__h", "__k"), "__a"), "dealt")
    others = [c for c in held.columns if c not in columns]
    tall = [both.select(*others, *[F.col(f"__v{i}" if c == d else d).alias(d) for d in columns], F.lit(c).alias("column"), "repeat") for i, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, tall, held.select(*others, *columns, F.lit(None).cast("string").alias("column"), F.lit(-1).alias("repeat")))


def permutation_importance(fitted: Fitted, rows: DataFrame, key: str, repeats: int = 3) -> list[tuple[str, float, float]]:
    """(column, mean and population deviation of the AP lost) by column. rows are a bounded sample: all permutations are scored in one pass, and each one's curve is one group."""
    columns = list(fitted.spec.columns)
    scored = materialize(fitted.score(permuted(rows.select(key, "label", *columns), columns, key, repeats)), "permutations")
    found = {(r["column"], r["repeat"]): r["average_precision"] or 0.0 for r in metrics.grouped_average_precision(scored, ["column", "repeat"]).collect()}  # a row per column and repeat
    base, out = found[None, -1], []
    for c in columns:
        lost = [base - found[c, r] for r in range(repeats)]
        mean = sum(lost) / repeats
        out.append((c, mean, (sum((x - mean) ** 2 for x in lost) / repeats) ** 0.5))
    return out


def explain(models: list[Fitted], validation: DataFrame, key: str) -> dict[str, dict]:
    """Standardised coefficients of the logistic models, and the AP that the boosting models lose on a sample of validation rows when a column is permuted."""
    sample, out = materialize(sample_rows(validation, IMPORTANCE_ROWS, key=key), "sample"), {}
    for fitted in models:
        if fitted.spec.kind == "logistic":
            out[fitted.spec.name] = {"standardised_coefficients": fitted.coefficients()}
        elif fitted.spec.kind == "boosting":
            out[fitted.spec.name] = {"validation_ap_decrease": {c: {"mean": m, "deviation": d} for c, m, d in permutation_importance(fitted, sample, key)}}
    return out
