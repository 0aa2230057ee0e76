"""Model jobs on Spark ML: weights, selection, fitting, scoring, persistence.

A scorer takes a DataFrame with feature columns and adds a prediction column; `inputs`
replaces chosen features by other columns, which is what the explanation jobs need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.functions.calendar import month_indicators
from geoseries.operators.clean import null_safe_score
from geoseries.operators.grid import assemble_features
from geoseries.operators.logistic import cross_accuracy
from geoseries.operators.metrics import accuracy, ensemble_mean, pooled_metrics, r2
from geoseries.operators.ranking import chunked_rank, row_hash
from geoseries.operators.splits import spatial_split, stratified_folds
from geoseries.schema import require_columns
from geoseries.session import temporary, written

FAMILIES = {
    "lr": LinearRegression,
    "dt": DecisionTreeRegressor,
    "rf": RandomForestRegressor,
    "gbt": GBTRegressor,
    "glr": GeneralizedLinearRegression,
}
SEEDED = {"dt", "rf", "gbt"}


@dataclass(frozen=True)
class LinearScorer:
    """Fixed linear function of the features, as a plain column expression."""

    coefficients: Mapping[str, float]
    intercept: float = 0.0

    @property
    def features(self) -> list[str]:
        return list(self.coefficients)

    def __call__(self, df: DataFrame, inputs: Mapping[str, Column] | None = None, out: str = "pred") -> DataFrame:
        inputs = inputs or {}
        terms = [F.lit(float(c)) * inputs.get(f, F.col(f)) for f, c in self.coefficients.items()]
        return df.withColumn(out, sum(terms, F.lit(float(self.intercept))))


@dataclass(frozen=True)
class ModelScorer:
    """A fitted Spark ML regression model with its ordered feature names."""

    model: object
    features: Sequence[str]

    def __call__(self, df: DataFrame, inputs: Mapping[str, Column] | None = None, out: str = "pred") -> DataFrame:
        inputs = inputs or {}
        staged = df.withColumns({f"_x_{f}": inputs.get(f, F.col(f)).cast("double") for f in self.features})
        vector = VectorAssembler(inputCols=[f"_x_{f}" for f in self.features], outputCol="_x").transform(staged)
        scored = self.model.transform(vector, {self.model.featuresCol: "_x", self.model.predictionCol: out})
        return scored.select(*[c for c in df.columns if c != out], out)


def build_features(
    df: DataFrame, time: str, label: str, drop: Sequence[str] = ("LAND_COVER", "station_idx")
) -> tuple[DataFrame, list[str]]:
    """Month indicators added and non-features dropped; returns the table and the feature order.

    Training and test rows stay one table: the split is a `status` column.
    """
    table = df.withColumns(month_indicators(F.col(time))).drop(*drop)
    features = [c for c in table.columns if c not in (time, label, "status")]
    return table, features


def assembled(df: DataFrame, features: Sequence[str], keep: Sequence[str], missing: str = "error") -> DataFrame:
    """Feature vectors; a row with a missing feature (null or NaN) ends the job, or with `missing="skip"` is left out."""
    staged = df.select(*keep, *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    vector = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="features", handleInvalid=missing)
    return vector.transform(staged).select(*keep, "features")


def _estimator(family: str, label: str, weight: str | None, params: Mapping, seed: int):
    options = dict(params)
    if family in SEEDED:
        options.setdefault("seed", seed)
    if weight:
        options["weightCol"] = weight
    return FAMILIES[family](featuresCol="features", labelCol=label, **options)


def fit_family(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    family: str,
    weight: str | None = None,
    seed: int = 2023,
    missing: str = "error",
    **params,
) -> ModelScorer:
    keep = [label, weight] if weight else [label]
    rows, estimator = assembled(train, features, keep, missing), _estimator(family, label, weight, params, seed)
    if family == "lr":
        return ModelScorer(estimator.fit(rows), list(features))
    with temporary(rows, "fit") as stored:  # all others read the rows several times, each time with all joins below
        return ModelScorer(estimator.fit(stored), list(features))


def fit_best(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    families: Mapping[str, Mapping[str, Sequence]],
    weight: str | None = None,
    folds: int = 10,
    metric: str = "r2_total",
    seed: int = 2023,
    missing: str = "error",
) -> tuple[ModelScorer, DataFrame]:
    """Best family and parameters by mean fold score, refitted on all rows.

    `families` maps a family to its parameter grid; the grid is the budget. Rows get their
    fold from a key hash, so a recomputed task sees the same folds. Also returns the score
    of every candidate. `metric` is a pooled metric; errors are minimised, the rest maximised.
    """
    keep = [label, weight] if weight else [label]
    fold = F.pmod(F.conv(F.substring(row_hash(seed, *keys), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    rows = assembled(train.withColumn("_fold", fold), features, [*keep, "_fold"], missing)
    sign = -1.0 if metric.startswith(("rmse", "ubrmse")) else 1.0
    scores = []
    with temporary(rows, "folds") as data:  # a table, so that the executors' memory is left to the fits
        for family, grid in families.items():
            for values in product(*grid.values()):
                params = dict(zip(grid, values))
                results = []
                for i in range(folds):
                    model = _estimator(family, label, weight, params, seed).fit(data.where(F.col("_fold") != i))
                    held = model.transform(data.where(F.col("_fold") == i))
                    results.append(pooled_metrics(held, [], label, "prediction").select(metric).first()[0])
                known = [x for x in results if x is not None]
                scores.append((family, params, sum(known) / len(known) if known else -sign * float("inf")))
        best = max(scores, key=lambda s: sign * s[2])
        model = _estimator(best[0], label, weight, best[1], seed).fit(data)
    table = train.sparkSession.createDataFrame(
        [(f, str(p), float(s)) for f, p, s in scores], "family string, params string, score double"
    )
    return ModelScorer(model, list(features)), table


def fit_halving(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    families: Mapping[str, Mapping[str, Sequence]],
    weight: str | None = None,
    folds: int = 10,
    metric: str = "r2_total",
    seed: int = 2023,
    missing: str = "error",
    shrink: int = 3,
    parallel: int = 4,
) -> tuple[ModelScorer, DataFrame]:
    """Best family and parameters by successive halving: the budget goes to the candidates that keep up.

    Of c candidates, each round keeps the best c / `shrink` and gives the next one `shrink` times the rows. Early rounds learn
    from a hashed share of the rows outside of one fold and are judged on that share of the fold; the last round, of at most
    `shrink` candidates, judges on all rows and all folds. `parallel` fits run at a time on one stored table. Returns the
    winner refitted on all rows, and a row for each candidate and round: `round`, `share` of the rows, `score`, `survives`.
    """
    keep = [label, weight] if weight else [label]
    number = lambda salt: F.conv(F.substring(row_hash(f"{seed}{salt}", *keys), 1, 8), 16, 10).cast("long")
    placed = train.withColumns({"_fold": F.pmod(number(""), F.lit(folds)).cast("int"), "_part": number(":share")})
    spread = assembled(placed, features, [*keep, "_fold", "_part"], missing).hint("rebalance")
    sign = -1.0 if metric.startswith(("rmse", "ubrmse")) else 1.0
    alive = [(family, dict(zip(grid, values))) for family, grid in families.items() for values in product(*grid.values())]
    rounds = 1
    while shrink**rounds < len(alive):
        rounds += 1
    found = []

    def judged(candidate, fold, rows):
        model = _estimator(candidate[0], label, weight, candidate[1], seed).fit(rows.where(F.col("_fold") != fold))
        held = model.transform(rows.where(F.col("_fold") == fold))
        return pooled_metrics(held, [], label, "prediction").select(metric).first()[0]

    with temporary(spread, "halving") as data:
        with ThreadPoolExecutor(parallel) as pool:
            for i in range(rounds):
                last = i == rounds - 1
                share = 1.0 / shrink ** (rounds - 1 - i)
                rows = data if last else data.where(F.col("_part") < int(share * (1 << 32)))
                tried = list(range(folds)) if last else [i % folds]
                scores = list(pool.map(lambda job: judged(*job, rows), [(c, f) for c in alive for f in tried]))
                known = [[x for x in scores[k * len(tried) : (k + 1) * len(tried)] if x is not None] for k in range(len(alive))]
                means = [sum(x) / len(x) if x else -sign * float("inf") for x in known]
                order = sorted(range(len(alive)), key=lambda k: (-sign * means[k], k))
                best = order[: 1 if last else max(1, -(-len(alive) // shrink))]
                found += [(i, share, c[0], str(c[1]), float(m), k in best) for k, (c, m) in enumerate(zip(alive, means))]
                alive = [alive[k] for k in best]
        model = _estimator(alive[0][0], label, weight, alive[0][1], seed).fit(data)
    table = train.sparkSession.createDataFrame(found, "round int, share double, family string, params string, score double, survives boolean")
    return ModelScorer(model, list(features)), table


def fit_rf_tuned(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    min_leaf: Sequence[int] = (5, 10, 15, 20, 25),
    depth: Sequence[int] = (5, 10),
    trees: int = 100,
    folds: int = 10,
    seed: int = 2023,
) -> tuple[ModelScorer, DataFrame]:
    """Random forest tuned on leaf size and depth by rmse, by successive halving."""
    grid = {"minInstancesPerNode": list(min_leaf), "maxDepth": list(depth), "numTrees": [trees]}
    return fit_halving(train, features, label, keys, {"rf": grid}, None, folds, "rmse_total", seed)


def fit_final(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, family: str, params: Mapping, seed: int = 2023
) -> ModelScorer:
    """The chosen model refitted on training and test rows together."""
    cols = [*features, label]
    return fit_family(train.select(*cols).unionByName(test.select(*cols)), features, label, family, seed=seed, **params)


def _classifier(kind: str, seed: int, params: Mapping | None = None):
    options = dict(featuresCol="features", labelCol="Is_test")
    if kind == "lr":
        return LogisticRegression(**options, **{"maxIter": 20, **(params or {})})
    return RandomForestClassifier(**options, seed=seed, **{"numTrees": 20, "maxDepth": 5, **(params or {})})


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("Is_test", F.when(F.col("status") == "test", 1.0).otherwise(0.0))


def adversarial_weights(
    df: DataFrame, features: Sequence[str], classifier: str = "rf", seed: int = 2023, name: str = "weight",
    missing: str = "error", params: Mapping | None = None,
) -> DataFrame:
    """Weight of each training row: its predicted probability of being a test row.

    A missing covariate ends the job, or with `missing="skip"` leaves the row out of the fit and of the result.
    """
    data = _labelled(df)
    fitted = _classifier(classifier, seed, params).fit(written(assembled(data, features, ["Is_test"], missing), "labelled"))
    staged = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_x", handleInvalid=missing).transform(
        data.where(F.col("status") == "train").withColumns({f"_x_{f}": F.col(f).cast("double") for f in features})
    )
    scored = fitted.transform(staged, {fitted.featuresCol: "_x"})
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def adversarial_accuracy(
    df: DataFrame, features: Sequence[str], classifier: str = "rf", seed: int = 2023, missing: str = "error", params: Mapping | None = None
) -> DataFrame:
    """How well train and test rows can be told apart, on the fitted rows."""
    data = written(assembled(_labelled(df), features, ["Is_test"], missing), "labelled")  # read in each pass of the fit
    fitted = _classifier(classifier, seed, params).fit(data)
    return accuracy(fitted.transform(data), "Is_test", "prediction")


def adversarial_cv(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], k: int = 5, classifier: str = "rf", seed: int = 2023
) -> DataFrame:
    """Out-of-fold accuracy per fold, folds stratified by train/test label. Logistic fits (`lr`) share their passes."""
    folded = stratified_folds(_labelled(df), "Is_test", keys, k, seed, ties=features)
    if classifier == "lr":
        found = cross_accuracy(folded, features, F.array(F.col("Is_test").cast("int")), F.array("fold"), 1, k)
        return df.sparkSession.createDataFrame([(fold, share) for _, fold, share in found], "fold int, accuracy double")
    data = assembled(folded, features, ["Is_test", "fold"]).persist()
    rows = []
    try:
        for i in range(k):
            fitted = _classifier(classifier, seed).fit(data.where(F.col("fold") != i))
            rows.append((i, accuracy(fitted.transform(data.where(F.col("fold") == i)), "Is_test", "prediction").first()[0]))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def seed_sweep(
    df: DataFrame,
    station: str,
    features: Sequence[str],
    keys: Sequence[str],
    seeds: Sequence[int],
    layer: str | None = None,
    split_method: str = "spatial",
    k: int = 5,
    classifier: str = "lr",
    test: float = 0.2,
) -> DataFrame:
    """Adversarial accuracy of the station split for each seed and layer: the seed log.

    With logistic fits (`lr`) all seeds, layers and folds are fitted together, one pass over the rows a step; their folds come
    from key hashes, so each label is spread evenly over them up to chance. Other classifiers are fitted one after the other
    on folds that are stratified exactly.
    """
    used = df.select(*dict.fromkeys([station, *keys, *features, *([layer] if layer else [])]))
    layers = [r[0] for r in used.select(layer).distinct().sort(layer).collect()] if layer else [None]
    if classifier == "lr":
        rows = _sweep_together(used, station, features, keys, list(seeds), layer, layers, k, test)
    else:
        used, rows = used.persist(), []  # read once for all seeds
        try:
            for name in layers:
                part = used.where(F.col(layer) == name) if layer else used
                for seed in seeds:
                    split = spatial_split(part, station, seed, test)
                    mean = adversarial_cv(split, features, keys, k, classifier, seed).agg(F.avg("accuracy")).first()[0]
                    rows.append((name, seed, mean))
        finally:
            used.unpersist()
    result = [(float(mean), split_method, name, int(seed)) for name, seed, mean in rows]
    return df.sparkSession.createDataFrame(result, "accuracy double, split_method string, layer string, seed int")


def _sweep_together(used, station, features, keys, seeds, layer, layers, k, test) -> list[tuple]:
    """(layer, seed, mean accuracy over folds) of logistic fits."""
    number = F.coalesce(*[F.when(F.col(layer) == name, i) for i, name in enumerate(layers)]) if layer else F.lit(0)
    used = used.withColumn("_layer", number.cast("int"))
    spread = used.hint("rebalance")  # a file of one row group would be hashed and learned from in one task
    every = used.select("_layer", station).distinct().withColumn("_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = every.withColumn("_h", F.md5(F.concat_ws(":", F.col("_seed").cast("string"), F.col(station).cast("string"))))
    ranked = chunked_rank(hashed, ["_layer", "_seed"], ["_h"], None, "_rn", "_n")
    last = ranked.where(F.col("_rn") == F.ceil(F.col("_n") * F.lit(test))).select("_layer", "_seed", "_h").collect()  # a row for each layer and seed
    limit = {(r["_layer"], r["_seed"]): r["_h"] for r in last}
    limits = F.array(*[F.array(*[F.lit(limit.get((i, s), "")) for s in seeds]) for i in range(len(layers))])
    own = F.get(limits, F.col("_layer"))
    held = F.array(*[(row_hash(s, station) <= own[i]).cast("int") for i, s in enumerate(seeds)])
    texts = [F.col(c).cast("string") for c in keys]  # joined once for all seeds; no part where all are null
    spread = spread.withColumn("_id", F.when(F.coalesce(*texts).isNotNull(), F.concat_ws(":", *texts)))
    fold = F.array(*[F.conv(F.substring(row_hash(f"{s}:fold", "_id"), 1, 8), 16, 10).cast("long") % k for s in seeds]).cast("array<int>")
    found = cross_accuracy(spread, features, held, fold, len(layers) * len(seeds), k, F.col("_layer") * len(seeds))
    means = {}
    for group, _, share in found:
        means.setdefault(group, []).append(share)
    return [(layers[g // len(seeds)], seeds[g % len(seeds)], sum(x) / len(x)) for g, x in sorted(means.items())]


def score_test(scorer, test: DataFrame, station: str, time: str, label: str) -> DataFrame:
    """Hold-out score table."""
    scored = scorer(test)
    return scored.select(
        F.col(station).alias("station_idx"), F.col(time).alias("date_time"), "pred", F.col(label).alias("true")
    )


def train_r2(scorer, df: DataFrame, label: str) -> DataFrame:
    return scorer(df).agg(r2(label, "pred").alias("r2"))


def _inference_rows(static, dynamic, features, time, on):
    rows = assemble_features(static, dynamic, on, time)
    rows = rows.withColumns({k: v for k, v in month_indicators(F.col(time)).items() if k in features})
    keys = [time, *on]
    return require_columns(rows, [*keys, *[f for f in features if f not in keys]]), keys


def _score_each(rows: DataFrame, scorers: Mapping[str, object]) -> DataFrame:
    """A prediction column `_p_<name>` per model, null where that model's features are missing."""
    for name, scorer in scorers.items():
        out = f"_p_{name}"
        rows = null_safe_score(rows, scorer.features, lambda df, s=scorer, o=out: s(df, None, o), out)
    return rows


def predict_grid(
    scorer, static: Sequence[DataFrame], dynamic: Sequence[DataFrame], time: str = "time", on: Sequence[str] = ("lat_i", "lon_i")
) -> DataFrame:
    """Prediction for every cell and day in one plan; null where any covariate is missing."""
    rows, keys = _inference_rows(static, dynamic, scorer.features, time, on)
    return _score_each(rows, {"one": scorer}).select(*keys, F.col("_p_one").alias("sm"))


def predict_ensemble(
    scorers: Mapping[str, object], static: Sequence[DataFrame], dynamic: Sequence[DataFrame], time: str = "time",
    on: Sequence[str] = ("lat_i", "lon_i"),
) -> DataFrame:
    """Mean prediction of several models with the same features."""
    first = next(iter(scorers.values()))
    if any(list(s.features) != list(first.features) for s in scorers.values()):
        raise ValueError("ensemble members must share their feature list")
    rows, keys = _inference_rows(static, dynamic, first.features, time, on)
    return ensemble_mean(_score_each(rows, scorers), [f"_p_{n}" for n in scorers], "sm").select(*keys, "sm")


def predict_best(
    scorers: Mapping[str, object], best: Mapping[str, str], static: Sequence[DataFrame], dynamic: Sequence[DataFrame],
    time: str = "time", on: Sequence[str] = ("lat_i", "lon_i"),
) -> DataFrame:
    """Per layer, the prediction of that layer's best model.

    Covariates are joined once and each model scores once, however many layers use it.
    """
    used = {name: scorers[name] for name in dict.fromkeys(best.values())}
    features = list(dict.fromkeys(f for s in used.values() for f in s.features))
    rows, keys = _inference_rows(static, dynamic, features, time, on)
    layers = [F.struct(F.lit(layer).alias("layer"), F.col(f"_p_{name}").alias("sm")) for layer, name in best.items()]
    return _score_each(rows, used).select(*keys, F.inline(F.array(*layers)))


def save_model(scorer: ModelScorer, path: str) -> None:
    """Assembler and model together; the assembler carries the ordered feature names."""
    assembler = VectorAssembler(inputCols=list(scorer.features), outputCol="features")
    PipelineModel([assembler, scorer.model]).write().overwrite().save(path)


def load_model(path: str) -> ModelScorer:
    assembler, model = PipelineModel.load(path).stages
    return ModelScorer(model, assembler.getInputCols())
