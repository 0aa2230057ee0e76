"""Explanation jobs: many perturbed copies of a table are scored in one plan.

Perturbed copies are made by narrow explodes, so the large intermediate is never
shuffled: only its per-feature or per-bin partial sums are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoseries.operators.boxes import has_boxes, tree_curves, tree_dependence, tree_effects, tree_shapley, tree_swapped
from geoseries.operators.metrics import r2, top_feature
from geoseries.operators.permutation import permuted, repeat_key
from geoseries.operators.quantiles import exact_percentiles
from geoseries.operators.ranking import CHUNK_ROWS, chunked_rank, row_hash
from geoseries.session import bucketed, stable, written


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def feature_grids(
    df: DataFrame, features: Sequence[str], points: int = 100, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Grid per feature: its distinct values when there are few, else even steps between two percentiles."""
    # A sketch settles the features with many more values than points (its error is a few percent); only the others
    # have their distinct values counted, and those are few.
    about = df.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()  # one row
    maybe = [f for f in features if about[f] < 2 * points]
    few = []
    if maybe:
        counts = _long(df, maybe).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
        few = [row["feature"] for row in counts.collect() if row["k"] < points]  # one row per feature
    rest = [f for f in features if f not in few]
    grids = []
    if few:
        grids.append(_long(df, few).distinct().groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("grid")))
    if rest:
        ends = exact_percentiles(_long(df, rest), ["feature"], "value", [low, high], "_e", alpha=0.4)
        steps = F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)),
            lambda i: F.col("_e")[0] + (F.col("_e")[1] - F.col("_e")[0]) * i / F.lit(float(points - 1)),
        )
        grids.append(ends.select("feature", steps.alias("grid")))
    return reduce(DataFrame.unionByName, grids)


def _as_map(grids: DataFrame, name: str) -> Column:
    return grids.agg(F.map_from_entries(F.collect_list(F.struct("feature", name)))).scalar()


def _swapped(features: Sequence[str], value: Column) -> dict[str, Column]:
    """Inputs in which only the row's `feature` is replaced by `value`."""
    return {f: F.when(F.col("feature") == f, value).otherwise(F.col(f)) for f in features}


def _on_grid(df: DataFrame, grids: DataFrame) -> DataFrame:
    with_grids = df.withColumn("_grids", _as_map(grids, "grid"))
    per_feature = with_grids.select(*df.columns, F.explode("_grids").alias("feature", "_grid"))
    return per_feature.select(
        *df.columns, "feature", F.col("_grid")[0].alias("_start"), F.posexplode("_grid").alias("point", "grid_value")
    )


def pdp(score, df: DataFrame, features: Sequence[str], points: int = 100, exclude: Sequence[str] = ()) -> DataFrame:
    """Partial dependence: mean prediction over all rows with the feature set to each grid value (closed form for linear models)."""
    chosen = [f for f in features if f not in exclude]
    grids = feature_grids(df, chosen, points)
    if hasattr(score, "coefficients"):  # the mean over rows of a linear model needs no copies of the rows
        own = {f: F.lit(float(c)) for f, c in score.coefficients.items()}
        rest = {f: sum((own[g] * F.col(g) for g in own if g != f), F.lit(float(score.intercept))) for f in chosen}
        means = df.agg(*[F.avg(rest[f]).alias(f) for f in chosen]).first()  # one row
        slope, base = (F.coalesce(*[F.when(F.col("feature") == f, v) for f, v in values.items()]) for values in (own, {f: F.lit(means[f]) for f in chosen}))
        return grids.select("feature", F.posexplode("grid").alias("point", "grid_value")).withColumn("pd", base + slope * F.col("grid_value"))
    if has_boxes(score) and set(chosen) <= set(score.features):
        found = {row["feature"]: list(row["grid"]) for row in grids.collect()}  # a row for each feature
        means = tree_dependence(score, df, found)
        rows = [(f, i, float(x), means[f][i]) for f, grid in found.items() for i, x in enumerate(grid)]
        return df.sparkSession.createDataFrame(rows, "feature string, point int, grid_value double, pd double")
    rows = _on_grid(df.select(*score.features), grids)
    scored = score(rows, _swapped(score.features, F.col("grid_value")))
    return scored.groupBy("feature", "point", "grid_value").agg(F.avg("pred").alias("pd"))


def ice(
    score, df: DataFrame, keys: Sequence[str], features: Sequence[str], points: int = 100, fraction: float = 1.0, seed: object = 2023
) -> DataFrame:
    """Curves of single rows, centred at the first grid point; with a `fraction` below one, of a seeded share of the rows."""
    grids = feature_grids(df, features, points)
    rows = df.select(*keys, *[f for f in score.features if f not in keys])
    if fraction < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(str(seed)), *keys), F.lit(1 << 30)) < int(fraction * (1 << 30)))
    if has_boxes(score) and set(features) <= set(score.features):
        found = {row["feature"]: list(row["grid"]) for row in grids.collect()}  # a row for each feature
        lines = tree_curves(score, rows, keys, found)
        each = [
            F.struct(F.lit(f).alias("feature"), F.array(*[F.lit(float(x)) for x in grid]).alias("_grid"), F.col(f"_c{j}").alias("_curve"))
            for j, (f, grid) in enumerate(found.items())
        ]
        single = lines.select(*keys, F.inline(F.array(*each))).select(*keys, "feature", "_grid", F.posexplode("_curve").alias("point", "ice"))
        return single.select(*keys, "feature", "point", F.get("_grid", F.col("point")).alias("grid_value"), "ice")
    if hasattr(score, "coefficients"):  # a line: no copy has to be scored
        found = {row["feature"]: list(row["grid"]) for row in grids.collect()}  # a row for each feature
        if found:
            return _line_curves(score, rows, keys, found)
    rows = _on_grid(rows, grids)
    scored = score(rows, _swapped(score.features, F.col("grid_value")))
    based = score(scored, _swapped(score.features, F.col("_start")), "_base")
    return based.select(*keys, "feature", "point", "grid_value", (F.col("pred") - F.col("_base")).alias("ice"))


def _line_curves(score, rows: DataFrame, keys: Sequence[str], grids: dict[str, list[float]]) -> DataFrame:
    """Curves of a linear model: coefficient times distance from the first grid value, in rows whose other features are known."""
    own = {f: F.lit(float(c)) for f, c in score.coefficients.items()}
    each = []
    for f, grid in grids.items():
        rest = sum((own[g] * F.col(g) for g in own if g != f), F.lit(0.0))
        steps = F.array(*[F.struct(F.lit(float(x)).alias("grid_value"), F.lit(float(score.coefficients.get(f, 0.0) * (x - grid[0]))).alias("step")) for x in grid])
        each.append(F.struct(F.lit(f).alias("feature"), (rest - rest).alias("_none"), steps.alias("_steps")))
    lines = rows.select(*keys, F.inline(F.array(*each)))
    single = lines.select(*keys, "feature", "_none", F.posexplode("_steps").alias("point", "_at"))
    return single.select(*keys, "feature", "point", "_at.grid_value", (F.col("_at.step") + F.col("_none")).alias("ice"))


def ice_summary(curves: DataFrame) -> DataFrame:
    """Number, mean, lowest and highest of the curves at each grid point."""
    return curves.groupBy("feature", "point", "grid_value").agg(
        F.count("ice").alias("n"), F.avg("ice").alias("mean"), F.min("ice").alias("lowest"), F.max("ice").alias("highest")
    )


def _scored_effects(score, df: DataFrame, features: Sequence[str], edges: DataFrame, bins: int) -> DataFrame:
    """`feature`, `bin`, `_effect`, `n`: mean change of the prediction across each bin, each row scored at both of its edges."""
    with_edges = df.select(*score.features).withColumn("_edges", _as_map(edges, "edges"))
    per = with_edges.select(*score.features, F.explode("_edges").alias("feature", "edges"))
    own = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("double")) for f in features])
    # one comparison per edge, compiled, instead of a lambda over the array
    below = sum((F.coalesce((F.get("edges", F.lit(k)) < F.col("_own")).cast("int"), F.lit(0)) for k in range(bins + 1)), F.lit(0))
    placed = (
        per.withColumn("_own", own)
        .where(F.col("_own").isNotNull() & (F.size("edges") > 1))
        .withColumn("bin", F.greatest(F.lit(1), below))
        .withColumn("_lo", F.element_at("edges", F.col("bin")))
        .withColumn("_hi", F.element_at("edges", F.col("bin") + 1))
    )
    low = score(placed, _swapped(score.features, F.col("_lo")), "_f_lo")
    both = score(low, _swapped(score.features, F.col("_hi")), "_f_hi")
    return both.groupBy("feature", "bin").agg(
        F.avg(F.col("_f_hi") - F.col("_f_lo")).alias("_effect"), F.count(F.lit(1)).alias("n")
    )


def ale(score, df: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Accumulated local effects at the bin edges, centred on the mean effect."""
    probs = [i / bins for i in range(bins + 1)]
    edges = stable(
        exact_percentiles(_long(df, features), ["feature"], "value", probs, "_p").select(
            "feature", F.array_distinct("_p").alias("edges")
        )
    )
    if has_boxes(score) and set(features) <= set(score.features):
        found = {row["feature"]: list(row["edges"]) for row in edges.collect()}  # a row for each feature
        rows = tree_effects(score, df, {f: e for f, e in found.items() if len(e) > 1})
        effects = df.sparkSession.createDataFrame(rows, "feature string, bin int, _effect double, n long")
    else:
        effects = _scored_effects(score, df, features, edges, bins)
    every = edges.select("feature", F.posexplode("edges").alias("bin", "edge"))
    order = Window.partitionBy("feature").orderBy("bin")
    summed = (
        every.join(effects, ["feature", "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("_acc", F.sum(F.coalesce("_effect", F.lit(0.0))).over(order))
        .withColumn("_mid", (F.col("_acc") + F.lag("_acc").over(order)) / 2)
    )
    whole = Window.partitionBy("feature")
    centre = F.sum(F.coalesce("_mid", F.lit(0.0)) * F.col("n")).over(whole) / F.nullif(
        F.sum("n").over(whole).cast("double"), F.lit(0.0)
    )
    return summed.select("feature", "bin", "edge", (F.col("_acc") - centre).alias("ale"), "n")


def with_donors(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], repeats: int, seed: object, by: Sequence[str] = (),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Each row beside the row a seeded permutation puts in its place, once per repeat.

    The rows of each group are ranked once, by key hashes over balanced chunks. Each repeat then is a one-to-one mapping of
    these positions computed by arithmetic, so only positions and features move, and every row is used exactly once per repeat.
    With `keep`, other columns are left behind as soon as the keys are hashed.
    """
    placed = _placed(df, keys, features, seed, by, keep)
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    sent = _sent(placed.withColumn("repeat", repeat), features, seed, by)
    return placed.drop("_n").join(sent, [*by, "_pos"]).drop("_pos")


def _placed(df: DataFrame, keys: Sequence[str], features: Sequence[str], seed: object, by: Sequence[str], keep: Sequence[str] | None) -> DataFrame:
    """`df` with `_pos`, the place of a row in the seeded order of its group, from 0 on, and `_n`, the size of the group.

    Md5 hashes are spread evenly, so their first bits number the chunks; where repeated keys make some chunks far larger than
    others, chunks are cut as for any other order. `df` is read twice.
    """
    ties = [f for f in features if f not in keys]
    kept = df.columns if keep is None else list(dict.fromkeys([*by, *keep, *features]))
    hashed = df.withColumn("_hash", F.unhex(row_hash(f"{seed}:base", *keys))).select(*kept, "_hash")
    chunk = F.lit(0)
    if not by:
        bits = F.conv(F.hex(F.substring("_hash", 1, 4)), 16, 10).cast("long")
        chunk = F.floor(bits * max(1, -(-df.count() // CHUNK_ROWS)) / (1 << 32))
    sizes = stable(hashed.groupBy(*by, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_size")))
    given = {"chunk": chunk, "sizes": sizes} if (sizes.agg(F.max("_size")).first()[0] or 0) <= 4 * CHUNK_ROWS else {}
    ranked = chunked_rank(hashed, by, ["_hash", *ties], name="_pos", total="_n", **given)
    return written(ranked.select(*kept, (F.col("_pos") - 1).alias("_pos"), "_n"), "placed")


def _sent(placed: DataFrame, features: Sequence[str], seed: object, by: Sequence[str]) -> DataFrame:
    """`by`, `_pos`, `repeat` and the features, as `donor_<feature>`, of the row that a repeat's mapping sends to this place."""
    source = placed.select(*by, F.col("_pos").alias("_from"), "_n", *[F.col(f).alias(f"donor_{f}") for f in features], "repeat")
    return permuted(source, "_from", "_n", repeat_key(seed, F.col("repeat")), "_pos").drop("_from", "_n")


def _each_feature(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))


def permutation_importance(
    score, df: DataFrame, keys: Sequence[str], label: str, repeats: int = 5, seed: object = 2023, by: Sequence[str] = ()
) -> DataFrame:
    """Drop in r2 when a feature's values are permuted; mean and population deviation over repeats."""
    raw = permutation_scores(score, df, keys, label, repeats, seed, by)
    return raw.groupBy(*by, "feature").agg(
        F.avg("value").alias("importance"), F.stddev_pop("value").alias("importance_std")
    )


def permutation_scores(
    score, df: DataFrame, keys: Sequence[str], label: str, repeats: int = 5, seed: object = 2023, by: Sequence[str] = ()
) -> DataFrame:
    """One row per feature and repeat: baseline r2 minus permuted r2.

    Each row is scored once for every feature, beside one another, so rows are not repeated for features. Rows stay in buckets
    of places; only donors move to them.
    """
    by, features = list(by), list(score.features)
    used = df.select(*dict.fromkeys([*by, *keys, *features, label]))
    placed = _placed(used, keys, features, seed, by, [label])
    found = []
    # one repeat after the other on one table: what is moved for a repeat is gone before the next one
    with bucketed(placed, "placed", [*by, "_pos"], placed.count()) as table:
        base = stable(score(table).groupBy(*by).agg(r2(label, "pred").alias("_base")))
        for repeat in range(repeats):
            rows = table.drop("_n").join(_sent(table.withColumn("repeat", F.lit(repeat)), features, seed, by), [*by, "_pos"])
            if has_boxes(score):
                rows = tree_swapped(score, rows, [*by, "repeat", label], [f"donor_{f}" for f in features], [f"_p{i}" for i in range(len(features))])
            else:
                for i, f in enumerate(features):
                    rows = score(rows, {f: F.col(f"donor_{f}")}, f"_p{i}")
            found.append(written(rows.groupBy(*by, "repeat").agg(*[r2(label, f"_p{i}").alias(f"_r{i}") for i in range(len(features))]), "repeat"))
    permuted = reduce(DataFrame.unionByName, found)
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_r{i}").alias("_r2")) for i, f in enumerate(features)])
    permuted = permuted.select(*by, "repeat", F.inline(each))
    if by:
        joined = permuted.join(base, by)
    else:
        joined = permuted.withColumn("_base", base.scalar())
    return joined.select(*by, "feature", "repeat", (F.col("_base") - F.col("_r2")).alias("value"))


def shapley_values(
    score, df: DataFrame, keys: Sequence[str], draws: int = 8, seed: object = 2023, carry: Sequence[str] = ()
) -> DataFrame:
    """Shapley value of each feature for each row against the whole table; `carry` columns are kept.

    Exact for linear models and for trees, forests and boosted trees. For others the mean of `draws` draws: one takes a random other row of the table and a random
    feature order, and counts both that order and its reverse; a feature's share is the change of the prediction when it
    switches from the other row's value to its own, the features before it in the order already switched.
    """
    if hasattr(score, "coefficients"):
        return linear_shapley(score, df, list(dict.fromkeys([*carry, *keys])))
    if has_boxes(score):
        return tree_shapley(score, df, list(dict.fromkeys([*carry, *keys])))
    features = list(score.features)
    rows = with_donors(df, keys, features, draws, seed)
    # a random 64-bit mark per feature gives the order; the low bits keep marks apart
    marks = {
        f: F.shiftleft(F.xxhash64(F.lit(str(seed)), F.col("repeat"), *keys, F.lit(f)), 10) + F.lit(i)
        for i, f in enumerate(features)
    }
    marked = rows.withColumns({f"_m_{f}": m for f, m in marks.items()})
    at = F.coalesce(*[F.when(F.col("feature") == f, F.col(f"_m_{f}")) for f in features])
    scored = _each_feature(marked, features).withColumn("_at", at)
    own, other = (lambda f: F.col(f)), (lambda f: F.col(f"donor_{f}"))
    before = {f: F.col(f"_m_{f}") < F.col("_at") for f in features}
    after = {f: F.col(f"_m_{f}") > F.col("_at") for f in features}
    # those before (or, in the reverse order, after) the feature have the row's values; with and without the feature itself
    states = {
        "_a": {f: F.when(after[f], other(f)).otherwise(own(f)) for f in features},
        "_b": {f: F.when(before[f], own(f)).otherwise(other(f)) for f in features},
        "_c": {f: F.when(before[f], other(f)).otherwise(own(f)) for f in features},
        "_d": {f: F.when(after[f], own(f)).otherwise(other(f)) for f in features},
    }
    for name, inputs in states.items():
        scored = score(scored, inputs, name)
    phi = (F.col("_a") - F.col("_b") + F.col("_c") - F.col("_d")) / 2
    names = list(dict.fromkeys([*carry, *keys]))
    return scored.groupBy(*names, "feature").agg(F.avg(phi).alias("phi"))


def shapley_importance(
    score, df: DataFrame, keys: Sequence[str], draws: int = 8, seed: object = 2023, by: Sequence[str] = ()
) -> DataFrame:
    """Mean absolute Shapley value per feature, over the rows of each `by` group; values are against the whole table."""
    values = shapley_values(score, df, keys, draws, seed, by)
    return values.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def linear_shapley(scorer, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact values for a linear model: coefficient times distance from the feature mean."""
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in scorer.features]).alias("_m")).scalar()
    shares = [
        F.struct(F.lit(f).alias("feature"), (F.lit(float(c)) * (F.col(f) - F.col(f"_m.{f}"))).alias("phi"))
        for f, c in scorer.coefficients.items()
    ]
    return df.withColumn("_m", means).select(*keys, F.inline(F.array(*shares)))


def station_top_features(
    score, df: DataFrame, keys: Sequence[str], label: str, station: str, repeats: int = 5, draws: int = 8, seed: object = 2023
) -> DataFrame:
    """Main driver of each station by permutation importance and by mean absolute Shapley value."""
    pi = permutation_importance(score, df, keys, label, repeats, seed, [station])
    si = shapley_importance(score, df, keys, draws, seed, [station])
    a = top_feature(pi, [station]).select(station, F.col("variable").alias("pi_variable"), F.col("value").alias("pi_value"))
    b = top_feature(si, [station]).select(station, F.col("variable").alias("si_variable"), F.col("value").alias("si_value"))
    return a.join(b, station, "full_outer")
