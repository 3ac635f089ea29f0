"""Ordered logit ``P(Y <= k) = logistic(cut_k - x beta)``, fitted by Spark aggregation.

Rows are first counted per distinct (predictors, outcome) cell. Each Newton step is one aggregate over the cells
that returns the gradient and Hessian sums; only those few numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneloom.functions.scalars import ordinal
from zoneloom.session import cut_lineage

# Standard error of a slope, per deviation of its predictor, beyond which the likelihood is flat: no maximum exists.
MAX_ERROR = 100.0
# Draws times parameters that go to the tasks at once.
MAX_BROADCAST_NUMBERS = 5_000_000


@dataclass(frozen=True)
class OrdinalFit:
    levels: tuple[str, ...]
    predictors: tuple[str, ...]
    beta: tuple[float, ...]
    cuts: tuple[float, ...]
    covariance: np.ndarray
    log_likelihood: float
    gradient: tuple[float, ...]
    steps: int

    @property
    def terms(self) -> list[str]:
        return [*self.predictors, *(f"{a}|{b}" for a, b in zip(self.levels, self.levels[1:]))]


def ordinal_cells(df: DataFrame, outcome: str, predictors: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Row counts per distinct predictors and outcome; rows with anything missing are left out."""
    rows = df.select(ordinal(outcome, levels).alias("y"), *[F.col(p).cast("double").alias(p) for p in predictors])
    return rows.dropna("any").groupBy("y", *predictors).agg(F.count(F.lit(1)).alias("n"))


def _number(value: float) -> str:
    return f"double('{float(value)!r}')"


def _linear(predictors: Sequence[str], beta: Sequence[float]) -> str:
    return " + ".join(f"`{p}` * {_number(b)}" for p, b in zip(predictors, beta)) or "double(0)"


def _score(cells: DataFrame, predictors: Sequence[str], k: int, theta: np.ndarray):
    """Log-likelihood, gradient and Hessian at ``theta``, and the smallest cell probability."""
    p = len(predictors)
    cuts = "array(" + ", ".join(_number(c) for c in theta[p:]) + ")"
    bounds = cells.selectExpr("*", f"{_linear(predictors, theta[:p])} as eta").selectExpr(
        "*",
        f"if(y < {k}, 1 / (1 + exp(eta - try_element_at({cuts}, y))), double(1)) as upper_p",
        f"if(y > 1, 1 / (1 + exp(eta - try_element_at({cuts}, y - 1))), double(0)) as lower_p",
    )
    slopes = bounds.selectExpr(
        "*", "upper_p - lower_p as cell_p", "upper_p * (1 - upper_p) as du", "lower_p * (1 - lower_p) as dl"
    ).selectExpr("*", "du * (1 - 2 * upper_p) as hu", "dl * (1 - 2 * lower_p) as hl")
    # Derivative of the upper and of the lower argument with respect to each parameter.
    upper = [f"-`{name}`" for name in predictors] + [f"if(y = {j}, 1, 0)" for j in range(1, k)]
    lower = [f"-`{name}`" for name in predictors] + [f"if(y = {j + 1}, 1, 0)" for j in range(1, k)]
    m = p + k - 1
    graded = slopes.selectExpr("*", *[f"(du * ({upper[j]}) - dl * ({lower[j]})) / cell_p as g{j}" for j in range(m)])
    sums = [F.expr("sum(n * ln(cell_p)) as ll"), F.expr("min(cell_p) as least_p")]
    sums += [F.expr(f"sum(n * g{j}) as s{j}") for j in range(m)]
    sums += [
        F.expr(
            f"sum(n * ((hu * ({upper[i]}) * ({upper[j]}) - hl * ({lower[i]}) * ({lower[j]})) / cell_p - g{i} * g{j})) as h{i}_{j}"
        )
        for i in range(m) for j in range(i, m)
    ]
    row = graded.agg(*sums).first()
    hessian = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"] if row[f"h{i}_{j}"] is not None else np.nan
    gradient = np.array([row[f"s{j}"] if row[f"s{j}"] is not None else np.nan for j in range(m)])
    return row["ll"], gradient, hessian, row["least_p"]


def fit_ordinal(
    df: DataFrame, outcome: str, predictors: Sequence[str], levels: Sequence[str], max_steps: int = 50, tolerance: float = 1e-9
) -> OrdinalFit:
    """Maximum-likelihood fit by Newton steps, halved where a step would not raise the likelihood.

    Steps are taken for predictors brought to mean 0 and deviation 1, whatever their unit; the result is in their own.
    """
    counted = cut_lineage(ordinal_cells(df, outcome, predictors, levels))
    mean, deviation = _centres(counted, predictors)
    cells = cut_lineage(counted.withColumns({q: (F.col(q) - float(c)) / float(d) for q, c, d in zip(predictors, mean, deviation)}))
    k, p = len(levels), len(predictors)
    per_level = {r["y"]: r["n"] for r in cells.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    empty = [levels[i - 1] for i in range(1, k + 1) if not per_level.get(i)]
    if empty:
        raise ValueError(f"no rows with outcome {empty}")
    total = sum(per_level.values())
    shares = np.cumsum([per_level[i] for i in range(1, k)]) / total
    theta = np.concatenate([np.zeros(p), np.log(shares / (1 - shares))])
    level, gradient, hessian, _ = _score(cells, predictors, k, theta)
    for step in range(1, max_steps + 1):
        if np.max(np.abs(gradient)) <= tolerance * total:
            break
        try:
            move = np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError as error:
            raise ValueError("the predictors do not determine the model") from error
        scale = 1.0
        while True:
            tried = theta - scale * move
            if np.all(np.diff(tried[p:]) > 0):
                new_level, new_gradient, new_hessian, least = _score(cells, predictors, k, tried)
                if least is not None and least > 0 and new_level >= level - 1e-12 * abs(level):
                    break
            scale /= 2
            if scale < 1e-10:
                raise ValueError("no step raises the likelihood")
        theta, level, gradient, hessian = tried, new_level, new_gradient, new_hessian
    else:
        raise ValueError(f"not converged after {max_steps} steps")
    covariance = np.linalg.inv(-hessian)
    if np.max(np.diag(covariance)[:p], initial=0) > MAX_ERROR**2:
        raise ValueError("a predictor separates the outcome levels; the likelihood has no maximum")
    # The same model for the predictors as they are: slopes by deviation, cuts moved by slope times mean.
    back = np.eye(len(theta))
    back[:p, :p] = np.diag(1 / deviation)
    back[p:, :p] = mean / deviation
    own = back @ theta
    return OrdinalFit(
        tuple(levels), tuple(predictors), tuple(own[:p].tolist()), tuple(own[p:].tolist()),
        back @ covariance @ back.T, level, tuple(np.linalg.solve(back.T, gradient).tolist()), step,
    )


def _centres(cells: DataFrame, predictors: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the predictors over all rows; 1 where there is no deviation."""
    if not predictors:
        return np.zeros(0), np.ones(0)
    means = cells.agg(*[F.expr(f"sum(n * `{q}`) / sum(n)").alias(f"m{i}") for i, q in enumerate(predictors)]).first()
    mean = np.array([m if m is not None else 0.0 for m in means], float)
    spread = cells.agg(*[F.expr(f"sqrt(sum(n * pow(`{q}` - {_number(c)}, 2)) / sum(n))").alias(f"d{i}") for i, (q, c) in enumerate(zip(predictors, mean))]).first()
    deviation = np.array([d or 1.0 for d in spread], float)
    return mean, deviation


def coefficient_table(spark: SparkSession, fit: OrdinalFit) -> DataFrame:
    """``(term, estimate, std_error, t_value, p_value)``, one row per parameter."""
    rows = []
    for term, estimate, variance in zip(fit.terms, [*fit.beta, *fit.cuts], np.diag(fit.covariance).tolist()):
        error = math.sqrt(variance)
        rows.append((term, estimate, error, estimate / error, math.erfc(abs(estimate / error) / math.sqrt(2))))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")


def counterfactual_mean(
    df: DataFrame, predictors: Sequence[str], beta: Sequence[float], top_cut: float, effect: str, values: Sequence[float]
) -> DataFrame:
    """Mean probability of the top level with ``effect`` set to each value for all rows.

    Columns ``effect_value, mean_prob, difference``; the difference is the last value's mean minus the first's.
    """
    others = [p for p in predictors if p != effect]
    rows = df.select(*[F.col(p).cast("double").alias(p) for p in predictors]).dropna("any")
    cells = rows.groupBy(*others).agg(F.count(F.lit(1)).alias("n"))
    fixed = dict(zip(predictors, beta))
    rest = _linear(others, [fixed[p] for p in others])
    means = cells.agg(*[
        F.expr(f"sum(n / (1 + exp({_number(top_cut)} - ({rest} + {_number(fixed[effect] * v)})))) / sum(n)").alias(f"m{i}")
        for i, v in enumerate(values)
    ])
    pairs = ", ".join(f"{_number(v)}, m{i}" for i, v in enumerate(values))
    return means.selectExpr(
        f"stack({len(values)}, {pairs}) as (effect_value, mean_prob)", f"m{len(values) - 1} - m0 as difference"
    )


def _uniform(text: str) -> str:
    """SQL for a number between 0 and 1 that depends on the text alone."""
    return f"(cast(conv(substring(md5({text}), 1, 13), 16, 10) as bigint) + 0.5D) / 4503599627370496D"


def normal_draws(spark: SparkSession, n_draws: int, width: int, seed: int = 0) -> DataFrame:
    """``(draw, z0, z1, ...)``: standard normals by Box and Muller, each a function of seed, draw and column alone, so they
    are the same however the rows are dealt."""
    named = "concat({0}, draw, {1})".format
    normals = [
        f"sqrt(-2 * ln({_uniform(named(repr(f'{seed}:'), repr(f':{j}:r')))})) * cos(2 * pi() * {_uniform(named(repr(f'{seed}:'), repr(f':{j}:t')))}) as z{j}"
        for j in range(width)
    ]
    return spark.range(n_draws).selectExpr("cast(id as int) as draw").selectExpr("draw", *normals)


def simulate_draws(df: DataFrame, fit: OrdinalFit, effect: str, values: Sequence[float], n_draws: int = 1000, seed: int = 0) -> DataFrame:
    """``(draw, effect_value, outcome, prob)``: per draw from the fit's normal approximation, the mean over all rows.

    Rows are counted per distinct predictors. Each task keeps one sum per draw, effect value and outcome, to which it adds
    its cells, and hands on one row per draw and effect value: cells and draws are never paired as rows. Draws go to
    the tasks in blocks of ``MAX_BROADCAST_NUMBERS`` numbers at most.
    """
    spark = df.sparkSession
    m, k = len(fit.terms), len(fit.levels)
    root, centre = np.linalg.cholesky(fit.covariance), np.array([*fit.beta, *fit.cuts])
    others = [(i, p) for i, p in enumerate(fit.predictors) if p != effect]
    own = fit.predictors.index(effect)
    rows = df.select(*[F.col(p).cast("double").alias(p) for p in fit.predictors]).dropna("any")
    cells = cut_lineage(rows.groupBy(*[p for _, p in others]).agg(F.count(F.lit(1)).cast("double").alias("n")))
    block = max(1, MAX_BROADCAST_NUMBERS // m)
    noise = normal_draws(spark, n_draws, m, seed)
    ddl = "draw int, effect_value double, n double, " + ", ".join(f"p{j} double" for j in range(k))
    sums = [
        cells.mapInArrow(_adder(centre + _matrix(noise.filter(f"draw >= {first} and draw < {first + block}"), m) @ root.T, first, others, own, values, k), ddl)
        for first in range(0, n_draws, block)
    ]
    means = reduce(DataFrame.unionByName, sums).groupBy("draw", "effect_value").agg(*[F.expr(f"sum(p{j}) / sum(n) as p{j}") for j in range(k)])
    labelled = F.array(*[F.struct(F.lit(level).alias("outcome"), F.col(f"p{j}").alias("prob")) for j, level in enumerate(fit.levels)])
    return means.select("draw", "effect_value", F.inline(labelled))


def _matrix(noise: DataFrame, width: int) -> np.ndarray:
    """One block of draws, a row each."""
    ordered = noise.orderBy("draw").toPandas()
    return ordered[[f"z{j}" for j in range(width)]].to_numpy(float).reshape(-1, width)


def _adder(
    theta: np.ndarray, first: int, others: Sequence[tuple[int, str]], own: int, values: Sequence[float], k: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the cells' probabilities per draw (a row of ``theta`` each), effect value and outcome."""
    cuts = theta[:, -(k - 1) :].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(values), k, len(theta))), 0.0
        for batch in batches:
            table = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                n, rest = table["n"][row], sum((table[p][row] * theta[:, i] for i, p in others), np.zeros(len(theta)))
                count += n
                for v, value in enumerate(values):
                    below = np.vstack((np.zeros(len(theta)), 1 / (1 + np.exp(rest + value * theta[:, own] - cuts)), np.ones(len(theta))))
                    total[v] += n * np.diff(below, axis=0)
        if count:
            for v, value in enumerate(values):
                yield pa.RecordBatch.from_pydict({
                    "draw": pa.array(np.arange(first, first + len(theta), dtype=np.int32)), "effect_value": pa.array(np.full(len(theta), float(value))),
                    "n": pa.array(np.full(len(theta), count)), **{f"p{j}": pa.array(total[v, j]) for j in range(k)},
                })

    return run


def interval_table(draws: DataFrame, low: float = 0.025, high: float = 0.975, digits: int = 3) -> DataFrame:
    """``(outcome, effect_value, lower, mean, upper, apart)``; ``apart`` says that an outcome's intervals do not overlap.

    A group is the bounded number of draws, so the built-in percentile is fine here.
    """
    table = draws.groupBy("outcome", "effect_value").agg(
        F.expr(f"percentile(prob, array({low}, {high})) as q"), F.avg("prob").alias("mean")
    ).selectExpr("outcome", "effect_value", "q[0] as lower", "mean", "q[1] as upper")
    both = Window.partitionBy("outcome")
    judged = table.withColumn("apart", F.max("lower").over(both) > F.min("upper").over(both))
    return judged.withColumns({c: F.round(c, digits) for c in ("lower", "mean", "upper")})
