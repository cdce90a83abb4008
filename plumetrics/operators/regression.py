"""Least squares on Spark: one aggregation to central moments, then a small solve per group.

Rows are reduced to counts, means and covariances by mergeable built-in aggregates, so a season holding most
rows costs no more than any other. What is left is one row per group; the solve runs on those rows inside
tasks. A row with any model variable missing is left out of the fit and counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumetrics.functions.scalars import number
from plumetrics.functions.tails import f_upper, t_quantile, t_two_sided
from plumetrics.operators.quantiles import group_summary, keyed_join, with_row
from plumetrics.operators.ranking import numbered
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

INTERCEPT = "(Intercept)"
# A predictor is aliased when earlier ones explain all but this share of its variation.
ALIAS_SHARE = 1e-12
GRID_POINTS = 80

COEFFICIENT_FIELDS = "term string, term_order bigint, estimate double, std_error double, statistic double, " \
    "p_value double, conf_low double, conf_high double"
FIT_FIELDS = "n bigint, n_dropped bigint, model_rank bigint, df_residual bigint, sigma double, r_squared double, " \
    "adj_r_squared double, f_statistic double, df_model bigint, p_value double"


def moments(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows used, rows dropped, means and the upper triangle of the covariance matrix."""
    names = [*xs, y]
    complete = F.lit(True)
    for name in names:
        complete = complete & number(name).isNotNull()
    values = df.select(*by, complete.alias("complete"), *[number(c).alias(f"v{i}") for i, c in enumerate(names)])
    used = [F.when(F.col("complete"), F.col(f"v{i}")) for i in range(len(names))]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return values.groupBy(*by).agg(
        F.count_if("complete").alias("n"),
        F.count_if(~F.col("complete")).alias("n_dropped"),
        F.array(*[F.avg(v) for v in used]).alias("means"),
        F.array(*[
            F.var_samp(used[i]) if i == j else F.covar_samp(used[i], used[j]) for i, j in pairs
        ]).alias("covariances"),
    )


def fit(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> "LinearFit":
    """Fit ``y ~ xs`` once per group of ``by`` (once overall when empty)."""
    return LinearFit(moments(df, y, xs, by), y, list(xs), list(by))


class LinearFit:
    """Fitted models as DataFrames: coefficients, fit statistics, residuals."""

    def __init__(self, moment_rows: DataFrame, y: str, xs: list[str], by: list[str]):
        self.moment_rows, self.y, self.xs, self.by = moment_rows, y, xs, by

    def coefficients(self, level: float = 0.95) -> DataFrame:
        """term, estimate, std_error, statistic, p_value and confidence bounds; aliased terms are NULL."""
        xs, by = self.xs, self.by

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    solved = _solve(row, len(xs))
                    yield _coefficient_rows({k: row[k] for k in by}, [INTERCEPT, *xs], *solved[:3], level)

        return self.moment_rows.mapInPandas(solve, self._schema(COEFFICIENT_FIELDS))

    def fit_statistics(self) -> DataFrame:
        """n, dropped rows, residual error, R squared, adjusted R squared, F and its p value."""
        xs, by = self.xs, self.by

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    _, _, df_resid, rank, rss, tss = _solve(row, len(xs))
                    yield _fit_rows({k: row[k] for k in by}, row["n"], row["n_dropped"], df_resid, rank, rss, tss)

        return self.moment_rows.mapInPandas(solve, self._schema(FIT_FIELDS))

    def residuals(self, df: DataFrame, out: str = "residual") -> DataFrame:
        """``df`` without incomplete rows, with observed minus fitted values; aliased terms count as zero."""
        wide = (
            self.coefficients().groupBy(*self.by).pivot("term", [INTERCEPT, *self.xs])
            .agg(F.coalesce(F.first("estimate"), F.lit(0.0)))
            .withColumnsRenamed({t: f"_b{i}" for i, t in enumerate([INTERCEPT, *self.xs])})
        )
        complete = df.dropna(subset=[self.y, *self.xs])
        if self.by:
            wide = broadcast_if_small(*cut_lineage_counted(wide, "coefficients"))
            scored = keyed_join(complete, wide, self.by)
        else:
            scored = with_row(complete, wide, "_row").select("*", "_row.*").drop("_row")
        beta = [F.col(f"_b{i}") for i in range(len(self.xs) + 1)]
        fitted = beta[0]
        for b, x in zip(beta[1:], self.xs):
            fitted = fitted + b * F.col(x)
        return scored.withColumn(out, F.col(self.y) - fitted).drop(*[f"_b{i}" for i in range(len(self.xs) + 1)])

    def residual_summary(self, df: DataFrame, **options) -> DataFrame:
        """Five-number summary of the residuals per model."""
        names = ("res_min", "res_q1", "res_median", "res_q3", "res_max")
        spec = {name: ("residual", p) for name, p in zip(names, (0.0, 0.25, 0.5, 0.75, 1.0))}
        return group_summary(self.residuals(df), self.by, [], spec, **options)

    def with_interaction(self, level: float = 0.95) -> tuple[DataFrame, DataFrame]:
        """The pooled model ``y ~ xs * factor`` for the single factor in ``by``: coefficients and fit.

        Every level is solved on its own; a term of a level is its difference to the first level, and the pooled
        residual variance comes from the sums over levels. So the work grows with the number of levels and no task
        holds more than a level. A predictor aliased within a level keeps the slope of the first level there. Only if
        a predictor is aliased within the first level, which term is left out depends on all levels together; then
        one task solves the pooled equations.
        """
        (factor,), xs = self.by, self.xs
        k = len(xs)
        levels = numbered(self.moment_rows.filter((F.col("n") > 0) & F.col(factor).isNotNull()), [factor], "levels")
        base = levels.filter("place = 0").toPandas().to_dict("records")
        if base and _solve(base[0], k)[3] <= k:
            return self._dense_interaction(level)

        def level_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for row in batch.to_dict("records"):
                    _, _, _, rank, rss, tss = _solve(row, k)
                    rows.append([row["n"], row["n_dropped"], row["means"][k], rank, rss, tss])
                yield pd.DataFrame(rows, columns=["n", "n_dropped", "mean", "rank", "rss", "tss"])

        sums = levels.mapInPandas(level_sums, "n bigint, n_dropped bigint, mean double, rank bigint, rss double, tss double")
        # The means are taken about the first level's, so little cancels in the spread between levels.
        shift = float(base[0]["means"][k]) if base else 0.0
        sums = sums.withColumn("m", F.col("mean") - F.lit(shift))
        between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")
        pooled = cut_lineage(sums.agg(
            F.sum("n").alias("n"), F.sum("n_dropped").alias("n_dropped"), F.sum("rank").alias("model_rank"),
            F.sum("rss").alias("rss"), (F.sum("tss") + between).alias("tss"), F.count(F.lit(1)).alias("n_levels"),
        ), "pooled")

        def coefficient_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    yield _interaction_rows(row, base[0], factor, xs, level)

        def fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.dropna(subset=["n"]).to_dict("records"):
                    rank, n = int(r["model_rank"]), int(r["n"])
                    yield _fit_rows({}, n, r["n_dropped"], n - rank, rank, r["rss"], r["tss"])

        totals = pooled.select(F.col("n").alias("all_n"), "model_rank", "rss", "n_levels")
        with_pool = with_row(levels, totals, "pool").select("*", "pool.*").drop("pool")
        return with_pool.mapInPandas(coefficient_rows, COEFFICIENT_FIELDS), pooled.mapInPandas(fit_rows, FIT_FIELDS)

    def _dense_interaction(self, level: float) -> tuple[DataFrame, DataFrame]:
        (factor,), xs = self.by, self.xs

        def coefficient_rows(levels: pd.DataFrame) -> pd.DataFrame:
            terms, beta, var, df_resid, *_ = _solve_interaction(levels, factor, xs)
            return _coefficient_rows({}, terms, beta, var, df_resid, level)

        def fit_rows(levels: pd.DataFrame) -> pd.DataFrame:
            _, _, _, df_resid, rank, rss, tss = _solve_interaction(levels, factor, xs)
            return _fit_rows({}, levels["n"].sum(), levels["n_dropped"].sum(), df_resid, rank, rss, tss)

        together = self.moment_rows.filter(F.col("n") > 0).withColumn("model", F.lit(1)).groupBy("model")
        return (
            together.applyInPandas(coefficient_rows, COEFFICIENT_FIELDS),
            together.applyInPandas(fit_rows, FIT_FIELDS),
        )

    def _schema(self, fields: str) -> T.StructType:
        keys = [self.moment_rows.schema[k] for k in self.by]
        return T.StructType([*keys, *T.StructType.fromDDL(fields).fields])


def trend_band(
    df: DataFrame, x: str, y: str, by: str | None = None, level: float = 0.95, points: int = GRID_POINTS
) -> DataFrame:
    """Straight-line fit per group (of the whole table without ``by``) on an even grid over the x range, with its band."""
    keys = [by] if by else []
    xv = F.when(number(y).isNotNull(), number(x))
    yv = F.when(number(x).isNotNull(), number(y))
    lines = df.groupBy(*keys).agg(
        F.regr_count(yv, xv).alias("n"), F.regr_slope(yv, xv).alias("slope"),
        F.regr_intercept(yv, xv).alias("intercept"), F.regr_r2(yv, xv).alias("r_squared"),
        F.regr_avgx(yv, xv).alias("x_mean"), F.regr_sxx(yv, xv).alias("sxx"),
        F.regr_syy(yv, xv).alias("syy"), F.regr_sxy(yv, xv).alias("sxy"),
        F.min(xv).alias("x_min"), F.max(xv).alias("x_max"),
    ).filter((F.col("n") > 2) & (F.col("sxx") > 0))

    @F.pandas_udf("double")
    def critical(df_resid: pd.Series) -> pd.Series:
        return df_resid.map(lambda d: t_quantile(level, float(d)))

    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = lines.withColumn("t_crit", critical(F.col("n") - 2)).select("*", step.alias("step"))
    grid_x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("step") / (points - 1)
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2))
    half = F.col("t_crit") * sigma * F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("x_mean"), 2) / F.col("sxx"))
    return (
        grid.withColumn("x", grid_x)
        .withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumns({"conf_low": F.col("fitted") - half, "conf_high": F.col("fitted") + half})
        .select(*keys, F.col("step").cast("bigint").alias("step"), "n", "slope", "intercept", "r_squared",
                "x", "fitted", "conf_low", "conf_high")
    )


def _eliminate(a: np.ndarray, reference: np.ndarray, columns: Sequence[int]) -> list[int]:
    """Sweep ``columns`` of the symmetric matrix ``a`` in order, in place; return those not aliased."""
    kept = []
    for p in columns:
        d = a[p, p]
        if not d > ALIAS_SHARE * reference[p]:
            continue
        row = a[p].copy()
        a -= np.outer(row, row) / d
        a[p, :] = a[:, p] = row / d
        a[p, p] = -1.0 / d
        kept.append(p)
    return kept


def _matrix(row: dict, k: int) -> np.ndarray:
    a = np.zeros((k + 1, k + 1))
    a[np.triu_indices(k + 1)] = np.asarray(row["covariances"], dtype=float)
    return a + np.triu(a, 1).T


def _solve(row: dict, k: int):
    """(estimates, variances, residual df, rank, RSS, TSS) of one model with an intercept."""
    n = int(row["n"])
    estimate, variance = np.full(k + 1, np.nan), np.full(k + 1, np.nan)
    if n == 0:
        return estimate, variance, 0, 0, np.nan, np.nan
    mean = np.asarray(row["means"], dtype=float)
    a = _matrix(row, k) * (n - 1) if n > 1 else np.zeros((k + 1, k + 1))
    tss = a[k, k]
    kept = _eliminate(a, np.diag(a).copy(), range(k)) if n > 1 else []
    rss, rank = max(a[k, k], 0.0), len(kept) + 1
    df_resid = n - rank
    inverse = -a[np.ix_(kept, kept)]
    slope, centre = a[kept, k], mean[kept]
    estimate[0] = mean[k] - centre @ slope
    estimate[[p + 1 for p in kept]] = slope
    if df_resid > 0:
        s2 = rss / df_resid
        variance[0] = s2 * (1.0 / n + centre @ inverse @ centre)
        variance[[p + 1 for p in kept]] = s2 * np.diag(inverse)
    return estimate, variance, df_resid, rank, rss, tss


def _solve_interaction(levels: pd.DataFrame, factor: str, xs: Sequence[str]):
    """Pooled model with every predictor and the intercept differing by level; first level is baseline."""
    rows = levels.dropna(subset=[factor]).sort_values(factor).to_dict("records")
    k, names = len(xs), [str(r[factor]) for r in rows]
    rest = names[1:]
    terms = [INTERCEPT, *xs, *[f"{factor}{s}" for s in rest], *[f"{x}:{factor}{s}" for x in xs for s in rest]]
    size = len(terms)
    cross = np.zeros((size + 1, size + 1))
    total = sum(int(r["n"]) for r in rows)
    y_mean = sum(int(r["n"]) * r["means"][k] for r in rows) / total
    for place, row in enumerate(rows):
        n = int(row["n"])
        mean = np.append(1.0, np.asarray(row["means"], dtype=float))
        mean[-1] -= y_mean
        block = n * np.outer(mean, mean)
        if n > 1:
            block[1:, 1:] += _matrix(row, k) * (n - 1)
        spots = [[0], *[[j + 1] for j in range(k)], [size]]
        if place:
            spots[0].append(k + place)
            for j in range(k):
                spots[j + 1].append(k + 1 + len(rest) * (j + 1) + place - 1)
        for i, left in enumerate(spots):
            for j, right in enumerate(spots):
                cross[np.ix_(left, right)] += block[i, j]
    reference = np.diag(cross).copy()
    tss = cross[size, size]
    kept = _eliminate(cross, reference, range(size))
    estimate, variance = np.full(size, np.nan), np.full(size, np.nan)
    estimate[kept] = cross[kept, size]
    estimate[0] += y_mean
    rss, rank = max(cross[size, size], 0.0), len(kept)
    df_resid = total - rank
    if df_resid > 0:
        variance[kept] = -np.diag(cross)[kept] * rss / df_resid
    return terms, estimate, variance, df_resid, rank, rss, tss


def _interaction_rows(row: dict, base: dict, factor: str, xs: Sequence[str], level: float) -> pd.DataFrame:
    """The terms of one level of the pooled model, whose first level has all its terms."""
    k, place, rest = len(xs), int(row["place"]), int(row["n_levels"]) - 1
    df_resid = int(row["all_n"]) - int(row["model_rank"])
    s2 = max(row["rss"], 0.0) / df_resid if df_resid > 0 else math.nan
    first, first_cov, _, _ = _level_terms(base, k)
    if place == 0:
        terms, orders = [INTERCEPT, *xs], list(range(k + 1))
        estimate, variance = first, np.diag(first_cov) * s2
    else:
        name = str(row[factor])
        terms = [f"{factor}{name}", *[f"{x}:{factor}{name}" for x in xs]]
        orders = [k + place, *[k + rest * (j + 1) + place for j in range(k)]]
        own, own_cov, kept, carry = _level_terms(row, k)
        estimate, variance = np.full(k + 1, np.nan), np.full(k + 1, np.nan)
        estimate[kept] = own[kept] - carry @ first
        variance[kept] = (np.diag(own_cov)[kept] + np.diag(carry @ first_cov @ carry.T)) * s2
    rows = _coefficient_rows({}, terms, estimate, variance, df_resid, level)
    rows["term_order"] = orders
    return rows


def _level_terms(row: dict, k: int):
    """(estimates, unscaled covariance, places of terms not aliased, carry) of one level.

    ``carry`` expresses every column of the level by those not aliased: slopes of another level times ``carry`` are the
    same fit on these columns.
    """
    n, mean = int(row["n"]), np.asarray(row["means"], dtype=float)
    a = _matrix(row, k) * (n - 1) if n > 1 else np.zeros((k + 1, k + 1))
    kept = _eliminate(a, np.diag(a).copy(), range(k)) if n > 1 else []
    places = [0, *[p + 1 for p in kept]]
    inverse, centre = -a[np.ix_(kept, kept)], mean[kept]
    estimate, covariance = np.full(k + 1, np.nan), np.full((k + 1, k + 1), np.nan)
    estimate[places] = [mean[k] - centre @ a[kept, k], *a[kept, k]]
    block = np.zeros((len(places), len(places)))
    block[1:, 1:] = inverse
    block[0, 1:] = block[1:, 0] = -inverse @ centre
    block[0, 0] = 1.0 / n + centre @ inverse @ centre
    covariance[np.ix_(places, places)] = block
    carry = np.zeros((len(places), k + 1))
    carry[range(len(places)), places] = 1.0
    for p in range(k):
        if p not in kept:
            share = a[kept, p]
            carry[1:, p + 1] = share
            carry[0, p + 1] = mean[p] - centre @ share
    return estimate, covariance, places, carry


def _present(value: float) -> float | None:
    return None if value is None or not math.isfinite(value) else float(value)


def _coefficient_rows(keys: dict, terms, estimate, variance, df_resid: int, level: float) -> pd.DataFrame:
    critical = t_quantile(level, df_resid) if df_resid > 0 else math.nan
    rows = []
    for order, (term, b, v) in enumerate(zip(terms, estimate, variance)):
        se = math.sqrt(v) if v >= 0 else math.nan
        t = b / se if se > 0 else math.nan
        p = t_two_sided(t, df_resid) if math.isfinite(t) else math.nan
        numbers = [b, se, t, p, b - critical * se, b + critical * se]
        rows.append([*keys.values(), term, order, *map(_present, numbers)])
    fields = [f.split()[0] for f in COEFFICIENT_FIELDS.split(", ")]
    return pd.DataFrame(rows, columns=[*keys, *fields])


def _fit_rows(keys: dict, n, n_dropped, df_resid: int, rank: int, rss: float, tss: float) -> pd.DataFrame:
    sigma = r2 = adjusted = f = p = None
    if df_resid > 0:
        sigma = math.sqrt(rss / df_resid)
    if tss > 0:
        r2 = 1.0 - rss / tss
        if df_resid > 0:
            adjusted = 1.0 - (1.0 - r2) * (n - 1) / df_resid
        if df_resid > 0 and rank > 1 and rss > 0:
            f = (tss - rss) / (rank - 1) / (rss / df_resid)
            p = f_upper(f, rank - 1, df_resid)
    values = [int(n), int(n_dropped), rank, df_resid, sigma, r2, adjusted, f, max(rank - 1, 0), p]
    fields = [x.split()[0] for x in FIT_FIELDS.split(", ")]
    return pd.DataFrame([[*keys.values(), *values]], columns=[*keys, *fields])
