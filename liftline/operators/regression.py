"""Least squares per group.

A group is one series, with at most one row per week, so its design matrix is
bounded by weeks x terms. Spark shuffles rows by group; numpy solves inside the
task.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workers

TOLERANCE = 1e-9
workers.ship()


def varying_columns(x: np.ndarray) -> np.ndarray:
    """Mask of the columns with more than one value."""
    return np.ptp(x, axis=0) > 0 if len(x) else np.zeros(x.shape[1], bool)


def independent_columns(x: np.ndarray) -> list[int]:
    """Columns kept from left to right, leaving out those spanned by earlier ones."""
    kept: list[int] = []
    basis = np.empty((len(x), 0))
    for j in range(x.shape[1]):
        v = x[:, j]
        rest = v - basis @ (basis.T @ v)
        rest = rest - basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        if size > TOLERANCE * max(np.linalg.norm(v), 1.0):
            kept.append(j)
            basis = np.column_stack([basis, rest / size])
    return kept


def design(pdf: pd.DataFrame, terms: list[str], slot: str | None) -> tuple[np.ndarray, list[str]]:
    """Intercept, terms that vary, and slot dummies, rank-reduced from the left."""
    x = pdf[terms].to_numpy(float)
    names = list(terms)
    if slot is not None and pdf[slot].notna().all() and len(pdf):
        slots = pdf[slot].to_numpy(int)
        levels = np.unique(slots)
        x = np.column_stack([x, (slots[:, None] == levels[None, :]).astype(float)])
        names += [f"week_{s}" for s in levels]
    mask = varying_columns(x)
    x, names = x[:, mask], [n for n, m in zip(names, mask) if m]
    x = np.column_stack([np.ones(len(x)), x])
    names = ["intercept", *names]
    keep = independent_columns(x)
    return x[:, keep], [names[k] for k in keep]


def ols_residuals(df: DataFrame, y: str, terms: Iterable[str], keys: Iterable[str],
                  order: str, slot: str | None = None, out: str = "residual",
                  carry: Iterable[str] = ()) -> DataFrame:
    """Rows (keys, order, carry, fitted, residual) of the per-group fit of y.

    `carry` names columns to pass through, so that the result need not be joined
    back to its own input.
    """
    terms, keys = list(terms), list(keys)
    kept = [*keys, order, *carry]
    fields = [df.schema[c] for c in kept]
    schema = T.StructType(fields + [T.StructField("fitted", T.DoubleType()),
                                    T.StructField(out, T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, _ = design(pdf, terms, slot)
        target = pdf[y].to_numpy(float)
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        fitted = x @ beta
        return pdf[kept].assign(**{"fitted": fitted, out: target - fitted})

    needed = list(dict.fromkeys([*kept, y, *terms, *([slot] if slot else [])]))
    return df.select(*needed).groupBy(*keys).applyInPandas(solve, schema)


def ols_coefficients(df: DataFrame, y: str, terms: Iterable[str], keys: Iterable[str],
                     order: str, slot: str | None = None) -> DataFrame:
    """Rows (keys, term, coef, std_error, t_value, n, dof, r2, rss) of the per-group fit."""
    terms, keys = list(terms), list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("term", T.StringType()), T.StructField("coef", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()), T.StructField("t_value", T.DoubleType()),
        T.StructField("n", T.IntegerType()), T.StructField("dof", T.IntegerType()),
        T.StructField("r2", T.DoubleType()), T.StructField("rss", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, names = design(pdf, terms, slot)
        target = pdf[y].to_numpy(float)
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        error = target - x @ beta
        n, p = x.shape
        rss = float(error @ error)
        tss = float(((target - target.mean()) ** 2).sum())
        dof = n - p
        scale = rss / dof if dof > 0 else np.nan
        std = np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)), 0.0) * scale)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(std > 0, beta / std, np.nan)
        out = pd.DataFrame({"term": names, "coef": beta, "std_error": std, "t_value": t})
        out = out.assign(n=n, dof=dof, r2=1 - rss / tss if tss > 0 else np.nan, rss=rss)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[keys + ["term", "coef", "std_error", "t_value", "n", "dof", "r2", "rss"]]

    needed = keys + [order, y] + terms + ([slot] if slot else [])
    fit = df.select(*needed).groupBy(*keys).applyInPandas(solve, schema)
    # NaN never leaves the solver as a value
    return fit.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("std_error", "t_value", "r2")})
