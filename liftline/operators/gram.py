"""Least squares of many series from sums of products.

A row's terms are a sparse vector: an array of (term number, value), without
zeros. Spark sums the products of every two terms of a row per series, partly
before the shuffle, so sums of any two parts of a series merge into the sums of
both and no series is gathered row by row. What a task holds of a series is its
matrix of sums, terms x terms, however many rows there are.

Terms enter in the order of their numbers. A term that the ones before it span
is left out, so coefficients are unique.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workers

workers.ship()

# --- fixed values: a term counts as spanned below this share of its own square; the target's number ---
SPANNED = 1e-10
TARGET = 1 << 30
# --- end of fixed values ---


def sparse_vector(values: Iterable[tuple[Column, Column]], more: Column | None = None) -> Column:
    """Array of (term, value) structs of the non-zero values, ascending by term. `more` is such an array to add."""
    own = F.array(*[F.struct(number.cast("int").alias("term"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
                    for number, value in values])
    whole = own if more is None else F.concat(own, more)
    return F.array_sort(F.filter(whole, lambda e: e["value"] != 0))


def sums_of_products(rows: DataFrame, keys: Iterable[str], vector: str, y: str) -> DataFrame:
    """(keys, i, j, s): for terms i <= j the sum of their products; the target y is term TARGET."""
    full = F.concat(F.col(vector), F.array(F.struct(F.lit(TARGET).alias("term"), F.col(y).cast("double").alias("value"))))
    staged = rows.select(*keys, full.alias("v"))
    pairs = F.flatten(F.transform("v", lambda a, n: F.transform(
        F.slice("v", n + 1, F.size("v") - n),
        lambda b: F.struct(a["term"].alias("i"), b["term"].alias("j"), (a["value"] * b["value"]).alias("p")))))
    return (staged.select(*keys, F.inline(pairs))
            .groupBy(*keys, "i", "j").agg(F.sum("p").alias("s")))


def swept(sums: np.ndarray, spanned: float = SPANNED) -> list[int]:
    """Columns to keep, from left to right, of the terms whose sums of products are given."""
    rest, kept = sums.copy(), []
    for p in range(len(rest)):
        if rest[p, p] > spanned * sums[p, p] and sums[p, p] > 0:
            kept.append(p)
            rest -= np.outer(rest[:, p], rest[p] / rest[p, p])
    return kept


def solve(terms: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    """Coefficients, standard errors and fit quality; sums has the target in its last row and column.

    The first term is the intercept, so the total sum of squares is taken about the mean.
    """
    size = np.sqrt(np.maximum(np.diag(sums), 0.0))
    size[size == 0] = 1.0
    scaled = sums / np.outer(size, size)
    x, xy, yy = scaled[:-1, :-1], scaled[:-1, -1], scaled[-1, -1]
    kept = swept(x)
    inverse = np.linalg.inv(x[np.ix_(kept, kept)])
    beta = inverse @ xy[kept]
    # one step of refinement against the sums themselves
    beta += inverse @ (xy[kept] - x[np.ix_(kept, kept)] @ beta)
    # size[-1] ** 2 carries the target's own scale
    rss = max(float(yy - beta @ (2 * xy[kept] - x[np.ix_(kept, kept)] @ beta)), 0.0) * size[-1] ** 2
    n = int(round(sums[0, 0]))
    tss = float(sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0])
    dof = n - len(kept)
    spread = rss / dof if dof > 0 else np.nan
    std = np.sqrt(np.maximum(np.diag(inverse), 0.0) * spread) / size[kept]
    coef = beta * size[-1] / size[kept]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(std > 0, coef / std, np.nan)
    return pd.DataFrame({"term": terms[kept], "coef": coef, "std_error": std, "t_value": t, "n": n, "dof": dof,
                         "r2": 1 - rss / tss if tss > 0 else np.nan, "rss": rss})


def least_squares(rows: DataFrame, keys: Iterable[str], vector: str, y: str) -> DataFrame:
    """(keys, term, coef, std_error, t_value, n, dof, r2, rss) of every series' fit of y on its sparse vectors.

    Term 0 is the intercept and must be 1 in every row. Values that a fit can't
    give (no degrees of freedom, a constant target) are null.
    """
    keys = list(keys)
    sums = sums_of_products(rows, keys, vector, y)
    fields = [("term", T.IntegerType()), *((c, T.DoubleType()) for c in ("coef", "std_error", "t_value")),
              ("n", T.IntegerType()), ("dof", T.IntegerType()), ("r2", T.DoubleType()), ("rss", T.DoubleType())]
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        terms = np.unique(pdf["j"].to_numpy())  # every term meets itself
        i, j = (np.searchsorted(terms, pdf[c].to_numpy()) for c in "ij")
        matrix = np.zeros((len(terms), len(terms)))
        matrix[i, j] = matrix[j, i] = pdf["s"].to_numpy()
        out = solve(terms[:-1], matrix)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *(n for n, _ in fields)]]

    found = sums.groupBy(*keys).applyInPandas(fit, schema)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("std_error", "t_value", "r2")})
