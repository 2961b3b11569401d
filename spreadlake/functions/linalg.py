"""The k x k algebra of one regression, applied to rows of sums. Nothing here sees data rows."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

# Executors get the functions of this module by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOLVED = StructType(
    [
        StructField("beta", ArrayType(DoubleType())),
        StructField("inv", ArrayType(DoubleType())),
        StructField("k", IntegerType()),
    ]
)


def solve_moments(n, sx, sxx, sy, sxy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares with a constant from sums, one fit per row: coefficients, (X'X)^-1 and ranks.

    ``n`` and ``sy`` are (m,), ``sx`` and ``sxy`` (m, k), ``sxx`` (m, k, k). Columns are centred and
    scaled first, which keeps the condition number of the normal equations near that of the design.
    A column without variation gets a zero coefficient and does not count.
    """
    n, sy = np.asarray(n, dtype=float), np.asarray(sy, dtype=float)
    m, k = sx.shape
    if k == 0:
        return (sy / n)[:, None], (1.0 / n)[:, None, None], np.ones(m, int)
    mean = sx / n[:, None]
    s = sxx - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    cross = sxy - mean * sy[:, None]
    var, raw = (np.diagonal(a, axis1=1, axis2=2) for a in (s, sxx))
    alive = var > 1e-12 * np.maximum(raw, 1e-300)
    d = np.where(alive, 1.0 / np.sqrt(np.where(alive, var, 1.0)), 0.0)
    values, vectors = np.linalg.eigh(d[:, :, None] * s * d[:, None, :])
    keep = values > 1e-10 * np.maximum(values.max(axis=1, keepdims=True), 1e-300)
    inner = (vectors * np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)[:, None, :]) @ vectors.transpose(0, 2, 1)
    c = d[:, :, None] * inner * d[:, None, :]
    slope = np.einsum("mij,mj->mi", c, cross)
    beta = np.concatenate([(sy / n - (mean * slope).sum(axis=1))[:, None], slope], axis=1)
    edge = np.einsum("mi,mij->mj", mean, c)
    inv = np.zeros((m, k + 1, k + 1))
    inv[:, 1:, 1:] = c
    inv[:, 0, 1:] = inv[:, 1:, 0] = -edge
    inv[:, 0, 0] = 1.0 / n + (edge * mean).sum(axis=1)
    return beta, inv, keep.sum(axis=1) + 1


def squared(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices from rows of their upper triangles."""
    out = np.zeros((len(flat), k, k))
    upper = np.triu_indices(k)
    out[:, upper[0], upper[1]] = out[:, upper[1], upper[0]] = flat
    return out


@F.pandas_udf(SOLVED)
def solve(n: pd.Series, sx: pd.Series, sxx: pd.Series, sy: pd.Series, sxy: pd.Series) -> pd.DataFrame:
    betas, invs, ranks = [None] * len(n), [None] * len(n), [0] * len(n)
    wide = sx.map(len).to_numpy()
    some = n.fillna(0).to_numpy() > 0
    # rows of one width are solved together
    for k in np.unique(wide[some]):
        at = np.flatnonzero(some & (wide == k))
        flat = [np.array([np.asarray(c.iloc[i], dtype=float) for i in at]).reshape(len(at), -1) for c in (sx, sxx, sxy)]
        beta, inv, rank = solve_moments(n.to_numpy()[at], flat[0], squared(flat[1], k), sy.to_numpy(dtype=float)[at], flat[2])
        for i, b, c, r in zip(at, beta, inv, rank):
            betas[i], invs[i], ranks[i] = b, c.reshape(-1), int(r)
    return pd.DataFrame({"beta": betas, "inv": invs, "k": ranks})


#: Origins solved in one go; bounds the memory of their matrices.
ORIGINS = 1024


def expanding(names: list[str], order: str, y: str, xs: list[str], min_train: int):
    """The per-key step of an expanding window: running cross products and stacked solves, no loop over origins."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        design, target = pdf[xs].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float)
        origins = np.arange(max(min_train, 1), len(pdf))
        forecast, before = np.empty(len(origins)), np.zeros((len(xs), len(xs)))
        sx, sxy, sy = (np.cumsum(a, axis=0) for a in (design, design * target[:, None], target))
        done = 0
        for at in range(0, len(origins), ORIGINS):
            part = origins[at : at + ORIGINS]
            # the rows up to the last one before each origin; sums go on from the chunk before
            rows = design[done : part[-1]]
            running = before + np.cumsum(rows[:, :, None] * rows[:, None, :], axis=0)
            sxx = running[part - 1 - done]
            beta, _, _ = solve_moments(part, sx[part - 1], sxx, sy[part - 1], sxy[part - 1])
            forecast[at : at + len(part)] = beta[:, 0] + (design[part] * beta[:, 1:]).sum(axis=1)
            before, done = running[-1], int(part[-1])
        out = pdf.loc[origins, names].reset_index(drop=True)
        out["n_train"] = origins.astype("int32")
        out["forecast"] = forecast
        out["benchmark"] = sy[origins - 1] / origins
        out["error"] = target[origins] - out["forecast"]
        out["benchmark_error"] = target[origins] - out["benchmark"]
        return out

    return step
