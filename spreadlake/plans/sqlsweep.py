"""Least squares with many regressors as SQL text, for the oracles: one regressor after the other is swept out.

Each step makes all columns that are left orthogonal to one regressor, within each group and over the
rows of a mask, so what is left of the outcome after the last step is its residual, and the slope on a
regressor that comes last is its coefficient in the whole equation. No normal equations are solved,
which makes this independent of the fits it checks.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Sum of squares below which a regressor has no variation left.
NOTHING = 1e-6


def sweep(rows: str, part: str, columns: Sequence[str], carried: Sequence[str], pivots: Sequence[str], mask: str = "true", k: str = "1") -> str:
    """A select of ``part``, ``carried``, ``k`` and the columns that are no pivots, without their means and without the pivots."""
    keep = ", ".join([part, *carried])
    window = f"window w as (partition by {part})"
    body = f"select {keep}, {k} as k, {', '.join(f'{c} - avg({c}) filter (where {mask}) over w as {c}' for c in columns)} from {rows} {window}"
    left = list(columns)
    for p in pivots:
        left.remove(p)
        square = f"sum({p} * {p}) filter (where {mask}) over w"
        swept = [f"{c} - coalesce(sum({c} * {p}) filter (where {mask}) over w / case when {square} > {NOTHING} then {square} end, 0) * {p} as {c}" for c in left]
        body = f"select {keep}, k + case when coalesce({square}, 0) > {NOTHING} then 1 else 0 end as k, {', '.join(swept)} from ({body}) {window}"
    return body


def last_slope(rows: str, part: str, carried: Sequence[str]) -> str:
    """A select of the slope of ``y`` on ``t``, the only regressor left, with what its robust error needs: o, v, n, k."""
    return f"""select {', '.join([part, *carried])}, m o, n, k, b coef, (y - b * t) * t / tt v, (y - b * t) e, y from (
      select *, sum(t * y) over w / sum(t * t) over w b, sum(t * t) over w tt, count(*) over w n from {rows} window w as (partition by {part}))"""
