"""Penalised logistic regression by reweighted least squares on sums that tasks add up.

One step is one aggregation. For the weights of the step before, every task adds up
its rows' gradient and Gram matrix, one flat array per nested share of the rows; the
arrays are shuffled in slices and added slice by slice. What reaches the driver has
the size of the Gram matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# Doubles that are shuffled as one row.
SLICE = 2048
# Tasks of a pass for each core.
TASKS = 2
# Newton steps are halved until the objective falls, this often at most.
HALVINGS = 30


@dataclass
class Fit:
    """Weights of one share; `steps` counts the aggregations it took part in."""

    weights: np.ndarray
    n: int
    steps: int
    converged: bool


@dataclass
class Sums:
    """What one pass over a share's rows adds up at given weights."""

    n: int
    loss: float
    total: np.ndarray
    squares: np.ndarray
    gradient: np.ndarray
    gram: np.ndarray


def _task_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    margin = x @ w
    p = 0.5 * (1.0 + np.tanh(0.5 * margin))
    loss = np.logaddexp(0.0, margin) - y * margin
    gram = (x * (p * (1.0 - p))[:, None]).T @ x
    return np.concatenate(
        [[len(y), loss.sum()], x.sum(0), (x * x).sum(0), x.T @ (y - p), gram[np.triu_indices(len(w))]]
    )


def _unpacked(flat: np.ndarray, width: int) -> Sums:
    total, squares, gradient, upper = np.split(flat[2:], [width, 2 * width, 3 * width])
    gram = np.zeros((width, width))
    gram[np.triu_indices(width)] = upper
    return Sums(int(flat[0]), flat[1], total, squares, gradient, gram + np.triu(gram, 1).T)


def gram_sums(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """share, slice, sums (a binary of doubles): one step's table.

    `rows` has label, features and `share`, the number of the first of the nested
    shares that the row belongs to; it belongs to all later ones too.
    """

    names = ("share", "slice", "sums")

    def added_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            share, y, x = (batch.column(i) for i in range(3))
            share, y = share.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
            # One look at the batch's buffer, no array per row.
            x = x.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False).reshape(batch.num_rows, -1)
            for number, w in weights.items():
                inside = share <= number
                if inside.any():
                    sums[number] = sums.get(number, 0.0) + _task_sums(x[inside], y[inside], w)
        for number, flat in sums.items():
            parts = [flat[at : at + SLICE].tobytes() for at in range(0, len(flat), SLICE)]
            numbers = [pa.array(n, pa.int32()) for n in ([number] * len(parts), range(len(parts)))]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(parts, pa.binary())], names=names)

    def added(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | float = 0.0
        for part in parts:
            for sums in part["sums"]:
                total = total + np.frombuffer(sums, "f8")
        yield pd.DataFrame({"share": [key[0]], "slice": [key[1]], "sums": [total.tobytes()]})

    schema = "share int, slice int, sums binary"
    # A task's sums are as large for few rows as for many, so each core takes its rows in few tasks.
    rows = rows.select("share", "label", "features").coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(added_here, schema).groupBy("share", "slice").applyInPandas(added, schema)


def _step_sums(rows: DataFrame, weights: dict[int, np.ndarray], width: int) -> dict[int, Sums]:
    slices: dict[int, dict[int, bytes]] = {}
    for row in gram_sums(rows, weights).collect():  # the Gram matrices' size
        slices.setdefault(row["share"], {})[row["slice"]] = row["sums"]
    return {
        number: _unpacked(np.frombuffer(b"".join(parts[i] for i in sorted(parts)), "f8"), width)
        for number, parts in slices.items()
    }


class _Search:
    """The Newton steps of one share."""

    def __init__(self, width: int, penalty: float):
        self.penalty = penalty
        self.weights = np.zeros(width)  # where the next pass looks
        self.best = np.zeros(width)
        self.objective = np.inf
        self.step = np.zeros(width)
        self.halved = self.steps = self.n = 0
        self.done = self.converged = False

    def take(self, sums: Sums, tolerance: float) -> None:
        """Go on from the sums at `weights`: a full step from there, or half the last step if that led up."""
        self.steps, self.n = self.steps + 1, sums.n
        spread = sums.squares - sums.total**2 / sums.n
        # Penalties count in units of a feature's deviation; a constant feature has no weight.
        scale = np.where(spread > 1e-12 * sums.squares, spread / max(sums.n - 1, 1), 0.0)
        active = scale > 0
        objective = sums.loss / sums.n + self.penalty / 2 * float(scale @ self.weights**2)
        if objective > self.objective + 1e-12 * abs(self.objective) and self.halved < HALVINGS:
            self.halved += 1
            self.step = self.step / 2
            self.weights = self.best + self.step
            return
        self.best, self.objective, self.halved = self.weights, objective, 0
        slope = np.where(active, sums.gradient / sums.n - self.penalty * scale * self.weights, 0.0)
        both = np.outer(active, active)
        curve = np.where(both, sums.gram / sums.n, 0.0) + np.diag(np.where(active, self.penalty * scale, 1.0))
        self.step = np.linalg.solve(curve, slope)
        if np.abs(self.step).max(initial=0.0) <= tolerance * max(1.0, np.abs(self.best).max(initial=0.0)):
            self.done = self.converged = True
        self.weights = self.best + self.step


def logistic_fits(
    rows: DataFrame, shares: Sequence[float], width: int, penalty: float, max_iter: int, tolerance: float = 1e-9
) -> list[Fit]:
    """A fit without intercept for each of the nested shares, all in the same passes.

    Minimises the mean logistic loss plus penalty/2 times the sum of (weight times the
    feature's deviation) squared. `rows` is read once per step, so it should be stored.
    A share without rows keeps zero weights.
    """
    searches = [_Search(width, penalty) for _ in shares]
    for _ in range(max_iter):
        open_ = {i: s.weights for i, s in enumerate(searches) if not s.done}
        if not open_:
            break
        found = _step_sums(rows, open_, width)
        for number in open_:
            if number in found:
                searches[number].take(found[number], tolerance)
            else:
                searches[number].done = searches[number].converged = True
    return [Fit(s.weights if s.converged else s.best, s.n, s.steps, s.converged) for s in searches]

