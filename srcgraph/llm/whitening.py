"""Whitening components of embeddings by shifted Cholesky QR.

Entries are fixed-point numbers, ``x = floor(SCALE * c)``.  Components come from
the fit list, which holds every distinct vector once: ``n`` vectors with sums
``S``.  The centred rows ``A = x - S / n`` are orthogonalised in passes over the
list.  A pass sums the Gram matrix of the rows so far in every task, Spark adds
the tasks' matrices, the Cholesky factor of the sum goes back and the next pass
solves its triangular system row by row.  The first factor is shifted so that it
exists for any rows; further passes remove what the shift left.  With
``A = Q R`` and the product of all factors ``R``, the singular values and right
vectors of ``R`` give eigenvalues ``s**2 / n`` and components of the covariance.
Rows of less than full rank never become orthonormal: then the last Gram
matrix's symmetric root joins the product, which makes it exact all the same.

What the driver and every task hold is a few matrices of dimension squared; the
dimension is a property of the embedding model, not of the table.  No row passes
through the driver.

Rows go if their vector is null, empty, holds null or non-finite entries, or has
another length than most vectors (of lengths as frequent the largest).  Repeated rows
and equal vec_id stay as they are; vec_id may be null; other columns are ignored.
Components without variance do not exist, so vectors of lower rank give fewer than
asked, and an empty table or equal vectors give no rows.  Entries or deviations that
do not fit a long raise an error, since no long could hold them.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from srcgraph.llm.tables import cut, map_arrow

SCALE = 256
COMPONENTS = 4
PASSES = 6
ORTHONORMAL = 1e-13
EPS = np.finfo(float).eps


def entries(vector: Column) -> Column:
    """Fixed-point entries; null for vectors that go."""
    def fixed(c):
        scaled = F.lit(float(SCALE)) * c.cast("double")
        return F.when(F.abs(scaled) < float(1 << 62), F.floor(scaled)).otherwise(
            F.raise_error(F.lit("an entry does not fit a long")).cast("long"))

    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(F.size(vector) == 0, F.lit(None)).when(~bad, F.transform(vector, fixed))


def vectors(table: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows that stay."""
    rows = table.select(F.col(row_id).alias("vec_id"), entries(F.col(vector)).alias("x")).where("x IS NOT NULL")
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.where(F.size("x") == (usual[0]["size"] if usual else 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def total(rows: DataFrame, width: int, partial: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all rows x of ``partial`` of a block of rows: added up per task, then line by line over the tasks."""
    lines = f"line int, cells array<{kind}>"

    def task(batches):
        found = None
        for batch in batches:
            if batch.num_rows:
                part = partial(matrix(batch.column(0), width))
                found = part if found is None else found + part
        if found is not None:
            yield pa.record_batch([pa.array(range(len(found)), pa.int32()), pa.array(list(found))], ["line", "cells"])

    def add(group: pa.Table) -> pa.Table:
        cells = np.stack([np.asarray(c) for c in group["cells"].to_pylist()]).sum(axis=0)
        return pa.table({"line": group["line"][:1], "cells": pa.array([cells])})

    out = rows.select("x").mapInArrow(task, lines).groupBy("line").applyInArrow(add, lines).collect()
    return np.array([r["cells"] for r in sorted(out, key=lambda r: r["line"])])


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows @ inverse(factor)`` for an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def shifted(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper Cholesky factor of the Gram matrix plus the least shift that rounding asks for."""
    width = len(gram)
    shift = 11 * (n * width + width * (width + 1)) * EPS / 2 * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(width)).T


def root(gram: np.ndarray) -> np.ndarray:
    """Symmetric root of a Gram matrix of any rank."""
    values, basis = np.linalg.eigh(gram)
    return (basis * np.sqrt(np.maximum(values, 0))) @ basis.T


class Whitening:
    """What a table's vectors are whitened with: n, sums, components (columns), eigenvalues, trace, identity_error."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.sums / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of (n x - S) ** 2."""
        size = np.abs(x).max(initial=0) * float(self.n) + np.abs(self.sums).max(initial=0)
        if x.shape[1] * size ** 2 < float(1 << 62):
            return ((self.n * x - self.sums) ** 2).sum(axis=1)
        sums = [int(s) for s in self.sums]
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
        return np.array(exact, np.int64)  # raises OverflowError if a sum does not fit


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (x) rows; None if there is none."""
    distinct, seen = cut(rows.select("x").distinct())
    n = seen["n"]
    if not n:
        return None
    width = len(distinct.first()["x"])
    sums = total(distinct, width, lambda x: x.sum(axis=0)[None, :], "long")[0]
    mean = sums / n
    factors: list[np.ndarray] = []

    def gram(x):
        q = x - mean
        for factor in factors:
            q = solve(q, factor)
        return q.T @ q

    product, trace = np.eye(width), 0.0
    for turn in range(PASSES + 1):
        found = total(distinct, width, gram, "double")
        if turn == 0:
            trace = float(np.trace(found)) / n
            if trace == 0:
                return None
        elif np.abs(found - np.eye(width)).max() < ORTHONORMAL * max(1.0, np.sqrt(width)) * 10:
            break
        if turn == PASSES:
            product = root(found) @ product
            break
        try:
            factor = shifted(found, n) if turn == 0 else np.linalg.cholesky(found).T
        except np.linalg.LinAlgError:
            factor = shifted(found, n)
        factors = [*factors, factor]
        product = factor @ product
    _, sizes, axes = np.linalg.svd(product)
    values = sizes ** 2 / n
    kept = int((values[:components] > width * EPS * trace).sum())
    axes = axes[:kept].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    out = Whitening(n, sums, axes, values[:kept], trace)

    def moments(x):
        y = out.apply(x)
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = total(distinct, width, moments, "double")
    centre = found[-1] / n
    out.identity_error = float(np.abs(found[:-1] / n - np.outer(centre, centre) - np.eye(kept)).max())
    return out


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """One row per vector that stays and component: n, deviation, whitened, explained, identity_error."""
    rows = vectors(table, vector, row_id)
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    found = fit(rows, components)
    if found is None:
        return table.sparkSession.createDataFrame([], schema)

    def apply(batch):
        x = matrix(batch.column(1), len(found.sums))
        y = found.apply(x)
        k = y.shape[1]
        size = len(x) * k
        yield pa.record_batch(
            [batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
             pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(size, found.n, np.int64)),
             pa.array(np.repeat(found.deviation(x), k)), pa.array(y.ravel()),
             pa.array(np.tile(found.values / found.trace, len(x))), pa.array(np.full(size, found.identity_error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return map_arrow(rows, apply, schema)
