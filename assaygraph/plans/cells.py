"""Cells of unit vectors: which pairs an exact similarity join can skip.

Rows go to the nearest of a bounded sample of centres; each cell knows its
radius (largest distance of a row to the centre).  A row ``q`` at distance
``d`` from a centre is at least ``d - radius`` away from everything in that
cell, and so it is from the plane half-way between the centre and its own one;
it only has to meet the cells where these bounds are within reach: a
fixed radius, or the k-th best distance that its own cell has already given.
Distances here are Euclidean between unit vectors; a cosine distance ``c`` is
``sqrt(2 c)``.  Zero vectors are at cosine distance 1 from everything, which
is no Euclidean place: they have a cell of their own that nobody skips.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ROUNDED, beyond, stack_vectors, unit_rows
from .session import cut_lineage, parallelism

#: Rows of a cell: the least, and the most that are aimed at (blocks have parts of their own, so large cells cost little).
ROWS_PER_CELL = 256
MOST_PER_CELL = 4096
#: Bounds what is broadcast (one vector each); it changes the cost, never the result.
MAX_CELLS = 16_384
_SLACK = 1e-6
#: Rows in a frame that a task hands on: a row may go to every cell.
_OUT_ROWS = 8192


@dataclass
class Cells:
    centres: np.ndarray         # unit rows
    radius: np.ndarray          # one more than centres: the last cell holds zero vectors
    rows: DataFrame             # id, x, _cell


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (unit_rows(x) @ centres.T), 0.0))


def _chunks(pdf: pd.DataFrame, vec: str, n: int):
    step = max(1, 4_000_000 // max(n, 1))
    for at in range(0, len(pdf), step):
        part = pdf.iloc[at:at + step]
        yield part, stack_vectors(part[vec])


def build(rows: DataFrame, id_col: str, vec: str, rows_per_cell: int | None = None) -> Cells:
    """Cells over ``rows`` (frozen by a checkpoint): about ``rows_per_cell`` rows in each, else a few cells for each task slot."""
    rows = cut_lineage(rows)
    n = rows.count()
    rows_per_cell = rows_per_cell or max(ROWS_PER_CELL, min(MOST_PER_CELL, n // (4 * parallelism(rows.sparkSession))))
    want = min(MAX_CELLS, max(1, -(-n // rows_per_cell)))
    sample = rows.orderBy(F.xxhash64(id_col, F.lit("centre")), id_col).limit(want).select(vec).collect()
    centres = np.array([r[0] for r in sample], dtype=np.float64).reshape(len(sample), -1)
    centres = unit_rows(centres)
    centres = np.unique(centres[np.abs(centres).sum(axis=1) > 0], axis=0)
    m = len(centres)

    def place(frames):
        for f in frames:
            for part, x in _chunks(f, vec, m):
                zero = ~x.any(axis=1)
                d = _distances(x, centres) if m else np.zeros((len(x), 1))
                cell = np.where(zero, m, d.argmin(axis=1))
                yield part.assign(_cell=cell.astype(np.int32), _far=np.where(zero, 0.0, np.nan_to_num(d.min(axis=1), nan=0.0)))

    placed = cut_lineage(rows.mapInPandas(place, rows.schema.simpleString()[7:-1] + ",_cell:int,_far:double"))
    far = placed.groupBy("_cell").agg(F.max("_far").alias("far")).collect()        # one row a cell
    radius = np.full(m + 1, -1.0)                                                  # -1: empty
    for r in far:
        radius[r["_cell"]] = r["far"]
    return Cells(centres, radius, placed.drop("_far"))


def reach(rows: DataFrame, cells: Cells, vec: str, bound=None, home: bool | None = None) -> DataFrame:
    """``rows`` repeated for each cell (``_cell``) that can hold a row within ``bound``.

    ``bound`` is a cosine distance or the name of a column with one (null: no
    bound).  ``home=True`` gives only the nearest cell that is not empty,
    ``home=False`` all cells in reach but that one, ``None`` all in reach.
    """
    centres, radius, m = cells.centres, cells.radius, len(cells.centres)
    filled = np.flatnonzero(radius[:m] >= 0)
    lonely = radius[m] >= 0                                # zero vectors: in everybody's reach

    def send(frames):
        for f in frames:
            for part, x in _chunks(f, vec, m):
                n = len(part)
                d = _distances(x, centres[filled]) if len(filled) else np.zeros((n, 0))
                nearest = d.argmin(axis=1) if len(filled) else None
                if home is True:
                    if nearest is None:
                        yield part.assign(_cell=np.full(n, m, np.int32))
                    else:
                        yield part.assign(_cell=filled[nearest].astype(np.int32))
                    continue
                cap = part[bound].to_numpy(float) if isinstance(bound, str) else np.full(n, np.nan if bound is None else bound)
                cap = np.sqrt(2.0 * (np.where(np.isnan(cap), 2.0, cap) + 2 * ROUNDED)) + _SLACK
                least = d - radius[filled][None, :]
                if nearest is not None:
                    between = np.sqrt(np.maximum(2.0 - 2.0 * (centres[filled[nearest]] @ centres[filled].T), 0.0))
                    least = np.maximum(least, beyond(d, d[np.arange(n), nearest], between))
                near = (least <= cap[:, None]) | ~x.any(axis=1)[:, None]
                if home is False and nearest is not None:
                    near[np.arange(n), nearest] = False
                row, at = np.nonzero(near)
                row, cell = row, filled[at]
                if lonely and not (home is False and nearest is None):
                    row, cell = np.concatenate((row, np.arange(n))), np.concatenate((cell, np.full(n, m)))
                for at in range(0, len(row), _OUT_ROWS):
                    some = slice(at, at + _OUT_ROWS)
                    yield part.iloc[row[some]].assign(_cell=cell[some].astype(np.int32))

    return rows.mapInPandas(send, rows.schema.simpleString()[7:-1] + ",_cell:int")



def spread(sample: DataFrame, cells: Cells, vec: str, bound) -> float:
    """Cells that a row of ``sample`` has in reach of ``bound``, on average."""
    n, met = sample.count(), reach(sample.select(*sample.columns), cells, vec, bound).count()
    return met / max(n, 1)


def nearness(rows: DataFrame, cells: Cells, vec: str, first: int | None = None) -> DataFrame:
    """``rows`` repeated for their nearest cells that are not empty (all, or the ``first`` few) with ``nth`` from 0.

    The cell of zero vectors comes last.
    """
    centres, radius, m = cells.centres, cells.radius, len(cells.centres)
    filled = np.flatnonzero(radius[:m] >= 0)
    ids = np.append(filled, m) if radius[m] >= 0 else filled

    def send(frames):
        for f in frames:
            for part, x in _chunks(f, vec, m):
                d = _distances(x, centres[filled]) if len(filled) else np.zeros((len(x), 0))
                order = np.argsort(d, axis=1, kind="stable")
                if len(ids) > len(filled):
                    order = np.concatenate((order, np.full((len(x), 1), len(filled))), axis=1)
                order = order[:, :first]
                k = order.shape[1]
                step = max(1, _OUT_ROWS // max(k, 1))
                for at in range(0, len(x), step):
                    some = order[at:at + step]
                    yield part.iloc[np.repeat(np.arange(at, at + len(some)), k)].assign(
                        _cell=ids[some].reshape(-1).astype(np.int32), nth=np.tile(np.arange(k, dtype=np.int32), len(some)))

    return rows.mapInPandas(send, rows.schema.simpleString()[7:-1] + ",_cell:int,nth:int")
