"""The same on all polygons of an Arrow batch at once: arrays of (row, corner), for what expressions corner by corner are too slow for.

A polygon with fewer corners than others is filled up with its first one, which changes no sum around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspark.functions.polygons import OFF, REACH

POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


class Polygons(NamedTuple):
    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    def __getitem__(self, rows):  # type: ignore[override]
        return Polygons(self.x[rows], self.y[rows], self.n[rows])


def lists(column: pa.ListArray, names: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields of a list of structs as (row, place), filled up with each row's first, and the lengths; null is empty."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, width, flat = np.cumsum(n) - n, max(int(n.max(initial=0)), 1), column.flatten()
    place = np.arange(width)
    at = first[:, None] + np.where(place < n[:, None], place, 0)
    at = np.where(n[:, None] > 0, at, 0)
    fields = [flat.field(name).to_numpy(zero_copy_only=False).astype(float) for name in names]
    return [np.where(n[:, None] > 0, (f if len(f) else np.zeros(1))[at], np.nan) for f in fields], n


def polygons(column: pa.ListArray) -> Polygons:
    (x, y), n = lists(column, ("x", "y"))
    return Polygons(x, y, n)


def column(p: Polygons) -> pa.ListArray:
    held = np.arange(p.x.shape[1]) < p.n[:, None]
    values = pa.StructArray.from_arrays([pa.array(p.x[held]), pa.array(p.y[held])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(p.n)), pa.int32()), values)


def chosen(options: list[Polygons], which: np.ndarray) -> Polygons:
    """Of each row the polygon of the option that ``which`` names."""
    place = np.arange(max(p.x.shape[1] for p in options))
    rows = np.arange(len(which))
    x, y = (np.stack([v[:, np.where(place < v.shape[1], place, 0)] for v in values])[which, rows] for values in ([p.x for p in options], [p.y for p in options]))
    return Polygons(x, y, np.stack([p.n for p in options])[which, rows])


def _next(v: np.ndarray) -> np.ndarray:
    return np.roll(v, -1, 1)


def _signed_area(p: Polygons) -> np.ndarray:
    return np.where(p.n > 0, (p.x * _next(p.y) - _next(p.x) * p.y).sum(1), 0.0) / 2


def area(p: Polygons) -> np.ndarray:
    return np.abs(_signed_area(p))


def centroid(p: Polygons) -> tuple[np.ndarray, np.ndarray]:
    whole, cross = _signed_area(p), p.x * _next(p.y) - _next(p.x) * p.y
    held = np.arange(p.x.shape[1]) < p.n[:, None]
    of = lambda v: np.where(np.abs(whole) > 1e-12, ((v + _next(v)) * cross).sum(1) / (6 * whole), np.where(held, v, 0.0).sum(1) / p.n)
    return of(p.x), of(p.y)


def clipped(p: Polygons, ax: np.ndarray, ay: np.ndarray, dx: np.ndarray, dy: np.ndarray, left: bool = True) -> Polygons:
    """What of each polygon lies to the left (else right) of its line, as ``polygons.clipped``."""
    s = dx[:, None] * (p.y - ay[:, None]) - dy[:, None] * (p.x - ax[:, None])
    q, held = _next(s), np.arange(p.x.shape[1]) < p.n[:, None]
    crosses = (s * q < 0) & held
    part = np.where(crosses, s / np.where(crosses, s - q, 1.0), 0.0)
    rows, width = s.shape
    keep = np.stack([((s if left else -s) >= 0) & held, crosses], 2).reshape(rows, 2 * width)
    n = keep.sum(1)
    width = max(int(n.max(initial=0)), 1)
    at = np.argsort(~keep, axis=1, kind="stable")[:, :width]
    at = np.where(np.arange(width) < n[:, None], at, at[:, :1])
    new = [np.take_along_axis(np.stack([v, v + (_next(v) - v) * part], 2).reshape(keep.shape), at, 1) for v in (p.x, p.y)]
    return Polygons(*new, n)


def good(p: Polygons) -> np.ndarray:
    """Whether each is a good cell, as ``layout.good_cell``."""
    place = np.arange(p.x.shape[1])
    before = np.where(place == 0, np.maximum(p.n - 1, 0)[:, None], place - 1)
    ax, ay, bx, by = (f(v) - v for f in (lambda v: np.take_along_axis(v, before, 1), _next) for v in (p.x, p.y))
    angle = np.degrees(np.arccos(np.clip((ax * bx + ay * by) / (np.hypot(ax, ay) * np.hypot(bx, by)), -1.0, 1.0)))
    return (p.n >= 4) & ~((angle < 35) & (place < p.n[:, None])).any(1)


def tangent(line: Polygons, ax: np.ndarray, ay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit direction of each line at its point nearest to a place, as ``polygons.tangent``."""
    x, y, dx, dy = line.x[:, :-1], line.y[:, :-1], np.diff(line.x), np.diff(line.y)
    held = np.arange(x.shape[1]) < line.n[:, None] - 1
    size = np.where(held, np.hypot(dx, dy), 0.0)
    start, whole = np.cumsum(size, 1) - size, size.sum(1)
    rows = np.arange(len(x))

    def along(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.minimum(np.maximum(np.where(d < 0, whole + d, d), 0.0), whole)
        inside = (start <= d[:, None]) & (size > 0)
        if not inside.shape[1]:
            return line.x[:, 0], line.y[:, 0]
        k = inside.shape[1] - 1 - inside[:, ::-1].argmax(1)
        part = np.where(inside.any(1), np.minimum((d - start[rows, k]) / np.where(size[rows, k] > 0, size[rows, k], 1.0), 1.0), 0.0)
        k = np.where(inside.any(1), k, 0)
        return x[rows, k] + dx[rows, k] * part, y[rows, k] + dy[rows, k] * part

    part = np.clip(np.where(size > 0, ((ax[:, None] - x) * dx + (ay[:, None] - y) * dy) / np.where(size > 0, size * size, 1.0), 0.0), 0.0, 1.0)
    away = np.where(held, np.hypot(x + dx * part - ax[:, None], y + dy * part - ay[:, None]), np.inf)
    nearest = np.where(away == away.min(1, initial=np.inf)[:, None], start + part * size, np.inf).min(1, initial=np.inf)
    d = np.where(np.isfinite(nearest), nearest, 0.0)
    here = along(d)

    def near(q: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        off = np.hypot(q[0] - here[0], q[1] - here[1]) > OFF
        return [np.where(off, h, v) for h, v in zip(here, q, strict=True)]

    (bx, by), (cx, cy) = near(along(d - REACH)), near(along(d + REACH))
    vx, vy = bx - cx, by - cy
    length = np.hypot(vx, vy)
    scale = np.where(length > 0, np.where(vx < 0, -1.0, 1.0) / np.where(length > 0, length, 1.0), 1.0)
    return vx * scale, vy * scale


def by_batch(rows: DataFrame, of: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``rows`` with ``of`` taken of every Arrow batch; ``of`` gives the columns of ``schema`` by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(divide="ignore", invalid="ignore"):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in of(batch).items()})

    return rows.mapInArrow(run, schema)


def fields(rows: DataFrame, *names: str) -> str:
    """Columns of a frame as part of a schema."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
