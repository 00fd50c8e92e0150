"""Nearest centroids through an index of cells, for more centroids than can stand beside every point."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .quantiles import quantiles, quantiles_of_counts

#: Centroids of a cell, cells at most (their boxes go to every task), cells that a point meets per round, points of a task.
CELL, CELLS, RING, TASK = 512, 1 << 16, 4, 50_000
#: Cells are cut along turned axes, so that many equal longitudes or latitudes are no equal places there.
_ANGLE = 0.7390851332151607
_COS, _SIN = math.cos(_ANGLE), math.sin(_ANGLE)


class Cells:
    """Boxes of ``side`` slabs of equal counts of centroids, and of ``side`` cells in each."""

    def __init__(self, side: int, slab_bounds: np.ndarray, cell_bounds: np.ndarray):
        self.side, self.slab_bounds, self.cell_bounds = side, slab_bounds, cell_bounds
        self.boxes = np.full((side * side, 4), np.nan)
        self.slabs = np.full((side, 4), np.nan)

    def of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The cell of each place; places beyond all boxes belong to those at the edge."""
        slab = np.searchsorted(self.slab_bounds, u, "left")
        cell = np.zeros(len(u), np.int64)
        for s in np.unique(slab):
            mine = slab == s
            cell[mine] = np.searchsorted(self.cell_bounds[s], v[mine], "left")
        return slab * self.side + cell

    def fill(self, boxes: pd.DataFrame) -> None:
        self.boxes[boxes["cell"].to_numpy()] = boxes[["u0", "u1", "v0", "v1"]].to_numpy()
        per = self.boxes.reshape(self.side, self.side, 4)
        some = ~np.isnan(per[:, :, 0]).all(1)
        self.slabs[some] = np.stack([np.nanmin(per[some, :, 0], 1), np.nanmax(per[some, :, 1], 1), np.nanmin(per[some, :, 2], 1), np.nanmax(per[some, :, 3], 1)], 1)

    @staticmethod
    def _away(u: np.ndarray, v: np.ndarray, box: np.ndarray) -> np.ndarray:
        du = np.maximum(np.maximum(box[..., 0] - u, u - box[..., 1]), 0)
        dv = np.maximum(np.maximum(box[..., 2] - v, v - box[..., 3]), 0)
        return np.nan_to_num(du * du + dv * dv, nan=np.inf)

    def near(self, u: np.ndarray, v: np.ndarray, reach2: np.ndarray, met: list[list[int]]) -> list[list[int]]:
        """By place: the nearest cells, ``RING`` at most, that may hold a centroid within the reach and weren't met."""
        # The slack covers rounding of the turned axes.
        reach2 = reach2 * (1 + 1e-9) + 1e-18
        out: list[list[int]] = []
        for i in range(0, len(u), 1024):
            a, b, r = u[i : i + 1024], v[i : i + 1024], reach2[i : i + 1024]
            point, slab = np.nonzero(self._away(a[:, None], b[:, None], self.slabs[None]) <= r[:, None])
            cells = slab[:, None] * self.side + np.arange(self.side)
            away = self._away(a[point, None], b[point, None], self.boxes[cells])
            away[away > r[point, None]] = np.inf
            code = (point[:, None] * self.side * self.side + cells).ravel()
            seen = np.array([p * self.side * self.side + c for p, cs in enumerate(met[i : i + 1024]) for c in cs], np.int64)
            fine = np.isfinite(away.ravel()) & ~np.isin(code, seen)
            code, away = code[fine], away.ravel()[fine]
            order = np.lexsort((away, code // (self.side * self.side)))
            who = code[order] // (self.side * self.side)
            rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
            some: list[list[int]] = [[] for _ in a]
            for p, c in zip(who[rank < RING].tolist(), (code[order] % (self.side * self.side))[rank < RING].tolist(), strict=True):
                some[p].append(c)
            out += some
        return out


def _turned(x, y, shrink: float):
    """Places on the turned axes, of columns or arrays."""
    return x * shrink * _COS + y * _SIN, y * _COS - x * shrink * _SIN


def _placed(df: DataFrame) -> DataFrame:
    """Rows with a finite place, as x and y."""
    fine = [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in ("longitude", "latitude")]
    return df.where(fine[0] & fine[1]).withColumns({"x": F.col("longitude").cast("double"), "y": F.col("latitude").cast("double")})


def index(centroids: DataFrame, n: int) -> tuple[Cells, DataFrame]:
    """Cells of about ``CELL`` centroids (x, y, u, v, ordinal, zone_id), and the centroids with their cell. Bounds are exact
    quantiles, found over ranges; one row per cell reaches the driver."""
    side = max(1, math.ceil(math.sqrt(n / max(CELL, n / CELLS))))
    cuts = [i / side for i in range(1, side)]
    slab_bounds, cell_bounds = np.zeros(0), np.zeros((side, 0))
    if cuts:
        slab_bounds = np.sort([r["value"] for r in quantiles(centroids, ["u"], cuts).collect()])
        slab = sum((F.when(F.col("u") > float(b), 1).otherwise(0) for b in slab_bounds), F.lit(0)) if side <= 8 else F.size(F.filter(F.array(*[F.lit(float(b)) for b in slab_bounds]), lambda b: b < F.col("u")))
        counts = centroids.select(slab.cast("string").alias("name"), F.col("v").alias("value")).groupBy("name", "value").agg(F.count("*").alias("n"))
        cell_bounds = np.full((side, side - 1), np.inf)
        got = quantiles_of_counts(counts, cuts).toPandas()
        for name, own in got.groupby("name"):
            cell_bounds[int(name)] = np.sort(own["value"].to_numpy())
    cells = Cells(side, slab_bounds, cell_bounds)
    kind = dict(centroids.dtypes)["zone_id"]

    def assign(batches):
        for batch in batches:
            cell = cells.of(batch.column("u").to_numpy(), batch.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], ["cell", *batch.schema.names])

    placed = checkpoint(centroids.select("u", "v", "x", "y", "ordinal", "zone_id").mapInArrow(assign, f"cell long, u double, v double, x double, y double, ordinal long, zone_id {kind}"))
    cells.fill(placed.groupBy("cell").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1")).toPandas())
    return cells, placed


def nearest(points: DataFrame, centroids: DataFrame, shrink: float, n: int) -> DataFrame:
    """point_id, zone_id, distance2: each point's nearest centroid, of equally near ones the first by ``ordinal``.

    A point first meets the cell that it lies in, then, in rounds of ``RING`` cells, the nearest others that can still
    hold a centroid as near as the best so far; it is done when there is none. So it meets a few cells, whatever the
    number of centroids. A cell's points are dealt to tasks of ``TASK`` points at most, each with the cell's centroids; of
    centroids in one place only the first by ``ordinal`` counts, so that cells are bounded too. Points without a place are left out.
    """
    one = _placed(centroids).select("x", "y", F.col("ordinal").cast("long").alias("ordinal"), "zone_id")
    u, v = _turned(F.col("x"), F.col("y"), shrink)
    distinct = checkpoint(one.groupBy("x", "y").agg(F.min(F.struct("ordinal", "zone_id")).alias("b")).select("x", "y", "b.*", u.alias("u"), v.alias("v")))
    cells, placed = index(distinct, n)
    kinds = dict(points.dtypes)["point_id"], dict(centroids.dtypes)["zone_id"]
    state = f"point_id {kinds[0]}, x double, y double, d2 double, ordinal long, zone_id {kinds[1]}, met array<long>, next array<long>"
    names = [c.split(" ")[0] for c in state.split(", ")]

    def located(batches):
        for batch in batches:
            px, py = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            home = cells.of(*_turned(px, py, shrink))
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("x"), batch.column("y"), pa.array([[c] for c in home.tolist()], pa.list_(pa.int64()))], ["point_id", "x", "y", "next"])

    def best(key: tuple, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("ordinal").reset_index(drop=True)
        px, py, cx, cy = (t[k].to_numpy() for t, k in ((p, "x"), (p, "y"), (c, "x"), (c, "y")))
        at, least = np.zeros(len(p), np.int64), np.full(len(p), np.inf)
        for i in range(0, len(p) if len(c) else 0, 2048):
            dx, dy = (px[i : i + 2048, None] - cx) * shrink, py[i : i + 2048, None] - cy
            d = dx * dx + dy * dy
            at[i : i + 2048], least[i : i + 2048] = d.argmin(1), d.min(1)
        return pd.DataFrame({"point_id": p["point_id"], "x": px, "y": py, "met": p["met"], "d2": least, "ordinal": c["ordinal"].to_numpy()[at] if len(c) else 0, "zone_id": pd.Series([c["zone_id"][k] for k in at] if len(c) else [None] * len(p), dtype=object)})

    def further(batches):
        for batch in batches:
            px, py = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            met = batch.column("met").to_pylist()
            ahead = cells.near(*_turned(px, py, shrink), batch.column("d2").to_numpy(), met)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names[:-1]], pa.array(ahead, pa.list_(pa.int64()))], names)

    located_points = _placed(points).select("point_id", "x", "y").mapInArrow(located, f"point_id {kinds[0]}, x double, y double, next array<long>")
    todo = located_points.select("point_id", "x", "y", F.lit(float("inf")).alias("d2"), F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast(kinds[1]).alias("zone_id"), F.array().cast("array<long>").alias("met"), "next")
    done = None
    while True:
        rows = checkpoint(todo.select("*", F.explode("next").alias("cell")).withColumn("met", F.array_union("met", "next")).drop("next"))
        tasks = rows.groupBy("cell").agg(F.ceil(F.count("*") / TASK).alias("tasks"))
        dealt = rows.join(F.broadcast(tasks), "cell").withColumn("task", F.pmod(F.xxhash64("point_id"), F.col("tasks")).cast("long"))
        copies = placed.join(F.broadcast(tasks), "cell").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
        found = dealt.select("cell", "task", "point_id", "x", "y", "met").groupBy("cell", "task").cogroup(copies.groupBy("cell", "task")).applyInPandas(best, f"point_id {kinds[0]}, x double, y double, met array<long>, d2 double, ordinal long, zone_id {kinds[1]}")
        every = found.unionByName(rows.where("d2 < double('Infinity')").select(*found.columns))
        merged = every.groupBy("point_id", "x", "y", "met").agg(F.min(F.struct("d2", "ordinal", "zone_id")).alias("b")).select("point_id", "x", "y", "b.*", "met")
        after = checkpoint(merged.select(*names[:-1]).mapInArrow(further, state))
        ready = after.where(F.size("next") == 0).select("point_id", "zone_id", F.col("d2").alias("distance2"))
        done = ready if done is None else done.unionByName(ready)
        todo = after.where(F.size("next") > 0)
        if todo.isEmpty():
            return done
