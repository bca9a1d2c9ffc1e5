"""Order-dependent operators, one group at a time in vectorised Python: greedy suppression, matching, dedup and ordering.

A group is one plan (or plan and class), which one task can hold; groups run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from planweave.functions.shared import partitions


def _groups(df: DataFrame, *keys: str):
    """df grouped by keys over as many tasks as a shuffle has: a group costs far more time than its bytes tell, by which small partitions would be joined to one."""
    return df.repartition(partitions(df.sparkSession), *keys).groupBy(*keys)


def _ious(b: np.ndarray, rest: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(b[2], rest[:, 2]) - np.maximum(b[0], rest[:, 0]), 0, None)
    h = np.clip(np.minimum(b[3], rest[:, 3]) - np.maximum(b[1], rest[:, 1]), 0, None)
    i = w * h
    u = (b[2] - b[0]) * (b[3] - b[1]) + (rest[:, 2] - rest[:, 0]) * (rest[:, 3] - rest[:, 1]) - i
    return np.divide(i, u, out=np.zeros(len(rest)), where=u > 0)


def suppress(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Greedy non-maximum suppression per group: by score down and id up, boxes above the IoU threshold with a kept one go.

    boxes: keys, id, score, x1, y1, x2, y2; rows with a null among these are left out.
    """
    columns = [*keys, "id", "score", "x1", "y1", "x2", "y2"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        b = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        alive, keep = np.ones(len(b), bool), []
        for k in range(len(b)):
            if alive[k]:
                keep.append(k)
                alive[k + 1 :] &= _ious(b[k], b[k + 1 :]) <= threshold
        return pdf.iloc[keep]

    df = boxes.select(*columns).dropna()
    return _groups(df, *keys).applyInPandas(one, df.schema)


def radius_dedup(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Per group and in order, a point is kept unless a kept one is nearer than the radius. points: key, ord, x, y."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        xy, kept = pdf[["x", "y"]].to_numpy(float), []
        for k in range(len(xy)):
            if not kept or (np.hypot(*(xy[kept] - xy[k]).T) >= radius).all():
                kept.append(k)
        return pdf.iloc[kept]

    df = points.select(key, "ord", "x", "y").dropna()
    return _groups(df, key).applyInPandas(one, df.schema)


def match(predicted: DataFrame, truth: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, id, truth_id, iou): predictions by score down, each takes the free truth of its class with the highest IoU from the threshold on."""

    def one(k, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", "id"], ascending=[False, True])
        free, out = np.ones(len(t), bool), []
        t = t.sort_values("id")
        tb, tc, ti = t[["x1", "y1", "x2", "y2"]].to_numpy(float), t["label"].to_numpy(), t["id"].to_numpy()
        for row in p.itertuples():
            v = np.where(free & (tc == row.label), _ious(np.array([row.x1, row.y1, row.x2, row.y2], float), tb), -1) if len(t) else np.zeros(0)
            if len(v) and v.max() >= threshold:
                j = int(v.argmax())
                free[j] = False
                out.append((k[0], row.id, ti[j], float(v[j])))
            else:
                out.append((k[0], row.id, None, 0.0))
        return pd.DataFrame(out, columns=[key, "id", "truth_id", "iou"])

    kind = dict(predicted.dtypes)
    schema = f"{key} {kind[key]}, id {kind['id']}, truth_id {dict(truth.dtypes)['id']}, iou double"
    return _groups(predicted, key).cogroup(_groups(truth, key)).applyInPandas(one, schema)


def chain(points: DataFrame, key: str) -> DataFrame:
    """Greedy nearest-neighbour order per group, from the first point on: key, ord, x, y and the place in the chain."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        xy, left, at, place = pdf[["x", "y"]].to_numpy(float), np.ones(len(pdf), bool), 0, np.zeros(len(pdf), np.int64)
        for k in range(len(pdf)):
            left[at] = False
            place[at] = k
            if left.any():
                at = int(np.where(left, np.hypot(*(xy - xy[at]).T), np.inf).argmin())
        return pdf.assign(place=place)

    df = points.select(key, "ord", "x", "y").dropna()
    return _groups(df, key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, ord {dict(df.dtypes)['ord']}, x double, y double, place long")


def simplified(lines: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Douglas-Peucker per group: the points that stay, in order. lines: key, ord, x, y."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        xy = pdf[["x", "y"]].to_numpy(float)
        keep, spans = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
        keep[[0, -1]] = True
        while spans:
            a, b = spans.pop()
            if b - a < 2:
                continue
            d, p = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
            size = np.hypot(*d)
            far = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / size if size else np.hypot(*p.T)
            k = int(far.argmax())
            if far[k] > tolerance:
                keep[a + 1 + k] = True
                spans += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf[keep]

    df = lines.select(key, "ord", "x", "y").dropna()
    return _groups(df, key).applyInPandas(one, df.schema)


def footprint(rooms: DataFrame) -> DataFrame:
    """(plan_id, area, parts, exterior): the union of a plan's rectilinear rooms on its own coordinate grid.

    exterior: edges (x1, y1, x2, y2) between the union and the outside, courtyards not counted; null if the union has
    several parts or a room is not rectilinear. rooms: plan_id, ring.
    """

    def labelled(grid: np.ndarray) -> tuple[np.ndarray, int]:
        """Number of the connected part of each true cell: least cell numbers spread along rows and columns of cells until they stay."""
        label = np.where(grid, np.arange(1, grid.size + 1).reshape(grid.shape), 0)
        runs = []
        for g in (grid, grid.T):
            flat = np.concatenate([g, np.zeros((g.shape[0], 1), bool)], 1).ravel()
            edge = np.flatnonzero(np.diff(flat.astype(np.int8), prepend=0) == 1)
            runs.append((edge, np.cumsum(np.diff(flat.astype(np.int8), prepend=0) == 1)[flat] - 1))
        while grid.any():
            before = label
            for turn, (edge, which) in enumerate(runs):
                v = label if turn == 0 else label.T
                g = grid if turn == 0 else grid.T
                low = np.full(len(edge), grid.size + 1)
                np.minimum.at(low, which, v[g])
                new = np.zeros_like(v)
                new[g] = low[which]
                label = new if turn == 0 else new.T
            if (label == before).all():
                break
        return label, len(np.unique(label[grid]))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [np.array([(p["x"], p["y"]) for p in r], float) for r in pdf["ring"] if r is not None and len(r) >= 3]
        plan = pdf["plan_id"].iloc[0]
        if not rings:
            return pd.DataFrame({"plan_id": [plan], "area": [0.0], "parts": [0], "exterior": [None]})
        straight = all(((np.roll(r, -1, 0) == r).any(1)).all() for r in rings)
        xs, ys = np.unique(np.concatenate(rings)[:, 0]), np.unique(np.concatenate(rings)[:, 1])
        cx, cy = (xs[1:] + xs[:-1]) / 2, (ys[1:] + ys[:-1]) / 2
        inside = np.zeros((len(cx) + 2, len(cy) + 2), bool)
        for r in rings:
            a, b = r, np.roll(r, -1, 0)
            up = (a[:, 1][:, None] > cy) != (b[:, 1][:, None] > cy)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = a[:, 0][:, None] + (cy - a[:, 1][:, None]) * ((b - a)[:, 0] / (b - a)[:, 1])[:, None]
            inside[1:-1, 1:-1] |= ((up[None] & (cx[:, None, None] < at[None])).sum(1) % 2).astype(bool)
        area = float((np.diff(xs)[:, None] * np.diff(ys)[None] * inside[1:-1, 1:-1]).sum())
        _, parts = labelled(inside)
        edges = None
        if straight and parts == 1:
            outer = labelled(~inside)[0]
            outside = outer == outer[0, 0]
            edges = []
            for di, dj in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                i, j = np.nonzero(inside & np.roll(outside, (-di, -dj), (0, 1)))
                # The side of the cell that faces the outside.
                x1, x2 = xs[i - (di <= 0)], xs[i - (di < 0)]
                y1, y2 = ys[j - (dj <= 0)], ys[j - (dj < 0)]
                edges.append(np.stack([x1, y1, x2, y2], 1))
            edges = [[float(v) for v in e] for e in np.concatenate(edges)]
        return pd.DataFrame({"plan_id": [plan], "area": [area], "parts": [parts], "exterior": [edges]})

    return _groups(rooms.select("plan_id", "ring"), "plan_id").applyInPandas(one, "plan_id string, area double, parts int, exterior array<array<double>>")
