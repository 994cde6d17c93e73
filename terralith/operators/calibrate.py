"""Calibration of frame cameras from control points: interior parameters, distortion and the pose of every image."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terralith.operators import pose

#: Distortion coefficients that are fitted, by kind of camera.
FITTED = {"pinhole": (), "brown": ("k1", "k2", "p1", "p2", "k3"), "opencv": ("k1", "k2", "p1", "p2", "k3"), "fisheye": ("k1", "k2", "k3", "k4")}
LEAST_POINTS = 4


def bent(kind: str, d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distorted camera coordinates."""
    if kind == "pinhole":
        return u, v
    r2 = u * u + v * v
    if kind == "fisheye":
        r = np.sqrt(r2)
        a = np.arctan(r)
        q = a * a
        scale = np.where(r > 0, a * (1 + q * (d[0] + q * (d[1] + q * (d[2] + q * d[3])))) / np.where(r > 0, r, 1), 1.0)
        return u * scale, v * scale
    k1, k2, p1, p2, k3 = d
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u), v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v


def _project(kind: str, shared: np.ndarray, p: np.ndarray, xyz: np.ndarray) -> np.ndarray:
    c = (xyz - p[:3]) @ pose.rotation(*p[3:])
    u, v = bent(kind, shared[3:], c[:, 0] / c[:, 2], c[:, 1] / c[:, 2])
    return np.column_stack([shared[0] * u + shared[1], shared[0] * v + shared[2]])


def solve(kind: str, size: tuple[int, int], points: list[tuple[np.ndarray, np.ndarray]], steps: int = 100) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Shared parameters (focal length, centre, distortion), a pose an image, and the root mean square error in pixels.

    Levenberg-Marquardt: poses of different images share no equations, so that each is eliminated from the normal
    equations of the shared parameters, and found again after them. Pixels are square.
    """
    m = 3 + len(FITTED[kind])
    # how many coefficients the points can bear: 2 equations a point, 6 unknowns an image
    spare = 2 * sum(len(x) for x, _ in points) - 6 * len(points)
    free = min(m, max(1, spare))
    shared = np.zeros(m)
    shared[:3] = max(size), (size[0] - 1) / 2, (size[1] - 1) / 2
    best = None
    for focal in (0.6, 0.85, 1.2, 1.7):
        trial = shared.copy()
        trial[0] = focal * max(size)
        fitted = [pose.solve(x, px, pose.Interior(trial[0], trial[0], trial[1], trial[2])) for x, px in points]
        error = sum(e * e * len(x) for (_, e), (x, _) in zip(fitted, points, strict=True))
        if best is None or error < best[0]:
            best = error, trial, [p for p, _ in fitted]
    _, shared, poses = best
    unit, scale = np.eye(6), np.array([1.0, 1.0, 1.0, 1e-4, 1e-4, 1e-4])
    steps_of = np.concatenate([[1e-3, 1e-3, 1e-3], np.full(m - 3, 1e-6)])
    damp = 1e-3
    residual = lambda s, ps: [(_project(kind, s, p, x) - px).ravel() for p, (x, px) in zip(ps, points, strict=True)]
    r = residual(shared, poses)
    cost = sum(float(e @ e) for e in r)
    for _ in range(steps):
        if cost < 1e-18:
            break
        a, g, parts = np.zeros((free, free)), np.zeros(free), []
        for p, (x, _), e in zip(poses, points, r, strict=True):
            js = np.stack([(_project(kind, shared + d, p, x) - _project(kind, shared - d, p, x)).ravel() / (2 * h) for h, d in zip(steps_of[:free], np.diag(steps_of)[:free], strict=True)], 1)
            jp = np.stack([(_project(kind, shared, p + scale * k, x) - _project(kind, shared, p - scale * k, x)).ravel() / (2 * (scale @ k)) for k in unit], 1)
            h = jp.T @ jp
            h += damp * np.diag(np.diag(h))
            back = np.linalg.lstsq(h, np.column_stack([jp.T @ js, jp.T @ e]), rcond=None)[0]
            cross = js.T @ jp
            a += js.T @ js - cross @ back[:, :free]
            g += js.T @ e - cross @ back[:, free]
            parts.append(back)
        move = np.linalg.lstsq(a + damp * np.diag(np.diag(a)), -g, rcond=None)[0]
        new = shared.copy()
        new[:free] += move
        moved = [p - b[:, free] - b[:, :free] @ move for p, b in zip(poses, parts, strict=True)]
        tried = residual(new, moved)
        after = sum(float(e @ e) for e in tried)
        if after < cost and new[0] > 0:
            done = cost - after < 1e-14 * cost
            shared, poses, r, cost, damp = new, moved, tried, after, damp / 5
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return shared, poses, math.sqrt(cost / max(1, sum(len(x) for x, _ in points)))


def fit_frame(points: DataFrame, kind: str, size: tuple[int, int]) -> DataFrame:
    """camera, filename, fx, cx, cy, distortion, x, y, z, omega, phi, kappa, rmse and error: a row an image.

    points: camera, filename, x, y, z, j, i. A camera is calibrated by all its images' points together, in one task: an
    image's control points are few, and a camera's images of a test field are too. Images with fewer than four points, or
    a camera with too few in all, give rows whose error says so. Points are taken relative to their mean.
    """
    names = FITTED[kind]
    columns = ["camera", "filename", "fx", "cx", "cy", *names, "x", "y", "z", "omega", "phi", "kappa", "rmse", "error"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = list(pdf.groupby("filename", sort=True))
        few = [n for n, g in groups if len(g) < LEAST_POINTS]
        total = len(pdf) >= max(LEAST_POINTS, math.ceil((1 + 3 + len(names) + 6 * len(groups)) / 2))
        offset = pdf[["x", "y", "z"]].to_numpy(float).mean(0)
        flat = abs(pdf["z"].to_numpy(float).std()) < 1e-5
        why = f"{few[0]} has fewer than {LEAST_POINTS} control points" if few else None if total else "The camera has too few control points"
        if why is None and len(groups) == 1 and flat:
            why = "Control points of one image lie in one plane"
        if why:
            return pd.DataFrame([[pdf["camera"].iloc[0], n, *[math.nan] * (len(columns) - 3), why] for n, _ in groups], columns=columns)
        data = [(g[["x", "y", "z"]].to_numpy(float) - offset, g[["j", "i"]].to_numpy(float)) for _, g in groups]
        shared, poses, rmse = solve(kind, size, data)
        return pd.DataFrame([[pdf["camera"].iloc[0], n, *shared, *(p[:3] + offset), *p[3:], rmse, None] for (n, _), p in zip(groups, poses, strict=True)], columns=columns)

    ddl = "camera string, filename string, " + ", ".join(f"{c} double" for c in columns[2:-1]) + ", error string"
    return points.select("camera", "filename", "x", "y", "z", "j", "i").groupBy("camera").applyInPandas(one, ddl)
