"""Iterative inverses of camera models: numpy kernels in Arrow batches, as no closed form exists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.functions.cameras import COEFFICIENTS, RPC_TERMS


def undistort_brown(u: np.ndarray, v: np.ndarray, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0, steps: int = 50):
    """Fixed-point iteration of the Brown model."""
    x, y = u.copy(), v.copy()
    for _ in range(steps):
        r2 = x * x + y * y
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        x, y = (u - 2 * p1 * x * y - p2 * (r2 + 2 * x * x)) / radial, (v - p1 * (r2 + 2 * y * y) - 2 * p2 * x * y) / radial
    return x, y


def undistort_opencv(u: np.ndarray, v: np.ndarray, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0, k4=0.0, k5=0.0, k6=0.0, s1=0.0, s2=0.0, s3=0.0, s4=0.0, t1=0.0, t2=0.0, steps: int = 50):
    """The tilt of the sensor is undone in one step, then a fixed-point iteration undoes prism, tangential and radial terms."""
    if t1 or t2:
        (ca, sa), (cb, sb) = ((np.cos(a), np.sin(a)) for a in (t1, t2))
        rot = np.array([[cb, sb * sa, -sb * ca], [0.0, ca, sa], [sb, -cb * sa, cb * ca]])
        tilt = np.array([[rot[2, 2], 0.0, -rot[0, 2]], [0.0, rot[2, 2], -rot[1, 2]], [0.0, 0.0, 1.0]]) @ rot
        a, b, w = np.linalg.inv(tilt) @ np.stack([u, v, np.ones_like(u)])
        u, v = a / w, b / w
    x, y = u.copy(), v.copy()
    for _ in range(steps):
        r2 = x * x + y * y
        scale = (1 + r2 * (k4 + r2 * (k5 + r2 * k6))) / (1 + r2 * (k1 + r2 * (k2 + r2 * k3)))
        dx = 2 * p1 * x * y + p2 * (r2 + 2 * x * x) + r2 * (s1 + r2 * s2)
        dy = p1 * (r2 + 2 * y * y) + 2 * p2 * x * y + r2 * (s3 + r2 * s4)
        x, y = (u - dx) * scale, (v - dy) * scale
    return x, y


def undistort_fisheye(u: np.ndarray, v: np.ndarray, k1=0.0, k2=0.0, k3=0.0, k4=0.0, steps: int = 20):
    """Newton's method for the angle."""
    bent = np.hypot(u, v)
    angle = np.minimum(bent, np.pi / 2)
    for _ in range(steps):
        q = angle * angle
        value = angle * (1 + q * (k1 + q * (k2 + q * (k3 + q * k4)))) - bent
        slope = 1 + q * (3 * k1 + q * (5 * k2 + q * (7 * k3 + q * 9 * k4)))
        angle = angle - value / np.where(slope == 0, 1, slope)
    scale = np.where(bent > 0, np.tan(angle) / np.where(bent > 0, bent, 1), 1)
    return u * scale, v * scale


def same(u: np.ndarray, v: np.ndarray):
    return u, v


INVERSES = {"pinhole": same, "brown": undistort_brown, "opencv": undistort_opencv, "fisheye": undistort_fisheye}


def undistorted(kind: str, coefficients: dict[str, float], u: Column, v: Column) -> Column:
    """struct<u, v>: ideal camera coordinates of distorted ones."""
    inverse = INVERSES[kind]

    @F.pandas_udf("u double, v double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = inverse(a.to_numpy(float), b.to_numpy(float), **coefficients)
        return pd.DataFrame({"u": x, "v": y}).replace([np.inf, -np.inf], np.nan)

    return run(u, v)


def rpc_value(c: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A 20-term cubic with a row of coefficients for each place."""
    return sum(c[:, k] * x**a * y**b * z**d for k, (a, b, d) in enumerate(RPC_TERMS))


RPC_PARTS = ("samp_num", "samp_den", "line_num", "line_den")


def rpc_to_world(rpc: Column, j: Column, i: Column, height: Column, steps: int = 12) -> Column:
    """struct<lon, lat> that a row's rational polynomial model projects to a pixel at a height: Newton's method with finite differences.

    NULL where any of the four is.
    """

    @F.pandas_udf("lon double, lat double")
    def run(js: pd.Series, is_: pd.Series, hs: pd.Series, off: pd.Series, *parts: pd.Series) -> pd.DataFrame:
        known = (js.notna() & is_.notna() & hs.notna() & off.notna()).to_numpy()
        out = np.full((len(js), 2), np.nan)
        if known.any():
            n = np.stack(off[known].to_numpy()).astype(float)
            samp_off, samp_scale, line_off, line_scale, long_off, long_scale, lat_off, lat_scale, height_off, height_scale = n.T
            c = [np.stack(p[known].to_numpy()).astype(float) for p in parts]
            project = lambda x, y: (rpc_value(c[0], x, y, z) / rpc_value(c[1], x, y, z), rpc_value(c[2], x, y, z) / rpc_value(c[3], x, y, z))
            s, t = (js[known].to_numpy(float) - samp_off) / samp_scale, (is_[known].to_numpy(float) - line_off) / line_scale
            z = (hs[known].to_numpy(float) - height_off) / height_scale
            x, y, e = np.zeros_like(s), np.zeros_like(s), 1e-6
            for _ in range(steps):
                a, b = project(x, y)
                ax, bx = (np.subtract(p, q) / e for p, q in zip(project(x + e, y), (a, b), strict=True))
                ay, by = (np.subtract(p, q) / e for p, q in zip(project(x, y + e), (a, b), strict=True))
                det = ax * by - ay * bx
                x, y = x + ((s - a) * by - (t - b) * ay) / det, y + ((t - b) * ax - (s - a) * bx) / det
            out[known] = np.stack([x * long_scale + long_off, y * lat_scale + lat_off], 1)
        return pd.DataFrame({"lon": out[:, 0], "lat": out[:, 1]})

    scalars = F.array(*(rpc[f"{n}_{part}"].cast("double") for n in ("samp", "line", "long", "lat", "height") for part in ("off", "scale")))
    return run(j.cast("double"), i.cast("double"), height.cast("double"), scalars, *(rpc[f"{p}_coeff"] for p in RPC_PARTS))


def undistorted_each(kind: Column, lens: dict[str, Column], u: Column, v: Column) -> Column:
    """struct<u, v>: ideal camera coordinates of distorted ones, each row by its own kind of camera and coefficients."""
    names = list(lens)

    @F.pandas_udf("u double, v double")
    def run(kinds: pd.Series, a: pd.Series, b: pd.Series, *values: pd.Series) -> pd.DataFrame:
        x, y = a.to_numpy(float).copy(), b.to_numpy(float).copy()
        given = {n: s.fillna(0.0).to_numpy(float) for n, s in zip(names, values, strict=True)}
        for one in kinds.dropna().unique():
            at = np.flatnonzero((kinds == one).to_numpy())
            own = {n: given[n][at] for n in COEFFICIENTS[one] if n in given}
            if one == "opencv":  # tilts are undone camera by camera, as each has a matrix of its own
                for t1, t2 in {(p, q) for p, q in zip(own.get("t1", [0.0]), own.get("t2", [0.0]), strict=True)}:
                    some = np.flatnonzero((own["t1"] == t1) & (own["t2"] == t2)) if "t1" in own else np.arange(len(at))
                    part = {n: c[some] for n, c in own.items() if n not in ("t1", "t2")}
                    x[at[some]], y[at[some]] = undistort_opencv(x[at[some]], y[at[some]], **part, t1=t1, t2=t2)
            else:
                x[at], y[at] = INVERSES[one](x[at], y[at], **own)
        return pd.DataFrame({"u": x, "v": y}).replace([np.inf, -np.inf], np.nan)

    return run(kind, u, v, *lens.values())
