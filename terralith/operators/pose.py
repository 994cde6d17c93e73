"""Poses of frame cameras from control points: Gauss-Newton for images, many at a time, after a linear start."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terralith.operators.groups import in_batches


@dataclass(frozen=True)
class Interior:
    fx: float
    fy: float
    cx: float
    cy: float


def rotation(omega: float, phi: float, kappa: float) -> np.ndarray:
    (co, so), (cp, sp), (ck, sk) = ((np.cos(a), np.sin(a)) for a in (omega, phi, kappa))
    rx, ry, rz = np.array([[1, 0, 0], [0, co, -so], [0, so, co]]), np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]]), np.array([[ck, -sk, 0], [sk, ck, 0], [0, 0, 1]])
    return rx @ ry @ rz @ np.diag([1, -1, -1])


def project(p: np.ndarray, xyz: np.ndarray, k: Interior) -> np.ndarray:
    c = (xyz - p[:3]) @ rotation(*p[3:])
    return np.column_stack([k.fx * c[:, 0] / c[:, 2] + k.cx, k.fy * c[:, 1] / c[:, 2] + k.cy])


def start(xyz: np.ndarray, px: np.ndarray, k: Interior) -> np.ndarray:
    """A camera that looks down: a similarity between the ground and the image gives turn, height and place."""
    g, q = xyz[:, :2] - xyz[:, :2].mean(0), np.column_stack([(px[:, 0] - k.cx) / k.fx, -(px[:, 1] - k.cy) / k.fy])
    z = (g[:, 0] + 1j * g[:, 1]), ((q - q.mean(0))[:, 0] + 1j * (q - q.mean(0))[:, 1])
    s = np.vdot(z[1], z[0]) / max(np.vdot(z[1], z[1]).real, 1e-12)
    at = xyz[:, :2].mean(0) - np.array([(s * complex(*q.mean(0))).real, (s * complex(*q.mean(0))).imag])
    return np.array([*at, xyz[:, 2].mean() + abs(s), 0.0, 0.0, np.angle(s)])


def solve(xyz: np.ndarray, px: np.ndarray, k: Interior, steps: int = 60) -> tuple[np.ndarray, float]:
    """The pose of one image and its root mean square error in pixels: see solve_all()."""
    p, rmse = solve_all(xyz, px, np.array([0]), k, steps)
    return p[0], float(rmse[0])


def _rotations(p: np.ndarray) -> np.ndarray:
    """rotation() of each pose."""
    (co, cp, ck), (so, sp, sk) = np.cos(p[:, 3:]).T, np.sin(p[:, 3:]).T
    rows = [cp * ck, cp * sk, -sp, co * sk + so * sp * ck, -(co * ck - so * sp * sk), so * cp, so * sk - co * sp * ck, -(so * ck + co * sp * sk), -co * cp]
    return np.stack(rows, 1).reshape(-1, 3, 3)


def _residuals(p: np.ndarray, of: np.ndarray, xyz: np.ndarray, px: np.ndarray, k: Interior) -> np.ndarray:
    """How far each point is projected from where it is seen, by the pose of its image."""
    c = np.einsum("na,nab->nb", xyz - p[of, :3], _rotations(p)[of])
    return np.stack([k.fx * c[:, 0] / c[:, 2] + k.cx, k.fy * c[:, 1] / c[:, 2] + k.cy], 1) - px


def solve_all(xyz: np.ndarray, px: np.ndarray, starts: np.ndarray, k: Interior, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt for many images at once, up to an error of 1e-10 pixels; poses and root mean square errors.

    An image's points follow one another from its start on. Each image has its own steps and damping, and takes no
    part any more once it is found.
    """
    counts = np.diff(np.r_[starts, len(px)])
    p = np.array([start(xyz[a : a + n], px[a : a + n], k) for a, n in zip(starts, counts, strict=True)])
    damp, scale = np.full(len(p), 1e-3), np.array([1.0, 1.0, 1.0, 1e-4, 1e-4, 1e-4])
    r = _residuals(p, np.repeat(np.arange(len(p)), counts), xyz, px, k)
    error = np.add.reduceat((r * r).sum(1), starts)
    live = np.arange(len(p))
    for _ in range(steps):
        live = live[~(error[live] < 1e-20)]
        if not len(live):
            break
        n = counts[live]
        of, first = np.repeat(np.arange(len(live)), n), np.r_[0, np.cumsum(n)[:-1]]
        points = np.arange(n.sum()) - np.repeat(first - starts[live], n)
        q, at, seen, now = p[live], xyz[points], px[points], r[points]
        jac = np.stack([(_residuals(q + scale * e, of, at, seen, k) - _residuals(q - scale * e, of, at, seen, k)) / (2 * (scale @ e)) for e in np.eye(6)], 2)
        a = np.add.reduceat(np.einsum("npa,npb->nab", jac, jac), first)
        b = np.add.reduceat(np.einsum("npa,np->na", jac, now), first)
        damped = a + damp[live, None, None] * np.einsum("nab,ab->nab", a, np.eye(6))
        ok = np.isfinite(damped).all((1, 2)) & np.isfinite(b).all(1)
        step = np.zeros_like(b)
        step[ok] = np.einsum("nab,nb->na", np.linalg.pinv(damped[ok], rcond=6 * np.finfo(float).eps, hermitian=True), -b[ok])
        new = _residuals(q + step, of, at, seen, k)
        less = np.add.reduceat((new * new).sum(1), first)
        better = less < error[live]
        p[live[better]] += step[better]
        error[live[better]] = less[better]
        r[points[better[of]]] = new[better[of]]
        damp[live] = np.where(better, damp[live] / 5, damp[live] * 5)
        live = live[ok]
    return p, np.sqrt(error / counts)


def fit_exterior(points: DataFrame, interior: Interior, least: int = 3) -> DataFrame:
    """filename, x, y, z, omega, phi, kappa, rmse of images with at least so many points (x, y, z, j, i).

    An image's control points are few; images are fitted many at a time.
    """
    names = ["x", "y", "z", "omega", "phi", "kappa"]

    def fit(t: pa.Table, starts: np.ndarray) -> pa.Table:
        counts = np.diff(np.r_[starts, t.num_rows])
        enough = counts >= least
        v = np.stack([t.column(c).to_numpy().astype(float) for c in ("x", "y", "z", "j", "i")], 1)[np.repeat(enough, counts)]
        first, counts = starts[enough], counts[enough]
        p, rmse = solve_all(v[:, :3], v[:, 3:], np.r_[0, np.cumsum(counts)[:-1]], interior) if len(first) else (np.empty((0, 6)), np.empty(0))
        return pa.table({"filename": t.column("filename").take(pa.array(first)), **{c: p[:, n] for n, c in enumerate(names)}, "rmse": rmse})

    return in_batches(points.select("filename", "x", "y", "z", "j", "i"), "filename", fit, "filename string, " + ", ".join(f"{c} double" for c in (*names, "rmse")))
