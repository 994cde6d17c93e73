"""Gram-Schmidt pan-sharpening: one pass for means and covariances, a small model on the driver, one map over pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.errors import ParamError, TerralithError
from terralith.functions.num import total
from terralith.operators import raster as R


@dataclass
class Parameters:
    weights: list[float]
    means: list[float]
    #: phi[band][component]: how much of each earlier component a band holds.
    phi: list[list[float]]
    gain: float
    bias: float


def valid(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Pixels without a masked band."""
    return pixels.dropna(subset=bands)


def statistics(pixels: DataFrame, pan: str, bands: list[str]) -> DataFrame:
    """One row: the mean of each band and the covariance of each two, over pixels valid in all."""
    names = [pan, *bands]
    means = [F.avg(c).alias(f"mean_{c}") for c in names]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = valid(pixels, names).agg(F.count("*").alias("n"), *means, *[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs])
    return one.select("*", *[F.col(f"cov_{a}_{b}").alias(f"cov_{b}_{a}") for a, b in pairs if a != b])


def tile_statistics(pixels: DataFrame, tile: str, names: list[str]) -> DataFrame:
    """By tile: how many pixels, the means, and the sums of products of deviations from them."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return valid(pixels, names).groupBy(tile).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in names], *[(F.covar_pop(a, b) * F.count("*")).alias(f"prod_{a}_{b}") for a, b in pairs])


def merged_statistics(tiles: DataFrame, names: list[str]) -> DataFrame:
    """Tile statistics as one: products gain what the tiles' means deviate from the whole's."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    n = F.sum("n")
    mean = {c: F.sum(F.col("n") * F.col(f"mean_{c}")) / n for c in names}
    between = {p: F.sum(F.col("n") * F.col(f"mean_{p[0]}") * F.col(f"mean_{p[1]}")) - n * mean[p[0]] * mean[p[1]] for p in pairs}
    return tiles.agg(n.alias("n"), *[mean[c].alias(f"mean_{c}") for c in names], *[((F.sum(f"prod_{a}_{b}") + between[a, b]) / (n - 1)).alias(f"cov_{a}_{b}") for a, b in pairs])


def fit_weights(cov: np.ndarray, given: list[float] | None = None) -> np.ndarray:
    """Weights of the bands in the pan band, none negative, adding up to 1.

    cov has the pan band first. Least squares; where a weight is negative, the bands with positive ones are fitted
    again, and should one still be negative the first fit stands; negative ones count as 0.
    """
    if given is not None:
        w = np.asarray(given, float)
    else:
        w = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
        if (w < 0).any():
            some = np.flatnonzero(w > 0)
            again = np.linalg.lstsq(cov[1:, 1:][np.ix_(some, some)], cov[1:, 0][some], rcond=None)[0]
            if (again >= 0).all():
                w = np.zeros_like(w)
                w[some] = again
    w = np.clip(w, 0, None)
    if not w.any():
        raise ValueError("All weights of the pan band are zero or negative.")
    return w / w.sum()


def fit_phi(cov: np.ndarray, weights: np.ndarray) -> list[list[float]]:
    """Coefficients of the Gram-Schmidt components, in terms of covariances of the bands alone."""
    n = len(weights)
    rows, phi = [weights], []
    for k in range(n):
        var = [a @ cov @ a for a in rows]
        phi.append([float(a @ cov[k] / v) if v > 0 else 0.0 for a, v in zip(rows, var, strict=True)])
        unit = np.zeros(n)
        unit[k] = 1
        rows.append(unit - sum(f * a for f, a in zip(phi[-1], rows, strict=True)))
    return phi


def parameters(pixels: DataFrame, pan: str, bands: list[str], weights: list[float] | None = None) -> Parameters:
    """The model of a pan band and others; one row of statistics comes to the driver."""
    names = [pan, *bands]
    row = statistics(pixels, pan, bands).first()
    if row["n"] < 2:
        raise ValueError("Pan-sharpening needs at least two valid pixels.")
    mean = np.array([row[f"mean_{c}"] for c in names])
    cov = np.array([[row[f"cov_{a}_{b}"] for b in names] for a in names])
    w = fit_weights(cov, weights)
    spread = w @ cov[1:, 1:] @ w
    gain = float(np.sqrt(spread / cov[0, 0]))
    return Parameters(w.tolist(), mean[1:].tolist(), fit_phi(cov[1:, 1:], w), gain, float(w @ mean[1:] - gain * mean[0]))


def simulated(bands: list[str], p: Parameters) -> Column:
    return total(F.col(b) * w for b, w in zip(bands, p.weights, strict=True))


def forward(pixels: DataFrame, bands: list[str], p: Parameters) -> DataFrame:
    """Adds g0 (the simulated pan band) and the components g1, g2, ... of the bands."""
    out = pixels.withColumn("g0", simulated(bands, p))
    for k, b in enumerate(bands):
        out = out.withColumn(f"g{k + 1}", F.col(b) - p.means[k] - total(F.col(f"g{m}") * f for m, f in enumerate(p.phi[k])))
    return out


def reverse(components: DataFrame, pan: str, bands: list[str], p: Parameters) -> DataFrame:
    """The bands from their components, with the adjusted pan band in place of the simulated one."""
    first = F.col(pan) * p.gain + p.bias
    new = {b: F.col(f"g{k + 1}") + p.means[k] + total((first if m == 0 else F.col(f"g{m}")) * f for m, f in enumerate(p.phi[k])) for k, b in enumerate(bands)}
    return components.withColumns(new)


def apply(pixels: DataFrame, pan: str, bands: list[str], p: Parameters) -> DataFrame:
    """Sharpened bands in one step: all components but the first keep their values, so that a band moves by its share of the first's change."""
    change = F.col(pan) * p.gain + p.bias - simulated(bands, p)
    return pixels.withColumns({b: F.col(b) + change * p.phi[k][0] for k, b in enumerate(bands)})


def sharpen(pixels: DataFrame, pan: str, bands: list[str], weights: list[float] | None = None) -> DataFrame:
    names = [pan, *bands]
    return apply(valid(pixels, names), pan, bands, parameters(pixels, pan, bands, weights))


def overlap(rects: DataFrame, other: tuple[float, float, float, float]) -> Column:
    """Whether rectangles (x0, y0, x1, y1) share an area with another."""
    x0, y0, x1, y1 = other
    return (F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0)


@dataclass(frozen=True)
class Raster:
    """Where a raster lies: the corner of its first pixel, its pixels' size (dy is negative), rows and columns."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.x0, self.y0 + self.dy * self.rows, self.x0 + self.dx * self.cols, self.y0

    def window(self, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
        """First column and row, and the ones after the last, of whole pixels that hold the part of bounds within the raster."""
        x0, y0, x1, y1 = bounds
        cols = (x0 - self.x0) / self.dx, (x1 - self.x0) / self.dx
        rows = (y1 - self.y0) / self.dy, (y0 - self.y0) / self.dy
        (c0, c1), (r0, r1) = ((max(0.0, a), min(float(n), b)) for (a, b), n in ((cols, self.cols), (rows, self.rows)))
        if c0 >= c1 or r0 >= r1:
            raise TerralithError("The pan image and the others don't overlap")
        return math.floor(c0), math.floor(r0), math.ceil(c1), math.ceil(r1)


def fitted_over(other: Raster, rows: int, cols: int) -> Raster:
    """A raster without a place of its own that covers what another does."""
    return Raster(other.x0, other.y0, other.dx * other.cols / cols, other.dy * other.rows / rows, rows, cols)


def check_rasters(pan: Raster, ms: Raster) -> tuple[tuple[int, int, int, int], tuple[int, int, int, int]]:
    """The windows of both that their shared bounds need; a pan image that is coarser than the others is an error."""
    if pan.dx > ms.dx or -pan.dy > -ms.dy:
        raise TerralithError("The pan image is coarser than the others")
    return pan.window(ms.bounds), ms.window(pan.bounds)


def colour_bands(alpha: list[bool]) -> list[int]:
    """Numbers of the bands that aren't alpha."""
    return [k + 1 for k, a in enumerate(alpha) if not a]


def check_weights(weights: list[float] | None, bands: int) -> None:
    if weights is not None and (len(weights) != bands or min(weights) < 0):
        raise ParamError(f"{bands} weights that aren't negative are needed")


def sharpen_images(pan: DataFrame, pan_at: Raster, ms: DataFrame, ms_at: Raster, bands: list[int], kernel: str = "cubic", weights: list[float] | None = None) -> DataFrame:
    """i, j and bands (b1, b2, ... by number) on the pan image's pixels, of pan (i, j, v) and others (band, i, j, v).

    The model is fitted where the pan image, averaged, meets the others' pixels; the others are resampled to the pan
    image's pixels for the transform. Pixels that are masked in any band are left out.
    """
    check_weights(weights, len(bands))
    (pj0, pi0, pj1, pi1), (mj0, mi0, mj1, mi1) = check_rasters(pan_at, ms_at)
    names = [f"b{b}" for b in bands]
    inside = lambda t, i0, i1, j0, j1: t.where(F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1))
    wide = ms.where(F.col("band").isin(bands)).groupBy("i", "j").agg(*(F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"b{b}") for b in bands))
    factor = ms_at.dx / pan_at.dx, ms_at.dy / pan_at.dy
    shift = (pan_at.x0 - ms_at.x0) / pan_at.dx, (pan_at.y0 - ms_at.y0) / pan_at.dy
    coarse = R.averaged(inside(pan, pi0, pi1, pj0, pj1), factor[1], factor[0], None, shift[1], shift[0]).select(F.col("r").alias("i"), F.col("c").alias("j"), F.col("v").alias("pan"))
    fit = parameters(inside(wide, mi0, mi1, mj0, mj1).join(coarse, ["i", "j"]), "pan", names, weights)
    fine = inside(pan, pi0, pi1, pj0, pj1).select("i", "j", F.col("v").alias("pan"))
    at = fine.select(F.col("i").alias("r"), F.col("j").alias("c"), "pan")
    j, i = ((F.col(n) + 0.5 + s) / f - 0.5 for n, s, f in (("c", shift[0], factor[0]), ("r", shift[1], factor[1])))
    up = R.resampled(at, ms.where(F.col("band").isin(bands)), j, i, kernel).groupBy("r", "c", "pan").agg(*(F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"b{b}") for b in bands))
    return apply(valid(up, ["pan", *names]), "pan", names, fit).select(F.col("r").alias("i"), F.col("c").alias("j"), *names)
