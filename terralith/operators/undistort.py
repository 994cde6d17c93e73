"""Images and pixels with and without lens distortion, for a camera whose parameters are numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import cameras as C
from terralith.functions import inverse
from terralith.operators import raster as R


@dataclass(frozen=True)
class Lens:
    """Image size, focal lengths and centre in pixels, and the distortion of a kind of camera."""

    size: tuple[int, int]
    fx: float
    fy: float
    cx: float
    cy: float
    kind: str = "pinhole"
    d: dict = field(default_factory=dict)

    @staticmethod
    def of(size: tuple[int, int], focal: float | tuple[float, float], sensor: tuple[float, float] | None = None, cx: float = 0.0, cy: float = 0.0, kind: str = "pinhole", d: dict | None = None) -> Lens:
        """From parameters as files have them; without a sensor size, focal lengths are in units of the width."""
        fx, fy = (focal, focal) if isinstance(focal, (int, float)) else focal
        units = (size[0] / sensor[0], size[1] / sensor[1]) if sensor else (size[0], size[0])
        longest = max(size)
        return Lens(size, fx * units[0], fy * units[1], (size[0] - 1) / 2 + longest * cx, (size[1] - 1) / 2 + longest * cy, kind, d or {})

    def intrinsic(self) -> C.Intrinsic:
        return C.Intrinsic(*(F.lit(float(v)) for v in (self.fx, self.fy, self.cx, self.cy)))

    def ideal(self, j: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Camera coordinates of pixels without distortion."""
        return inverse.INVERSES[self.kind]((j - self.cx) / self.fx, (i - self.cy) / self.fy, **self.d)

    def straight(self, alpha: float = 1.0) -> Lens:
        """The camera of the undistorted image of the same size: alpha 0 shows valid pixels alone, 1 all of the source."""
        w, h = self.size[0] - 1, self.size[1] - 1
        j, i = (a.ravel() for a in np.meshgrid(np.arange(9) * w / 8, np.arange(9) * h / 8))
        u, v = self.ideal(j, i)
        left, top, right, bottom = j == 0, i == 0, j == w, i == h
        inner = u[left].max(), v[top].max(), u[right].min(), v[bottom].min()
        outer = u.min(), v.min(), u.max(), v.max()
        alpha = min(1.0, max(0.0, alpha))

        def fitted(box):
            fx, fy = w / (box[2] - box[0]), h / (box[3] - box[1])
            return np.array([fx, fy, -fx * box[0], -fy * box[1]])

        return Lens(self.size, *(fitted(inner) * (1 - alpha) + fitted(outer) * alpha).tolist())


def clipped(lens: Lens, j: Column, i: Column) -> tuple[Column, Column]:
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), c)) for c, n in zip((j, i), lens.size, strict=True))


def distorted(lens: Lens, straight: Lens, j: Column, i: Column, clip: bool = False) -> tuple[Column, Column]:
    """Where pixels of the undistorted image lie in the distorted one."""
    k = lens.intrinsic()
    frame = C.Frame(k, None, lens.kind, lens.d)
    at = C.pixel(k, *frame.distorted((j - straight.cx) / straight.fx, (i - straight.cy) / straight.fy))
    return clipped(lens, *at) if clip else at


def undistorted(rows: DataFrame, lens: Lens, straight: Lens, clip: bool = False) -> DataFrame:
    """Rows (j, i in the distorted image) with where they lie in the undistorted one."""
    uv = inverse.undistorted(lens.kind, lens.d, (F.col("j") - lens.cx) / lens.fx, (F.col("i") - lens.cy) / lens.fy)
    at = C.pixel(straight.intrinsic(), F.col("uv_.u"), F.col("uv_.v"))
    j, i = clipped(lens, *at) if clip else at
    return rows.withColumn("uv_", uv).withColumns({"j": j, "i": i}).drop("uv_")


def _grid(image: DataFrame, lens: Lens) -> DataFrame:
    return R.grid(image.sparkSession, lens.size[1], lens.size[0])


def undistort_image(image: DataFrame, lens: Lens, alpha: float = 1.0, kernel: str = "bilinear") -> DataFrame:
    """The undistorted image of the same size (i, j, v and the image's keys); pixels that the source doesn't show are left out."""
    if lens.kind == "pinhole":
        return image
    straight = lens.straight(alpha)
    j, i = distorted(lens, straight, F.col("c").cast("double"), F.col("r").cast("double"))
    cells = _grid(image, lens).select("r", "c", j.alias("j"), i.alias("i"))
    out = R.resampled(cells, image, F.col("j"), F.col("i"), kernel)
    return out.withColumnsRenamed({"r": "i", "c": "j"})


def distort_image(image: DataFrame, lens: Lens, alpha: float = 1.0, kernel: str = "nearest") -> DataFrame:
    """The image that a camera with distortion takes of what an undistorted image shows."""
    cells = _grid(image, lens).select("r", "c", F.col("c").cast("double").alias("j"), F.col("r").cast("double").alias("i"))
    at = undistorted(cells, lens, lens.straight(alpha)) if lens.kind != "pinhole" else cells
    return R.resampled(at, image, F.col("j"), F.col("i"), kernel).withColumnsRenamed({"r": "i", "c": "j"})


def without_blur(cells: DataFrame, values: DataFrame, reach: int = 1, by: list[str] | None = None) -> DataFrame:
    """Values (by, r, c and more) of a grid's cells without those that lie within reach of a cell that has none.

    Interpolation near the edges of an undistorted image mixes in what isn't there.
    """
    by = by or []
    keys = [*by, "r", "c"]
    have = values.select(*keys).distinct().withColumn("has", F.lit(0))
    mask = cells.select(*keys).join(have, keys, "left").select(*by, F.col("r").alias("i"), F.col("c").alias("j"), F.coalesce("has", F.lit(1)).alias("m"))
    kept = R.dilated(mask, reach, by).where("m = 0").select(*by, F.col("i").alias("r"), F.col("j").alias("c"))
    return values.join(kept, keys)
