"""Camera models as Columns. Parameters may be Columns or numbers, so that one query can mix cameras row by row.

Pixels are (j, i) = (column, row) with whole numbers at pixel centres. Camera axes are x right, y down, z forward.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.functions.angles import flipped, opk_rotation
from terralith.functions.num import Matrix, Value, applied, col, over, polynomial, total, transposed

#: Distortion coefficients of each kind of camera: fixed names.
COEFFICIENTS = {
    "pinhole": (),
    "brown": ("k1", "k2", "p1", "p2", "k3"),
    "opencv": ("k1", "k2", "p1", "p2", "k3", "k4", "k5", "k6", "s1", "s2", "s3", "s4", "t1", "t2"),
    "fisheye": ("k1", "k2", "k3", "k4"),
}


@dataclass
class Intrinsic:
    fx: Column
    fy: Column
    cx: Column
    cy: Column


def intrinsic(width: Value, height: Value, focal_x: Value, focal_y: Value | None = None, sensor: tuple[Value, Value] | None = None, cx: Value = 0.0, cy: Value = 0.0) -> Intrinsic:
    """Focal lengths in pixels and the principal point. Without a sensor size, focal lengths are in units of the image width."""
    w, h, fx = col(width), col(height), col(focal_x)
    fy = col(focal_y) if focal_y is not None else fx
    if sensor is None:
        fx, fy = fx * w, fy * w
    else:
        fx, fy = over(fx * w, sensor[0]), over(fy * h, sensor[1])
    longest = F.greatest(w, h)
    return Intrinsic(fx, fy, (w - 1) / 2 + longest * col(cx), (h - 1) / 2 + longest * col(cy))


@dataclass
class Pose:
    position: list[Column]
    rotation: Matrix


def pose(x: Value, y: Value, z: Value, omega: Value, phi: Value, kappa: Value) -> Pose:
    return Pose([col(x), col(y), col(z)], flipped(opk_rotation(col(omega), col(phi), col(kappa))))


@dataclass
class Frame:
    """A frame camera; kind names the distortion model. NULL pose columns give NULL results."""

    k: Intrinsic
    at: Pose
    kind: str = "pinhole"
    d: dict[str, Value] = field(default_factory=dict)
    undistorted: Intrinsic | None = None  # replaces k where images are undistorted

    def coefficient(self, name: str) -> Value:
        return self.d.get(name, 0.0)

    def distorted(self, u: Column, v: Column) -> tuple[Column, Column]:
        """From ideal to distorted camera coordinates (x/z, y/z)."""
        return DISTORT[self.kind](self, u, v)

    def world_to_pixel(self, x: Value, y: Value, z: Value) -> tuple[Column, Column]:
        """Points behind the camera are projected like others, as nothing tells them apart."""
        c = applied(transposed(self.at.rotation), [col(v) - t for v, t in zip((x, y, z), self.at.position, strict=True)])
        u, v = over(c[0], c[2]), over(c[1], c[2])
        if self.undistorted is not None:
            return pixel(self.undistorted, u, v)
        return pixel(self.k, *self.distorted(u, v))

    def pixel_to_world(self, j: Value, i: Value, z: Value) -> tuple[Column, Column]:
        """Where the ray through a pixel meets height z; for models without distortion, or undistorted images."""
        k = self.undistorted or self.k
        u, v = (col(j) - k.cx) / k.fx, (col(i) - k.cy) / k.fy
        return self.ray_to_world(u, v, z)

    def ray_to_world(self, u: Column, v: Column, z: Value) -> tuple[Column, Column]:
        r = applied(self.at.rotation, [u, v, F.lit(1.0)])
        s = over(col(z) - self.at.position[2], r[2])
        return self.at.position[0] + r[0] * s, self.at.position[1] + r[1] * s


def pixel(k: Intrinsic, u: Column, v: Column) -> tuple[Column, Column]:
    return k.fx * u + k.cx, k.fy * v + k.cy


def _none(c: Frame, u: Column, v: Column):
    return u, v


def _brown(c: Frame, u: Column, v: Column):
    r2, p1, p2 = u * u + v * v, col(c.coefficient("p1")), col(c.coefficient("p2"))
    radial = polynomial(r2, [1.0, c.coefficient("k1"), c.coefficient("k2"), c.coefficient("k3")])
    return u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u), v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v


def _opencv(c: Frame, u: Column, v: Column):
    """Rational radial, tangential, thin prism, then a tilt of the sensor if there is one."""
    g = c.coefficient
    r2, p1, p2 = u * u + v * v, col(g("p1")), col(g("p2"))
    radial = over(polynomial(r2, [1.0, g("k1"), g("k2"), g("k3")]), polynomial(r2, [1.0, g("k4"), g("k5"), g("k6")]))
    x = u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u) + polynomial(r2, [0.0, g("s1"), g("s2")])
    y = v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v + polynomial(r2, [0.0, g("s3"), g("s4")])
    if isinstance(g("t1"), Column) or isinstance(g("t2"), Column) or g("t1") or g("t2"):
        a, b = col(g("t1")), col(g("t2"))
        ca, sa, cb, sb = F.cos(a), F.sin(a), F.cos(b), F.sin(b)
        rot = [[cb, sb * sa, -sb * ca], [F.lit(0.0), ca, sa], [sb, -cb * sa, cb * ca]]
        t = applied(rot, [x, y, F.lit(1.0)])
        w = t[2]
        x, y = over(rot[2][2] * t[0] - rot[0][2] * w, w), over(rot[2][2] * t[1] - rot[1][2] * w, w)
    return x, y


def _fisheye(c: Frame, u: Column, v: Column):
    """On the axis, where the angle's ratio to the radius is undefined, it is taken as 1."""
    r = F.sqrt(u * u + v * v)
    angle = F.atan(r)
    bent = angle * polynomial(angle * angle, [1.0, *(c.coefficient(f"k{n}") for n in range(1, 5))])
    scale = F.coalesce(F.try_divide(bent, r), F.lit(1.0))
    return u * scale, v * scale


DISTORT = {"pinhole": _none, "brown": _brown, "opencv": _opencv, "fisheye": _fisheye}

#: Orders of (x, y, z) in the 20 terms of a rational polynomial: fixed values.
RPC_TERMS = (
    (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2),
    (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3),
)


def rpc_polynomial(c: Column, x: Column, y: Column, z: Column) -> Column:
    """A 20-term cubic with an array of coefficients, nested by powers of x, then y, then z."""

    def along(prefix: tuple[int, ...], values: list[Column]) -> Column:
        if not values:
            return F.element_at(c, RPC_TERMS.index(prefix) + 1)
        out = None
        for power in range(3 - sum(prefix), -1, -1):
            inner = along((*prefix, power), values[1:])
            out = inner if out is None else inner + values[0] * out
        return out

    return along((), [x, y, z])


def rpc_to_pixel(r: Column, lon: Value, lat: Value, height: Value) -> tuple[Column, Column]:
    """World to pixel by a struct of rational polynomial coefficients; NULL in, NULL out."""
    x, y, z = ((col(v) - r[f"{n}_off"]) / r[f"{n}_scale"] for v, n in ((lon, "long"), (lat, "lat"), (height, "height")))
    j = over(rpc_polynomial(r["samp_num_coeff"], x, y, z), rpc_polynomial(r["samp_den_coeff"], x, y, z)) * r["samp_scale"] + r["samp_off"]
    i = over(rpc_polynomial(r["line_num_coeff"], x, y, z), rpc_polynomial(r["line_den_coeff"], x, y, z)) * r["line_scale"] + r["line_off"]
    return j, i


def any_null(*columns: Column) -> Column:
    return total([F.when(c.isNull(), 1).otherwise(0) for c in columns]) > 0
