"""Rotations as Columns: roll/pitch/yaw, omega/phi/kappa and angle-axis vectors, all in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.functions.num import Matrix, product, transposed

ZERO, ONE = F.lit, F.lit


def _axis(angle: Column, axis: int) -> Matrix:
    c, s, z, o = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return [[[o, z, z], [z, c, -s], [z, s, c]], [[c, z, s], [z, o, z], [-s, z, c]], [[c, -s, z], [s, c, z], [z, z, o]]][axis]


def rpy_rotation(roll: Column, pitch: Column, yaw: Column) -> Matrix:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def opk_rotation(omega: Column, phi: Column, kappa: Column) -> Matrix:
    """Rx(omega) Ry(phi) Rz(kappa), multiplied out."""
    co, so, cp, sp, ck, sk = F.cos(omega), F.sin(omega), F.cos(phi), F.sin(phi), F.cos(kappa), F.sin(kappa)
    return [
        [cp * ck, -cp * sk, sp],
        [co * sk + so * sp * ck, co * ck - so * sp * sk, -so * cp],
        [so * sk - co * sp * ck, so * ck + co * sp * sk, co * cp],
    ]


def rotation_opk(m: Matrix) -> tuple[Column, Column, Column]:
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[0][2]))
    return F.atan2(-m[1][2], m[2][2]), F.asin(sine), F.atan2(-m[0][1], m[0][0])


def angle_axis_rotation(x: Column, y: Column, z: Column) -> Matrix:
    """Rodrigues' formula; the series' first terms stand in for tiny angles."""
    square = x * x + y * y + z * z
    angle = F.sqrt(square)
    tiny = angle < 1e-9
    s = F.when(tiny, F.lit(1.0)).otherwise(F.try_divide(F.sin(angle), angle))
    c = F.when(tiny, F.lit(0.5)).otherwise(F.try_divide(1 - F.cos(angle), square))
    cos = F.cos(angle)
    return [
        [cos + c * x * x, c * x * y - s * z, c * x * z + s * y],
        [c * x * y + s * z, cos + c * y * y, c * y * z - s * x],
        [c * x * z - s * y, c * y * z + s * x, cos + c * z * z],
    ]


def flipped(m: Matrix) -> Matrix:
    """m diag(1, -1, -1): between axes with y and z up and axes with y down and z forward."""
    return [[a, -b, -c] for a, b, c in m]


def angle_axis_opk(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Of a world-to-camera rotation vector, the angles of the camera in the world."""
    return rotation_opk(flipped(transposed(angle_axis_rotation(x, y, z))))


def rpy_to_opk(rpy: tuple[Column, Column, Column], north: list[Column]) -> tuple[Column, Column, Column]:
    """From body angles and the unit vector that points north in world coordinates.

    The navigation frame's axes are north, east (down times north) and down; the body's x and y swap and z turns.
    """
    length = F.sqrt(north[0] * north[0] + north[1] * north[1] + north[2] * north[2])
    n = [F.try_divide(v, length) for v in north]
    east = [n[1], -n[0], F.lit(0.0)]
    world = [[n[i], east[i], F.lit(-1.0 if i == 2 else 0.0)] for i in range(3)]
    body = product(world, rpy_rotation(*rpy))
    return rotation_opk([[r[1], r[0], -r[2]] for r in body])
