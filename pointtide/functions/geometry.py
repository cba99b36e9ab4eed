"""Affine maps, quaternions and volumes as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["Transform", "mix_transforms", "keyed_transform", "apply_affine", "apply_linear", "quat_multiply", "quat_rotate", "quat_normalise", "nlerp", "slerp", "in_box", "in_cylinder", "largest", "smallest", "clamp"]


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def largest(*c: Column) -> Column:
    return F.greatest(*c)


def smallest(*c: Column) -> Column:
    return F.least(*c)


class Transform:
    """position, rotation in degrees about x, y, z (applied in that order), shear xy, xz, yz, and scale: T Rz Ry Rx H S."""

    def __init__(self, position=(0, 0, 0), rotation=(0, 0, 0), scale=(1, 1, 1), shear=(0, 0, 0)):
        self.position, self.rotation, self.scale, self.shear = position, rotation, scale, shear

    def matrix(self) -> np.ndarray:
        a, b, c = (math.radians(v) for v in self.rotation)
        rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
        ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
        rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
        h = np.array([[1, self.shear[0], self.shear[1]], [0, 1, self.shear[2]], [0, 0, 1]])
        m = np.eye(4)
        m[:3, :3] = rz @ ry @ rx @ h @ np.diag(self.scale)
        m[:3, 3] = self.position
        return m

    def inverse(self) -> np.ndarray:
        m = self.matrix()
        if abs(np.linalg.det(m[:3, :3])) < 1e-12:
            raise ValueError("the transform is singular")
        return np.linalg.inv(m)

    @classmethod
    def of(cls, m: np.ndarray) -> "Transform":
        """The parts of an affine matrix without reflection."""
        q, r = np.linalg.qr(m[:3, :3])
        s = np.sign(np.diag(r))
        s[s == 0] = 1
        q, r = q * s, (r.T * s).T
        scale = np.diag(r)
        h = r / scale
        b = math.asin(max(-1.0, min(1.0, -q[2, 0])))
        if abs(math.cos(b)) < 1e-5:
            a, c = 0.0, math.atan2(-q[0, 1], q[1, 1])
        else:
            a, c = math.atan2(q[2, 1], q[2, 2]), math.atan2(q[1, 0], q[0, 0])
        return cls(tuple(m[:3, 3]), tuple(map(math.degrees, (a, b, c))), tuple(scale), (h[0, 1], h[0, 2], h[1, 2]))


def mix_transforms(a: Transform, b: Transform, t: float) -> Transform:
    """Between two poses: rotations along the shorter arc at even speed, all else linear."""
    line = lambda p, q: tuple(float(x) * (1 - t) + float(y) * t for x, y in zip(p, q))
    turn = Transform(rotation=a.rotation).matrix()[:3, :3].T @ Transform(rotation=b.rotation).matrix()[:3, :3]
    # a part of the turn from one to the other, about its axis
    angle = math.acos(max(-1.0, min(1.0, (np.trace(turn) - 1) / 2)))
    if angle < 1e-9:
        part = np.eye(3)
    else:
        val, vec = np.linalg.eigh((turn + turn.T) / 2)
        axis = vec[:, int(np.argmax(val))]
        cross = lambda v: np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        if (cross(axis) * (turn - turn.T)).sum() < 0:
            axis = -axis
        k = cross(axis)
        part = np.eye(3) + math.sin(angle * t) * k + (1 - math.cos(angle * t)) * k @ k
    m = np.eye(4)
    m[:3, :3] = Transform(rotation=a.rotation).matrix()[:3, :3] @ part
    return Transform(line(a.position, b.position), Transform.of(m).rotation, line(a.scale, b.scale), line(a.shear, b.shear))


def keyed_transform(keys: list[tuple[float, Transform]], frame: float) -> Transform:
    """The pose at a frame: that of the first or last key outside them, else between the two around it."""
    keys = sorted(keys, key=lambda k: k[0])
    if not keys or frame <= keys[0][0]:
        return keys[0][1] if keys else Transform()
    for (f, a), (g, b) in zip(keys, keys[1:]):
        if frame < g:
            return mix_transforms(a, b, (frame - f) / (g - f))
    return keys[-1][1]


def apply_affine(m: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    """The images of the coordinates under a 4x4 matrix; neutral terms are left out of the plan."""
    return [_terms(m[r, :3], (x, y, z), m[r, 3]) for r in range(3)]


def apply_linear(m: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    return [_terms(m[r], (x, y, z), 0.0) for r in range(3)]


def _terms(row, cols, constant) -> Column:
    out = None
    for w, c in zip(row, cols):
        if w == 0:
            continue
        t = c if w == 1 else c * F.lit(float(w))
        out = t if out is None else out + t
    if out is None:
        return F.lit(float(constant))
    return out + F.lit(float(constant)) if constant else out


def quat_multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Hamilton product; quaternions are x, y, z, w."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def quat_normalise(q: list[Column]) -> list[Column]:
    """Unit length; the identity where there is no length."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [F.when(n > 0, c / n).otherwise(F.lit(1.0 if i == 3 else 0.0)) for i, c in enumerate(q)]


def quat_rotate(q: list[Column], v: list[Column]) -> list[Column]:
    """v turned by the unit quaternion q."""
    x, y, z, w = q
    t = [(y * v[2] - z * v[1]) * 2, (z * v[0] - x * v[2]) * 2, (x * v[1] - y * v[0]) * 2]
    return [v[0] + w * t[0] + (y * t[2] - z * t[1]), v[1] + w * t[1] + (z * t[0] - x * t[2]), v[2] + w * t[2] + (x * t[1] - y * t[0])]


def nlerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Normalised linear interpolation along the shorter arc."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    s = F.when(dot < 0, -t).otherwise(t)
    return quat_normalise([p * (F.lit(1.0) - t) + q * s for p, q in zip(a, b)])


def slerp(a: list[Column], b: list[Column], t: float, flat: float = 0.9999995) -> list[Column]:
    """Interpolation between unit quaternions at even speed along the shorter arc; those nearer than the cosine ``flat`` are mixed
    linearly."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    cos = F.least(F.lit(1.0), F.abs(dot))
    angle = F.acos(cos)
    u = F.when(cos > flat, F.lit(1.0 - t)).otherwise(F.sin(angle * (1.0 - t)) / F.sin(angle))
    v = F.when(cos > flat, F.lit(float(t))).otherwise(F.sin(angle * t) / F.sin(angle)) * F.when(dot < 0, -1.0).otherwise(1.0)
    return quat_normalise([p * u + q * v for p, q in zip(a, b)])


def in_box(x, y, z, width: float, height: float, depth: float) -> Column:
    return (y >= 0) & (y <= height) & (F.abs(x) <= width / 2) & (F.abs(z) <= depth / 2)


def in_cylinder(x, y, z, radius: float, height: float, radius_z: float | None = None) -> Column:
    rz = radius if radius_z is None else radius_z
    return (y >= 0) & (y <= height) & (x * x / (radius * radius) + z * z / (rz * rz) <= 1)
