"""4x4 transforms on the driver: rotations, their resolution from stored forms, and variances through them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation_between(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    """The smallest rotation that turns direction a into b; opposite directions turn about any axis across."""
    u, v = (np.asarray(x, dtype=float) / np.linalg.norm(x) for x in (a, b))
    cos = float(u @ v)
    if cos < -1 + 1e-12:
        across = np.cross(u, np.eye(3)[int(np.argmin(np.abs(u)))])
        across /= np.linalg.norm(across)
        return 2 * np.outer(across, across) - np.eye(3)
    axis = np.cross(u, v)
    skew = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + skew + skew @ skew / (1 + cos)


def matrix4(rotation: np.ndarray | None = None, shift: Sequence[float] = (0.0, 0.0, 0.0)) -> np.ndarray:
    out = np.eye(4)
    if rotation is not None:
        r = np.asarray(rotation, dtype=float)
        out[: len(r), : len(r)] = r
    out[: len(shift), 3] = shift
    return out


def resolved(stored: Mapping | None) -> np.ndarray | None:
    """A stored transform as 4x4: ``matrix4``, a 3x3 ``matrix`` of the plane, or ``degrees`` and ``shift``; None for none."""
    if not stored:
        return None
    if stored.get("matrix4") is not None:
        return np.asarray(stored["matrix4"], dtype=float).reshape(4, 4)
    if stored.get("matrix") is not None:
        m = np.asarray(stored["matrix"], dtype=float).reshape(3, 3)
        return matrix4(m[:2, :2], m[:2, 2])
    if "degrees" in stored or "shift" in stored:
        a = np.radians(float(stored.get("degrees", 0.0)))
        return matrix4(np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), stored.get("shift", (0.0, 0.0)))
    return None


def propagated(matrix: Sequence[Sequence[float]], sigmas: Sequence[Column]) -> list[Column]:
    """Standard deviations of the coordinates after a linear map, from independent ones before."""
    return [F.sqrt(sum((F.pow(float(m) * s, 2) for m, s in zip(row, sigmas, strict=False)), F.lit(0.0))) for row in np.asarray(matrix)[: len(sigmas)]]
