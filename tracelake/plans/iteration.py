"""Small parsers and rules that turn user input and instrument metadata into plan parameters."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence


def parse_selector(text: str) -> str | int:
    """``last``, ``all``, ``sum``, ``average``, ``effective``, or a 1-based iteration, returned 0-based."""
    t = text.strip().lower()
    if t in ("last", "all", "sum", "average", "effective"):
        return t
    m = re.fullmatch(r"(?:itr|iteration)?\s*(\d+)(?:st|nd|rd|th)?", t)
    if not m or int(m[1]) < 1:
        raise ValueError(f"no iteration selector {text!r}")
    return int(m[1]) - 1


def selectors(iterations: int) -> list[str]:
    return ["last", "all", *(str(i + 1) for i in range(iterations)), "sum", "average"]


def parse_numbers(text: str) -> list[int]:
    """``1-3,5`` as [1, 2, 3, 5], sorted and without repeats."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"no numbers in {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        out |= set(range(min(a, b), max(a, b) + 1))
    return sorted(out)


def sequence_steps(text: str) -> list[dict]:
    """Iterations of a sequence description: scale and whether the pattern is lateral or axial."""
    steps = json.loads(text)
    steps = steps.get("iterations", steps) if isinstance(steps, Mapping) else steps
    return [{"itr": i, "scale": float(s["scale"]), "axial": str(s.get("pattern", "")).lower().startswith(("z", "axial"))} for i, s in enumerate(steps)]


def photon_iterations(steps: Sequence[Mapping] | None, iterations: int, dimensions: int) -> list[int]:
    """The last lateral and the last axial step of the smallest scale; without a sequence the last two (3-D) or the last."""
    if steps:
        small = min(s["scale"] for s in steps)
        best = {s["axial"]: s["itr"] for s in steps if s["scale"] == small}
        return sorted(best.values())
    return list(range(max(iterations - (2 if dimensions == 3 else 1), 0), iterations))


def merged(base: Mapping, over: Mapping) -> dict:
    """Nested settings: what ``over`` has wins, the rest comes from ``base``."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out
