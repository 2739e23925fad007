"""Driver-side optimizers: L-BFGS, trust-region Newton and projected gradients. What they move is bounded by features, not rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Result:
    x: np.ndarray
    value: float
    rounds: int
    converged: bool
    passes: int = 0  # over the rows, as the caller counts them
    gap: float | None = None  # between primal and dual values, where there is a dual


def _line(f: Objective, x, value, g, direction, step: float = 1.0, c1: float = 1e-4, c2: float = 0.9, most: int = 40):
    """A step with sufficient decrease and curvature (bisection between what is too long and too short)."""
    lo, hi, slope = 0.0, np.inf, float(g @ direction)
    for _ in range(most):
        new, grad = f(x + step * direction)
        if not np.isfinite(new) or new > value + c1 * step * slope:
            hi = step
        elif float(grad @ direction) < c2 * slope:
            lo = step
        else:
            return step, new, grad
        step = (lo + hi) / 2 if np.isfinite(hi) else 2 * step
    return step, *f(x + step * direction)


def lbfgs(f: Objective, x0: np.ndarray, memory: int = 6, rounds: int = 100, tolerance: float = 1e-6) -> Result:
    x = np.array(x0, float)
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        if np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x)):
            return Result(x, value, r, True)
        q, used = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        direction = -q
        if direction @ g >= 0:
            direction, steps = -g, []
        step, new, grad = _line(f, x, value, g, direction, 1.0 if steps else min(1.0, 1 / max(np.linalg.norm(g), 1e-12)))
        moved = step * direction
        if new >= value and np.linalg.norm(moved) < 1e-14:
            return Result(x, value, r, True)
        y = grad - g
        if moved @ y > 1e-12:
            steps = [*steps[-(memory - 1) :], (moved, y)]
        x, value, g = x + moved, new, grad
    return Result(x, value, rounds, False)


def _to_boundary(s: np.ndarray, p: np.ndarray, scale: np.ndarray, radius: float) -> np.ndarray:
    """s moved along p until its scaled length is the radius."""
    a, b, c = float(p @ (scale * p)), float(s @ (scale * p)), float(s @ (scale * s)) - radius**2
    return s + (-b + np.sqrt(max(0.0, b * b - a * c))) / a * p


def truncated_newton(g: np.ndarray, times: Callable[[np.ndarray], np.ndarray], scale: np.ndarray, radius: float, tolerance: float, most: int = 200) -> tuple[np.ndarray, np.ndarray, bool]:
    """Conjugate gradients on H s = -g within a scaled radius (preconditioned by the scale): s, H s, and whether s lies on the boundary.

    Stops when the residual falls under ``tolerance`` times its first length, at the boundary, or where the curvature is not positive.
    """
    s, hs, r = np.zeros_like(g), np.zeros_like(g), -g
    z = r / scale
    p, rz = z.copy(), float(r @ z)
    goal = tolerance * np.sqrt(rz)
    for _ in range(most):
        if np.sqrt(rz) <= goal:
            break
        hp = times(p)
        curve = float(p @ hp)
        step = rz / curve if curve > 0 else np.inf
        new = s + step * p if np.isfinite(step) else s
        if not np.isfinite(step) or new @ (scale * new) >= radius**2:
            edge = _to_boundary(s, p, scale, radius)
            moved = float((edge - s) @ p) / float(p @ p)
            return edge, hs + moved * hp, True
        s, hs, r = new, hs + step * hp, r - step * hp
        z = r / scale
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return s, hs, False


def trust_region(f: Objective, curvature: Callable[[np.ndarray], tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]], x0: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> Result:
    """Newton steps within a trust radius. curvature(x) gives Hessian-vector products at x and the Hessian's (positive) diagonal.

    A step that does less than a quarter of what its model promises shrinks the radius, one that does three quarters at the
    boundary doubles it. The inner residual falls with the gradient, so the last steps converge superlinearly.
    """
    x = np.array(x0, float)
    value, g = f(x)
    radius, first = None, np.linalg.norm(g)
    for r in range(rounds):
        size = np.linalg.norm(g)
        if size <= tolerance * max(1.0, np.linalg.norm(x)):
            return Result(x, value, r, True)
        times, scale = curvature(x)
        if radius is None:
            radius = float(np.sqrt(g @ (g / scale)))
        while True:
            s, hs, edge = truncated_newton(g, times, scale, radius, min(0.1, np.sqrt(size / max(first, 1e-300))))
            promised = -float(g @ s + 0.5 * s @ hs)
            new, grad = f(x + s)
            ratio = (value - new) / promised if promised > 0 else -1.0
            if abs(value - new) <= 1e-13 * abs(value) and promised <= 1e-12 * max(1.0, abs(value)):
                ratio = 1.0  # below what the sums can tell
            if np.isfinite(new) and ratio > 1e-4:
                break
            radius = 0.25 * float(np.sqrt(s @ (scale * s)))
            if radius < 1e-14:
                return Result(x, value, r, False)
        length = float(np.sqrt(s @ (scale * s)))
        if ratio < 0.25:
            radius = 0.25 * length
        elif ratio > 0.75 and edge:
            radius *= 2
        x, value, g = x + s, new, grad
    return Result(x, value, rounds, bool(np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x))))


def searched_newton(f: Objective, curvature: Callable[[np.ndarray], tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]], x0: np.ndarray, rounds: int = 60, tolerance: float = 1e-6) -> Result:
    """Newton directions with a line search, for convex functions made of quadratic pieces, whose next piece no radius foretells."""
    x = np.array(x0, float)
    value, g = f(x)
    first = np.linalg.norm(g)
    for r in range(rounds):
        size = np.linalg.norm(g)
        if size <= tolerance * max(1.0, np.linalg.norm(x)):
            return Result(x, value, r, True)
        times, scale = curvature(x)
        s, _, _ = truncated_newton(g, times, scale, np.inf, min(0.1, np.sqrt(size / max(first, 1e-300))))
        step, new, grad = _line(f, x, value, g, s, c2=0.2, most=20)
        if new >= value - 1e-15 * abs(value) and np.linalg.norm(grad) >= 0.5 * size:  # below what the sums can tell
            return Result(x, value, r, bool(np.linalg.norm(grad) <= tolerance * max(1.0, np.linalg.norm(x))))
        x, value, g = x + step * s, new, grad
    return Result(x, value, rounds, bool(np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x))))


def projected(f: Objective, project: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, rounds: int = 2000, tolerance: float = 1e-8, quasi: bool = False, memory: int = 6) -> Result:
    """Projected gradient with Armijo steps; ``quasi`` scales the gradient by limited-memory curvature."""
    x = project(np.array(x0, float))
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1.0
    for r in range(rounds):
        if np.linalg.norm(project(x - g) - x) <= tolerance:
            return Result(x, value, r, True)
        direction = -g
        if quasi and steps:
            s, y = steps[-1]
            direction = -g * (s @ s) / (s @ y)
        step = min(step * 2, 1.0) if not quasi else 1.0
        while True:
            new_x = project(x + step * direction)
            new, grad = f(new_x)
            if np.isfinite(new) and new <= value + 1e-4 * g @ (new_x - x) or step < 1e-16:
                break
            step /= 2
        s, y = new_x - x, grad - g
        if s @ y > 1e-14:
            steps = [*steps[-(memory - 1) :], (s, y)]
        if np.linalg.norm(s) < 1e-15:
            return Result(x, value, r, True)
        x, value, g = new_x, new, grad
    return Result(x, value, rounds, False)
