"""Numerical routines for the model fits: log-gamma, a hypergeometric series, count tails and a simplex search."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator

import numpy as np

_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: np.ndarray | float) -> np.ndarray:
    """ln Gamma of positive numbers (Lanczos, g = 7)."""
    z = np.asarray(x, float) - 1.0
    a = np.full_like(z, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        a = a + c / (z + i)
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(np.abs(a))
    small = np.asarray(x, float) < 0.5  # step up where the approximation is weak
    return np.where(small, _up(np.asarray(x, float)), out) if np.any(small) else out


def _up(x: np.ndarray) -> np.ndarray:
    y = np.where(x < 0.5, x, 1.0)
    return lgamma(y + 1.0) - np.log(y)


def betaln(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + np.asarray(b))


def hyp2f1(a, b, c, z, tol: float = 1e-14, most: int = 1_000_000) -> np.ndarray:
    """Gauss' series for |z| < 1; an error if it hasn't converged after `most` terms, with z all but 1."""
    a, b, c, z = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, c, z)))
    term, total = np.ones_like(z), np.ones_like(z)
    for n in range(most):
        term = term * (a + n) * (b + n) / ((c + n) * (n + 1)) * z
        total = total + term
        if np.all(np.abs(term) <= tol * np.abs(total)):
            return total
    raise ArithmeticError(f"the hypergeometric series has not converged after {most} terms")


def simplex(start: np.ndarray, step: float = 0.3, most: int = 2000, tol: float = 1e-9, ahead: bool = False) -> Generator[list[np.ndarray], list[float], tuple[np.ndarray, float]]:
    """The simplex search of Nelder and Mead as a generator: yields points, is sent their values, and returns the best.

    ahead: a step's points are all asked for at once, those that it might not need among them; the search is the same.
    """
    n = len(start)
    pts = [np.array(start, float)] + [np.array(start, float) + step * np.eye(n)[i] for i in range(n)]
    vals = list((yield pts))
    for _ in range(most):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        mid = np.mean(pts[:-1], axis=0)
        ref, far = mid + (mid - pts[-1]), mid + 2 * (mid - pts[-1])
        outside, inside = mid + 0.5 * (ref - mid), mid + 0.5 * (pts[-1] - mid)
        known = (yield [ref, far, outside, inside]) if ahead else (yield [ref])
        fr = known[0]
        if fr < vals[0]:
            ff = known[1] if ahead else (yield [far])[0]
            pts[-1], vals[-1] = (far, ff) if ff < fr else (ref, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = ref, fr
        else:
            near, at = (outside, 2) if fr < vals[-1] else (inside, 3)
            fn = known[at] if ahead else (yield [near])[0]
            if fn < min(fr, vals[-1]):
                pts[-1], vals[-1] = near, fn
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0], *(yield pts[1:])]
    i = int(np.argmin(vals))
    return pts[i], vals[i]


def searched(f: Callable[[list[np.ndarray]], list[float]], searches: list[Generator]) -> list[tuple[np.ndarray, float]]:
    """What the searches return, run side by side: f gets the points that all of them ask for at once."""
    asked, found = {i: next(s) for i, s in enumerate(searches)}, {}
    while asked:
        values = iter(f([p for pts in asked.values() for p in pts]))
        for i, pts in list(asked.items()):
            try:
                asked[i] = searches[i].send([next(values) for _ in pts])
            except StopIteration as end:
                found[i] = end.value
                del asked[i]
    return [found[i] for i in range(len(searches))]


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.3, most: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """The simplex search of one function from one start."""
    return searched(lambda points: [f(p) for p in points], [simplex(start, step, most, tol)])[0]


def _fraction(first: np.ndarray, step: Callable[[int], tuple[np.ndarray, np.ndarray]], most: int, what: str, tol: float = 3e-16) -> np.ndarray:
    """A continued fraction first + a1 / (b1 + a2 / (b2 + ...)) by Lentz's recursion; step(n) gives (an, bn)."""
    tiny = 1e-300
    value = np.where(first == 0, tiny, first)
    c, d = value.copy(), np.zeros_like(value)
    for n in range(1, most + 1):
        a, b = step(n)
        d = b + a * d
        c = b + a / c
        d = 1.0 / np.where(d == 0, tiny, d)
        c = np.where(c == 0, tiny, c)
        value = value * c * d
        if np.all(np.abs(c * d - 1.0) < tol * 4):
            return value
    raise ArithmeticError(f"the continued fraction of {what} has not converged after {most} terms")


def betainc(a, b, x, rest, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The regularised incomplete beta function and its complement, rest = 1 - x; each keeps its digits where it is small."""
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, rest)))
    left = x < (a + 1) / (a + b + 2)  # where the fraction converges fast; the other side is the same function mirrored
    p, q, y, z = np.where(left, a, b), np.where(left, b, a), np.where(left, x, rest), np.where(left, rest, x)

    def step(n: int) -> tuple[np.ndarray, np.ndarray]:
        m = n // 2
        if n % 2:
            return -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)), np.ones_like(y)
        return m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), np.ones_like(y)

    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log(z) - betaln(p, q)) / p
    near = np.clip(front / _fraction(np.ones_like(y), step, most, "the beta function"), 0.0, 1.0)
    return np.where(left, near, 1.0 - near), np.where(left, 1.0 - near, near)


def gammainc(a, x, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The regularised lower incomplete gamma function and its complement, for x > 0; each keeps its digits where it is small."""
    a, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, x)))
    low = x < a + 1
    front = np.exp(a * np.log(x) - x - lgamma(a))
    # the series where x is small, the fraction where it is large; each gets arguments that it can take elsewhere
    xs, xl = np.where(low, x, np.minimum(x, a)), np.where(low, a + 2, x)
    term = 1.0 / a
    total, n = term.copy(), a.copy()
    for _ in range(most):
        n = n + 1
        term = term * xs / n
        total = total + term
        if np.all(term <= 1e-17 * total):
            break
    else:
        raise ArithmeticError(f"the series of the gamma function has not converged after {most} terms")
    fraction = _fraction(xl + 1 - a, lambda i: (-i * (i - a), xl + 2 * i + 1 - a), most, "the gamma function")
    lower, upper = np.clip(front * total, 0, 1), np.clip(front / fraction, 0, 1)
    return np.where(low, lower, 1.0 - upper), np.where(low, 1.0 - lower, upper)


def count_tails(y: np.ndarray, lam: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    """(P(Y <= y), P(Y >= y)) of a negative binomial with mean lam and shape k, Poisson for k = inf.

    Both are incomplete beta (gamma) functions, so the work doesn't grow with the counts, and a small tail keeps its digits.
    """
    y, lam = np.floor(np.asarray(y, float)), np.asarray(lam, float)
    at, before = np.maximum(y, 0.0), np.maximum(y, 1.0)  # where a tail isn't certain
    if math.isinf(k):
        _, lower = gammainc(at + 1, lam)
        upper, _ = gammainc(before, lam)
    else:
        p, q = k / (k + lam), lam / (k + lam)
        lower, _ = betainc(k, at + 1, p, q)
        upper, _ = betainc(before, k, q, p)
    return np.where(y < 0, 0.0, lower), np.where(y < 1, 1.0, upper)
