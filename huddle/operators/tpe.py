"""Tree-structured Parzen estimators over integers and choices.

Trials so far are split into the best (a tenth, at most 25) and the rest.  For
each parameter two densities are made, of the good and of the other values,
each with a prior; candidates are drawn from the good one and the candidate
with the largest ratio good to other is taken.  A round's own earlier asks
count among the others, so one round does not ask the same twice.

An ask depends on the seed, its number and the history alone."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

STARTUP, CANDIDATES = 10, 24
GOOD_SHARE, GOOD_MOST = 0.1, 25


def _phi(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


@dataclass(frozen=True)
class Integers:
    """low to high, both included."""
    low: int
    high: int

    def random(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)

    def kernels(self, values: Sequence[int]) -> list[tuple[float, float]]:
        """(mean, width) of the normals: one a value, as wide as the larger
        gap to its neighbours, and the prior, as wide as the range."""
        size = self.high - self.low + 1
        points = sorted([float(v) for v in values] + [(self.low + self.high) / 2])
        prior = points.index((self.low + self.high) / 2)
        out = []
        for i, m in enumerate(points):
            if i == prior:
                out.append((m, float(size)))
                continue
            gaps = [m - points[i - 1]] if i else []
            gaps += [points[i + 1] - m] if i + 1 < len(points) else []
            out.append((m, min(max(max(gaps, default=0.0), size / min(100, 1 + len(points))), float(size))))
        return out

    def density(self, values: Sequence[int]) -> dict[int, float]:
        """Probability of each integer: the mixture of the kernels, each cut
        off at the range and summed over a unit around the integer."""
        out = dict.fromkeys(range(self.low, self.high + 1), 0.0)
        kernels = self.kernels(values)
        for m, w in kernels:
            inside = _phi((self.high + 0.5 - m) / w) - _phi((self.low - 0.5 - m) / w)
            for v in out:
                out[v] += (_phi((v + 0.5 - m) / w) - _phi((v - 0.5 - m) / w)) / inside / len(kernels)
        return out


@dataclass(frozen=True)
class Choice:
    options: tuple

    def random(self, rng: random.Random):
        return rng.choice(self.options)

    def density(self, values: Sequence) -> dict:
        """Shares of the options, each counted once more than it occurs."""
        n = len(values) + len(self.options)
        return {o: (sum(v == o for v in values) + 1) / n for o in self.options}


class ParzenSearch:
    def __init__(self, space: Mapping[str, Integers | Choice], seed: int = 42, startup: int = STARTUP,
                 candidates: int = CANDIDATES):
        self.space, self.seed, self.startup, self.candidates = dict(space), seed, startup, candidates

    @staticmethod
    def n_good(n: int) -> int:
        return min(math.ceil(GOOD_SHARE * n), GOOD_MOST)

    def ask(self, history: Sequence[tuple[dict, float | None]], n: int) -> list[dict]:
        """``n`` settings to try next.  ``history``: (settings, score), the
        higher the better; None is worse than any score, ties go to the
        earlier."""
        order = sorted(range(len(history)), key=lambda i: (history[i][1] is None, -(history[i][1] or 0.0), i))
        ranked = [history[i][0] for i in order]
        good, rest = ranked[:self.n_good(len(ranked))], ranked[self.n_good(len(ranked)):]
        out: list[dict] = []
        for k in range(n):
            rng = random.Random(f"{self.seed}:{len(history) + k}")
            if len(history) < self.startup:
                out.append({p: s.random(rng) for p, s in self.space.items()})
            else:
                out.append({p: self._best(p, s, good, rest + out, rng) for p, s in self.space.items()})
        return out

    def _best(self, name: str, kind: Integers | Choice, good: list[dict], rest: list[dict], rng: random.Random):
        high, low = kind.density([g[name] for g in good]), kind.density([r[name] for r in rest])
        drawn = rng.choices(list(high), weights=list(high.values()), k=self.candidates)
        return max(drawn, key=lambda v: math.log(high[v]) - math.log(low[v]))
