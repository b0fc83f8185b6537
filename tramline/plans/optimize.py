"""Genetic search of feature weights; only weights and their fitness live on the driver."""

from __future__ import annotations

import random
from collections.abc import Callable

from ..config import FEATURE_WEIGHTS

Weights = tuple[float, ...]
FAMILIES = tuple(sorted(FEATURE_WEIGHTS))


def search(fitness: Callable[[list[dict[str, float]]], list[float]], generations: int = 10, population: int = 10, mutations: int = 2, seed: int = 0) -> tuple[dict[str, float], float, list[float]]:
    """-> (weights, fitness, best of each generation). Roulette selection, one-point crossover, the best always survives.

    fitness takes all weights of a generation that it was not asked for yet, at once. Weights are rounded to 5 places, so it is
    asked once for each.
    """
    rng, known = random.Random(seed), {}

    def values(population: list[Weights]) -> list[float]:
        fresh = [w for w in dict.fromkeys(population) if w not in known]
        if fresh:
            known.update(zip(fresh, fitness([dict(zip(FAMILIES, w)) for w in fresh])))
        return [known[w] for w in population]

    def fresh() -> Weights:
        return tuple(round(rng.random(), 5) for _ in FAMILIES)

    def child(a: Weights, b: Weights) -> Weights:
        at = rng.randrange(1, len(a))
        w = list(a[:at] + b[at:])
        for i in rng.sample(range(len(w)), mutations):
            w[i] = round(rng.random(), 5)
        return tuple(w)

    now, history = [fresh() for _ in range(population)], []
    for _ in range(generations):
        scores = values(now)
        best = max(now, key=known.get)
        history.append(known[best])
        picks = rng.choices(now, [s - min(scores) + 1e-9 for s in scores], k=2 * (population - 1))
        now = [best, *(child(a, b) for a, b in zip(picks[::2], picks[1::2]))]
    values(now)
    best = max(now, key=known.get)
    return dict(zip(FAMILIES, best)), known[best], history
