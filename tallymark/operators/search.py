"""Parameter search that learns from its trials: a density-ratio sampler with early stopping of poor trials.

After a few random trials the sampler splits the past trials into the better ones and the rest, and estimates for each parameter how
dense both are along its range. It draws candidates where the better ones are dense and takes the one with the greatest ratio of the
two densities. Each parameter is handled on its own, on a range from 0 to 1 that its rule maps to values.

A trial climbs rungs of growing cost, such as larger shares of the training rows. It goes on only while its score is among the
best ``1 / keep`` of all scores so far on that rung, so poor parameters cost the first rung only. A trial counts by the highest
rung it reached, then by its score there, then the earlier one wins.

All draws are hashes of seed, trial, name and number: the same scores give the same trials anywhere. The history is one row
per trial and stays on the driver; scoring a trial is the caller's job and runs on Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

BINS = 8
STARTUP = 4
CANDIDATES = 8
GOOD = 0.25
KEEP = 3


@dataclass
class Trial:
    number: int
    units: dict[str, float]
    params: dict
    scores: list[float] = field(default_factory=list)  # one per rung reached

    @property
    def rank(self) -> tuple:
        """Smaller is better."""
        return -len(self.scores), -self.scores[-1], self.number


def uniform(seed: int, *parts) -> float:
    """A number in [0, 1) out of a hash."""
    digits = hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:13]
    return int(digits, 16) / (1 << 52)


def value_of(rule: tuple, unit: float):
    """The value of a rule, such as ("log", least, most), ("int", least, most) or ("choice", options), at a place from 0 to 1."""
    if rule[0] == "log":
        low, high = math.log(rule[1]), math.log(rule[2])
        return math.exp(low + unit * (high - low))
    if rule[0] == "int":
        return rule[1] + min(int(unit * (rule[2] - rule[1] + 1)), rule[2] - rule[1])
    if rule[0] == "choice":
        return rule[1][min(int(unit * len(rule[1])), len(rule[1]) - 1)]
    raise ValueError(f"unknown rule {rule[0]!r}")


def _bins(rule: tuple) -> int:
    return len(rule[1]) if rule[0] == "choice" else BINS


def weights(places: Sequence[int], bins: int, smooth: bool) -> list[float]:
    """Weight of each bin: one for each, one more for every place, and half of one in the bins beside it if ``smooth``."""
    return [1.0 + sum(1.0 if p == b else 0.5 if smooth and abs(p - b) == 1 else 0.0 for p in places) for b in range(bins)]


def suggest(history: Sequence[Trial], space: Mapping[str, tuple], number: int, seed: int) -> dict[str, float]:
    """The place of each parameter for the next trial."""
    if number < STARTUP:
        return {name: uniform(seed, number, name, 0) for name in space}
    ranked = sorted(history, key=lambda t: t.rank)
    n_good = math.ceil(GOOD * len(ranked))
    out = {}
    for name, rule in space.items():
        bins, smooth = _bins(rule), rule[0] != "choice"
        places = [min(int(t.units[name] * bins), bins - 1) for t in ranked]
        good, rest = weights(places[:n_good], bins, smooth), weights(places[n_good:], bins, smooth)
        total, ratio = sum(good), [(g / sum(good)) / (r / sum(rest)) for g, r in zip(good, rest)]
        ends = [sum(good[: b + 1]) / total for b in range(bins)]
        best = None
        for k in range(1, CANDIDATES + 1):
            draw = uniform(seed, number, name, k)
            b = min(sum(e <= draw for e in ends), bins - 1)
            inside = (draw - sum(good[:b]) / total) / (good[b] / total)
            if best is None or ratio[b] > best[0]:
                best = (ratio[b], (b + min(inside, 1.0)) / bins)
        out[name] = best[1]
    return out


def goes_on(history: Sequence[Trial], rung: int, score: float, keep: int = KEEP) -> bool:
    """Whether a score on a rung is among the best ``1 / keep`` of those so far, its own included."""
    earlier = [t.scores[rung] for t in history if len(t.scores) > rung]
    return sum(s > score for s in earlier) < math.ceil((len(earlier) + 1) / keep)


def run_search(
    objective: Callable[[dict, int], float], space: Mapping[str, tuple], n_trials: int, rungs: int = 1, seed: int = 42, keep: int = KEEP,
) -> list[Trial]:
    """All trials in order; ``objective(params, rung)`` is the score to maximise. A score that is no number counts as the worst."""
    history: list[Trial] = []
    for number in range(n_trials):
        units = suggest(history, space, number, seed)
        trial = Trial(number, units, {name: value_of(rule, units[name]) for name, rule in space.items()})
        for rung in range(rungs):
            score = objective(trial.params, rung)
            score = -math.inf if score is None or math.isnan(score) else float(score)
            go_on = goes_on(history, rung, score, keep)
            trial.scores.append(score)
            if not go_on:
                break
        history.append(trial)
    return history


def best_trial(history: Sequence[Trial]) -> Trial:
    return min(history, key=lambda t: t.rank)
