"""Search spaces: distributions, seeded draws, presets."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Choice:
    """One of the options; a mapping among them opens a branch with its own parameters."""
    options: tuple

    def draw(self, rng):
        return self.options[int(rng.integers(len(self.options)))]


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float
    step: float = 0.0

    def draw(self, rng):
        return self.snap(rng.uniform(self.low, self.high))

    def snap(self, x):
        return round(x / self.step) * self.step if self.step else float(x)

    def inward(self, value):
        return value

    def outward(self, u):
        return self.snap(min(self.high, max(self.low, u)))

    @property
    def span(self):
        return self.low, self.high


@dataclass(frozen=True)
class LogUniform(Uniform):
    """exp of a uniform draw between low and high, optionally quantised."""

    def draw(self, rng):
        return self.snap(math.exp(rng.uniform(self.low, self.high)))

    def inward(self, value):
        return math.log(value) if value > 0 else self.low

    def outward(self, u):
        return self.snap(math.exp(min(self.high, max(self.low, u))))


def integers(low: int, high: int) -> Choice:
    """Whole numbers low..high-1."""
    return Choice(tuple(range(low, high)))


def draw(space: Mapping, rng: np.random.Generator) -> dict:
    """One parameter set. Parameters of branches that were not taken are absent."""
    out = {}
    for name in sorted(space):
        dist = space[name]
        value = dist.draw(rng) if hasattr(dist, "draw") else dist
        if isinstance(value, Mapping):
            out[name] = float(dist.options.index(value))
            out.update(draw(value, rng))
        else:
            out[name] = value
    return out


def sample_space(space: Mapping, n: int, seed: int = 1) -> list[dict]:
    rng = np.random.default_rng(seed)
    return [draw(space, rng) for _ in range(n)]


def split_weights(params: Mapping) -> tuple[dict, object]:
    """A trial's learner parameters, and its class weights as `class_weights` takes them.

    scale_pos_weight, or a number as class_weight, weighs the positives against 1; without either all rows weigh 1."""
    learner = {k: v for k, v in params.items() if k not in ("scale_pos_weight", "class_weight")}
    given = [params[k] for k in ("scale_pos_weight", "class_weight") if params.get(k) is not None]
    if len(given) > 1:
        raise ValueError("give scale_pos_weight or class_weight, not both")
    return learner, given[0] if given else 1.0


# Search ranges of the presets.
PRESETS = {
    "gbt_f1": {
        "max_depth": integers(4, 12), "min_child_weight": Uniform(1, 20, 1),
        "subsample": Uniform(0.5, 1, 0.025), "colsample_bylevel": Uniform(0.5, 1, 0.025),
        "gamma": Uniform(0, 20), "scale_pos_weight": Uniform(1, 30, 2),
        "max_delta_step": integers(0, 11), "learning_rate": LogUniform(-4.7, -1.25),
    },
    "gbt_ap": {
        "max_depth": integers(5, 12), "colsample_bylevel": Uniform(0.25, 1, 0.025),
        "gamma": Uniform(0, 1, 0.025), "scale_pos_weight": LogUniform(0, 6, 1),
    },
    "gbt_lr": {"learning_rate": Uniform(0.0001, 0.5, 0.0025)},
    "xgb_auc": {
        "max_depth": Choice((2, 5, 7, 9, 12, 15)), "min_child_weight": Uniform(1, 10, 2),
        "subsample": Uniform(0.5, 1), "colsample_bylevel": Uniform(0.5, 1),
        "learning_rate": LogUniform(-7, -1),
    },
    "xgb_basic": {"max_depth": integers(5, 31), "min_child_weight": Uniform(1, 10, 1),
                  "subsample": Uniform(0.8, 1)},
    "xgb_random": {
        "n_estimators": integers(150, 500), "learning_rate": Uniform(0.01, 0.08),
        "subsample": Uniform(0.3, 1), "max_depth": integers(3, 10),
        "colsample_bylevel": Uniform(0.5, 0.95), "min_child_weight": integers(1, 4),
    },
    "knn": {"k": LogUniform(0, 6.55, 1)},
    "logistic": {"C": LogUniform(-5, 4), "class_weight": integers(1, 300), "n_pca": integers(5, 18)},
    "svm": {"C": LogUniform(-6, 4), "gamma": LogUniform(-6, 4)},
    "rf": {
        "n_estimators": Choice(tuple(range(400, 1600, 100))), "max_depth": integers(8, 22),
        "max_features": integers(2, 12), "min_samples_split": Choice(tuple(range(2, 20, 2))),
        "min_samples_leaf": integers(1, 10),
    },
    "tree": {
        "max_depth": integers(1, 4), "max_features": integers(1, 25),
        "criterion": Choice(("gini", "entropy")), "min_weight_fraction_leaf": Uniform(0, 0.1),
    },
    "stack_meta": {
        "n_estimators": Choice((400, 600, 800, 1000, 1200)), "max_depth": integers(5, 24),
        "max_features": integers(3, 24), "min_samples_split": Choice((2, 3, 4, 7, 15)),
        "min_samples_leaf": Choice((2, 3, 5, 10, 15, 30)), "class_weight": LogUniform(0, 6, 1),
    },
    "mlp": {
        "width_1": 18, "max_norm_1": Choice((2, 3, 4, 5)), "dropout_1": Uniform(0, 0.5, 0.05),
        "width_2": Choice((9, 13, 18, 22, 27)), "max_norm_2": Choice((2, 3, 4, 5)),
        "dropout_2": Uniform(0, 0.5, 0.05),
        "third_layer": Choice(({}, {"width_3": Choice((9, 13, 18, 22, 27)),
                                    "dropout_3": Uniform(0, 0.5, 0.05),
                                    "max_norm_3": Choice((2, 3, 4, 5))})),
        "class_weight": Uniform(1, 20, 1), "batch": Choice((256, 512, 1024)),
    },
    "mlp_lr": {"lr": LogUniform(1.1, 1.8), "momentum": Uniform(0.5, 0.975, 0.025)},
    "grid_gbt": {"learning_rate": (0.1, 0.05, 0.01), "max_depth": (2, 3, 5, 7),
                 "min_samples_leaf": (2, 4, 8, 16), "max_features": (1.0, 0.5, 0.2, 0.1)},
    "grid_reg": {"reg_alpha": (1e-5, 1e-2, 0.1, 1, 100), "reg_lambda": (1e-5, 1e-2, 0.1, 1, 100)},
}
