"""Optimizers on flat parameter vectors; weights are small and live on the driver.

state gives what a run needs to go on, as named arrays, and restore takes it back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class AdamW:
    def __init__(self, lr: float, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.lr, self.decay, self.betas, self.eps, self.t, self.m, self.v = lr, decay, betas, eps, 0, np.zeros(1), np.zeros(1)

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        a, b = self.betas
        self.t += 1
        self.m, self.v = a * self.m + (1 - a) * g, b * self.v + (1 - b) * g * g
        move = (self.m / (1 - a**self.t)) / (np.sqrt(self.v / (1 - b**self.t)) + self.eps)
        return x * (1 - self.lr * self.decay) - self.lr * move

    def state(self) -> dict[str, np.ndarray]:
        return {"t": np.array([float(self.t)]), "m": self.m, "v": self.v}

    def restore(self, state: dict[str, np.ndarray]) -> None:
        self.t, self.m, self.v = int(state["t"][0]), state["m"], state["v"]


class Adagrad:
    def __init__(self, lr: float, decay: float = 0.0, eps: float = 1e-12):
        self.lr, self.decay, self.eps, self.total = lr, decay, eps, np.zeros(1)

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * x
        self.total = self.total + g * g
        return x - self.lr * g / (np.sqrt(self.total) + self.eps)

    def state(self) -> dict[str, np.ndarray]:
        return {"total": self.total}

    def restore(self, state: dict[str, np.ndarray]) -> None:
        self.total = state["total"]


class Lbfgs:
    """Limited-memory BFGS by the two-loop recursion: step takes one gradient, search a closure and halves the move until the loss falls enough."""

    def __init__(self, lr: float, decay: float = 0.0, memory: int = 10):
        self.lr, self.decay, self.memory, self.pairs, self.last = lr, decay, memory, [], None

    def _direction(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.last is not None:
            s, y = x - self.last[0], g - self.last[1]
            if s @ y > 1e-10:
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.last = (x.copy(), g.copy())
        q, alphas = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q *= min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for (s, y), a in zip(self.pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        return -q

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return x + self.lr * self._direction(x, g + self.decay * x)

    def search(self, x: np.ndarray, closure: Callable[[np.ndarray], tuple[float, np.ndarray]], tries: int = 10) -> tuple[np.ndarray, float]:
        """The next point and its loss. The first move is lr along the direction; after tries halvings without an Armijo decrease x stays."""
        loss, g = closure(x)
        loss, g = loss + 0.5 * self.decay * float(x @ x), g + self.decay * x
        move, rate = self._direction(x, g), self.lr
        for _ in range(tries):
            there = x + rate * move
            value = closure(there)[0] + 0.5 * self.decay * float(there @ there)
            if value <= loss + 1e-4 * rate * float(g @ move):
                return there, value
            rate /= 2
        return x, loss

    def state(self) -> dict[str, np.ndarray]:
        found = {f"{name}{i}": own for i, pair in enumerate(self.pairs) for name, own in zip("sy", pair, strict=True)}
        return found | ({} if self.last is None else {"x": self.last[0], "g": self.last[1]})

    def restore(self, state: dict[str, np.ndarray]) -> None:
        self.pairs = [(state[f"s{i}"], state[f"y{i}"]) for i in range(sum(name[0] == "s" for name in state))]
        self.last = (state["x"], state["g"]) if "x" in state else None


def optimizer(name: str, lr: float, decay: float):
    kinds = {"adamw": AdamW, "adagrad": Adagrad, "lbfgs": Lbfgs}
    if name not in kinds:
        raise ValueError(f"optimizer has to be one of {sorted(kinds)}")
    return kinds[name](lr, decay) if name == "adamw" else kinds[name](lr)
