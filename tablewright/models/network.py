"""The arithmetic of the multilayer perceptron on one batch; Spark decides which batches a task sees."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

# The network and its training as the study sets them.
WIDTHS = ((64, 2.0), (32, 1.0), (16, 0.5))      # each hidden layer: least width, width per feature
DROPOUT = (0.3, 0.2, 0.1)
LEARNING_RATE, WEIGHT_DECAY = 1e-3, 1e-5
RATE_STEP, RATE_FACTOR = 30, 0.1
FIRST_DECAY, SECOND_DECAY, ADAM_EPSILON = 0.9, 0.999, 1e-8
NORM_EPSILON, NORM_MOMENTUM = 1e-5, 0.1


def hidden_sizes(features: int) -> list[int]:
    return [max(least, int(features * factor)) for least, factor in WIDTHS]


@dataclass(frozen=True)
class Architecture:
    """Layer sizes of a network; ``outputs`` is the class count, or 1 for regression."""

    features: int
    outputs: int
    task: str
    hidden: list[int] = field(default_factory=list)
    dropout: list[float] = field(default_factory=lambda: list(DROPOUT))

    def __post_init__(self) -> None:
        if not self.hidden:
            object.__setattr__(self, "hidden", hidden_sizes(self.features))

    def info(self) -> dict:
        return {"input_size": self.features, "hidden_sizes": self.hidden, "dropout_rates": self.dropout,
                "task_type": self.task, "output_size": self.outputs}

    def shapes(self) -> list[tuple[str, tuple[int, ...]]]:
        """Names and shapes of the trained parameters, then of the running normalization figures."""
        trained, running, size = [], [], self.features
        for i, width in enumerate(self.hidden):
            trained += [(f"w{i}", (size, width)), (f"b{i}", (width,)), (f"g{i}", (width,)), (f"h{i}", (width,))]
            running += [(f"m{i}", (width,)), (f"v{i}", (width,))]
            size = width
        return [*trained, ("wo", (size, self.outputs)), ("bo", (self.outputs,)), *running]

    @cached_property
    def places(self) -> list[tuple[str, int, int, tuple[int, ...]]]:
        """Where each named parameter lies in the vector, with its shape."""
        found, start = [], 0
        for name, shape in self.shapes():
            found.append((name, start, start + int(np.prod(shape)), shape))
            start = found[-1][2]
        return found

    def trained_size(self) -> int:
        return sum(int(np.prod(s)) for n, s in self.shapes() if n[0] not in "mv")

    def initial(self, seed: int) -> np.ndarray:
        """Xavier-uniform weights, zero biases, unit scales and variances, as one vector."""
        random = np.random.default_rng(seed)
        parts = []
        for name, shape in self.shapes():
            if name[0] == "w":
                reach = np.sqrt(6.0 / sum(shape))
                parts.append(random.uniform(-reach, reach, shape).ravel())
            else:
                parts.append(np.full(shape, 1.0 if name[0] in "gv" else 0.0).ravel())
        return np.concatenate(parts)

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """Named views into one parameter vector, or into several as the rows of a matrix."""
        return {name: vector[..., start:end].reshape(*vector.shape[:-1], *shape) for name, start, end, shape in self.places}

    def row_views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """The same with every parameter of a layer's outputs as one row, as it meets the rows of a batch."""
        lead = vector.shape[:-1]
        return {name: vector[..., start:end].reshape(*lead, *(shape if len(shape) == 2 else (1, *shape)))
                for name, start, end, shape in self.places}


def predict(net: Architecture, vector: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Outputs with dropout off and the running normalization figures."""
    p, a = net.views(vector), x
    for i in range(len(net.hidden)):
        z = (a @ p[f"w{i}"] + p[f"b{i}"] - p[f"m{i}"]) / np.sqrt(p[f"v{i}"] + NORM_EPSILON)
        a = np.maximum(z * p[f"g{i}"] + p[f"h{i}"], 0.0)
    return a @ p["wo"] + p["bo"]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - np.maximum.reduce(scores, axis=-1, keepdims=True))
    return e / np.add.reduce(e, axis=-1, keepdims=True)


def loss_and_slope(net: Architecture, out: np.ndarray, y: np.ndarray) -> tuple[float | np.ndarray, np.ndarray]:
    """Mean loss of a batch and its slope at the outputs; of several batches side by side, a loss for each."""
    rows = y.shape[-1]
    if net.task == "classification":
        shares = softmax(out)
        flat, own = shares.reshape(-1, shares.shape[-1]), y.astype(int).ravel()
        every = np.arange(len(own))
        right = flat[every, own]
        loss = -np.log(np.maximum(right, 1e-300)).reshape(y.shape).mean(axis=-1)
        flat[every, own] = right - 1.0
        shares /= rows
        return loss, shares
    error = out[..., 0] - y
    return (error ** 2).mean(axis=-1), (2.0 * error / rows)[..., None]


def drawn(random: np.random.Generator | list[np.random.Generator], shape: tuple[int, ...]) -> np.ndarray:
    """Even numbers from 0 to 1; of several generators each draws the share of its own batch."""
    if isinstance(random, np.random.Generator):
        return random.random(shape)
    found = np.empty(shape)
    for own, part in zip(random, found):
        own.random(out=part)
    return found


def gradient(net: Architecture, vector: np.ndarray, x: np.ndarray, y: np.ndarray,
             random: np.random.Generator | list[np.random.Generator] | None) -> tuple[float | np.ndarray, np.ndarray, np.ndarray]:
    """Loss, outputs and parameter slopes of one batch; updates the running figures in ``vector``.

    Several workers' batches may stand side by side: ``vector``, ``x`` and ``y`` then have one more leading axis, and ``random`` is
    a list. Each gets the numbers it would get alone, bit by bit, at a fraction of the calls, which on so few rows cost more than the
    numbers; so do means that are not sums over a count. Without ``random`` dropout is off, which leaves a smooth function to check
    slopes on.
    """
    sums, rows = np.add.reduce, x.shape[-2]
    p, slopes = net.row_views(vector), np.zeros_like(vector)
    s, a, kept = net.row_views(slopes), x, []
    for i, rate in enumerate(net.dropout[:len(net.hidden)]):
        z = a @ p[f"w{i}"]
        z += p[f"b{i}"]
        mean = sums(z, axis=-2, keepdims=True) / rows
        z -= mean
        var = sums(z * z, axis=-2, keepdims=True) / rows
        p[f"m{i}"] += NORM_MOMENTUM * (mean - p[f"m{i}"])
        p[f"v{i}"] += NORM_MOMENTUM * (var * rows / max(rows - 1, 1) - p[f"v{i}"])
        spread = np.sqrt(var + NORM_EPSILON)
        normal = z
        normal /= spread
        raised = normal * p[f"g{i}"]
        raised += p[f"h{i}"]
        mask = raised > 0
        if random is not None and rate > 0:
            mask &= drawn(random, mask.shape) >= rate
            mask = mask * (1.0 / (1.0 - rate))
        kept.append((a, normal, spread, mask))
        raised *= mask
        a = raised
    out = a @ p["wo"] + p["bo"]
    loss, back = loss_and_slope(net, out, y)
    np.matmul(a.swapaxes(-1, -2), back, out=s["wo"])
    sums(back, axis=-2, keepdims=True, out=s["bo"])
    back = back @ p["wo"].swapaxes(-1, -2)
    for i in reversed(range(len(net.hidden))):
        before, normal, spread, mask = kept[i]
        back *= mask
        sums(back * normal, axis=-2, keepdims=True, out=s[f"g{i}"])
        sums(back, axis=-2, keepdims=True, out=s[f"h{i}"])
        back *= p[f"g{i}"]
        along = sums(back * normal, axis=-2, keepdims=True) / rows
        back -= sums(back, axis=-2, keepdims=True) / rows
        normal *= along
        back -= normal
        back /= spread
        np.matmul(before.swapaxes(-1, -2), back, out=s[f"w{i}"])
        sums(back, axis=-2, keepdims=True, out=s[f"b{i}"])
        if i:
            back = back @ p[f"w{i}"].swapaxes(-1, -2)
    return loss, out, slopes


class Adam:
    """Adam with the penalty added to the slope; its state is two vectors and a step count.

    For workers side by side: two matrices with a row for each, and a list of counts.
    """

    def __init__(self, size: int, first: np.ndarray | None = None, second: np.ndarray | None = None, steps: int | list[int] = 0):
        self.first = np.zeros(size) if first is None else first
        self.second = np.zeros(size) if second is None else second
        self.steps = steps

    def left(self, decay: float) -> float | np.ndarray:
        """What the decay has taken from a sum of so many steps."""
        return np.array([[1 - decay ** n] for n in self.steps]) if isinstance(self.steps, list) else 1 - decay ** self.steps

    def step(self, vector: np.ndarray, slopes: np.ndarray, rate: float) -> None:
        size = self.first.shape[-1]
        g = WEIGHT_DECAY * vector[..., :size]
        g += slopes[..., :size]
        self.steps = [n + 1 for n in self.steps] if isinstance(self.steps, list) else self.steps + 1
        for kept, decay, new in ((self.first, FIRST_DECAY, g), (self.second, SECOND_DECAY, g * g)):
            new -= kept
            new *= 1 - decay
            kept += new
        first = self.first / self.left(FIRST_DECAY)
        first *= rate
        second = self.second / self.left(SECOND_DECAY)
        np.sqrt(second, out=second)
        second += ADAM_EPSILON
        first /= second
        vector[..., :size] -= first


def batch_edges(rows: int, batch: int) -> list[tuple[int, int]]:
    """Consecutive batches with the last one kept; a last batch of one row joins the one before."""
    edges = [(i, min(i + batch, rows)) for i in range(0, rows, batch)]
    if len(edges) > 1 and edges[-1][1] - edges[-1][0] == 1:
        edges[-2:] = [(edges[-2][0], rows)]
    return edges
