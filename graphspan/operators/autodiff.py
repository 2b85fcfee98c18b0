"""Reverse-mode derivatives over numpy arrays, for work inside one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Node:
    """A value, what it was computed from, and how its gradient goes back to that."""

    __slots__ = ("grad", "pull", "sources", "value")

    def __init__(self, value, sources: tuple[Node, ...] = (), pull: Callable | None = None):
        self.value = np.asarray(value, float)
        self.sources, self.pull, self.grad = sources, pull, None

    def __add__(self, other):
        return binary(self, other, np.add, lambda g, a, b, y: (g, g))

    def __sub__(self, other):
        return binary(self, other, np.subtract, lambda g, a, b, y: (g, -g))

    def __mul__(self, other):
        return binary(self, other, np.multiply, lambda g, a, b, y: (g * b, g * a))

    def __truediv__(self, other):
        return binary(self, other, np.divide, lambda g, a, b, y: (g / b, -g * a / b**2))

    def __neg__(self):
        return unary(self, np.negative, lambda g, x, y: -g)

    def __pow__(self, p: float):
        return unary(self, lambda x: x**p, lambda g, x, y: g * p * x ** (p - 1))

    def __matmul__(self, other):
        return Node(self.value @ other.value, (self, other), lambda g: (g @ other.value.T, self.value.T @ g))

    def __getitem__(self, part):
        def pull(g):
            out = np.zeros_like(self.value)
            np.add.at(out, part, g)
            return (out,)

        return Node(self.value[part], (self,), pull)

    @property
    def T(self):
        return Node(self.value.T, (self,), lambda g: (g.T,))

    def sum(self, axis=None):
        def pull(g):
            return (np.broadcast_to(g if axis is None else np.expand_dims(g, axis), self.value.shape).copy(),)

        return Node(self.value.sum(axis=axis), (self,), pull)

    def mean(self, axis=None):
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis) * (1.0 / n)


def lift(x) -> Node:
    return x if isinstance(x, Node) else Node(x)


def fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sums g over the axes along which a value of this shape was repeated."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis=axis, keepdims=True)
    return g


def binary(a, b, f, back) -> Node:
    a, b = lift(a), lift(b)
    y = f(a.value, b.value)

    def pull(g):
        ga, gb = back(g, a.value, b.value, y)
        return fit(np.asarray(ga), a.value.shape), fit(np.asarray(gb), b.value.shape)

    return Node(y, (a, b), pull)


def unary(a, f, back) -> Node:
    a = lift(a)
    y = f(a.value)
    return Node(y, (a,), lambda g: (back(g, a.value, y),))


def exp(a) -> Node:
    return unary(a, np.exp, lambda g, x, y: g * y)


def log(a) -> Node:
    return unary(a, np.log, lambda g, x, y: g / x)


def sqrt(a) -> Node:
    return unary(a, np.sqrt, lambda g, x, y: g / (2 * y))


def absolute(a) -> Node:
    return unary(a, np.abs, lambda g, x, y: g * np.sign(x))


def sigmoid(a) -> Node:
    return unary(a, lambda x: 1 / (1 + np.exp(-x)), lambda g, x, y: g * y * (1 - y))


def tanh(a) -> Node:
    return unary(a, np.tanh, lambda g, x, y: g * (1 - y**2))


def relu(a) -> Node:
    return unary(a, lambda x: np.maximum(x, 0), lambda g, x, y: g * (x > 0))


def leaky_relu(a, slope: float = 0.2) -> Node:
    return unary(a, lambda x: np.where(x > 0, x, slope * x), lambda g, x, y: g * np.where(x > 0, 1, slope))


def maximum(a, b) -> Node:
    return binary(a, b, np.maximum, lambda g, x, z, y: (g * (x >= z), g * (x < z)))


def softmax(a) -> Node:
    """Over the last axis."""

    def f(x):
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    return unary(a, f, lambda g, x, y: y * (g - (g * y).sum(axis=-1, keepdims=True)))


def concat(parts: list[Node], axis: int = -1) -> Node:
    sizes = np.cumsum([p.value.shape[axis] for p in parts])[:-1]
    return Node(np.concatenate([p.value for p in parts], axis=axis), tuple(parts), lambda g: tuple(np.split(g, sizes, axis=axis)))


def cross_entropy_on_softmax(logits: Node, targets: np.ndarray) -> Node:
    """One loss for each row; targets are class indices."""
    x = logits.value
    top = x.max(axis=1, keepdims=True)
    e = np.exp(x - top)
    rows = np.arange(len(x))
    loss = np.log(e.sum(axis=1)) + top[:, 0] - x[rows, targets]

    def pull(g):
        p = e / e.sum(axis=1, keepdims=True)
        p[rows, targets] -= 1
        return (p * g[:, None],)

    return Node(loss, (logits,), pull)


def cross_entropy_on_sigmoid(z: Node, targets: np.ndarray) -> Node:
    soft = np.logaddexp(0, -z.value)
    return Node(soft * targets + (1 - targets) * (z.value + soft), (z,), lambda g: (g * (1 / (1 + np.exp(-z.value)) - targets),))


def topological(root: Node) -> list[Node]:
    """Nodes that root is computed from, each after its sources."""
    order, seen, stack = [], set(), [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            order.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            stack.append((node, True))
            stack += [(s, False) for s in node.sources]
    return order


def backprop(root: Node) -> None:
    """Puts the derivative of root's sum into grad of every node below it."""
    order = topological(root)
    for node in order:
        node.grad = np.zeros_like(node.value)
    root.grad = np.ones_like(root.value)
    for node in reversed(order):
        if node.pull is not None:
            for source, g in zip(node.sources, node.pull(node.grad), strict=True):
                source.grad = source.grad + g
