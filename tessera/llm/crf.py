"""Linear-chain conditional random fields over numpy arrays.

Sequences lie one after another in a matrix of features; `first` holds where
each begins.  All sequences step together, longest first, so a step costs one
array operation however many sequences there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """weights: features x states; moves: states x states (from, to)."""

    weights: np.ndarray
    moves: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _steps(first: np.ndarray) -> list[np.ndarray]:
    """Rows at each step of the sequences that are that long."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begins, falling = first[:-1][order], sizes[order]
    counts = np.searchsorted(-falling, -np.arange(1, int(falling.max(initial=0)) + 1), "right")
    return [begins[:k] + t for t, k in enumerate(counts)]


def marginals(model: Model, x: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities of every row, expected moves (if pairs) and the log partition summed over sequences."""
    score = x @ model.weights
    steps = _steps(first)
    alpha, beta = score.copy(), np.zeros_like(score)
    for rows in steps[1:]:
        alpha[rows] = score[rows] + _lse(alpha[rows - 1][:, :, None] + model.moves[None], 1)
    for rows in steps[:0:-1]:
        beta[rows - 1] = _lse(model.moves[None] + (score[rows] + beta[rows])[:, None, :], 2)
    joint = alpha + beta
    total = _lse(joint, 1)
    expected = np.zeros_like(model.moves)
    if pairs:
        for rows in steps[1:]:
            p = alpha[rows - 1][:, :, None] + model.moves[None] + (score[rows] + beta[rows])[:, None, :] - total[rows][:, None, None]
            expected += np.exp(p).sum(axis=0)
    live = first[:-1][np.diff(first) > 0]
    return np.exp(joint - total[:, None]), expected, float(total[live].sum())


def viterbi(model: Model, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most likely state of every row."""
    return best_states(x @ model.weights, model.moves, first)


def best_states(score: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Viterbi's states from the scores of states (rows x states)."""
    steps = _steps(first)
    best, back = score.copy(), np.zeros(score.shape, np.int8)
    for rows in steps[1:]:
        options = best[rows - 1][:, :, None] + moves[None]
        back[rows] = options.argmax(axis=1)
        best[rows] = score[rows] + options.max(axis=1)
    out = np.zeros(len(score), np.int8)
    last = first[1:][np.diff(first) > 0] - 1
    out[last] = best[last].argmax(axis=1)
    for rows in steps[:0:-1]:
        out[rows - 1] = back[rows, out[rows]]
    return out


def settled(score: np.ndarray, moves: np.ndarray, state: int) -> np.ndarray:
    """Rows that have `state` in every most likely path, whatever their neighbours: no move gained or lost makes up for their scores."""
    sure = np.ones(len(score), bool)
    for x in range(score.shape[1]):
        if x != state:
            gain = (moves[:, x] - moves[:, state]).max() + (moves[x] - moves[state]).max()
            sure &= score[:, state] - score[:, x] > max(gain, 0)
    return sure


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, states: int, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Maximum likelihood with a ridge, by full-batch Adam from zero: the same rows give the same model."""
    model = Model(np.zeros((x.shape[1], states)), np.zeros((states, states)))
    if not len(x):
        return model
    hot = np.eye(states)[y]
    seen = np.zeros((states, states))
    inner = np.ones(len(x), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at - 1], y[at]), 1)
    params = [model.weights, model.moves]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        p, expected, _ = marginals(model, x, first, pairs=True)
        grads = [x.T @ (hot - p) / len(x) - ridge * model.weights, (seen - expected) / len(x) - ridge * model.moves]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-9)
    return model
