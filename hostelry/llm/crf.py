"""Linear-chain conditional random field over categorical features, trained and decoded in numpy.

A position has one feature id per template; its score for a label is the sum of the weights of its ids.
Training takes a small table and follows the exact gradient (forward-backward over padded sequences).
Decoding is Viterbi over many sequences at once: step t handles every sequence longer than t, so a batch
costs as many array operations as its longest sequence has positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    weights: np.ndarray  # features × labels
    moves: np.ndarray  # labels × labels
    begin: np.ndarray  # labels

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Positions × labels; ``features`` holds one row of feature ids per position."""
        out = np.zeros((len(features), self.weights.shape[1]), np.float32)
        for column in range(features.shape[1]):
            out += self.weights[features[:, column]]
        return out

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label of every position. Sequence i is ``first[i]`` up to ``first[i + 1]``."""
        scores = self.scores(features)
        labels = np.zeros(len(features), np.int8)
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = np.asarray(first[:-1])[order], lengths[order]
        steps = int(lengths[0]) if len(lengths) else 0
        if not steps:
            return labels
        live = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
        best = np.empty((len(features), self.moves.shape[0]), np.int8)
        now = self.begin + scores[starts[:live[0]]]
        ends = np.empty((live[0], self.moves.shape[0]), np.float32)
        for t in range(1, steps):
            n = live[t]
            ends[n:len(now)] = now[n:]
            paths = now[:n, :, None] + self.moves
            at = starts[:n] + t
            came = paths.argmax(axis=1)
            best[at] = came
            now = np.take_along_axis(paths, came[:, None, :], 1)[:, 0] + scores[at]
        ends[:len(now)] = now
        label = ends.argmax(axis=1).astype(np.int8)  # of each sequence, at its last position
        labels[starts[:live[0]] + lengths[:live[0]] - 1] = label
        for t in range(steps - 1, 0, -1):
            n = live[t]
            at = starts[:n] + t
            label[:n] = best[at, label[:n]]
            labels[at - 1] = label[:n]
        return labels


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(
    features: np.ndarray, labels: np.ndarray, first: np.ndarray, n_features: int, n_labels: int,
    rounds: int = 150, penalty: float = 0.02, rate: float = 0.1,
) -> Chain:
    """Chain fitted to labelled sequences. Work follows sequences × longest sequence, so the table must be small.

    Without rows every weight is zero and every label the first one.
    """
    lengths = np.diff(first)
    keep = lengths > 0
    starts, lengths = np.asarray(first[:-1])[keep], lengths[keep]
    model = Chain(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if not len(lengths):
        return Chain(*(x.astype(np.float32) for x in (model.weights, model.moves, model.begin)))
    n, steps = len(lengths), int(lengths.max())
    there = np.arange(steps) < lengths[:, None]
    at = np.where(there, starts[:, None] + np.arange(steps), 0)
    ids, gold = features[at], labels[at]
    one = np.eye(n_labels)
    seen = one[gold] * there[..., None]
    moved = np.zeros((n_labels, n_labels))
    both = there[:, 1:]
    np.add.at(moved, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.moves, model.begin)]
    for step in range(1, rounds + 1):
        scores = model.weights[ids].sum(axis=2)
        ahead = np.empty_like(scores)
        back = np.zeros_like(scores)
        ahead[:, 0] = model.begin + scores[:, 0]
        for t in range(1, steps):
            new = _total(ahead[:, t - 1, :, None] + model.moves, 1) + scores[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = _total(model.moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(there[:, t + 1, None], new, 0)
        whole = _total(ahead[:, -1], 1)
        share = np.exp(ahead + back - whole[:, None, None]) * there[..., None]
        pair = np.zeros_like(moved)
        for t in range(1, steps):
            p = np.exp(ahead[:, t - 1, :, None] + model.moves + (scores[:, t] + back[:, t])[:, None, :] - whole[:, None, None])
            pair += (p * there[:, t, None, None]).sum(axis=0)
        gap = (share - seen).reshape(-1, n_labels)
        slope = np.zeros_like(model.weights)
        flat = ids.reshape(len(gap), -1)
        for column in range(flat.shape[1]):
            for label in range(n_labels):
                slope[:, label] += np.bincount(flat[:, column], gap[:, label], n_features)
        slopes = (slope + penalty * model.weights, pair - moved + penalty * model.moves,
                  share[:, 0].sum(axis=0) - seen[:, 0].sum(axis=0) + penalty * model.begin)
        for p, g, (m, v) in zip((model.weights, model.moves, model.begin), slopes, state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Chain(*(x.astype(np.float32) for x in (model.weights, model.moves, model.begin)))
