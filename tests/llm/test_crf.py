import itertools

import numpy as np

from hostelry.llm import crf


def random_chain(rng, features=12, labels=3):
    return crf.Chain(rng.normal(size=(features, labels)).astype("f"), rng.normal(size=(labels, labels)).astype("f"),
                     rng.normal(size=labels).astype("f"))


def test_decoding_equals_trying_every_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        chain = random_chain(rng)
        lengths = rng.integers(0, 6, 7)
        first = np.concatenate([[0], np.cumsum(lengths)])
        features = rng.integers(0, 12, (first[-1], 2))
        got = chain.decode(features, first)
        scores = chain.scores(features)
        for a, b in itertools.pairwise(first):
            paths = list(itertools.product(range(3), repeat=b - a))
            best = max(paths, key=lambda p: sum(scores[a + i, x] for i, x in enumerate(p))
                       + (chain.begin[p[0]] if p else 0) + sum(chain.moves[x, y] for x, y in itertools.pairwise(p)))
            assert tuple(got[a:b]) == best


def test_training_learns_a_rule_that_needs_the_neighbour():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9, 120)
    first = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, 4, first[-1])
    labels = np.zeros(len(ids), np.int64)
    for a, b in itertools.pairwise(first):  # label 1 from the first 0 up to the next 3
        on = 0
        for i in range(a, b):
            on = 1 if ids[i] == 0 else 0 if ids[i] == 3 else on
            labels[i] = on
    chain = crf.train(ids[:, None], labels, first, 4, 2)
    assert (chain.decode(ids[:, None], first) == labels).mean() > 0.95


def test_nothing_to_train_or_decode():
    chain = crf.train(np.zeros((0, 2), int), np.zeros(0, int), np.array([0, 0]), 5, 2)
    assert not chain.weights.any()
    assert len(chain.decode(np.zeros((0, 2), int), np.array([0]))) == 0
