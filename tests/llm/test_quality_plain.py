"""The non-negative risk and the class prior against plain loops and known truths."""

import math

import numpy as np
import pytest

from marketframe.llm import quality


def plain_fit(positive, unlabelled, prior, steps, shrink=1e-3, rate=0.05):
    """Row by row: gradient of prior * loss(positive as 1) + max(0, loss(unlabelled as 0) - prior * loss(positive as 0)),
    stepping back along the second part where it is below zero; Adam with a falling rate."""
    columns = list(zip(*unlabelled))
    mean = [sum(c) / len(c) for c in columns]
    scale = [math.sqrt(sum((x - m) ** 2 for x in c) / len(c)) for c, m in zip(columns, mean)]
    scale = [s if s > 1e-9 else 1.0 for s in scale]
    norm = lambda rows: [[max(-8.0, min(8.0, (x - m) / s)) for x, m, s in zip(r, mean, scale)] + [1.0] for r in rows]
    positive, unlabelled = norm(positive), norm(unlabelled)
    size = len(mean)
    w, first, second = [0.0] * (size + 1), [0.0] * (size + 1), [0.0] * (size + 1)
    turned = 0
    for step in range(1, steps + 1):
        z = lambda r: sum(a * b for a, b in zip(r, w))
        soft = lambda v: math.log1p(math.exp(-abs(v))) + max(v, 0.0)
        one = lambda v: 1 / (1 + math.exp(-v))
        rest = sum(soft(z(r)) for r in unlabelled) / len(unlabelled) - prior * sum(soft(z(r)) for r in positive) / len(positive)
        as_negative = [sum(one(z(r)) * r[k] for r in unlabelled) / len(unlabelled) - prior * sum(one(z(r)) * r[k] for r in positive) / len(positive) for k in range(size + 1)]
        as_positive = [prior * sum((one(z(r)) - 1) * r[k] for r in positive) / len(positive) for k in range(size + 1)]
        turned += rest < 0
        gradient = [p + n for p, n in zip(as_positive, as_negative)] if rest >= 0 else [-n for n in as_negative]
        for k in range(size):
            gradient[k] += (shrink + 2 / len(positive)) * w[k]
        for k, g in enumerate(gradient):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            fall = rate * (1 - step / (steps + 1))
            w[k] -= fall * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w, turned


@pytest.mark.parametrize("prior,turns", [(0.02, False), (0.95, True)])
def test_fit_equals_plain_loops(prior, turns):
    rng = np.random.default_rng(1)
    positive = rng.normal(1.5, 1, (25, 3))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (16, 3)), rng.normal(-1.5, 1, (24, 3))])
    unlabelled[:, 2] = 7.0  # a constant feature
    model = quality.fit(positive, unlabelled, prior, steps=80)
    want, turned = plain_fit(positive.tolist(), unlabelled.tolist(), prior, 80)
    assert np.allclose([*model.weights, model.bias], want, atol=1e-9)
    assert bool(turned) == turns


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.7, 0.9])
def test_prior_of_known_mixtures(share):
    rng = np.random.default_rng(int(share * 10))
    positive = rng.normal(2, 1, (2500, 4))
    n = round(2500 * share)
    unlabelled = np.concatenate([rng.normal(2, 1, (n, 4)), rng.normal(-2, 1, (2500 - n, 4))])
    assert quality.estimated_prior(positive, unlabelled) == pytest.approx(share, abs=0.06)


def test_a_fitted_model_finds_the_hidden_negatives():
    rng = np.random.default_rng(5)
    positive = rng.normal(1, 1, (1500, 5))
    hidden = np.repeat([1, 0], [900, 600])
    unlabelled = np.concatenate([rng.normal(1, 1, (900, 5)), rng.normal(-1, 1, (600, 5))])
    predicted = quality.fit(positive, unlabelled).score(unlabelled) >= 0.5
    assert (predicted == hidden).mean() > 0.93
