"""Which languages belong to a text: the chosen set against trying every set."""

from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import language


def every_set(model, counts):
    """Main language and its proportion in the set with the highest penalised likelihood, by fitting all sets."""
    n, best = counts.sum(), None
    penalty = language.PER_TRIGRAM * n + language.PER_LOG * np.log(n + 1)
    for size in range(1, len(model.languages) + 1):
        for own in combinations(range(len(model.languages)), size):
            if size == 1:
                value, top, share = float(counts @ np.log(model.probability[own[0]]) + np.log(model.prior[own[0]])), own[0], 1.0
            else:
                start = np.zeros((1, len(model.languages)), np.float32)
                start[0, list(own)] = 1 / size
                part, like = model.fit(counts[None, :], start)
                value, top, share = float(like[0]) - (size - 1) * penalty, int(part[0].argmax()), float(part[0].max())
            if best is None or value > best[0]:
                best = (value, top, share)
    return best[1:]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_chosen_set_is_the_best_of_all(seed):
    """Texts of one to four of five languages, in equal and unequal parts, short and long."""
    rnd = np.random.default_rng(seed)
    p = rnd.dirichlet(np.full(language.FEATURES, 0.02), 5).astype(np.float32) + 1e-6
    p /= p.sum(1, keepdims=True)
    model = language.Model(list("abcde"), p, np.full(5, 0.2))
    counts, parts = [], []
    for k in range(48):
        mix = np.zeros(5)
        own = rnd.permutation(5)[: 1 + k % 4]
        mix[own] = rnd.dirichlet(np.full(len(own), 6.0))
        parts.append(mix)
        counts.append(rnd.multinomial([60, 400, 3000][k % 3], mix @ (p / p.sum(1, keepdims=True))))
    counts = np.array(counts, np.float32)
    top, share = model.infer(counts)
    want = [every_set(model, c) for c in counts]
    assert [int(t) for t in top] == [w[0] for w in want]
    assert np.abs(share - [w[1] for w in want]).max() < 0.02
    assert np.mean([t == m.argmax() for t, m in zip(top, parts, strict=True)]) > 0.9


def test_one_language_and_short_texts():
    rnd = np.random.default_rng(9)
    p = rnd.dirichlet(np.full(language.FEATURES, 0.02), 3).astype(np.float32) + 1e-6
    p /= p.sum(1, keepdims=True)
    model = language.Model(list("abc"), p, np.full(3, 1 / 3))
    counts = np.array([rnd.multinomial(n, p[k] / p[k].sum()) for n in (5, 40, 2000) for k in range(3)], np.float32)
    top, share = model.infer(counts)
    assert top.tolist() == [0, 1, 2] * 3 and (share > 0.99).all()
    assert [every_set(model, c)[0] for c in counts] == top.tolist()
