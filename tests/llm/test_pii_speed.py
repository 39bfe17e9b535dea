"""The network's shortcuts give what the plain way gives, and spare the work that decides nothing."""

import random

import numpy as np
import pytest

from ledgerline.llm import pii


@pytest.fixture(scope="module")
def net():
    """A network fitted on generated examples alone."""
    return pii.train(*pii.training_examples([], 1500), turns=8)


def mixed_windows(n=400):
    r = random.Random(3)
    prose = [" ".join(pii._word(r) for _ in range(60)) for _ in range(n)]
    texts = [p[: r.choice([1, 40, 95, 96])] if i % 2 else pii.generated_example(r, p)[0] for i, p in enumerate(prose)]
    return np.stack([np.pad(pii.character_ids(t), (0, pii.WINDOW - len(t))) for t in texts])


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_own_tanh_is_tanh(kind):
    x = np.concatenate([np.linspace(-12, 12, 20_001), [0.0, 1e-40, -1e-30, 1e-9]]).astype(kind)
    expected, spare = np.tanh(x.astype(np.float64)), np.empty_like(x)
    pii._own_tanh(x, spare)
    np.testing.assert_allclose(x, expected, atol=2e-7)


@pytest.mark.parametrize("by", [1, 30])  # 30: far beyond where the own tanh holds
@pytest.mark.parametrize("tanh", [pii._own_tanh, pii._numpy_tanh])
def test_both_tanhs_read_what_the_training_reads(net, by, tanh):
    ids = mixed_windows(60)
    wide = {k: v.astype(np.float64) * (by if k == "inputs" else 1) for k, v in net.items()}
    np.testing.assert_allclose(pii._read_states(wide, ids, tanh).transpose(1, 2, 0, 3), pii._states(wide, ids), atol=1e-5 if by == 1 else 5e-5)


def test_scores_are_those_of_the_states(net):
    ids = mixed_windows(60)
    states = pii._states(net, ids)
    plain = states[0] @ net["out"][0] + states[1] @ net["out"][1] + net["bias"]
    plain[..., 1:][ids == 0] = -1e4
    np.testing.assert_allclose(pii.emissions(net, ids), plain, atol=1e-4)


def test_windows_that_are_not_searched_stay_outside(net):
    ids = mixed_windows()
    scores = pii._label_scores(net, ids)
    searched = pii.undecided(net, scores)
    leaves = pii.best_paths(net, scores.transpose(2, 0, 1)).any(axis=1)
    assert leaves.sum() > 100 and set(np.flatnonzero(leaves)) <= set(searched)
    assert len(searched) < 0.75 * len(ids)  # the prose among them needs no search
    g = np.random.default_rng(8)
    for spread in (0.3, 1, 3):
        wild = {k: (g.standard_normal(v.shape) * spread).astype(np.float32) for k, v in net.items()}
        scores = (g.standard_normal((6, 9, 300)) * 2).astype(np.float32)
        scores[:, 0] += 4
        leaves = pii.best_paths(wild, scores.transpose(2, 0, 1)).any(axis=1)
        assert set(np.flatnonzero(leaves)) <= set(pii.undecided(wild, scores))


def test_prose_is_read_but_not_searched(net, monkeypatch):
    searched = []
    found = pii.best_paths
    monkeypatch.setattr(pii, "best_paths", lambda net, scores: searched.append(len(scores)) or found(net, scores))
    r = random.Random(6)
    prose = [" ".join(pii._word(r) for _ in range(300)) for _ in range(30)]
    assert pii.added_spans(net, prose, [[]] * len(prose)) == [[]] * len(prose)
    assert sum(searched) < 0.2 * sum(len(pii.window_starts(len(t))) for t in prose)


@pytest.mark.parametrize("at_once", [1, 7, 2048])
def test_windows_meet_their_texts(net, monkeypatch, at_once):
    r = random.Random(9)
    texts = ["", "a", *[pii.generated_example(r, "some words here " * 40)[0] * r.randint(1, 5) for _ in range(25)], "x" * 97, "\ud83d"]
    base = [[] if i % 2 else pii.base_spans(t) for i, t in enumerate(texts)]
    expected = []
    for text, known in zip(texts, base):
        ids, windows = pii.character_ids(text), []
        for start in pii.window_starts(len(ids)).tolist() if text else ():
            part = ids[start : start + pii.WINDOW]
            spans = pii._window_spans(net, np.pad(part, (0, pii.WINDOW - len(part)))[None])[0]
            windows.append((start, [pii._trimmed(text, start, c) for c in spans]))
        fits = lambda s, e, kind: pii.holds_kind(text[s:e], kind) and all(e <= a or z <= s for a, _, z in known)  # noqa: B023, E731
        expected.append(pii.reconciled(windows, len(text), fits))
    monkeypatch.setattr(pii, "WINDOWS_AT_ONCE", at_once)
    assert pii.added_spans(net, texts, base) == expected
    assert any(expected)
