"""Every window of a text is read by the network, whatever it holds."""

import numpy as np

from ledgerline.llm import pii


def test_windows_without_digits_are_read(monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "_window_spans", lambda net, ids: seen.extend(ids) or [[] for _ in ids])
    texts = ["plain words " * 30, "", "no hint at all", "with 1 digit " + "x" * 500]
    assert pii.added_spans({}, texts, [[]] * 4) == [[]] * 4
    assert len(seen) == sum(len(pii.window_starts(len(t))) for t in texts if t)


def test_addresses_without_digit_and_at_sign_count(monkeypatch):
    text = "write to jane[at]example.org soon"
    start, end = text.index("jane"), text.index(" soon")
    monkeypatch.setattr(pii, "_window_spans", lambda net, ids: [[(start, end, 0, 3.0)] for _ in ids])
    assert pii.added_spans({}, [text, "no address here, none in sight"], [[], []]) == [[(start, 0, end)], []]


def test_a_long_span_begins_in_a_window_without_digits(monkeypatch):
    w, step = pii.WINDOW, pii.STEP
    text = "x" * (w + 20) + "1234567890" + "x" * 40

    def spans(net, ids):
        found = {0: [(step - 8, w, 3, 2.0)], 1: [(0, w - 14, 3, 3.0)]}
        return [found.get(i, []) for i in range(len(ids))]

    monkeypatch.setattr(pii, "_window_spans", spans)
    assert pii.added_spans({}, [text], [[]]) == [[(step - 8, 3, step + w - 14)]]


def test_reading_states_equal_those_of_the_training():
    ids = np.random.default_rng(5).integers(0, 99, (7, 30)).astype(np.uint8)
    for kind in (np.float32, np.float64):
        net = {k: v.astype(kind) for k, v in pii.new_network(6).items()}
        np.testing.assert_allclose(pii._read_states(net, ids).transpose(1, 2, 0, 3), pii._states(net, ids), atol=1e-6)
