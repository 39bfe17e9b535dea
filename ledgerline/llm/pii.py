"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside base patterns.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers that match a strict
pattern. The network finds what the patterns miss: numbers run together, other notations.
It is trained in numpy from labelled spans: those that the patterns find in a
bounded sample of the documents, and generated ones of many notations, alone and side by side, set
into stretches of the sampled texts among numbers that are no personal data.

A text is cut into overlapping windows. Each is decoded by the CRF's best path; all windows of a text are then
reconciled: a span cut by a window's edge is joined with its other part in the next window, and of all
candidates of the text the set of disjoint spans with the highest sum of scores is taken.
A decoded span counts if it holds what its kind needs (digits, parts, check digit) and meets no base span.
The network runs on every window of every text, also where no digit or ``@`` is in sight.

Defined results: NULL texts are empty; empty texts hold nothing. Every input row gives a row, repeated rows repeated
ones; rows without id are handled like others. Offsets are code points, ends exclusive. Base matches of a kind are the
leftmost non-overlapping ones; those that fail the kind's test are dropped and their text is not tried again.
Without documents the model is fitted on generated texts alone. Extra columns take no part.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from numpy.lib import introspect
from pyspark.sql import DataFrame, functions as F

from ledgerline.session import materialize

# The kinds in the order in which equal starts are listed, and their patterns.
# A number of digits is taken whole, which finds the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT_SIGN = re.compile("@")
HOLDS_HINT = re.compile("[0-9@]")

#: sampled documents, and windows of them that the model is fitted on
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 2000, 1000
#: characters of a window, and from one window's start to the next one's
WINDOW, STEP = 96, 48
#: cells of the network per direction; training examples and turns over them
CELLS, EXAMPLES, TURNS, BATCH = 16, 3000, 10, 64
#: windows decoded together, and best paths searched together
WINDOWS_AT_ONCE, PATHS_AT_ONCE = 2048, 256

Span = tuple[int, int, int]  # start, kind, end

# Character ids: 0 beyond the text, ASCII 32 to 126 each its own, then controls, other letters, the rest.
_CONTROL, _LETTER, _REST, CHARACTERS = 96, 97, 98, 99
_IDS = np.array(
    [_CONTROL if c < 32 else c - 31 if c < 127 else _LETTER if chr(c).isalpha() else _REST for c in range(0x250)] + [_REST], np.uint8
)
_LABELS = 1 + 2 * len(KINDS)

#: a loss of score that rounding cannot make up for
_CLEAR = 0.1


def passes_luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    values = np.frombuffer(digits.encode("ascii"), np.uint8).astype(int)[::-1] - 48
    double = values[1::2] * 2
    return int(values[::2].sum() + (double - 9 * (double > 9)).sum()) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and passes_luhn(digits)


def _octets(parts: Sequence[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns by start, then kind."""
    if not HOLDS_HINT.search(text):
        return []
    spans, free = [], 0
    for at in AT_SIGN.finditer(text):
        first = at.start()
        while first > free and EMAIL_LOCAL.match(text, first - 1):
            first -= 1
        host = EMAIL_HOST.match(text, at.end()) if first < at.start() else None
        free = host.end() if host else at.end()
        if host:
            spans.append((first, 0, host.end()))
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m.group().split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() > 11 and _is_card(m.group())]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(spans)


def holds_kind(text: str, kind: int) -> bool:
    """Whether a decoded span has what its kind needs."""
    digits = _digits(text)
    if KINDS[kind] == "email":
        return "@" in text.strip("@") or bool(re.search(r"\w\s?[\[(]at[\])]\s?\w", text))
    if KINDS[kind] == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and _octets(parts)
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and passes_luhn(digits)
    return 9 <= len(digits) <= 15


# Generated examples


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(r.choice("etaoinshrdlucmfgpbé") for _ in range(r.randint(least, most)))


def _card_digits(r: random.Random, n: int) -> str:
    body = r.choice("3456") + _number(r, n - 2)
    return next(body + c for c in "0123456789" if passes_luhn(body + c))


def _email(r: random.Random) -> str:
    local = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}.{_number(r, 2)}", f"{_word(r)}_{_number(r, 1)}+{_word(r)}"]).replace("é", "e")
    host = r.choice([f"mail{_number(r, 1)}.example.com", f"{_word(r)}.org", f"{_word(r)}-{_word(r)}.co.uk", f"{_word(r)}.net"]).replace("é", "e")
    return local + r.choice(["@"] * 6 + [" @ ", "[at]", " (at) ", " [at] "]) + host


def _ip(r: random.Random) -> str:
    return r.choice(["."] * 5 + ["[.]", " . "]).join(str(r.randrange(256)) for _ in range(4))


def _card(r: random.Random) -> str:
    digits = _card_digits(r, r.choice([16, 16, 16, 16, 15, 13, 19]))
    mark = r.choice(["", "", "", " ", "-", "."])
    return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _phone(r: random.Random) -> str:
    n = lambda k: _number(r, k)
    area = r.choice("23456789") + n(2)
    return r.choice(
        [
            f"+1 ({area}) {n(3)}-{n(4)}", f"+1 ({area}) {n(3)}-{n(4)}", f"({area}) {n(3)}-{n(4)}", f"{area}-{n(3)}-{n(4)}",
            f"+44 20 {n(4)} {n(4)}", f"+{n(2)}-{n(3)}-{n(7)}", f"+49 {n(3)} {n(7)}", f"{area}.{n(3)}.{n(4)}", f"00{n(2)} {n(3)} {n(6)}", f"+{n(11)}",
        ]
    )


def _no_person(r: random.Random) -> str:
    """Numbers and codes that are no personal data."""
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    return r.choice(
        [
            f'token = "{hexes(40)}"', f"password={hexes(18)}", hexes(32), "AKIA" + "".join(r.choice("ABCDEFGHIJ2345678") for _ in range(16)),
            f"version {r.randrange(9)}.{r.randrange(20)}", f"Version {_number(r, 1)}.0.", f"CC BY-NC {_number(r, 1)}.0.", f"{r.randint(1900, 2099)}",
            f"20{_number(r, 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{_number(r, 2)}:{_number(r, 2)}:{_number(r, 2)}", f"{_number(r, r.randint(1, 11))}",
            f"{_number(r, 1)}.{_number(r, 9)}", f"{_number(r, 3)},{_number(r, 3)},{_number(r, 3)}", f"${_number(r, 4)}.{_number(r, 2)}", _number(r, r.randint(20, 40)),
            f"@{_word(r)}", f"{_word(r)}@", f"p. {_number(r, 2)}-{_number(r, 2)}", f"{_number(r, 1)}.{_number(r, 1)}.{_number(r, 1)}", f"#{_number(r, 5)}",
            f"{r.randint(256, 999)}.{_number(r, 3)}.{r.randint(256, 999)}.{_number(r, 3)}", f"{_word(r)}{_number(r, 3)}",
        ]
    )


_MAKERS = (_email, _ip, _card, _phone)


def generated_example(r: random.Random, carrier: str) -> tuple[str, list[Span]]:
    """A text of ``WINDOW`` characters at most with its spans; some are cut by its ends."""
    at = r.randint(0, len(carrier))
    text, spans = carrier[max(0, at - r.randint(0, WINDOW)) : at], []
    if text and r.random() < 0.85 and not text[-1].isspace():
        text += " "
    for _ in range(r.choice([1, 1, 2, 2, 3])):
        kind = r.randrange(len(_MAKERS) + 2)
        piece = _MAKERS[kind](r) if kind < len(_MAKERS) else _no_person(r)
        if kind < len(_MAKERS):
            spans.append((len(text), kind, len(text) + len(piece)))
        text += piece + r.choice([" ", " ", " ", " ", ", ", ". ", "\n", "!! ", "### ", "; "])
    text += carrier[at : at + WINDOW]
    first = r.randint(0, max(0, len(text) - WINDOW))
    inside = [(max(0, s - first), k, min(WINDOW, e - first)) for s, k, e in spans if s - first < WINDOW and e > first]
    return text[first : first + WINDOW], inside


def _labels_of(spans: Sequence[Span], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for s, kind, e in spans:
        out[s:e] = 2 + 2 * kind
        out[s : s + 1] = 1 + 2 * kind
    return out


# The network: a dict of arrays, so that it reaches workers that can't import this package


def _allowed() -> np.ndarray:
    """0 for transitions that may follow, and a large negative number for those into the inside of another kind."""
    out = np.zeros((_LABELS, _LABELS), np.float32)
    for kind in range(len(KINDS)):
        out[:, 2 + 2 * kind] = -1e4
        out[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = 0
    return out


def new_network(cells: int = CELLS, seed: int = 0) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    draw = lambda *shape, by: (g.standard_normal(shape) * by).astype(np.float32)
    net = {
        "inputs": draw(2, CHARACTERS, 4 * cells, by=0.3),
        "state": draw(2, cells, 4 * cells, by=cells**-0.5),
        "out": draw(2, cells, _LABELS, by=cells**-0.5),
        "bias": np.zeros(_LABELS, np.float32),
        "follow": np.zeros((_LABELS, _LABELS), np.float32),
        "first": np.zeros(_LABELS, np.float32),
    }
    net["inputs"][:, :, cells : 2 * cells] += 1  # remember at first
    return net


def _states(net: dict[str, np.ndarray], ids: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States of both directions, (2, windows, places, cells), the second one in reading order too."""
    n, size = ids.shape
    cells = net["state"].shape[1]
    both = np.stack((ids, ids[:, ::-1]))
    given = net["inputs"][np.arange(2)[:, None, None], both]
    kind = net["state"].dtype
    hidden, cell = np.zeros((2, n, cells), kind), np.zeros((2, n, cells), kind)
    out = np.zeros((size, 2, n, cells), kind)
    for t in range(size):
        z = given[:, :, t] + hidden @ net["state"]
        gates = 0.5 * np.tanh(0.5 * z[..., : 3 * cells]) + 0.5
        new = np.tanh(z[..., 3 * cells :])
        before = cell
        cell = gates[..., cells : 2 * cells] * before + gates[..., :cells] * new
        squashed = np.tanh(cell)
        if trace is not None:
            trace.append((gates, new, before, squashed, hidden))
        hidden = gates[..., 2 * cells :] * squashed
        out[t] = hidden
    return np.stack((out[:, 0], out[::-1, 1])).transpose(0, 2, 1, 3)


def _numpy_tanh_is_quick() -> bool:
    """Whether numpy's own tanh has the wide registers that it needs to be quick; elsewhere it takes as long as 20 additions."""
    return "AVX512" in str(introspect.opt_func_info(func_name="^tanh$").get("tanh", {}).get("ff", {}).get("current"))


def _numpy_tanh(x: np.ndarray, spare: np.ndarray) -> None:
    np.tanh(x, out=x)


#: up to here ``_own_tanh`` holds, and tanh is 1 but for 1e-10 beyond
_FAR = 12.0


def _own_tanh(x: np.ndarray, spare: np.ndarray) -> None:
    """Replace ``x``, from -12 to 12, by its tanh within 2e-8 and rounding, in nine operations on whole arrays.

    2 * coth(2 * u) is coth(u) + 1 / coth(u), so three such steps lead from an estimate at an eighth of ``x`` to a multiple of
    coth(x). The factors are fitted to tanh, which makes the result 1,000 times closer than the exact ones would.
    """
    with np.errstate(divide="ignore", over="ignore"):  # coth of 0
        np.divide(172.67415101607273, x, out=spare)
        x += spare
        for factor in (448.259241250481, 1863.758869829743, 7454.089377932547):
            np.divide(factor, x, out=spare)
            x += spare
        np.divide(172.6741397851328, x, out=x)


Tanh = Callable[[np.ndarray, np.ndarray], None]


def _steps(net: dict[str, np.ndarray], ids: np.ndarray, tanh: Tanh | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Direction, place and states there (windows, cells) of every step of the reading; the next step overwrites the states.

    Gates lie apart, so that every step works on whole arrays, and what a character gives is looked up step by step.
    """
    tanh = tanh or (_numpy_tanh if _numpy_tanh_is_quick() else _own_tanh)
    n, size = ids.shape
    cells, kind = net["state"].shape[1], net["state"].dtype
    half = np.array([0.5, 0.5, 0.5, 1], kind)[:, None, None]  # a gate is 0.5 * tanh(0.5 * z) + 0.5
    given, state = (
        [np.ascontiguousarray(w.reshape(len(w), 4, cells).transpose(1, 0, 2)) * half for w in net[name]] for name in ("inputs", "state")
    )
    turned = np.ascontiguousarray(ids.T).astype(np.intp)
    z, new = np.empty((4, n, cells), kind), np.empty((4, n, cells), kind)
    gates, squashed, spare = z[:3], new[0], new[1]

    def near(x: np.ndarray, result: np.ndarray) -> None:
        np.minimum(x, _FAR, out=result)
        np.maximum(result, -_FAR, out=result)

    for d in (0, 1):
        far = (np.abs(given[d]).max(axis=1) + np.abs(state[d]).sum(axis=1)).max() > _FAR  # states are from -1 to 1
        hidden, cell = np.zeros((n, cells), kind), np.zeros((n, cells), kind)
        for t in range(size) if d == 0 else range(size - 1, -1, -1):
            np.take(given[d], turned[t], axis=1, out=z, mode="clip")
            np.matmul(hidden, state[d], out=new)
            z += new
            if far:
                near(z, z)
            tanh(z, new)
            gates += 1  # twice the gates
            cell *= gates[1]
            gates[0] *= z[3]
            cell += gates[0]
            cell *= 0.5
            near(cell, squashed)
            tanh(squashed, spare)
            squashed *= 0.5
            np.multiply(gates[2], squashed, out=hidden)
            yield d, t, hidden


def _read_states(net: dict[str, np.ndarray], ids: np.ndarray, tanh: Tanh | None = None) -> np.ndarray:
    """What ``_states`` gives, by place: (places, 2, windows, cells), without a trace."""
    out = np.empty((ids.shape[1], 2, len(ids), net["state"].shape[1]), net["state"].dtype)
    for d, t, states in _steps(net, ids, tanh):
        out[t, d] = states
    return out


def _label_scores(net: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Scores by place, label and window; beyond the text only the outside is possible."""
    n, size = ids.shape
    out = np.ascontiguousarray(net["out"].transpose(0, 2, 1))
    scores, part = np.empty((size, _LABELS, n), out.dtype), np.empty((_LABELS, n), out.dtype)
    for d, t, states in _steps(net, ids):
        if d == 0:
            np.matmul(out[0], states.T, out=scores[t])
        else:
            np.matmul(out[1], states.T, out=part)
            scores[t] += part
            scores[t] += net["bias"][:, None]
    short = np.flatnonzero((ids == 0).any(axis=1))
    scores[:, 1:, short] = np.where((ids[short].T == 0)[:, None], out.dtype.type(-1e4), scores[:, 1:, short])
    return scores


def emissions(net: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Scores of all labels at all places of every window."""
    return _label_scores(net, ids).transpose(2, 0, 1)


def loss_and_gradients(net: dict[str, np.ndarray], ids: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the labels, by the CRF, and its gradients."""
    n, size = ids.shape
    cells, kind = net["state"].shape[1], net["state"].dtype
    trace: list = []
    states = _states(net, ids, trace)
    scores = states[0] @ net["out"][0] + states[1] @ net["out"][1] + net["bias"]
    scores[..., 1:][ids == 0] = -1e4
    follow = net["follow"] + _allowed()
    # forward and backward sums as shares of each place's total
    by_place = np.ascontiguousarray(scores.transpose(1, 0, 2))
    top = by_place.max(axis=2, keepdims=True)
    weight, step = np.exp(by_place - top), np.exp(follow)
    ahead, back = np.zeros((size, n, _LABELS), kind), np.ones((size, n, _LABELS), kind)
    totals = np.zeros((size, n, 1), kind)
    for t in range(size):
        ahead[t] = (ahead[t - 1] @ step if t else np.exp(net["first"])) * weight[t]
        totals[t] = ahead[t].sum(axis=1, keepdims=True)
        ahead[t] /= totals[t]
    for t in range(size - 2, -1, -1):
        back[t] = (weight[t + 1] * back[t + 1] / totals[t + 1]) @ step.T
    whole = (np.log(totals) + top).sum(axis=(0, 2))
    rows, places = np.arange(n)[:, None], np.arange(size)
    d_scores = (ahead * back).transpose(1, 0, 2).copy()
    reached = (weight[1:] * back[1:] / totals[1:]).reshape(-1, _LABELS)
    pairs = ahead[:-1].reshape(-1, _LABELS).T @ reached * step
    path = net["first"][labels[:, 0]] + scores[rows, places, labels].sum(axis=1) + follow[labels[:, :-1], labels[:, 1:]].sum(axis=1)
    loss = float((whole - path).mean())
    d_scores[rows, places, labels] -= 1
    np.subtract.at(pairs, (labels[:, :-1], labels[:, 1:]), 1)
    d_scores /= n
    grad = {"first": d_scores[:, 0].sum(axis=0), "follow": np.where(_allowed() < 0, 0, pairs / n).astype(kind)}
    d_scores[..., 1:][ids == 0] = 0
    grad["bias"] = d_scores.sum(axis=(0, 1))
    grad["out"] = states.reshape(2, n * size, cells).transpose(0, 2, 1) @ d_scores.reshape(n * size, _LABELS)
    d_states = np.ascontiguousarray((d_scores @ net["out"].transpose(0, 2, 1)[:, None]).transpose(2, 0, 1, 3))
    d_states[:, 1] = d_states[::-1, 1].copy()
    d_z = np.zeros((size, 2, n, 4 * cells), kind)
    d_hidden, d_cell = np.zeros((2, n, cells), kind), np.zeros((2, n, cells), kind)
    grad["state"] = np.zeros_like(net["state"])
    back_state = net["state"].transpose(0, 2, 1)
    for t in range(size - 1, -1, -1):
        gates, new, before, squashed, hidden = trace[t]
        d_hidden = d_hidden + d_states[t]
        slope = gates * (1 - gates)
        d_cell = d_cell + d_hidden * gates[..., 2 * cells :] * (1 - squashed * squashed)
        z = d_z[t]
        z[..., :cells] = d_cell * new * slope[..., :cells]
        z[..., cells : 2 * cells] = d_cell * before * slope[..., cells : 2 * cells]
        z[..., 2 * cells : 3 * cells] = d_hidden * squashed * slope[..., 2 * cells :]
        z[..., 3 * cells :] = d_cell * gates[..., :cells] * (1 - new * new)
        grad["state"] += hidden.transpose(0, 2, 1) @ z
        d_hidden = z @ back_state
        d_cell = d_cell * gates[..., cells : 2 * cells]
    both = np.stack((ids, ids[:, ::-1])).transpose(2, 0, 1)  # places, directions, windows
    grad["inputs"] = np.stack(
        [np.equal.outer(np.arange(CHARACTERS), both[:, d].ravel()).astype(kind) @ d_z[:, d].reshape(-1, 4 * cells) for d in (0, 1)]
    )
    return loss, grad


def train(ids: np.ndarray, labels: np.ndarray, turns: int = TURNS, batch: int = BATCH, cells: int = CELLS, rate: float = 0.02) -> dict[str, np.ndarray]:
    """A network fitted by Adam with a falling rate and clipped gradients."""
    net = new_network(cells)
    g = np.random.default_rng(1)
    mean, square = ({k: np.zeros_like(v) for k, v in net.items()} for _ in "ms")
    steps, total = 0, max(turns * -(-len(ids) // batch), 1)
    for _ in range(turns):
        order = g.permutation(len(ids))
        for i in range(0, len(ids), batch):
            rows = order[i : i + batch]
            _, grad = loss_and_gradients(net, ids[rows], labels[rows])
            norm = float(np.sqrt(sum(float((v**2).sum()) for v in grad.values())))
            steps += 1
            now = rate * (1 - steps / (total + 1))
            for k, v in grad.items():
                v = v / max(1.0, norm / 5)
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.005 * (v * v - square[k])
                net[k] -= (now * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.995**steps)) + 1e-8)).astype(np.float32)
    return net


def best_paths(net: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """The most likely labels of every window."""
    follow = net["follow"] + _allowed()
    out = np.zeros(scores.shape[:2], np.int64)
    for i in range(0, len(scores), PATHS_AT_ONCE):
        given = np.ascontiguousarray(scores[i : i + PATHS_AT_ONCE].transpose(1, 2, 0))  # places, labels, windows
        best = np.empty_like(given)
        best[0] = net["first"][:, None] + given[0]
        every = np.empty((_LABELS, *given.shape[1:]), given.dtype)
        for t in range(1, len(given)):
            np.add(best[t - 1][:, None], follow[:, :, None], out=every)
            every.max(axis=0, out=best[t])
            best[t] += given[t]
        # where a path came from is found again along the best one only
        path = out[i : i + PATHS_AT_ONCE]
        path[:, -1] = best[-1].argmax(axis=0)
        for t in range(len(given) - 1, 0, -1):
            path[:, t - 1] = (best[t - 1] + np.take(follow, path[:, t], axis=1)).argmax(axis=0)
    return out


def undecided(net: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """Numbers of the windows whose best path may leave the outside, by their scores per place, label and window.

    A stretch beyond the outside is a beginning, or the inside at the window's start, and the inside of its kind after it.
    Counted is what it gains at most over staying outside, with the best ways into and out of it. Where each is a loss, so is
    every path with any of them, and the search for the best path is not needed; ``_CLEAR`` is far more than rounding.
    """
    follow = net["follow"] + _allowed()
    into = follow.max(axis=0) - follow[0, 0]
    back = max(float(follow[1:, 0].max() - follow[0, 0]), 0.0)
    outside, begins, inside = scores[:, :1], scores[:, 1::2], scores[:, 2::2]
    rest = np.zeros_like(begins[0])  # most that the inside gains from a place on
    most = np.full_like(rest, -np.inf)
    for t in range(len(scores) - 1, 0, -1):
        np.maximum(most, begins[t] - outside[t] + into[1::2, None] + rest, out=most)
        rest += inside[t]
        rest -= outside[t]
        rest += into[2::2, None]
        np.maximum(rest, 0, out=rest)
    for label, first in ((1, begins[0]), (2, inside[0])):
        np.maximum(most, first - outside[0] + (net["first"][label::2] - net["first"][0])[:, None] + rest, out=most)
    return np.flatnonzero(most.max(axis=0) > -back - _CLEAR)


# Texts


def character_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _IDS[np.minimum(points, len(_IDS) - 1)]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of ``n`` characters."""
    return np.arange(0, max(n - WINDOW, 0) + STEP, STEP)[: max(1, -(-(n - WINDOW) // STEP) + 1)]


Candidate = tuple[int, int, int, float]  # start, end, kind, score


def _window_spans(net: dict[str, np.ndarray], ids: np.ndarray) -> list[list[Candidate]]:
    """Decoded spans of every window with their scores: how far their labels are above the outside."""
    by_place = _label_scores(net, ids)
    rows = undecided(net, by_place)
    scores = by_place[:, :, rows].transpose(2, 0, 1)
    paths = best_paths(net, scores)
    out: list[list[Candidate]] = [[] for _ in ids]
    # a span begins at every beginning label and lasts as long as inside labels follow
    inside = (paths > 0) & (paths % 2 == 0)
    for w, s in zip(*np.nonzero(paths % 2 == 1)):
        rest = np.flatnonzero(~inside[w, s + 1 :])
        e = s + 1 + int(rest[0]) if len(rest) else ids.shape[1]
        gain = scores[w, np.arange(s, e), paths[w, s:e]] - scores[w, s:e, 0]
        out[rows[w]].append((int(s), e, int(paths[w, s]) // 2, float(gain.sum())))
    return out


def reconciled(windows: Sequence[tuple[int, list[Candidate]]], size: int, fits: Callable[[int, int, int], bool] = lambda s, e, kind: True) -> list[Span]:
    """The best disjoint spans of a text of ``size`` characters from the spans of its windows, in order.

    A span cut by a window's edge is left to the neighbour that sees it whole; where none
    does, its parts are joined. Candidates are those that satisfy ``fits(start, end, kind)``.
    """
    whole: dict[tuple[int, int, int], float] = {}
    open_parts: list[Candidate] = []  # cut by the end of the window before
    for start, spans in windows:
        still_open = []
        for s, e, kind, score in spans:
            s, e, last = s + start, e + start, start + WINDOW
            if s == start and start:
                part = next((p for p in open_parts if p[2] == kind and p[0] < s <= p[1]), None)
                if part:
                    s, score = part[0], score + part[3]
                elif e <= start - STEP + WINDOW:
                    continue
            if e == last < size:
                still_open.append((s, e, kind, score))
                if s >= start + STEP:
                    continue
            whole[s, e, kind] = max(whole.get((s, e, kind), 0.0), score)
        open_parts = still_open
    found = sorted((e, s, kind, score) for (s, e, kind), score in whole.items() if fits(s, e, kind))
    ends = [f[0] for f in found]
    best, taken = [0.0], [False]
    for i, (e, s, kind, score) in enumerate(found):
        with_it = best[int(np.searchsorted(ends, s, side="right"))] + score
        best.append(max(best[-1], with_it))
        taken.append(with_it > best[-2])
    out, i = [], len(found)
    while i:
        if taken[i]:
            e, s, kind, _ = found[i - 1]
            out.append((s, kind, e))
            i = int(np.searchsorted(ends, s, side="right"))
        else:
            i -= 1
    return out[::-1]


def _trimmed(text: str, start: int, candidate: Candidate) -> Candidate:
    """A window's candidate without white space at its ends."""
    s, e, kind, score = candidate
    piece = text[start + s : start + e]
    return s + len(piece) - len(piece.lstrip()), e - (len(piece) - len(piece.rstrip())), kind, score


def _windows(ids: np.ndarray) -> np.ndarray:
    """The windows of a text, of equal size."""
    starts = window_starts(len(ids))
    filled = np.pad(ids, (0, max(int(starts[-1]) + WINDOW - len(ids), 0)))
    return np.lib.stride_tricks.sliding_window_view(filled, WINDOW)[::STEP]


def added_spans(net: dict[str, np.ndarray], texts: Sequence[str], base: Sequence[list[Span]]) -> list[list[Span]]:
    """What the network finds in every text beside its base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    decoded: list[list[list[Candidate]]] = [[] for _ in texts]
    waiting: list[tuple[int, np.ndarray]] = []
    room = WINDOWS_AT_ONCE

    def run() -> None:
        found = iter(_window_spans(net, np.concatenate([windows for _, windows in waiting])))
        for i, windows in waiting:
            decoded[i] += islice(found, len(windows))
        waiting.clear()

    for i, text in enumerate(texts):
        windows = _windows(character_ids(text)) if text else ()
        while len(windows):
            waiting.append((i, windows[:room]))
            room, windows = room - len(waiting[-1][1]), windows[room:]
            if not room:
                run()
                room = WINDOWS_AT_ONCE
    if waiting:
        run()
    for i, windows in enumerate(decoded):
        if not any(windows):
            continue
        text, known = texts[i], base[i]
        fits = lambda s, e, kind: holds_kind(text[s:e], kind) and all(e <= a or z <= s for a, _, z in known)  # noqa: B023, E731
        trimmed = [(k * STEP, [_trimmed(text, k * STEP, c) for c in spans]) for k, spans in enumerate(windows)]
        out[i] = reconciled(trimmed, len(text), fits)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_DDL = "array<struct<kind:string,start:long,end:long>>"


def _span_arrays(found: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found], pa.list_(_SPAN))


def labelled_windows(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> list[tuple[str, list[Span]]]:
    """Windows with base spans, and stretches of text around them, from a bounded sample of documents with a digit or an ``@``.

    The sample is the first ``documents`` in hash order, and of its windows the first ``windows`` in hash order.
    """
    held = docs.select("text", F.xxhash64("text").alias("_hash")).filter(F.col("text").rlike("[0-9@]"))
    # hashes are picked first: texts of all partitions don't meet in one task
    picked = held.select("_hash").distinct().orderBy("_hash").limit(documents)
    sample = held.join(F.broadcast(picked), "_hash").dropDuplicates(["_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                for start in window_starts(len(text)).tolist():
                    part = text[start : start + WINDOW]
                    if HOLDS_HINT.search(part):
                        inside = [(max(0, s - start), k, min(len(part), e - start)) for s, k, e in base if s - start < len(part) and e > start]
                        texts.append(part)
                        spans.append([x for s in inside for x in s])
            yield pa.record_batch([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["text", "spans"])

    cut_up = materialize(sample.select("text"), "sample").mapInArrow(cut, "text string, spans array<long>")
    rows = cut_up.orderBy(F.xxhash64("text"), "text", "spans").limit(windows).collect()
    return [(r.text, [tuple(r.spans[i : i + 3]) for i in range(0, len(r.spans), 3)]) for r in rows]


def training_examples(sampled: Sequence[tuple[str, list[Span]]], examples: int = EXAMPLES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of sampled windows with base spans, and of generated ones up to ``examples``."""
    r = random.Random(seed)
    carriers = [t for t, _ in sampled] or [" ".join(_word(r) for _ in range(20)) for _ in range(50)]
    carriers = [re.sub(r"\S*[0-9@]\S*", "", c) for c in carriers]
    carriers += [re.sub(r"\S", lambda _: r.choice("😀日本ещё"), c) for c in carriers[::20]]
    # a window whose numbers no pattern explains may hold what the patterns miss: not a label
    sure = [(t, s) for t, s in sampled if s and not any(HOLDS_HINT.search(g) for g in _gaps(t, s))]
    made = [generated_example(r, r.choice(carriers)) for _ in range(max(examples - len(sure), 0))]
    ids, labels = np.zeros((examples, WINDOW), np.uint8), np.zeros((examples, WINDOW), np.int64)
    for i, (text, spans) in enumerate([*sure, *made][:examples]):
        ids[i, : len(text)] = character_ids(text)
        labels[i] = _labels_of(spans, WINDOW)
    return ids, labels


def _gaps(text: str, spans: list[Span]) -> Iterator[str]:
    at = 0
    for s, _, e in spans:
        yield text[at:s]
        at = max(at, e)
    yield text[at:]


def fit_pii(docs: DataFrame) -> dict[str, np.ndarray]:
    """A network fitted on a bounded sample of the documents' base spans and on generated ones."""
    return train(*training_examples(labelled_windows(docs)))


def find_pii(docs: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    """Every row's ``doc_id``, its ``base`` spans, and all ``spans``, by start, then kind; the network is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, base)
            every = [sorted(b + a) for b, a in zip(base, added)]
            yield pa.record_batch([batch.column(0), _span_arrays(base), _span_arrays(every)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, f"doc_id long, base {_SPAN_DDL}, spans {_SPAN_DDL}")
