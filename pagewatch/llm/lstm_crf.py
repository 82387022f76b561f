"""A small bidirectional LSTM with CRF transitions over characters, in numpy.

Sequences are padded to one length; padding is a class of its own and is labelled as outside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tagger:
    """Parameters: ``inputs`` (2, classes, 4h) embedding times input weights, ``recurrent`` (2, h, 4h),
    ``output`` (2h, tags), ``bias`` (tags), ``step`` (tags, tags) and ``first`` (tags)."""

    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    step: np.ndarray
    first: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(inputs, recurrent, codes):
    """Hidden states (2, T, n, h) of both directions; the second runs over the reversed sequence."""
    n, steps = codes.shape
    h = recurrent.shape[1]
    both = np.stack([codes.T, codes.T[::-1]])
    gates_in = np.stack([inputs[0][both[0]], inputs[1][both[1]]])  # (2, T, n, 4h)
    hidden = np.zeros((2, steps + 1, n, h), np.float32)
    cell = np.zeros((2, steps + 1, n, h), np.float32)
    gates = np.empty_like(gates_in)
    for t in range(steps):
        z = gates_in[:, t] + hidden[:, t] @ recurrent
        g = gates[:, t]
        g[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
        g[..., 3 * h :] = np.tanh(z[..., 3 * h :])
        cell[:, t + 1] = g[..., h : 2 * h] * cell[:, t] + g[..., :h] * g[..., 3 * h :]
        hidden[:, t + 1] = g[..., 2 * h : 3 * h] * np.tanh(cell[:, t + 1])
    return both, gates, cell, hidden


def _lstm_back(recurrent, both, gates, cell, hidden, d_hidden, classes):
    steps, h = gates.shape[1], recurrent.shape[1]
    dz = np.empty_like(gates)
    dh = np.zeros_like(hidden[:, 0])
    dc = np.zeros_like(dh)
    for t in range(steps - 1, -1, -1):
        g = gates[:, t]
        i, f, o, c = (g[..., k * h : (k + 1) * h] for k in range(4))
        dh = dh + d_hidden[:, t]
        shown = np.tanh(cell[:, t + 1])
        dc = dc + dh * o * (1 - shown**2)
        z = dz[:, t]
        z[..., :h] = dc * c * i * (1 - i)
        z[..., h : 2 * h] = dc * cell[:, t] * f * (1 - f)
        z[..., 2 * h : 3 * h] = dh * shown * o * (1 - o)
        z[..., 3 * h :] = dc * i * (1 - c**2)
        dc = dc * f
        dh = z @ recurrent.transpose(0, 2, 1)
    flat = dz.reshape(2, -1, 4 * h)
    d_recurrent = hidden[:, :-1].reshape(2, -1, h).transpose(0, 2, 1) @ flat
    d_inputs = np.zeros((2, classes, 4 * h), np.float32)
    for k in range(2):
        one_hot = np.zeros((classes, flat.shape[1]), np.float32)
        one_hot[both[k].ravel(), np.arange(flat.shape[1])] = 1
        d_inputs[k] = one_hot @ flat[k]
    return d_inputs, d_recurrent


def _emissions(model: Tagger, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, n, tags) scores and the joined hidden states (T, n, 2h)."""
    joined = np.concatenate([hidden[0, 1:], hidden[1, :0:-1]], axis=-1)
    return joined @ model.output + model.bias, joined


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _crf(scores: np.ndarray, tags: np.ndarray, step: np.ndarray, first: np.ndarray):
    """Mean negative log-likelihood and its gradients by emissions, transitions and first tags."""
    steps, n, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0] + first
    for t in range(1, steps):
        alpha[t] = scores[t] + _log_sum(alpha[t - 1][:, :, None] + step, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(step + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _log_sum(alpha[-1], 1)
    marginal = np.exp(alpha + beta - log_z[None, :, None])
    gold = np.zeros_like(scores)
    gold[np.arange(steps)[:, None], np.arange(n)[None, :], tags.T] = 1
    pairs = np.exp(
        alpha[:-1, :, :, None] + step + (scores[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None]
    ).sum(axis=(0, 1))
    seen = np.zeros((k, k), np.float32)
    np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    path = (scores * gold).sum(axis=(0, 2)) + first[tags[:, 0]] + step[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    loss = float((log_z - path).mean())
    return loss, (marginal - gold) / n, (pairs - seen) / n, (marginal[0] - gold[0]).sum(axis=0) / n


def train(codes: np.ndarray, tags: np.ndarray, classes: int, n_tags: int, forbidden: np.ndarray,
          hidden: int = 24, rounds: int = 350, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Fit with Adam on ``(n, T)`` arrays. ``forbidden`` marks transitions that never happen."""
    rng = np.random.default_rng(seed)
    h = hidden
    p = {
        "inputs": rng.normal(0, 0.3, (2, classes, 4 * h)), "recurrent": rng.normal(0, 0.25, (2, h, 4 * h)),
        "output": rng.normal(0, 0.3, (2 * h, n_tags)), "bias": np.zeros(n_tags),
        "step": np.zeros((n_tags, n_tags)), "first": np.zeros(n_tags),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["inputs"][:, :, h : 2 * h] += 1.0  # gates start by remembering
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    wall = np.where(forbidden, np.float32(-1e4), np.float32(0))
    for round_ in range(1, rounds + 1):
        pick = rng.integers(0, len(codes), min(batch, len(codes)))
        x, y = codes[pick], tags[pick]
        model = Tagger(**p)
        both, gates, cell, states = _lstm(p["inputs"], p["recurrent"], x)
        scores, joined = _emissions(model, states)
        _, d_scores, d_step, d_first = _crf(scores, y, p["step"] + wall, p["first"])
        flat = d_scores.reshape(-1, n_tags)
        d_joined = d_scores @ p["output"].T
        d_hidden = np.stack([d_joined[..., :h], d_joined[::-1, :, h:]])
        d_inputs, d_recurrent = _lstm_back(p["recurrent"], both, gates, cell, states, d_hidden, classes)
        grads = {
            "inputs": d_inputs, "recurrent": d_recurrent, "output": joined.reshape(-1, 2 * h).T @ flat,
            "bias": flat.sum(axis=0), "step": d_step, "first": d_first,
        }
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            pace = rate * min(1.0, 2 * (1 - round_ / (rounds + 1)))
            p[k] -= (pace * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-8)).astype(np.float32)
    return Tagger(**(p | {"step": p["step"] + wall}))


def emissions(model: Tagger, codes: np.ndarray) -> np.ndarray:
    """Scores (n, T, tags) of an ``(n, T)`` array of classes."""
    return _emissions(model, _lstm(model.inputs, model.recurrent, codes)[3])[0].transpose(1, 0, 2)


def best_paths(model: Tagger, scores: list[np.ndarray], together: int = 200_000) -> list[np.ndarray]:
    """Best tag path for each array of emissions (T, tags). Those of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    while order:
        some = [order.pop()]
        longest = len(scores[some[0]])
        while order and (len(some) + 1) * longest <= together:
            some.append(order.pop())
        # Behind its end a sequence is outside of any span.
        padded = np.full((longest, len(some), model.bias.shape[0]), -1e4, np.float32)
        padded[:, :, 0] = 0
        for at, i in enumerate(some):
            padded[: len(scores[i]), at] = scores[i]
        for i, path in zip(some, _viterbi(model, padded)):
            out[i] = path[: len(scores[i])]
    return out


def _viterbi(model: Tagger, scores: np.ndarray) -> np.ndarray:
    steps, n, k = scores.shape
    back = np.zeros((steps, n, k), np.int8)
    total = scores[0] + model.first
    for t in range(1, steps):
        reach = total[:, :, None] + model.step
        back[t] = reach.argmax(axis=1)
        total = reach.max(axis=1) + scores[t]
    path = np.empty((n, steps), np.int8)
    path[:, -1] = total.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t][np.arange(n), path[:, t]]
    return path
