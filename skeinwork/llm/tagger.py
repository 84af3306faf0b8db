"""A character-level bidirectional LSTM with CRF transitions in numpy: training from labelled spans, and decoding of windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
HIDDEN = 8
#: Characters: ASCII with folded case and one class for digits, then other letters up to U+024F, then the rest.
CLASSES = 130
_FOLD = np.full(0x250, 128, np.uint8)
_FOLD[:128] = np.arange(128)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[0x09, 0x0B, 0x0C, 0x0D]] = 32
WINDOW = 512
OVERLAP = 64
BATCH = 2048


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _FOLD[np.minimum(points, 0x24F)], np.uint8(129))


@dataclass(frozen=True)
class Tagger:
    """Weights: per direction the input rows (classes x 4H: in, forget, out, cell) and the recurrent (H x 4H); the projections; the transitions."""

    inputs: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    project: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(x: np.ndarray, table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    steps, batch = x.shape
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out, kept = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = table[x[t]] + h @ u
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        kept.append((h, before, i, f, o, g, squashed))
        h = out[t] = o * squashed
    return out, kept


def _backward(x: np.ndarray, u: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d_table, d_u = np.zeros((CLASSES, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh = dc = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, squashed = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        np.add.at(d_table, x[t], dz)
        d_u += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return d_table, d_u


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _crf(e: np.ndarray, labels: np.ndarray, a: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood and its gradients by the forward-backward recursion."""
    steps, batch, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = start + e[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + a, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    node = np.exp(alpha + beta - total[:, None])
    rows = np.arange(batch)
    pair = np.exp(alpha[:-1, :, :, None] + a + (e[1:] + beta[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
    gold = np.take_along_axis(e, labels[:, :, None], 2).sum((0, 2)) + start[labels[0]] + a[labels[:-1], labels[1:]].sum(0)
    d_e, d_start, d_a = node.copy(), node[0].sum(0), pair
    d_e[np.arange(steps)[:, None], rows, labels] -= 1
    np.subtract.at(d_start, labels[0], 1)
    np.subtract.at(d_a, (labels[:-1], labels[1:]), 1)
    return float((total - gold).mean()), d_e / batch, d_a / batch, d_start / batch


def fit(texts: list[str], spans: list[list[tuple[int, int, str]]], steps: int = 420, batch: int = 48, width: int = 96, seed: int = 7) -> Tagger:
    """Train on labelled spans (start, end, kind) with Adam; the same input and seed give the same weights."""
    rng = np.random.default_rng(seed)
    coded, marks = [], []
    for text, found in zip(texts, spans):
        mark = np.zeros(len(text), np.int64)
        for a, b, kind in found:
            mark[a:b] = 1 + KINDS.index(kind)
        coded.append(classes(text))
        marks.append(mark)
    x_all, y_all = np.concatenate(coded), np.concatenate(marks)
    p = {
        "f": rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN)),
        "b": rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN)),
        "uf": rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)),
        "ub": rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)),
        "w": rng.normal(0, 0.3, (2 * HIDDEN, LABELS)),
        "bias": np.zeros(LABELS),
        "a": np.eye(LABELS),
        "s": np.zeros(LABELS),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    for k in "fb":
        p[k][:, HIDDEN : 2 * HIDDEN] += 1
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        begin = rng.integers(0, len(x_all) - width, batch)
        at = begin[None, :] + np.arange(width)[:, None]
        x, y = x_all[at], y_all[at]
        hf, kf = _forward(x, p["f"], p["uf"])
        hb, kb = _forward(x[::-1], p["b"], p["ub"])
        both = np.concatenate([hf, hb[::-1]], axis=2)
        _, de, da, ds = _crf(both @ p["w"] + p["bias"], y, p["a"], p["s"])
        g = {"w": np.einsum("tbh,tbk->hk", both, de), "bias": de.sum((0, 1)), "a": da, "s": ds}
        dh = (de @ p["w"].T).astype(np.float32)
        g["f"], g["uf"] = _backward(x, p["uf"], kf, dh[:, :, :HIDDEN])
        g["b"], g["ub"] = _backward(x[::-1], p["ub"], kb, dh[::-1, :, HIDDEN:])
        norm = np.sqrt(sum(float((q**2).sum()) for q in g.values()))
        rate = 0.03 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in p:
            q = g[k] * min(1.0, 5.0 / max(norm, 1e-9))
            m[k] += 0.1 * (q - m[k])
            v[k] += 0.01 * (q**2 - v[k])
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Tagger((p["f"], p["b"]), (p["uf"], p["ub"]), p["w"], p["bias"], p["a"], p["s"])


def _scaled(table: np.ndarray) -> np.ndarray:
    """Rows of the gates, halved where (1 + tanh) / 2 stands for the logistic function."""
    out = np.ascontiguousarray(table.T).astype(np.float32)
    out[: 3 * HIDDEN] *= 0.5
    return out


def emissions(tagger: Tagger, x: np.ndarray, active: np.ndarray) -> np.ndarray:
    """(steps, labels, batch) scores of windows in columns, longest first; ``active[t]`` columns reach step t. Columns never touch each other or padding."""
    steps, batch = x.shape
    x = x.astype(np.intp)
    out = np.zeros((steps, LABELS, batch), np.float32)
    out += tagger.bias[None, :, None]
    for side in (0, 1):
        # the state is kept doubled: h is (1 + tanh) * tanh
        table, u = _scaled(tagger.inputs[side]), _scaled(tagger.recurrent[side]) * np.float32(0.5)
        w = np.ascontiguousarray(tagger.project[side * HIDDEN : (side + 1) * HIDDEN].T) * np.float32(0.5)
        width = 0
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            k = int(active[t])
            if k != width:  # columns begin or end: arrays of the new width, in one piece
                was = min(k, width)
                fresh = np.zeros((2, HIDDEN, k), np.float32)
                if was:
                    fresh[0, :, :was], fresh[1, :, :was] = h[:, :was], c[:, :was]
                h, c, width = fresh[0], fresh[1], k
                z, drive = np.empty((2, 4 * HIDDEN, k), np.float32)
                score = np.empty((LABELS, k), np.float32)
            np.take(table, x[t, :k], axis=1, mode="clip", out=drive)
            np.matmul(u, h, out=z)
            z += drive
            np.tanh(z, out=z)
            z[: 3 * HIDDEN] += 1
            c *= z[HIDDEN : 2 * HIDDEN]
            z[:HIDDEN] *= z[3 * HIDDEN :]
            c += z[:HIDDEN]
            c *= 0.5
            np.tanh(c, out=h)
            h *= z[2 * HIDDEN : 3 * HIDDEN]
            np.matmul(w, h, out=score)
            out[t, :, :k] += score
    return out


def undecided(tagger: Tagger, e: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Columns whose best labels may differ from all 0.

    A stretch of other labels gains at most its steps' lead over label 0 plus a transition more than it has
    steps; if no step's lead makes up for two transitions (or a transition and the start), 0 stays best.
    """
    lead = e[:, 1:].max(axis=1) - e[:, 0]
    lead[np.arange(e.shape[2]) >= active[:, None]] = -np.inf
    gain = max(0.0, float(tagger.transitions.max() - tagger.transitions[0, 0]))
    first = max(0.0, float(tagger.start.max() - tagger.start[0]))
    return np.flatnonzero(lead.max(axis=0) + 2 * gain + first >= 0)


def viterbi(tagger: Tagger, e: np.ndarray, active: np.ndarray) -> np.ndarray:
    """(steps, batch) best labels; 0 beyond a column's end."""
    steps, _, batch = e.shape
    a = tagger.transitions
    best = np.empty_like(e)
    best[0] = e[0] + tagger.start[:, None]
    for t in range(1, steps):
        k = int(active[t])
        for j in range(LABELS):
            row = best[t - 1, 0, :k] + a[0, j]
            for i in range(1, LABELS):
                np.maximum(row, best[t - 1, i, :k] + a[i, j], out=row)
            best[t, j, :k] = row + e[t, j, :k]
    labels = np.zeros((steps, batch), np.uint8)
    after = 0
    for t in range(steps - 1, -1, -1):
        k = int(active[t])
        score = best[t, :, :k]
        if after:
            score = score.copy()
            score[:, :after] += a[:, labels[t + 1, :after]]
        labels[t, :k] = score.argmax(axis=0)
        after = k
    return labels


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def tag_windows(tagger: Tagger, windows: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """Spans (start, end, label, score per character) of every window of character classes."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in windows]
    order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        lengths = np.array([len(windows[i]) for i in some])
        steps = int(lengths[0]) if len(lengths) else 0
        if not steps:
            continue
        x = np.zeros((len(some), steps), np.uint8)
        for column, i in enumerate(some):
            x[column, : lengths[column]] = windows[i]
        x = np.ascontiguousarray(x.T)
        active = np.searchsorted(-lengths, -np.arange(steps), "left")
        e = emissions(tagger, x, active)
        open_ = undecided(tagger, e, active)
        labels = np.zeros((len(some), steps + 2), np.uint8)
        if len(open_):
            labels[open_, 1:-1] = viterbi(tagger, np.ascontiguousarray(e[:, :, open_]), np.searchsorted(open_, active, "left")).T
        turns = np.flatnonzero(np.diff(labels.reshape(-1).astype(np.int8)) != 0)
        column, step = np.divmod(turns, steps + 2)
        begins = np.flatnonzero(labels[column, step + 1] > 0)
        if len(begins):
            c, first, last = column[begins], step[begins], step[begins + 1]
            label = labels[c, first + 1].astype(np.int64)
            at = np.repeat(first, last - first) + _places(last - first)
            many = np.repeat(np.arange(len(begins)), last - first)
            lead = e[at, label[many], c[many]] - e[at, 0, c[many]]
            score = np.bincount(many, lead) / (last - first)
            for k, *span in zip(c.tolist(), first.tolist(), last.tolist(), label.tolist(), score.tolist()):
                found[some[k]].append(tuple(span))
    return found
