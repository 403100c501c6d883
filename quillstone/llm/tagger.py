"""A character-level bidirectional LSTM with CRF transitions, in numpy.

``Tagger`` holds the weights and decodes; ``train`` fits them to windows of characters with
a label for each. Arrays are laid out as (units, windows), so that each step of the
recurrence is one small matrix product over all windows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

UNITS = 8
EMBED = 8
LABELS = ("none", "email", "ip", "card", "phone")
K = len(LABELS)


def _classes() -> np.ndarray:
    """Class of each character: letters by name, digits together, some signs, all else."""
    out = np.full(129, 41, dtype=np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    out[48:58] = 27
    for i, c in enumerate("@.-_+() \n:/,%"):
        out[ord(c)] = 28 + i
    out[9:14] = 36
    out[128] = 42
    return out


CLASS = _classes()
N_CLASSES = 43


def classes(text: str) -> np.ndarray:
    """Class of every code point; those beyond ASCII share one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return CLASS[np.minimum(points, 128)]


@dataclass
class Tagger:
    """``embed`` (EMBED, classes); per direction ``rec`` (4 UNITS, UNITS + EMBED + 1) with gates in
    the order input, forget, output, new; ``out`` (K, 2 UNITS + 1); ``move`` (K, K) transitions."""

    embed: np.ndarray
    rec: list[np.ndarray]
    out: np.ndarray
    move: np.ndarray

    def emissions(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores (steps, K, windows). Windows are sorted by length ``n``, longest first, so those
        that reach a step are always the first ones, in either direction."""
        steps, width = x.shape
        score = np.empty((steps, K, width), dtype=np.float32)
        score[:] = self.out[:, -1][None, :, None]
        live = np.searchsorted(-n, -np.arange(steps), side="left")  # windows longer than t
        for direction, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            rec = self.rec[direction].copy()
            rec[: 3 * UNITS] *= 0.5  # sigmoid by tanh: one call for all gates
            out = np.ascontiguousarray(self.out[:, direction * UNITS : (direction + 1) * UNITS])
            joint = np.zeros((UNITS + EMBED + 1, width), dtype=np.float32)
            joint[-1] = 1
            cell = np.zeros((UNITS, width), dtype=np.float32)
            room = np.empty((4 * UNITS, width), dtype=np.float32)
            for t in order:
                m = int(live[t])
                if not m:
                    continue
                np.take(self.embed, x[t, :m], axis=1, out=joint[UNITS:-1, :m], mode="clip")
                z = np.matmul(rec, joint[:, :m], out=room[:, :m])
                np.tanh(z, out=z)
                gates, new, c, h = z[: 3 * UNITS], z[3 * UNITS :], cell[:, :m], joint[:UNITS, :m]
                gates *= 0.5
                gates += 0.5
                c *= gates[UNITS : 2 * UNITS]
                new *= gates[:UNITS]
                c += new
                np.tanh(c, out=h)
                h *= gates[2 * UNITS :]
                score[t, :, :m] += out @ h
        return score

    def decode(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Best labels (steps, windows) of windows apart."""
        return self.best(self.emissions(x, n), n)

    def open_places(self, e: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places that some labelled stretch covers whose score could exceed that of ``none``; on a best
        path all others are ``none``. A stretch's gain is bounded by the best label at each
        place and the best transition between any two, so the most that any stretch through a
        place can gain is a maximum over where it starts and one over where it ends."""
        rel = self.move - self.move[0, 0]
        enter, stay, leave = max(0.0, rel[0, 1:].max()), rel[1:, 1:].max(), max(0.0, rel[1:, 0].max())
        lead = (e[:, 1:].max(axis=1) - e[:, 0]).astype(np.float64)
        # a step between texts, so that a stretch in one gains nothing in the next; were it too small,
        # more places than need be would be open
        apart = np.repeat(np.arange(len(at) - 1) * 1e7, np.diff(at))
        sums = np.cumsum(lead + stay)
        left = np.maximum.accumulate(lead - sums + apart) + sums - apart
        back = np.cumsum((lead + stay)[::-1])[::-1]
        right = (np.maximum.accumulate((lead - back)[::-1] + apart[-1:] - apart[::-1])[::-1] + back) - (apart[-1:] - apart)
        return left + right - lead + enter + leave > -1e-3

    def best_of_texts(self, e: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Labels on the best path of every text, over all its places; ``e`` is (place, K), texts lie
        one after the other from ``at[i]`` to ``at[i + 1]``.

        Places that are certainly ``none`` part a text into stretches whose paths don't depend
        on each other, so these are searched side by side, each with the places around it.
        """
        out = np.zeros(len(e), dtype=np.uint8)
        if not len(e):
            return out
        open_ = self.open_places(e, at)
        e = e.copy()
        e[~open_, 1:] = -1e6
        edge = np.zeros(len(e) + 1, dtype=bool)
        edge[at] = True
        began = open_ & (edge[:-1] | ~np.concatenate(([False], open_[:-1])))
        ended = open_ & (edge[1:] | ~np.concatenate((open_[1:], [False])))
        first, last = np.flatnonzero(began), np.flatnonzero(ended) + 1
        first, last = first - ~edge[first], last + ~edge[last]
        n = last - first
        order = np.argsort(-n, kind="stable")
        k = 0
        while k < len(order):
            lanes = order[k : k + max(1, (1 << 20) // int(n[order[k]]))]
            k += len(lanes)
            m, steps = n[lanes], int(n[lanes[0]])
            place = first[lanes] + np.minimum(np.arange(steps)[:, None], m - 1)
            best = self.best(np.ascontiguousarray(e[place].transpose(0, 2, 1)), m)
            some = best > 0
            out[place[some]] = best[some]
        return out

    def best(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Best labels (steps, windows) by scores (steps, K, windows).

        A bound on what any stretch of labels can score over ``none`` (the best label at
        each step, the best transition between any two labels) shows most windows to have
        no label; only the others are searched.
        """
        steps, _, width = e.shape
        best = np.zeros((steps, width), dtype=np.uint8)
        lead = e[:, 1]
        for k in range(2, K):
            lead = np.maximum(lead, e[:, k])
        lead = lead - e[:, 0]
        rel = (self.move - self.move[0, 0]).astype(np.float32)
        enter, stay, leave = rel[0, 1:].max(), rel[1:, 1:].max(), rel[1:, 0].max()
        over, hot = lead[0].copy(), np.zeros(width, dtype=bool)
        for t in range(steps):
            if t:
                over += stay
                np.maximum(over, enter, out=over)
                over += lead[t]
            hot |= (t < n) & (over > np.where(t == n - 1, 0, -leave) - 1e-3)
        hot = np.flatnonzero(hot)
        if not len(hot):
            return best
        e, m = e[:, :, hot].astype(np.float64), n[hot]
        score, back = e[0].copy(), np.zeros((steps, K, len(hot)), dtype=np.uint8)
        for t in range(1, steps):
            way = score[:, None] + self.move[:, :, None]
            frm = way.argmax(axis=0)
            new = np.take_along_axis(way, frm[None], 0)[0] + e[t]
            on = t < m
            score = np.where(on, new, score)
            back[t] = np.where(on, frm, np.arange(K)[:, None])
        label = score.argmax(axis=0)
        for t in range(steps - 1, -1, -1):
            best[t, hot] = np.where(t < m, label, 0)
            label = back[t, label, np.arange(len(hot))]
        return best


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_loss(e: np.ndarray, move: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of labels ``y`` (steps, windows), and its gradients."""
    steps, _, width = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, None] + move[:, :, None], 0) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(move[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
    z = _lse(alpha[-1], 0)
    lanes, tt = np.arange(width), np.arange(steps)[:, None]
    gold = e[tt, y, lanes].sum(axis=0) + move[y[:-1], y[1:]].sum(axis=0)
    de = np.exp(alpha + beta - z)
    de[tt, y, lanes] -= 1
    dm = np.zeros_like(move)
    for t in range(1, steps):
        dm += np.exp(alpha[t - 1][:, None] + move[:, :, None] + (e[t] + beta[t])[None] - z).sum(axis=2)
    np.add.at(dm, (y[:-1].ravel(), y[1:].ravel()), -1)
    return float((z - gold).mean()), de / width, dm / width


def _run(rec: np.ndarray, inputs: np.ndarray):
    """States of one direction, with what the way back needs. inputs: (steps, EMBED, windows)."""
    steps, _, width = inputs.shape
    h, c = np.zeros((UNITS, width)), np.zeros((UNITS, width))
    kept, hidden = [], np.zeros((steps, UNITS, width))
    for t in range(steps):
        joint = np.concatenate([h, inputs[t], np.ones((1, width))])
        z = rec @ joint
        g = 1 / (1 + np.exp(-z[: 3 * UNITS]))
        new = np.tanh(z[3 * UNITS :])
        c0, c = c, g[UNITS : 2 * UNITS] * c + g[:UNITS] * new
        tc = np.tanh(c)
        h = g[2 * UNITS :] * tc
        kept.append((joint, g, new, c0, tc))
        hidden[t] = h
    return hidden, kept


def _back(rec: np.ndarray, kept: list, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    drec, dins = np.zeros_like(rec), np.zeros((len(kept), EMBED, dh_out.shape[2]))
    dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
    for t in range(len(kept) - 1, -1, -1):
        joint, g, new, c0, tc = kept[t]
        i, f, o = g[:UNITS], g[UNITS : 2 * UNITS], g[2 * UNITS :]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * new * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)])
        drec += dz @ joint.T
        dj = rec.T @ dz
        dh, dins[t], dc = dj[:UNITS], dj[UNITS:-1], dc * f
    return drec, dins


def train(x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 96, seed: int = 5, rate: float = 0.03) -> Tagger:
    """Fit to windows ``x`` and labels ``y`` (windows, steps) by Adam on the CRF likelihood."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (EMBED, N_CLASSES)),
        "rec0": rng.normal(0, 0.3, (4 * UNITS, UNITS + EMBED + 1)),
        "rec1": rng.normal(0, 0.3, (4 * UNITS, UNITS + EMBED + 1)),
        "out": rng.normal(0, 0.3, (K, 2 * UNITS + 1)),
        "move": np.zeros((K, K)),
    }
    for d in "01":
        p["rec" + d][UNITS : 2 * UNITS, -1] = 1.0  # remember by default
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        xb, yb = x[pick].T, y[pick].T.astype(np.int64)
        ins = p["embed"][:, xb].transpose(1, 0, 2)
        h0, k0 = _run(p["rec0"], ins)
        h1, k1 = _run(p["rec1"], ins[::-1])
        both = np.concatenate([h0, h1[::-1], np.ones((len(h0), 1, batch))], axis=1)
        e = np.einsum("ku,tuw->tkw", p["out"], both, optimize=True)
        _, de, dm = crf_loss(e, p["move"], yb)
        dboth = np.einsum("ku,tkw->tuw", p["out"], de, optimize=True)
        g = {"move": dm, "out": np.einsum("tkw,tuw->ku", de, both, optimize=True)}
        g["rec0"], di0 = _back(p["rec0"], k0, dboth[:, :UNITS])
        g["rec1"], di1 = _back(p["rec1"], k1, dboth[::-1, UNITS : 2 * UNITS])
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"].T, xb, (di0 + di1[::-1]).transpose(0, 2, 1))
        size = np.sqrt(sum((v * v).sum() for v in g.values()))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            d = g[k] * min(1.0, 5.0 / size)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            p[k] = p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    f = np.float32
    return Tagger(p["embed"].astype(f), [p["rec0"].astype(f), p["rec1"].astype(f)], p["out"].astype(f), p["move"].astype(np.float64))
