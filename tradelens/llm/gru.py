"""A small gated recurrent language model in numpy: many documents side by side, one window of time after another.

Documents run in lanes. A window covers the next tokens of every lane; the state at its end is the state at the start of
the next one, also when a document goes on, and it is zero where a document begins. Gradients stop at the window's
edge. The softmax over words has two factors, the class of a word and the word within its class; words beyond the
vocabulary form a class of their own, whose inner distribution is given by counts outside of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: One document: its number, the row of the input table before each token, and the word to be foretold (-1: beyond the vocabulary).
Sequence = tuple[int, np.ndarray, np.ndarray]


class Window(NamedTuple):
    lanes: np.ndarray  # numbers of the lanes that have tokens
    inputs: np.ndarray  # lanes x time
    targets: np.ndarray  # -2 where a lane has ended
    starts: np.ndarray  # true where a document begins
    at: list[int]  # first place of each piece of a document, in lanes x time flattened
    of: list[int]  # its document
    ended: list[int]  # documents that end in this window


def windows(docs: Iterator[Sequence], lanes: int, steps: int) -> Iterator[Window]:
    """Windows over ``docs``; a lane takes the next document when its own has ended, so only the last ones leave lanes empty."""
    docs = iter(docs)
    now: list[list | None] = [None] * lanes
    more = True
    while True:
        inputs, targets = np.zeros((lanes, steps), np.int32), np.full((lanes, steps), -2, np.int32)
        starts, at, of, ended = np.zeros((lanes, steps), bool), [], [], []
        for lane in range(lanes):
            t, own = 0, now[lane]
            while t < steps:
                if own is None:
                    found = next(docs, None) if more else None
                    if found is None:
                        more = False
                        break
                    own = [0, *found]
                    starts[lane, t] = True
                place, number, rows, words = own
                n = min(steps - t, len(words) - place)
                inputs[lane, t : t + n] = rows[place : place + n]
                targets[lane, t : t + n] = words[place : place + n]
                at.append(lane * steps + t)
                of.append(number)
                t += n
                own[0] += n
                if own[0] == len(words):
                    ended.append(number)
                    own = None
            now[lane] = own
        if not at:
            return
        used = np.flatnonzero((targets > -2).any(axis=1))
        if len(used) < lanes:
            back = np.zeros(lanes, np.int64)
            back[used] = np.arange(len(used))
            at = [int(back[a // steps]) * steps + a % steps for a in at]
            inputs, targets, starts = inputs[used], targets[used], starts[used]
        yield Window(used, inputs, targets, starts, at, of, ended)


#: Where Adagrad's sums begin: below the squares of the gradients, which are means over a window's tokens.
INIT = 1e-9


class Model:
    """Parameters and Adagrad sums. ``counts`` are those of the vocabulary, most frequent first, ``rare`` that of all other tokens."""

    def __init__(self, counts: np.ndarray, rare: int, hidden: int, classes: int, rare_inputs: int, seed: int):
        words, r = len(counts), np.random.default_rng(seed)
        mass = np.cumsum(np.sqrt(np.maximum(counts, 1)))
        bins = np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1)
        self.class_of = np.append(np.unique(bins, return_inverse=True)[1], 0).astype(np.int64)
        n = int(self.class_of[:-1].max()) + 1
        self.class_of[-1] = n  # the class of rare words, found by the target -1
        self.first = np.searchsorted(self.class_of[:-1], np.arange(n + 1))
        full = np.maximum(counts, 0.5).astype(np.float64)
        by_class = np.append(np.add.reduceat(full, self.first[:-1]), max(rare, 0.5))
        f = np.float32
        self.hidden = hidden
        self.p = {
            "inputs": (0.1 * r.standard_normal((words + rare_inputs + 1, 3 * hidden))).astype(f),
            "gates": (r.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "classes": np.zeros((hidden, n + 1), f), "class_bias": np.log(by_class / by_class.sum()).astype(f),
            "words": np.zeros((words, hidden), f), "word_bias": np.log(full / by_class[self.class_of[:-1]]).astype(f),
        }
        # rows of the two tables, each of which few windows touch, have one sum for the row
        self.sums = {k: np.full((len(v), 1) if k in ("inputs", "words") else v.shape, INIT, f) for k, v in self.p.items()}

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for d in (self.p, self.sums) for v in d.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.sums):
            for k, v in d.items():
                d[k] = flat[at : at + v.size].astype(np.float32).reshape(v.shape)
                at += v.size

    def _states(self, w: Window, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The states after each time, hidden x time x lanes, and the last; ``keep`` gets what the way back needs.

        Lanes are the last axis of all arrays, so that numpy's loops run along them.
        """
        k, gates = self.hidden, np.ascontiguousarray(self.p["gates"].T)
        x = np.ascontiguousarray(self.p["inputs"][w.inputs.T].transpose(0, 2, 1))
        begins, going = w.starts.any(axis=0), (~w.starts.T).astype(np.float32)
        out = np.empty((k, x.shape[0], x.shape[2]), np.float32)
        for t in range(len(x)):
            if begins[t]:
                h = h * going[t]
            a = gates @ h
            g, own, n = x[t, : 2 * k], a[2 * k :], x[t, 2 * k :]
            g += a[: 2 * k]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            n += g[k:] * own
            np.tanh(n, out=n)
            d = h - n
            if keep is not None:
                keep.append((h, g, own, n, d))
            h = g[:k] * d
            h += n
            out[:, t] = h
        return out, h

    def _foretell(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of the probabilities of ``targets`` after the states ``h``, hidden x targets, and the gradient with respect to ``h``."""
        p, kind, every = self.p, self.class_of[targets], np.arange(len(targets))

        def softmax(z: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The logarithms, and in ``z`` the probabilities less 1 for the own one, if asked for."""
            z -= z.max(axis=0)
            mine = z[own, at]
            np.exp(z, out=z)
            total = z.sum(axis=0)
            if grads is not None:
                z /= total
                z[own, at] -= 1
            return mine - np.log(total)

        order = np.argsort(kind.astype(np.int16), kind="stable")  # tokens of one class side by side, from here on
        kind, targets, h = kind[order], targets[order], np.take(h, order, axis=1)
        z = p["classes"].T @ h
        z += p["class_bias"][:, None]
        out = softmax(z, kind, every).astype(np.float64)
        dh = None
        if grads is not None:
            grads["classes"], grads["class_bias"] = h @ z.T, z.sum(axis=1)
            dh = p["classes"] @ z
        edges = np.searchsorted(kind, np.arange(len(self.first)))
        for k in range(len(self.first) - 1):
            (low, high), (a, b) = self.first[k : k + 2], edges[k : k + 2]
            if a == b or high - low == 1:
                continue
            words = p["words"][low:high]
            z = words @ h[:, a:b]
            z += p["word_bias"][low:high, None]
            out[a:b] += softmax(z, targets[a:b] - low, every[: b - a])
            if grads is not None:
                dh[:, a:b] += words.T @ z
                grads["words"][low:high], grads["word_bias"][low:high] = z @ h[:, a:b].T, z.sum(axis=1)
        place = np.empty_like(order)
        place[order] = every
        return out[place], None if dh is None else np.take(dh, place, axis=1)

    def score(self, w: Window, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the probabilities, lanes x time flattened (0 where a lane has ended), and the last states, hidden x lanes."""
        states, h = self._states(w, h)
        flat, targets = states.reshape(self.hidden, -1), w.targets.T.ravel()
        real = np.flatnonzero(targets > -2)
        out = np.zeros(len(targets))
        if len(real) == len(targets):
            out = self._foretell(flat, targets)[0]
        else:
            out[real] = self._foretell(np.take(flat, real, axis=1), targets[real])[0]
        return out.reshape(w.targets.T.shape).T.ravel(), h

    def _move(self, name: str, rows, grad: np.ndarray, rate: float) -> None:
        sums, square = self.sums[name], grad * grad
        now = sums[rows] + (square.mean(axis=1, keepdims=True) if name in ("inputs", "words") else square)
        sums[rows] = now
        self.p[name][rows] -= rate * grad / np.sqrt(now)

    def learn(self, w: Window, h: np.ndarray, rate: float) -> np.ndarray:
        """One step down the gradient of this window; the last states are returned."""
        kept: list = []
        states, last = self._states(w, h, kept)
        k, steps, lanes = states.shape
        flat, targets = states.reshape(k, -1), w.targets.T.ravel()
        real = np.flatnonzero(targets > -2)
        whole = len(real) == len(targets)
        grads: dict = {n: np.zeros_like(self.p[n]) for n in ("words", "word_bias")}
        _, dh_real = self._foretell(flat if whole else np.take(flat, real, axis=1), targets[real], grads)
        if whole:
            dh_all = dh_real
        else:
            dh_all = np.zeros((k, steps * lanes), np.float32)
            dh_all[:, real] = dh_real
        dh_all = dh_all.reshape(k, steps, lanes)
        gates = self.p["gates"]
        back = np.zeros((k, lanes), np.float32)
        # the last third of the input's gradients, dx, differs from that of the state's by the gate
        before, da, dx = np.empty((k, steps, lanes), np.float32), np.empty((3 * k, steps, lanes), np.float32), np.empty((k, steps, lanes), np.float32)
        begins = w.starts.any(axis=0)
        for t in range(steps - 1, -1, -1):
            h0, g, own, n, d = kept[t]
            dh = dh_all[:, t] + back
            slope = g - g * g
            both, dn = da[:, t], dx[:, t]
            np.multiply(dh, 1 - g[:k], out=dn)
            dn *= 1 - n * n
            np.multiply(dh * d, slope[:k], out=both[:k])
            np.multiply(dn * own, slope[k:], out=both[k : 2 * k])
            np.multiply(dn, g[k:], out=both[2 * k :])
            back = dh * g[:k]
            back += gates @ both
            if begins[t]:
                back[:, w.starts[:, t]] = 0
            before[:, t] = h0
        scale = np.float32(1 / max(1, len(real)))
        grads["gates"] = before.reshape(k, -1) @ da.reshape(3 * k, -1).T
        for name, grad in grads.items():
            self._move(name, slice(None), grad * scale, rate)
        ids = w.inputs.T.ravel()[real].astype(np.int64)
        rows = np.flatnonzero(np.bincount(ids))
        place = np.empty(rows[-1] + 1, np.int64)
        place[rows] = np.arange(len(rows))
        ids = place[ids]
        sums = np.empty((len(rows), 3 * k), np.float32)
        for m, x in enumerate((*da.reshape(3 * k, -1)[: 2 * k], *dx.reshape(k, -1))):
            sums[:, m] = np.bincount(ids, x if whole else x[real])
        self._move("inputs", rows, sums * scale, rate)
        return last
