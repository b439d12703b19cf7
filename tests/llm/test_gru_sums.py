"""One learning step: gradients of input rows are summed over all tokens of a row, and only rows that occur move."""

import numpy as np

from tradelens.llm.gru import Model, windows


def test_rows_that_occur_move(monkeypatch):
    r = np.random.default_rng(1)
    seqs = [(k, r.integers(0, 40, n), r.integers(-1, 50, n)) for k, n in enumerate((70, 3, 1, 40, 9))]
    for w in windows(iter(seqs), 3, 16):
        m = Model(np.arange(50, 0, -1), 20, 4, 5, 6, 2)
        m.p["words"][:], m.p["classes"][:] = r.standard_normal(m.p["words"].shape), r.standard_normal(m.p["classes"].shape)
        seen = {}
        monkeypatch.setattr(m, "_move", lambda name, rows, grad, rate: seen.update({name: (rows, grad.copy())}))
        state, lost = np.zeros((4, len(w.lanes)), np.float32), lambda: -m.score(w, state)[0].sum() / (w.targets > -2).sum()
        m.learn(w, state, 0.1)
        rows, grad = seen["inputs"]
        assert sorted(rows) == sorted(set(w.inputs[w.targets > -2].tolist()))
        k, d = 0, int(r.integers(0, 12))
        for step in (1e-2, -2e-2):  # central difference
            m.p["inputs"][rows[k], d] += np.float32(step)
            step > 0 and seen.update(up=lost())
        down = lost()
        m.p["inputs"][rows[k], d] += np.float32(1e-2)
        assert abs((seen["up"] - down) / 2e-2 - grad[k, d]) < 1e-3
