"""A small bidirectional gated recurrent network over bytes (numpy).

One gated unit reads a word's bytes forwards and one backwards; both states
together give every position a distribution over the classes. Words of equal
length run together as one batch, so no padding enters.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
STEPS = 1500  #: of training, whatever the number of words


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.hidden, self.classes = hidden, classes
        self.p = {}
        for d in "fb":
            self.p["w" + d] = normal(256, 3 * hidden, scale=0.5)  # update, reset, new state
            self.p["u" + d] = normal(hidden, 3 * hidden, scale=hidden**-0.5)
            self.p["v" + d] = normal(hidden, classes, scale=hidden**-0.5)
        self.p["c"] = np.zeros(classes, np.float32)

    def _run(self, x, d, keep=None):
        """States after every step of (n, length) bytes; ``keep`` collects what backpropagation needs."""
        h3, hh = self.hidden * 2, self.hidden
        w, u = self.p["w" + d], self.p["u" + d]
        h = np.zeros((len(x), hh), np.float32)
        states = np.empty((x.shape[1], len(x), hh), np.float32)
        for t in range(x.shape[1]):
            a = w[x[:, t]]
            b = h @ u
            gate = _sigmoid(a[:, :h3] + b[:, :h3])
            z, r = gate[:, :hh], gate[:, hh:]
            new = np.tanh(a[:, h3:] + r * b[:, h3:])
            if keep is not None:
                keep.append((h, z, r, new, b[:, h3:]))
            h = new + z * (h - new)
            states[t] = h
        return states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(length, n, classes) for (n, length) bytes."""
        f, b = self._run(x, "f"), self._run(x[:, ::-1], "b")[::-1]
        s = f @ self.p["vf"] + b @ self.p["vb"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True)

    def gradients(self, x, y):
        """Loss and gradients by backpropagation through time; y is a class for each word."""
        kf, kb = [], []
        f = self._run(x, "f", kf)
        b = self._run(x[:, ::-1], "b", kb)
        s = f @ self.p["vf"] + b[::-1] @ self.p["vb"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        count = x.size
        loss = -np.log(s[:, np.arange(len(y)), y] + 1e-9).sum() / count
        s[:, np.arange(len(y)), y] -= 1
        s /= count
        g = {"c": s.sum(axis=(0, 1))}
        for d, states, kept, ds, xs in (("f", f, kf, s, x), ("b", b, kb, s[::-1], x[:, ::-1])):
            g["v" + d] = np.einsum("tnh,tnc->hc", states, ds)
            g["w" + d], g["u" + d] = np.zeros_like(self.p["w" + d]), np.zeros_like(self.p["u" + d])
            out = ds @ self.p["v" + d].T
            dh = np.zeros_like(states[0])
            u = self.p["u" + d]
            for t in range(x.shape[1] - 1, -1, -1):
                h, z, r, new, bn = kept[t]
                dh = dh + out[t]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dnew], axis=1)
                db = np.concatenate([dz, dr, dnew * r], axis=1)
                np.add.at(g["w" + d], xs[:, t], da)
                g["u" + d] += h.T @ db
                dh = dh * z + db @ u.T
        return loss, g

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = 512, rate: float = 0.01, seed: int = 2):
        """About ``steps`` Adam steps over batches of words of one length, in a fixed shuffled order."""
        rng = np.random.default_rng(seed)
        length = np.array([len(w) for w in words])
        batches = []
        for n in np.unique(length):
            if not n:
                continue
            rows = rng.permutation(np.flatnonzero(length == n))
            x = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), n)
            batches += [(x[k:k + batch], labels[rows[k:k + batch]]) for k in range(0, len(rows), batch)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        epochs = max(1, round(steps / max(len(batches), 1)))
        for _ in range(epochs):
            total = 0.0
            for k in rng.permutation(len(batches)):
                loss, g = self.gradients(*batches[k])
                total += loss
                step += 1
                now = rate / (1 + 2 * step / (epochs * len(batches)))
                for name, value in g.items():
                    value = np.clip(value, -1, 1)
                    first[name] += 0.1 * (value - first[name])
                    second[name] += 0.01 * (value * value - second[name])
                    hat = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.p[name] -= (now * hat).astype(np.float32)
            losses.append(total / max(len(batches), 1))
        return losses
