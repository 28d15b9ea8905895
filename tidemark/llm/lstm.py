"""A bidirectional LSTM that labels every element of a sequence, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Parameters by name: for each direction (f, b) input, recurrent and bias weights; output weights."""

    def __init__(self, width: int, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, 2 * hidden).astype(np.float32), "skip": np.zeros(width, np.float32), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.15, (width, 4 * hidden)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            gates = np.zeros(4 * hidden, np.float32)
            gates[hidden : 2 * hidden] = 1  # remember at first
            self.p["c" + d] = gates

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, carried: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """States (T, B, H) of one direction over x (T, B, D), from ``carried`` on; mask (T, B, 1)."""
        n = self.hidden
        pre = x @ self.p["x" + d] + self.p["c" + d]
        h, c = carried or (np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32))
        out, tape = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + d]
            i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            new = f * c + i * g
            squashed, m = np.tanh(new), mask[t]
            if keep:
                tape.append((t, i, f, o, g, c, h, squashed))
            h, c = m * (o * squashed) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, tape, (h, c)

    def margins(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        n = self.hidden
        return f @ self.p["out"][:n] + b @ self.p["out"][n:] + x @ self.p["skip"] + self.p["bias"]

    def margins_in_slices(self, count: int, size: int, make: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """Margins of one sequence of any length: ``make(a, b)`` gives the inputs of elements a to b, one slice at a time."""
        out, n, cuts = np.zeros(count, np.float32), self.hidden, [(a, min(count, a + size)) for a in range(0, count, size)]
        for d, order in (("f", cuts), ("b", cuts[::-1])):
            carried = None
            for a, b in order:
                x = make(a, b)[:, None, :]
                states, _, carried = self._run(x, np.ones((b - a, 1, 1), np.float32), d, False, carried)
                out[a:b] += states[:, 0] @ (self.p["out"][:n] if d == "f" else self.p["out"][n:])
                if d == "f":
                    out[a:b] += x[:, 0] @ self.p["skip"] + self.p["bias"]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over unmasked elements and its gradients."""
        n, states, tapes = self.hidden, {}, {}
        for d in "fb":
            states[d], tapes[d], _ = self._run(x, mask, d, True)
        both = np.concatenate((states["f"], states["b"]), axis=2)
        p = _sigmoid(both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"])
        m, total = mask[:, :, 0], float(mask.sum())
        loss = float(-(m * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        e = (m * (p - y) / total).astype(np.float32)
        grad = {"out": np.einsum("tb,tbh->h", e, both), "skip": np.einsum("tb,tbd->d", e, x), "bias": e.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            w, own = self.p["h" + d], self.p["out"][k * n : (k + 1) * n]
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            dw = np.zeros_like(w)
            dh, dc = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
            for t, i, f, o, g, c, h, squashed in reversed(tapes[d]):
                dh = dh + e[t][:, None] * own
                mt = mask[t]
                dh_in = mt * dh
                dnew = mt * dc + dh_in * o * (1 - squashed**2)
                dz = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), dh_in * squashed * o * (1 - o), dnew * i * (1 - g**2)), axis=1)
                dz_all[t] = dz
                dw += h.T @ dz
                dh, dc = dz @ w.T + (1 - mt) * dh, dnew * f + (1 - mt) * dc
            flat = dz_all.reshape(-1, 4 * n)
            grad |= {"h" + d: dw, "x" + d: x.reshape(-1, x.shape[2]).T @ flat, "c" + d: flat.sum(axis=0)}
        return loss, grad

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int, seed: int, batch: int = 32, rate: float = 0.01, cells: int = 60_000) -> float:
        """Adam over shuffled batches of at most ``cells`` elements, padding included; returns the last epoch's mean loss."""
        rng, m, v, step, loss = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, 0.0
        for _ in range(epochs):
            order, losses = rng.permutation(len(sequences)), []
            for chosen in _batches(order.tolist(), [len(s) for s in sequences], batch, cells):
                x, mask = padded([sequences[j] for j in chosen])
                y = padded([labels[j][:, None] for j in chosen])[0][:, :, 0]
                one, grad = self.gradients(x, mask, y)
                losses.append(one)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def _batches(order: list[int], sizes: list[int], most: int, cells: int) -> Iterator[list[int]]:
    some, longest = [], 0
    for j in order:
        if some and (len(some) == most or (len(some) + 1) * max(longest, sizes[j]) > cells):
            yield some
            some, longest = [], 0
        some.append(j)
        longest = max(longest, sizes[j])
    if some:
        yield some


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(T, B, D) values and (T, B, 1) mask of sequences of different lengths."""
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(sequences), 1), np.float32)
    for j, s in enumerate(sequences):
        x[: len(s), j], mask[: len(s), j] = s, 1
    return x, mask
