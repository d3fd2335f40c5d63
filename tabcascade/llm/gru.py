"""Gated recurrent unit in numpy, forward and back through time, and the Adam step."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    half = x.dtype.type(0.5) if isinstance(x, np.ndarray) else 0.5
    return np.tanh(x * half) * half + half


def cell(gates: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: (new state, update gate, reset gate, candidate, recurrent part of the candidate).

    ``gates`` is the input's share of the three gates, (batch, 3 * hidden).
    """
    k = h.shape[1]
    rec = h @ u
    zr = sigmoid(gates[:, : 2 * k] + rec[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(gates[:, 2 * k :] + r * rec[:, 2 * k :])
    return n + z * (h - n), z, r, n, rec[:, 2 * k :]


def forward(gates: np.ndarray, u: np.ndarray, h0: np.ndarray, mask: np.ndarray | None = None):
    """States (steps + 1, batch, hidden) of ``gates`` (steps, batch, 3 * hidden), and what
    :func:`backward` needs. Where ``mask`` is 0 the state stays."""
    states, kept = [h0], []
    for t in range(len(gates)):
        h, z, r, n, rn = cell(gates[t], states[-1], u)
        if mask is not None:
            h = np.where(mask[t][:, None], h, states[-1])
        states.append(h)
        kept.append((z, r, n, rn))
    return np.stack(states), kept


def backward(dh: np.ndarray, states: np.ndarray, kept, u: np.ndarray, mask: np.ndarray | None = None):
    """Gradients (of gates, of u) from those of each step's new state ``dh``."""
    steps, batch, k = dh.shape
    dgates, du, carry = np.empty((steps, batch, 3 * k), dh.dtype), np.zeros_like(u), np.zeros((batch, k), dh.dtype)
    for t in range(steps - 1, -1, -1):
        g = dh[t] + carry
        live = g if mask is None else g * mask[t][:, None]
        z, r, n, rn = kept[t]
        h = states[t]
        dz = live * (h - n) * z * (1 - z)
        dn = live * (1 - z) * (1 - n * n)
        dr = dn * rn * r * (1 - r)
        drec = np.concatenate([dz, dr, dn * r], 1)
        dgates[t] = np.concatenate([dz, dr, dn], 1)
        du += h.T @ drec
        carry = live * z + drec @ u.T + (g - live)
    return dgates, du


def lanes_forward(table: np.ndarray, codes: np.ndarray, u: np.ndarray, h0: np.ndarray, starts: np.ndarray | None = None):
    """States (steps + 1, hidden, lanes) and what :func:`lanes_backward` needs, as :func:`forward` with
    the lanes last, so that every slice of a gate is one block of memory. ``codes`` (steps, lanes) are rows
    of the gate ``table``. Where ``starts`` is true the state before the step is 0, in ``states`` as well.
    """
    k, steps, lanes = len(u), *codes.shape
    half = table.dtype.type(0.5)
    states, kept = np.empty((steps + 1, k, lanes), table.dtype), np.empty((4, steps, k, lanes), table.dtype)
    z, r, n, rn = kept
    across, gates, rec, zr = np.ascontiguousarray(u.T), np.empty((3 * k, lanes), table.dtype), np.empty((3 * k, lanes), table.dtype), np.empty((2 * k, lanes), table.dtype)
    across[: 2 * k] *= half
    fresh = starts.any(1) if starts is not None else np.zeros(steps, bool)
    states[0] = h0
    for t in range(steps):
        h, new = states[t], states[t + 1]
        if fresh[t]:
            h[:, starts[t]] = 0
        gates[...] = np.take(table, codes[t], axis=0, mode="clip").T
        np.matmul(across, h, out=rec)
        np.multiply(gates[: 2 * k], half, out=zr)
        zr += rec[: 2 * k]
        np.tanh(zr, zr)
        zr *= half
        np.add(zr[:k], half, out=z[t])
        np.add(zr[k:], half, out=r[t])
        rn[t] = rec[2 * k :]
        np.multiply(r[t], rec[2 * k :], out=new)
        new += gates[2 * k :]
        np.tanh(new, n[t])
        np.subtract(h, n[t], out=new)
        new *= z[t]
        new += n[t]
    return states, kept


def lanes_backward(dstates: np.ndarray, states: np.ndarray, kept: np.ndarray, u: np.ndarray, starts: np.ndarray | None = None):
    """Gradients (of the gates (steps, lanes, 3 * hidden), of u) from those of the states before each
    step, ``dstates`` (steps, hidden, lanes)."""
    steps, k, lanes = kept.shape[1:]
    dgates, du = np.empty((steps, lanes, 3 * k), kept.dtype), np.zeros((3 * k, k), kept.dtype)
    own, rec = (np.empty((3 * k, lanes), kept.dtype) for _ in range(2))
    a, carry = (np.empty((k, lanes), kept.dtype) for _ in range(2))
    g = np.zeros((k, lanes), kept.dtype)
    dz, dr, dn = own[:k], own[k : 2 * k], own[2 * k :]
    fresh = starts.any(1) if starts is not None else np.zeros(steps, bool)
    for t in range(steps - 1, -1, -1):
        z, r, n, rn = kept[:, t]
        np.multiply(g, z, out=a)
        np.subtract(g, a, out=dn)
        np.subtract(states[t], n, out=dz)
        dz *= z
        dz *= dn
        np.multiply(n, n, out=dr)
        dr *= dn
        dn -= dr
        np.multiply(dn, r, out=rec[2 * k :])
        np.multiply(rec[2 * k :], rn, out=dr)
        np.multiply(dr, r, out=carry)
        dr -= carry
        rec[: 2 * k] = own[: 2 * k]
        dgates[t] = own.T
        du += rec @ states[t].T
        np.matmul(u, rec, out=g)
        g += a
        g += dstates[t]
        if fresh[t]:
            g[:, starts[t]] = 0
    return dgates, du.T


def final_states(table: np.ndarray, codes: np.ndarray, u: np.ndarray) -> np.ndarray:
    """States (steps, hidden, batch) without what a gradient needs.

    ``codes`` (steps, batch) are columns of the gate ``table`` (3 * hidden, words): with the
    batch last, every slice of a gate is one block of memory.
    """
    k, steps, batch = len(u), *codes.shape
    h = np.zeros((k, batch), table.dtype)
    out = np.empty((steps, k, batch), table.dtype)
    gates, rec, across, half = np.empty((3 * k, batch), table.dtype), np.empty((3 * k, batch), table.dtype), np.ascontiguousarray(u.T), table.dtype.type(0.5)
    zr, z, r, n = rec[: 2 * k], rec[:k], rec[k : 2 * k], rec[2 * k :]
    for t in range(steps):
        np.take(table, codes[t], axis=1, out=gates, mode="clip")
        np.matmul(across, h, out=rec)
        zr += gates[: 2 * k]
        zr *= half
        np.tanh(zr, zr)
        zr *= half
        zr += half
        n *= r
        n += gates[2 * k :]
        np.tanh(n, n)
        h = np.subtract(h, n, out=out[t])
        h *= z
        h += n
    return out


def row_sums(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """(count, width) sums of ``values`` by row number."""
    out = np.zeros((count, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        out[ordered[starts]] = np.add.reduceat(values[order], starts)
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], clip: float = 5.0) -> None:
        """One step; a gradient may be (rows, their gradient), then other rows stay as they are."""
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in (g[1] if isinstance(g, tuple) else g for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-12))
        for k, g in grads.items():
            if isinstance(g, tuple):
                at, g = g[0], g[1] * scale
                m, v = 0.9 * self.m[k][at] + 0.1 * g, 0.999 * self.v[k][at] + 0.001 * g * g
                self.m[k][at], self.v[k][at] = m, v
                params[k][at] -= (self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(params[k].dtype)
                continue
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            params[k] = params[k] - (self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)).astype(params[k].dtype)


class LaneAdam:
    """:class:`Adam` in place and block by block, so that a block's numbers stay in the cache."""

    BLOCK = 1 << 15

    def __init__(self, params: dict[str, np.ndarray]):
        self.step = 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], rate: float, clip: float = 5.0) -> None:
        """One step; a gradient may be (rows, their gradient), then other rows stay as they are. The
        gradients are used up."""
        self.step += 1
        squares = sum(float(np.vdot(g, g)) for g in (g[1] if isinstance(g, tuple) else g for g in grads.values()))
        scale = min(1.0, clip / (np.sqrt(squares) + 1e-12))
        root = np.sqrt(1 - 0.999**self.step)
        rate, tiny = rate * root / (1 - 0.9**self.step), 1e-8 * root

        def moved(p, m, v, g):
            m *= 0.9
            m += g * (0.1 * scale)
            v *= 0.999
            g *= g
            g *= 0.001 * scale * scale
            v += g
            np.sqrt(v, g)
            g += tiny
            np.divide(m, g, out=g)
            g *= rate
            p -= g

        for k, g in grads.items():
            p, m, v = params[k], self.m[k], self.v[k]
            if isinstance(g, tuple):
                at, g = g
                some = [x[at] for x in (p, m, v)]
                moved(*some, g)
                p[at], m[at], v[at] = some
                continue
            p, m, v, g = (x.reshape(-1) for x in (p, m, v, g))
            for a in range(0, len(p), self.BLOCK):
                moved(*(x[a : a + self.BLOCK] for x in (p, m, v, g)))
