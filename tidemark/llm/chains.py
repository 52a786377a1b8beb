"""Forward and backward recursions over many documents at once.

A concatenation of documents is cut into blocks of STEPS tokens, and every
step runs over all blocks. The product of a block's transition matrices links
it exactly to the next, so one very long document costs what many short ones do.
Weights need not be probabilities: the recursions serve hidden Markov models
and conditional random fields alike.
"""

from __future__ import annotations

import numpy as np

STEPS = 128


def firsts(lengths: np.ndarray) -> np.ndarray:
    """Marks the first token of each document of a concatenation; no length is zero."""
    first = np.zeros(int(lengths.sum()), bool)
    first[np.cumsum(lengths) - lengths] = True
    return first


class Chain:
    """Blocks of a concatenation of documents; ``first`` marks the documents' first tokens."""

    def __init__(self, first: np.ndarray):
        self.n = len(first)
        self.blocks = -(-self.n // STEPS)
        pad = self.blocks * STEPS - self.n
        self.first = np.concatenate([first, np.ones(pad, bool)]).reshape(self.blocks, STEPS)
        self.starts = [np.nonzero(self.first[:, t])[0] for t in range(STEPS)]

    def fold(self, e: np.ndarray) -> np.ndarray:
        """Weights (n, K) by step and block: (STEPS, blocks, K)."""
        pad = self.blocks * STEPS - self.n
        whole = np.concatenate([e, np.ones((pad, e.shape[1]), e.dtype)]).reshape(self.blocks, STEPS, -1)
        return np.ascontiguousarray(whole.transpose(1, 0, 2))

    def fold_one(self, x: np.ndarray, pad) -> np.ndarray:
        """A value per token by step and block: (STEPS, blocks); ``pad`` behind the last token."""
        whole = np.concatenate([x, np.full(self.blocks * STEPS - self.n, pad, x.dtype)])
        return np.ascontiguousarray(whole.reshape(self.blocks, STEPS).T)

    def tokens(self, x: np.ndarray) -> np.ndarray:
        """The other way: (STEPS, blocks, ...) to (n, ...)."""
        return np.ascontiguousarray(np.moveaxis(x, 0, 1)).reshape(-1, *x.shape[2:])[: self.n]


def _step(v: np.ndarray, trans: np.ndarray, initial: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row vectors (..., K) one token on; documents that start forget what was before."""
    out = (v.reshape(-1, v.shape[-1]) @ trans).reshape(v.shape)
    if len(starts):
        out[starts] = v[starts].sum(-1, keepdims=True) * initial
    return out


def forward(chain: Chain, e: np.ndarray, initial: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward vectors (STEPS, blocks, K), scales (STEPS, blocks), block matrices.

    ``e`` are the folded emission weights; all is computed in their precision.
    The product of the scales from a document's first to its last token is its
    likelihood.
    """
    k = len(initial)
    initial, trans = initial.astype(e.dtype), trans.astype(e.dtype)
    m = np.broadcast_to(np.eye(k, dtype=e.dtype), (chain.blocks, k, k)).copy()
    for t in range(STEPS):
        m = _step(m, trans, initial, chain.starts[t])
        m *= e[t, :, None, :]
        if t % 4 == 3:
            m /= m.sum((1, 2), keepdims=True)
    enter = np.empty((chain.blocks, k), e.dtype)
    v = initial
    for b in range(chain.blocks):
        enter[b] = v
        v = v @ m[b]
        v = v / v.sum()
    alpha, scale = np.empty((STEPS, chain.blocks, k), e.dtype), np.empty((STEPS, chain.blocks), e.dtype)
    v, one = enter, np.ones(k, e.dtype)
    for t in range(STEPS):
        now = np.matmul(v, trans, out=alpha[t])
        if len(at := chain.starts[t]):
            now[at] = v[at].sum(-1, keepdims=True) * initial
        now *= e[t]
        now /= np.matmul(now, one, out=scale[t])[:, None]
        v = now
    return alpha, scale, m


def folded_marginals(chain: Chain, f: np.ndarray, initial: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of folded weights, which it overwrites: folded state marginals, expected transitions (K, K), folded scales.

    ``weight``, if given, is folded too: what the transition into each token
    counts. Behind the last token marginals and scales mean nothing.
    """
    initial, trans = initial.astype(f.dtype), trans.astype(f.dtype)
    alpha, scale, m = forward(chain, f, initial, trans)
    k = len(initial)
    leave = np.empty((chain.blocks, k), f.dtype)
    v = np.ones(k, f.dtype)
    for b in range(chain.blocks - 1, -1, -1):
        leave[b] = v
        v = m[b] @ v
        v = v / v.sum()
    gamma = np.empty_like(alpha)
    v, one = leave, np.ones(k, f.dtype)
    back = np.ascontiguousarray(trans.T)
    moves = np.zeros((k, k), f.dtype)
    for t in range(STEPS - 1, -1, -1):
        w = f[t]
        w *= v
        g = np.multiply(v, alpha[t], out=gamma[t])
        g /= (g @ one)[:, None]
        v = w @ back
        if len(at := chain.starts[t]):
            v[at] = (w[at] @ initial)[:, None]
        v /= (v @ one)[:, None]
        # xi(t) = alpha(t-1) x trans x (e beta)(t), made to sum to one; none into a first token
        a, after, first = (alpha[t - 1], w, chain.first[:, t]) if t else (alpha[-1, :-1], w[1:], chain.first[1:, 0])
        total = ((a @ trans) * after) @ one
        share = np.where(first, 0, 1 / np.where(total > 0, total, 1)).astype(f.dtype)
        if weight is not None:
            share *= weight[t] if t else weight[0, 1:]
        moves += a.T @ (after * share[:, None])
    return gamma, moves * trans, scale


def marginals(chain: Chain, e: np.ndarray, initial: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens' weights e (n, K): state marginals (n, K), expected transitions (K, K), scales (n).

    ``weight``, if given, is what the transition into each token counts."""
    gamma, moves, scale = folded_marginals(chain, chain.fold(e), initial, trans, None if weight is None else chain.fold_one(weight, 0))
    return chain.tokens(gamma), moves, chain.tokens(scale)
