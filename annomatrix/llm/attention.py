"""A small causal self-attention model over slots of subword ids, in NumPy: forward, backward and Adam.

The next slot is predicted from a window: the CONTEXT positions before a block of STRIDE positions, and the block. Heads of
attention with a learned bias per distance read the window; their values and the last slot's own vector pass a rectifier
and correct a prior, which is the smoothed share of each slot behind the last one, from counts. Slots form classes of equal
size: a softmax over the classes, and one over the slots of the right class. So the probabilities of all slots sum to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CONTEXT = STRIDE = 8
SPAN = CONTEXT + STRIDE
HEADS, WIDTH = 1, 16
#: Windows of a training step.
STEP_WINDOWS = 256
RATE, DECAY = 0.02, (0.9, 0.98)
#: Bounds of the entries of queries and keys, so that no exponential overflows.
LARGEST = 3.5
LAG = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(SPAN)

Params = dict[str, np.ndarray]


def start(slots: int, classes: int, seed: int = 0) -> Params:
    r, d = np.random.Generator(np.random.PCG64(seed)), HEADS * WIDTH
    some = lambda scale, *shape: (scale * r.standard_normal(shape)).astype(np.float32)
    return {
        "query": some(0.3, HEADS, slots, WIDTH),
        "key": some(0.3, HEADS, slots, WIDTH),
        "value": some(0.3, HEADS, slots, WIDTH),
        "own": some(0.3, slots, d),
        "lag": np.stack([-np.arange(SPAN) * 0.5 ** (3 * h + 1) for h in range(HEADS)]).astype(np.float32),
        "class": np.zeros((d, classes), dtype=np.float32),
        "member": np.zeros((classes, d, slots // classes), dtype=np.float32),
    }


class Prior:
    """Log shares of classes, and of the slots of a class, behind each slot."""

    def __init__(self, pairs: np.ndarray, classes: int, weight: float = 5.0):
        """pairs[a, b] counts slot b behind slot a; the shares of all slots count as weight more."""
        slots = len(pairs)
        share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * slots)
        p = (pairs + weight * share) / (pairs.sum(1, keepdims=True) + weight)
        p = p.reshape(slots, classes, -1)
        of_class = p.sum(2)
        self.of_class = np.log(of_class).astype(np.float32)
        self.of_member = np.log(p / of_class[:, :, None]).astype(np.float32).reshape(slots * classes, -1)


def windows(lengths: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, inside, first) of the windows over texts of these lengths, which lie end to end, or of the chosen ones of
    them: SPAN positions of each, whether each of the STRIDE last ones is in the text, and whether a window is a text's first."""
    ends = np.cumsum(-(-lengths // STRIDE))
    if chosen is None:
        chosen = np.arange(ends[-1] if len(ends) else 0)
    text = np.searchsorted(ends, chosen, side="right")
    nth = chosen - np.append(0, ends)[text]
    stop = np.cumsum(lengths)[text]
    at = (stop - lengths[text] + nth * STRIDE)[:, None] + np.arange(-CONTEXT, STRIDE)
    inside = at[:, CONTEXT:] < stop[:, None]
    return np.clip(at, 0, max(0, int(lengths.sum()) - 1)), inside, nth == 0


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(e, sums, logs) of the rows of x, with e / sums their softmax and logs the logarithms of their summed exponentials."""
    ones = np.ones(x.shape[1], dtype=x.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(x)
        sums = e @ ones
    if not len(sums) or (sums.min() > 0 and sums.max() < np.inf):
        return e, sums, np.log(sums)
    most = x.max(1)
    e = np.exp(x - most[:, None])
    sums = e @ ones
    return e, sums, np.log(sums) + most


class Model:
    def __init__(self, params: Params, prior: Prior):
        self.p, self.prior = params, prior
        self.classes, self.members = params["class"].shape[1], params["member"].shape[2]

    def _attend(self, slots: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Per head: query, key, value, weights."""
        out, scale = [], np.float32(WIDTH**-0.5)
        for h in range(HEADS):
            q, k, v = (self.p[c][h] for c in ("query", "key", "value"))
            q, k, v = np.take(q * scale, slots[:, CONTEXT:], 0), np.take(k, slots, 0), np.take(v, slots, 0)
            w = q @ k.transpose(0, 2, 1)
            w += np.where(LAG >= 0, self.p["lag"][h][np.maximum(LAG, 0)], np.float32(-1e9))
            np.exp(w, out=w)
            w[np.flatnonzero(first), :, :CONTEXT] = 0
            w *= (1 / (w.reshape(-1, SPAN) @ np.ones(SPAN, dtype=w.dtype))).reshape(*w.shape[:2], 1)
            out.append((q, k, v, w))
        return out

    def _hidden(self, heads: list, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows of the positions at, which count the blocks' positions end to end."""
        mixed = [(w @ v).reshape(-1, WIDTH) for _, _, v, w in heads]
        mixed = np.take(mixed[0] if len(mixed) == 1 else np.concatenate(mixed, 1), at, 0)
        mixed += np.take(self.p["own"], last, 0)
        return np.maximum(mixed, 0, out=mixed)

    def log_probs(self, slots: np.ndarray, inside: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target, in the order of the positions inside."""
        logp, order, *_ = self._forward(slots, inside, first, target)
        out = np.empty_like(logp)
        out[order] = logp
        return out

    def _forward(self, slots: np.ndarray, inside: np.ndarray, first: np.ndarray, target: np.ndarray) -> tuple:
        """Logarithms and all that led to them, in the order of the targets' classes."""
        order = np.argsort((target // self.members).astype(np.int16), kind="stable")
        which, member = np.divmod(target[order], self.members)
        ends = np.cumsum(np.bincount(which, minlength=self.classes)).tolist()
        at = np.flatnonzero(inside)[order]
        heads, last = self._attend(slots, first), np.take(np.ascontiguousarray(slots[:, CONTEXT:]).ravel(), at)
        h = self._hidden(heads, at, last)
        top = h @ self.p["class"]
        top += np.take(self.prior.of_class, last, 0)
        low = np.empty((len(h), self.members), dtype=h.dtype)
        own = [(c, slice(a, b)) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
        for c, rows in own:
            np.matmul(h[rows], self.p["member"][c], out=low[rows])
        low += np.take(self.prior.of_member, last * self.classes + which, 0)
        every = np.arange(len(h))
        of_top, of_low = every * self.classes + which, every * self.members + member
        out = np.take(top.ravel(), of_top) + np.take(low.ravel(), of_low)
        top, sum_top, log_top = _exp(top)
        low, sum_low, log_low = _exp(low)
        out -= log_top
        out -= log_low
        return out, order, heads, last, at, h, (top, sum_top, of_top), (low, sum_low, of_low), own

    def gradient(self, slots: np.ndarray, inside: np.ndarray, first: np.ndarray, target: np.ndarray) -> tuple[float, Params]:
        """The mean negative log-probability of the targets, and its derivatives."""
        logp, _, heads, last, at, h, top, low, own = self._forward(slots, inside, first, target)
        n, p, g = len(logp), self.p, {}
        for e, sums, hit in (top, low):
            e *= (1 / (n * sums))[:, None]
            e.reshape(-1)[hit] -= np.float32(1 / n)
        top, low = top[0], low[0]
        g["class"] = h.T @ top
        dh = top @ p["class"].T
        g["member"], back = np.zeros_like(p["member"]), np.empty_like(h)
        for c, rows in own:
            np.matmul(h[rows].T, low[rows], out=g["member"][c])
            np.matmul(low[rows], p["member"][c].T, out=back[rows])
        dh += back
        dh *= h > 0
        # Columns of own and of each head's queries by last slot; columns of each head's values and keys by slot.
        d = HEADS * WIDTH
        of_last = np.zeros((*inside.shape, 2 * d), dtype=h.dtype)
        of_last.reshape(-1, 2 * d)[at, :d] = dh
        of_slot = np.empty((*slots.shape, 2 * d), dtype=h.dtype)
        g["lag"], seen = np.zeros_like(p["lag"]), LAG >= 0
        for i, (q, k, v, w) in enumerate(heads):
            mine = slice(i * WIDTH, (i + 1) * WIDTH)
            theirs = slice(d + i * WIDTH, d + (i + 1) * WIDTH)
            wide = of_last[:, :, mine]
            np.matmul(w.transpose(0, 2, 1), wide, out=of_slot[:, :, mine])
            s = wide @ v.transpose(0, 2, 1)
            s -= ((s * w).reshape(-1, SPAN) @ np.ones(SPAN, dtype=w.dtype)).reshape(*w.shape[:2], 1)
            s *= w
            g["lag"][i] = np.bincount(LAG[seen], s.sum(0)[seen], SPAN)
            np.matmul(s, k, out=of_last[:, :, theirs])
            np.matmul(s.transpose(0, 2, 1), q, out=of_slot[:, :, theirs])
        of_last, of_slot = self._by_slot(slots[:, CONTEXT:], of_last), self._by_slot(slots, of_slot)
        heads = lambda x: x.reshape(len(x), HEADS, WIDTH).transpose(1, 0, 2)
        g["own"], g["query"] = of_last[:, :d], heads(of_last[:, d:]) * np.float32(WIDTH**-0.5)
        g["value"], g["key"] = heads(of_slot[:, :d]), heads(of_slot[:, d:])
        return float(-logp.mean()), {c: v.astype(np.float32, copy=False) for c, v in g.items()}

    def _by_slot(self, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of the rows of each slot."""
        out = np.zeros((self.classes * self.members, rows.shape[-1]), dtype=rows.dtype)
        # Two columns are added as one complex number.
        pair = np.result_type(rows.dtype, np.complex64)
        places = np.take(np.arange(out.size // 2).reshape(len(out), -1), slots.ravel(), 0)
        np.add.at(out.reshape(-1).view(pair), places.ravel(), rows.reshape(-1).view(pair))
        return out


class Adam:
    """Steps in place of params, which it makes views of one vector."""

    def __init__(self, params: Params, rate: float = RATE):
        self.names, self.flat, at = list(params), np.concatenate([x.ravel() for x in params.values()]), 0
        for c, x in params.items():
            params[c] = self.flat[at : at + x.size].reshape(x.shape)
            at += x.size
        # Means of gradients and of their squares, as multiples of 1 - DECAY.
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.t, self.rate = 0, rate

    def step(self, params: Params, gradient: Params) -> None:
        self.t += 1
        a, b = DECAY
        g = np.concatenate([gradient[c].ravel() for c in self.names])
        self.m *= np.float32(a)
        self.m += g
        g *= g
        self.v *= np.float32(b)
        self.v += g
        np.sqrt(self.v, out=g)
        g += np.float32(1e-8 / (1 - b) ** 0.5)
        np.divide(self.m, g, out=g)
        g *= np.float32(self.rate * (1 - b**self.t) ** 0.5 / (1 - a**self.t) * (1 - a) / (1 - b) ** 0.5)
        self.flat -= g
        for c in ("query", "key"):
            np.clip(params[c], -LARGEST, LARGEST, out=params[c])
        np.clip(params["lag"], -30, 10, out=params["lag"])


Texts = tuple[np.ndarray, np.ndarray, np.ndarray]


def batches(texts: Texts, size: int, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(slots, inside, first, target) of size windows each, of all windows in their order or of the chosen ones. texts is
    (slot before each target, target, lengths) of texts end to end. Every target is in one window's block."""
    last, target, lengths = texts
    at, inside, first = windows(lengths, chosen)
    for lo in range(0, len(at), size):
        w = slice(lo, lo + size)
        yield np.take(last, at[w]), inside[w], first[w], np.take(target, at[w, CONTEXT:][inside[w]])


def train(params: Params, prior: Prior, runs: Iterator[Texts], every: int = 1, nth: int = 0, rate: float = RATE, seed: int = 0) -> tuple[Params, int]:
    """One pass over runs of texts, by the nth of every so many windows. Gives the trained copy and the number of targets."""
    params, shuffle, n, seen = {c: x.copy() for c, x in params.items()}, np.random.Generator(np.random.PCG64(seed)), 0, 0
    adam, model = Adam(params, rate), Model(params, prior)
    for texts in runs:
        many = int((-(-texts[2] // STRIDE)).sum())
        chosen = np.flatnonzero((np.arange(many) + seen) % every == nth)
        seen += many
        for batch in batches(texts, STEP_WINDOWS, shuffle.permutation(chosen)):
            adam.step(params, model.gradient(*batch)[1])
            n += len(batch[3])
    return params, n
