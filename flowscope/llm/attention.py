"""A small causal self-attention language model on subword ids, in numpy.

One layer of masked attention over the last ids predicts the class of the next id, and then which member of its class it
is. Classes are neighbours in the vocabulary's order of spelling; every id that occurs in training has a place and an
input row of its own, and about as many classes as members are made for them. Ids that never occur share their class's last place
by equal parts.

A text is cut into windows that overlap by ``CONTEXT`` ids; a window predicts its own ``STEP`` ids, each once.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np

WIDTH, CONTEXT, STEP = 32, 16, 32
SPAN = CONTEXT + STEP
#: The id that ends a text, unless another one is named.
END = 50_256
#: Windows of a training step at the start and at most; it grows by one for every ``GROW`` ids seen.
FIRST_BATCH, LAST_BATCH, GROW = 24, 256, 12_000
#: Decay of the mean gradient and of its square.
MEAN, SQUARE = np.float32(0.9), np.float32(0.99)
#: Windows whose attention a step works on at once, and numbers that Adam moves at once, so that they stay in a core's cache.
PART, BLOCK = 128, 16_384


@lru_cache(maxsize=1)
def _keep_memory() -> None:
    """Have the C library keep freed arrays for the next step: giving them back and fetching them anew costs more than the step's sums."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def _within(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """``x`` with its rows' maxima taken off, in place, where values are too large, or may be too small, to do without. ``some`` holds an entry of each row."""
    if x.max(initial=0) > 60 or some.min(initial=0) < -60:
        x -= x.max(-1, keepdims=True)
    return x


def _total(x: np.ndarray) -> np.ndarray:
    """Exponentials in place; their sums over the last axis."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[-1], np.float32)


def _softmax(x: np.ndarray, some: np.ndarray, scale: np.ndarray | float = 1) -> np.ndarray:
    """``scale`` times the softmax, in place, over the last axis."""
    total = _total(_within(x, some))
    x *= (scale / total)[..., None].astype(np.float32)
    return x


class Adam:
    """Adam over named arrays; of an embedding only the rows that a step touches are moved."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        root = np.sqrt(1 - float(SQUARE) ** self.t)
        rate, least = np.float32(rate * min(1, self.t / 20) * root / (1 - float(MEAN) ** self.t)), np.float32(1e-8 * root)
        for name, g in grads.items():
            at = rows.get(name)
            if at is not None:
                mean, square, moved = (x[name][at] for x in (self.m, self.s, self.p))
                self._move(moved, g, mean, square, rate, least)
                self.m[name][at], self.s[name][at], self.p[name][at] = mean, square, moved
                continue
            whole = [x.reshape(-1) for x in (self.p[name], g, self.m[name], self.s[name])]
            for a in range(0, g.size, BLOCK):
                self._move(*(x[a : a + BLOCK] for x in whole), rate, least)

    @staticmethod
    def _move(p: np.ndarray, g: np.ndarray, mean: np.ndarray, square: np.ndarray, rate: np.float32, least: np.float32) -> None:
        """All in place; ``g`` is overwritten."""
        mean *= MEAN
        mean += (1 - MEAN) * g
        square *= SQUARE
        g *= g
        g *= 1 - SQUARE
        square += g
        np.sqrt(square, out=g)
        g += least
        np.divide(mean, g, out=g)
        g *= rate
        p -= g


class Model:
    """``rank``: input row of an id; ``klass`` and ``member``: its places; ``share``: log of its share of a place. The rest is trained."""

    def __init__(self, counts: np.ndarray, spelling: list[str], end: int = END):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        seen = int((counts > 0).sum())
        self.end = end
        self.classes = max(1, int(np.ceil(np.sqrt(seen))))
        self.members, inputs = self.classes + 1, seen + 1
        self.rank = np.empty(size, np.int32)
        self.rank[order] = np.minimum(np.arange(size), inputs - 1)
        common = np.zeros(size, bool)
        common[order[:seen]] = True
        ranked = np.array(sorted(range(size), key=spelling.__getitem__))
        place = np.cumsum(common[ranked]) - common[ranked]  # common ids that stand before
        self.klass, self.member = np.empty(size, np.int32), np.empty(size, np.int32)
        self.klass[ranked] = np.minimum(place // (self.members - 1), self.classes - 1)
        self.member[ranked] = np.where(common[ranked], place % (self.members - 1), self.members - 1)
        smooth = counts + 0.5
        slot = self.klass * self.members + self.member
        whole = np.bincount(slot, weights=smooth, minlength=self.classes * self.members)
        self.share = np.log(smooth / whole[slot])
        whole = whole.reshape(self.classes, self.members)
        log = lambda part, all_: np.where(part > 0, np.log(np.maximum(part, 1e-9) / np.maximum(all_, 1e-9)), -1e9).astype(np.float32)  # noqa: E731  places without an id have no share
        rng = np.random.default_rng(7)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "E": small(inputs, WIDTH), "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, WIDTH), "r": np.zeros(SPAN, np.float32),
            "U": small(WIDTH, self.classes), "b": log(whole.sum(1), whole.sum()),
            "M": small(self.classes, WIDTH, self.members), "c": log(whole, whole.sum(1, keepdims=True)),
        }
        i, j = np.arange(STEP)[:, None] + CONTEXT, np.arange(SPAN)[None]
        self.ahead, self.back = j > i, np.clip(i - j, 0, SPAN - 1)
        self.trained = 0  # ids of training documents that were learnt

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, vector: np.ndarray) -> Model:
        a = 0
        for name, x in self.p.items():
            self.p[name] = vector[a : a + x.size].reshape(x.shape).astype(np.float32)
            a += x.size
        return self

    def windows(self, ids: np.ndarray, sizes: np.ndarray):
        """Inputs and targets of documents one after the other, and where windows begin and end: each document's ids, after an end, then its end."""
        n = sizes.astype(np.int64) + 1
        stop = np.cumsum(n)
        target = np.insert(ids.astype(np.int32), np.cumsum(sizes.astype(np.int64)), self.end)
        source = np.concatenate(([self.end], target[:-1]))
        per = -(-n // STEP)
        doc = np.repeat(np.arange(len(n)), per)
        inside = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * STEP
        return self.rank[source], target, (stop - n)[doc] + inside, stop[doc], inside == 0, doc

    def bias(self) -> np.ndarray:
        return np.where(self.ahead, np.float32(-1e9), self.p["r"][self.back]).astype(np.float32)

    def score(self, ids: np.ndarray, sizes: np.ndarray, group: int = 256) -> np.ndarray:
        """log10 probability of each document."""
        _keep_memory()
        source, target, begin, stop, first, doc = self.windows(ids, sizes)
        p, bias = self.p, self.bias()
        q, k, v = p["E"] @ p["q"] / np.sqrt(WIDTH).astype(np.float32), p["E"] @ p["k"], p["E"] @ p["v"]
        klass, member, share = self.klass[target], self.member[target], self.share[target]
        out, reach, here = np.zeros(len(sizes)), np.arange(-CONTEXT, STEP), np.arange(STEP)
        own = here
        for a in range(0, len(begin), group):
            s = begin[a : a + group]
            u = source[np.clip(s[:, None] + reach, 0, len(source) - 1)]
            mine = u[:, CONTEXT:]
            att = np.matmul(q.take(mine, axis=0), k.take(u, axis=0).transpose(0, 2, 1))
            att += bias
            att[first[a : a + group], :, :CONTEXT] = -1e9
            h = np.matmul(_softmax(att, att[:, own, CONTEXT + own]), v.take(u, axis=0))
            h += p["E"].take(mine, axis=0)
            h = h.reshape(-1, WIDTH)
            at = s[:, None] + here
            good = np.flatnonzero((at < stop[a : a + group, None]).ravel())
            at = at.ravel()[good]
            by = np.argsort(klass[at].astype(np.int16), kind="stable")
            at, good = at[by], good[by]
            h, kind = h.take(good, axis=0), klass[at]
            logit = h @ p["U"]
            logit += p["b"]
            value = self._gained(logit, kind) + share[at]
            value += self._gained(self._members(h, kind), member[at])
            out += np.bincount(doc[a : a + group][good // STEP], weights=value, minlength=len(sizes))
        return out / np.log(10)

    @staticmethod
    def _gained(logit: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Log probability of the chosen column of each row; ``logit`` is overwritten."""
        value = _within(logit, logit[:, 0])[np.arange(len(chosen)), chosen].astype(np.float64)
        return value - np.log(_total(logit))

    def _members(self, h: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """Logits of the members of each row's class; rows are sorted by class."""
        out, cuts = np.empty((len(h), self.members), np.float32), np.searchsorted(klass, np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            np.matmul(h[cuts[c] : cuts[c + 1]], self.p["M"][c], out=out[cuts[c] : cuts[c + 1]])
        out += self.p["c"].take(klass, axis=0)
        return out

    def train(self, streams, rate: float, seen: int = 0, part: tuple[int, int] = (0, 1)) -> int:
        """Adam on the windows of each stream (ids, sizes) of those with a number of ``part[0]`` modulo ``part[1]``; returns how many ids it learnt.

        ``seen`` ids were learnt before; the batch grows with them.
        """
        _keep_memory()
        adam, learnt = Adam(self.p), 0
        for ids, sizes in streams:
            source, target, begin, stop, first, _ = self.windows(ids, sizes)
            order = np.random.default_rng(len(begin)).permutation(np.arange(part[0], len(begin), part[1]))
            a = 0
            while a < len(order):
                b = a + min(LAST_BATCH, FIRST_BATCH + (seen + learnt) // GROW)
                learnt += self._step(adam, order[a:b], source, target, begin, stop, first, rate)
                a = b
        return learnt

    def _step(self, adam: Adam, w, source, target, begin, stop, first, rate: float) -> int:
        p, reach, here, root = self.p, np.arange(-CONTEXT, STEP), np.arange(STEP), np.float32(1 / np.sqrt(WIDTH))
        u = source[np.clip(begin[w][:, None] + reach, 0, len(source) - 1)]
        at = begin[w][:, None] + here
        inside = (at < stop[w][:, None]).ravel()
        good = np.flatnonzero(inside)
        aim = target[at.ravel()[good]]
        by = np.argsort(self.klass[aim].astype(np.int16), kind="stable")
        aim, good = aim[by], good[by]
        y, z, n = self.klass[aim], self.member[aim], np.float32(1 / len(aim))
        # Queries meet keys by one matrix, and values are projected after they are weighed: neither has rows of its own for a window's context.
        fold, bias, alone = (p["q"] @ p["k"].T) * root, self.bias(), first[w]
        x = p["E"].take(u, axis=0)
        # By window, above each other: weights and their gradient; and what each is multiplied by for the gradient of the inputs.
        weights, sides = np.empty((len(w), 2 * STEP, SPAN), np.float32), np.empty((len(w), 2 * STEP, WIDTH), np.float32)
        mixed, h = (np.empty((len(w), STEP, WIDTH), np.float32) for _ in range(2))
        parts = [slice(a, a + PART) for a in range(0, len(w), PART)]
        for part in parts:
            own, att, query = x[part, CONTEXT:], weights[part, :STEP], sides[part, STEP:]
            query[:] = (own.reshape(-1, WIDTH) @ fold).reshape(own.shape)
            np.matmul(query, x[part].transpose(0, 2, 1), out=att)
            att += bias
            att[alone[part], :, :CONTEXT] = -1e9
            _softmax(att, att[:, here, CONTEXT + here])
            np.matmul(att, x[part], out=mixed[part])
            np.add(own, (mixed[part].reshape(-1, WIDTH) @ p["v"]).reshape(own.shape), out=h[part])
        h = h.reshape(-1, WIDTH)
        h = h.take(good, axis=0)
        e = h @ p["U"]
        e += p["b"]
        number = np.arange(len(y))
        _softmax(e, e[:, 0], n)
        e[number, y] -= n
        f = self._members(h, y)
        _softmax(f, f[:, 0], n)
        f[number, z] -= n
        g = {"U": h.T @ e, "b": np.ones(len(e), np.float32) @ e, "M": np.zeros_like(p["M"]), "c": np.zeros_like(p["c"])}
        back = e @ p["U"].T
        cuts = np.searchsorted(y, np.arange(self.classes + 1))
        found = np.flatnonzero(np.diff(cuts))
        g["c"][found] = np.add.reduceat(f, cuts[found])
        for c in found:
            i, j = cuts[c], cuts[c + 1]
            np.matmul(h[i:j].T, f[i:j], out=g["M"][c])
            back[i:j] += f[i:j] @ p["M"][c].T
        dh = np.zeros((len(w) * STEP, WIDTH), np.float32)
        dh[good] = back
        dh = dh.reshape(len(w), STEP, WIDTH)
        dx, far, between, g["v"] = np.empty_like(x), np.zeros((STEP, SPAN), np.float32), np.zeros_like(fold), np.zeros_like(p["v"])
        for part in parts:
            own, att, ds, dmixed = x[part, CONTEXT:].reshape(-1, WIDTH), weights[part, :STEP], weights[part, STEP:], sides[part, :STEP]
            seen = dh[part].reshape(-1, WIDTH)
            g["v"] += mixed[part].reshape(-1, WIDTH).T @ seen
            dmixed[:] = (seen @ p["v"].T).reshape(dmixed.shape)
            np.matmul(dmixed, x[part].transpose(0, 2, 1), out=ds)
            ds -= np.einsum("wij,wij->wi", dmixed, mixed[part])[:, :, None]
            ds *= att
            far += ds.sum(0)
            dq = np.matmul(ds, x[part]).reshape(-1, WIDTH)
            between += own.T @ dq
            np.matmul(weights[part].transpose(0, 2, 1), sides[part], out=dx[part])
            dx[part, CONTEXT:] += (seen + dq @ fold.T).reshape(dmixed.shape)
        g["r"] = np.bincount(self.back.ravel(), weights=np.where(self.ahead, 0, far).ravel(), minlength=SPAN).astype(np.float32)
        between *= root
        g["q"], g["k"] = between @ p["k"], between.T @ p["q"]
        flat = u.ravel()
        touched = np.flatnonzero(np.bincount(flat, minlength=len(p["E"])))
        place = np.empty(len(p["E"]), np.int64)
        place[touched] = np.arange(0, len(touched) * WIDTH, WIDTH)
        cell = (place[flat][:, None] + np.arange(WIDTH)).ravel()
        g["E"] = np.bincount(cell, weights=dx.ravel(), minlength=len(touched) * WIDTH).astype(np.float32).reshape(-1, WIDTH)
        adam.step(g, {"E": touched}, rate)
        return int((aim != self.end).sum())
