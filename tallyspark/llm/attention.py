"""A causal self-attention language model over subword ids, trained and run in numpy.

Ids come from a public vocabulary. One layer of masked attention over a window of two blocks, the later one's own and the one
before, and a small feed-forward part give a distribution over groups of ids and, within the group, over its members. Groups
are neighbours in byte order of about equal weight; the rarer ids of a group are one member, which they divide by their corpus
counts. As windows overlap by a block, each token is scored once, with at least a block of context where the text has one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens in a block, width of the vectors and of the feed-forward part, groups, members of a group, ids that are told apart as context.
BLOCK, WIDTH, HIDDEN, GROUPS, MEMBERS, INPUTS = 16, 16, 16, 32, 64, 4096
#: Blocks in a training step, its rate, and blocks scored at once.
STEP_BLOCKS, RATE, SCORE_BLOCKS = 128, 0.01, 1024
NEVER = np.float32(-1e9)
#: Bytes of an array that is made and dropped before the work (see keep_freed()).
KEPT_BYTES = 31 << 20
#: What exponentials are taken of stays within this, so that their sums neither overflow nor vanish.
LIMIT = np.float32(60)


def keep_freed() -> None:
    """After a large array has been dropped, the C library keeps up to twice its size of what is freed, where it else gives the arrays of each step back to the system and asks for them anew. The array is not touched, so it takes no memory."""
    np.empty(KEPT_BYTES, np.uint8)


@dataclass
class Classes:
    """goal: the group of each id times MEMBERS, and its member; share: the logarithm of its share of the member; context: what it counts as before
    other tokens; groups, members: log shares in all tokens and in the group."""

    goal: np.ndarray
    share: np.ndarray
    context: np.ndarray
    groups: np.ndarray
    members: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, names: list[bytes]) -> Classes:
        """counts: how often each id occurs in the corpus; each gets one more, so none is impossible. names: their bytes."""
        n, weight = len(counts), counts + 1.0
        by_name = np.array(sorted(range(n), key=names.__getitem__), np.int64)
        mass = np.cumsum(weight[by_name])
        group = np.empty(n, np.int64)
        group[by_name] = np.minimum((mass - weight[by_name] / 2) / mass[-1] * GROUPS, GROUPS - 1).astype(np.int64)
        by_count = np.lexsort((np.arange(n), -counts))
        rank = np.empty(n, np.int64)
        rank[by_count] = np.arange(n)
        inside = np.lexsort((rank, group))  # group by group, the frequent first
        first = np.searchsorted(group[inside], np.arange(GROUPS))
        member = np.empty(n, np.int64)
        member[inside] = np.minimum(np.arange(n) - first[group[inside]], MEMBERS - 1)
        goal = group * MEMBERS + member
        sums = np.bincount(goal, weight, GROUPS * MEMBERS).reshape(GROUPS, MEMBERS)
        whole = sums.sum(1)
        context = np.minimum(rank, INPUTS - GROUPS + group)
        log = lambda x: np.log(np.maximum(x, 1e-9)).astype(np.float32)
        return cls(goal.astype(np.int16), log(weight / sums.ravel()[goal]), context.astype(np.int16), log(whole / whole.sum()), log(sums / np.maximum(whole, 1e-9)[:, None]))


def shapes() -> dict[str, tuple[int, ...]]:
    d = WIDTH
    return {"embed": (INPUTS, d), "query": (d, d), "key": (d, d), "value": (d, d), "mix": (d, d), "near": (2 * BLOCK,), "up": (d, HIDDEN), "up_bias": (HIDDEN,), "down": (HIDDEN, d), "out": (d, GROUPS), "bias": (GROUPS,), "inner": (GROUPS, d, MEMBERS), "inner_bias": (GROUPS, MEMBERS)}


#: Distance back from each place of a block to each place of its window; ahead of it where negative.
_BACK = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)
_AHEAD = np.where(_BACK < 0, NEVER, np.float32(0))
_AT = np.maximum(_BACK, 0)


class Model:
    """The weights, as one vector that is cut into named arrays."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.named: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in shapes().items():
            size = int(np.prod(shape))
            self.named[name] = weights[at : at + size].reshape(shape)
            at += size

    @classmethod
    def fresh(cls, classes: Classes, seed: int = 7) -> Model:
        """Random weights, but where the distribution comes out: there they give the corpus shares."""
        rng = np.random.default_rng(seed)
        scales = {"embed": 0.3, "out": 0.03, "inner": 0.03}
        parts = {k: rng.normal(0, scales.get(k, s[0] ** -0.5), s) if len(s) > 1 else np.zeros(s) for k, s in shapes().items()}
        parts["bias"], parts["inner_bias"] = classes.groups, classes.members
        return cls(np.concatenate([x.ravel() for x in parts.values()]).astype(np.float32))

    def step(self, context: np.ndarray, follows: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of some windows and its gradient. context: the ids' contexts, window by window; follows: whether the first block is of the same text; target: goals of the second block's next ids, -1 for none."""
        w, grad = self.named, Model(np.zeros_like(self.weights))
        g, n, d, kind = grad.named, len(context), WIDTH, self.weights.dtype
        flat = lambda m: m.reshape(-1, m.shape[-1])  # noqa: E731  (one product of all rows is faster than one for each window)
        sums = lambda m: np.ones(len(m), kind) @ m  # noqa: E731  (faster than sum())
        scale, ahead = np.float32(d**-0.5), w["near"][_AT] + _AHEAD
        x = w["embed"][context]
        own = flat(np.ascontiguousarray(x[:, BLOCK:]))
        q = (own @ (w["query"] * scale)).reshape(n, BLOCK, d)
        kv = (flat(x) @ np.concatenate([w["key"], w["value"]], 1)).reshape(n, 2 * BLOCK, 2 * d)
        k, v = kv[..., :d], kv[..., d:]
        p = q @ k.transpose(0, 2, 1)
        np.clip(p, -LIMIT, LIMIT, out=p)
        p += ahead
        p[~follows, :, :BLOCK] = NEVER
        np.exp(p, out=p)
        p /= p @ np.ones((2 * BLOCK, 1), kind)
        a = flat(p @ v)
        h = a @ w["mix"]
        h += own
        z = h @ w["up"]
        z += w["up_bias"]
        np.maximum(z, 0, out=z)
        h2 = z @ w["down"]
        h2 += h
        goal = target.ravel()
        asked = np.flatnonzero(goal >= 0)
        asked = asked[np.argsort(goal[asked], kind="stable")]  # by group, so that a group's places lie together
        group, member = np.divmod(goal[asked].astype(np.int64), MEMBERS)
        share, last = np.float32(1 / max(1, len(asked))), h2[asked]
        got, dy = _log_shares(last, w["out"], w["bias"], group, share)
        g["out"][:], g["bias"][:] = last.T @ dy, sums(dy)
        dlast = dy @ w["out"].T
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for one in np.flatnonzero(np.diff(ends)).tolist():
            at = slice(ends[one], ends[one + 1])
            more, dy = _log_shares(last[at], w["inner"][one], w["inner_bias"][one], member[at], share)
            got[at] += more
            g["inner"][one], g["inner_bias"][one] = last[at].T @ dy, sums(dy)
            dlast[at] += dy @ w["inner"][one].T
        loss = -float(got.mean()) if len(asked) else 0.0
        dh = np.zeros_like(h2)
        dh[asked] = dlast
        g["down"][:] = z.T @ dh
        dz = dh @ w["down"].T
        dz *= z > 0
        g["up"][:], g["up_bias"][:] = h.T @ dz, sums(dz)
        dh += dz @ w["up"].T
        g["mix"][:] = a.T @ dh
        da = dh @ w["mix"].T
        ds = da.reshape(n, BLOCK, d) @ v.transpose(0, 2, 1)
        ds -= (da * a).reshape(n, BLOCK, d) @ np.ones((d, 1), kind)
        ds *= p
        g["near"][:] = np.bincount(_AT.ravel(), sums(ds.reshape(n, -1)), 2 * BLOCK)
        dkv = np.empty_like(kv)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :d])
        np.matmul(p.transpose(0, 2, 1), da.reshape(n, BLOCK, d), out=dkv[..., d:])
        dq = flat(ds @ k)
        dq *= scale
        g["query"][:] = own.T @ dq
        both = flat(x).T @ flat(dkv)
        g["key"][:], g["value"][:] = both[:, :d], both[:, d:]
        dx = (flat(dkv) @ np.concatenate([w["key"].T, w["value"].T])).reshape(n, 2 * BLOCK, d)
        dh += dq @ w["query"].T
        dx[:, BLOCK:] += dh.reshape(n, BLOCK, d)
        ids = context.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        g["embed"][ids[first]] = np.add.reduceat(flat(dx)[order], first, axis=0)
        return loss, grad.weights

    def score(self, context: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of the goal target[b, t] after context[b, :t + 1] and the block before it; blocks come in the order of the texts, first: whether one begins a text."""
        keep_freed()
        w, out = self.named, np.empty(target.shape, np.float32)
        near = w["near"][_AT] + _AHEAD
        keys, values = w["embed"] @ w["key"], w["embed"] @ w["value"]
        queries = w["embed"] @ w["query"] * np.float32(WIDTH**-0.5)
        for low in range(0, len(context), SCORE_BLOCKS):
            ids = context[low : low + SCORE_BLOCKS]
            n = len(ids)
            seen = np.concatenate([context[max(low - 1, 0)], ids.ravel()])  # with the block before the first
            s = queries[ids] @ _windows(keys[seen], n).transpose(0, 2, 1)
            np.clip(s, -LIMIT, LIMIT, out=s)
            s += near
            s[first[low : low + n], :, :BLOCK] = NEVER
            np.exp(s, out=s)
            a = s @ _windows(values[seen], n)
            a /= (s @ np.ones((2 * BLOCK, 1), np.float32))  # faster than a sum over a short axis
            h = a.reshape(-1, WIDTH) @ w["mix"]
            h += w["embed"][ids.ravel()]
            z = h @ w["up"]
            z += w["up_bias"]
            np.maximum(z, 0, out=z)
            h += z @ w["down"]
            goal = target[low : low + n].ravel()
            group, member = goal // MEMBERS, goal % MEMBERS
            found = _log_shares(h, w["out"], w["bias"], group)
            for k, at in _by_group(group):
                found[at] += _log_shares(h[at], w["inner"][k], w["inner_bias"][k], member[at])
            out[low : low + n] = found.reshape(n, BLOCK)
        return out

    def train(self, context: np.ndarray, first: np.ndarray, target: np.ndarray, steps: int, rate: float, seed: int, width: int = STEP_BLOCKS) -> float:
        """Steps of Adam, each over `width` blocks, in a random order, again from the beginning when all have been used; mean loss of the last tenth."""
        rng, losses = np.random.default_rng(seed), []
        keep_freed()
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        order = np.zeros(0, np.int64)
        for t in range(1, steps + 1):
            if len(order) < width:
                order = np.concatenate([order, rng.permutation(len(context))])
            at, order = order[:width], order[width:]
            windows = np.concatenate([context[np.maximum(at - 1, 0)], context[at]], 1)
            loss, grad = self.step(windows, ~first[at], target[at])
            losses.append(loss)
            m = 0.9 * m + 0.1 * grad
            v = 0.98 * v + 0.02 * grad * grad
            self.weights -= np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
        return float(np.mean(losses[-max(1, steps // 10) :])) if losses else 0.0


def _windows(rows: np.ndarray, n: int) -> np.ndarray:
    """Each of the last n blocks with the one before it, as a view."""
    step, wide = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (n, 2 * BLOCK, rows.shape[1]), (BLOCK * step, step, wide), writeable=False)


def _by_group(group: np.ndarray):
    """Each group with the places that ask for it."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if len(order) else ()
    for low, high in zip(first, [*first[1:], len(order)]):
        yield int(group[order[low]]), order[low:high]


def _log_shares(h: np.ndarray, out: np.ndarray, bias: np.ndarray, goal: np.ndarray, share: np.float32 | None = None):
    """Log softmax of h @ out + bias at the goals; with share, also the gradient of minus its sum, times share."""
    y = h @ out
    y += bias
    np.clip(y, -LIMIT, LIMIT, out=y)
    rows = np.arange(len(y))
    got = y[rows, goal]
    np.exp(y, out=y)
    total = y @ np.ones(y.shape[1], y.dtype)
    got -= np.log(total)
    if share is None:
        return got
    y *= (share / total)[:, None]
    y[rows, goal] -= share
    return got, y


def blocks(ids: np.ndarray, sizes: np.ndarray, before: int, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of ids, one behind the other, in blocks of their own, so that what a text gets does not depend on those beside it.

    Contexts (blocks x BLOCK; the id `before` stands before a text), whether a block begins a text, goals (0 beyond a
    text's end), and the place of each id among all places of the blocks.
    """
    n_blocks = -(-sizes // BLOCK)
    base = (np.cumsum(n_blocks) - n_blocks) * BLOCK
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) + np.repeat(base - start, sizes)
    total = int(n_blocks.sum()) * BLOCK
    context, goal = np.full(total, classes.context[before], np.int16), np.zeros(total, np.int16)
    context[place[1:]] = classes.context[ids[:-1]]
    context[base] = classes.context[before]
    goal[place] = classes.goal[ids]
    first = np.zeros(total // BLOCK, bool)
    first[base // BLOCK] = True
    return context.reshape(-1, BLOCK), first, goal.reshape(-1, BLOCK), place
