"""A one-layer causal self-attention model over subword ids, in numpy.

The network predicts the next id's class from the attended context and the current id. Classes
group ids of like contexts, so that knowing the context (language, topic) tells much of the class.
Within its class an id has a share by the counts of the current id's successors in the training
corpus, discounted and backed off to its share of the class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

START, END = 1, 2
#: Inputs of a window, and how many of them only give context to the others.
WINDOW, OVERLAP = 32, 8
EMBED, HEAD, CLASSES, INPUTS = 16, 8, 16, 4096
#: Numbers that describe the contexts of an id, and ids of a context.
TRAITS, CONTEXT = 12, 32
#: Taken off each count of a pair for ids that did not follow.
DISCOUNT = 0.75


@dataclass
class Net:
    row: np.ndarray  # id -> row of the input table
    cls: np.ndarray  # id -> class
    share: np.ndarray  # id -> ln P(id | class)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))  # sorted: current id * ids + next id
    pair_ln: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # ln P(next | current, class)
    back: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))  # sorted: current id * CLASSES + class
    back_ln: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # ln of the mass that backs off
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))  # counts of all pairs of a current id and class

    def within(self, current: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ln P(id | current id, class of the id)."""
        out = self.share[ids]
        if len(self.pair):
            key, where = np.unique(current.astype(np.uint32) * np.uint32(len(self.cls)) + ids.astype(np.uint32), return_inverse=True)
            spot = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            found = self.pair[spot] == key
            before, after = key // np.uint32(len(self.cls)), key % np.uint32(len(self.cls))
            back = before * np.uint32(CLASSES) + self.cls[after].astype(np.uint32)
            at = np.minimum(np.searchsorted(self.back, back), len(self.back) - 1)
            off = self.share[after] + np.where(self.back[at] == back, self.back_ln[at], np.float32(0))
            out = np.where(found, self.pair_ln[spot], off)[where]
        return out

    def holds(self, key: np.ndarray) -> np.ndarray:
        if not len(self.pair):
            return np.zeros(len(key), bool)
        return self.pair[np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)] == key

    def rest(self, key: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What within() lacks for pairs that it does not hold, by their counts."""
        current, ids = key // np.uint32(len(self.cls)), key % np.uint32(len(self.cls))
        at = np.minimum(np.searchsorted(self.back, current * np.uint32(CLASSES) + self.cls[ids].astype(np.uint32)), len(self.back) - 1)
        off = self.back_ln[at] + self.share[ids].astype(float)
        return np.where(counts > 0, np.log(np.maximum(counts - DISCOUNT, 0) / self.total[at] + np.exp(off)) - off, 0.0)


def trait_vectors(size: int) -> np.ndarray:
    """A random vector an id; sums of them over a context describe it."""
    return np.random.default_rng(21).standard_normal((size, TRAITS)).astype(np.float32)


def context_sums(vectors: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per id the sum over its places of the mean vector of the CONTEXT ids around it, without itself."""
    per = -(-lengths // CONTEXT)
    begin = np.cumsum(lengths) - lengths
    start = np.repeat(begin, per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * CONTEXT
    size = np.diff(np.append(start, len(ids)))
    # places beyond a context's end take a vector of zeros
    padded = np.append(ids, np.zeros(CONTEXT, ids.dtype)).astype(np.intp)
    at = np.where(np.arange(CONTEXT) < size[:, None], np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[start], len(vectors))
    own = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    mean = np.empty((vectors.shape[1], len(start)))
    for i in range(0, len(start), 1024):
        mean[:, i : i + 1024] = (np.ones((1, CONTEXT), vectors.dtype) @ np.take(own, at[i : i + 1024], axis=0))[:, 0].T
    mean /= size
    out = np.column_stack([np.bincount(ids, weights=np.repeat(m, size), minlength=len(vectors)) for m in mean])
    return out - np.bincount(ids, weights=np.repeat(1 / size, size), minlength=len(vectors))[:, None] * vectors


def _by_mass(counts: np.ndarray) -> np.ndarray:
    """Classes of like mass, from the most frequent ids down."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    mass = np.cumsum(counts[order] + 1e-3)
    cls = np.empty(len(counts), np.int64)
    cls[order] = np.minimum((mass - 1e-9) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
    return cls


def context_classes(counts: np.ndarray, sums: np.ndarray, seed: int = 3, rounds: int = 25) -> np.ndarray:
    """Classes of ids by their mean contexts: k-means, weighted by the roots of counts."""
    known = np.flatnonzero(counts > 0)
    if len(known) < 2 * CLASSES:
        return _by_mass(counts)
    x = sums / np.maximum(counts, 1)[:, None]
    x -= (x * counts[:, None]).sum(axis=0) / counts.sum()
    x *= (counts / (counts + 20))[:, None]  # little is known of rare ids
    weight = np.sqrt(counts) + 1e-6
    often = known[np.lexsort((known, -counts[known]))][: max(2 * CLASSES, len(known) // 4)]
    centre = x[np.random.default_rng(seed).choice(often, CLASSES, replace=False, p=weight[often] / weight[often].sum())]
    for _ in range(rounds):
        cls = ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
        for k in range(CLASSES):
            mine = cls == k
            if mine.any():
                centre[k] = np.average(x[mine], axis=0, weights=weight[mine])
    return cls


def make_net(counts: np.ndarray, sums: np.ndarray | None = None, pairs: np.ndarray | None = None, pair_counts: np.ndarray | None = None, seed: int = 11) -> Net:
    """Classes and shares from counts over all training documents, and small random weights.

    sums: context_sums of each id; pairs: sorted keys current id * ids + next id, with their counts.
    """
    order = np.lexsort((np.arange(len(counts)), -counts))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    cls = _by_mass(counts) if sums is None else context_classes(counts, sums)
    smooth = counts + 0.5
    mass = np.bincount(cls, weights=smooth, minlength=CLASSES)
    share = np.log(smooth / mass[cls])
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    p = {"E": r(INPUTS + 1, EMBED), "P": r(WINDOW, EMBED), "Q": r(EMBED, HEAD), "K": r(EMBED, HEAD), "V": r(EMBED, HEAD), "A": r(HEAD, CLASSES), "B": r(EMBED, CLASSES)}
    p["c"] = np.log(np.maximum(mass, 1e-3) / smooth.sum()).astype(np.float32)
    net = Net(np.minimum(rank, INPUTS).astype(np.int32), cls.astype(np.int32), share.astype(np.float32), p)
    if pairs is not None and len(pairs):
        hold(net, pairs, pair_counts, *back_totals(net.cls, pairs, pair_counts))
    return net


def back_totals(cls: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(current id * CLASSES + class, ascending; counts of its pairs; how many they are)."""
    current, following = pairs // np.uint32(len(cls)), pairs % np.uint32(len(cls))
    back, at = np.unique(current.astype(np.uint32) * np.uint32(CLASSES) + cls[following].astype(np.uint32), return_inverse=True)
    return back, np.bincount(at, weights=pair_counts, minlength=len(back)), np.bincount(at, minlength=len(back))


def hold(net: Net, pairs: np.ndarray, pair_counts: np.ndarray, back: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
    """Gives net the pairs that it holds and the back_totals of all pairs."""
    current, following = pairs // np.uint32(len(net.cls)), pairs % np.uint32(len(net.cls))
    at = np.searchsorted(back, current.astype(np.uint32) * np.uint32(CLASSES) + net.cls[following].astype(np.uint32))
    off = DISCOUNT * kinds / total
    net.back, net.back_ln, net.total = back, np.log(off).astype(np.float32), total
    net.pair, net.pair_ln = pairs.astype(np.uint32), np.log((pair_counts - DISCOUNT) / total[at] + off[at] * np.exp(net.share[following].astype(float))).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one behind another: (flat index of each window's first input, its text's first index, its text's end)."""
    step = WINDOW - OVERLAP
    per = -(-lengths // step)
    begin = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return begin[doc] + nth * step - OVERLAP, begin[doc], begin[doc] + lengths[doc]


#: Causal mask from the scored inputs (the last WINDOW - OVERLAP) to all inputs.
_MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(OVERLAP, WINDOW)[:, None], 0, -1e9).astype(np.float32)


_ALLOWED = np.exp(_MASK)


def _views(values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Rows of width values from each place of at, which may lie up to OVERLAP before the first and WINDOW behind the last."""
    padded = np.concatenate([np.zeros(OVERLAP, values.dtype), values, np.zeros(WINDOW, values.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[at + OVERLAP]


def _attend(s: np.ndarray, opening: np.ndarray) -> None:
    """Scores to weights, not yet divided by their sums; opening: windows that open a text, where the overlap is absent."""
    if max(s.max(), -s.min()) >= 80:
        s += _MASK
        s[opening, :, :OVERLAP] = -1e9
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s *= _ALLOWED
    s[opening, :, :OVERLAP] = 0


def _by_sum(s: np.ndarray) -> np.ndarray:
    """One over the sums of weights, for each entry of a head."""
    return np.repeat(1 / (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)), HEAD).reshape(*s.shape[:2], HEAD)


def _level(logits: np.ndarray) -> None:
    """Logits that exp() can take."""
    if max(logits.max(), -logits.min()) >= 80:
        logits -= logits.max(axis=-1, keepdims=True)


#: Columns of the projections of an input.
_K, _V, _Q = slice(0, HEAD), slice(HEAD, 2 * HEAD), slice(2 * HEAD, 3 * HEAD)


def _projections(p: dict[str, np.ndarray]) -> np.ndarray:
    """EMBED x 3 HEAD: embeddings to their keys, values and queries."""
    return np.hstack([p["K"], p["V"], p["Q"] * np.float32(1 / np.sqrt(HEAD))])


def score(net: Net, ids: np.ndarray, lengths: np.ndarray, block: int = 64) -> np.ndarray:
    """ln P of each text; ids: all texts one behind another, each with its end. Each id is scored in one window."""
    if not len(ids):
        return np.zeros(len(lengths))
    at, begin, end = windows(lengths)
    current = np.empty(len(ids), np.int64)
    current[1:] = ids[:-1]
    current[begin] = START
    p, step = net.p, WINDOW - OVERLAP
    # projections of ids and of places add up, so they are looked up; so are the logits of the current id
    w = _projections(p)
    table, places = p["E"] @ w, p["P"] @ w
    own = p["E"] @ p["B"] + p["c"]
    rows_all = _views(net.row[current].astype(np.intp), at, WINDOW)
    target = _views(net.cls[ids], at + OVERLAP, step)
    spot = np.arange(block * step) * CLASSES
    ln = np.empty(len(at) * step, np.float32)
    x, kt = np.empty((block, WINDOW, table.shape[1]), np.float32), np.empty((block, HEAD, WINDOW), np.float32)
    s = np.empty((block, step, WINDOW), np.float32)
    u, logits, more = np.empty((block, step, HEAD), np.float32), np.empty((block, step, CLASSES), np.float32), np.empty((block * step, CLASSES), np.float32)
    ones = np.ones(CLASSES, np.float32)
    for i in range(0, len(at), block):
        rows = rows_all[i : i + block]
        if len(rows) < block:
            x, kt, s, u, logits, more = x[: len(rows)], kt[: len(rows)], s[: len(rows)], u[: len(rows)], logits[: len(rows)], more[: len(rows) * step]
        np.take(table, rows, axis=0, out=x, mode="clip")
        x += places
        kt[:] = x[:, :, _K].transpose(0, 2, 1)
        np.matmul(x[:, OVERLAP:, _Q], kt, out=s)
        _attend(s, np.flatnonzero(at[i : i + block] < begin[i : i + block]))
        np.matmul(s, x[:, :, _V], out=u)
        u *= _by_sum(s)
        np.take(own, rows[:, OVERLAP:], axis=0, out=logits, mode="clip")
        flat = logits.reshape(-1, CLASSES)
        flat += np.matmul(u.reshape(-1, HEAD), p["A"], out=more)
        _level(flat)
        hit = flat.ravel()[spot[: len(flat)] + target[i : i + block].ravel()]
        np.exp(flat, out=flat)
        ln[i * step : i * step + len(flat)] = hit - np.log(flat @ ones)
    live = (at + OVERLAP)[:, None] + np.arange(step) < end[:, None]
    total = ln[live.ravel()] + net.within(current, ids)
    return np.add.reduceat(total.astype(np.float64), np.cumsum(lengths) - lengths)


def train(net: Net, ids: np.ndarray, lengths: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.01, seed: int = 12) -> list[float]:
    """Adam on random windows of the sample; returns the losses (nats an id, of classes)."""
    if not len(ids):
        return []
    at, begin, end = windows(lengths)
    inputs = np.empty(len(ids), np.int64)
    inputs[1:] = net.row[ids[:-1]]
    inputs[begin] = net.row[START]
    target = net.cls[ids]
    rng, p, losses = np.random.default_rng(seed), net.p, []
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    scale = np.float32(1 / np.sqrt(HEAD))
    for step in range(1, steps + 1):
        w = rng.integers(0, len(at), batch)
        flat = at[w, None] + np.arange(WINDOW)
        absent = flat < begin[w, None]
        rows = inputs[np.clip(flat, 0, len(ids) - 1)]
        embedded = p["E"][rows]
        x, es = embedded + p["P"], embedded[:, OVERLAP:]
        xs = x[:, OVERLAP:]
        q, k, val = xs @ p["Q"], x @ p["K"], x @ p["V"]
        s = q @ k.transpose(0, 2, 1) * scale + _MASK + np.where(absent, np.float32(-1e9), np.float32(0))[:, None, :]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        o = s @ val
        logits = o @ p["A"] + es @ p["B"] + p["c"]
        live = flat[:, OVERLAP:] < end[w, None]
        y = target[np.clip(flat[:, OVERLAP:], 0, len(ids) - 1)]
        prob = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob /= prob.sum(axis=2, keepdims=True)
        n = max(1, live.sum())
        hit = np.take_along_axis(prob, y[:, :, None], 2)[:, :, 0]
        losses.append(float(-np.log(hit[live] + 1e-12).sum() / n))
        d = prob
        np.put_along_axis(d, y[:, :, None], hit[:, :, None] - 1, 2)
        d *= (live / np.float32(n))[:, :, None].astype(np.float32)
        flat2 = lambda z: z.reshape(-1, z.shape[-1])
        g = {"A": flat2(o).T @ flat2(d), "B": flat2(es).T @ flat2(d), "c": flat2(d).sum(axis=0)}
        do = d @ p["A"].T
        dval = s.transpose(0, 2, 1) @ do
        ds = do @ val.transpose(0, 2, 1)
        ds = s * (ds - (ds * s).sum(axis=2, keepdims=True)) * scale
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        g |= {"Q": flat2(xs).T @ flat2(dq), "K": flat2(x).T @ flat2(dk), "V": flat2(x).T @ flat2(dval)}
        dx = dk @ p["K"].T + dval @ p["V"].T
        dx[:, OVERLAP:] += dq @ p["Q"].T
        g["P"] = dx.sum(axis=0)
        dx[:, OVERLAP:] += d @ p["B"].T  # the current id without its place
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], rows, dx)
        lr = rate * min(1, step / 20) * (1 - 0.9 * step / steps)
        for name in p:
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
            p[name] = (p[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return losses


class Local:
    """Adam over all windows of the texts that are added, each seen once; weights start at net's."""

    BATCH, BLOCK, RATE = 256, 128, 0.01

    def __init__(self, net: Net, seed: int) -> None:
        self.net, self.rng, self.step, self.windows, self.loss, self.ids = net, np.random.default_rng(seed), 0, 0, 0.0, 0
        self.p = {k: x.copy() for k, x in net.p.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        b, step = self.BLOCK, WINDOW - OVERLAP
        shapes = {"x": (WINDOW, EMBED), "y": (WINDOW, 3 * HEAD), "kt": (HEAD, WINDOW), "vt": (HEAD + 1, WINDOW), "s": (step, WINDOW), "ds": (step, WINDOW), "u": (step, HEAD), "own": (step, CLASSES), "d": (step, CLASSES), "da": (step, HEAD), "do": (step, HEAD + 1), "g": (WINDOW, 3 * HEAD + CLASSES)}
        self.room = {k: np.zeros((b, *x), np.float32) for k, x in shapes.items()}
        self.room["vt"][:, HEAD] = 1
        self.dx = np.empty((EMBED, (self.BATCH + b) * WINDOW))
        self._look_up()
        self._clear()

    def _look_up(self) -> None:
        """What blocks look up between two steps."""
        self.w, self.own = _projections(self.p), self.p["E"] @ self.p["B"] + self.p["c"]

    def _clear(self) -> None:
        self.g: dict[str, np.ndarray] = {}
        self.rows, self.live, self.held = [], 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """ids: all texts one behind another, each with its end."""
        if not len(ids):
            return
        at, begin, end = windows(lengths)
        step = WINDOW - OVERLAP
        order = self.rng.permutation(len(at))
        at, begin, end = at[order], begin[order], end[order]
        inputs = np.empty(len(ids), np.intp)
        inputs[1:] = self.net.row[ids[:-1]]
        inputs[begin] = self.net.row[START]
        rows, target = _views(inputs, at, WINDOW), _views(self.net.cls[ids], at + OVERLAP, step)
        live = (at + OVERLAP)[:, None] + np.arange(step) < end[:, None]
        for i in range(0, len(at), self.BLOCK):
            part = slice(i, i + self.BLOCK)
            self._block(rows[part], np.flatnonzero(at[part] < begin[part]), target[part].ravel(), live[part].ravel().astype(np.float32))
            if self.held >= self.BATCH:
                self.update()

    def _block(self, rows: np.ndarray, opening: np.ndarray, y: np.ndarray, live: np.ndarray) -> None:
        """Adds the gradient sums of a block of windows."""
        p, n = self.p, len(rows)
        r = self.room if n == self.BLOCK else {k: x[:n] for k, x in self.room.items()}
        x, z, s, u, d, da, do, ds, g = (r[k] for k in ("x", "y", "s", "u", "d", "da", "do", "ds", "g"))
        u2, d2, da2, g2 = (a.reshape(-1, a.shape[2]) for a in (u, d, da, g))
        np.take(p["E"], rows, axis=0, out=x, mode="clip")
        x += p["P"]
        np.matmul(x.reshape(-1, EMBED), self.w, out=z.reshape(-1, 3 * HEAD))
        k, q = z[:, :, _K], z[:, OVERLAP:, _Q]
        r["kt"][:], r["vt"][:, :HEAD] = k.transpose(0, 2, 1), z[:, :, _V].transpose(0, 2, 1)
        np.matmul(q, r["kt"], out=s)
        _attend(s, opening)
        # weights s are not divided by their sums, so what meets them is
        by_sum = _by_sum(s)
        np.matmul(s, z[:, :, _V], out=u)
        u *= by_sum
        np.matmul(u2, p["A"], out=d2)
        d += np.take(self.own, rows[:, OVERLAP:], axis=0, out=r["own"], mode="clip")
        _level(d2)
        np.exp(d2, out=d2)
        d2 *= np.repeat(live / (d2 @ np.ones(CLASSES, np.float32)), CLASSES).reshape(d2.shape)
        spot = np.arange(len(y)) * CLASSES + y
        flat = d2.reshape(-1)
        self.loss -= float(np.log(flat[spot][live > 0] + 1e-12).sum())
        flat[spot] -= live
        np.matmul(d2, p["A"].T.copy(), out=da2)
        da *= by_sum
        do[:, :, :HEAD] = da
        np.multiply(da2, -u2, out=da2)
        do[:, :, HEAD] = (da2 @ np.ones(HEAD, np.float32)).reshape(n, -1)
        np.matmul(do, r["vt"], out=ds)
        ds *= s
        np.matmul(ds.transpose(0, 2, 1), q, out=g[:, :, :HEAD])
        np.matmul(s.transpose(0, 2, 1), do[:, :, :HEAD], out=g[:, :, HEAD : 2 * HEAD])
        np.matmul(ds, k, out=g[:, OVERLAP:, 2 * HEAD : 3 * HEAD])
        g[:, OVERLAP:, 3 * HEAD :] = d
        scale = np.float32(1 / np.sqrt(HEAD))
        back = np.hstack([p["K"], p["V"], p["Q"] * scale, p["B"]])
        gw, by_place = np.matmul(x.transpose(0, 2, 1), g).sum(axis=0), (np.ones(n, np.float32) @ g.reshape(n, -1)).reshape(WINDOW, -1)
        found = {"A": u2.T @ d2, "c": by_place[:, 3 * HEAD :].sum(axis=0), "K": gw[:, _K], "V": gw[:, _V], "Q": gw[:, _Q] * scale, "P": by_place[:, : 3 * HEAD] @ back[:, : 3 * HEAD].T}
        found["B"] = gw[:, 3 * HEAD :] - p["P"].T @ by_place[:, 3 * HEAD :]  # the current id without its place
        self.g = {name: self.g[name] + z if self.g else z for name, z in found.items()}
        self.rows.append(rows.ravel())
        self.dx[:, self.held * WINDOW : (self.held + n) * WINDOW] = (g2 @ back.T).T
        n_live = int(live.sum())
        self.live, self.held, self.windows, self.ids = self.live + n_live, self.held + n, self.windows + n, self.ids + n_live

    def update(self) -> None:
        """A step by the sums held; fewer windows than a batch make a smaller step."""
        if not self.held:
            return
        rows = np.concatenate(self.rows)
        self.g["E"] = np.empty_like(self.p["E"])
        for k, x in enumerate(self.dx):
            self.g["E"][:, k] = np.bincount(rows, weights=x[: len(rows)], minlength=len(self.p["E"]))
        self.step += 1
        rate = self.RATE * min(1, self.step / 20) * min(1, self.held / self.BATCH)
        for name, x in self.p.items():
            g = self.g[name] * np.float32(1 / max(1, self.live))
            m, v = self.m[name], self.v[name]
            m += np.float32(0.1) * (g - m)
            g *= g
            g -= v
            g *= np.float32(0.01)
            v += g
            np.multiply(v, np.float32(1 / (1 - 0.99**self.step)), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= np.float32(rate / (1 - 0.9**self.step))
            x -= g
        self._look_up()
        self._clear()
