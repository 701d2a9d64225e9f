"""A small causal self-attention language model in numpy, and scoring with overlapping windows.

Subword ids are predicted in two steps, both softmaxes of ``SIDE`` ways: the id's group, then its place in the group.
Groups hold the commonest ids in order; the last group holds all other ids, which share its probability by their
corpus counts. One masked attention layer with relative-position biases and one feed-forward layer turn a window's
embeddings into states. All windows of a batch run through the same matrix products.

A text is cut into windows of ``WIDTH`` inputs that start every ``STRIDE``; each prediction is scored once, in the
window where it has most context (the first window scores all of its own, later ones their last ``STRIDE``). Training
learns every prediction once too, in windows that follow each other without overlap.

Row sums are matrix products with ones, and logits are shifted by their maximum only where a row's sum leaves float32
(in training, in the step that has such a row): numpy's reductions over short rows cost more than the products.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import as_strided

WIDTH, STRIDE = 32, 24
HEAD = WIDTH - STRIDE
SIDE, DIM, HIDDEN = 64, 16, 32
COMMON = SIDE * (SIDE - 1)
#: Input rows: the common ids, and ``SIDE`` rows that all other ids share.
ROWS = COMMON + SIDE
SPECS = {"E": (ROWS, DIM), "QKV": (DIM, 3 * DIM), "R": (WIDTH,), "O": (DIM, DIM), "W1": (DIM, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, DIM), "U": (DIM, SIDE), "c": (SIDE,), "T": (SIDE - 1, DIM, SIDE), "t": (SIDE - 1, SIDE)}
#: Rows and windows that are worked on together, so that what they need stays in cache.
PIECE, NEAR = 1024, 64
_AT = np.arange(PIECE)
#: Largest attention logit; exp of it times WIDTH stays far inside float32.
TOP = 60
#: Steps after which the rate falls with the root of their number, and how far the loss may rise in a task's training.
STEADY, WORSE = 16, 1.1
_BACK = np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :]
_MASK = np.where(_BACK >= 0, 0, -1e9).astype(np.float32)


class Vocabulary:
    """How ids are grouped, from their counts over the training texts."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.row = np.empty(len(counts), np.int32)
        self.row[order[:COMMON]] = np.arange(min(COMMON, len(order)))
        rest = order[COMMON:]
        self.row[rest] = COMMON + rest % SIDE
        self.group = np.full(len(counts), SIDE - 1, np.int32)
        self.place = np.zeros(len(counts), np.int32)
        common = order[:COMMON]
        self.group[common], self.place[common] = np.arange(len(common)) // SIDE, np.arange(len(common)) % SIDE
        share = counts[rest] + 0.5
        self.rest_log = np.zeros(len(counts), np.float32)
        self.rest_log[rest] = np.log(share / share.sum()) if len(rest) else 0
        mass = np.zeros((SIDE, SIDE))
        np.add.at(mass, (self.group[common], self.place[common]), counts[common] + 0.5)
        total = mass.sum(1)
        total[SIDE - 1] = share.sum() if len(rest) else 0.5
        #: log shares of the ids by themselves, the end (the last id) apart
        self.alone = np.log((counts[:-1] + 0.5) / (counts[:-1] + 0.5).sum())
        self.c = np.log(total / total.sum())
        self.t = np.log(np.maximum(mass[:-1], 1e-9) / mass[:-1].sum(1, keepdims=True))


def start(vocabulary: Vocabulary, first: np.ndarray | None = None, last: np.ndarray | None = None, pairs: np.ndarray | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that begin as the unigram model, or as a low-rank model of neighbouring ids if those are counted."""
    r = np.random.default_rng(seed)
    p = {k: (r.normal(0, 0.3 if k == "E" else 0.5 / np.sqrt(DIM), s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in SPECS.items()}
    for k in ("U", "T", "O", "W2"):
        p[k] *= 0.1
    p["c"], p["t"] = vocabulary.c.astype(np.float32), vocabulary.t.astype(np.float32)
    if pairs is not None and len(pairs):
        _neighbours(p, vocabulary, first, last, pairs)
    return p


def _neighbours(p: dict[str, np.ndarray], v: Vocabulary, first: np.ndarray, last: np.ndarray, pairs: np.ndarray) -> None:
    """Set E, U and T so that E[a] . T[b] is near the pointwise information of a before b, weighted by frequency.

    Words follow each other independently here: after a word's last id come the ids that begin words by their share.
    """
    common = v.row < COMMON
    a, b, n = pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(np.float32)
    keep = common[b]
    m = np.zeros((ROWS, COMMON), np.float32)
    np.add.at(m, (v.row[a[keep]], v.row[b[keep]]), n[keep])
    begin = np.zeros(COMMON, np.float32)
    begin[v.row[common]] = first[common]
    begin /= max(1.0, begin.sum())
    end = np.bincount(v.row, weights=last, minlength=ROWS).astype(np.float32)
    m += end[:, None] * begin[None, :]
    fa, fb = m.sum(1), m.sum(0)
    total = max(1.0, float(fa.sum()))
    fa, fb = fa / total, fb / total
    m /= total
    m += 1e-3 * fa[:, None] * fb[None, :] + 1e-12
    m /= (fa + 1e-9)[:, None] * (fb + 1e-9)[None, :]
    np.log(m, out=m)
    np.clip(m, -7, 7, out=m)
    wa, wb = np.sqrt(fa + 1e-9), np.sqrt(fb + 1e-9)
    m *= wa[:, None]
    m *= wb[None, :]
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(COMMON, DIM + 8)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(m.T @ (m @ q))[0]
    u, s, w = np.linalg.svd(m @ q, full_matrices=False)
    u, s, w = u[:, :DIM], np.sqrt(s[:DIM]), (w @ q.T)[:DIM]
    e, t = u * s / wa[:, None], (w.T * s) / wb[:, None]
    e[fa < 1e-8], t[fb < 1e-8] = 0, 0
    size = np.sqrt((e * e * fa[:, None]).sum(0) / fa.sum()) + 1e-6  # inputs of like size
    p["E"][:], t = np.clip(e / size, -6, 6), t * size
    t = t.reshape(SIDE - 1, SIDE, DIM).astype(np.float32)
    p["T"][:] = t.transpose(0, 2, 1)
    share = fb.reshape(SIDE - 1, SIDE)
    p["U"][:, :-1] = ((t * share[:, :, None]).sum(1) / (share.sum(1)[:, None] + 1e-12)).T
    p["U"][:, -1] = 0


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SPECS])


def unflatten(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SPECS.items():
        n = int(np.prod(s))
        out[k], at = x[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def cut(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(start in the concatenation, text number) of every window over texts of these many inputs."""
    n = np.maximum(1, -(-(lengths - WIDTH) // stride) + 1)
    text = np.repeat(np.arange(len(lengths)), n)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    k = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return first[text] + k * stride, text


def batch(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray, text: np.ndarray, first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(indices of inputs (windows, WIDTH), which of them are scored). ids: inputs, end-marked; ends: exclusive."""
    at = starts[:, None] + np.arange(WIDTH)[None, :]
    scored = at < ends[text][:, None]
    scored[first[text] != starts, : WIDTH - stride] = False
    return np.minimum(at, len(ids) - 1), scored


class Room:
    """Arrays to work in, kept between calls: memory that is given back and taken anew costs more than the sums."""

    def __init__(self, kind):
        self.kind, self.held = kind, {}

    def __call__(self, name, *shape: int) -> np.ndarray:
        size, held = math.prod(shape), self.held.get(name)
        if held is None or len(held) < size:
            held = self.held[name] = np.empty(size, self.kind)
        return held[:size].reshape(shape)


def _biases(p: dict[str, np.ndarray]) -> np.ndarray:
    """(WIDTH, WIDTH): what is added to the attention logits, by distance; far below all others ahead of a place."""
    return p["R"][np.maximum(_BACK, 0)] + _MASK.astype(p["R"].dtype)


def _one(z: np.ndarray) -> np.ndarray:
    """z with a column of ones, so that products add a bias or a row's sum too."""
    out = np.empty((len(z), z.shape[1] + 1), z.dtype)
    out[:, :-1], out[:, -1] = z, 1
    return out


def _feed(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the feed-forward layer: biases under the first, a column of zeros beside the second."""
    return np.vstack([p["W1"], p["b1"]]), np.pad(p["W2"], ((0, 0), (0, 1)))


def _limit(a: np.ndarray) -> None:
    if not a.max() <= TOP:
        np.minimum(a, TOP, out=a)


def states(p: dict[str, np.ndarray], rows: np.ndarray, fixed: tuple, room: Room, n: int, z: np.ndarray) -> tuple:
    """States after attention and feed-forward, ones last, into z (windows * WIDTH, DIM + 1); returns what the backward
    pass needs, which is kept as the room's piece n. fixed: biases, QKV with the scale in Q, weights of the feed-forward
    layer, zeros."""
    biases, w, (w1, w2), none = fixed
    x = p["E"].take(rows.ravel(), axis=0, out=room((n, "x"), rows.size, DIM), mode="clip")
    # q, k and v; one more column of ones gives each row's sum along with the mix
    qkv = room((n, "qkv"), rows.size, 3 * DIM + 1)
    np.matmul(x, w, out=qkv[:, :-1])
    qkv[:, -1] = 1
    q, k, v = _thirds(qkv.reshape(*rows.shape, -1))
    a = np.matmul(q, k.transpose(0, 2, 1), out=room((n, "a"), *rows.shape, WIDTH))
    a += biases
    _limit(a)
    np.exp(a, out=a)
    sums = np.matmul(a, v, out=room("sums", *rows.shape, DIM + 1)).reshape(-1, DIM + 1)
    share = 1 / (sums[:, DIM:] + x.dtype.type(1e-20))
    mixed = np.multiply(sums[:, :DIM], share, out=room((n, "mixed"), rows.size, DIM))
    h = room((n, "h"), rows.size, DIM + 1)
    top = np.matmul(mixed, p["O"], out=room("top", rows.size, DIM))
    top += x
    h[:, :DIM], h[:, DIM] = top, 1
    g = np.matmul(h, w1, out=room((n, "g"), rows.size, HIDDEN))
    np.maximum(g, none[: len(g)], out=g)  # numpy takes three times as long against a number
    np.matmul(g, w2, out=z)
    z += h
    return x, qkv, a, share, mixed, h, g


def _thirds(qkv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return qkv[:, :, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]


def _exp(z: np.ndarray, w: np.ndarray, at: np.ndarray, e: np.ndarray, shift: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits z w into e; (its row sums, the logits at the places ``at`` of e). The last of z's columns are
    ones, of w's rows the biases. Where a sum leaves float32 it has to be done again with each row shifted."""
    np.matmul(z, w, out=e)
    if shift:
        e -= e.max(axis=1, keepdims=True)
    own = e.reshape(-1).take(at)
    np.exp(e, out=e)
    return e @ np.ones(e.shape[1], e.dtype), own


def _unusual(total: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~((total > 1e-30) & (total < np.inf)))


def _chosen(z: np.ndarray, w: np.ndarray, c: np.ndarray, which: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """log softmax(z w + c) at ``which``, in pieces that stay in cache. z may end in a column of ones; room: (PIECE,
    len(c)) to work in. Only rows whose sum leaves float32 have their logits shifted."""
    z, w = z if z.shape[1] > len(w) else _one(z), np.vstack([w, c])
    total, own = np.empty(len(z), z.dtype), np.empty(len(z), z.dtype)
    room = np.empty((min(PIECE, len(z)), len(c)), z.dtype) if room is None else room
    with np.errstate(over="ignore"):
        for lo in range(0, len(z), PIECE):
            s = slice(lo, min(lo + PIECE, len(z)))
            total[s], own[s] = _exp(z[s], w, which[s] + _AT[: s.stop - lo] * len(c), room[: s.stop - lo])
    for far in np.array_split(_unusual(total), range(PIECE, len(z), PIECE)):
        if len(far):
            total[far], own[far] = _exp(z[far], w, which[far] + _AT[: len(far)] * len(c), room[: len(far)], shift=True)
    return own - np.log(total)


def log_probabilities(p: dict[str, np.ndarray], v: Vocabulary, z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of each target's probability given its state (n, DIM), which a one may follow."""
    group, place = v.group[target], v.place[target]
    z = z if z.shape[1] > DIM else _one(z)
    room = np.empty((PIECE, SIDE), z.dtype)
    out = _chosen(z, p["U"], p["c"], group, room) + v.rest_log[target]
    order = np.argsort(group.astype(np.int16), kind="stable")
    edges = np.searchsorted(group[order], np.arange(SIDE)).tolist()
    zs, place = z.take(order[: edges[-1]], axis=0), place[order[: edges[-1]]]
    inner = [_chosen(zs[lo:hi], p["T"][g], p["t"][g], place[lo:hi], room) for g, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if lo < hi]
    if inner:
        out[order[: edges[-1]]] += np.concatenate(inner)
    return out


def _heads(p: dict[str, np.ndarray], z: np.ndarray, group: np.ndarray, place: np.ndarray, room: Room, shift: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(gradients of U, c, T and t, of the states, the summed loss) of the mean loss. z ends in ones and is in order of
    group. Done again with shifted logits if a row's sum leaves float32."""
    u, t = np.vstack([p["U"], p["c"]]), np.concatenate([p["T"], p["t"][:, None]], 1)
    du, dt = np.zeros_like(u), np.zeros_like(t)
    dz, total, own = room("dz", len(z), DIM), np.empty((2, len(z)), z.dtype), np.zeros((2, len(z)), z.dtype)
    total[1] = 1  # ids of the last group have one step
    logits, kind = room("logits", PIECE, SIDE), z.dtype.type(max(1, len(z)))
    edges = np.searchsorted(group, np.arange(SIDE)).tolist()
    steps = _AT * SIDE
    parts = [(0, u, du, p["U"].T, group, 0, len(z))]
    parts += [(1, t[j], dt[j], p["T"][j].T, place, edges[j], edges[j + 1]) for j in range(SIDE - 1) if edges[j] < edges[j + 1]]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for k, w, dw, back, which, first, last in parts:
            for lo in range(first, last, PIECE):
                s = slice(lo, min(lo + PIECE, last))
                e, at, some = logits[: s.stop - lo], which[s] + steps[: s.stop - lo], z[s]
                sums, own[k, s] = _exp(some, w, at, e, shift)
                total[k, s] = sums
                # errors times the sums; the rows are scaled where they are narrow
                e.reshape(-1)[at] -= sums
                scale = (1 / (sums * kind))[:, None]
                dw += (e.T @ (some * scale)).T
                if k:
                    dz[s] += (e @ back) * scale
                else:
                    np.multiply(e @ back, scale, out=dz[s])
    if not shift and len(_unusual(total.ravel())):
        return _heads(p, z, group, place, room, shift=True)
    grad = {"U": du[:DIM], "c": du[DIM], "T": dt[:, :DIM], "t": dt[:, DIM]}
    return grad, dz, float(np.log(total).sum(dtype=np.float64) - own.sum(dtype=np.float64))


def gradients(p: dict[str, np.ndarray], v: Vocabulary, rows: np.ndarray, target: np.ndarray, scored: np.ndarray, room: Room | None = None) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the mean loss over the scored places, and that loss."""
    room = room or Room(p["E"].dtype)
    w = p["QKV"].copy()
    w[:, :DIM] *= w.dtype.type(DIM**-0.5)
    fixed = (_biases(p), w, _feed(p), np.zeros((NEAR * WIDTH, HIDDEN), w.dtype))
    z = room("z", rows.size, DIM + 1)
    pieces = [states(p, rows[lo : lo + NEAR], fixed, room, lo, z[lo * WIDTH : (lo + NEAR) * WIDTH]) for lo in range(0, len(rows), NEAR)]
    places = np.flatnonzero(scored.ravel())
    y = target.ravel()[places]
    group = v.group[y]
    # in order of group, so that each group's states are one piece
    order = np.argsort(group.astype(np.int16), kind="stable")
    places, y, group = places[order], y[order], group[order]
    grad = {k: np.zeros_like(x) for k, x in p.items() if k not in "UcTt"}
    more, dz, loss = _heads(p, z.take(places, axis=0, out=room("chosen", len(places), DIM + 1), mode="clip"), group, v.place[y], room)
    full, dx = room("full", rows.size, DIM), room("dx", rows.size, DIM)
    full[:] = 0
    full[places] = dz
    for n, kept in enumerate(pieces):
        s = slice(n * NEAR * WIDTH, min((n + 1) * NEAR * WIDTH, rows.size))
        _back(p, w, full[s], kept, grad, room, dx[s])
    grad["QKV"][:, :DIM] *= w.dtype.type(DIM**-0.5)
    # sums per input row, number by number
    at = (rows.ravel() * np.intp(DIM))[:, None] + np.arange(DIM)
    grad["E"] = np.bincount(at.ravel(), weights=dx.ravel(), minlength=ROWS * DIM).reshape(ROWS, DIM).astype(z.dtype)
    return grad | more, loss / max(1, len(y))


def _back(p: dict[str, np.ndarray], w: np.ndarray, full: np.ndarray, kept: tuple, grad: dict[str, np.ndarray], room: Room, dx: np.ndarray) -> None:
    """Adds a piece's gradients from those of its states; those of its inputs go into dx. w: QKV with the scale in Q."""
    x, qkv, a, share, mixed, h, g = kept
    q, k, val = _thirds(qkv.reshape(len(a), WIDTH, -1))
    grad["W2"] += g.T @ full
    dg = np.matmul(full, p["W2"].T, out=room("dg", *g.shape))
    dg *= g > 0
    both = h.T @ dg
    grad["W1"] += both[:DIM]
    grad["b1"] += both[DIM]
    dh = np.matmul(dg, p["W1"].T, out=room("dh", *full.shape))
    dh += full
    grad["O"] += mixed.T @ dh
    # the rows' shares are set on these, which are narrower than a; the last column meets the ones of val
    dm, both = room("dm", len(full), DIM + 1), room("both", *full.shape)
    np.matmul(dh, p["O"].T, out=dm[:, :DIM])
    np.matmul(np.multiply(dm[:, :DIM], mixed, out=both), -np.ones(DIM, full.dtype), out=dm[:, DIM])
    dm *= share
    dm = dm.reshape(len(a), WIDTH, DIM + 1)
    ds = np.matmul(dm, val.transpose(0, 2, 1), out=room("ds", *a.shape))
    ds *= a
    back = (np.ones(len(a), full.dtype) @ ds.reshape(len(a), -1)).reshape(WIDTH, WIDTH)
    grad["R"] += np.bincount(np.maximum(_BACK, 0).ravel(), weights=(back * (_BACK >= 0)).ravel(), minlength=WIDTH).astype(full.dtype)
    # q, k and v side by side, as in QKV
    d3 = room("d3", *a.shape[:2], 3 * DIM)
    dq, dk, dv = _thirds(d3)
    np.matmul(ds, k, out=dq)
    np.matmul(ds.transpose(0, 2, 1), q, out=dk)
    np.matmul(a.transpose(0, 2, 1), dm[:, :, :DIM], out=dv)
    d3 = d3.reshape(-1, 3 * DIM)
    grad["QKV"] += x.T @ d3
    np.matmul(d3, w.T, out=dx)
    dx += dh


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, p: dict[str, np.ndarray], v: Vocabulary, rate: float = 1e-2, windows: int = 256):
        self.p, self.v, self.rate, self.windows, self.t, self.seen = p, v, rate, windows, 0, 0
        self.first = self.loss = 0.0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.s = {k: np.zeros_like(x) for k, x in p.items()}
        self.room, self.work = {k: np.empty_like(x) for k, x in p.items()}, Room(p["E"].dtype)

    def learn(self, texts: list[np.ndarray], end: int) -> None:
        """texts: ids without the end mark."""
        for lo in range(0, len(texts), 512):
            for index, scored, rows, target in prepared(texts[lo : lo + 512], end, self.v, WIDTH):
                for w in range(0, len(index), self.windows):
                    i = index[w : w + self.windows]
                    self.step(rows[i], target[i], scored[w : w + self.windows])

    def step(self, rows: np.ndarray, target: np.ndarray, scored: np.ndarray) -> None:
        grad, loss = gradients(self.p, self.v, rows, target, scored, self.work)
        self.t += 1
        self.first, self.loss = (loss, loss) if self.t == 1 else (self.first, self.loss + 0.1 * (loss - self.loss))
        self.seen += int(scored.sum())
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        a = np.float32(self.rate * np.sqrt(1 - 0.98**self.t) / (1 - 0.9**self.t) / np.sqrt(max(1.0, self.t / STEADY)))
        for k, g in grad.items():
            m, s, room = self.m[k], self.s[k], self.room[k]
            g *= clip
            np.multiply(np.subtract(g, m, out=room), np.float32(0.1), out=room)
            m += room
            g *= g
            np.multiply(np.subtract(g, s, out=room), np.float32(0.02), out=room)
            s += room
            np.sqrt(s, out=room)
            room += np.float32(1e-6)
            np.divide(m, room, out=room)
            room *= a
            self.p[k] -= room

    def sane(self) -> bool:
        """The parameters are numbers and the loss has not run away."""
        return self.loss <= self.first * WORSE and all(np.isfinite(x).all() for x in self.p.values())


def _joined(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, which begin with the end mark, targets, inputs per text) of texts one after another."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ids = np.concatenate([x for t in texts for x in ((end,), t)]).astype(np.int64)
    target = np.empty_like(ids)
    target[:-1] = ids[1:]
    target[np.cumsum(lengths) - 1] = end
    return ids, target, lengths


def prepared(texts: list[np.ndarray], end: int, v: Vocabulary, stride: int = STRIDE):
    """One (window indices, scored, input rows, targets) for a list of texts."""
    ids, target, lengths = _joined(texts, end)
    ends = np.cumsum(lengths)
    starts, text = cut(lengths, stride)
    index, scored = batch(ids, ends, starts, text, ends - lengths, stride)
    yield index, scored, v.row[ids], target


class _Scorer:
    """States of whole texts under fixed parameters.

    What an input row gives to attention depends on the row alone, so it is worked out once per row. The texts stand in
    a line, each at a multiple of ``STRIDE``, so that all windows are views of it; only the places that a window scores
    ask, and the first ``HEAD`` places of a text ask among themselves.
    """

    def __init__(self, p: dict[str, np.ndarray], windows: int):
        kind, w = p["E"].dtype.type, p["QKV"]
        e = p["E"]
        # per row: its question, its key, its value (through O) and a one; apart from these, itself
        self.table = np.concatenate([e @ (w[:, :DIM] * kind(DIM**-0.5)), e @ w[:, DIM : 2 * DIM], e @ (w[:, 2 * DIM :] @ p["O"]), np.ones((ROWS, 1), e.dtype)], 1)
        self.own = np.pad(e, ((0, 0), (0, 1)))
        self.biases, (self.w1, self.w2) = _biases(p), _feed(p)
        self.windows, self.none, self.room = windows, np.zeros((windows * STRIDE, HIDDEN), e.dtype), Room(e.dtype)

    def line(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """States (inputs, DIM + 1), ones last, of texts of these many input rows, one after another."""
        slots = -(-lengths // STRIDE) * STRIDE
        begin = np.cumsum(slots) - slots
        at = np.arange(len(rows)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
        size = int(slots.sum())
        line = np.zeros(size + HEAD, np.intp)
        line[at] = rows
        z = self.room("z", size + HEAD, DIM + 1)
        step = self.windows * STRIDE
        for lo in range(0, size, step):
            hi = min(lo + step, size)
            self.ask(line[lo : hi + HEAD], (hi - lo) // STRIDE, STRIDE, WIDTH, HEAD, z[lo + HEAD : hi + HEAD])
        for lo in range(0, len(begin), self.windows):
            head = (begin[lo : lo + self.windows, None] + np.arange(HEAD)).ravel()
            z[head] = self.ask(line[head], len(head) // HEAD, HEAD, HEAD, 0, self.room("head", len(head), DIM + 1))
        return z.take(at, axis=0)

    def ask(self, rows: np.ndarray, n: int, stride: int, width: int, skip: int, z: np.ndarray) -> np.ndarray:
        """States, ones last, into z, of the places from ``skip`` on of n windows of ``width`` rows, each ``stride``
        after the one before."""
        room = self.room
        x = self.table.take(rows, axis=0, out=room("x", len(rows), 3 * DIM + 1), mode="clip")
        row, one = x.strides
        q, k, v = (as_strided(x[first:, c:], (n, wide, size), (stride * row, row, one)) for first, c, wide, size in ((skip, 0, width - skip, DIM), (0, DIM, width, DIM), (0, 2 * DIM, width, DIM + 1)))
        a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", n, width - skip, width))
        a += self.biases[skip:width, :width]
        _limit(a)
        np.exp(a, out=a)
        mixed = np.matmul(a, v, out=room("mixed", n, width - skip, DIM + 1)).reshape(-1, DIM + 1)
        h = np.divide(mixed, mixed[:, DIM:] + x.dtype.type(1e-20), out=room("h", *mixed.shape))
        h[:, DIM] = 1
        h += self.own.take(rows[skip : skip + len(h)], axis=0, out=room("own", *h.shape), mode="clip")
        g = np.matmul(h, self.w1, out=room("g", len(h), HIDDEN))
        np.maximum(g, self.none[: len(g)], out=g)  # numpy takes three times as long against a number
        np.matmul(g, self.w2, out=z)
        z += h
        return z


def score_ids(p: dict[str, np.ndarray], v: Vocabulary, texts: list[np.ndarray], end: int, windows: int = NEAR, bite: int = 200_000):
    """Natural log probability of every id of each text and of its end, in bites of texts."""
    lo, scorer = 0, _Scorer(p, windows)
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < bite):
            size += len(texts[hi]) + 1
            hi += 1
        ids, target, lengths = _joined(texts[lo:hi], end)
        yield from np.split(log_probabilities(p, v, scorer.line(v.row[ids], lengths), target), np.cumsum(lengths)[:-1])
        lo = hi
