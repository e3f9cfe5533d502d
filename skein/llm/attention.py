"""A small causal self-attention model over subword units, in numpy.

Units are a public tokenizer's ids, told apart by whether they begin a word. The frequent ones of the training texts get
vectors, in classes of CLASS units by frequency; the others are one rare unit of their kind, spelled uniformly by this model
and by their counts where Units.spelling() is added. The output is a
softmax over classes and one over the units of the class, so a token costs classes + CLASS products and not one for each unit.
One layer: unit and place vectors, one attention head with a causal mask, a small hidden layer, both added to their input.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

DIM, HIDDEN, WINDOW, OVERLAP, CLASS = 32, 48, 32, 16, 64
BATCH = 256
#: Parameters that Adam moves at a time.
ADAM = 1 << 13
#: Bound of all logits.
LIMIT = 60.0


def _limit(x: np.ndarray) -> None:
    """Clips logits at LIMIT, which hardly any reach."""
    if x.max(initial=0) > LIMIT or x.min(initial=0) < -LIMIT:
        np.clip(x, -LIMIT, LIMIT, out=x)


class Units:
    """Numbers of units: those that begin words (the end of a text among them) come first, in whole classes."""

    def __init__(self, begin: np.ndarray, inner: np.ndarray, vocabulary: int, most: int = 2048):
        """begin, inner: how often each id begins words, and stands inside words, in the training texts."""
        self.vocabulary = vocabulary
        self.spell_begin, self.spell_inner = self._spelled(begin, most), self._spelled(inner, most)
        self.of_begin, next_ = self._number(begin, 0, most, 2)
        self.end, self.rare_begin = 0, 1
        self.begin_classes = next_ // CLASS
        self.of_inner, self.n = self._number(inner, next_, most, 1)
        self.rare_inner = next_
        self.of_begin[self.of_begin < 0] = self.rare_begin
        self.of_inner[self.of_inner < 0] = self.rare_inner

    def of(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The units of ids that do or do not begin words."""
        return np.where(first, self.of_begin[ids], self.of_inner[ids])

    def spelling(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What to add to the log probabilities of these ids so that rare ones are spelled by their counts and not uniformly."""
        return np.where(first, self.spell_begin[ids], self.spell_inner[ids])

    @classmethod
    def _spelled(cls, counts: np.ndarray, most: int) -> np.ndarray:
        rare = cls._number(counts, 0, most, 0)[0] < 0
        share = np.where(rare, counts + 1.0, 0)
        return np.where(rare, np.log(np.maximum(share, 1) / max(1, share.sum()) * len(counts)), 0).astype(np.float32)

    @staticmethod
    def _number(counts: np.ndarray, base: int, most: int, taken: int) -> tuple[np.ndarray, int]:
        order = np.argsort(-counts, kind="stable")[:most]
        order = order[counts[order] > 1]
        out = np.full(len(counts), -1, np.int64)
        out[order] = base + taken + np.arange(len(order))
        return out, base + -(-(taken + len(order)) // CLASS) * CLASS


class Model:
    NAMES = ("unit", "place", "q", "k", "v", "o", "h1", "h2", "cls", "cls_b", "out", "out_b")

    def __init__(self, units: Units, seed: int = 1):
        r = np.random.default_rng(seed)
        classes = units.n // CLASS
        shape = {"unit": (units.n + 1, DIM), "place": (WINDOW, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "h1": (DIM, HIDDEN), "h2": (HIDDEN, DIM), "cls": (DIM, classes), "cls_b": (classes,), "out": (classes, DIM, CLASS), "out_b": (classes, CLASS)}
        self.units = units
        self.p = {n: (r.standard_normal(s) * (0.3 if n == "unit" else 0.1 if n == "place" else 1 / np.sqrt(DIM))).astype(np.float32) for n, s in shape.items()}
        for n in ("cls_b", "out_b", "h2"):
            self.p[n][:] = 0
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def _project(self) -> np.ndarray:
        """Queries as what they ask of units, and values as what a place gets of them, side by side: one head needs no other products."""
        p = self.p
        return np.concatenate([p["q"] @ p["k"].T / np.sqrt(DIM).astype(p["q"].dtype), p["v"] @ p["o"]], 1)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each unit, and each place: vector, value, a one for units and query; those of a unit at a place are the sums."""
        project, out = self._project(), []
        for x in (self.p["unit"], self.p["place"]):
            made = x @ project
            out.append(np.concatenate([x, made[:, DIM:], np.full((len(x), 1), x is self.p["unit"], x.dtype), made[:, :DIM]], 1))
        return out[0], out[1]

    def hidden(self, inputs: np.ndarray, first: int = 0, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Vectors (windows, WINDOW - first, DIM) from which the units are predicted; inputs are the units before them.

        Places before ``first`` are context only: they give keys and values, but nothing is predicted there.
        Logits are clipped at LIMIT, so that no maximum has to be taken off; a column of ones beside the values sums the weights.
        """
        p, n = self.p, len(inputs)
        unit, place = tables or self.tables()
        t = unit[inputs]
        t += place
        x = t[:, :, :DIM]
        a = t[:, first:, 2 * DIM + 1 :] @ x.transpose(0, 2, 1)
        _limit(a)
        np.exp(a, out=a)
        a *= self.mask[first:]
        c = a @ t[:, :, DIM : 2 * DIM + 1]
        y = c[:, :, :DIM] / c[:, :, DIM:]
        y += x[:, first:]
        y = y.reshape(-1, DIM)
        g = y @ p["h1"]
        np.maximum(g, 0, out=g)
        y += g @ p["h2"]
        return y.reshape(n, WINDOW - first, DIM)

    def log_probs(self, z: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """For vectors (n, DIM) and units: log probability of each unit, log probability of any that begins a word.

        With ``grads`` also the gradients of the mean loss: those of the output there, and those of z as the third result.
        """
        p, u, n = self.p, self.units, len(z)
        classes, rows = len(p["cls_b"]), np.arange(n)
        e = z @ p["cls"]
        e += p["cls_b"]
        _limit(e)
        np.exp(e, out=e)
        both = np.zeros((classes, 2), e.dtype)
        both[:, 0], both[: u.begin_classes, 1] = 1, 1
        sums = e @ both
        total = sums[:, 0]
        cls, slot = targets // CLASS, targets % CLASS
        logp = np.log(e[rows, cls] / total)
        logb = np.log(sums[:, 1] / total)
        # rows of a class stand together; what is no product is done for all classes at once
        order = np.argsort(cls.astype(np.int16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(classes + 1)).tolist()
        own = [(c, slice(edges[c], edges[c + 1])) for c in range(classes) if edges[c] < edges[c + 1]]
        zs, slot = z[order], slot[order]
        f = np.empty((n, CLASS), e.dtype)
        for c, s in own:
            np.matmul(zs[s], p["out"][c], out=f[s])
            f[s] += p["out_b"][c]
        _limit(f)
        np.exp(f, out=f)
        inner = f @ np.ones(CLASS, f.dtype)
        logp[order] += np.log(f[rows, slot] / inner)
        dz = None
        if grads is not None and n:
            e *= (1 / (n * total))[:, None]
            e[rows, cls] -= e.dtype.type(1 / n)
            np.matmul(z.T, e, out=grads["cls"])
            e.sum(0, out=grads["cls_b"])
            dz = e @ p["cls"].T
            f *= (1 / (n * inner))[:, None]
            f[rows, slot] -= f.dtype.type(1 / n)
            grads["out"].fill(0)
            grads["out_b"].fill(0)
            grads["out_b"][[c for c, _ in own]] = np.add.reduceat(f, [s.start for _, s in own])
            back = np.empty_like(zs)
            for c, s in own:
                np.matmul(zs[s].T, f[s], out=grads["out"][c])
                np.matmul(f[s], p["out"][c].T, out=back[s])
            dz[order] += back
        logp[(targets == u.rare_begin) | (targets == u.rare_inner)] -= np.float32(np.log(u.vocabulary))
        return logp, logb, dz

    def step(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, grads: dict | None = None) -> tuple[float, dict]:
        """Mean loss over the valid places and the gradients of all parameters, in ``grads`` if that is given."""
        p, n = self.p, len(inputs)
        grads = {k: np.zeros_like(v) for k, v in p.items()} if grads is None else grads
        kind, rows = p["unit"].dtype, lambda t: t.reshape(-1, t.shape[-1])
        project = self._project()
        x = p["unit"][inputs]
        x += p["place"]
        flat = rows(x)
        both = flat @ project
        q, v = (np.ascontiguousarray(both[:, i : i + DIM]).reshape(x.shape) for i in (0, DIM))
        a = q @ x.transpose(0, 2, 1)
        _limit(a)
        np.exp(a, out=a)
        a *= self.mask
        a *= 1 / (rows(a) @ np.ones(WINDOW, kind)).reshape(n, WINDOW, 1)
        c = rows(a @ v)
        y = c + flat
        g = y @ p["h1"]
        np.maximum(g, 0, out=g)
        z = g @ p["h2"]
        z += y

        if valid.all():
            logp, _, dz = self.log_probs(z, targets.ravel(), grads)
        else:
            at = np.flatnonzero(valid.ravel())
            dz = np.zeros_like(z)
            logp, _, dz[at] = self.log_probs(z[at], targets.ravel()[at], grads)
        np.matmul(g.T, dz, out=grads["h2"])
        dg = dz @ p["h2"].T
        dg *= g > 0
        np.matmul(y.T, dg, out=grads["h1"])
        dy = dg @ p["h1"].T
        dy += dz
        # what the weights of a place get together is what its mixture gets
        mean = np.einsum("ij,ij->i", dy, c).reshape(n, WINDOW, 1)
        dc = dy.reshape(x.shape)
        ds = dc @ v.transpose(0, 2, 1)
        ds -= mean
        ds *= a
        both = both.reshape(n, WINDOW, 2 * DIM)
        both[:, :, :DIM], both[:, :, DIM:] = ds @ x, a.transpose(0, 2, 1) @ dc
        both = rows(both)
        asked, given = np.split(flat.T @ both, 2, 1)
        asked = asked / np.sqrt(DIM).astype(kind)
        grads["q"][:], grads["k"][:], grads["v"][:], grads["o"][:] = asked @ p["k"], asked.T @ p["q"], given @ p["o"].T, p["v"].T @ given
        dx = both @ project.T
        dx += dy
        dx += rows(ds.transpose(0, 2, 1) @ q)
        dx.reshape(n, -1).sum(0, out=grads["place"].reshape(-1))
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.uint16) if self.units.n < 1 << 16 else ids, kind="stable")
        ids = ids[order]
        start = np.flatnonzero(np.diff(ids, prepend=-1))
        grads["unit"].fill(0)
        grads["unit"][ids[start]] = np.add.reduceat(dx[order], start)
        return -float(logp.mean()), grads

    def _named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters, or their gradients, that lie one after another in ``flat``."""
        ends = np.cumsum([self.p[n].size for n in self.NAMES])
        return {n: flat[end - self.p[n].size : end].reshape(self.p[n].shape) for n, end in zip(self.NAMES, ends.tolist(), strict=True)}

    def begin_at(self, count: np.ndarray) -> None:
        """Lets the output's biases begin at the units' frequencies; count: how often each unit stands in the training texts."""
        count = count.reshape(-1, CLASS) + 0.01
        self.p["cls_b"][:] = np.log(count.sum(1) / count.sum())
        self.p["out_b"][:] = np.log(count / count.sum(1, keepdims=True))

    def fit(self, texts: Iterable[np.ndarray], least: int, expected: float = 0, rates: tuple[float, float] = (0.01, 0.0005), batch: int = 64, seed: int = 2, together: int = 1 << 20, passes: int = 1) -> tuple[list[float], int]:
        """Adam over windows of the texts' units, in an order shuffled among ``together`` units at a time: losses and units seen.

        Every unit of every text is predicted in each of ``passes`` passes; texts of too few windows for ``least`` steps are gone through again.
        The rate rises over the first steps and goes from the first of ``rates`` to the second over the expected steps.
        """
        r, losses, units, span = np.random.default_rng(seed), [], 0, max(least, expected, 1)
        flat = np.concatenate([self.p[n].ravel() for n in self.NAMES])
        m, v, slope = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
        self.p, grads = self._named(flat), self._named(slope)

        def learn(some: list[np.ndarray], least: int) -> None:
            lengths = np.array([len(t) for t in some])
            seq, offset = np.concatenate(some), np.cumsum(lengths) - lengths
            home, begin, _ = windows(lengths, WINDOW)
            done, gone = 0, 0
            while gone < passes or done < least:
                gone += 1
                order = r.permutation(len(home))
                for at in range(0, len(order), batch):
                    w, t = order[at : at + batch], len(losses) + 1
                    loss, _ = self.step(*inputs_of(seq, offset[home[w]], begin[w], lengths[home[w]], self.units.n)[:3], grads)
                    losses.append(loss)
                    done += 1
                    lr = min(1, t / 20) * (rates[0] + (rates[1] - rates[0]) * min(1, t / span))
                    _adam(flat, slope, m, v, lr, t)

        some, size = [], 0
        for text in texts:
            for at in range(0, len(text), together):
                some.append(text[at : at + together])
                size += len(some[-1])
                units += len(some[-1])
                if size >= together:
                    learn(some, 0)
                    some, size = [], 0
        if some:
            learn(some, least - len(losses))
        return losses, units

    def score(self, seq: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log probability of each unit of the texts (one after another in seq), and of any that begins a word, there.

        Overlapping windows: each after the first lends its first OVERLAP places as context only, so every unit counts once.
        """
        offset = np.cumsum(lengths) - lengths
        home, begin, first = windows(lengths)
        logp, logb, tables = np.empty(len(seq), np.float32), np.empty(len(seq), np.float32), self.tables()
        for some, skip in ((np.flatnonzero(first), 0), (np.flatnonzero(~first), OVERLAP)):
            step = BATCH if skip == 0 else BATCH * 3 // 2
            for at in range(0, len(some), 2 * step):
                vectors, goals, places = [], [], []
                for lo in range(at, min(at + 2 * step, len(some)), step):
                    w = some[lo : min(lo + step, at + 2 * step)]
                    h, b = home[w], begin[w]
                    inputs, targets, valid, place = inputs_of(seq, offset[h], b, lengths[h], self.units.n)
                    flat = np.flatnonzero(valid[:, skip:].ravel())
                    vectors.append(self.hidden(inputs, skip, tables).reshape(-1, DIM)[flat])
                    goals.append(targets[:, skip:].ravel()[flat])
                    places.append(place[:, skip:].ravel()[flat])
                to = np.concatenate(places)
                logp[to], logb[to], _ = self.log_probs(np.concatenate(vectors), np.concatenate(goals))
        return logp, logb


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, lr: float, t: int) -> None:
    """Adam's step t (0.9, 0.99, 1e-8) in place, a piece that stays in the cache at a time; g is used up.

    m and v hold the sums that are 10 and 100 times the usual means.
    """
    root = 10 * np.sqrt(1 - 0.99**t)
    rate, least = np.float32(lr * root / 10 / (1 - 0.9**t)), np.float32(1e-8 * root)
    for at in range(0, len(p), ADAM):
        s = slice(at, at + ADAM)
        x, y, z = g[s], m[s], v[s]
        y *= np.float32(0.9)
        y += x
        x *= x
        z *= np.float32(0.99)
        z += x
        np.sqrt(z, out=x)
        x += least
        np.divide(y, x, out=x)
        x *= rate
        p[s] -= x


def windows(lengths: np.ndarray, stride: int = WINDOW - OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its text, where it begins there, and whether it is the text's first."""
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // stride)), 0)
    home = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(home)) - (np.cumsum(count) - count)[home]
    return home, nth * stride, nth == 0


def inputs_of(seq: np.ndarray, offset: np.ndarray, begin: np.ndarray, length: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """Inputs (units before), targets, which places are in the text, and their places in seq; ``start`` stands before a text."""
    pos = begin[:, None] + np.arange(WINDOW)
    valid = pos < length[:, None]
    place = np.where(valid, offset[:, None] + pos, offset[:, None])
    targets = seq[place]
    inputs = np.where(pos == 0, start, seq[np.maximum(place - 1, 0)])
    return inputs, targets, valid, place
