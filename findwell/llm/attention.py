"""A small causal self-attention language model in numpy.

One block: embeddings, one attention head with a learnt bias for each distance,
a feed-forward layer, residual connections, and a softmax in two steps (the class
of a symbol, then the symbol in its class), all in single precision. The first
classes hold the symbols that begin a word, or end a text, and no others.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a class, classes.
WIDE = 32
SYMBOLS = WIDE * WIDE


def _keep_freed_memory() -> None:
    """Frees one large block, after which glibc keeps smaller ones for the next step instead of returning them to the system."""
    np.empty(24 << 20, np.uint8)


class Attention:
    """The model. Symbol 0 begins and ends every text; those of the first `openers` classes begin words."""

    def __init__(self, counts: np.ndarray, dim: int = 16, inner: int = 32, window: int = 32, stride: int = 24, seed: int = 11, openers: int = 1):
        rng = np.random.default_rng(seed)
        self.window, self.stride, self.openers = window, stride, openers

        def random(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)

        share = (counts + 0.5) / (counts + 0.5).sum()
        table = share.reshape(WIDE, WIDE)
        self.p = {
            "embed": random(SYMBOLS, dim) * np.sqrt(SYMBOLS).astype(np.float32) * 0.3,
            "query": random(dim, dim), "key": random(dim, dim), "value": random(dim, dim), "out": random(dim, dim) * 0.5,
            "near": np.linspace(1.0, -1.0, window).astype(np.float32),
            "up": random(dim, inner), "up_bias": np.zeros(inner, np.float32), "down": random(inner, dim) * 0.5,
            "group": random(dim, WIDE) * 0.1, "group_bias": np.log(table.sum(1)).astype(np.float32),
            "member": random(WIDE, dim, WIDE) * 0.1, "member_bias": np.log(table / table.sum(1, keepdims=True)).astype(np.float32),
        }
        i, j = np.indices((window, window))
        self.back = np.clip(i - j, 0, window - 1)
        self.future = j > i

    @staticmethod
    def _by_class(rows: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Rows in the order of their targets' classes, their targets, and the (class, begin, end) of those that have rows."""
        targets = targets.take(rows)
        group = targets // WIDE
        ends = np.cumsum(np.bincount(group, minlength=WIDE)).tolist()
        order = np.argsort(group.astype(np.uint8), kind="stable")
        return rows.take(order), targets.take(order), [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]

    @staticmethod
    def _members(h: np.ndarray, table: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits within the class of each row; rows are in the order of classes and end with a 1 for the bias."""
        z = np.empty((len(h), WIDE), h.dtype)
        for c, a, b in classes:
            np.matmul(h[a:b], table[c], out=z[a:b])
        return np.minimum(z, 60, out=z)

    def _bias(self, rows: int) -> np.ndarray:
        """What is added to the logits of the last `rows` places of a window."""
        return np.where(self.future, np.float32(-1e9), self.p["near"][self.back])[-rows:]

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and within them, with the biases as last rows."""
        p = self.p
        return np.vstack([p["group"], p["group_bias"]]), np.concatenate([p["member"], p["member_bias"][:, None]], axis=1)

    def windows(self, lengths: np.ndarray):
        """(begin in the text, first scored place) of the windows over texts of `lengths` targets, and their text.

        Windows overlap by window - stride; each place is scored in the first
        window that holds it.
        """
        n = 1 + np.maximum(0, -(-(lengths - self.window) // self.stride))
        n[lengths == 0] = 0
        text = np.repeat(np.arange(len(lengths)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = k * self.stride
        return text, begin, np.where(k > 0, begin + self.window - self.stride, 0)

    def _placed(self, begin: np.ndarray, scored: np.ndarray, lengths: np.ndarray, starts: np.ndarray):
        """(place of each input, which stand before their text, place of each target, which are scored) of windows.

        Only the last `stride` places of a window are targets. Those before them are
        scored in the first window of a text alone, which for this comes a second time,
        `window - stride` places further back.
        """
        skip = self.window - self.stride
        again = np.flatnonzero(begin == 0) if skip else np.empty(0, np.int64)
        before = np.arange(len(begin), len(begin) + len(again))
        limit = np.r_[lengths, np.minimum(lengths[again], skip)]
        begin, scored = np.r_[begin, np.full(len(again), -skip)], np.r_[np.maximum(scored, skip), np.zeros(len(again), np.int64)]
        starts = np.r_[starts, starts[again]]
        inside = begin[:, None] + np.arange(self.window)
        last = np.r_[lengths, lengths[again]][:, None] - 1
        index = np.minimum(np.maximum(inside, 0), last) + starts[:, None]
        own = inside[:, skip:]
        return index, before, index[:, skip:], (own >= scored[:, None]) & (own < limit[:, None])

    def log_probs(self, symbols: np.ndarray, lengths: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities at every symbol of texts laid end to end: of the symbol, and of one that begins a word.

        Each place is scored once, given what precedes it.
        """
        _keep_freed_memory()
        p, out, opens = self.p, np.zeros(len(symbols), np.float32), np.zeros(len(symbols), np.float32)
        dim, skip = p["query"].shape[1], self.window - self.stride
        bias, kind = self._bias(self.stride), p["embed"].dtype
        # what depends on one symbol alone; a column of ones sums the weights of a place
        asks = np.hstack([p["embed"], p["embed"] @ (p["query"] * np.float32(1 / np.sqrt(dim)))])
        tells = np.hstack([p["embed"] @ p["key"], p["embed"] @ (p["value"] @ p["out"]), np.ones((SYMBOLS, 1), kind)])
        group_table, member_table = self._tables()
        sums = np.zeros((WIDE, 2), kind)
        sums[:, 0], sums[: self.openers, 1], one = 1, 1, np.ones(WIDE, kind)
        starts = np.cumsum(lengths) - lengths
        text, begin, scored = self.windows(lengths)
        previous = np.empty(len(symbols), np.int64)
        previous[1:] = symbols[:-1]
        previous[starts[lengths > 0]] = 0
        for at in range(0, len(text), block):
            t = text[at : at + block]
            index, before, targets, wanted = self._placed(begin[at : at + block], scored[at : at + block], lengths[t], starts[t])
            inputs = previous.take(index)
            told = tells.take(inputs, axis=0)
            asked = asks.take(inputs[:, skip:], axis=0)
            a = asked[:, :, dim:] @ told[:, :, :dim].transpose(0, 2, 1)
            a += bias
            np.minimum(a, 60, out=a)
            np.exp(a, out=a)
            a[before, :, :skip] = 0
            o = (a @ told[:, :, dim:]).reshape(-1, dim + 1)
            h1 = o[:, :dim] * (1 / np.maximum(o[:, dim:], np.float32(1e-30)))
            h1 += asked[:, :, :dim].reshape(-1, dim)
            f = h1 @ p["up"]
            f += p["up_bias"]
            np.maximum(f, 0, out=f)
            h = np.ones((len(h1), dim + 1), kind)
            np.matmul(f, p["down"], out=h[:, :dim])
            h[:, :dim] += h1
            where = targets.ravel()
            rows, target, classes = self._by_class(np.flatnonzero(wanted), symbols.take(where))
            h, where = h.take(rows, axis=0), where.take(rows)
            group, row = target // WIDE, np.arange(0, len(target) * WIDE, WIDE)
            z = h @ group_table
            np.minimum(z, 60, out=z)
            own = z.ravel().take(row + group)
            np.exp(z, out=z)
            total, opening = (z @ sums).T
            opens[where] = np.log(opening / total)
            z = self._members(h, member_table, classes)
            own += z.ravel().take(row + target % WIDE)
            np.exp(z, out=z)
            total *= z @ one
            out[where] = own - np.log(total)
        return out, opens

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, wanted: np.ndarray, before: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the wanted places of windows, and its gradients.

        `targets` and `wanted` are of the last places of each window; where fewer than
        the inputs, the inputs without a target stand before the text in the windows `before`.
        """
        p = self.p
        (w, t), r = inputs.shape, wanted.shape[1]
        skip, d = t - r, p["query"].shape[1]
        kind, scale = p["embed"].dtype, np.float32(1 / np.sqrt(d))
        ids = inputs.ravel()
        x = p["embed"].take(ids, axis=0)
        # keys, values and queries are computed for each symbol, not for each place, values with what "out" makes of them
        both, query = np.hstack([p["key"], p["value"] @ p["out"]]), p["query"] * scale
        kv = (p["embed"] @ both).take(inputs, axis=0)
        k, v = kv[:, :, :d], kv[:, :, d:]
        mine = np.hstack([p["embed"], p["embed"] @ query]).take(inputs[:, skip:], axis=0)
        q, mine = mine[:, :, d:], mine[:, :, :d].reshape(-1, d)
        attention = q @ k.transpose(0, 2, 1)
        attention += self._bias(self.window)[skip:t, :t]
        np.minimum(attention, 60, out=attention)
        np.exp(attention, out=attention)
        if before is not None:
            attention[before, :, :skip] = 0
        flat = attention.reshape(-1, t)
        flat *= (1 / np.maximum(flat @ np.ones(t, kind), np.float32(1e-30)))[:, None]
        o = (attention @ v).reshape(-1, d)
        h1 = o + mine
        f = h1 @ p["up"]
        f += p["up_bias"]
        np.maximum(f, 0, out=f)
        h = np.ones((len(h1), d + 1), kind)
        np.matmul(f, p["down"], out=h[:, :d])
        h[:, :d] += h1
        rows, target, classes = self._by_class(np.flatnonzero(wanted), targets.ravel())
        n = len(rows)
        h = h.take(rows, axis=0)
        group, row = target // WIDE, np.arange(0, n * WIDE, WIDE)
        group_table, member_table = self._tables()
        one, share = np.ones(WIDE, kind), kind.type(1 / max(n, 1))

        def softened(z: np.ndarray, at: np.ndarray) -> float:
            """Logits to their gradients; returns the loss."""
            own = z.ravel().take(at).sum()
            np.exp(z, out=z)
            total = z @ one
            z *= (share / total)[:, None]
            z.ravel()[at] -= share
            return np.log(total).sum() - own

        z = h @ group_table
        np.minimum(z, 60, out=z)
        loss = softened(z, row + group)
        of_group = h.T @ z
        of_h = z @ p["group"].T
        z = self._members(h, member_table, classes)
        loss += softened(z, row + target % WIDE)
        of_member = np.zeros_like(member_table)
        back = np.empty((n, d), kind)
        for c, a, b in classes:
            np.matmul(h[a:b].T, z[a:b], out=of_member[c])
            np.matmul(z[a:b], p["member"][c].T, out=back[a:b])
        g = {"group": of_group[:d], "group_bias": of_group[d], "member": of_member[:, :d], "member_bias": of_member[:, d]}
        of_h += back
        dh = np.zeros_like(h1)
        dh[rows] = of_h
        df = dh @ p["down"].T
        df *= f > 0
        g["down"], g["up"], g["up_bias"] = f.T @ dh, h1.T @ df, np.ones(len(df), kind) @ df
        dh += df @ p["up"].T
        ds = dh.reshape(w, r, d) @ v.transpose(0, 2, 1)
        # the weights of a place add up to one, so what they share is what the output has
        ds -= np.einsum("ij,ij->i", dh, o).reshape(w, r, 1)
        ds *= attention
        dkv = np.empty((w, t, 2 * d), kind)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :d])
        np.matmul(attention.transpose(0, 2, 1), dh.reshape(w, r, d), out=dkv[:, :, d:])
        dq = (ds @ k).reshape(-1, d)
        back_of, near = self.back[skip:t, :t], (np.ones(w, kind) @ ds.reshape(w, -1)).reshape(r, t)
        g["near"] = np.bincount(back_of.ravel(), weights=np.where(self.future[skip:t, :t], 0, near).ravel(), minlength=self.window).astype(np.float32)
        dkv = dkv.reshape(-1, 2 * d)
        of_both = x.T @ dkv
        g["query"], g["key"], of_out = (mine.T @ dq) * scale, of_both[:, :d], of_both[:, d:]
        g["value"], g["out"] = of_out @ p["out"].T, p["value"].T @ of_out
        dx = dkv @ both.T
        dh += dq @ query.T
        dx.reshape(w, t, d)[:, skip:] += dh.reshape(w, r, d)
        g["embed"] = np.zeros_like(p["embed"])
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["embed"][ids[begins]] = np.add.reduceat(dx.take(order, axis=0), begins, axis=0)
        return float(loss / max(n, 1)), g

    def train(self, symbols: np.ndarray, lengths: np.ndarray, steps: int, batch: int = 96, rate: float = 0.01, seed: int = 0) -> float:
        """Adam steps on windows drawn at random; returns the mean loss of the last tenth."""
        n = int(self.windows(lengths)[0].size)
        if not n:
            return 0.0
        rng = np.random.default_rng(seed)
        picks = (rng.integers(0, n, min(batch, n)) for _ in range(steps))
        losses = self._descend(symbols, lengths, picks, lambda step: rate * min(1.0, step / 20) * (1 - 0.9 * step / steps), self.moments())
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def train_all(self, symbols: np.ndarray, lengths: np.ndarray, state: list, rate: float, batch: int = 96) -> int:
        """Adam steps on every window once, in random order, from `state` on; returns the number of windows."""
        n = int(self.windows(lengths)[0].size)
        order = np.random.default_rng(state[2]).permutation(n)
        self._descend(symbols, lengths, (order[a : a + batch] for a in range(0, n, batch)), lambda step: rate * min(1.0, step / 20), state)
        return n

    def moments(self) -> list:
        """First and second moments of Adam, weights end to end, and the steps so far."""
        n = sum(v.size for v in self.p.values())
        return [np.zeros(n, np.float32), np.zeros(n, np.float32), 0]

    def _descend(self, symbols: np.ndarray, lengths: np.ndarray, picks, pace_of, state: list) -> list[float]:
        _keep_freed_memory()
        text, begin, scored = self.windows(lengths)
        starts = np.cumsum(lengths) - lengths
        previous = np.empty(len(symbols), np.int64)
        previous[1:] = symbols[:-1]
        previous[starts[lengths > 0]] = 0
        first, second, step = state
        # all weights in one piece, of which each is a view
        weights = np.concatenate([v.ravel() for v in self.p.values()])
        at = 0
        for n, v in self.p.items():
            self.p[n] = weights[at : at + v.size].reshape(v.shape)
            at += v.size
        g, move, losses = np.empty_like(weights), np.empty_like(weights), []
        for pick in picks:
            step += 1
            t = text[pick]
            index, before, targets, wanted = self._placed(begin[pick], scored[pick], lengths[t], starts[t])
            loss, found = self.gradients(previous.take(index), symbols.take(targets), wanted, before)
            losses.append(loss)
            np.concatenate([found[n].ravel() for n in self.p], out=g)
            pace = pace_of(step)
            first *= 0.9
            np.multiply(g, 0.1, out=move)
            first += move
            second *= 0.99
            g *= g
            g *= 0.01
            second += g
            np.multiply(second, 1 / (1 - 0.99**step), out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(first, g, out=move)
            move *= pace / (1 - 0.9**step)
            weights -= move
        state[2] = step
        return losses
