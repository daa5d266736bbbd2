"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by back-propagation, and decoding.

A step of the LSTM reads two neighbouring characters and scores the tags of both, which halves the steps of a sequence. Its
gates squash by x / (1 + |x|), in training as in decoding: numpy computes that several times faster than exponentials. The
CRF joins the tags of single characters; every sequence has an even length, filled up by padding.

Decoding follows the best path only in sequences that may have a tag other than none. A bound says which: the best paths of
each kind of span are followed forward, without memory, and moves between kinds are taken for as good as the best of them.
Where no such path gains over none, the path of none throughout is the best, so the bound changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Parameters = dict[str, np.ndarray]


def _squashed(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Symbols in, tags out. Both directions run side by side as the first axis of the recurrent weights. The gates stand in
    the order in, out, candidate; what a cell forgets is what it takes in, so it stays between -1 and 1."""

    parameters: Parameters

    @classmethod
    def fresh(cls, symbols: int, tags: int, embedding: int = 12, hidden: int = 8, seed: int = 0) -> Tagger:
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) * (1.5 / np.sqrt(shape[-2]))).astype(np.float32)
        p = {
            "embed": draw.standard_normal((symbols, embedding)).astype(np.float32) * 0.3,
            "input": small(2, 2 * embedding, 3 * hidden),
            "recur": small(2, hidden, 3 * hidden),
            "bias": np.zeros((2, 1, 3 * hidden), np.float32),
            "out": small(2 * hidden, 2 * tags),
            "out_bias": np.zeros(2 * tags, np.float32),
            "move": np.zeros((tags, tags), np.float32),
            "first": np.zeros(tags, np.float32),
        }
        p["bias"][:, :, :hidden] = -1  # remember at first
        return cls(p)

    def _run(self, symbols: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (time, row, tag) of symbols (time, row), and what the way back needs."""
        p = self.parameters
        steps, rows, hidden = len(symbols) // 2, symbols.shape[1], p["recur"].shape[1]
        embedded = p["embed"][symbols].reshape(steps, 2, rows, -1).transpose(0, 2, 1, 3).reshape(steps, rows, -1)
        both = np.stack([embedded, embedded[::-1]], 1)
        pre = both @ p["input"] + p["bias"]
        h = c = np.zeros((2, rows, hidden), pre.dtype)
        ys = np.empty((steps, 2, rows, 3 * hidden), pre.dtype)
        cells, states = np.zeros((steps + 1, 2, rows, hidden), pre.dtype), np.zeros((steps + 1, 2, rows, hidden), pre.dtype)
        for t in range(steps):
            ys[t] = y = _squashed(pre[t] + h @ p["recur"])
            i, o = (0.5 + 0.5 * y[..., k * hidden : (k + 1) * hidden] for k in (0, 1))
            c = c + i * (y[..., 2 * hidden :] - c)
            h = o * c
            cells[t + 1], states[t + 1] = c, h
        joined = np.concatenate([states[1:, 0], states[:0:-1, 1]], 2)
        scores = joined @ p["out"] + p["out_bias"]
        scores = scores.reshape(steps, rows, 2, -1).transpose(0, 2, 1, 3).reshape(2 * steps, rows, -1)
        return scores, (both, ys, cells, states, joined)

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, Parameters]:
        """Mean negative log-likelihood of tag sequences and its gradients; arrays are (time, row)."""
        p = self.parameters
        scores, (both, ys, cells, states, joined) = self._run(symbols)
        kind = scores.dtype
        scores = scores.astype(np.float64)
        length, rows, n = scores.shape
        move, r = p["move"].astype(np.float64), np.arange(rows)
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = p["first"] + scores[0]
        # sums of exponentials as products of matrices, scaled by the largest of each row
        jump = np.exp(move)
        for t in range(1, length):
            top = ahead[t - 1].max(1, keepdims=True)
            ahead[t] = np.log(np.exp(ahead[t - 1] - top) @ jump) + top + scores[t]
        for t in range(length - 2, -1, -1):
            following = back[t + 1] + scores[t + 1]
            top = following.max(1, keepdims=True)
            back[t] = np.log(np.exp(following - top) @ jump.T) + top
        total = _logsumexp(ahead[-1], 1)
        d_scores = np.exp(ahead + back - total[None, :, None])
        d_first = d_scores[0].sum(0)
        gold = p["first"][tags[0]] + scores[np.arange(length)[:, None], r, tags].sum(0) + move[tags[:-1], tags[1:]].sum(0)
        # sum over time and rows of exp(ahead + move + following - total), as one product of matrices
        right = scores[1:] + back[1:]
        top = ahead[:-1].max(2, keepdims=True)
        left = np.exp(ahead[:-1] - top).reshape(-1, n)
        right = np.exp(right + top - total[None, :, None]).reshape(-1, n)
        d_move = jump * (left.T @ right)
        np.add.at(d_first, tags[0], -1.0)
        np.add.at(d_move, (tags[:-1], tags[1:]), -1.0)
        d_scores[np.arange(length)[:, None], r, tags] -= 1
        steps = length // 2
        d_scores = (d_scores / rows).astype(kind).reshape(steps, 2, rows, n).transpose(0, 2, 1, 3).reshape(steps, rows, 2 * n)
        flat = d_scores.reshape(-1, 2 * n)
        out = {"out": joined.reshape(-1, joined.shape[2]).T @ flat, "out_bias": flat.sum(0), "move": (d_move / rows).astype(kind), "first": (d_first / rows).astype(kind)}
        d_joined = d_scores @ p["out"].T
        hidden = p["recur"].shape[1]
        d_states = np.stack([d_joined[:, :, :hidden], d_joined[::-1, :, hidden:]], 1)
        d_pre = np.empty_like(ys)
        dh = dc = np.zeros((2, rows, hidden), kind)
        back_recur = p["recur"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            y = ys[t]
            i, o = (0.5 + 0.5 * y[..., k * hidden : (k + 1) * hidden] for k in (0, 1))
            dh = dh + d_states[t]
            dc = dc + dh * o
            d_pre[t] = np.concatenate([0.5 * dc * (y[..., 2 * hidden :] - cells[t]), 0.5 * dh * cells[t + 1], dc * i], 2)
            d_pre[t] *= (1 - np.abs(y)) ** 2
            dh = d_pre[t] @ back_recur
            dc = dc - dc * i
        flat_pre = d_pre.transpose(1, 0, 2, 3).reshape(2, -1, 3 * hidden)
        out["recur"] = states[:-1].transpose(1, 3, 0, 2).reshape(2, hidden, -1) @ flat_pre
        out["input"] = both.transpose(1, 3, 0, 2).reshape(2, both.shape[3], -1) @ flat_pre
        out["bias"] = flat_pre.sum(1, keepdims=True)
        d_both = d_pre @ p["input"].transpose(0, 2, 1)
        d_embedded = (d_both[:, 0] + d_both[::-1, 1]).reshape(steps, rows, 2, -1).transpose(0, 2, 1, 3).reshape(2 * steps * rows, -1)
        one_hot = symbols.ravel()[:, None] == np.arange(len(p["embed"]))
        out["embed"] = one_hot.astype(kind).T @ d_embedded
        return float((total - gold).mean()), out

    def fit(self, symbols: np.ndarray, tags: np.ndarray, steps: int, batch: int = 128, rate: float = 0.05, seed: int = 0) -> list[float]:
        """Adam on random batches of sequences (row, time); returns the losses."""
        draw, losses = np.random.default_rng(seed), []
        first = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        second = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        for step in range(1, steps + 1):
            rows = draw.integers(0, len(symbols), batch)
            loss, gradients = self.gradients(symbols[rows].T, tags[rows].T)
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
            speed = rate * min(1.0, 1.6 * (1 - step / (steps + 1)))
            for k, g in gradients.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.parameters[k] = (self.parameters[k] - speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def decoder(self) -> Decoder:
        return Decoder(self.parameters)


class Decoder:
    """Viterbi paths of many sequences, with tables made once from a tagger's parameters. Rows are the last axis throughout,
    so that numpy works on long stretches."""

    def __init__(self, p: Parameters):
        self.symbols, self.hidden, self.tags = len(p["embed"]), p["recur"].shape[1], p["move"].shape[0]
        half, n, hidden = p["embed"].shape[1], self.tags, self.hidden
        first, second = (p["embed"] @ p["input"][:, k * half : (k + 1) * half] for k in (0, 1))
        # the input of a step, a column for each pair of symbols
        pairs = (first[:, :, None] + second[:, None] + p["bias"][:, None]).reshape(2, self.symbols**2, -1)
        self.inputs = np.ascontiguousarray(pairs.transpose(0, 2, 1)).astype(np.float32)
        # one product gives what a state adds to the next gates, and the scores of its step: of each tag over none. States
        # are kept twice as large, which saves the halves of their gates
        out, bias = p["out"].reshape(2, hidden, 2, n), p["out_bias"].reshape(2, n)
        over = (out[..., 1:] - out[..., :1]).reshape(2, hidden, -1)
        self.recur = np.ascontiguousarray(np.concatenate([p["recur"], over], 2).transpose(0, 2, 1) / 2).astype(np.float32)
        self.out_bias = (bias[:, 1:] - bias[:, :1]).reshape(-1, 1).astype(np.float32)
        self.move = (p["move"] - p["move"][0, 0]).astype(np.float32)
        self.first = (p["first"] - p["first"][0]).astype(np.float32)
        # for the bound: into the first and other characters of each kind, from none, from its own, from others
        m, n = self.move, self.tags
        other = m[1:, 1:].copy()
        for k in range(0, n - 1, 2):
            other[k : k + 2, k + 1] = -np.inf
        column = lambda x: np.ascontiguousarray(x, np.float32)[:, None]
        self.none_first, self.none_rest = column(m[0, 1::2]), column(m[0, 2::2])
        self.begin_first, self.begin_rest = column(self.first[1::2]), column(self.first[2::2])
        self.any_first, self.any_rest = column(other[:, 0::2].max(axis=0)), column(other[:, 1::2].max(axis=0))
        self.first_rest, self.rest_rest = column(m[1::2, 2::2].diagonal()), column(m[2::2, 2::2].diagonal())
        self.leave = float(m[1:, 0].max())

    def gains(self, symbols: np.ndarray) -> np.ndarray:
        """Scores of all tags but none, over that of none, of symbols (row, time): (step, 2 * (tags - 1), row)."""
        rows, length = symbols.shape
        steps, hidden = length // 2, self.hidden
        pairs = np.ascontiguousarray((symbols[:, 0::2].astype(np.intp) * self.symbols + symbols[:, 1::2]).T)
        z = np.empty((2, self.recur.shape[1], rows), np.float32)
        y, scores = z[:, : 3 * hidden], z[:, 3 * hidden :]
        x, a = np.empty((2, 3 * hidden, rows), np.float32), np.empty((2, 3 * hidden, rows), np.float32)
        gates, i, o, g = y[:, : 2 * hidden], *(y[:, k * hidden : (k + 1) * hidden] for k in range(3))
        c, h = np.zeros((2, hidden, rows), np.float32), np.zeros((2, hidden, rows), np.float32)
        out = np.empty((steps, scores.shape[1], rows), np.float32)
        out[:] = self.out_bias
        for t in range(steps + 1):
            np.matmul(self.recur, h, out=z)
            if t:
                out[t - 1] += scores[0]
                out[steps - t] += scores[1]
            if t == steps:
                break
            np.take(self.inputs[0], pairs[t], axis=1, out=x[0], mode="clip")
            np.take(self.inputs[1], pairs[steps - 1 - t], axis=1, out=x[1], mode="clip")
            y += x
            np.abs(y, out=a)
            a += 1
            y /= a
            gates += 1  # twice the gates
            g -= c
            g *= i
            g *= 0.5
            c += g
            np.multiply(o, c, out=h)
        return out

    def hopeful(self, gains: np.ndarray) -> np.ndarray:
        """The rows whose best path may have a tag other than none: odd tags are first characters, even ones the others."""
        rows, kinds = gains.shape[2], self.tags // 2
        low = np.full((kinds, rows), -np.inf, np.float32)
        first, rest, new, part = low, low.copy(), np.empty_like(low), np.empty_like(low)
        any_, most = low[0].copy(), low[0].copy()
        from_first, from_rest = self.begin_first, self.begin_rest
        for own in gains.reshape(-1, kinds, 2, rows):
            np.add(first, self.first_rest, out=new)
            rest += self.rest_rest
            np.maximum(rest, new, out=rest)
            np.add(any_, self.any_rest, out=part)
            np.maximum(part, from_rest, out=part)
            np.maximum(rest, part, out=rest)
            rest += own[:, 1]
            np.add(any_, self.any_first, out=first)
            np.maximum(first, from_first, out=first)
            first += own[:, 0]
            np.maximum(first, rest, out=part)
            np.max(part, axis=0, out=any_)
            np.maximum(most, any_, out=most)
            from_first, from_rest = self.none_first, self.none_rest
        return np.flatnonzero((most + self.leave > 0) | (any_ > 0))

    def paths(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (row, time) by what gains() gives, and the scores of these tags over none."""
        n, rows, length = self.tags, gains.shape[2], 2 * len(gains)
        own = np.zeros((length, n, rows), np.float32)
        own[:, 1:] = gains.reshape(length, n - 1, rows)
        best = np.empty((length, n, rows), np.float32)
        best[0] = self.first[:, None] + own[0]
        ways = np.empty((n, n, rows), np.float32)
        for t in range(1, length):
            np.add(best[t - 1][:, None], self.move[:, :, None], out=ways)
            np.max(ways, axis=0, out=best[t])
            best[t] += own[t]
        tags = np.empty((length, rows), np.int8)
        tags[-1] = best[-1].argmax(axis=0)
        for t in range(length - 1, 0, -1):
            tags[t - 1] = (best[t - 1] + self.move[:, tags[t]]).argmax(axis=0)
        gain = own[np.arange(length)[:, None], tags, np.arange(rows)]
        return tags.T, gain.T

    def decode(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (row, time) of symbols (row, time), and the scores of these tags over none."""
        return self.paths(self.gains(symbols))
