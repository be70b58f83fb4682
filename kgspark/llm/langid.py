"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` UTF-8 bytes in both directions, labels every byte position with a distribution
over languages, and a document's probabilities are the mean over its positions. It is trained here, in numpy, by
backpropagation through time on a bounded sample of labelled rows: at most ``PER_LANG`` rows of each language (one from
each hash bucket of all of them), and ``DRAWS`` windows of each, from anywhere in the text. Both bounds are parameters.
Prediction reads every byte of every text.

Gates use the piecewise linear sigmoid and tanh, in training as in prediction. No feature but the bytes is read. Text
that is null, empty or without a letter is ``und`` with score 0. Without any labelled row everything is ``und``; with one
language only, everything with letters gets it. Ties go to the language that sorts first. Repeated rows get equal
results; of rows that share a doc_id one is learned from. A very long text is read in blocks of windows. An empty table
gives an empty result; columns other than doc_id, text and lang are not read, but for those to carry, which may not be
named lang_pred or score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import map_columns

WINDOW = 96
PER_LANG = 512
HIDDEN = 8
STEPS = 160
BATCH = 96
BLOCK_WINDOWS = 2048
DRAWS = 8
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _hard_sigmoid(x, out=None):
    out = np.multiply(x, np.float32(0.25), out=out)
    out += np.float32(0.5)
    return np.clip(out, 0, 1, out=out)


class Network:
    """Weights by direction d: embed[d] (3, 256, H) adds to gates z, r, n; recur[d] (3, H, H); out (2H, K), bias (K)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (2, 3, 256, hidden)).astype(f)
        self.recur = rng.normal(0, 0.6 / hidden**0.5, (2, 3, hidden, hidden)).astype(f)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(f)
        self.bias = np.zeros(len(langs), f)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.out, self.bias]

    def _direction(self, d: int, steps: np.ndarray, keep: bool):
        """Hidden states (T, B, H) for byte indices (T, B), in reading order; with keep, the values training needs."""
        length, width = steps.shape
        hidden = self.out.shape[0] // 2
        ez, er, en = self.embed[d]
        uz, ur, un = self.recur[d]
        h = np.zeros((width, hidden), np.float32)
        states = np.empty((length, width, hidden), np.float32)
        saved = []
        z, r, n, t = (np.empty((width, hidden), np.float32) for _ in range(4))
        for k in range(length):
            i = steps[k]
            if keep:
                z, r, n, t = (np.empty((width, hidden), np.float32) for _ in range(4))
            np.matmul(h, uz, out=z)
            np.take(ez, i, axis=0, out=t, mode="clip")
            z += t
            _hard_sigmoid(z, z)
            np.matmul(h, ur, out=r)
            np.take(er, i, axis=0, out=t, mode="clip")
            r += t
            _hard_sigmoid(r, r)
            rh = r * h
            np.matmul(rh, un, out=n)
            np.take(en, i, axis=0, out=t, mode="clip")
            n += t
            np.clip(n, -1, 1, out=n)
            np.subtract(h, n, out=t)
            t *= z
            new = states[k]
            np.add(n, t, out=new)
            if keep:
                saved.append((h, z, r, n, rh))
            h = new
        return states, saved

    def states(self, windows: np.ndarray, keep: bool = False):
        forward = np.ascontiguousarray(windows.T)
        backward = np.ascontiguousarray(forward[::-1])
        a, sa = self._direction(0, forward, keep)
        b, sb = self._direction(1, backward, keep)
        return a, b[::-1], (forward, backward, sa, sb)

    def label(self, windows: np.ndarray) -> np.ndarray:
        """Distributions (B, T, K) of every position of windows (B, T) of bytes."""
        a, b, _ = self.states(windows)
        hidden = a.shape[2]
        p = a @ self.out[:hidden]
        p += b @ self.out[hidden:]
        p += self.bias
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p.transpose(1, 0, 2)

    def gradients(self, windows: np.ndarray, mask: np.ndarray, target: np.ndarray):
        """Loss over labelled positions and its gradients, by backpropagation through time."""
        a, b, (forward, backward, sa, sb) = self.states(windows, keep=True)
        hidden = a.shape[2]
        both = np.concatenate([a, b], axis=2)
        p = both @ self.out + self.bias
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        m = mask.T[:, :, None].astype(np.float32) / max(1, mask.sum())
        cols = np.arange(len(target))
        loss = float(-(np.log(p[:, cols, target] + 1e-9) * m[:, :, 0]).sum())
        p[:, cols, target] -= 1
        p *= m
        flat = both.reshape(-1, 2 * hidden)
        d_out, d_bias = flat.T @ p.reshape(-1, p.shape[2]), p.sum(axis=(0, 1))
        d_states = p @ self.out.T
        d_embed, d_recur = np.zeros_like(self.embed), np.zeros_like(self.recur)
        for d, steps, saved, g in ((0, forward, sa, d_states[:, :, :hidden]), (1, backward, sb, d_states[::-1, :, hidden:])):
            uz, ur, un = self.recur[d]
            dh = np.zeros_like(saved[0][0])
            for k in range(len(steps) - 1, -1, -1):
                h, z, r, n, rh = saved[k]
                dh = dh + g[k]
                dn = dh * (1 - z) * ((n > -1) & (n < 1))
                dz = dh * (h - n) * (np.float32(0.25) * ((z > 0) & (z < 1)))
                drh = dn @ un.T
                dr = drh * h * (np.float32(0.25) * ((r > 0) & (r < 1)))
                d_recur[d, 0] += h.T @ dz
                d_recur[d, 1] += h.T @ dr
                d_recur[d, 2] += rh.T @ dn
                for gate, v in enumerate((dz, dr, dn)):
                    np.add.at(d_embed[d, gate], steps[k], v)
                dh = dh * z + drh * r + dz @ uz.T + dr @ ur.T
        return loss, [d_embed, d_recur, d_out, d_bias]

    def train(self, windows: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam over windows drawn from the sample, languages evenly."""
        rng = np.random.default_rng(seed)
        by_lang = [[t for t, y in zip(windows, labels, strict=True) if y == k] for k in range(len(self.langs))]
        first = [np.zeros_like(w) for w in self.weights()]
        second = [np.zeros_like(w) for w in self.weights()]
        losses = []
        for step in range(1, steps + 1):
            target = rng.integers(0, len(self.langs), BATCH)
            made, mask = np.zeros((BATCH, WINDOW), np.uint8), np.zeros((BATCH, WINDOW), bool)
            for k, y in enumerate(target):
                part = np.frombuffer(by_lang[y][rng.integers(len(by_lang[y]))], np.uint8)
                made[k, : len(part)], mask[k, : len(part)] = part, True
            loss, grads = self.gradients(made, mask, target)
            losses.append(loss)
            rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(self.weights(), grads, first, second, strict=True):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses


def sample(docs: DataFrame, per_lang: int = PER_LANG, draws: int = DRAWS) -> list[tuple[str, bytes]]:
    """(lang, window) from labelled rows that are not held out: at most per_lang rows a language, one a hash bucket, and
    as many windows of each as asked for, at hashed places of the whole text."""
    rows = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")))
    rows = rows.where("doc_id is not null and lang is not null and text is not null and text rlike '\\\\p{L}'")
    spread = F.xxhash64("doc_id", F.lit(3))
    keys = rows.select("doc_id", "lang", F.pmod(spread, F.lit(per_lang)).alias("bucket"), F.xxhash64("doc_id", F.lit(5)).alias("h"))
    best = keys.groupBy("lang", "bucket").agg(F.min("h").alias("h"))
    # At most per_lang rows a language.
    chosen = rows.withColumn("h", F.xxhash64("doc_id", F.lit(5))).withColumn("bucket", F.pmod(spread, F.lit(per_lang))).join(
        F.broadcast(best), ["lang", "bucket", "h"]
    )
    data = F.col("text").cast("binary")
    last = F.greatest(F.lit(1), F.octet_length("text") - WINDOW + 1)
    places = [F.pmod(F.xxhash64("doc_id", F.lit(9 + k)), last).cast("int") + 1 for k in range(draws)]
    parts = F.array(*(F.substring(data, at, F.lit(WINDOW)) for at in places))
    got = chosen.groupBy("lang", "bucket").agg(F.min(parts).alias("parts")).collect()
    return sorted((r["lang"], bytes(part)) for r in got for part in r["parts"])


def fitted(docs: DataFrame, per_lang: int = PER_LANG) -> Network:
    rows = sample(docs, per_lang)
    langs = sorted({lang for lang, _ in rows})
    net = Network(langs)
    if len(langs) > 1:
        net.train([part for _, part in rows], [langs.index(lang) for lang, _ in rows])
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label distribution over all positions of each (non-empty) text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros((len(texts), len(net.langs)), np.float64)
    lengths = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    last = np.cumsum(counts) - 1
    filled = np.full(len(flat), WINDOW)
    filled[last] = lengths - (counts - 1) * WINDOW
    for at in range(0, len(flat), BLOCK_WINDOWS):
        part = flat[at : at + BLOCK_WINDOWS]
        p = net.label(part)
        inside = np.arange(WINDOW)[None, :] < filled[at : at + len(part), None]
        sums = np.einsum("btk,bt->bk", p, inside.astype(np.float32))
        np.add.at(total, owner[at : at + len(part)], sums)
    return total / lengths[:, None]


def positions(net: Network, text: str) -> list[str]:
    """The label of every byte of a text."""
    data = text.encode("utf-8", "surrogatepass")
    out: list[str] = []
    for at in range(0, len(data), WINDOW):
        part = np.zeros((1, WINDOW), np.uint8)
        part[0, : len(data[at : at + WINDOW])] = np.frombuffer(data[at : at + WINDOW], np.uint8)
        out += [net.langs[k] for k in net.label(part)[0].argmax(axis=1)[: len(data[at : at + WINDOW])]]
    return out


def predict(docs: DataFrame, net: Network, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred and score of every document row."""

    def make():
        def f(texts):
            data = [t.encode("utf-8", "surrogatepass") if t and any(map(str.isalpha, t)) else b"" for t in texts]
            lang, score = [UNKNOWN] * len(data), [0.0] * len(data)
            some = [k for k, t in enumerate(data) if t]
            if some and net.langs:
                p = document_probabilities(net, [data[k] for k in some])
                for k, best, row in zip(some, p.argmax(axis=1), p, strict=True):
                    lang[k], score[k] = net.langs[best], float(min(1.0, row[best]))
            return lang, score

        return f

    return map_columns(docs, ["text"], "lang_pred string, score double", make, carry)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document row."""
    found = predict(docs, fitted(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
