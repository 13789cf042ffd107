"""Hashed word features and FTRL-proximal logistic regression, for the classifiers of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_TOKEN = re.compile(r"[^\W_]+")
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


class WordHasher:
    """64-bit hashes of a text's words; remembers up to `limit` words."""

    def __init__(self, pattern: re.Pattern = _TOKEN, limit: int = 1 << 18):
        self.pattern, self.limit, self.known = pattern, limit, {}

    def __call__(self, text: str) -> np.ndarray:
        return self.hashes(self.words(text))

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for word in set(words).difference(known):
                known[word] = self.code(word)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def code(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word)


def gram_features(h: np.ndarray, bits: int, grams: int = 2, skips: int = 2) -> np.ndarray:
    """Hashed indices of words, of runs of 2 to `grams` words and of pairs with 1 to `skips` words between; with repeats."""
    shift = np.uint64(64 - bits)
    out = [(h * np.uint64(_ODD[0])) >> shift]
    run = h
    for n in range(2, grams + 1):
        run = run[:-1] * np.uint64(_ODD[1]) + h[n - 1 :]
        out.append((run * np.uint64(_ODD[0] ^ n)) >> shift)
    for gap in range(1, skips + 1):
        if len(h) > gap + 1:
            pair = h[: -gap - 1] * np.uint64(_ODD[2]) + h[gap + 1 :] * np.uint64(_ODD[3] ^ (gap << 8))
            out.append((pair * np.uint64(_ODD[0])) >> shift)
    return np.concatenate(out).astype(np.int32)


class Ftrl:
    """Logistic regression on binary features by FTRL-proximal: a learning rate a coordinate and exact zeros by L1.

    The bias is a coordinate of its own without L1.
    """

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def margin(self, at: np.ndarray) -> float:
        return self.bias() + float(self.weights(at).sum())

    def learn(self, at: np.ndarray, label: float, weight: float = 1.0) -> None:
        """One step on the row with the distinct features at."""
        w, b = self.weights(at), self.bias()
        g = weight * (sigmoid(b + w.sum()) - label)
        n = self.n[at]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] = n + g * g
        rate = ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z += g - rate * b
        self.bias_n += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that calibrate margins: logistic regression in one variable by Newton steps, smoothed labels."""
    pos, neg = float(label.sum()), float(len(label) - label.sum())
    t = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, v = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margin).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (v * margin * margin).sum() + 1e-3, (v * margin).sum(), v.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-7:
            break
    return a, b
