"""A byte-level convolutional network in numpy: training on windows, batched application.

Texts are cut into overlapping windows of fixed length. Filters of several
widths slide over a window's bytes; as the input is one byte a place, a filter
is a table (offset, byte) -> weight and its answer a sum of lookups. Each filter
keeps its greatest answer in the window (max pooling, then ReLU).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WINDOW, OVERLAP = 256, 16
STRIDE = WINDOW - OVERLAP
#: Windows that are answered at a time.
TOGETHER = 512


def window_count(n_bytes: int) -> int:
    """Windows that cover a text of so many bytes; one for an empty text."""
    return max(1, -(-max(0, n_bytes - OVERLAP) // STRIDE))


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all texts with zeros after each, window starts in it, first window of each text)."""
    pad = b"\0" * WINDOW
    flat = np.frombuffer(b"".join(x for t in texts for x in (t, pad)), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-np.maximum(0, sizes - OVERLAP) // STRIDE))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]]) if len(texts) else first
    starts = np.repeat(begins, counts) + STRIDE * (np.arange(counts.sum()) - np.repeat(first, counts))
    return flat, starts, first


@dataclass
class Filters:
    """Filter tables by width, each (width, 256, filters), and a bias a filter."""

    tables: list[np.ndarray]
    bias: np.ndarray
    _pairs: list = field(default_factory=list, repr=False)

    @classmethod
    def fresh(cls, rng: np.random.Generator, widths: tuple[int, ...], filters: int) -> Filters:
        tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        return cls(tables, np.zeros(filters * len(widths), np.float32))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Answers (n, all filters) before ReLU and the place of each greatest, for training."""
        out, at = [], []
        for table in self.tables:
            width, _, filters = table.shape
            places = windows.shape[1] - width + 1
            answer = np.zeros((len(windows), places, filters), np.float32)
            for o in range(width):
                answer += table[o][windows[:, o : o + places]]
            best = answer.argmax(1)
            at.append(best)
            out.append(np.take_along_axis(answer, best[:, None], 1)[:, 0])
        return np.concatenate(out, 1) + self.bias, at

    def gradients(self, windows, at, grad) -> list[np.ndarray]:
        """Of the tables, given that of the answers before ReLU."""
        out, done = [], 0
        for table, best in zip(self.tables, at):
            width, _, filters = table.shape
            g = grad[:, done : done + filters]
            done += filters
            rows = np.arange(len(windows))[:, None]
            own = np.empty_like(table)
            for o in range(width):
                code = windows[rows, best + o].astype(np.int64) * filters + np.arange(filters)
                own[o] = np.bincount(code.ravel(), g.ravel(), 256 * filters).reshape(256, filters)
            out.append(own)
        return out

    def features(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """ReLU of the pooled answers of all windows, two bytes a lookup."""
        if not self._pairs:
            for table in self.tables:
                parts = [
                    (table[o][:, None, :] + table[o + 1][None, :, :]).reshape(65536, -1)
                    for o in range(0, len(table) - 1, 2)
                ]
                self._pairs.append((parts, table[-1] if len(table) % 2 else None))
        out = np.empty((len(starts), len(self.bias)), np.float32)
        for i in range(0, len(starts), TOGETHER):
            windows = flat[starts[i : i + TOGETHER, None] + np.arange(WINDOW)]
            pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
            done = 0
            for (parts, single), table in zip(self._pairs, self.tables):
                width, _, filters = table.shape
                places = WINDOW - width + 1
                answer = None
                for k, part in enumerate(parts):
                    more = part.take(pairs[:, 2 * k : 2 * k + places], axis=0)
                    answer = more if answer is None else np.add(answer, more, out=answer)
                if single is not None:
                    answer += single.take(windows[:, width - 1 :], axis=0)
                out[i : i + TOGETHER, done : done + filters] = answer.max(1)
                done += filters
        return np.maximum(out + self.bias, 0)


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (scale * m / (np.sqrt(v) + 1e-7)).astype(p.dtype)
