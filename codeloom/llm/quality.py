"""Quality by gated-attention multiple-instance learning over passages (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._shared import Adam, U64, WordHashes, crc_mod, give_back, labelled_sample, rows_of, scored, sigmoid, tidy

#: Words of one passage; bound of the learning sample: label rows a class. Each text counts with all its passages.
PASSAGE, PER_CLASS = 64, 1000
_KINDS = 12
WIDE = _KINDS * _KINDS + 6


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 11, np.int64)
    kind[128:] = 0
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \n\t\r", b".", b",;:", b"!?", b"#*$%&@^~", b"|", b"-_/\\", b"\"'()[]{}<>")):
        kind[list(chars)] = k
    return kind


_KIND = _byte_kinds()


def passages(text: str | None, cache: WordHashes) -> np.ndarray:
    """One row of features for each run of 64 words of the whole text, at least one row.

    Shares of pairs of adjacent character kinds, then: share of distinct
    words, mean word length, share of words equal to the one before, share of
    word pairs seen earlier in the text, words, and whether there are none.
    """
    words = (text or "").split()
    n = -(-len(words) // PASSAGE) or 1
    out = np.zeros((n, WIDE), np.float32)
    if not words:
        out[0, -1] = 1
        return out
    raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    part = np.cumsum(raw == 32) // PASSAGE
    kind = _KIND[raw]
    pairs = np.bincount(part[:-1] * _KINDS**2 + kind[:-1] * _KINDS + kind[1:], minlength=n * _KINDS**2).reshape(n, -1)[:n]
    out[:, : _KINDS**2] = pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True))
    h = np.fromiter(map(cache.__getitem__, words), U64, len(words))
    at = np.arange(len(words)) // PASSAGE
    size = np.bincount(at, minlength=n)
    distinct = [len(set(words[i : i + PASSAGE])) for i in range(0, len(words), PASSAGE)]
    two = h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]
    again = np.ones(len(two), bool)
    again[np.unique(two, return_index=True)[1]] = False
    tail = _KINDS**2
    out[:, tail] = np.array(distinct) / size
    out[:, tail + 1] = np.bincount(part, minlength=n)[:n] / size / 10
    out[:, tail + 2] = np.bincount(at[1:], weights=h[1:] == h[:-1], minlength=n) / size
    out[:, tail + 3] = np.bincount(at[1:], weights=again, minlength=n) / size
    out[:, tail + 4] = size / PASSAGE
    return out


class Model:
    """Standardised passages to tanh units, gated attention, logistic score."""

    def __init__(self, wide: int = WIDE, hidden: int = 32, gate: int = 16, seed: int = 4):
        r = np.random.default_rng(seed)
        w = lambda a, b: r.normal(0, a**-0.5, (a, b))
        self.mean, self.scale = np.zeros(wide), np.ones(wide)
        self.p = [w(wide, hidden), np.zeros(hidden), w(hidden, gate), w(hidden, gate), w(gate, 1)[:, 0], w(hidden, 1)[:, 0], np.zeros(1)]

    def forward(self, x: np.ndarray, sizes: np.ndarray):
        enc, b1, v, u, w, c, b = self.p
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ enc + b1)
        t, s = np.tanh(h @ v), sigmoid(h @ u)
        e = (t * s) @ w
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return sigmoid(z @ c + b[0]), (h, t, s, a, z, starts)

    def gradients(self, x, sizes, y, l2):
        enc, _, v, u, w, c, _ = self.p
        p, (h, t, s, a, z, starts) = self.forward(x, sizes)
        do = (p - y) / len(y)
        dz = np.repeat(do[:, None] * c, sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dts = de[:, None] * w
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ v.T + ds @ u.T) * (1 - h * h)
        xs = np.clip((x - self.mean) / self.scale, -6, 6)
        g = [xs.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ do, np.array([do.sum()])]
        return [gi + l2 * pi if pi.ndim == 2 else gi for gi, pi in zip(g, self.p, strict=True)]


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.003, l2: float = 1e-4, seed: int = 4) -> Model:
    """Learn from documents' passages and document labels; without both classes, a constant."""
    model = Model(seed=seed)
    if not len(y) or y.min() == y.max():
        model.p = [np.zeros_like(p) for p in model.p]
        model.p[-1][:] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    n = sum(map(len, bags))
    model.mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
    model.scale = np.maximum(np.sqrt(sum(((b - model.mean) ** 2).sum(axis=0) for b in bags) / n), 1e-3)
    adam, rng = Adam(model.p, rate), np.random.default_rng(seed)
    order = np.arange(len(bags))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in pick])
            adam.step(model.gradients(np.concatenate([bags[i] for i in pick]).astype(np.float64), sizes, y[pick], l2))
    return model


def _features(batches):
    cache = WordHashes()
    for ids, texts, ys in rows_of(batches, "doc_id", "text", "y"):
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([passages(t, cache).tobytes() for t in texts], pa.binary())], names=["doc_id", "y", "x"])


def learn(docs: DataFrame, labels: DataFrame, keep=None, per_class: int = PER_CLASS, seed: int = 4) -> Model:
    """Fit on every passage of at most ``per_class`` label rows a class that satisfy ``keep``.

    Rows without label or doc_id teach nothing; of repeated doc_ids see
    ``labelled_sample``. Without rows of both classes, as with empty tables,
    the model is a constant.
    """
    keep = crc_mod("doc_id", 3) != 1 if keep is None else keep
    got = labelled_sample(docs, labels, "quality", keep, per_class, seed).mapInArrow(tidy(_features), "doc_id long, y int, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    bags, y = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDE) for r in got], np.array([r["y"] for r in got], float)
    model = fit(bags, y)
    del got, bags
    give_back()
    return model


def _scorer(model: Model):
    def score(batches):
        cache = WordHashes()
        for ids, held, texts in rows_of(batches, "doc_id", "held_out", "text"):
            out, bags, n = [], [], 0

            def flush(bags, out):
                if bags:
                    out.extend(model.forward(np.concatenate(bags), np.array([len(b) for b in bags]))[0].tolist())

            for t in texts:
                bags.append(x := passages(t, cache))
                n += len(x)
                if n >= 8192:
                    flush(bags, out)
                    bags, n = [], 0
            flush(bags, out)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return score


def quality(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of ``docs``.

    Every passage of the whole text is encoded; gated attention weighs the
    encodings and the weighted sum is scored. Null and empty texts are one
    passage that says so; very long texts are scored whole, like any other;
    repeated rows give repeated results; no rows give no rows; other columns
    are ignored.
    """
    return scored(docs, _scorer(model), crc_mod("doc_id", 3) == 1 if held_out is None else held_out, "score double, predicted int")
