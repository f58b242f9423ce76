"""Toxicity by a factorization machine over hashed terms (operator 10)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from codeloom.llm._shared import CACHE_BYTES, ENTRY_BYTES, Adam, WordHashes, crc_mod, give_back, kept_rows, labelled_sample, rows_of, scored, sigmoid, tidy

#: Bound of the learning sample: label rows a class. Each text counts with all its terms.
PER_CLASS = 3000
#: Columns of one block of the table of pairs.
WIDE = 512
TERM = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


@dataclass
class Machine:
    """bias, and for each hashed term its weight and its factors."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, rows: list[int]) -> float:
        v = self.factors[rows]
        s = v.sum(axis=0)
        return self.bias + float(self.weights[rows].sum() + 0.5 * (s @ s - (v * v).sum()))


def _features(batches):
    cache = WordHashes()
    for texts, ys in rows_of(batches, "text", "y"):
        found = [np.unique(np.fromiter(map(cache.__getitem__, terms(t)), np.uint64)).view(np.int64) for t in texts]
        yield pa.record_batch([pa.array(ys, pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], names=["y", "terms"])


def chi_square(y: np.ndarray, df: np.ndarray, dp: np.ndarray) -> np.ndarray:
    """Association with the label of terms that ``df`` texts hold, ``dp`` of them labelled."""
    n, pos = len(y), float(y.sum())
    a, b, c, d = dp, df - dp, pos - dp, n - pos - df + dp
    return n * (a * d - b * c) ** 2 / np.maximum(df * (n - df) * pos * (n - pos), 1e-9)


def in_pairs(y: np.ndarray, row: np.ndarray, col: np.ndarray, m: int, alone: np.ndarray, least: float) -> np.ndarray:
    """Which of ``m`` terms have a partner such that both together tell more of the label than each alone.

    For each pair the texts fall into four groups, with both, one or none. The
    chi-square of the groups against the label, less those of the two terms,
    must reach ``least``. Pairs are counted by matrix products in blocks.
    """
    n, rate = len(y), float(y.mean())
    held = np.zeros((m, n), np.uint8)
    held[col, row] = 1
    # counted from the ones: a product would make numbers four times as wide of the whole table
    df, dp = np.bincount(col, minlength=m).astype(np.float32), np.bincount(col, weights=y[row], minlength=m).astype(np.float32)
    labelled = np.flatnonzero(y > 0)
    out = np.zeros(m, bool)

    def off(pos, size):
        return (pos - size * rate) ** 2 / (size * rate * (1 - rate) + 1)

    for i in range(0, m, WIDE):
        a, ap = held[i : i + WIDE].astype(np.float32), held[i : i + WIDE, labelled].astype(np.float32)
        for j in range(i, m, WIDE):
            both = a @ held[j : j + WIDE].astype(np.float32).T
            pos = ap @ held[j : j + WIDE, labelled].astype(np.float32).T
            n_i, n_j, p_i, p_j = df[i : i + WIDE, None], df[None, j : j + WIDE], dp[i : i + WIDE, None], dp[None, j : j + WIDE]
            gain = off(pos, both) + off(p_i - pos, n_i - both) + off(p_j - pos, n_j - both) + off(labelled.size - p_i - p_j + pos, n - n_i - n_j + both)
            gain -= alone[i : i + WIDE, None] + alone[None, j : j + WIDE]
            hit = gain >= least
            out[i : i + WIDE] |= hit.any(axis=1)
            out[j : j + WIDE] |= hit.any(axis=0)
    return out


def gradients(bias: float, w: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray):
    """Gradients of the mean logistic loss of a factorization machine over (row, column) ones, rows in order."""
    return _Sums(row, col, len(y), len(w)).gradients(bias, w, v, y)


class _Sums:
    """Sums by text and by term of the same ones, whose order is found once."""

    def __init__(self, row, col, n: int, m: int):
        order = np.argsort(col, kind="stable")
        self.n, self.m = n, m
        # each ends with the place of a row of zeros, which a text or term at the end without ones begins at
        self.col, self.rows_c = np.r_[col, m], np.r_[row[order], n]
        self.start = np.searchsorted(col[order], np.arange(m))
        self.used = np.bincount(col, minlength=m) > 0
        self.by_row, self.has = np.searchsorted(row, np.arange(n)), np.bincount(row, minlength=n) > 0

    @staticmethod
    def _add(x, at, starts, some):
        out = np.add.reduceat(np.vstack([x, np.zeros((1, x.shape[1]))])[at], starts, axis=0)
        out[~some] = 0
        return out

    def gradients(self, bias, w, v, y):
        dims = v.shape[1]
        sums = self._add(np.column_stack([v, (v * v).sum(axis=1), w]), self.col, self.by_row, self.has)
        s, q, lin = sums[:, :dims], sums[:, dims], sums[:, dims + 1]
        g = (sigmoid(bias + lin + 0.5 * ((s * s).sum(axis=1) - q)) - y) / self.n
        back = self._add(np.column_stack([g[:, None] * s, g]), self.rows_c, self.start, self.used)
        return g.sum(), back[:, -1], back[:, :dims] - back[:, -1:] * v


def fit(y: np.ndarray, bags: list[np.ndarray], least_df: int = 4, least_chi2: float = 12.0, least_pair: float = 45.0, common: float = 0.005, dims: int = 8, steps: int = 250, l2: float = 2e-3, seed: int = 10) -> Machine:
    """Learn from term hashes of texts and their labels.

    Terms enter if at least ``least_df`` texts hold them and their chi-square
    against the label reaches ``least_chi2``, or if they are in a pair that
    tells ``least_pair`` more than its terms do (``in_pairs``; terms that a
    share ``common`` of the texts hold are paired), so terms that mean
    something only together enter too. Without texts of both classes the
    machine is the base rate.
    """
    n, pos = len(y), float(y.sum())
    empty = Machine(float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else -20.0, np.empty(0, np.int64), np.empty(0), np.empty((0, dims)))
    if not n or pos in (0, n):
        return empty
    keys, col = np.unique(np.concatenate(bags), return_inverse=True)
    row = np.repeat(np.arange(n), [len(b) for b in bags])
    df = np.bincount(col, minlength=len(keys)).astype(float)
    chi2 = chi_square(y, df, np.bincount(col, weights=y[row], minlength=len(keys)))
    enter = (df >= least_df) & (chi2 >= least_chi2)
    paired = np.flatnonzero((df >= max(least_df, common * n)) & (df <= n - least_df))
    at = np.full(len(keys), -1)
    at[paired] = np.arange(len(paired))
    keep = at[col] >= 0
    enter[paired] |= in_pairs(y, row[keep], at[col[keep]], len(paired), chi2[paired], least_pair)
    chosen = np.flatnonzero(enter)
    if not len(chosen):
        return empty
    at = np.full(len(keys), -1)
    at[chosen] = np.arange(len(chosen))
    keep = at[col] >= 0
    row, col = row[keep], at[col[keep]]
    rng = np.random.default_rng(seed)
    bias, w, v = np.array([empty.bias]), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), dims))
    adam = Adam([bias, w, v], 0.05)
    sums = _Sums(row, col, n, len(chosen))
    for _ in range(steps):
        gb, gw, gv = sums.gradients(bias[0], w, v, y)
        adam.step([np.array([gb]), gw + l2 * w / 10, gv + l2 * v])
    return Machine(float(bias[0]), keys[chosen], w, v)


def learn(docs: DataFrame, labels: DataFrame, keep=None, per_class: int = PER_CLASS, seed: int = 10) -> Machine:
    """Fit on a sample of at most ``per_class`` label rows a class that satisfy ``keep``.

    Rows without label or doc_id teach nothing; of repeated doc_ids see
    ``labelled_sample``; copies count each; without rows of both classes, as
    with empty tables, the machine is the base rate.
    """
    keep = crc_mod("doc_id", 5) != 0 if keep is None else keep
    got = labelled_sample(docs, labels, "toxic", keep, per_class, seed).mapInArrow(tidy(_features), "y int, terms binary").toArrow()
    rows = sorted(zip(got["terms"].to_pylist(), got["y"].to_pylist(), strict=True))  # in an order that is the same each time
    del got
    model = fit(np.array([y for _, y in rows], float), [np.frombuffer(t, np.int64) for t, _ in rows])
    del rows
    give_back()
    return model


class _Rows(dict):
    """Word to its row in the machine, -1 for none, remembered up to ``CACHE_BYTES``."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index, self.room = index, CACHE_BYTES

    def __missing__(self, word: str) -> int:
        self.room -= ENTRY_BYTES + len(word)
        if self.room < 0:
            self.clear()
            self.room = CACHE_BYTES
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = r = self.index.get(h - (1 << 64) if h >> 63 else h, -1)
        return r


def _scorer(model: Machine):
    index = {int(k): r for r, k in enumerate(model.keys)}

    def score(batches):
        rows = _Rows(index)
        for ids, held, texts in rows_of(batches, "doc_id", "held_out", "text"):
            out = []
            for t in texts:
                hit = sorted({r for r in map(rows.__getitem__, terms(t)) if r >= 0})
                out.append(float(sigmoid(model.logit(hit))) if hit else float(sigmoid(model.bias)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return score


def toxicity(docs: DataFrame, model: Machine, held_out=None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of ``docs``.

    The score is a factorization machine over the presence of lower-case
    words, hashed to 64 bits: a weight for each and a product of factors for
    each pair, in time linear in the words. Null and empty texts get the base
    rate; very long texts are scored whole, like any other; repeated rows
    give repeated results; no rows give no rows; other columns are ignored.
    """
    return scored(docs, _scorer(model), crc_mod("doc_id", 5) == 0 if held_out is None else held_out, "score double, predicted int")


def clean(docs: DataFrame, model: Machine) -> DataFrame:
    """``docs`` without the texts that ``toxicity`` predicts to be toxic; all columns stay."""
    return kept_rows(docs, _scorer(model), "predicted", 1)
