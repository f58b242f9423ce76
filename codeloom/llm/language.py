"""Language identification by averaged hashed subword embeddings (operator 5)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm._shared import CACHE_BYTES, ENTRY_BYTES, U64, crc_mod, give_back, kept_rows, mix64, rows_of, scored, tidy

#: Bounds of the learning sample: documents a language, documents in all. Each counts with its whole text.
PER_LANG, MOST_DOCS = 1000, 8000
#: Languages that a model can have; more are an error.
MOST_LANGS = 2000
BUCKETS, DIMS = 1 << 15, 16
#: Words that are looked up together.
PART = 1 << 15
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def subword_groups(found: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, where those of each word begin, with the end) of the words' runs of two, three and four characters, ends marked, and of the whole words."""
    cps = np.frombuffer(("<" + "><".join(found) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    ends = np.cumsum(sizes)
    place = np.arange(len(cps)) - np.repeat(ends - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    out, h = [], mix64(cps + U64(0x9E3779B97F4A7C15))
    for n in (2, 3, 4):
        h = mix64(h[:-1] * U64(0xC2B2AE3D27D4EB4F) + cps[n - 1 :])
        out.append(((h[left[: len(h)] >= n] % U64(BUCKETS)).astype(np.int64), np.r_[0, np.cumsum(np.maximum(sizes - n + 1, 0))]))
    whole = np.add.reduceat(mix64(cps * U64(0x9E3779B97F4A7C15) + place.astype(U64) * U64(0x165667B19E3779F9)), ends - sizes)
    out.append(((mix64(whole) % U64(BUCKETS)).astype(np.int64), np.arange(len(found) + 1)))
    return out


def subwords(word: str) -> list[int]:
    """Buckets of the word's runs of two to four characters, ends marked, and of the word."""
    return np.concatenate([b for b, _ in subword_groups([word])]).tolist()


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket to one logit a language: embeddings times the linear layer
    bias: np.ndarray
    heat: float
    least: float  # calibrated confidence below which a document is rejected

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.heat
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def bag(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of ``found`` and how often each occurs."""
    each = Counter(found)
    times = np.fromiter(each.values(), np.int64, len(each))
    counts = np.zeros(BUCKETS, np.int64)
    for buckets, at in subword_groups(list(each)):
        counts += np.bincount(buckets, weights=np.repeat(times, np.diff(at)), minlength=BUCKETS).astype(np.int64)
    held = np.flatnonzero(counts)
    return held, counts[held]


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 5, miss: float = 0.0005, dims: int = DIMS) -> Model:
    """Stochastic gradient descent in numpy on bags of subwords (buckets, counts) and their languages.

    A tenth is kept apart to fit the temperature and the rejection level: the
    confidence that a share ``miss`` of rightly recognised bags stays under,
    0.5 at most.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    if not names:
        return Model(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    y_of = {n: k for k, n in enumerate(names)}
    ys = np.array([y_of[x] for x in langs], np.int64)
    shares = [(c / c.sum()).astype(np.float32) for _, c in bags]
    test = np.arange(len(bags)) // 2 % 10 == 9
    emb = rng.normal(0, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    lin, bias = np.zeros((dims, len(names)), np.float32), np.zeros(len(names), np.float32)
    order = np.flatnonzero(~test)
    steps, done = epochs * max(1, len(order) // 32 + 1), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            loss, g_emb, g_lin, g_bias = gradients(emb, lin, bias, [bags[i][0] for i in pick], [shares[i] for i in pick], ys[pick])
            now = np.float32(rate * (1 - done / steps))
            lin -= now * g_lin * (len(pick) / 4)
            bias -= now * g_bias
            for rows, share, g in g_emb:
                emb[rows] -= (now * len(pick)) * share[:, None] * g
            done += 1
    table = emb @ lin
    model = Model(names, table, bias.astype(np.float64), 1.0, 0.0)
    held = np.flatnonzero(test)
    if len(held):
        z = np.array([shares[i] @ table[bags[i][0]] for i in held]) + bias
        loss = []
        heats = np.geomspace(0.2, 5, 33)
        for heat in heats:
            model.heat = float(heat)
            loss.append(-np.log(model.probabilities(z)[np.arange(len(held)), ys[held]] + 1e-12).mean())
        model.heat = float(heats[int(np.argmin(loss))])
        p = model.probabilities(z)
        right = p.max(axis=1)[p.argmax(axis=1) == ys[held]]
        model.least = float(min(0.5, np.quantile(right, miss))) if len(right) else 0.0
    return model


def gradients(emb, lin, bias, rows: list[np.ndarray], shares: list[np.ndarray], ys: np.ndarray):
    """Mean cross-entropy of a batch and its gradients; that of the embeddings as (rows, shares, gradient of the average) a bag."""
    h = np.array([share @ emb[r] for r, share in zip(rows, shares, strict=True)])
    z = h @ lin + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(p[np.arange(len(ys)), ys] + 1e-30).mean())
    p[np.arange(len(ys)), ys] -= 1
    p /= len(ys)
    back = p @ lin.T
    return loss, [(r, share, g) for r, share, g in zip(rows, shares, back, strict=True)], h.T @ p, p.sum(axis=0)


def _features(batches):
    """The bag of each text and that of a short run of its words, picked by the text's hash."""
    for langs, keys, texts in rows_of(batches, "lang", "key", "text"):
        rows = []
        for lang, key, t in zip(langs, keys, texts, strict=True):
            w = words(t)
            if not w:
                continue
            rng = np.random.default_rng(key & 0xFFFFFFFFFFFF)
            n = int(rng.integers(2, 12))
            at = int(rng.integers(0, max(1, len(w) - n)))
            for part, found in enumerate((w, w[at : at + n])):
                held, counts = bag(found)
                rows.append((lang, key, part, held.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["lang", "key", "part", "rows", "counts"])


def learn(docs: DataFrame, keep=None, per_lang: int = PER_LANG, most: int = MOST_DOCS, seed: int = 5) -> Model:
    """Fit on at most ``per_lang`` documents of each language, ``most`` in all, that satisfy ``keep``.

    The documents are the first of their language by a hash of doc_id. Their
    whole texts count, as sparse counts of subword buckets, which is what the
    driver gets. Each language's number of documents, one row a language,
    sets how small a hash must be to come into question, so only about as
    many rows as are picked are shuffled, however common a language is. Rows
    without language, doc_id or letters teach nothing; without rows the model
    knows ``und`` only. More than ``MOST_LANGS`` languages raise ValueError.
    """
    keep = crc_mod("doc_id", 4) != 2 if keep is None else keep
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & keep).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    if not sizes:
        return fit([], [])
    each = max(2, min(per_lang, most // len(sizes)))
    # six deviations over what is wanted; of what passes, the first are picked
    share = [(r.lang, min(1.0, (each + 6 * each**0.5 + 20) / r.n)) for r in sizes]
    least = docs.sparkSession.createDataFrame(share, "lang string, share double")
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).join(F.broadcast(least), "lang").where(F.col("h") / 2.0**64 + 0.5 < F.col("share"))
    picked = rows.withColumn("key", F.xxhash64("text", "doc_id")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "key"))).where(F.col("k") <= each)
    got = picked.select("lang", "key", "text").mapInArrow(tidy(_features), "lang string, key long, part int, rows binary, counts binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["key"], r["part"]))
    bags, langs = [(np.frombuffer(r["rows"], "<u2"), np.frombuffer(r["counts"], "<u4")) for r in got], [r["lang"] for r in got]
    del got
    model = fit(bags, langs)
    del bags
    give_back()
    return model


def _scorer(model: Model):
    def score(batches):
        width = len(model.langs)
        each = ENTRY_BYTES + 8 * width + 8
        room = CACHE_BYTES
        sums = np.zeros((1 << 14, width + 1))
        at: dict[str, int] = {}

        def learn_words(new: list[str]) -> None:
            """Sums of the table over the words' subwords, and how many these are."""
            nonlocal sums, room
            low, high = len(at), len(at) + len(new)
            while high > len(sums):
                sums = np.vstack([sums, np.zeros_like(sums)])
            sums[low:high] = 0
            for buckets, cut in subword_groups(new):
                some = np.diff(cut) > 0
                rows = np.vstack([model.table[buckets].astype(np.float64), np.zeros((1, width))])
                sums[low:high, :width] += np.where(some[:, None], np.add.reduceat(rows, cut[:-1], axis=0), 0)
                sums[low:high, width] += np.diff(cut)
            at.update(zip(new, range(low, high), strict=True))
            room -= each * len(new) + sum(map(len, new))

        def totals(group: list[list[str]]) -> np.ndarray:
            """Sums over the words of each text."""
            nonlocal room
            if room < 0:
                at.clear()
                room = CACHE_BYTES
            new = [x for x in dict.fromkeys(chain.from_iterable(group)) if x not in at]
            if new:
                learn_words(new)
            n = np.fromiter(map(len, group), np.int64, len(group))
            rows = sums[np.fromiter(map(at.__getitem__, chain.from_iterable(group)), np.int64, int(n.sum()))]
            rows = np.vstack([rows, np.zeros((1, width + 1))])
            return np.where((n > 0)[:, None], np.add.reduceat(rows, np.cumsum(n) - n, axis=0), 0)

        for ids, held, texts in rows_of(batches, "doc_id", "held_out", "text"):
            lang, top, gone = [], [], []
            found, group, size = [], [], 0
            for k, t in enumerate(texts):
                w = words(t)
                # a text of many words is summed in parts that are the same in any batch
                parts = [w[a : a + PART] for a in range(0, len(w), PART)] or [w]
                for part in parts:
                    group.append((k, part))
                    size += len(part)
                    if size >= PART:
                        found += zip([g[0] for g in group], totals([g[1] for g in group]), strict=True)
                        group, size = [], 0
            if group:
                found += zip([g[0] for g in group], totals([g[1] for g in group]), strict=True)
            every = np.zeros((len(texts), width + 1))
            for k, total in found:
                every[k] += total
            for total in every:
                if not total[width]:
                    lang.append("und"), top.append(0.0), gone.append(True)
                    continue
                p = model.probabilities(total[:width] / total[width] + model.bias)
                best = int(p.argmax())
                lang.append(model.langs[best]), top.append(float(p[best])), gone.append(bool(p[best] < model.least))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(gone, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return score


def language(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``.

    A text is the average of the embeddings of its words' hashed subwords; a
    linear softmax scores it and a temperature calibrates the score. Texts
    that are null or without letters are ``und`` with score 0; those and
    texts under the calibrated confidence are ``rejected``. Whole texts count,
    of any length, and whole runs of letters; repeated rows give repeated
    results; equally likely languages come by name; no rows give no rows;
    other columns are ignored.
    """
    return scored(docs, _scorer(model), crc_mod("doc_id", 4) == 2 if held_out is None else held_out, "lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts that ``language`` rejects; all columns stay."""
    return kept_rows(docs, _scorer(model), "rejected", True)
