"""Document fingerprints by one-permutation MinHash (operator 3)."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import U64, WordHashes, mix64, rows_of, shingles, tidy

#: Bins of one fingerprint (a power of two) and stored low-order bits a bin.
BINS, BITS = 1024, 4
_PROBES = 4096


@lru_cache(1)
def _probes() -> np.ndarray:
    """For each attempt and empty bin, the bin to copy: a fixed two-universal choice."""
    t, i = np.meshgrid(np.arange(_PROBES, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    return (mix64(t * U64(0x9E3779B97F4A7C15) + i * U64(0xC2B2AE3D27D4EB4F) + U64(1)) % U64(BINS)).astype(np.int32)


def bins_of(grams: np.ndarray) -> np.ndarray:
    """The least hash of each bin of sorted ``grams``; empty bins filled by optimal densification.

    An empty bin follows its own fixed sequence of random bins to the first
    that was full before filling, so two sets agree in a filled bin with
    probability equal to their similarity. After all probes (sets of a few
    runs) the next full bin in circular order is taken.
    """
    where = (grams >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[where[first]], full[where[first]] = grams[first], True
    empty, source = np.flatnonzero(~full), np.arange(BINS)
    if len(empty) and len(first) > 1:
        at, step = 0, min(_PROBES, 2 * (BINS // len(first) + 1))
        while len(empty) and at < _PROBES:
            tried = _probes()[at : at + step][:, empty]
            good = full[tried]
            got, k = good.any(axis=0), good.argmax(axis=0)
            source[empty[got]] = tried[k[got], np.flatnonzero(got)]
            empty, at = empty[~got], at + step
    if len(empty):
        filled = np.flatnonzero(full)
        source[empty] = filled[np.searchsorted(filled, empty) % len(filled)]
    return out[source]


def packed(grams: np.ndarray) -> bytes:
    """The low-order bits of every bin, packed; no bytes for a set of no runs."""
    if not len(grams):
        return b""
    low = (bins_of(grams) & U64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1).ravel()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: the share of equal bins less chance agreement of their bits."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = np.count_nonzero(x >> 4 == 0) + np.count_nonzero(x & 15 == 0)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (same / BINS - chance) / (1 - chance))))


def _dealer(bounds: list[int]):
    """Rows to the range they belong to; the first row of each range also to the one before."""

    def deal(batches):
        up = np.array(bounds[::-1], np.int64)
        last = len(bounds) - 1
        heads = {b: (p - 1) % (last + 1) for p, b in enumerate(bounds)}
        for ids, texts in rows_of(batches, "doc_id", "text"):
            part = np.clip(last - np.searchsorted(up, np.array(ids, np.int64)), 0, last).tolist() if ids else []
            guest = [k for k, i in enumerate(ids) if i in heads]
            yield pa.record_batch(
                [
                    pa.array(part + [heads[ids[k]] for k in guest], pa.int32()), pa.array([False] * len(ids) + [True] * len(guest), pa.bool_()),
                    pa.array(ids + [ids[k] for k in guest], pa.int64()), pa.array(texts + [texts[k] for k in guest], pa.string()),
                ],
                names=["part", "guest", "doc_id", "text"],
            )

    return deal


def _marker(width: int):
    def mark(batches):
        cache = WordHashes()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        prev, done = None, None
        for parts, guests, ids, texts in rows_of(batches, "part", "guest", "doc_id", "text"):
            out = []
            for part, guest, i, text in zip(parts, guests, ids, texts, strict=True):
                if part == done:  # further rows of the guest's id
                    continue
                own = packed(shingles(text, cache, width))
                if prev and prev[0] == part:
                    _, pid, ptext, pown = prev
                    half = len(ptext) // 2
                    edited = ptext[: len(ptext) - half] + text[:half]
                    other = packed(shingles(edited, cache, width))
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((pid, len(ptext), sha, pown.hex(), other.hex(), likeness(pown, other), likeness(pown, own)))
                done = part if guest else None
                prev = None if guest else (part, i, text, own)
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return mark


def fingerprints(docs: DataFrame, width: int = 5, parts: int | None = None) -> DataFrame:
    """One row a document with its fingerprint, that of an edited text, and two likenesses.

    A fingerprint bins the hashes of the text's distinct ``width``-word runs
    once, fills empty bins by optimal densification and keeps 4 bits of each
    of 1024 bins, in hex. The edited text replaces the last half by the start
    of the next document in descending doc_id; the first follows the last.
    Texts cross the network once, in ranges of doc_id; neighbours across
    ranges come from sending each range's first row twice.

    Null text is empty; a text without words has an empty fingerprint, like
    only its equals (1.0, else 0.0). Rows without doc_id are left out; rows
    that repeat a doc_id follow each other in order of text. A single
    document is its own next. Other columns are ignored.
    """
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = parts or 8 * tasks  # several ranges a task, so that chance spreads them evenly
    cuts = base.agg(F.percentile_approx("doc_id", [(k + 1) / n for k in range(n)], F.lit(100 * n)).alias("q"), F.max("doc_id").alias("top")).head()
    bounds = sorted({*(cuts.q or []), cuts.top} - {None}, reverse=True) or [0]
    dealt = base.mapInArrow(tidy(_dealer(bounds)), "part int, guest boolean, doc_id long, text string")
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", "guest", F.desc("doc_id"), "text")
    return dealt.mapInArrow(tidy(_marker(width)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
