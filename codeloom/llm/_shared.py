"""What several operators share: shared storage, word hashes, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task's cache of words may take before it is emptied.
CACHE_BYTES = 40 << 20
#: What an entry takes besides the characters of its word.
ENTRY_BYTES = 190
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the last stage once, and a lost
    executor costs only its own unfinished tasks. The table goes with the
    application at the latest.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, system = _path(spark, path)
    system.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may still read it."""
    path = getattr(df, "_codeloom_path", None)
    if path:
        p, system = _path(df.sparkSession, path)
        system.delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_kept: dict = {}


def keep(key, make: Callable):
    """What ``make`` gives, held by the worker process under ``key`` until a task of another key begins."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy(mapper: Callable, key=None) -> Callable:
    """``mapper``, after which the worker gives its memory back, but for what ``keep`` holds under ``key``.

    Worker processes outlive tasks and stages; what one leaves behind would add to the next one's.
    """

    def run(batches):
        if key not in _kept:
            _kept.clear()
        try:
            yield from mapper(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return to the system what the process has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_mod(column, n: int):
    """crc32 of the decimal text of ``column``, modulo ``n``."""
    return F.crc32(F.col(column).cast("string")) % n


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to ``CACHE_BYTES``."""

    room = CACHE_BYTES

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        size = ENTRY_BYTES + len(word)
        if size < 1024:
            if self.room < size:
                self.clear()
                self.room = CACHE_BYTES
            self.room -= size
            self[word] = h
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)]


def shingles(text: str | None, cache: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words (split at white space).

    A text of fewer words has one run of all of them; a text without words, none.
    """
    words = (text or "").split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(cache.__getitem__, words), U64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, U64(len(h) if len(h) < width else width), U64)
    for j in range(min(width, len(h))):
        out = (out + h[j : j + n]) * _ODD[j % 5] ^ (out >> U64(29))
    return np.unique(mix64(out))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Each batch as Python lists, one per named column."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def ones(values, kind) -> pa.Array:
    return pa.array(values, type=kind)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: int, seed: int) -> DataFrame:
    """Documents (doc_id, text, y) of at most ``per_class`` label rows of each class.

    Rows are picked by a hash of doc_id, so the pick does not depend on file
    order. The picked ids number at most twice ``per_class``; that bound is
    what makes it right to broadcast them, and texts are read in one scan.
    Of texts that share a doc_id the one of the least hash is taken, and the
    greater label of labels that do.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    pick = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
    ids = pick(0).unionByName(pick(1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "y", "text")).alias("r")).select("doc_id", "r.y", "r.text")


def scored(docs: DataFrame, mapper, held_out, fields: str) -> DataFrame:
    """``mapper`` over (doc_id, text) of all documents; ``held_out`` is computed by Spark."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return base.mapInArrow(tidy(mapper), "doc_id long, held_out boolean, " + fields)


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def kept_rows(docs: DataFrame, scorer, column: str, dropped) -> DataFrame:
    """Rows of ``docs``, all columns, unless ``scorer`` gives them ``dropped`` in ``column``.

    The decision is made where the row is read, so nothing is shuffled.
    Repeated rows stay or go together; no rows give no rows; ``docs`` may
    have any other columns.
    """

    def run(batches):
        waiting = []

        def feed():
            for batch in batches:
                waiting.append(batch)
                n = batch.num_rows
                text = batch.column(batch.schema.get_field_index("text"))
                yield pa.record_batch([pa.array([None] * n, pa.int64()), pa.array([False] * n, pa.bool_()), text], names=["doc_id", "held_out", "text"])

        for got in scorer(feed()):
            mask = [x != dropped for x in got.column(got.schema.get_field_index(column)).to_pylist()]
            yield waiting.pop(0).filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
