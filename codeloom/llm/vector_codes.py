"""Codes of vectors by parts, from codebooks learned with Yinyang bounds (operator 13)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import discard, materialize, tidy
from codeloom.llm.inner_product import finite_vectors, matrix, padded

#: Groups of codebook entries that share a lower bound.
GROUPS = 4
#: What a bound in single precision may be off by.
LOOSE = 1e-6


def grouped(book: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each entry (parts x entries): a few rounds of Lloyd over the entries themselves."""
    parts, entries, _ = book.shape
    out = np.zeros((parts, entries), np.int64)
    for p in range(parts):
        x = book[p].astype(np.float64)
        centres = x[np.linspace(0, entries - 1, min(groups, entries)).astype(int)]
        for _ in range(rounds):
            out[p] = np.argmin(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
            centres = np.array([x[out[p] == g].mean(axis=0) if (out[p] == g).any() else centres[g] for g in range(len(centres))])
    return out


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    diff = x[:, None, :] - book[None]
    return np.einsum("ijk,ijk->ij", diff, diff)


class Bounds:
    """Of each part of each vector: its entry, at most how far that is (``upper``), at least how far the others of each group are (``lower``)."""

    def __init__(self, n: int, parts: int, groups: int):
        self.entry = np.zeros((n, parts), np.uint8)
        self.upper, self.lower = np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, groups), np.float32)


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, now: Bounds, drift: np.ndarray | None) -> int:
    """Move every part (n x parts x width, integers) to its nearest entry, the lower index of equal ones; ``now`` is changed. Returns the distances computed.

    ``drift`` is how far each entry has moved since the bounds held; None if
    they never did. A part whose upper bound stays below all lower bounds
    keeps its entry unseen; else its distance is taken again, and only groups
    whose bound still fails are scanned. Bounds may only err on the safe
    side; what is scanned is decided by integer squares.
    """
    done = 0
    for p in range(book.shape[0]):
        many, entry = int(group[p].max()) + 1, now.entry[:, p]
        upper, lower = now.upper[:, p].astype(np.float64), now.lower[:, p].astype(np.float64)
        if drift is None:
            rows, scan = np.arange(len(x)), np.ones((len(x), many), bool)
        else:
            moved = np.array([drift[p][group[p] == g].max(initial=0.0) for g in range(many)])
            lower = lower - np.pad(moved, (0, lower.shape[1] - many))
            upper = upper + drift[p][entry]
            rows = np.flatnonzero(upper >= lower[:, :many].min(axis=1))
            own = x[rows, p] - book[p][entry[rows]]
            upper[rows] = np.sqrt(np.einsum("ij,ij->i", own, own)) * (1 + LOOSE)
            done += len(rows)
            scan = lower[rows, :many] <= upper[rows][:, None]
            rows, scan = rows[scan.any(axis=1)], scan[scan.any(axis=1)]
        if len(rows):
            # the entry a part has stays in the run, whether its group is scanned or not
            big = np.iinfo(np.int64).max
            squares = np.full((len(rows), book.shape[1]), big)
            for g in range(many):
                at, these = np.flatnonzero(scan[:, g]), np.flatnonzero(group[p] == g)
                if len(at) and len(these):
                    squares[np.ix_(at, these)] = _squares(x[rows[at], p], book[p][these])
                    done += len(at) * len(these)
            if drift is not None:
                own = x[rows, p] - book[p][entry[rows]]
                squares[np.arange(len(rows)), entry[rows]] = np.einsum("ij,ij->i", own, own)
            old, best = entry[rows].copy(), np.argmin(squares, axis=1)
            here = squares[np.arange(len(rows)), best]
            squares[np.arange(len(rows)), best] = big
            far = np.sqrt(squares.astype(np.float64)) * (1 - LOOSE)
            for g in range(many):
                these = group[p] == g
                if not these.any():
                    lower[rows, g] = np.inf
                    continue
                least = np.where(squares[:, these] == big, np.inf, far[:, these]).min(axis=1)
                lower[rows, g] = np.where(scan[:, g], least, lower[rows, g])
                # an entry that is left goes back under its group's bound
                if drift is not None:
                    left = (old != best) & these[old] & ~scan[:, g]
                    lower[rows[left], g] = np.minimum(lower[rows[left], g], far[left, old[left]])
            entry[rows] = best
            upper[rows] = np.sqrt(here.astype(np.float64)) * (1 + LOOSE)
        now.upper[:, p] = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
        now.lower[:, p] = np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
    return done


def _parts(batch, dim: int, parts: int) -> np.ndarray:
    return matrix(batch.column(batch.schema.get_field_index("v")), dim).astype(np.int64).reshape(batch.num_rows, parts, dim // parts)


def _rounder(dim: int, book: np.ndarray, group: np.ndarray, drift: np.ndarray | None):
    """One round: the state after it, and in the last row of each batch what the batch adds to every entry."""
    parts, entries, width = book.shape
    groups = GROUPS

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, now = _parts(batch, dim, parts), Bounds(n, parts, groups)
            if drift is not None:
                get = lambda c, kind: np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), kind)  # noqa: B023, E731
                now.entry, now.upper, now.lower = get("entry", np.uint8).reshape(n, parts).copy(), get("upper", np.float32).reshape(n, parts).copy(), get("lower", np.float32).reshape(n, parts, groups).copy()
            assign(x, book, group, now, drift)
            sums = np.zeros((parts, entries, width + 1), np.int64)
            for p in range(parts):
                np.add.at(sums[p, :, :width], now.entry[:, p], x[:, p])
                sums[p, :, width] = np.bincount(now.entry[:, p], minlength=entries)
            told = [None] * (n - 1) + [sums.ravel()]
            packed = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "v")]
            yield pa.record_batch([*kept, packed(now.entry), packed(now.upper), packed(now.lower), pa.array(told, pa.list_(pa.int64()))], names=["vec_id", "label", "v", "entry", "upper", "lower", "sums"])

    return run


def _coder(dim: int, book: np.ndarray):
    def run(batches):
        for batch in batches:
            entry = batch.column(batch.schema.get_field_index("entry")).to_pylist()
            x, at = _parts(batch, dim, len(book)), np.frombuffer(b"".join(entry), np.uint8).reshape(-1, len(book))
            own = x - book[np.arange(len(book)), at.astype(np.int64)]
            error = np.einsum("ijk,ijk->i", own, own)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.record_batch([*kept, pa.array([e.hex() for e in entry], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: each vector as the numbers of its parts' codebook entries.

    Components count as floor(``scale`` * x), vectors are cut into ``parts``
    equal parts. A position's codebook begins as that part of the first ``entries`` rows by vec_id and
    goes through ``rounds`` rounds of Lloyd: every part to its nearest entry
    by squared distance (the lower index of equal ones), every entry that has
    parts to their componentwise floor of the mean; then parts are assigned again. Rounds
    carry Yinyang bounds with each row: one upper bound a part, one lower
    bound for each of ``GROUPS`` groups of entries; entries' moves loosen them,
    and only groups whose bound fails are scanned, in integers. Each round
    reads the table of the one before and writes its own; sums for the entries come with the
    same rows. Only sums for each entry, whose number is fixed, come to the driver.

    ``code`` has two hex digits a part; ``error`` is the squared distance over
    all parts, ``label_error`` its sum over the rows of equal ``label``, nulls
    together; ``codebooks_sha256`` digests the last entries' components.

    Vectors that are null or hold null or non-finite components are dropped. Rows without
    vec_id come last in the order and are coded like others; rows that repeat
    a vec_id count each, in order of their vectors. With fewer rows than
    ``entries`` the codebooks are smaller. Shorter vectors count as padded
    with zeros, all to a multiple of ``parts``. An empty table gives no rows;
    other columns are ignored. Components whose squared distances could pass 63 bits are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    rows = finite_vectors(vectors.select("vec_id", "label", "embedding"), scale)
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).head()
    if shape.dim is None:
        return spark.createDataFrame([], vectors.select("vec_id").schema).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    dim = -(-max(1, shape.dim) // parts) * parts
    if 4 * (shape.most or 0.0) ** 2 * dim >= 2**63 or (shape.most or 0.0) >= 2**31:
        raise ValueError("squared distances would not fit in 63 bits")
    state = materialize(rows.select("vec_id", "label", padded(F.col("v"), dim).cast("array<int>").alias("v")))
    seeds = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    width = dim // parts
    book = matrix(seeds, dim).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    group, drift = grouped(book), None
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", entry binary, upper binary, lower binary, sums array<bigint>"
    for turn in range(rounds + 1):
        new = materialize(state.mapInArrow(tidy(_rounder(dim, book, group, drift)), fields))
        discard(state)
        state = new
        if turn == rounds:
            break
        told = state.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
        sums = np.zeros(parts * book.shape[1] * (width + 1), object)
        for r in told:
            sums[r["at"]] = int(r.x)
        sums = sums.reshape(parts, book.shape[1], width + 1)
        was = book.copy()
        for p in range(parts):
            for e in range(book.shape[1]):
                if sums[p, e, width]:
                    book[p, e] = [int(s // sums[p, e, width]) for s in sums[p, e, :width]]
        drift = np.sqrt(((book - was).astype(np.float64) ** 2).sum(axis=2)) * (1 + LOOSE)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    coded = materialize(state.mapInArrow(tidy(_coder(dim, book)), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    discard(state)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded.label.eqNullSafe(sums.of)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
