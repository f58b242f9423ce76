"""N-gram Jaccard join by MinHash banding (operator 8)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import U64, WordHashes, fresh, materialize, rows_of, shingles, tidy
from codeloom.llm.components import components

#: Texts (by count and by runs of words) that are verified together; a block of a larger group, of which two are.
GROUP_ROWS, BLOCK_ROWS, BLOCK_WORDS = 256, 512, 1 << 20


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at ``threshold`` meets with ``recall``.

    More rows a band mean fewer chance meetings; ``most`` bounds bands x rows.
    """
    best = (1, 1)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12))))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _signer(width: int, bands: int, rows: int, seed: int):
    def sign(batches):
        rng = np.random.default_rng(seed)
        mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)[:, None] * U64(2) + U64(1)
        add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None]
        cache = WordHashes()
        for ids, marks, texts in rows_of(batches, "doc_id", "text_key", "text"):
            keys, sizes, found = [], [], []
            for text in texts:
                s = shingles(text, cache, width)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                if not len(s):
                    found.append([])
                    continue
                low = np.full(bands * rows, U64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(s), 2048):
                    np.minimum(low, (s[at : at + 2048] * mul + add).min(axis=1), out=low)
                sig = (low >> U64(16)).reshape(bands, rows)
                band = np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
                for j in range(rows):
                    band = (band ^ sig[:, j]) * U64(0xD6E8FEB86659FD93)
                    band ^= band >> U64(32)
                found.append(band.view(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_key", "copy_key", "n_grams", "bands"])

    return sign


def _links(sets: list[np.ndarray], size: np.ndarray, common: np.ndarray, left: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach ``threshold``; pairs on one side only, unless all are left.

    Two texts share what their ``sets`` share and ``common`` of both more.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), n)
    gram, column = np.unique(np.concatenate(sets), return_inverse=True)
    keep = np.bincount(column, minlength=len(gram))[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = common[:, None] + common[None, :]
    wide = max(1, (1 << 22) // m)
    top = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, wide):
        a, b = np.searchsorted(column, [at, at + wide])
        part = np.zeros((m, min(wide, top - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        shared += part @ part.T
    hit = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(hit, False)
    if not left.all():
        hit &= left[:, None] != left[None, :]
    return hit


def _linked(ids: list[int], copies: list[int], hit: np.ndarray):
    """(id, linked texts, linked documents, least id reached) of every text with a link."""
    ids, copies = np.array(ids, np.int64), np.array(copies, np.int64)
    order = np.arange(len(ids))
    by_id = np.argsort(ids, kind="stable")
    label = np.empty_like(order)
    label[by_id] = order
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(ids)).min(axis=1, initial=len(ids)))
        if (new == label).all():
            break
        label = new
    some = hit.any(axis=1)
    return [x[some].tolist() for x in (ids, hit.sum(axis=1), hit @ copies, ids[by_id][label])]


_FOUND = "id long, texts long, docs long, root long, comp long, copies long, n_grams int, gone int, n_lead int, delta binary"
_FOUND_KINDS = [pa.int64()] * 6 + [pa.int32()] * 3 + [pa.binary()]
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _grouper(width: int, threshold: float):
    """Small groups are verified; members of larger ones become their difference from the group's first.

    A member is told by the runs that it has and the first has not, and the
    other way round (``delta``; ``gone`` counts the latter). Near copies
    differ by little, so this is what larger groups are verified on.
    """

    def group_up(batches):
        cache, now, group, lead = WordHashes(), None, [], None

        def verified():
            if len(group) < 2:
                return None
            sets = [g[1] for g in group]
            size = np.array([len(x) for x in sets], np.float64)
            got = _linked([g[0] for g in group], [g[2] for g in group], _links(sets, size, np.zeros(len(sets)), np.ones(len(sets), bool), threshold))
            n = len(got[0])
            return pa.record_batch([pa.array(c, k) for c, k in zip([*got, *[[None] * n] * 6], _FOUND_KINDS, strict=True)], names=_FOUND_NAMES)

        for comp, part, many, ids, texts, copies in rows_of(batches, "comp", "part", "many", "id", "text", "copies"):
            out = []
            for k in range(len(ids)):
                if (comp[k], part[k]) != now:
                    if group and (done := verified()):
                        yield done
                    now, group, lead, last = (comp[k], part[k]), [], None, None
                if ids[k] == last:  # another row of the same text
                    continue
                last = ids[k]
                grams = shingles(texts[k], cache, width)
                if not many[k]:
                    group.append((ids[k], grams, copies[k]))
                    continue
                if lead is None:  # the first stands in every part, and counts in its own
                    lead = grams
                    if part[k]:
                        continue
                gone = np.setdiff1d(lead, grams, assume_unique=True)
                delta = np.concatenate([gone, np.setdiff1d(grams, lead, assume_unique=True)])
                out.append((ids[k], None, None, None, comp[k], copies[k], len(grams), len(gone), len(lead), delta.tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _FOUND_KINDS, strict=True)], names=_FOUND_NAMES)
        if group and (done := verified()):
            yield done

    return group_up


def _block_verifier(threshold: float):
    """Links between two blocks of a group, or within one, from differences."""

    def verify(batches):
        now, group = None, []

        def out():
            size = np.array([g[3] for g in group], np.float64)
            common = np.array([g[5] / 2 - g[4] for g in group], np.float64)
            got = _linked([g[0] for g in group], [g[2] for g in group], _links([g[1] for g in group], size, common, np.array([g[6] for g in group], bool), threshold))
            return pa.record_batch([pa.array(c, pa.int64()) for c in got], names=["id", "texts", "docs", "root"])

        for comp, i, j, ids, copies, sizes, gone, leads, deltas, block in rows_of(batches, "comp", "i", "j", "id", "copies", "n_grams", "gone", "n_lead", "delta", "block"):
            for k in range(len(ids)):
                key = comp[k], i[k], j[k]
                if key != now:
                    if len(group) > 1:
                        yield out()
                    now, group = key, []
                group.append((ids[k], np.frombuffer(deltas[k], U64), copies[k], sizes[k], gone[k], leads[k], block[k] == i[k]))
        if len(group) > 1:
            yield out()

    return verify


def _classified(docs: DataFrame, threshold: float, width: int, recall: float, seed: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, label (of its class), class_id, copy_id, n_links, n_text_links, n_grams."""
    bands, rows = banding(threshold, recall)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    keys = materialize(base.mapInArrow(tidy(_signer(width, bands, rows, seed)), "doc_id long, text_key long, copy_key binary, n_grams int, bands array<long>"))
    reps = keys.groupBy("copy_key").agg(F.min("doc_id").alias("copy_id"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay
    banded = reps.select("id", F.explode("bands").alias("band"))
    lead = banded.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    stars = banded.join(lead, "band").where("id <> lead").select(F.col("id").alias("src"), F.col("lead").alias("dst"))
    groups = components(stars)
    members = groups.select("id", F.col("label").alias("comp")).join(reps.select("id", "copies", "n_grams", "row"), "id")
    blocks = lambda n, words, most: F.greatest(F.ceil(n / most), F.ceil(words / BLOCK_WORDS)).cast("int")
    sizes = members.groupBy("comp").agg(blocks(F.count("*"), F.sum("n_grams"), GROUP_ROWS).alias("parts"))
    members = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    here = F.when(F.col("id") == F.col("comp"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    members = members.select("comp", "id", "copies", (F.col("parts") > 1).alias("many"), F.col("row.doc_id").alias("of"), F.col("row.text_key").alias("text_key"), here.alias("here"))
    texts = base.join(members, base.doc_id.eqNullSafe(F.col("of")) & (base.text_key == members.text_key)).select("comp", F.explode("here").alias("part"), "many", "id", "text", "copies")
    dealt = texts.repartition("comp", "part").sortWithinPartitions("comp", "part", (F.col("id") != F.col("comp")), "id")
    found = materialize(dealt.mapInArrow(tidy(_grouper(width, threshold)), _FOUND))
    many = found.where(F.col("delta").isNotNull())
    sizes = many.groupBy("comp").agg(blocks(F.count("*"), F.sum(F.octet_length("delta") / 8), BLOCK_ROWS).alias("blocks"))
    many = many.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = many.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "copies", "n_grams", "gone", "n_lead", "delta", "block")
    dealt = spread.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id")
    verified = materialize(dealt.mapInArrow(tidy(_block_verifier(threshold)), "id long, texts long, docs long, root long"))
    small = found.where(F.col("delta").isNull())
    split = components(verified.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    labels = small.select("id", F.col("root").alias("label")).unionByName(split)
    counts = verified.groupBy("id").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs")).unionByName(small.select("id", "texts", "docs"))
    per_copy = reps.select("copy_key", "id", "copy_id", "copies").join(counts.join(labels, "id"), "id", "left").select(
        "copy_key", "copy_id", F.coalesce("label", "id").alias("label"), (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    per_copy = per_copy.join(per_copy.groupBy("label").agg(F.min("copy_id").alias("class_id")), "label")
    return keys.select("doc_id", "text_key", "copy_key", F.col("n_grams").cast("long").alias("n_grams")).join(per_copy, "copy_key").drop("copy_key")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.995, seed: int = 8) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, copy_id, n_links, n_text_links, n_grams.

    Documents link if the Jaccard similarity of their sets of ``width``-word
    runs is at least ``threshold``. ``copy_id`` is the least doc_id with the
    same set; ``class_id`` the least one of the connected group; ``n_links``
    counts linked documents, copies included, and ``n_text_links`` linked
    different sets. Pairs are sought with ``recall`` at ``threshold`` (more
    above it) and then verified on their full sets.

    Equal sets become one representative first. Band hashes name candidate
    groups. Groups of up to 256 sets are verified whole; of a larger one each
    text is sent once to be told by its difference from the group's first,
    and pairs of blocks of differences are verified by matrix products that
    emit one row a member and never a pair.

    Documents without words are copies of each other; null text is empty.
    Every row counts as a document of its own, with null or repeated doc_id
    too; ids of rows without doc_id count for class_id and copy_id only where
    no other has one (then null). No rows give no rows; other columns are
    ignored; very long texts count whole.
    """
    return _classified(docs, threshold, width, recall, seed).select("doc_id", "class_id", "copy_id", "n_links", "n_text_links", "n_grams")


def first_of_each_class(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.995, seed: int = 8) -> DataFrame:
    """``docs`` with one row of each class of near copies, that of the least doc_id; all columns stay.

    Rows are told apart by doc_id and text: different texts under one doc_id
    are compared like any others. Rows without doc_id come after those with
    one; of rows with the same doc_id and text, one stays. No rows give no rows.
    """
    rows = _classified(docs, threshold, width, recall, seed).select("doc_id", "text_key", "label")
    rows = materialize(rows)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("w"))
    gone = rows.join(first, "label").where(~(F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("text_key") == F.col("w.text_key"))))
    again = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    i, x, of, key = fresh(docs, "row_id", "row_key", "gone_id", "gone_key")
    wide = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(x, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = lambda df: df.select(F.col("doc_id").alias(of), F.col("text_key").alias(key)).distinct()
    same = lambda: F.col(i).eqNullSafe(F.col(of)) & (F.col(x) == F.col(key))
    left = wide.join(named(gone), same(), "left_anti")
    if not again.isEmpty():
        once = left.join(named(again), same(), "left_semi").dropDuplicates([i, x])
        left = left.join(named(again), same(), "left_anti").unionByName(once)
    return left.select(docs.columns)
