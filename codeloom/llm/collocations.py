"""Phrases whose words come together more often than apart (operator 11)."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm._shared import U64, WordHashes, discard, materialize, mix64, tidy

#: Cells in each of the two rows of the sketch of one phrase length, as a power of two: at least and at most; bytes of text for which one cell is made.
FEWEST, MOST, TEXT_A_CELL = 22, 24, 256
#: Cells in one row that is summed; characters of text looked at together.
BLOCK, CHUNK = 4096, 2 << 20
#: Words of the phrases, and phrases, that a task counts before it gives them out.
AUTOMATON_WORDS, ENTRIES = 1 << 20, 1 << 18

# A-Z in lower case, what ends a piece, what parts words.
_CLEAN = bytearray(range(256))
_CLEAN[0x41:0x5B] = _CLEAN[0x61:0x7B]
for _b in b".,;:!?\n\x0b\x0c\r":
    _CLEAN[_b] = 0x0A
_CLEAN[0x09] = 0x20
_CLEAN = bytes(_CLEAN)
_ODD = U64(0x9E3779B97F4A7C15)


def words_and_ends(texts: list[bytes]) -> list[str]:
    r"""The words of the texts in order, with ``\n`` wherever a piece ends."""
    flat = b"\n".join(texts).translate(_CLEAN).decode("utf-8", "replace").replace("\n", " \n ")
    return list(filter(None, flat.split(" ")))


def _by_lang(batches):
    """(lang, texts) of some millions of characters; a text is never cut, a chunk has one language."""
    waiting, size = defaultdict(list), Counter()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        for lang, text in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
            waiting[lang].append(text.as_py())
            size[lang] += len(waiting[lang][-1]) + 64
            if size[lang] >= CHUNK or len(size) >= 4096:
                for full in [lang] if size[lang] >= CHUNK else list(waiting):
                    yield full, waiting.pop(full)
                    del size[full]
    yield from waiting.items()


class Grams:
    """64-bit hashes of the runs of 1 to ``longest`` words of a chunk; a run lies in one piece."""

    def __init__(self, tokens: list[str], lang: str, cache: WordHashes, longest: int):
        self.word = np.fromiter(map(cache.__getitem__, tokens), U64, len(tokens))
        ends = np.flatnonzero(self.word == cache["\n"])
        place = np.arange(len(tokens))
        self.room = np.append(ends, len(tokens))[np.searchsorted(ends, place)] - place  # words from here to the end of the piece
        self.seed, self.longest = U64(cache["lang " + lang]), longest

    def __iter__(self):
        """(length, hash of the run that begins at each word; without meaning where there is no room for it)."""
        h = mix64(self.word + self.seed)
        yield 1, h
        for m in range(2, self.longest + 1):
            h = h[:-1] if len(h) else h
            h = mix64(h * _ODD + self.word[m - 1 :])
            yield m, h


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in either row: by its first ``bits`` bits and by the next."""
    return [(h >> U64(64 - bits)).astype(np.int64), (h >> U64(64 - 2 * bits)).astype(np.int64) & ((1 << bits) - 1)]


def _sketcher(bits: int, least: int, longest: int):
    kind = np.uint8 if least < 256 else np.uint32

    def sketch(batches):
        cache, cells = WordHashes(), np.zeros((2 * longest, 1 << bits), np.uint32)
        for lang, texts in _by_lang(batches):
            grams = Grams(words_and_ends(texts), lang, cache, longest)
            for m, h in grams:
                for row, at in enumerate(_cells(h[grams.room[: len(h)] >= m], bits)):
                    np.add.at(cells[2 * m - 2 + row], at, np.uint32(1))
        # a task that reaches the threshold alone need not say by how much
        for r in range(2 * longest):
            row = np.minimum(cells[r], least).astype(kind).reshape(-1, BLOCK)
            blocks = np.flatnonzero(row.any(axis=1))
            for some in np.array_split(blocks, -(-len(blocks) // 1024) or 1):
                if len(some):
                    yield pa.record_batch([pa.array(np.full(len(some), r), pa.int32()), pa.array(some, pa.int32()), pa.array([row[b].tobytes() for b in some], pa.binary())], names=["row", "block", "cells"])

    return sketch


def _adder(least: int):
    kind = np.uint8 if least < 256 else np.uint32

    def add(batches):
        sums = {}
        for batch in batches:
            for m, b, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now, more = sums.get((m, b)), np.frombuffer(cells, kind).astype(np.uint32)
                sums[m, b] = more if now is None else np.minimum(now + more, least)
        found = [(m, b, np.packbits(s >= least, bitorder="little").tobytes()) for (m, b), s in sums.items() if (s >= least).any()]
        if found:
            yield _batch(found, row=pa.int32(), block=pa.int32(), passed=pa.binary())

    return add


def _batch(rows: list[tuple], **kinds):
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _finder(passed, bits: int, longest: int):
    """Rows (bucket, lang, n, phrases, counts): the runs of words that the sketch lets pass, in themselves and their parts, in lists by their hash, with how often each came, once or more a task; without bucket, the number of words of a language.

    A task tells runs apart by 64-bit hashes until it gives their texts out.
    """

    def passes(m, h):
        one, two = (passed.value[2 * m - 2 + row][at >> 3] >> (at & 7).astype(np.uint8) for row, at in enumerate(_cells(h, bits)))
        return one & two & 1 == 1

    kinds = {"bucket": pa.int32(), "lang": pa.string(), "n": pa.int64(), "phrases": pa.string(), "counts": pa.binary()}

    def find(batches):
        cache, times, phrase, size, words = WordHashes(), defaultdict(dict), defaultdict(dict), 0, Counter()

        def listed():
            rows = []
            for lang, counts in ((k, c) for k, c in times.items() if c):
                text, hashes = phrase[lang], np.sort(np.fromiter(counts, U64, len(counts)))
                buckets, starts = np.unique(hashes >> U64(52), return_index=True)
                for bucket, some in zip(buckets.tolist(), np.split(hashes, starts[1:]), strict=True):
                    some = some.tolist()
                    rows.append((bucket, lang, None, "\n".join(map(text.__getitem__, some)), np.fromiter(map(counts.__getitem__, some), np.int64, len(some)).tobytes()))
            times.clear(), phrase.clear()
            return _batch(rows, **kinds)

        for lang, texts in _by_lang(batches):
            tokens = words_and_ends(texts)
            grams, ok, counts, text = Grams(tokens, lang, cache, longest), None, times[lang], phrase[lang]
            words[lang] += int((grams.room > 0).sum())
            for m, h in grams:
                here = passes(m, h) & (grams.room[: len(h)] >= m)
                ok = here if ok is None else here & ok[:-1][: len(h)] & ok[1 : len(h) + 1]
                at = np.flatnonzero(ok)
                found, first, n = np.unique(h[at], return_index=True, return_counts=True)
                for x, i, k in zip(found.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    if x in counts:
                        counts[x] += k
                    else:
                        counts[x], text[x] = k, " ".join(tokens[i : i + m])
                        size += m
            if size > AUTOMATON_WORDS or sum(map(len, times.values())) > ENTRIES:
                yield listed()
                size = 0
        if any(times.values()):
            yield listed()
        if words:
            yield _batch([(None, lang, n, None, None) for lang, n in words.items()], **kinds)

    return find


def _summer(least: int):
    """Rows (lang, phrase, f) of the phrases whose counts add up to ``least``, from lists that come bucket by bucket."""

    def told(sums):
        return _batch([(lang, p, f) for (lang, p), f in sums.items() if f >= least], lang=pa.string(), phrase=pa.string(), f=pa.int64())

    def add(batches):
        now, sums = None, Counter()
        for batch in batches:
            for bucket, lang, phrases, counts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "lang", "phrases", "counts")), strict=True):
                if bucket != now:
                    if any(f >= least for f in sums.values()):
                        yield told(sums)
                    now, sums = bucket, Counter()
                for p, k in zip(phrases.split("\n"), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    sums[lang, p] += k
        if any(f >= least for f in sums.values()):
            yield told(sums)

    return add


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of 1 to ``longest`` words that comes ``least`` times in a language, and (lang, n) of all its words.

    Two scans. The first adds phrases up in a sketch of cells, as many as the
    text asks for, but 2^``MOST`` a length at most; a cell holds the sum of all phrases
    hashed to it, so it never counts too few, and of a phrase's two cells the lesser counts. The second counts the phrases
    whose cell, and whose parts' cells, reach ``least``: candidates, more than
    there are but none too few; a full sketch only makes them more. Tasks
    give counts out in lists by hash, which are summed by the phrases themselves, so the number of scans does not grow with the
    phrases. Only the cells' bits (20 MB at most) ever come to the driver.
    """
    if least < 1 or longest < 1:
        raise ValueError("least and longest must be 1 or more")
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    bits = min(MOST, max(FEWEST, int(size * 100 / least / TEXT_A_CELL).bit_length()))
    cells = base.mapInArrow(tidy(_sketcher(bits, least, longest)), "row int, block int, cells binary")
    passed = cells.repartition("row", "block").mapInArrow(tidy(_adder(least)), "row int, block int, passed binary").toArrow()
    held = np.zeros((2 * longest, (1 << bits) // BLOCK, BLOCK // 8), np.uint8)
    for r, b, bits_ in zip(*(passed[c].to_pylist() for c in ("row", "block", "passed")), strict=True):
        held[r, b] = np.frombuffer(bits_, np.uint8)
    held = spark.sparkContext.broadcast(held.reshape(2 * longest, -1))
    found = materialize(base.mapInArrow(tidy(_finder(held, bits, longest)), "bucket int, lang string, n long, phrases string, counts binary"))
    held.destroy()
    lists = found.where("bucket is not null").repartition("bucket").sortWithinPartitions("bucket")
    every = lists.mapInArrow(tidy(_summer(least)), "lang string, phrase string, f long")
    counts = materialize(every.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f"))
    totals = materialize(found.where("bucket is null").groupBy("lang").agg(F.sum("n").alias("n")))
    discard(found)
    return counts, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000) -> DataFrame:
    r"""lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by how much more often their words come together than chance has it.

    Texts are put in lower case (A-Z only), parted into pieces at ``.,;:!?`` and line
    ends, pieces into words at spaces and tabs. n counts a language's words; a
    phrase of 2 to ``longest`` words of one piece with a >= ``least``
    occurrences, overlaps included, is a candidate. A cut after k words
    with l and r occurrences of its sides gives floor(1000 a n / (l r)); the
    least counts, that of the least k of equal ones. Candidates inside a
    longer one that comes at least ``share`` percent as often go, whether
    that one stays or not. Order: score, then a, both descending, then phrase by
    its UTF-8 bytes. Counts are exact (``phrase_counts``), products are decimals of 38 digits.

    Null texts count as empty, null languages as ``und``; rows are told apart by nothing, so
    repeated rows count each; texts of any length count whole; empty tables,
    and languages without candidates, give no rows. Other columns are ignored.
    """
    counts, totals = phrase_counts(docs, least, longest)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    phrases = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumn("over", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide("l") * wide("r"))
    best = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("c"))
    inner = phrases.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).withColumn("len", F.explode(F.sequence(F.lit(2), F.size("w") - 0)))
    inner = inner.where((F.col("at") + F.col("len") - 1 <= F.size("w")) & (F.col("len") < F.size("w"))).select("lang", part(F.col("at"), F.col("len")).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.select("lang", "phrase", "c.*").join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = materialize(ranked)
    discard(counts), discard(totals)
    return out
