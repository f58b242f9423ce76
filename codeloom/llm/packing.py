"""Best-fit packing of token pieces into sequences (operator 7)."""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm._shared import discard, keep, materialize, tidy

CAPACITY, CLOSING_ID = 4096, 1
#: Pieces that a task numbers, about.
SWEPT = 1 << 16
#: Characters that are encoded at once.
CHARS = 1 << 22
#: Bytes of runs that a worker learns before it forgets those it has not met since as many before, and what a run takes besides its characters and ids.
HELD_BYTES, RUN_BYTES = 80 << 20, 180
#: Marks that such a vocabulary always parts from a letter before them.
TAILS = frozenset(",.;:!?")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stands_alone(vocabulary: str) -> bool:
    """Whether runs between spaces have the ids they have in a text, in any case, and marks part from letters before them.

    True of a vocabulary whose normaliser makes white space single spaces and
    letters small, whose rule to part words keeps letters, each number and
    the rest apart and drops white space, and whose added tokens begin "<|".
    """
    with open(vocabulary, encoding="utf-8") as f:
        told = json.load(f)
    normal, before = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps = [n["type"] for n in normal.get("normalizers", [normal]) if n]
    split = next((p for p in before.get("pretokenizers", [before]) if p.get("type") == "Split"), {})
    rule = split.get("pattern", {}).get("Regex", "")
    return (
        "Lowercase" in steps and "Replace" in steps and rule.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and split.get("behavior") == "Removed" and bool(split.get("invert"))
        and all(t["content"].startswith("<|") for t in told.get("added_tokens", []))
    )


class Encoder:
    """Texts to ids by the runs between their spaces, where the vocabulary lets runs stand alone; else text by text.

    The different runs of many texts are found by Arrow and looked up once
    each; their ids, little-endian bytes, are then dealt to all places by
    numpy. A run that is not remembered is put together from a word and the
    mark after it; words that are not remembered are tokenized together,
    parted by spaces, and told apart by where their tokens start.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.by_run, self.room = stands_alone(vocabulary), HELD_BYTES
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _tokenize(self, words: list[str]) -> None:
        plain = [r for r in words if "<|" not in r]  # else special tokens may be part of it
        groups = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        for group, got in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            sizes = np.fromiter(map(len, group), np.int64, len(group)) + 1
            cuts = np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), np.cumsum(sizes) - sizes).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            for run, lo, hi in zip(group, cuts, [*cuts[1:], len(got.ids)], strict=True):
                self.known[run] = raw[4 * lo : 4 * hi]
        for run in (r for r in words if "<|" in r):
            self.known[run] = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, runs: list[str]) -> list[str]:
        """Ids of new ``runs``; returns all that are known since, words of runs included."""
        known, older = self.known, self.older
        built, words = [], {}
        for run in runs:
            got = older.get(run)
            if got is not None:
                known[run] = got
                continue
            word, tail = run, ""
            if run[-1] in TAILS and run[-2:-1].isalpha() and run.isascii() and "<|" not in run:
                word, tail = run[:-1], run[-1]
                built.append((run, word, tail))
            for part in (word, tail):
                if part not in known:
                    got = older.get(part)
                    if got is not None:
                        known[part] = got
                    else:
                        words[part] = None
        if words:
            self._tokenize(list(words))
        for run, word, tail in built:
            known[run] = known[word] + known[tail]
        return [*runs, *words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin, with their end."""
        if not self.by_run:
            got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *got]), np.cumsum([0, *map(len, got)])
        if self.room < 0:
            self.older, self.known, self.room = self.known, {"": b""}, HELD_BYTES
        # ids do not depend on case; only in plain texts are small letters sure to leave the rest alone
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        split = pc.split_pattern(pc.replace_substring(pc.if_else(plain, pc.ascii_lower(texts), texts), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [r for r in runs if r not in self.known]
        learned = self._learn(new) if new else []
        found = list(map(self.known.__getitem__, runs))
        for run in learned:
            if len(run) > 48:
                self.known.pop(run, None)
            else:
                self.room -= RUN_BYTES + len(run) + len(self.known[run])
        own = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy()
        n = own[which]
        after = np.r_[0, np.cumsum(n)]
        take = np.arange(after[-1]) + np.repeat((np.cumsum(own) - own)[which] - after[:-1], n)
        return np.frombuffer(b"".join(found), "<u4")[take], after[split.offsets.to_numpy()]


def _pieces(vocabulary: str | None, capacity: int):
    def cut(batches):
        path = vocabulary or default_vocabulary()
        encoder = keep(("encoder", vocabulary), lambda: Encoder(path))  # so later tasks need not learn again
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            chars = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())]
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(chars, chars[at] + CHARS)) - 1)
                tokens, cuts = encoder.encode(texts[at:to])
                out = []
                for i, first, last in zip(ids[at:to], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    raw = tokens[first:last].tobytes() + closing
                    for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[lo : lo + 4 * capacity]
                        out.append((i, k, lo // 4, len(part) // 4, crc32(part)))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                at = to

    return cut


def carried(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """What the ranges left over, ``(part, pieces, slots)``, swept on from range to range.

    Moves (part, first rank, of, last rank, n, number): ``n`` pieces of
    ``part`` from ``first rank`` upwards take the slots of the range ``of``
    from ``last rank`` downwards; pairs are numbered on from ``number``. There
    are at most twice as many moves as ranges.
    """
    stack, moves, number = [], [], 0
    for part, pieces, slots in sorted(left):
        done = 0
        while done < pieces and stack:
            of, held = stack.pop()
            take = min(held, pieces - done)
            moves.append((part, done, of, held - 1, take, number))
            number, done = number + take, done + take
            if held > take:
                stack.append((of, held - take))
        if slots:
            stack.append((part, slots))
    return moves


def moves_of(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over ``counts``, the number of pieces of each length, without a look at single pieces.

    Moves (length, rank, n, sequence, each, offset): of the pieces of
    ``length`` those from ``rank``, ``n`` of them, go into the sequences from
    ``sequence`` upwards, ``each`` into one, the first at ``offset``.
    Sequences with equal gaps, numbered one after another, are one run; a
    length adds two runs at most and a run takes a length once, and a
    sequence holds few different lengths. So the moves are bounded by
    ``capacity``, whatever the number of pieces.
    """
    runs, gaps, moves, opened = defaultdict(list), [], [], 0

    def leave(gap, sequence, n):
        if gap and n:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((sequence, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                sequence, held = runs[gap].pop()
                if not runs[gap]:
                    del gaps[at]
            else:
                gap, sequence, held = capacity, opened, -(-left // (capacity // length))
                opened += held
            each = gap // length
            full = min(held, left // each)
            if full:
                moves.append((length, rank, full * each, sequence, each, capacity - gap))
                leave(gap - each * length, sequence, full)
                rank, left = rank + full * each, left - full * each
            if full < held:
                if left:  # fewer than a sequence takes
                    moves.append((length, rank, left, sequence + full, left, capacity - gap))
                    leave(gap - left * length, sequence + full, 1)
                    full, left = full + 1, 0
                leave(gap, sequence + full, held - full)
    return moves


def _seats(moves):
    """Rows (id, length, sequence, offset) of pieces (id, length, rank), by the move that takes their rank."""

    def seat(batches):
        length, rank, _, sequence, each, offset = moves.value
        starts = (length << 40) + rank
        for batch in batches:
            ids, own, k = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "length", "rank"))
            m = np.searchsorted(starts, (own << 40) + k, "right") - 1
            k = k - rank[m]
            columns = [ids, own, sequence[m] + k // each[m], offset[m] + k % each[m] * own]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["id", "length", "sequence", "offset"])

    return seat


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """(id, sequence_id, offset) of all ``pieces`` (id, length) of at most half of ``capacity``, given with the longer ones, which open sequences.

    Only the number of pieces of each length comes to the driver, where
    ``moves_of`` packs them by number. Pieces are numbered in their length,
    part by part, so a common length is no hot key; their number tells which
    place they take. A sequence bears the id of the piece that opened it.
    """
    spark = pieces.sparkSession
    dealt = pieces.select("id", F.col("length").cast("long").alias("length"), F.shiftright("id", 33).alias("part"))  # the part that gave the id
    told = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    told = materialize(told.select("length", "part", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")))
    counts = {r.length: r.n for r in told.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length, at most capacity
    if not counts:
        return spark.createDataFrame([], "id long, sequence_id long, offset long")
    moves = spark.sparkContext.broadcast(np.array(sorted(moves_of(counts, capacity)), np.int64).T.copy())
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("id")) - 1
    ranked = dealt.repartition(1 + sum(counts.values()) // SWEPT, "length", "part").withColumn("own", own).join(told.hint("merge"), ["length", "part"])  # as many rows as parts and lengths, so not to all
    seats = materialize(ranked.select("id", "length", (F.col("own") + F.col("before")).alias("rank")).mapInArrow(tidy(_seats(moves)), "id long, length long, sequence long, offset long"))
    moves.destroy()
    discard(told)
    openers = seats.where("offset = 0").select("sequence", F.col("id").alias("sequence_id"))
    return seats.where(F.col("length") <= capacity // 2).join(openers, "sequence").select("id", "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenized once and their pieces written. Pieces longer than
    half of ``capacity`` open sequences. All others, from the longest down,
    take the smallest gap that holds them (best fit decreasing), found from
    the number of pieces of each length alone; only these, at most
    ``capacity`` numbers, come to the driver.

    Null and empty texts are the closing id alone; documents longer than
    ``capacity`` ids are cut, others never; repeated rows are packed each;
    rows without doc_id are packed under null; other columns are ignored; no
    rows give no rows. ``vocabulary`` is the path of a tokenizer file.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = tidy(_pieces(vocabulary, capacity), ("encoder", vocabulary))
    pieces = base.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces.withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    first = pieces.where(F.col("length") > capacity // 2).withColumn("sequence_id", F.col("id")).withColumn("offset", F.lit(0).cast("long"))
    others = pieces.where(F.col("length") <= capacity // 2).join(_placed(pieces, capacity), "id")
    return first.select(columns).unionByName(others.select(columns))
