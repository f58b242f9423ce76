"""Interval containment and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import utf16_len

#: Widths of the bins that spans lie in: powers of four, so offsets up to 4 ** 16.
LEVELS = 16


def containing(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Every point with every span of the same ``keys`` that holds it: ``points`` (at, ...) and ``spans`` (start, end, ...), half-open.

    A span lies in one or two bins about as wide as itself, a point in a bin
    of each width that spans of its key have; they meet in a bin. So a point
    meets the spans around it, not all of its key, and points of keys without spans go first.
    """
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    level = F.least(F.ceil(F.log2(length) / 2), F.lit(LEVELS)).cast("int")
    width = lambda n: F.expr(f"shiftleft(1L, 2 * {n})")
    s = spans.where(F.col("start") < F.col("end")).withColumn("level", level)
    levels = s.select(*keys, "level").distinct()
    s = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width("level")), F.floor((F.col("end") - 1) / width("level")))))
    p = points.join(levels, keys).withColumn("bin", F.floor(F.col("at") / width("level")))
    return p.join(s.hint("merge"), [*keys, "level", "bin"]).where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end"))).drop("level", "bin")


def line_spans(sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, start, end: where each line of a source begins and the next one does, in UTF-16 units, lines from 0.

    Beginnings are running sums of the lengths of the lines before, so the text is parted once; the end
    of the last line takes in the place after it.
    """
    parts = sources.select(*keys, F.posexplode(F.split("source", "\n", -1)).alias("line", "text"))
    sized = parts.select(*keys, F.col("line").cast("long").alias("line"), (utf16_len(F.col("text")) + 1).alias("n"))
    end = F.sum("n").over(Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.select(*keys, "line", (end - F.col("n")).alias("start"), end.alias("end"))


def calls_by_line(frames: DataFrame, calls: DataFrame) -> DataFrame:
    """(frame_id, line, position, call_key): the calls (frame_id, call_key, span_start) of each line of a frame (frame_id, source), in order of their spans.

    Lines count from 0. An offset after the end is on the last line, one before the beginning on the first.
    Offsets meet lines as points meet spans, without a look at the text.
    """
    spans = line_spans(frames, ["frame_id"])
    ends = spans.groupBy("frame_id").agg((F.max("end") - 1).alias("last"))
    points = calls.join(ends, "frame_id").select("frame_id", "call_key", "span_start", F.greatest(F.lit(0), F.least("span_start", "last")).alias("at"))
    place = F.row_number().over(Window.partitionBy("frame_id", "line").orderBy("span_start", "call_key")) - 1
    return containing(points, spans, ["frame_id"]).withColumn("position", place.cast("long")).select("frame_id", "line", "position", "call_key")


def overlapping(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Every span with every other of the same ``keys`` that shares a place with it, half-open; the other's ends as other_start and other_end.

    Of two that overlap, the one that starts later starts inside the other, so two joins of points with spans find all.
    """
    renamed = lambda df, a, b: df.withColumnsRenamed({"start": a, "end": b})
    spans, others = spans.where(F.col("start") < F.col("end")), others.where(F.col("start") < F.col("end"))
    later = containing(renamed(spans, "own_start", "own_end").withColumn("at", F.col("own_start")), others, keys)
    later = renamed(renamed(later, "other_start", "other_end").drop("at").withColumnsRenamed({"own_start": "start", "own_end": "end"}), "start", "end")
    sooner = containing(renamed(others, "other_start", "other_end").withColumn("at", F.col("other_start")), spans, keys).where(F.col("at") > F.col("start")).drop("at")
    return later.unionByName(sooner)


def innermost(points: DataFrame, spans: DataFrame, key: str, point_key: list[str]) -> DataFrame:
    """For each point (key, at) the span (key, start, end, span_id) of the same key that holds it and starts last."""
    hit = containing(points, spans.select(key, "start", "end", "span_id"), [key])
    return hit.groupBy(*point_key).agg(F.max(F.struct("start", "span_id")).alias("b")).select(*point_key, F.col("b.start").alias("start"), F.col("b.span_id").alias("span_id"))


def merge_ranges(ranges: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """Union of [start, end] ranges per key; ranges at most ``gap`` apart coalesce."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col("start") > seen + gap), 1).otherwise(0)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = ranges.withColumn("new", new).withColumn("island", island)
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _frame_spans(frames: DataFrame) -> DataFrame:
    return frames.select("file", *[c for c in frames.columns if c not in ("file", "start_line", "end_line")], F.col("start_line").alias("start"), (F.col("end_line") + 1).alias("end"))


def noted_lines(notes: DataFrame, frames: DataFrame) -> DataFrame:
    """Lines of each frame (file, start_line, end_line) that a note over a range (note_id, file, kind, start_line, end_line) covers.

    Ranges meet the frames they overlap before their lines are listed, so a
    range far longer than its frame costs no more than the frame. A missing line counts as 0.
    """
    ranged = notes.where("kind = 'range'").select("file", "note_id", F.coalesce("start_line", F.lit(0)).cast("long").alias("start"), (F.coalesce("end_line", F.lit(0)).cast("long") + 1).alias("end"))
    both = overlapping(ranged, _frame_spans(frames).select("file", "start", "end"), ["file"])
    return both.select("file", "note_id", F.explode(F.sequence(F.greatest("start", "other_start"), F.least("end", "other_end") - 1)).alias("line"))


def notes_in_frames(notes: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, note_id, index): notes after a line or over a range whose last line is in the frame, by the frame's line they come after, from 0."""
    points = notes.where(F.col("kind").isin("after-line", "range")).select("file", "note_id", F.coalesce("end_line", F.lit(0)).cast("long").alias("at"))
    return containing(points, _frame_spans(frames), ["file"]).select("frame_id", "note_id", (F.col("at") - F.col("start")).alias("index"))
