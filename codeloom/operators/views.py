"""The view a reader has opened, as rows, and bookmarks.

A view is a table of steps: view_id, path (array of ``call#choice``, the way
from the root), kind (``call`` or ``receiver``) and, for rows that stand for
an open list of receivers, kind ``fanout`` with the path ``[..., call]``.
Frames below a step are the rows whose path starts with its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(path: Column, step: Column) -> Column:
    """Whether ``path`` is ``step`` or leads through it."""
    return F.slice(path, F.lit(1), F.size(step)) == step


def _without(view: DataFrame, edits: DataFrame, step: Column | None, gone: Column) -> DataFrame:
    """``view`` without the rows that have ``gone`` against an edit whose path leads to them.

    Rows meet edits on the view and one start of their path, listed for each
    row, so an edit meets the rows below it, not all of its view. ``step``,
    if given, is the call that the edit names next, whatever its choice.
    ``gone`` sees kind, path and n, the length of the edit's path.
    """
    e = edits.select("view_id", F.col("path").alias("start"), *([step.alias("step")] if step is not None else [])).distinct()
    rows = view.select("view_id", "path", "kind").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.size("path")))).withColumn("start", F.slice("path", F.lit(1), F.col("n")))
    keys = ["view_id", "start"]
    if step is not None:
        rows, keys = rows.withColumn("step", F.substring_index(F.get("path", F.col("n")), "#", 1)), [*keys, "step"]
    hit = rows.join(e, keys, "left_semi").where(gone).select("view_id", "path", "kind").distinct()
    return view.join(hit, ["view_id", "path", "kind"], "left_anti").select(view.columns)


def collapse(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` without the steps named by ``edits`` (view_id, path, call), under any choice, and all below them."""
    return _without(view, edits, F.col("call").cast("string"), F.col("kind") != "fanout")


def clear_children(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` without anything below the frames named by ``edits`` (view_id, path); the frames themselves stay."""
    return _without(view, edits, None, F.size("path") > F.col("n"))


def expand(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` with the calls of ``edits`` (view_id, path, call, choice) open, each with nothing below it."""
    step = F.concat(F.col("path"), F.array(F.concat_ws("#", "call", F.col("choice").cast("string"))))
    return collapse(view, edits).unionByName(edits.select("view_id", step.alias("path"), F.lit("call").alias("kind")).distinct())


def set_choice(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` with another choice at calls that are open; what was below them goes. Calls that are not open stay so."""
    opened = view.where("kind = 'call'").select(
        "view_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.substring_index(F.element_at("path", -1), "#", 1).alias("call")).distinct()
    return expand(view, edits.join(opened, ["view_id", "path", "call"], "left_semi"))


def open_fanout(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` with the list of receivers of ``edits`` (view_id, path, call) open; one that is open stays as it is."""
    listed = edits.select("view_id", F.concat("path", F.array("call")).alias("path"), F.lit("fanout").alias("kind")).distinct()
    return view.unionByName(listed.join(view, ["view_id", "path", "kind"], "left_anti").select("view_id", "path", "kind"))


def close_fanout(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` without the lists of receivers of ``edits`` and all that is open in them."""
    return _without(view, edits, F.col("call").cast("string"), F.col("kind").isin("fanout", "receiver") | (F.size("path") > F.col("n") + 1))


def expand_receiver(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` with receivers (view_id, path, call, choice) open, many at a call, each with nothing below; their lists open too."""
    step = edits.select("view_id", F.concat("path", F.array(F.concat_ws("#", "call", F.col("choice").cast("string")))).alias("path"), F.lit("receiver").alias("kind")).distinct()
    return open_fanout(collapse_receiver(view, edits), edits).unionByName(step)


def collapse_receiver(view: DataFrame, edits: DataFrame) -> DataFrame:
    """``view`` without the receivers of ``edits`` and all below them; their lists stay open."""
    return _without(view, edits.withColumn("path", F.concat("path", F.array(F.concat_ws("#", "call", F.col("choice").cast("string"))))), None, F.lit(True))


def encoded(state: Column) -> Column:
    """A view's state as base64 of its JSON, for an address; null for none."""
    return F.base64(F.encode(F.to_json(state), "UTF-8"))


def decoded(code: Column, schema: str) -> Column:
    """What ``encoded`` gave; what is not base64 of such JSON is null, an empty view."""
    raw = F.try_to_binary(code, F.lit("base64"))
    return F.from_json(F.decode(raw, "UTF-8"), schema, {"mode": "PERMISSIVE"})


def bookmarked(entries: DataFrame, bookmarks: DataFrame, keys: list[str]) -> DataFrame:
    """The entries that are bookmarked."""
    return entries.join(bookmarks.select(*keys).distinct(), keys, "left_semi")


def add_bookmarks(bookmarks: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Both; one that is there stays as it is."""
    return bookmarks.unionByName(more.dropDuplicates(keys).join(bookmarks, keys, "left_anti"))


def remove_bookmarks(bookmarks: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return bookmarks.join(gone, keys, "left_anti")


def toggle_bookmarks(bookmarks: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Those that are there go, the others come."""
    return remove_bookmarks(bookmarks, asked, keys).unionByName(asked.dropDuplicates(keys).join(bookmarks, keys, "left_anti"))
