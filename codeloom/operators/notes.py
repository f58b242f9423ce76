"""Notes: the latest state of a log of changes, references, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import leaf, references, stripped
from codeloom.operators.lookup import containing_text

# The kinds of anchors.
ANCHOR_KINDS = ("file-start", "file-end", "after-line", "range")


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last change per key, without deleted ones; created_at is the first change's time.

    Two bounded aggregates (min and max_by) instead of a window: partial
    results combine before the shuffle.
    """
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min("ts").alias("created_at"))
    return last.where("not r.deleted").select(key, "created_at", *[F.col(f"r.{c}").alias(c) for c in rest if c != "deleted"])


def anchor_valid(file: Column, kind: Column, start: Column, end: Column) -> Column:
    """Whether an anchor has a file, a known kind and, but at a file's ends, lines from 1 in order."""
    return F.coalesce((F.length(file) > 0) & kind.isin(*ANCHOR_KINDS) & (kind.isin("file-start", "file-end") | ((start >= 1) & (end >= start))), F.lit(False))


def applied(notes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes after all ``changes`` in order of seq, rejected changes with a reason).

    ``notes``: id, anchor, text, createdAt, updatedAt; ``changes``: seq, op
    (``upsert`` or ``delete``), id, anchor, text, at. An upsert without id
    makes a note, with an id of its own; one with a known id replaces anchor
    and text and keeps the time of creation. Bad anchors and ids that are
    not, or no longer, known are rejected. Changes of an id are taken in
    order in one window over the id.
    """
    a = F.col("anchor")
    bad = (F.col("op") == "upsert") & ~anchor_valid(a["file"], a["kind"], a["startLine"], a["endLine"])
    asked = changes.withColumn("new", (F.col("op") == "upsert") & (F.coalesce("id", F.lit("")) == ""))
    asked = asked.withColumn("bad", bad).withColumn("id", F.when(F.col("new"), F.concat(F.lit("n"), F.sha2(F.concat_ws("/", F.col("seq").cast("string"), F.col("at")), 256))).otherwise(F.col("id")))
    held = notes.select("id", F.lit(True).alias("held"), "anchor", "text", "createdAt", "updatedAt")
    known = asked.join(held.select("id", "held"), "id", "left")
    order = Window.partitionBy("id").orderBy("seq")
    # an id lives until its first delete; nothing brings it back
    deleted = F.coalesce(F.max(F.col("op") == "delete").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    known = known.withColumn("reason", F.when(F.col("bad"), "bad anchor").when(~F.col("new") & (F.col("held").isNull() | deleted), "unknown note id"))
    rejected = known.where(F.col("reason").isNotNull()).select("seq", "op", "id", "reason")
    good = known.where(F.col("reason").isNull())
    last = good.groupBy("id").agg(F.max_by(F.struct("op", "anchor", "text", "at"), "seq").alias("c"), F.min_by("at", "seq").alias("first"))
    both = held.join(last, "id", "full")
    now = both.where(F.col("c").isNull() | (F.col("c.op") != "delete")).select(
        "id", F.coalesce("c.anchor", "anchor").alias("anchor"), F.when(F.col("c").isNull(), F.col("text")).otherwise(F.col("c.text")).alias("text"),
        F.when(F.col("held"), F.col("createdAt")).otherwise(F.col("first")).alias("createdAt"), F.coalesce("c.at", "updatedAt").alias("updatedAt"))
    return now, rejected


def listed(notes: DataFrame) -> DataFrame:
    """Notes by file, then first line (none counts as 0), then id."""
    return notes.orderBy(F.col("anchor.file"), F.coalesce(F.col("anchor.startLine"), F.lit(0)), "id")


def drifted(snippet: Column, end_line: Column, line: Column) -> Column:
    """Whether ``line``, the text at ``end_line``, is no longer the snippet but for white space at their ends.

    An anchor without snippet, or with an empty one, or without end line never
    drifts; one of blanks does when the line has other text. A line that is not there has drifted.
    """
    anchored = (F.length(snippet) > 0) & end_line.isNotNull()
    return F.when(anchored, F.coalesce(stripped(line) != stripped(snippet), F.lit(True))).otherwise(False)


def resolve(notes: DataFrame, targets: DataFrame, files: DataFrame | None = None, most: int = 25) -> DataFrame:
    """(note_id, position, reference, target_id): what ``[[...]]`` in notes stands for, null if nothing.

    ``targets``: target_id, title (its label). Of the first ``most`` targets
    that a search for the reference finds, the first whose title, leaf or end
    of id is the reference, else the first. ``[[file:p]]`` is the first file
    that is p or ends in it. References are made distinct before they are
    sought; each distinct one meets the targets whose id holds those of its
    three-letter runs that the fewest ids hold, in lower case.
    """
    found = notes.select("note_id", F.posexplode(references(F.col("text"))).alias("position", "reference")).withColumn("reference", stripped(F.col("reference")))
    wanted = found.select("reference").distinct()
    names = wanted.where(~F.col("reference").startswith("file:"))
    best = _first_hits(names, targets, most)
    if files is not None:
        asked = wanted.where(F.col("reference").startswith("file:")).withColumn("path", F.regexp_replace(stripped(F.substring("reference", 6, 1 << 30)), r"^\./", ""))
        ends = files.select("file", F.explode(_suffixes("file")).alias("path"))
        hit = asked.join(ends, "path").groupBy("reference").agg(F.concat(F.lit("file:"), F.min("file")).alias("target_id"))
        best = best.withColumn("target_id", F.col("target_id").cast("string")).unionByName(hit)
    return found.join(best, "reference", "left").select("note_id", F.col("position").cast("long").alias("position"), "reference", "target_id")


def _suffixes(path: str) -> Column:
    """A path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def _first_hits(names: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    label = F.col("title")
    ids = targets.select("target_id", label.alias("label"), F.lower(F.col("target_id").cast("string")).alias("folded")).distinct()
    hits = containing_text(names.withColumn("q", F.lower("reference")), ids, "q", "folded")
    in_leaf = F.contains(leaf(F.col("folded")), F.col("q"))
    ranked = hits.withColumn("k", F.row_number().over(Window.partitionBy("reference").orderBy(F.desc(in_leaf), "target_id"))).where(F.col("k") <= most)
    exact = (F.col("label") == F.col("reference")) | (leaf(F.col("label")) == F.col("reference")) | F.col("target_id").cast("string").endswith(F.col("reference"))
    return ranked.groupBy("reference").agg(F.min_by("target_id", F.struct(~exact, "k")).alias("target_id"))
