"""The query surface over one snapshot of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import byte_to_utf16, clean_path, excerpt, lines, utf16_len
from codeloom.operators.dispatch import chosen, fan_in
from codeloom.operators.intervals import containing
from codeloom.operators.lookup import lookup, lookup_names, search, search_names
from codeloom.operators.types import places_in_files


class UnknownTarget(KeyError):
    """No target, or none with a body, under an id."""


def frames(targets: DataFrame, calls: DataFrame, order: str = "ast_order") -> DataFrame:
    """Every target that has a body, as one row with its calls: a struct each, in source order.

    ``targets``: target_id, title, file, start_byte, end_byte, start_line,
    end_line, has_body, source (of its file); ``calls``: caller_id,
    call_key, ast_order, name_start and name_end (bytes of the file), and any
    other columns, which the structs keep. Spans come out in UTF-16 units of the
    target's own source. Calls cross the network once, by caller.
    """
    bodies = targets.where("has_body").withColumn("body", F.substring(F.encode("source", "UTF-8"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")).cast("string")).drop("source")
    rest = [c for c in calls.columns if c not in ("caller_id", "name_start", "name_end", order)]
    inside = calls.groupBy("caller_id").agg(F.sort_array(F.collect_list(F.struct(order, "name_start", "name_end", *rest))).alias("raw"))
    whole = bodies.join(inside, bodies.target_id == inside.caller_id, "left").drop("caller_id")
    at = lambda c, name: byte_to_utf16(F.col("body"), c[name] - F.col("start_byte"))
    spans = F.transform(F.coalesce("raw", F.slice("raw", 1, 0)), lambda c: F.struct(at(c, "name_start").alias("span_start"), at(c, "name_end").alias("span_end"), *[c[n].alias(n) for n in rest]))
    empty = F.array().cast(whole.select(spans.alias("x")).schema["x"].dataType)
    return whole.select("target_id", "title", "file", "start_line", "end_line", F.col("body").alias("source"), F.coalesce(spans, empty).alias("calls"))


class Engine:
    """describe, files, lookup, frame, frame_for_call, search, type_info and usages as DataFrames.

    ``tables`` maps table names to DataFrames: source_files, targets,
    call_sites, and where there are some candidates, receivers, templates,
    usages, idents. ``language`` is ``go`` or ``ts``, which look names up and
    rank searches by rules of their own. Filters on ids reach the Parquet
    scans of the snapshot. An id that is unknown, or has no body to show,
    raises ``UnknownTarget``.
    """

    def __init__(self, tables: dict[str, DataFrame], language: str = "go"):
        self.t, self.language = tables, language

    @classmethod
    def of(cls, snapshots, language: str = "go", snapshot_id: str | None = None) -> Engine:
        """An engine bound to one snapshot: later ones do not change what it reads."""
        snapshot_id = snapshot_id or snapshots.current()
        return cls({name: snapshots.read(name, snapshot_id) for name in snapshots.tables(snapshot_id)}, language)

    def describe(self) -> dict[str, list[str]]:
        return {name: df.columns for name, df in self.t.items()}

    @property
    def _spark(self) -> SparkSession:
        return self.t["targets"].sparkSession

    def loaded(self) -> int:
        """How many functions the snapshot holds."""
        return self.t["targets"].count()

    def files(self) -> DataFrame:
        main = self.t["source_files"].where("is_main_module").select("file")
        return main.join(self.t["targets"].select("file").distinct(), "file", "left_semi").distinct().orderBy("file")

    def lookup(self, name: str) -> str:
        if not name:
            raise ValueError("empty symbol name")
        if name.startswith("file:"):
            return name
        asked = self._spark.range(1).select(F.lit(name).alias("name"))
        if self.language == "ts":
            row = lookup_names(self.t["targets"], self.t.get("templates"), asked).head()
        else:
            row = lookup(self.t["targets"], asked).head()
        if row is None:
            raise UnknownTarget(f"unknown symbol {name}")
        return row.target_id

    def search(self, query: str, limit: int = 50) -> DataFrame:
        if self.language != "ts":
            return search(self.t["targets"], query, limit)
        named = lambda df: df.select("target_id", F.col("title").alias("name"))
        functions = named(self.t["targets"])
        return search_names(functions, named(self.t["templates"]) if "templates" in self.t else functions.limit(0), query, limit)

    def _targets(self, where: Column) -> DataFrame:
        return self.t["targets"].where(where).join(self.t["source_files"].select("file", "source"), "file")

    def frame(self, target_id: str) -> DataFrame:
        """One row: the target's own source with its calls in source order. ``file:<path>`` gives a whole indexed file."""
        if target_id.startswith("file:"):
            return self._file_frame(target_id)
        known = self.t["targets"].where(F.col("target_id") == target_id).select("has_body").head()
        if known is None or not known.has_body:
            raise UnknownTarget(f"unknown target {target_id}" if known is None else f"target {target_id} has no body")
        return frames(self._targets(F.col("target_id") == target_id), self.t["call_sites"].where(F.col("caller_id") == target_id))

    def _file_frame(self, target_id: str) -> DataFrame:
        path = target_id[len("file:") :]
        asked = self._spark.range(1).select(clean_path(F.lit(path)).alias("file"))
        source = self.files().join(asked, "file", "left_semi").join(self.t["source_files"].select("file", "source"), "file")
        if source.isEmpty():
            raise UnknownTarget(f"{path} is not an indexed file")
        whole = source.select(
            F.col("file").alias("target_id"), F.substring_index("file", "/", -1).alias("title"), "file", F.lit(0).cast("long").alias("start_byte"), F.octet_length("source").cast("long").alias("end_byte"),
            F.lit(1).cast("long").alias("start_line"), F.size(lines(F.col("source"))).cast("long").alias("end_line"), F.lit(True).alias("has_body"), "source")
        own = self.t["targets"].join(source.select("file"), "file", "left_semi").select(F.col("target_id").alias("caller_id"), F.col("file").alias("of_file"))
        inside = self.t["call_sites"].join(own, "caller_id").drop("caller_id").withColumnRenamed("of_file", "caller_id")
        if self.language == "ts":
            inside = inside.dropDuplicates(["call_key"])  # a function inside another has its calls twice
        # a whole file shows calls in order of their names' places
        return frames(whole, inside.drop("ast_order").withColumn("place", F.col("name_start")), "place").withColumn("target_id", F.lit(target_id))

    def frame_for_call(self, call_key: str, choice: int = 0) -> DataFrame:
        """The body behind a call: its target, or the option at ``choice``, the first if there is none there."""
        call = self.t["call_sites"].where(F.col("call_key") == call_key).select("call_key", "resolved_target")
        options = fan_in(*[self.t[n].where(F.col("call_key") == call_key) for n in ("candidates", "receivers") if n in self.t])
        if options is not None:
            call = call.join(options, "call_key", "left").select(F.coalesce(F.col("resolved_target"), chosen(F.col("options"), F.lit(choice))["target_id"]).alias("target_id"))
        else:
            call = call.select(F.col("resolved_target").alias("target_id"))
        picked = call.head()
        if picked is None or picked.target_id is None:
            raise UnknownTarget(f"no body for call {call_key}")
        return self.frame(picked.target_id)

    def type_info(self, target_id: str, offset: int) -> DataFrame:
        """The identifier at a UTF-16 offset of a target's source: no row or one.

        A negative offset asks for the target's own declaration. ``file:<path>``
        is a target too. An unknown target is an error, unless its declaration is asked for.
        """
        if offset < 0:
            return self.describe_target(target_id)
        if not target_id.startswith("file:") and self.t["targets"].where(F.col("target_id") == target_id).isEmpty():
            raise UnknownTarget(f"unknown target {target_id}")
        point = self._spark.range(1).select(F.lit(target_id).alias("target_id"), F.lit(offset).cast("long").alias("offset"))
        return self.type_infos(point).drop("target_id", "offset")

    def type_infos(self, points: DataFrame) -> DataFrame:
        """(target_id, offset) with the identifier there, for many at once; none for places off identifiers and unknown targets."""
        placed = places_in_files(points, self.t["targets"], self.t["source_files"])
        hit = identifiers_at(self.t["idents"], placed.select("file", F.col("at").alias("offset")))
        return placed.join(hit.withColumnRenamed("offset", "at"), ["file", "at"]).drop("at")

    def describe_target(self, target_id: str) -> DataFrame:
        """What the declaration of a target says of itself: its identifier's row; none for an unknown target."""
        return self.t["idents"].where((F.col("func_target") == target_id) & F.col("is_declaration"))

    def usages(self, target_id: str) -> DataFrame:
        """Usages by file, line and kind, with two lines around each inside the caller."""
        if self.t["targets"].where(F.col("target_id") == target_id).isEmpty():
            raise UnknownTarget(f"unknown target {target_id}")
        caller = self.t["targets"].select(F.col("target_id").alias("caller_id"), F.col("title").alias("caller_title"), F.col("file"), "start_line", "end_line")
        source = self.t["source_files"].select("file", lines(F.col("source")).alias("source_lines"))
        used = self.t["usages"].where(F.col("target_id") == target_id).join(caller, "caller_id").join(source, "file")
        text, first = excerpt(F.col("source_lines"), F.col("line"), F.col("start_line"), F.col("end_line"))
        return used.withColumn("excerpt", text).withColumn("excerpt_line", first).drop("source_lines", "start_line", "end_line").orderBy("file", "line", "kind", "call_key", "choice")

    def callees_at(self, file: str, first: int, last: int) -> DataFrame:
        """Targets that calls on lines ``first`` to ``last`` of a file can run, once each, by title: none, one, or several to choose from."""
        own = self.t["targets"].where(F.col("file") == file).select(F.col("target_id").alias("caller_id"))
        calls = self.t["call_sites"].where(F.col("line").between(first, last)).join(own, "caller_id", "left_semi").select("call_key", F.col("resolved_target").alias("target_id"))
        reached = calls
        for name in ("candidates", "receivers"):
            if name in self.t:
                reached = reached.unionByName(self.t[name].join(calls.select("call_key"), "call_key", "left_semi").select("call_key", "target_id"))
        return self.t["targets"].where("has_body").join(reached.select("target_id").distinct(), "target_id", "left_semi").select("target_id", "title").orderBy("title", "target_id")


def identifiers_at(idents: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (file, offset in UTF-16 units) the innermost identifier that holds it; none off identifiers.

    A negative offset is on no identifier. Points and names meet in bins of
    their file about as wide as the names, not file by file.
    """
    spans = idents.withColumn("start", F.col("off_u16")).withColumn("end", F.col("off_u16") + utf16_len(F.col("name")))
    hit = containing(points.where("offset >= 0").select("file", "offset", F.col("offset").alias("at")).distinct(), spans, ["file"])
    best = hit.groupBy("file", "offset").agg(F.max_by(F.struct(*[c for c in idents.columns if c != "file"]), F.struct("start", "end")).alias("r"))
    return best.select("file", "offset", "r.*")

