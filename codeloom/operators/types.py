"""What types look like inside, and what an identifier of a frame is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import byte_to_utf16, stripped, utf16_left, utf16_len

#: Members that are still listed, and the length of a member's line that is still shown whole, where types are structural.
MOST_MEMBERS, LONGEST_LINE = 24, 100


def pointed_at(type_string: Column) -> Column:
    """The type behind any number of pointers."""
    return F.regexp_replace(type_string, r"^\*+", "")


def _listed(members: DataFrame, order: list[str], line: Column) -> DataFrame:
    """(type_key, n, text): each type's members, a line each, in order."""
    rows = members.select("type_key", F.struct(*order).alias("place"), line.alias("line"))
    listed = rows.groupBy("type_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("m"))
    return listed.select("type_key", "n", F.array_join(F.transform("m", lambda x: F.concat(F.lit("    "), x["line"], F.lit("\n"))), "").alias("text"))


def definitions(asked: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """(type_string, definition): what a named type stands for, where its name alone does not tell.

    ``asked``: type_string; ``types``: type_key, shape (struct, interface,
    signature or other) and underlying (its type as text); ``members``:
    type_key, ordinal, name (null for an embedded field), type. Pointers are
    followed to what they point at. A struct lists its fields in order, an
    interface its methods by name, with their signatures; without any they
    are ``struct{}`` and ``interface{}``. Functions, unnamed and unknown
    types, and names that are what they stand for give an empty text.
    """
    wanted = asked.select("type_string").distinct().withColumn("type_key", pointed_at(F.col("type_string")))
    shaped = types.join(wanted.select("type_key").distinct(), "type_key", "left_semi").select("type_key", "shape", "underlying")
    held = members.join(shaped, "type_key")
    fields = _listed(held.where("shape = 'struct'"), ["ordinal"], F.concat_ws(" ", "name", "type"))
    methods = _listed(held.where("shape = 'interface'"), ["name"], F.concat("name", F.regexp_replace("type", "^func", "")))
    listed = fields.unionByName(methods)
    kind = F.col("shape")
    told = (
        F.when(kind.isin("struct", "interface"), F.when(F.col("n").isNull(), F.concat(kind, F.lit("{}"))).otherwise(F.concat(kind, F.lit(" {\n"), F.col("text"), F.lit("}"))))
        .when((kind == "other") & (F.col("underlying") != F.col("type_key")), F.col("underlying")).otherwise("")
    )
    return wanted.join(shaped, "type_key", "left").join(listed, "type_key", "left").select("type_string", told.alias("definition"))


def structural_definitions(types: DataFrame, members: DataFrame) -> DataFrame:
    """(type_key, definition): the members of each type, by the first line of each one's declaration.

    ``types``: type_key, telling (whether its name says everything: basic
    types, unions, arrays, functions); ``members``: type_key, ordinal, text.
    A line over ``LONGEST_LINE`` UTF-16 units is cut, an ellipsis in place
    of its end. Types without members, and of more than ``MOST_MEMBERS``, give an empty
    text; the members of such types are counted, not gathered.
    """
    n = members.groupBy("type_key").agg(F.count("*").alias("n_members"))
    few = types.join(n, "type_key", "left").withColumn("shown", ~F.col("telling") & F.coalesce(F.col("n_members").between(1, MOST_MEMBERS), F.lit(False)))
    first = stripped(F.substring_index("text", "\n", 1))
    line = F.when(utf16_len(first) > LONGEST_LINE, F.concat(utf16_left(first, LONGEST_LINE - 3), F.lit("…"))).otherwise(first)
    listed = _listed(members.join(few.where("shown").select("type_key"), "type_key", "left_semi"), ["ordinal"], line)
    return few.join(listed, "type_key", "left").select("type_key", F.when(F.col("shown"), F.concat(F.lit("{\n"), F.col("text"), F.lit("}"))).otherwise("").alias("definition"))


def places_in_files(points: DataFrame, targets: DataFrame, files: DataFrame) -> DataFrame:
    """Points (target_id, offset in UTF-16 units of the target's source) as (target_id, offset, file, at), ``at`` in units of the file.

    Files themselves are targets named ``file:<path>``, which begin at 0.
    Unknown targets and negative offsets give no row. The text before a target is measured once a target.
    """
    asked = points.where("offset >= 0")
    own = targets.join(asked.select("target_id").distinct(), "target_id", "left_semi").join(files.select("file", "source"), "file")
    starts = own.select("target_id", "file", byte_to_utf16(F.col("source"), F.col("start_byte")).alias("base"))
    whole = asked.where(F.col("target_id").startswith("file:")).select("target_id", F.expr("substring(target_id, 6)").alias("file"), F.lit(0).cast("long").alias("base")).distinct().join(files.select("file"), "file", "left_semi").select("target_id", "file", "base")
    return asked.join(starts.unionByName(whole), "target_id").select("target_id", "offset", "file", (F.col("base") + F.col("offset")).alias("at"))
