"""Schemas and readers of program facts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators.storage import Versions

SCHEMAS = {
    "source_files": "file string, language string, is_main_module boolean, source string",
    "targets": "target_id string, title string, leaf string, file string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, has_body boolean, is_external boolean",
    "call_sites": "call_key string, call_id string, caller_id string, ast_order bigint, line bigint, name_start bigint, name_end bigint, display_name string, resolved_target string, iface_key string, method_name string, goroutine boolean",
    "refs": "target_id string, caller_id string, file string, line bigint",
    "candidates": "call_key string, idx bigint, target_id string, label string",
    "receivers": "call_key string, idx bigint, target_id string, label string, provenance string",
    "templates": "target_id string, title string, file string, class_key string, start_line bigint, source string",
    "idents": "file string, off_u16 bigint, name string, obj_kind string, type_string string, definition string, func_target string, enclosing_target string, line bigint, is_declaration boolean, is_call_name boolean",
    "iface_methods": "iface_key string, method_name string, signature string",
    "method_sets": "type_key string, method_name string, signature string, target_id string",
    "heritage": "owner_key string, class_key string, clause string, owner_kind string",
    "subscriptions": "observable_sym string, callback_target string, label string, provenance string",
    "notes": "id string, anchor struct<file:string,kind:string,startLine:bigint,endLine:bigint,snippet:string>, text string, createdAt string, updatedAt string",
    "change_events": "ts timestamp, path string, op string",
}


def read_facts(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A fact table as Parquet, under its fixed schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes from a JSON document, or the newest version of a store that ``write_notes`` keeps. A missing or corrupt store is empty."""
    kind = SCHEMAS["notes"]
    newest = Versions(spark, path).current()
    path = path if newest is None else Versions(spark, path).folder(newest)
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or str(e)):
            raise
        return spark.createDataFrame([], kind)
    document = F.from_json("value", f"array<struct<{', '.join(_fields(kind))}>>")
    rows = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, kind))
    notes = whole.select(F.explode(F.when(F.ltrim("value").startswith("["), document).otherwise(rows)).alias("n")).where("n.id is not null")
    return notes.select("n.*")


def _fields(ddl: str) -> list[str]:
    """``name type`` pairs of a table's schema as ``name:type``, for a struct's."""
    return [f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]


def write_notes(notes: DataFrame, path: str) -> None:
    """Replace the store at ``path``: a new version is written whole, then becomes the one that is read.

    At no moment is there none, and ``notes`` may read the store itself. The
    version before stays for those that read it; older ones go.
    """
    store = Versions(notes.sparkSession, path)
    store.publish(lambda folder: notes.write.json(folder, ignoreNullFields=False))
    store.forget(2)


def source_range(source: Column, start: Column, end: Column) -> Column:
    """Bytes ``start`` to ``end`` of a source as text; a range outside it is an error."""
    raw = F.encode(source, "UTF-8")
    inside = (start >= 0) & (start <= end) & (end <= F.octet_length(raw))
    return F.when(inside, F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")).otherwise(F.raise_error(F.concat(F.lit("range out of bounds: "), start.cast("string"), F.lit("-"), end.cast("string"))))


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON object, nulls included, as an API would answer."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def detect_language(marker_files: DataFrame, asked: str | None = None) -> DataFrame:
    """(project, language): as asked, else by marker files, else go."""
    has = lambda *names: F.max(F.col("name").isin(*names))
    rule = F.when(has("go.mod"), "go").when(has("tsconfig.json", "package.json"), "ts").otherwise("go")
    return marker_files.groupBy("project").agg((F.lit(asked) if asked else rule).alias("language"))
