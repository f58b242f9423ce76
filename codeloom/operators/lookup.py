"""Symbols by name: exact lookup and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import contains_folded, leaf


def _runs(text: str, n: int):
    """The distinct runs of ``n`` characters of a text; none of a shorter one."""
    c = F.col(text)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda k: c.substr(k, F.lit(n)))))


def containing_text(asked: DataFrame, texts: DataFrame, q: str, text: str) -> DataFrame:
    """Every row of ``asked`` with every row of ``texts`` whose ``text`` holds its ``q``; letters as they are.

    They meet on one run of three letters of q, the one that the fewest texts
    hold, so a run that all texts share makes no pairs; on the whole of a q
    of one or two letters. An empty q meets nothing.
    """
    out = None
    for n in (1, 2, 3):
        keyed = texts.withColumn("_run", F.explode(_runs(text, n)))
        own = asked.where(F.length(q) == n if n < 3 else F.length(q) >= 3)
        if n == 3:
            spread = keyed.groupBy("_run").agg(F.count("*").alias("_n"))
            options = own.select(q).distinct().withColumn("_run", F.explode(_runs(q, 3))).join(spread, "_run", "left")
            rarest = options.groupBy(q).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_r")).where("_r.n > 0")
            own = own.join(rarest.select(q, F.col("_r._run").alias("_run")), q)
        else:
            own = own.withColumn("_run", F.col(q))
        hit = own.join(keyed, "_run").where(F.contains(F.col(text), F.col(q))).drop("_run").select(*asked.columns, *texts.columns)
        out = hit if out is None else out.unionByName(hit)
    return out


def lookup(targets: DataFrame, names: DataFrame) -> DataFrame:
    """(name, target_id): the exact id, else the least id whose leaf is the name; no row if neither."""
    ids = targets.select("target_id").distinct()
    exact = names.join(ids, names.name == ids.target_id).select("name", "target_id", F.lit(0).alias("tier"))
    by_leaf = ids.withColumn("leaf", leaf(F.col("target_id")))
    near = names.join(by_leaf, names.name == by_leaf.leaf).select("name", "target_id", F.lit(1).alias("tier"))
    return exact.unionByName(near).groupBy("name").agg(F.min(F.struct("tier", "target_id")).alias("b")).select("name", "b.target_id")


def search(targets: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Targets whose id contains the query in any case; leaf matches first, then by id; cut after ranking, at 50 where ``limit`` is not positive.

    What a request may ask for is bounded by ``text.search_limit``.
    """
    limit = limit if limit > 0 else 50
    q = F.lit(query)
    hits = targets.where(contains_folded(F.col("target_id"), q)).withColumn("is_leaf", contains_folded(leaf(F.col("target_id")), q))
    return hits.orderBy(F.desc("is_leaf"), "target_id").limit(limit)


def picked(targets: DataFrame, query: str) -> DataFrame:
    """What a picker offers for ``query``, at most 25 targets with first for the one that is taken; a blank query offers none."""
    if not query.strip():
        return targets.limit(0).withColumn("first", F.lit(False))
    place = F.row_number().over(Window.orderBy(F.desc("is_leaf"), "target_id"))  # over 25 rows
    return search(targets, query, 25).withColumn("first", place == 1).drop("is_leaf")


def search_names(functions: DataFrame, templates: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """By name: functions in order of id, then templates; cut after the union, at 50 where ``limit`` is not positive."""
    limit = limit if limit > 0 else 50
    both = functions.withColumn("tier", F.lit(0)).unionByName(templates.withColumn("tier", F.lit(1)))
    return both.where(contains_folded(F.col("name"), F.lit(query))).orderBy("tier", "target_id").limit(limit)


def lookup_names(functions: DataFrame, templates: DataFrame | None, names: DataFrame) -> DataFrame:
    """(name, target_id): the exact id, else of functions whose title or its leaf is the name, and templates whose title holds it in any case, the least title's.

    Titles order by their UTF-16 units, equal ones by id.
    """
    every = functions.select("target_id", "title", F.lit(False).alias("template"))
    if templates is not None:
        every = every.unionByName(templates.select("target_id", "title", F.lit(True).alias("template")))
    entry = F.struct(F.encode("title", "UTF-16BE").alias("units"), "target_id")
    exact = names.join(every, names.name == every.target_id).select("name", F.lit(0).alias("tier"), entry.alias("e"))
    called = every.where("not template").select("target_id", "title", F.explode(F.array_distinct(F.array("title", leaf(F.col("title"))))).alias("called"))
    near = names.join(called, names.name == called.called).select("name", F.lit(1).alias("tier"), entry.alias("e"))
    held = containing_text(names.select("name", F.lower("name").alias("q")), every.where("template").select("target_id", "title", F.lower("title").alias("folded")), "q", "folded")
    inside = held.select("name", F.lit(1).alias("tier"), entry.alias("e"))
    best = exact.unionByName(near).unionByName(inside).groupBy("name").agg(F.min(F.struct("tier", "e")).alias("b"))
    return best.select("name", F.col("b.e.target_id").alias("target_id"))
