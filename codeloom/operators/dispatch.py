"""Which bodies a call can reach: direct, interface, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import EMIT_METHODS, is_observable
from codeloom.operators.storage import written

#: Copies of the options of a key, among which the calls of that key are dealt.
SPREAD = 8

#: Calls that are listed together, calls that are gathered for that, calls and options of a key that meet in one place.
BLOCK, GATHERED, PART, SLICE = 256, 2048, 8192, 16384

#: Rows of one place, about, where that leaves as many calls as are gathered.
MOST = 1 << 24

#: Rows from which on their number decides how many tasks list them.
MANY = 2_000_000


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in scan order."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r"))
    return best.select(key, "r.*").select(df.columns)


def implements(iface_methods: DataFrame, method_sets: DataFrame) -> DataFrame:
    """(iface_key, type_key): types whose method set covers all methods of the interface.

    Relational division. Candidates meet on the method of each interface that
    the fewest types have, so a method that all types have makes no pairs;
    the rest is an equi-join on (type, method, signature) and a count.
    """
    need = iface_methods.select("iface_key", "method_name", "signature").distinct()
    have = method_sets.select("type_key", "method_name", "signature").distinct()
    spread = have.groupBy("method_name", "signature").agg(F.count("*").alias("n_types"))
    known = need.join(spread, ["method_name", "signature"], "left").withColumn("n_types", F.coalesce("n_types", F.lit(0)))
    rarest = known.groupBy("iface_key").agg(F.count("*").alias("n_need"), F.min(F.struct("n_types", "method_name", "signature")).alias("m"))
    rarest = rarest.where("m.n_types > 0").select("iface_key", "n_need", "m.method_name", "m.signature")
    maybe = rarest.join(have, ["method_name", "signature"]).select("iface_key", "n_need", "type_key")
    met = maybe.join(need, "iface_key").join(have, ["type_key", "method_name", "signature"])
    return met.groupBy("iface_key", "type_key").agg(F.count("*").alias("n_met"), F.first("n_need").alias("n_need")).where("n_met = n_need").select("iface_key", "type_key")


def implementers(iface_methods: DataFrame, method_sets: DataFrame) -> DataFrame:
    """(iface_key, type_key, type_name): each named type once, by its value if that satisfies, else by its pointer (``*name``).

    ``method_sets`` has type_key, is_pointer, method_name, signature; the
    method set of a pointer holds that of the value.
    """
    keyed = method_sets.withColumn("type_key", F.struct("type_key", "is_pointer"))
    found = implements(iface_methods, keyed).select("iface_key", "type_key.type_key", "type_key.is_pointer")
    best = found.groupBy("iface_key", "type_key").agg(F.min("is_pointer").alias("is_pointer"))
    return best.select("iface_key", "type_key", F.concat(F.when(F.col("is_pointer"), "*").otherwise(""), "type_key").alias("type_name"))


def explicit_implements(heritage: DataFrame) -> DataFrame:
    """(iface_key, type_key) by declared clauses, one level only.

    ``implements`` may name any declaration, ``extends`` counts for classes
    only; where ``heritage`` has no owner_kind, all owners count as classes.
    """
    owner = F.col("owner_kind") == "class" if "owner_kind" in heritage.columns else F.lit(True)
    named = (F.col("clause") == "implements") | ((F.col("clause") == "extends") & owner)
    return heritage.where(named).select(F.col("owner_key").alias("iface_key"), F.col("class_key").alias("type_key")).distinct()


def _ranked(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return found.withColumn("idx", idx.cast("long"))


def _options(calls: DataFrame, impls: DataFrame, methods: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """The bodies that each called method of an interface may run, numbered from 0 in the order of ``order``."""
    bodies = methods if known is None else methods.join(known.select("target_id").distinct(), "target_id", "left_semi")
    wanted = calls.select("iface_key", "method_name").distinct()
    return _ranked(wanted.join(impls, "iface_key").join(bodies, ["type_key", "method_name"]), ["iface_key", "method_name"], order)


def spread_join(many: DataFrame, options: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``many`` with the ``options`` of the same ``keys``; rows of a key are dealt by ``by`` over ``SPREAD`` copies of its options, so few keys keep many tasks busy."""
    copies = options.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return many.withColumn("spread", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(copies, [*keys, "spread"]).drop("spread")


def listed(calls: DataFrame, options: DataFrame, keys: list[str], once: bool = False) -> DataFrame:
    """Every row of ``calls`` with every one of ``options`` of the same ``keys``; options have idx, from 0, and may have gaps. With ``once`` equal calls count as one.

    There are as many rows as calls of a key times its options, so all else is kept small. Calls of a key are
    counted and dealt, equal ones together, to places where about ``PART`` of them, fewer if there are many options, meet ``SLICE`` options; they move
    once, to be gathered in blocks there. Rows come an option of a block after the other, so files hold an option
    once a block, and calls in a short pattern.
    """
    options = written(options)
    sizes = calls.groupBy(*keys).agg(F.count("*").alias("n_calls")).join(options.groupBy(*keys).agg((F.max("idx") + 1).alias("n_options")), keys)
    lots = F.greatest(F.lit(1), F.least(F.lit(PART // GATHERED), F.floor(F.lit(MOST) / F.col("n_options") / GATHERED)))
    sizes = written(sizes.select("*", lots.alias("lots"), F.monotonically_increasing_id().alias("key")))
    places = F.sum(F.col("n_calls") / (F.col("lots") * GATHERED) * F.greatest(F.lit(1), F.col("n_options") / SLICE))
    n_places, n_rows = sizes.agg(places, F.sum(F.col("n_calls").cast("double") * F.col("n_options"))).head()
    last = lambda n, size: F.floor((F.col(n) - 1) / size).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n))
    part = lambda lot: F.floor(lot / F.col("lots")).cast("int")
    row = F.struct(*[c for c in calls.columns if c not in keys])
    dealt = calls.join(sizes, keys).select("key", "lots", row.alias("row"), F.pmod(F.xxhash64(row), last("n_calls", GATHERED) + 1).cast("int").alias("lot"), upto(last("n_options", SLICE)).alias("slice"))
    dealt = dealt.select("key", part(F.col("lot")).alias("part"), "slice", "lot", "row")
    copies = options.join(sizes, keys).select("key", upto(part(last("n_calls", GATHERED))).alias("part"), F.floor(F.col("idx") / SLICE).cast("int").alias("slice"), *options.columns)
    place = ["key", "part", "slice"]
    tasks = [1 + int(2 * n_places)] if (n_rows or 0) > MANY else []  # else Spark goes by the size of what meets, which says little of what is listed
    dealt, copies = (df.repartition(*tasks, *place) for df in (dealt, copies))
    rows = dealt.groupBy(*place, "lot").agg((F.collect_set if once else F.collect_list)("row").alias("rows"))
    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(BLOCK))
    blocks = rows.select(*place, F.explode(F.transform(starts, lambda at: F.slice("rows", at, F.lit(BLOCK)))).alias("rows"))
    met = blocks.hint("merge").join(copies, place).drop(*place)
    return met.select(*[c for c in met.columns if c != "rows"], F.inline("rows"))


def candidates(calls: DataFrame, impls: DataFrame, methods: DataFrame, order: list[str], known: DataFrame | None = None, targets: DataFrame | None = None, once: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Every body an interface call may run, numbered from 0 in the order of ``order``.

    ``calls``: call_key, iface_key, method_name; ``methods``: type_key,
    method_name, target_id, label. With ``known`` (target_id) only targets
    that have a body there count. Equal targets under two types stay. The
    options of an interface's method are ranked once, then joined to calls.
    With ``targets`` only options that are among them are listed, under the
    numbers they have among all. With ``once`` equal calls count as one.
    Columns of calls that ``also`` names come with each row, so nothing about
    a call need be worked out again for each of its options.
    """
    options = _options(calls, impls, methods, order, known)
    if targets is not None:
        options = options.join(targets.select("target_id").distinct(), "target_id", "left_semi")
    keys = ["iface_key", "method_name"]
    return listed(calls.select("call_key", *also, *keys), options.select(*keys, "idx", "target_id", "label"), keys, once).select("call_key", "idx", "target_id", "label", *also)


def candidate_counts(calls: DataFrame, impls: DataFrame, methods: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(target_id, n): in how many rows of ``candidates`` a target is, without listing them: calls of a method are counted, then its bodies."""
    called = calls.groupBy("iface_key", "method_name").agg(F.count("*").alias("n_calls"))
    options = _options(calls, impls, methods, ["target_id"], known).select("iface_key", "method_name", "target_id")
    return options.join(called, ["iface_key", "method_name"]).groupBy("target_id").agg(F.sum("n_calls").alias("n"))


def chosen_candidates(calls: DataFrame, impls: DataFrame, methods: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """(call_key, target_id): of each call (``candidates``, with choice) the option at its choice, the first if that is out of range; calls without options go.

    The other options of a call are never listed.
    """
    keys = ["iface_key", "method_name"]
    options = _options(calls, impls, methods, order, known).select(*keys, "idx", "target_id")
    sized = spread_join(calls, options.groupBy(*keys).agg(F.count("*").alias("n")), keys, "call_key")
    at = F.when((F.col("choice") >= 0) & (F.col("choice") < F.col("n")), F.col("choice")).otherwise(0).cast("long")
    return spread_join(sized.withColumn("idx", at), options, [*keys, "idx"], "call_key").select("call_key", "target_id")


def own_candidates(calls: DataFrame, heritage: DataFrame, methods: DataFrame, known: DataFrame) -> DataFrame:
    """``candidates`` by declared clauses: a class's own method with a body, one level down, by label.

    ``methods``: type_key, class_name, method_name, target_id, has_body. The
    label is ``Class.method``, with ``?`` for a class without name; labels
    order by their UTF-16 units, equal ones by target.
    """
    own = methods.where("has_body").select("type_key", "method_name", "target_id", F.concat_ws(".", F.coalesce("class_name", F.lit("?")), "method_name").alias("label"))
    return candidates(calls, explicit_implements(heritage), own.withColumn("units", F.encode("label", "UTF-16BE")), ["units", "target_id"], known)


def classify(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds kind and external: an interface receiver is interface, else a resolved target direct, else indirect.

    A direct call is external if its target is known to be; an unknown target is not.
    """
    j = calls.join(targets.select(F.col("target_id").alias("resolved_target"), "is_external"), "resolved_target", "left")
    kind = F.when(F.col("iface_key").isNotNull(), "interface").when(F.col("resolved_target").isNotNull(), "direct").otherwise("indirect")
    return j.withColumn("kind", kind).withColumn("external", F.coalesce(F.col("is_external") & (F.col("kind") == "direct"), F.lit(False))).drop("is_external")


def classify_declared(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Adds kind and target_id by what a call's declaration is; the first rule that holds counts.

    ``calls``: call_key, observable_sym (null unless an emit that fans out),
    declaration (its target id; null unresolved), external (declared in a
    library), abstract (a method without body of an interface or class),
    function_like. Order of the rules: fan-out; unresolved is indirect;
    external is direct without target; abstract is interface; a registered
    body is direct; another function is direct without target; else indirect.
    """
    j = calls.join(known.select(F.col("target_id").alias("declaration"), F.lit(True).alias("body")).distinct(), "declaration", "left")
    unresolved, body = F.col("declaration").isNull(), F.coalesce("body", F.lit(False))
    kind = (
        F.when(F.col("observable_sym").isNotNull(), "fanout").when(unresolved, "indirect").when(F.col("external"), "direct").when(F.col("abstract"), "interface")
        .when(body | F.col("function_like"), "direct").otherwise("indirect")
    )
    out = j.withColumn("kind", kind)
    return out.withColumn("target_id", F.when((F.col("kind") == "direct") & ~F.col("external") & body, F.col("declaration"))).drop("body")


def callbacks(subscriptions: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds callback_target: the function an argument of subscribe runs; rows without one go.

    ``subscriptions``: inline_target (a function written there), argument_name
    (an identifier), next_target (the function under ``next`` of an object);
    ``functions``: name, target_id. Of several functions of a name the least counts.
    """
    named = functions.groupBy(F.col("name").alias("argument_name")).agg(F.min("target_id").alias("named_target"))
    found = subscriptions.join(named, "argument_name", "left").withColumn("callback_target", F.coalesce("inline_target", "named_target", "next_target"))
    return found.where(F.col("callback_target").isNotNull()).drop("named_target")


def emits(calls: DataFrame) -> DataFrame:
    """Calls that fan out: ``next`` or ``emit`` on an observable type of its own package.

    ``calls``: call_key, method_name, type_name, origin (the path that declares the type), observable_sym.
    """
    return calls.where(F.col("method_name").isin(*EMIT_METHODS) & is_observable(F.col("type_name"), F.col("origin")))


def receivers(emits: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """All callbacks of the observable of each emit, once each, numbered from 0 by label.

    Callbacks of an observable are ranked once, then joined to emits. A
    provenance column, where there is one, is that of the first label.
    """
    extra = [c for c in ("provenance",) if c in subscriptions.columns]
    wanted = subscriptions.join(emits.select("observable_sym").distinct(), "observable_sym", "left_semi")
    once = wanted.groupBy("observable_sym", "callback_target").agg(F.min(F.struct("label", *extra)).alias("r")).select("observable_sym", "callback_target", "r.*")
    ranked = _ranked(once, ["observable_sym"], ["label", "callback_target"])
    return listed(emits.select("call_key", "observable_sym"), ranked, ["observable_sym"]).select("call_key", "idx", F.col("callback_target").alias("target_id"), "label", *extra)


def template_targets(calls: DataFrame, methods: DataFrame, known: DataFrame) -> DataFrame:
    """Adds kind and target_id: a call on the component itself whose class has such a method with a body is direct, else indirect.

    ``calls``: class_key, name, implicit; ``methods``: class_key, name, target_id, has_body.
    """
    bodies = methods.where("has_body").join(known.select("target_id").distinct(), "target_id", "left_semi").groupBy("class_key", "name").agg(F.min("target_id").alias("target_id"))
    j = calls.join(bodies, ["class_key", "name"], "left").withColumn("target_id", F.when(F.col("implicit"), F.col("target_id")))
    return j.withColumn("kind", F.when(F.col("target_id").isNotNull(), "direct").otherwise("indirect"))


def fan_in(*listed: DataFrame) -> DataFrame | None:
    """(call_key, options): the candidates and receivers of each call as one array in order of idx; None without tables."""
    parts = [df.select("call_key", "idx", "target_id") for df in listed]
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("call_key").agg(F.sort_array(F.collect_list(F.struct("idx", "target_id"))).alias("options"))


def chosen(options: Column, choice: Column) -> Column:
    """The option at ``choice``; out of range is the first; null without options."""
    return F.get(options, F.when((choice >= 0) & (choice < F.size(options)), choice).otherwise(0).cast("int"))


def expandable(kind: Column, target: Column, n_candidates: Column, n_receivers: Column) -> Column:
    return ((kind == "direct") & target.isNotNull()) | ((kind == "interface") & (n_candidates > 0)) | ((kind == "fanout") & (n_receivers > 0))


def badge(kind: Column, target: Column) -> Column:
    return F.when(kind == "interface", "iface").when(kind == "indirect", "indirect").when((kind == "direct") & target.isNull(), "ext").otherwise("")
