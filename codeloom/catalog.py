"""The registered queries of the program-structure engine and their SQL.

The supplied tables stand for facts: a line item is a call site (its order
the caller, its part the target), a part a target, a brand an interface.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import diff, dispatch, graph, intervals, lookup, notes, resolvers, types, usages, views
from codeloom.operators.storage import shared_folder, written
from codeloom.plans.engine import Engine, frames, identifiers_at
from codeloom.streaming import reload

QUERIES, ORACLES = {}, {}
FLAGSHIP = "q_usages"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def _key():
    """Key of a line item: order and line number repeat, so other columns follow."""
    return F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], (F.col("l_extendedprice") * 100).cast("long").cast("string"))


_KEY_SQL = "concat_ws('/', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, trunc(l_extendedprice * 100)::BIGINT::VARCHAR)"


def _calls(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(_key().alias("call_key"), *_long("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_returnflag", "l_linestatus")


@_query("SELECT DISTINCT source AS file FROM documents WHERE lang = 'en'")
def q_files(spark, sf_dir):
    """Files of the main module, which English documents stand for, that have a target."""
    docs = _t(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("file"), (F.col("lang") == "en").alias("is_main_module"))
    return Engine({"source_files": files, "targets": docs.select(F.col("source").alias("file"))}).files()


@_query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def q_first_wins(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("text", "doc_id", F.col("doc_id").alias("at"))
    return dispatch.first_wins(docs, "text", "at").select("doc_id", "text")


@_query("""SELECT p_partkey, regexp_extract(replace(p_name, ' ', '.'), '[^.]*$') AS leaf,
  p_type || '.' || regexp_extract(p_name, '^[^ ]*') AS title FROM part""")
def q_titles_leaf(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    return _t(spark, sf_dir, "part").select("p_partkey", T.leaf(name).alias("leaf"), T.title(F.concat(F.lit("*"), F.col("p_type")), F.substring_index("p_name", " ", 1)).alias("title"))


def _classified(spark, sf_dir):
    calls = _calls(spark, sf_dir).select("call_key", "l_orderkey", F.when(F.col("l_returnflag") == "N", F.lit("iface")).alias("iface_key"), F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("resolved_target"))
    return dispatch.classify(calls, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), (F.col("p_size") > 25).alias("is_external")))


@_query(f"""SELECT {_KEY_SQL} AS call_key, CASE l_returnflag WHEN 'N' THEN 'interface' WHEN 'A' THEN 'direct' ELSE 'indirect' END AS kind,
  l_returnflag = 'A' AND coalesce(p_size > 25, false) AS external FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def q_classify_calls(spark, sf_dir):
    return _classified(spark, sf_dir).select("call_key", "kind", "external")


@_query("""SELECT CASE l_returnflag WHEN 'N' THEN 'interface' WHEN 'A' THEN 'direct' ELSE 'indirect' END AS kind,
  l_returnflag = 'A' AND coalesce(p_size > 25, false) AS external, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def q_external_flag(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("kind", "external").agg(F.count("*").alias("n"))


@_query("""SELECT l_returnflag = 'A' OR l_returnflag = 'N' AS expandable, CASE l_returnflag WHEN 'N' THEN 'iface' WHEN 'R' THEN 'indirect' ELSE '' END AS badge, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def q_expandable(spark, sf_dir):
    c = _classified(spark, sf_dir)
    can = dispatch.expandable(F.col("kind"), F.col("resolved_target"), F.when(F.col("kind") == "interface", 1).otherwise(0), F.lit(0))
    return c.groupBy(can.alias("expandable"), dispatch.badge(F.col("kind"), F.col("resolved_target")).alias("badge")).agg(F.count("*").alias("n"))


@_query("""WITH need AS (SELECT DISTINCT p_size // 2 AS iface_key, p_type, p_name FROM part), have AS (SELECT DISTINCT p_brand AS type_key, p_type, p_name FROM part),
  met AS (SELECT iface_key, type_key, count(*) AS n FROM need JOIN have USING (p_type, p_name) GROUP BY 1, 2)
SELECT iface_key, type_key FROM met WHERE n = (SELECT count(*) FROM need x WHERE x.iface_key = met.iface_key)
UNION ALL SELECT 1000 + n_regionkey, n_name FROM nation""")
def q_implements_division(spark, sf_dir):
    """Sizes of parts stand for interfaces, brands for types; each region besides needs one method, which its nations have."""
    part, nation = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "nation")
    region = (1000 + F.col("n_regionkey")).cast("int")
    method = lambda key: (key, F.col("p_name").alias("method_name"), F.col("p_type").alias("signature"))
    need = part.select(*method(F.floor(F.col("p_size") / 2).cast("int").alias("iface_key"))).unionByName(nation.select(region.alias("iface_key"), F.lit("join").alias("method_name"), region.cast("string").alias("signature")))
    have = part.select(*method(F.col("p_brand").alias("type_key"))).unionByName(nation.select(F.col("n_name").alias("type_key"), F.lit("join").alias("method_name"), region.cast("string").alias("signature")))
    return dispatch.implements(need, have)


@_query("SELECT DISTINCT r_name AS iface_key, n_name AS type_key FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_implements_explicit(spark, sf_dir):
    region = _t(spark, sf_dir, "region")
    return dispatch.explicit_implements(_t(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("owner_key"), F.col("n_name").alias("class_key"), F.lit("implements").alias("clause")))


def _option_facts(spark, sf_dir):
    """Calls of interfaces, which nations stand for, with the types, methods and targets that ``dispatch.candidates`` takes; line items that repeat give equal calls."""
    supplier = _t(spark, sf_dir, "supplier")
    calls = _calls(spark, sf_dir).where("l_returnflag = 'N'").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("iface_key")), "l_suppkey").select("call_key", "iface_key", F.lit("m").alias("method_name"), F.col("l_orderkey").alias("caller_id"))
    impls = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("iface_key"), F.col("n_nationkey").alias("type_key"))
    methods = supplier.select(F.col("s_nationkey").alias("type_key"), F.lit("m").alias("method_name"), F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("label"))
    return calls, impls, methods, supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("target_id"))


def _options(spark, sf_dir, targets=None, also=()):
    calls, impls, methods, known = _option_facts(spark, sf_dir)
    return dispatch.candidates(calls, impls, methods, ["label", "target_id"], known, targets, once=True, also=also)


_OPTIONS_SQL = f"""calls AS (SELECT DISTINCT {_KEY_SQL} AS call_key, l_orderkey, l_linenumber, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'N'),
  options AS (SELECT call_key, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY call_key ORDER BY s_name, s_suppkey) - 1 AS idx, s_suppkey AS target_id, s_name AS label FROM calls JOIN supplier USING (s_nationkey) WHERE s_acctbal >= 0)"""


@_query(f"WITH {_OPTIONS_SQL} SELECT call_key, idx, target_id, label FROM options")
def q_candidates(spark, sf_dir):
    return _options(spark, sf_dir)


@_query(f"""WITH {_OPTIONS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY call_key) AS n FROM options)
SELECT call_key, target_id FROM sized WHERE idx = CASE WHEN l_linenumber * 3 < n THEN l_linenumber * 3 ELSE 0 END""")
def q_frame_for_call(spark, sf_dir):
    calls, impls, methods, known = _option_facts(spark, sf_dir)
    calls = calls.dropDuplicates(["call_key"]).withColumn("choice", F.split("call_key", "/")[1].cast("int") * 3)
    return dispatch.chosen_candidates(calls, impls, methods, ["label", "target_id"], known)


@_query("""WITH subs AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'signup'),
  once AS (SELECT DISTINCT event_id AS call_key, s.user_id AS target_id FROM events e JOIN subs s ON s.k = json_extract_string(e.props, '$.k')::BIGINT WHERE event_type = 'error')
SELECT call_key, row_number() OVER (PARTITION BY call_key ORDER BY 'user ' || lpad(target_id::VARCHAR, 9, '0')) - 1 AS idx, target_id, 'user ' || lpad(target_id::VARCHAR, 9, '0') AS label FROM once""")
def q_fanout_receivers(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("observable_sym", F.get_json_object("props", "$.k").cast("long"))
    subs = e.where("event_type = 'signup'").select("observable_sym", F.col("user_id").alias("callback_target"), F.concat(F.lit("user "), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("label"))
    return dispatch.receivers(e.where("event_type = 'error'").select(F.col("event_id").alias("call_key"), "observable_sym"), subs)


def _targets(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"))


def _told_usages(spark, sf_dir):
    """Direct calls and references of targets."""
    calls = _calls(spark, sf_dir)
    part = lambda flag: calls.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("target_id"), F.col("l_orderkey").alias("caller_id"), "call_key", F.lit(0).alias("choice"))
    return usages.usages(part("A"), None, part("R"), _targets(spark, sf_dir))


_USAGES_SQL = f"""{_OPTIONS_SQL}, every AS (
  SELECT l_partkey AS target_id, 'call' AS kind, l_orderkey AS caller_id, {_KEY_SQL} AS call_key, 0 AS choice FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT target_id, 'interface', l_orderkey, call_key, idx FROM options
  UNION ALL SELECT l_partkey, 'ref', l_orderkey, {_KEY_SQL}, 0 FROM lineitem WHERE l_returnflag = 'R'),
  used AS (SELECT target_id, kind, caller_id, call_key, choice::BIGINT AS choice FROM every WHERE target_id IN (SELECT p_partkey FROM part))"""


@_query(f"WITH {_USAGES_SQL} SELECT * FROM used")
def q_usages(spark, sf_dir):
    """Options are held against the targets before calls meet them, so their rows are not moved again; callers come with the calls."""
    options = _options(spark, sf_dir, _targets(spark, sf_dir), ("caller_id",)).select("target_id", "caller_id", "call_key", F.col("idx").alias("choice"))
    return _told_usages(spark, sf_dir).unionByName(usages.usages(None, options, None))


@_query(f"WITH {_USAGES_SQL} SELECT target_id, kind, count(*) AS n FROM used GROUP BY 1, 2")
def q_usages_count(spark, sf_dir):
    calls, impls, methods, known = _option_facts(spark, sf_dir)
    options = dispatch.candidate_counts(calls.dropDuplicates(["call_key"]), impls, methods, known).join(_targets(spark, sf_dir).distinct(), "target_id", "left_semi")
    return usages.counts(_told_usages(spark, sf_dir), options.withColumn("kind", F.lit("interface")))


@_query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_call_collision(spark, sf_dir):
    return usages.colliding(_calls(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@_query("""WITH spans AS (SELECT o_custkey AS k, o_orderkey % 1000 AS s, o_orderkey % 1000 + 200 AS e, o_orderkey AS span_id FROM orders)
SELECT c_custkey AS k, arg_max(s, s * 1000000000 + span_id) AS start, arg_max(span_id, s * 1000000000 + span_id) AS span_id FROM customer JOIN spans ON k = c_custkey AND s <= c_custkey % 1000 AND c_custkey % 1000 < e GROUP BY 1""")
def q_innermost(spark, sf_dir):
    at = F.col("o_orderkey") % 1000
    spans = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), at.alias("start"), (at + 200).alias("end"), F.col("o_orderkey").alias("span_id"))
    return intervals.innermost(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 1000).alias("at")), spans, "k", ["k"])


@_query("""WITH ids AS (SELECT DISTINCT p_brand || '.' || p_type || '.' || replace(p_name, ' ', '_') AS target_id FROM part), names AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part)
SELECT name, min(target_id) AS target_id FROM names JOIN ids ON regexp_extract(target_id, '[^.]*$') = name GROUP BY 1""")
def q_lookup(spark, sf_dir):
    leaf = F.replace("p_name", F.lit(" "), F.lit("_"))
    part = _t(spark, sf_dir, "part")
    return lookup.lookup(part.select(F.concat_ws(".", "p_brand", "p_type", leaf).alias("target_id")), part.select(leaf.alias("name")).distinct())


@_query("""WITH ids AS (SELECT DISTINCT p_brand || '.' || p_type || '.' || replace(p_name, ' ', '_') AS target_id FROM part)
SELECT target_id, contains(lower(regexp_extract(target_id, '[^.]*$')), 'ring') AS is_leaf FROM ids WHERE contains(lower(target_id), 'ring') ORDER BY is_leaf DESC, target_id LIMIT 50""")
def q_search_ranked(spark, sf_dir):
    ids = _t(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("target_id")).distinct()
    return lookup.search(ids, "RING").select("target_id", "is_leaf")


@_query("""SELECT * FROM (SELECT s_suppkey AS target_id, s_name AS name, 0::BIGINT AS tier FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer)
WHERE contains(lower(name), '0007') ORDER BY tier, target_id LIMIT 50""")
def q_search_ts(spark, sf_dir):
    a = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("name"))
    b = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), F.col("c_name").alias("name"))
    return lookup.search_names(a, b, "0007").withColumn("tier", F.col("tier").cast("long"))


@_query(f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, {_KEY_SQL}) - 1 AS ast_order, {_KEY_SQL} AS call_key
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def q_frame_nested(spark, sf_dir):
    calls = _calls(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "call_key"))).alias("calls"))
    frames = _t(spark, sf_dir, "orders").join(calls, F.col("o_orderkey") == F.col("l_orderkey"))
    return frames.select("o_orderkey", F.posexplode("calls").alias("at", "c")).select("o_orderkey", F.col("at").cast("long").alias("ast_order"), "c.call_key")


def _trade(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    s, c = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer")
    j = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(*[F.col(x).cast("long").alias(y) for x, y in (("s_nationkey", "src"), ("c_nationkey", "dst"))]).distinct()


def _walk_sql(src, dst):
    return f"""WITH RECURSIVE edges AS (SELECT DISTINCT s_nationkey::BIGINT AS {src}, c_nationkey::BIGINT AS {dst} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
walk AS (SELECT n_nationkey::BIGINT AS root, 0::BIGINT AS depth, n_nationkey::BIGINT AS target, [n_nationkey::BIGINT] AS path, false AS recursive FROM nation
  UNION ALL SELECT root, depth + 1, dst, list_append(path, dst), list_contains(path, dst) FROM walk JOIN edges ON target = src WHERE NOT recursive AND depth < 3)
SELECT root, depth, target, array_to_string(path, '>') AS path, recursive FROM walk"""


def _roots(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


@_query(_walk_sql("src", "dst"))
def q_callees_walk(spark, sf_dir):
    return graph.walk(_trade(spark, sf_dir), _roots(spark, sf_dir), 3).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@_query(_walk_sql("dst", "src"))
def q_callers_walk(spark, sf_dir):
    return graph.callers(_trade(spark, sf_dir), _roots(spark, sf_dir), 3).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


def _chains(spark, sf_dir):
    step = F.struct("turn", F.col("turn").alias("call"), (F.col("turn") % 2).alias("choice"), ((F.col("conv_id") + F.col("turn")) % 4 == 0).alias("is_ref"))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("chain"))


@_query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 4 = 0 AS is_ref FROM conversations),
  d AS (SELECT *, max(CASE WHEN is_ref THEN turn END) OVER (PARTITION BY conv_id) AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM c)
SELECT conv_id, coalesce(string_agg(turn || '#' || turn % 2, '>' ORDER BY turn DESC) FILTER (cut IS NULL OR turn > cut), '') AS path_key,
  coalesce(bool_or(is_ref) FILTER (from_end > 1), false) AS partial FROM d GROUP BY 1""")
def q_splice_partial(spark, sf_dir):
    steps, partial = graph.spliced(F.col("chain"))
    return _chains(spark, sf_dir).select("conv_id", graph.path_key(steps).alias("path_key"), partial.alias("partial"))


@_query("SELECT conv_id, string_agg(turn || '#' || turn % 2, '>' ORDER BY turn) AS path_key FROM conversations GROUP BY 1")
def q_path_key(spark, sf_dir):
    return _chains(spark, sf_dir).select("conv_id", graph.path_key(F.col("chain")).alias("path_key"))


@_query(f"""SELECT {_KEY_SQL} AS call_key FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
WHERE ((l_returnflag = 'N' AND l_linestatus = 'O' AND l_suppkey % 3 > 0) OR (l_returnflag = 'A' AND NOT coalesce(p_size > 25, false) AND l_partkey % 7 <> l_orderkey % 7)) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def q_plus_one_level(spark, sf_dir):
    """Flag N with status F stands for fan-outs; a part that has its order's remainder by 7 is a frame above."""
    calls = _classified(spark, sf_dir).join(_calls(spark, sf_dir).select("call_key", "l_partkey", "l_suppkey", "l_linestatus").dropDuplicates(["call_key"]), "call_key")
    calls = calls.withColumn("kind", F.when((F.col("kind") == "interface") & (F.col("l_linestatus") == "F"), "fanout").otherwise(F.col("kind"))).withColumn("n_candidates", F.col("l_suppkey") % 3)
    calls = calls.withColumn("recursive", graph.recursive(F.col("kind"), F.col("resolved_target") % 7, F.array().cast("array<bigint>"), F.array(F.col("l_orderkey") % 7)))
    opened = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return graph.plus_one_level(calls, opened, ["l_orderkey"]).select("call_key")


@_query("""WITH f AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS file FROM pages), p AS (SELECT string_split(file, '/') AS p FROM f)
SELECT DISTINCT array_to_string(p[1:d], '/') AS path, d AS depth, d = len(p) AS is_file FROM p, unnest(range(1, len(p) + 1)) AS u(d)""")
def q_folder_tree(spark, sf_dir):
    file = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return graph.folder_tree(_t(spark, sf_dir, "pages").select(file.alias("file")).distinct())


@_query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, l, doc_id % (len(l) + 9) AS line, 2 * (doc_id % 3) AS low, len(l) + doc_id % 5 - 2 AS high FROM d),
  r AS (SELECT *, greatest(low, 1, line - 2) AS a, least(high, len(l), line + 2) AS b FROM h)
SELECT doc_id, line, CASE WHEN a <= b THEN a ELSE 0 END AS excerpt_line, CASE WHEN a <= b THEN array_to_string(l[a:b], chr(10)) ELSE '' END AS excerpt FROM r""")
def q_excerpts(spark, sf_dir):
    """Lines in and out of bodies that begin before the file or end after it."""
    d = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.lines(F.col("text")).alias("l")).withColumn("line", F.col("doc_id") % (F.size("l") + 9))
    text, first = T.excerpt(F.col("l"), F.col("line"), 2 * (F.col("doc_id") % 3), F.size("l") + F.col("doc_id") % 5 - 2)
    return d.select("doc_id", "line", first.cast("long").alias("excerpt_line"), text.alias("excerpt"))


@_query("SELECT doc_id, (len(string_split(left(text, (n_chars // 2)::BIGINT), chr(10))) - 1)::BIGINT AS line FROM documents")
def q_line_of_offset(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.line_of(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line"))


@_query("SELECT doc_id, length(text) + 2 AS utf16_units, length(text) + 1 AS code_points, strlen(text) + 4 AS bytes FROM documents")
def q_utf16(spark, sf_dir):
    c = F.concat("text", F.lit("🌍"))
    return _t(spark, sf_dir, "documents").select("doc_id", T.utf16_len(c).alias("utf16_units"), F.length(c).cast("long").alias("code_points"), F.octet_length(c).cast("long").alias("bytes"))


_TEMPLATE_SQL = r"""\{\{.*?\}\}|\[href\]\s*=\s*(?:"[^"]*"|'[^']*')"""


@_query(rf"""WITH t AS (SELECT page_id, replace(html, ' href=', ' [href]=') || '{{{{ title(' || page_id || ') }}}}<b (click)="open(item.name(1))">f(x)</b>' AS html FROM pages),
  e AS (SELECT page_id, list_concat(regexp_extract_all(html, '(?s)({_TEMPLATE_SQL.replace("'", "''")})', 1), ['open(item.name(1))']) AS e FROM t)
SELECT page_id, array_to_string(flatten(list_transform(e, lambda x: regexp_extract_all(x, '([A-Za-z_$][A-Za-z0-9_$]*)\(', 1))), ',') AS calls FROM e""")
def q_template_calls(spark, sf_dir):
    """Calls in what templates evaluate; plain text does not count. Links stand for bound attributes."""
    html = F.concat(F.replace("html", F.lit(" href="), F.lit(" [href]=")), F.lit("{{ title("), F.col("page_id").cast("string"), F.lit(') }}<b (click)="open(item.name(1))">f(x)</b>'))
    calls = F.flatten(F.transform(T.template_expressions(F.col("html")), T.template_calls))
    return _t(spark, sf_dir, "pages").select("page_id", html.alias("html")).select("page_id", F.array_join(calls, ",").alias("calls"))


def _versions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    of = lambda odd: o.where(F.col("o_orderkey") % 2 == odd).select((F.col("o_orderkey") - odd).alias("target_id"), F.col("o_orderpriority").alias("source"))
    return of(0), of(1).where("target_id % 10 <> 4")


@_query("""SELECT a.o_orderkey AS target_id, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderpriority = b.o_orderpriority THEN 'unchanged' ELSE 'modified' END AS status
FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND a.o_orderkey % 10 <> 4 WHERE a.o_orderkey % 2 = 0""")
def q_diff_status(spark, sf_dir):
    return diff.annotate(*_versions(spark, sf_dir))


@_query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, l, list_filter(l, lambda x: NOT starts_with(x, 't')) AS b FROM d)
SELECT doc_id, CASE WHEN len(l) * greatest(1, len(b)) > 3000 THEN 0 WHEN len(b) = 0 THEN len(l) - (CASE WHEN list_contains(l, '') THEN 1 ELSE 0 END) ELSE len(l) - len(b) END::BIGINT AS n_added FROM e""")
def q_diff_lines(spark, sf_dir):
    """How many lines of each text are new against a copy without the lines that start with t."""
    base = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~x.startswith("t")), "\n")
    rows = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("head"), base.alias("base"))
    return rows.select("doc_id", F.size(diff.added_lines(F.col("base"), F.col("head"))).cast("long").alias("n_added"))


@_query("""WITH n AS (SELECT doc_id AS note_id, doc_id % 20 AS file, 1 + doc_id % 50 AS s, CASE WHEN doc_id % 11 = 0 THEN 2000000000 ELSE 1 + doc_id % 50 + doc_id % 7 END AS e FROM labels WHERE doc_id % 5 <> 0),
  f AS (SELECT DISTINCT source AS src, replace(source, 'src', '')::BIGINT AS file FROM documents)
SELECT src AS file, note_id, line FROM n JOIN f USING (file), unnest(range(greatest(s, 10), least(e, 40) + 1)) AS u(line) WHERE s <= 40 AND e >= 10""")
def q_note_anchor_join(spark, sf_dir):
    at = 1 + F.col("doc_id") % 50
    end = F.when(F.col("doc_id") % 11 == 0, F.lit(2_000_000_000)).otherwise(at + F.col("doc_id") % 7)  # some go far beyond the file
    n = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("file"), at.alias("start_line"), end.alias("end_line"), F.when(F.col("doc_id") % 5 == 0, "after-line").otherwise("range").alias("kind"))
    f = _t(spark, sf_dir, "documents").select(F.col("source").alias("file")).distinct().select("file", F.lit(10).cast("long").alias("start_line"), F.lit(40).cast("long").alias("end_line"))
    return intervals.noted_lines(n, f)


@_query("""WITH ids AS (SELECT DISTINCT 'pkg.' || p_brand || '.' || replace(p_name, ' ', '_') AS target_id FROM part),
  r AS (SELECT p_partkey AS note_id, unnest([0::BIGINT, 1, 2]) AS position, unnest([replace(p_name, ' ', '_'), 'no such', 'file:' || lower(p_type) || '.go']) AS reference FROM part),
  q AS (SELECT DISTINCT reference FROM r),
  h AS (SELECT reference, target_id, row_number() OVER (PARTITION BY reference ORDER BY contains(lower(regexp_extract(target_id, '[^.]*$')), lower(reference)) DESC, target_id) AS k FROM q JOIN ids ON contains(lower(target_id), lower(reference))),
  x AS (SELECT reference, target_id, row_number() OVER (PARTITION BY reference ORDER BY ends_with(target_id, reference) DESC, k) AS n FROM h WHERE k <= 25),
  f AS (SELECT 'file:' || lower(p_type) || '.go' AS reference, 'file:' || min(p_brand || '/' || lower(p_type) || '.go') AS target_id FROM part GROUP BY 1)
SELECT note_id, position, reference, coalesce(x.target_id, f.target_id) AS target_id FROM r LEFT JOIN (SELECT * FROM x WHERE n = 1) x USING (reference) LEFT JOIN f USING (reference)""")
def q_note_refs(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    text = F.concat(F.lit("see [["), name, F.lit("]] and [[ no such ]] [[]] [[file:"), F.lower("p_type"), F.lit(".go]]"))
    ids = part.select(F.concat_ws(".", F.lit("pkg"), "p_brand", name).alias("target_id"))
    files = part.select(F.concat(F.col("p_brand"), F.lit("/"), F.lower("p_type"), F.lit(".go")).alias("file")).distinct()
    return notes.resolve(part.select(F.col("p_partkey").alias("note_id"), text.alias("text")), ids.withColumn("title", F.substring("target_id", 5, 1 << 20)), files)


@_query("""WITH r AS (SELECT l_orderkey, l_linenumber * 3 AS s, l_linenumber * 3 + l_quantity::BIGINT // 10 AS e FROM lineitem),
  m AS (SELECT *, CASE WHEN s > 1 + max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r),
  g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, min(s)::BIGINT AS "start", max(e)::BIGINT AS "end" FROM g GROUP BY l_orderkey, island""")
def q_merge_ranges(spark, sf_dir):
    at = (F.col("l_linenumber") * 3).cast("long")
    return intervals.merge_ranges(_t(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("start"), (at + F.floor(F.col("l_quantity") / 10)).alias("end")), ["l_orderkey"])


_PATH = {"click": "a/b.GO", "view": "x/tsconfig.build.json", "error": "x/data.json", "purchase": "README", "signup": "y/app.component.HTML"}


def _changes(spark, sf_dir):
    path = F.create_map(*[F.lit(x) for kv in _PATH.items() for x in kv])
    return _t(spark, sf_dir, "events").withColumn("path", path[F.col("event_type")])


@_query("SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'signup')")
def q_trigger_filter(spark, sf_dir):
    return reload.triggers(_changes(spark, sf_dir)).select("event_id")


@_query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS fires_us, count(*) AS n_events FROM g GROUP BY user_id, k""")
def q_debounce(spark, sf_dir):
    d = reload.debounce(_t(spark, sf_dir, "events"), "6 hours", ("user_id",))
    return d.select("user_id", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("fires_at").cast("timestamp")).alias("fires_us"), "n_events")


@_query("""SELECT user_id, epoch_us(min(ts)) AS created_us, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type
FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'""")
def q_upsert_latest(spark, sf_dir):
    changes = _t(spark, sf_dir, "events").select("user_id", F.col("event_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("deleted"))
    return notes.latest(changes, "user_id", "event_id").select("user_id", F.unix_micros("created_at").alias("created_us"), "event_id", "event_type")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def q_snapshot_swap(spark, sf_dir):
    store = reload.Snapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    store.publish({"targets": o.where("o_orderkey % 2 = 0")})
    store.publish({"targets": o.where("o_orderkey % 2 = 1")})
    return store.read("targets")


@_query("""SELECT n AS depth, CASE n % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS color, CASE WHEN n BETWEEN 1 AND 500 THEN n ELSE 50 END AS "limit",
  CASE WHEN n % 2 = 0 THEN ':' || n ELSE ':' || n || '–' || n + 3 END AS label FROM (SELECT n_nationkey * 30 AS n FROM nation)""")
def q_small_functions(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select((F.col("n_nationkey") * 30).alias("n"))
    end = F.when(F.col("n") % 2 == 0, F.col("n")).otherwise(F.col("n") + 3)
    return n.select(F.col("n").alias("depth"), T.depth_color(F.col("n"), ["a", "b", "c"]).alias("color"), T.search_limit(F.col("n")).alias("limit"), T.anchor_label(F.col("n"), end, F.when(F.col("n") % 2 == 0, "after-line").otherwise("range")).alias("label"))


@_query("SELECT item_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '…' ELSE text END AS short FROM (SELECT item_id, string_split(text, chr(10))[1] AS text FROM benchmark)")
def q_shortened(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", T.shortened(F.col("text"), 40).alias("short"))


@_query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 12 AS k FROM conversations),
  n AS (SELECT *, [NULL, '', '  ', chr(9) || 'x = 1 '][k % 4 + 1] AS snippet, CASE WHEN k < 10 THEN turn END AS end_line, [NULL, 'x = 1' || chr(13), ' '][k % 3 + 1] AS line FROM c)
SELECT conv_id, turn, CASE WHEN snippet IS NULL OR snippet = '' OR end_line IS NULL THEN false WHEN line IS NULL THEN true
  ELSE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> regexp_replace(snippet, '^\\s+|\\s+$', '', 'g') END AS drifted FROM n""")
def q_note_drift(spark, sf_dir):
    """Every snippet (none, empty, blank, text) with every state of its line (gone, the same, blank), some without end line."""
    k = (F.col("conv_id") + F.col("turn")) % 12
    pick = lambda *texts: F.get(F.array(*map(F.lit, texts)), (k % len(texts)).cast("int"))
    snippet, line = pick(None, "", "  ", "\tx = 1 "), pick(None, "x = 1\r", " ")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", notes.drifted(snippet, F.when(k < 10, F.col("turn")), line).alias("drifted"))


@_query("""WITH v AS (SELECT r_name AS iface_key, n_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 = 0 OR (n_nationkey % 3 = 1 AND r_regionkey % 2 = 0)),
  calls AS (SELECT c_custkey AS call_key, r_name AS iface_key, 'm' || c_custkey % 3 AS method_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT call_key, row_number() OVER (PARTITION BY call_key ORDER BY label, target_id) - 1 AS idx, target_id, label
FROM (SELECT call_key, s_suppkey AS target_id, CASE WHEN n_nationkey % 10 = 9 THEN '?' ELSE n_name END || '.' || method_name AS label
  FROM calls JOIN v USING (iface_key) JOIN supplier ON s_nationkey = n_nationkey AND 'm' || s_suppkey % 3 = method_name WHERE s_suppkey % 4 <> 0 AND s_acctbal >= 0)""")
def q_own_candidates(spark, sf_dir):
    nation, supplier = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    at = nation.join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    clause = F.element_at(F.array(F.lit("implements"), F.lit("extends"), F.lit("mixes")), F.col("n_nationkey") % 3 + 1)
    heritage = at.select(F.col("r_name").alias("owner_key"), F.col("n_nationkey").alias("class_key"), clause.alias("clause"), F.when(F.col("r_regionkey") % 2 == 0, "class").otherwise("interface").alias("owner_kind"))
    named = lambda c: F.concat(F.lit("m"), (F.col(c) % 3).cast("string")).alias("method_name")
    methods = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_nationkey").alias("type_key"), F.when(F.col("n_nationkey") % 10 != 9, F.col("n_name")).alias("class_name"), named("s_suppkey"), F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") % 4 != 0).alias("has_body"))
    calls = _t(spark, sf_dir, "customer").join(at, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("call_key"), F.col("r_name").alias("iface_key"), named("c_custkey"))
    return dispatch.own_candidates(calls, heritage, methods, supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("target_id")))


@_query("""WITH c AS (SELECT event_id AS call_key, event_type, CASE WHEN event_type <> 'purchase' THEN user_id END AS d, user_id % 5 AS u, EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal >= 0) AS body FROM events),
  k AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'fanout' WHEN d IS NULL THEN 'indirect' WHEN u = 0 THEN 'direct' WHEN u = 1 THEN 'interface' WHEN body OR u = 2 THEN 'direct' ELSE 'indirect' END AS kind FROM c)
SELECT call_key, kind, CASE WHEN kind = 'direct' AND u <> 0 AND body THEN d END AS target_id FROM k""")
def q_classify_declared(spark, sf_dir):
    u = F.col("user_id") % 5
    calls = _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_key"), F.when(F.col("event_type") == "signup", F.lit(1)).alias("observable_sym"), F.when(F.col("event_type") != "purchase", F.col("user_id")).alias("declaration"),
        (u == 0).alias("external"), (u == 1).alias("abstract"), (u == 2).alias("function_like"))
    known = _t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("target_id"))
    return dispatch.classify_declared(calls, known).select("call_key", "kind", "target_id")


@_query("""WITH f AS (SELECT 'u' || c_custkey % 60 AS name, min(c_custkey) AS t FROM customer GROUP BY 1)
SELECT event_id, CASE user_id % 3 WHEN 0 THEN user_id WHEN 1 THEN t ELSE CASE WHEN user_id % 2 = 0 THEN user_id END END AS callback_target
FROM events LEFT JOIN f ON name = 'u' || user_id % 70 AND user_id % 3 = 1 WHERE user_id % 3 = 0 OR (user_id % 3 = 1 AND t IS NOT NULL) OR (user_id % 3 = 2 AND user_id % 2 = 0)""")
def q_callbacks(spark, sf_dir):
    """What an argument of subscribe runs: a function written there, a named one, or that under ``next``."""
    u = F.col("user_id")
    subs = _t(spark, sf_dir, "events").select("event_id", F.when(u % 3 == 0, u).alias("inline_target"), F.when(u % 3 == 1, F.concat(F.lit("u"), (u % 70).cast("string"))).alias("argument_name"), F.when((u % 3 == 2) & (u % 2 == 0), u).alias("next_target"))
    functions = _t(spark, sf_dir, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 60).cast("string")).alias("name"), F.col("c_custkey").alias("target_id"))
    return dispatch.callbacks(subs, functions).select("event_id", "callback_target")


@_query("""WITH t AS (SELECT n_nationkey AS call_key, ['Subject', 'EventEmitter', 'subject', 'AsyncSubject', 'Subjects'][n_nationkey % 5 + 1] AS ty, ['a/rxjs/x.ts', 'a/rxjs.ts', '@angular/core/y.ts', 'src/rxjs-helpers/z.ts'][n_nationkey % 4 + 1] AS o, ['next', 'emit', 'send'][n_nationkey % 3 + 1] AS m FROM nation)
SELECT call_key FROM t WHERE ty IN ('Subject', 'EventEmitter', 'AsyncSubject') AND o IN ('a/rxjs/x.ts', '@angular/core/y.ts') AND m <> 'send'""")
def q_emits(spark, sf_dir):
    n = F.col("n_nationkey")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), n % len(names))
    calls = _t(spark, sf_dir, "nation").select(n.alias("call_key"), pick("next", "emit", "send").alias("method_name"), pick("Subject", "EventEmitter", "subject", "AsyncSubject", "Subjects").alias("type_name"), pick("a/rxjs/x.ts", "a/rxjs.ts", "@angular/core/y.ts", "src/rxjs-helpers/z.ts").alias("origin"))
    return dispatch.emits(calls).select("call_key")


@_query("""WITH b AS (SELECT s_nationkey, 'm' || s_suppkey % 7 AS name, min(s_suppkey) AS t FROM supplier WHERE s_suppkey % 4 <> 0 AND s_acctbal >= 0 GROUP BY 1, 2)
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN t END AS target_id, CASE WHEN page_id % 3 <> 0 AND t IS NOT NULL THEN 'direct' ELSE 'indirect' END AS kind FROM pages LEFT JOIN b ON s_nationkey = page_id % 25 AND name = 'm' || page_id % 7""")
def q_template_targets(spark, sf_dir):
    p, s = F.col("page_id"), _t(spark, sf_dir, "supplier")
    named = lambda c: F.concat(F.lit("m"), (F.col(c) % 7).cast("string")).alias("name")
    calls = _t(spark, sf_dir, "pages").select("page_id", (p % 25).alias("class_key"), named("page_id"), (p % 3 != 0).alias("implicit"))
    methods = s.select(F.col("s_nationkey").alias("class_key"), named("s_suppkey"), F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") % 4 != 0).alias("has_body"))
    return dispatch.template_targets(calls, methods, s.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("target_id"))).select("page_id", "target_id", "kind")


@_query("""WITH fn AS (SELECT DISTINCT p_type || '.' || replace(p_name, ' ', '_') AS title, p_brand || '#' || p_size AS target_id FROM part), tp AS (SELECT n_name || ' template' AS title, 'tpl#' || n_nationkey AS target_id FROM nation),
  names AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT DISTINCT p_brand || '#' || p_size FROM part),
  hits AS (SELECT name, 0 AS tier, title, target_id FROM names JOIN (SELECT * FROM fn UNION ALL SELECT * FROM tp) ON target_id = name
    UNION ALL SELECT name, 1, title, target_id FROM names JOIN fn ON title = name OR regexp_extract(title, '[^.]*$') = name
    UNION ALL SELECT name, 1, title, target_id FROM names JOIN tp ON contains(lower(title), lower(name)))
SELECT name, target_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, title, target_id) AS k FROM hits) WHERE k = 1""")
def q_lookup_names(spark, sf_dir):
    part, nation = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "nation")
    leaf = F.replace("p_name", F.lit(" "), F.lit("_"))
    ident = F.concat_ws("#", "p_brand", F.col("p_size").cast("string"))
    functions = part.select(ident.alias("target_id"), F.concat_ws(".", "p_type", leaf).alias("title")).distinct()
    templates = nation.select(F.concat(F.lit("tpl#"), F.col("n_nationkey").cast("string")).alias("target_id"), F.concat("n_name", F.lit(" template")).alias("title"))
    names = part.select(leaf.alias("name")).union(nation.select(F.lower("n_name"))).union(part.select(ident)).distinct()
    return lookup.lookup_names(functions, templates, names)


@_query("""WITH r AS (SELECT DISTINCT l_partkey AS target_id, l_suppkey AS file, l_orderkey % 5000 AS o FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'F' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)),
  k AS (SELECT l_suppkey AS file, l_orderkey % 5000 AS o, min(l_partkey) AS first, list_sort(list_distinct(list(l_partkey))) AS options FROM lineitem GROUP BY 1, 2),
  e AS (SELECT r.*, first, options, file * 100 + CASE WHEN o < 5500 THEN least(9, o // 500) END AS caller_id FROM r JOIN k USING (file, o)),
  m AS (SELECT *, CASE WHEN o % 3 = 0 AND first = target_id THEN 'call' WHEN o % 3 = 1 THEN 'interface' ELSE 'ref' END AS kind FROM e)
SELECT target_id, file, o AS "offset", caller_id, kind, CASE kind WHEN 'call' THEN 0 WHEN 'interface' THEN list_position(options, target_id) - 1 END::BIGINT AS choice FROM m""")
def q_usages_by_reference(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("*", (F.col("l_orderkey") % 5000).alias("offset"))
    refs = line.select(F.col("l_partkey").alias("target_id"), F.col("l_suppkey").alias("file"), "offset", F.lit(0).cast("long").alias("line"), (F.col("l_returnflag") == "R").alias("is_declaration"), (F.col("l_linestatus") == "F").alias("outside"))
    names = _t(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("target_id"))
    spans = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k"))
    spans = spans.select("file", (F.col("k") * 500).alias("start"), (F.col("k") * 500 + 700).alias("end"), (F.col("file") * 100 + F.col("k")).alias("span_id"))
    rule = F.col("offset") % 3
    calls = line.groupBy(F.col("l_suppkey").alias("file"), "offset").agg(F.min("l_partkey").alias("first"), F.array_sort(F.collect_set("l_partkey")).alias("options"))
    calls = calls.select("file", "offset", F.concat_ws(":", F.col("file").cast("string"), F.col("offset").cast("string")).alias("call_key"), F.when(rule == 0, "direct").when(rule == 1, "interface").otherwise("indirect").alias("kind"), F.when(rule == 0, F.col("first")).alias("target_id"), F.when(rule == 1, F.col("options")).alias("options"))
    return usages.references(refs, names, spans, calls).select("target_id", "file", "offset", "caller_id", "kind", "choice")


@_query("""WITH d AS (SELECT doc_id, text, strpos(text, chr(10)) AS cut FROM documents WHERE text IS NOT NULL), c AS (SELECT *, unnest([1, 2, 3]) AS k FROM d)
SELECT doc_id, length(text) - cut AS body_chars, k::BIGINT AS call, 5 * k::BIGINT AS span_start, 5 * k + 3::BIGINT AS span_end FROM c WHERE length(text) - cut >= 5 * k + 3""")
def q_frames(spark, sf_dir):
    """Documents stand for files, what follows the first line for a function in each, and three places in it for calls."""
    d = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.instr("text", "\n").alias("cut"))
    upto = lambda n: F.octet_length(F.substring("text", F.lit(1), n)).cast("long")
    target = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    targets = d.select(target.alias("target_id"), F.lit("t").alias("title"), F.col("doc_id").alias("file"), upto(F.col("cut")).alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(True).alias("has_body"), F.col("text").alias("source"))
    calls = d.select("*", F.explode(F.array(*[F.lit(k) for k in (3, 1, 2)])).alias("k")).where("length(text) - cut >= 5 * k + 3")
    calls = calls.select(target.alias("caller_id"), F.col("k").cast("long").alias("ast_order"), F.col("k").cast("long").alias("call"), upto(F.col("cut") + 5 * F.col("k")).alias("name_start"), upto(F.col("cut") + 5 * F.col("k") + 3).alias("name_end"))
    return frames(targets, calls).select(F.col("file").alias("doc_id"), F.length("source").cast("long").alias("body_chars"), F.explode("calls").alias("c")).select("doc_id", "body_chars", "c.call", "c.span_start", "c.span_end")


def _engine(spark, sf_dir):
    """Documents are files with one function each; line items are calls in them, to other documents' functions, or with options."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    name = lambda c: F.concat(F.lit("d"), (c % 100).cast("string"))
    target = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    n = F.size(T.lines(F.col("text"))).cast("long")
    targets = docs.select(target.alias("target_id"), F.concat(F.lit("T."), target).alias("title"), target.alias("file"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"), F.lit(1).cast("long").alias("start_line"), n.alias("end_line"), (F.col("doc_id") % 7 != 3).alias("has_body"))
    line = _t(spark, sf_dir, "lineitem")
    calls = line.select(_key().alias("call_key"), name(F.col("l_orderkey")).alias("caller_id"), F.col("l_linenumber").cast("long").alias("ast_order"), F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("name_start"), F.lit(1).cast("long").alias("name_end"), F.when(F.col("l_returnflag") == "A", name(F.col("l_partkey"))).alias("resolved_target")).dropDuplicates(["call_key"])
    options = line.where("l_returnflag = 'N'").select(_key().alias("call_key"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("idx"), name(F.col("l_suppkey")).alias("target_id")), F.struct(F.lit(1).cast("long").alias("idx"), name(F.col("l_suppkey") + 1).alias("target_id")))).alias("o")).select("call_key", "o.*")
    used = calls.where("resolved_target is not null").select(F.col("resolved_target").alias("target_id"), F.lit("call").alias("kind"), "caller_id", "call_key", "line", F.lit(0).cast("long").alias("choice"))
    files = docs.select(target.alias("file"), F.lit(True).alias("is_main_module"), F.col("text").alias("source"))
    idents = docs.select(target.alias("file"), F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 7, 12)])).alias("off_u16"), F.lit("name").alias("name"), F.lit("var").alias("obj_kind"))
    return Engine({"targets": targets, "call_sites": calls, "candidates": options, "usages": used, "source_files": files, "idents": idents})


_ENGINE_CALLS = f"(SELECT DISTINCT ON ({_KEY_SQL}) {_KEY_SQL} AS call_key, 'd' || l_orderkey % 100 AS caller_id, CASE WHEN l_returnflag = 'A' THEN 'd' || l_partkey % 100 END AS target_id FROM lineitem)"


@_query(f"SELECT 'd1' AS target_id, length(text) AS n_chars, call_key FROM documents, {_ENGINE_CALLS} WHERE doc_id = 1 AND caller_id = 'd1'")
def q_engine_frame(spark, sf_dir):
    f = _engine(spark, sf_dir).frame("d1")
    return f.select("target_id", F.length("source").cast("long").alias("n_chars"), F.explode("calls").alias("c")).select("target_id", "n_chars", "c.call_key")


@_query(f"SELECT 'file:./x/../d2' AS target_id, len(string_split(text, chr(10)))::BIGINT AS end_line, call_key FROM documents, {_ENGINE_CALLS} WHERE doc_id = 2 AND caller_id = 'd2'")
def q_engine_file_frame(spark, sf_dir):
    f = _engine(spark, sf_dir).frame("file:./x/../d2")
    return f.select("target_id", "end_line", F.explode("calls").alias("c")).select("target_id", "end_line", "c.call_key")


@_query(f"""SELECT 'T.' || caller_id AS caller_title, caller_id AS file, call_key, 1::BIGINT AS excerpt_line, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS excerpt
FROM {_ENGINE_CALLS} JOIN documents ON 'd' || doc_id = caller_id WHERE target_id = 'd1' AND text IS NOT NULL""")
def q_engine_usages(spark, sf_dir):
    return _engine(spark, sf_dir).usages("d1").select("caller_title", "file", "call_key", "excerpt_line", "excerpt")


@_query("""WITH p AS (SELECT doc_id, unnest([-1, 3, 4, 8, 13, 400]) AS o FROM documents WHERE text IS NOT NULL)
SELECT 'd' || doc_id AS file, o::BIGINT AS "offset", CASE WHEN o < 4 THEN 0 WHEN o < 11 THEN 7 ELSE 12 END::BIGINT AS off_u16 FROM p WHERE o IN (3, 8, 13)""")
def q_identifiers_at(spark, sf_dir):
    idents = _engine(spark, sf_dir).t["idents"]
    points = idents.select("file").distinct().select("file", F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 3, 4, 8, 13, 400)])).alias("offset"))
    return identifiers_at(idents, points).select("file", "offset", "off_u16")


@_query("""WITH n AS (SELECT doc_id AS note_id, doc_id % 20 AS file, 1 + doc_id % 50 + doc_id % 7 AS e, doc_id % 3 AS kind FROM labels), f AS (SELECT DISTINCT source AS src, replace(source, 'src', '')::BIGINT AS file FROM documents)
SELECT src AS frame_id, note_id, e - 10 AS "index" FROM n JOIN f USING (file) WHERE kind > 0 AND e BETWEEN 10 AND 40""")
def q_notes_in_frames(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("file-end"), F.lit("after-line"), F.lit("range")), (F.col("doc_id") % 3 + 1).cast("int"))
    n = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("file"), (1 + F.col("doc_id") % 50 + F.col("doc_id") % 7).alias("end_line"), kind.alias("kind"))
    f = _t(spark, sf_dir, "documents").select(F.col("source").alias("file")).distinct().select("file", F.col("file").alias("frame_id"), F.lit(10).cast("long").alias("start_line"), F.lit(40).cast("long").alias("end_line"))
    return intervals.notes_in_frames(n, f)


_NOTE_CHANGES = """WITH c AS (SELECT event_id AS seq, 'n' || user_id % 400 AS id, event_type = 'error' AS del, event_type = 'view' AND user_id % 3 = 0 AS bad, user_id % 400 < 300 AS held FROM events),
  g AS (SELECT *, coalesce(max(del::INT) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM c), k AS (SELECT *, CASE WHEN bad THEN 'bad anchor' WHEN NOT held OR dead = 1 THEN 'unknown note id' END AS reason FROM g)"""


def _noted(spark, sf_dir):
    anchor = lambda end: F.struct(F.lit("f.go").alias("file"), F.lit("range").alias("kind"), F.lit(2).cast("long").alias("startLine"), end.cast("long").alias("endLine"), F.lit("").alias("snippet"))
    held = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), anchor(F.lit(2)).alias("anchor"), F.lit("old").alias("text"), F.lit("0").alias("createdAt"), F.lit("0").alias("updatedAt"))
    bad = (F.col("event_type") == "view") & (F.col("user_id") % 3 == 0)
    changes = _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.concat(F.lit("n"), (F.col("user_id") % 400).cast("string")).alias("id"),
        anchor(F.when(bad, 1).otherwise(3)).alias("anchor"), F.col("event_id").cast("string").alias("text"), F.lit("1").alias("at"))
    return notes.applied(held, changes)


@_query(_NOTE_CHANGES + """, last AS (SELECT id, arg_max(del, seq) AS del, max(seq) AS seq FROM k WHERE reason IS NULL GROUP BY 1)
SELECT 'n' || i AS id, CASE WHEN seq IS NULL THEN 'old' ELSE seq::VARCHAR END AS text, '0' AS "createdAt" FROM range(300) r(i) LEFT JOIN last ON id = 'n' || i WHERE del IS NULL OR NOT del""")
def q_notes_applied(spark, sf_dir):
    return notes.listed(_noted(spark, sf_dir)[0]).select("id", "text", "createdAt")


@_query(_NOTE_CHANGES + " SELECT seq, id, reason FROM k WHERE reason IS NOT NULL")
def q_notes_rejected(spark, sf_dir):
    return _noted(spark, sf_dir)[1].select("seq", "id", "reason")


def _opened(spark, sf_dir):
    """Each conversation is a view in which one call after the other is open."""
    steps = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("view_id"), "turn").distinct().groupBy("view_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    steps = steps.select("view_id", F.transform("turns", lambda t: F.concat(t.cast("string"), F.lit("#0"))).alias("steps"))
    view = steps.select("view_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.slice("steps", F.lit(1), k))).alias("path"), F.lit("call").alias("kind"))
    at = F.slice("steps", 1, 1)
    return view, steps.where(F.size("steps") > 1).select("view_id", at.alias("path"), F.substring_index(F.get("steps", F.lit(1)), "#", 1).alias("call"), (F.col("view_id") % 3).cast("int").alias("choice"))


@_query("""WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c),
  p AS (SELECT a.conv_id, a.k, string_agg(b.turn || '#0', '>' ORDER BY b.k) AS path FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.k <= a.k GROUP BY 1, 2),
  two AS (SELECT x.conv_id, x.turn || '#0' AS one, y.turn AS second FROM r x JOIN r y ON x.conv_id = y.conv_id AND x.k = 1 AND y.k = 2)
SELECT 'collapse' AS edit, conv_id AS view_id, path FROM p WHERE k = 1 UNION ALL SELECT 'clear', conv_id, path FROM p WHERE k = 1
UNION ALL SELECT 'choice', conv_id, path FROM p WHERE k = 1 UNION ALL SELECT 'choice', conv_id, one || '>' || second || '#' || conv_id % 3 FROM two
UNION ALL SELECT 'fanout', conv_id, path FROM p UNION ALL SELECT 'fanout', conv_id, one || '>9000' FROM two UNION ALL SELECT 'fanout', conv_id, one || '>9000#1' FROM two
UNION ALL SELECT 'closed', conv_id, path FROM p""")
def q_view_edits(spark, sf_dir):
    view, edits = map(written, _opened(spark, sf_dir))
    other = edits.withColumn("call", F.lit("9000")).withColumn("choice", F.lit(1))
    second = other.withColumn("choice", F.lit(2))
    fanned = written(views.expand_receiver(written(views.expand_receiver(view, other)), second))  # each edit is stored
    fanned = written(views.collapse_receiver(fanned, second))
    every = {"collapse": views.collapse(view, edits), "clear": views.clear_children(view, edits), "choice": views.set_choice(view, edits), "fanout": fanned, "closed": views.close_fanout(fanned, other)}
    out = None
    for name, df in every.items():
        part = df.select(F.lit(name).alias("edit"), "view_id", F.array_join("path", ">").alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


@_query("""WITH f AS (SELECT DISTINCT 'root/app/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS file FROM pages), p AS (SELECT file, string_split(file, '/')[3:] AS p FROM f),
  n AS (SELECT DISTINCT array_to_string(p[1:d], '/') AS path, array_to_string(p[1:d - 1], '/') AS parent, p[d] AS name, d AS depth, d = len(p) AS is_file, CASE WHEN d = len(p) THEN 'file:' || file END AS target_id FROM p, unnest(range(1, len(p) + 1)) AS u(d))
SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_file, name) - 1 AS position FROM n""")
def q_file_tree(spark, sf_dir):
    file = F.concat(F.lit("root/app/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    return graph.file_tree(_t(spark, sf_dir, "pages").select(file.alias("file")).distinct())


@_query(_walk_sql("src", "dst").split("walk AS")[0] + """r AS (SELECT n_nationkey::BIGINT AS root, n_nationkey::BIGINT AS target, 0 AS depth FROM nation UNION SELECT root, dst, depth + 1 FROM r JOIN edges ON src = target WHERE depth < 3)
SELECT root, target, min(depth)::BIGINT AS depth FROM r GROUP BY 1, 2""")
def q_reach(spark, sf_dir):
    return graph.reach(_trade(spark, sf_dir), _roots(spark, sf_dir), 3)


@_query("""WITH s AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS fires_us, count(*) AS n_events FROM g GROUP BY k""")
def q_debounce_all(spark, sf_dir):
    d = reload.debounce(_t(spark, sf_dir, "events"), "10 minutes")
    return d.select(F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("fires_at").cast("timestamp")).alias("fires_us"), "n_events")


@_query("""SELECT p_partkey, regexp_replace(p_name, '(?i)(in)', '[\\1]', 'g') AS marked, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || '.' || p_name END AS display, '.../' || p_type || '/' || p_name AS pretty,
  'x.go' || CASE WHEN p_size % 2 = 0 THEN ':' || p_size ELSE '' END AS defined, ['code', '-g', '/a b/' || p_name || ':' || p_size] AS argv, p_size % 3 <> 1 AS matches, p_size % 4 <> 0 AS skipped, 1::BIGINT AS byte FROM part""")
def q_scalars(spark, sf_dir):
    n = F.col("p_size")
    marked = F.array_join(F.transform(T.highlighted(F.col("p_name"), F.lit(" IN ")), lambda s: F.when(s.hit, F.concat(F.lit("["), s.text, F.lit("]"))).otherwise(s.text)), "")
    where = F.concat(F.lit("a/b/x.go"), F.when(n % 2 == 0, F.concat(F.lit(":"), n.cast("string"))).otherwise(""))
    asked = F.get(F.array(F.lit("./x.go"), F.lit("y.go"), F.lit("a/x.go")), n % 3)
    folder = F.get(F.array(F.lit("src"), F.lit("vendor"), F.lit(".git"), F.lit(".")), n % 4)
    return _t(spark, sf_dir, "part").select(
        "p_partkey", marked.alias("marked"), T.display_name(F.when(n % 2 != 0, F.col("p_brand")), F.col("p_name")).alias("display"), T.pretty_name(F.concat_ws("/", F.lit("m"), "p_type", "p_name")).alias("pretty"),
        T.short_defined(where).alias("defined"), T.command(F.lit(" code  -g {file}:{line} "), F.concat(F.lit("/a b/"), "p_name"), n).alias("argv"), T.path_matches(F.lit("a/x.go"), asked).alias("matches"),
        T.is_skipped_dir(folder).alias("skipped"), T.utf16_to_byte(F.lit("aéb"), 1 + n % 2 * 0).alias("byte"))


@_query("""SELECT c_custkey, c_acctbal >= 0 AS kept, c_custkey % 3 = 0 AS was_bad FROM customer""")
def q_view_codec(spark, sf_dir):
    """A view's state to an address and back; what is no such code is an empty view."""
    state = F.struct(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("kept"))
    code = F.when(F.col("c_custkey") % 3 == 0, F.lit("%%%")).otherwise(views.encoded(state))
    back = views.decoded(code, "id bigint, kept boolean")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", back.alias("s"))
    return rows.select("c_custkey", F.coalesce("s.kept", F.col("c_acctbal") >= 0).alias("kept"), F.col("s.id").isNull().alias("was_bad"))


@_query("""WITH b AS (SELECT DISTINCT c_nationkey AS id FROM customer WHERE c_custkey % 5 = 0), a AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0)
SELECT 'add' AS op, id FROM (SELECT id FROM b UNION SELECT id FROM a) UNION ALL SELECT 'remove', id FROM b WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'toggle', id FROM (SELECT id FROM b EXCEPT SELECT id FROM a UNION (SELECT id FROM a EXCEPT SELECT id FROM b)) UNION ALL SELECT 'in', id FROM a WHERE id IN (SELECT id FROM b)""")
def q_bookmarks(spark, sf_dir):
    b = _t(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_nationkey").alias("id")).distinct()
    a = _t(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"))
    parts = {"add": views.add_bookmarks(b, a, ["id"]), "remove": views.remove_bookmarks(b, a, ["id"]), "toggle": views.toggle_bookmarks(b, a, ["id"]), "in": views.bookmarked(a, b, ["id"])}
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("op"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@_query("""WITH t AS (SELECT c_custkey, repeat('*', c_custkey % 3) || 'm.T' || c_custkey AS type_string, c_custkey % 5 AS k FROM customer),
  f AS (SELECT o_custkey, count(*) AS n, string_agg('    ' || CASE WHEN o_orderkey % 4 > 0 THEN 'F' || o_orderkey || ' ' ELSE '' END || o_orderpriority || chr(10), '' ORDER BY o_orderkey) AS fields FROM orders GROUP BY 1),
  m AS (SELECT o_custkey, string_agg('    F' || o_orderkey || o_orderpriority || chr(10), '' ORDER BY 'F' || o_orderkey) AS methods FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1)
SELECT type_string, CASE k WHEN 0 THEN CASE WHEN n IS NULL THEN 'struct{}' ELSE 'struct {' || chr(10) || fields || '}' END
  WHEN 1 THEN CASE WHEN methods IS NULL THEN 'interface{}' ELSE 'interface {' || chr(10) || methods || '}' END WHEN 3 THEN 'map[int]int' ELSE '' END AS definition
FROM t LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN m ON m.o_custkey = c_custkey""")
def q_definitions(spark, sf_dir):
    """Customers stand for named types of five shapes, their orders for members; every fourth order is an embedded field."""
    k, key = F.col("c_custkey") % 5, F.concat(F.lit("m.T"), F.col("c_custkey").cast("string"))
    customer, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    shape = F.get(F.array(*map(F.lit, ("struct", "interface", "signature", "other"))), k.cast("int"))
    named = customer.where(k < 4).select(key.alias("type_key"), shape.alias("shape"), F.lit("map[int]int").alias("underlying"))
    asked = customer.select(F.concat(F.expr("repeat('*', cast(c_custkey % 3 as int))"), key).alias("type_string"))
    embedded = F.col("o_orderkey") % 4 == 0
    method = F.col("o_custkey") % 5 == 1
    members = orders.where(~(method & embedded)).select(F.concat(F.lit("m.T"), F.col("o_custkey").cast("string")).alias("type_key"), F.col("o_orderkey").alias("ordinal"), F.when(~embedded, F.concat(F.lit("F"), F.col("o_orderkey").cast("string"))).alias("name"), F.when(method, F.concat(F.lit("func"), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("type"))
    return types.definitions(asked, named, members)


@_query("""WITH m AS (SELECT o_custkey // 3 AS g, o_orderkey, repeat(o_orderpriority, 1 + o_orderkey % 20) AS text FROM orders),
  l AS (SELECT g, count(*) AS n, string_agg('    ' || CASE WHEN length(text) > 100 THEN left(text, 97) || '…' ELSE text END || chr(10), '' ORDER BY o_orderkey) AS lines FROM m GROUP BY 1),
  t AS (SELECT DISTINCT c_custkey // 3 AS g FROM customer)
SELECT g AS type_key, CASE WHEN g % 6 <> 0 AND n BETWEEN 1 AND 24 THEN '{' || chr(10) || lines || '}' ELSE '' END AS definition FROM t LEFT JOIN l USING (g)""")
def q_structural_definitions(spark, sf_dir):
    """Three customers stand for a type, their orders for members whose text goes on after the first line."""
    group = lambda c: F.floor(F.col(c) / 3).cast("long").alias("type_key")
    named = _t(spark, sf_dir, "customer").select(group("c_custkey")).distinct().withColumn("telling", F.col("type_key") % 6 == 0)
    text = F.concat(F.lit(" "), F.expr("repeat(o_orderpriority, cast(1 + o_orderkey % 20 as int))"), F.lit("\t\nrest"))
    return types.structural_definitions(named, _t(spark, sf_dir, "orders").select(group("o_custkey"), F.col("o_orderkey").alias("ordinal"), text.alias("text")))


@_query("""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, text, unnest(range(1, 9)) AS k FROM d), o AS (SELECT doc_id, k, text, (k * 7919 + doc_id) % (length(text) + 40) AS place FROM c),
  l AS (SELECT doc_id, k, place, (len(string_split(left(text, place), chr(10))) - 1)::BIGINT AS line FROM o)
SELECT doc_id AS frame_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY place, k) - 1 AS position, k AS call_key FROM l""")
def q_calls_by_line(spark, sf_dir):
    """Documents stand for frames with eight calls each, some of them after the end."""
    d = _t(spark, sf_dir, "documents").where("text is not null")
    calls = d.select(F.col("doc_id").alias("frame_id"), F.length("text").alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("call_key"))
    calls = calls.select("frame_id", "call_key", ((F.col("call_key") * 7919 + F.col("frame_id")) % (F.col("n") + 40)).cast("long").alias("span_start"))
    return intervals.calls_by_line(d.select(F.col("doc_id").alias("frame_id"), F.col("text").alias("source")), calls)


@_query("""WITH d AS (SELECT doc_id, instr(text, ' ') AS cut, length(text) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, cut, n, unnest([-3, 0, 2, 5, 100000000]) AS o FROM d), q AS (SELECT *, unnest(['d', 'file:d', 'gone']) AS kind FROM p),
  i AS (SELECT doc_id, unnest([0, 3, 4]) AS off, unnest([20, 2, 9]) AS len, cut FROM d)
SELECT kind || q.doc_id AS target_id, o::BIGINT AS "offset", max(cut_off)::BIGINT AS off_u16 FROM q JOIN (SELECT doc_id, off + cut AS cut_off, off + cut + len AS cut_end FROM i) i USING (doc_id)
WHERE kind <> 'gone' AND o >= 0 AND cut_off <= o + CASE WHEN kind = 'd' THEN cut ELSE 0 END AND o + CASE WHEN kind = 'd' THEN cut ELSE 0 END < cut_end GROUP BY 1, 2""")
def q_type_infos(spark, sf_dir):
    """Documents stand for files, what follows the first blank for a target in each, with three identifiers, one around the others."""
    d = _t(spark, sf_dir, "documents").where("text is not null")
    name, cut = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.instr("text", " ").cast("long")
    files = d.select(name.alias("file"), F.col("text").alias("source"))
    targets = d.select(name.alias("target_id"), name.alias("file"), F.octet_length(F.substring("text", F.lit(1), cut.cast("int"))).cast("long").alias("start_byte"))
    ident = lambda off, n: F.struct((cut + off).alias("off_u16"), F.lit("x" * n).alias("name"))
    idents = d.select(name.alias("file"), F.explode(F.array(ident(0, 20), ident(3, 2), ident(4, 9))).alias("i")).select("file", "i.*")
    kinds = F.explode(F.array(*[F.concat(F.lit(p), name) for p in ("", "file:")], F.concat(F.lit("gone"), F.col("doc_id").cast("string")))).alias("target_id")
    points = d.select("doc_id", "text", kinds).select("target_id", F.explode(F.array(*[F.lit(o).cast("long") for o in (-3, 0, 2, 5, 100_000_000)])).alias("offset"))
    return Engine({"targets": targets, "source_files": files, "idents": idents}).type_infos(points).select("target_id", "offset", "off_u16")


@_query("""WITH RECURSIVE par AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0),
  pairs AS (SELECT c_custkey AS pair_id, c_custkey AS l, (c_custkey * 7 + c_nationkey) // 6 AS r FROM customer),
  a AS (SELECT * FROM (SELECT pair_id, 0 AS side, l AS c FROM pairs UNION ALL SELECT pair_id, 1, r FROM pairs) UNION SELECT pair_id, side, p FROM a JOIN par USING (c)),
  common AS (SELECT pair_id, c FROM a WHERE c IN (SELECT p_partkey FROM part) GROUP BY 1, 2 HAVING count(*) = 2),
  best AS (SELECT pair_id, c FROM common EXCEPT SELECT pair_id, p FROM common JOIN par USING (c))
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY p_size DESC, c) - 1 AS idx, c AS commit_id FROM best JOIN part ON p_partkey = c""")
def q_merge_bases(spark, sf_dir):
    """Parts stand for commits, whose parents are those of half and a third of their number; customers for pairs of versions."""
    part = _t(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("long")
    parents = F.when(key > 0, F.array_distinct(F.array(F.floor(key / 2), F.floor(key / 3)))).otherwise(F.array().cast("array<bigint>"))
    right = F.floor((F.col("c_custkey") * 7 + F.col("c_nationkey")) / 6)
    pairs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair_id"), F.col("c_custkey").cast("long").alias("left"), right.alias("right"))
    return graph.merge_bases(part.select(key.alias("commit_id"), parents.alias("parents"), F.col("p_size").alias("at")), pairs)


_ROUTE_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@_query(f"""WITH e AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
  reads AS (SELECT DISTINCT k // 10 AS g, user_id FROM e WHERE event_type = 'signup'),
  sends AS (SELECT 'e' || event_id AS call_key, 'channels' AS resolver, 'f' || user_id AS target_id FROM (SELECT event_id, k // 10 AS g FROM e WHERE event_type = 'error') JOIN reads USING (g)),
  asked AS (SELECT 'p' || page_id AS call_key, {_ROUTE_SQL} AS route FROM pages),
  table_ AS (SELECT '/' || string_split({_ROUTE_SQL}, '/')[2] || '/' AS pattern, min('h' || page_id) AS target_id FROM pages GROUP BY 1),
  every AS (SELECT * FROM sends UNION ALL SELECT call_key, 'routes', target_id FROM asked JOIN table_ ON starts_with(route, pattern))
SELECT call_key, resolver, row_number() OVER (PARTITION BY call_key ORDER BY 'at ' || target_id, target_id) - 1 AS idx, target_id FROM every""")
def q_resolvers(spark, sf_dir):
    """Events stand for sends and reads on channels, ten of which assignments make one; pages for requests, their first folders for routes."""
    e = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    pages = _t(spark, sf_dir, "pages").withColumn("route", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", ""))
    none = F.lit(None).cast("string")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sends = e.where("event_type = 'error'").select(name("e", "event_id").alias("call_key"), F.col("k").alias("channel"), none.alias("route"))
    calls = sends.unionByName(pages.select(name("p", "page_id").alias("call_key"), F.lit(None).cast("long").alias("channel"), "route"))
    handler = lambda p, c: (name(p, c).alias("target_id"), F.concat(F.lit("at "), name(p, c)).alias("label"), none.alias("provenance"))
    facts = {
        "channel_flows": e.select((F.floor(F.col("k") / 10) * 10).alias("source"), F.col("k").alias("target")).distinct(),
        "channel_reads": e.where("event_type = 'signup'").select(F.col("k").alias("channel"), *handler("f", "user_id")),
        "routes": pages.select(F.concat(F.lit("/"), F.split("route", "/")[1], F.lit("/")).alias("pattern"), *handler("h", "page_id")),
    }
    return resolvers.Resolvers(resolvers.Channels(), resolvers.Routes()).resolve(calls, facts).select("call_key", "resolver", "idx", "target_id")


@_query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, k AS line, (k - 1 + coalesce(list_sum(list_transform(l[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start, length(l[k]) AS n_chars FROM l, unnest(range(1, len(l) + 1)) AS u(k)""")
def q_source_lines(spark, sf_dir):
    """The table function of lines, called for each document by a lateral join."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    resolvers.register(spark)
    return spark.sql("SELECT doc_id, line, start, length(l.text)::bigint AS n_chars FROM {docs} d, LATERAL source_lines(d.text) l", docs=docs)
