from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.operators import dispatch, intervals, resolvers, usages


def _facts(spark):
    calls = spark.createDataFrame([(f"c{k}", "i" if k % 3 else "j", "m", k - 2) for k in range(12)] + [("none", "x", "m", 0)], "call_key string, iface_key string, method_name string, choice int")
    impls = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "b")], "iface_key string, type_key string")
    methods = spark.createDataFrame([("a", "m", 1, "q"), ("a", "m", 2, "p"), ("b", "m", 3, "o"), ("b", "m", 2, "n"), ("b", "m", 4, "a")], "type_key string, method_name string, target_id long, label string")
    return calls, impls, methods, spark.createDataFrame([(1,), (2,), (3,)], "target_id long")


def test_chosen_candidates_are_those_of_the_list(spark):
    calls, impls, methods, known = _facts(spark)
    listed = dispatch.candidates(calls, impls, methods, ["label", "target_id"], known)
    options = listed.groupBy("call_key").agg(F.sort_array(F.collect_list(F.struct("idx", "target_id"))).alias("o")).join(calls, "call_key")
    want = options.select("call_key", dispatch.chosen(F.col("o"), F.col("choice"))["target_id"]).collect()
    got = dispatch.chosen_candidates(calls, impls, methods, ["label", "target_id"], known).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 12


def test_candidates_are_counted_without_a_list(spark):
    calls, impls, methods, known = _facts(spark)
    listed = dispatch.candidates(calls, impls, methods, ["label", "target_id"], known)
    want = listed.groupBy("target_id").agg(F.count("*").alias("n"))
    counted = dispatch.candidate_counts(calls, impls, methods, known)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    both = usages.counts(spark.createDataFrame([(1, "call"), (1, "interface")], "target_id long, kind string"), counted.withColumn("kind", F.lit("interface")))
    assert {(r.target_id, r.kind): r.n for r in both.collect()}[1, "interface"] == 1 + {r.target_id: r.n for r in counted.collect()}[1]


def test_only_options_among_targets_are_listed_under_their_numbers(spark):
    calls, impls, methods, known = _facts(spark)
    all_, some = (dispatch.candidates(calls, impls, methods, ["label", "target_id"], known, t) for t in (None, known.where("target_id <> 2")))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, all_.where("target_id <> 2").collect()))


def test_shared_receivers_are_numbered_as_those_of_each_call(spark):
    """A call key may stand for calls of several channels; receivers it shares come once."""

    class Apart(resolvers.Channels):
        shared = property()  # so that there is none

        def receivers(self, calls, facts):
            of, reached = resolvers.Channels().shared(calls, facts)
            return of.join(reached, "group").select("call_key", "target_id", "label", "provenance")

    calls = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "x"), ("c", "x")], "call_key string, channel string")
    facts = {
        "channel_flows": spark.createDataFrame([("y", "z")], "source string, target string"),
        "channel_reads": spark.createDataFrame([("x", "t", "2", "p"), ("x", "s", "1", "p"), ("y", "t", "0", "q"), ("z", "t", "3", None), ("z", "u", None, None)], "channel string, target_id string, label string, provenance string"),
    }
    got, want = (sorted(map(repr, resolvers.Resolvers(r).resolve(calls, facts).collect())) for r in (resolvers.Channels(), Apart()))
    assert got == want and len(got) == 3 + 2 + 2


def test_points_meet_only_widths_that_spans_have(spark):
    """A point is not copied for each width there could be, a size no join foresees."""
    points = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("at"))
    spans = spark.range(100).select((F.col("id") % 5).alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4 + F.col("id") % 3 * 50).alias("end"))
    found = intervals.containing(points, spans, ["k"])
    want = points.join(spans, "k").where("start <= at and at < end")
    assert sorted(map(tuple, found.select("k", "at", "start", "end").collect())) == sorted(map(tuple, want.select("k", "at", "start", "end").collect()))
    assert "0,1,2,3,4" not in found._jdf.queryExecution().toString().replace(" ", "")


def test_listed_meets_all_in_small_places(spark, monkeypatch):
    """Many blocks, parts and slices a key give each call each option once; calls of equal or null key stay apart."""
    for name, n in {"BLOCK": 2, "GATHERED": 4, "PART": 8, "SLICE": 3, "MANY": 1}.items():
        monkeypatch.setattr(dispatch, name, n)
    calls = spark.createDataFrame([(f"c{k}", k % 3) for k in range(90)] + [(None, 0), ("c0", 0), ("alone", 7), ("none", None)], "call_key string, k int")
    options = spark.range(40).select((F.col("id") % 2).cast("int").alias("k"), F.floor(F.col("id") / 2).alias("idx"), F.col("id").alias("target_id"))
    got = dispatch.listed(calls, options, ["k"]).select("call_key", "k", "idx", "target_id").collect()
    want = calls.join(options, "k").select("call_key", "k", "idx", "target_id").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 62 * 20
    assert dispatch.listed(calls.where("false"), options, ["k"]).count() == 0


def test_listed_receivers_take_little_space(spark, tmp_path):
    """What grows with calls times receivers is the result, so it decides how much disk there must be."""
    emits = spark.range(8000).select(F.concat(F.lit("lib/module/file.go:"), F.col("id") * 7919).alias("call_key"), (F.col("id") % 2).alias("observable_sym"))
    subs = spark.range(2002).select((F.col("id") % 2).alias("observable_sym"), (F.col("id") * 31).alias("callback_target"), F.concat(F.lit("user "), F.col("id")).alias("label"))
    dispatch.receivers(emits, subs).write.parquet(f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == 8000 * 1001 and sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.4 * n


def test_options_with_gaps_meet_all_calls(spark, monkeypatch):
    """Options that are left of many keep numbers beyond their count; none is lost where options of a key meet calls in slices."""
    monkeypatch.setattr(dispatch, "SLICE", 2)
    calls, impls, methods, known = _facts(spark)
    all_, last = (dispatch.candidates(calls, impls, methods, ["label", "target_id"], None, t) for t in (None, known.where("target_id = 1")))
    want = sorted(map(tuple, all_.where("target_id = 1").collect()))
    assert sorted(map(tuple, last.collect())) == want and {r[1] for r in want} == {4}


def test_listed_calls_move_once(spark):
    """Calls are as many as the input's rows, so each further exchange of them takes as much disk again; equal ones are found where they are gathered."""
    calls = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 1000).alias("call_key"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("iface_key"), F.lit("m").alias("method_name"))
    impls = spark.createDataFrame([("a", "t"), ("b", "t")], "iface_key string, type_key string")
    methods = spark.createDataFrame([("t", "m", 1, "p"), ("t", "m", 2, "q")], "type_key string, method_name string, target_id long, label string")
    once = dispatch.candidates(calls, impls, methods, ["label"], once=True)
    assert once.count() == 2000 == once.distinct().count() and dispatch.candidates(calls, impls, methods, ["label"]).count() == 6000
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_few_calls_of_many_options_are_dealt_over_tasks(spark):
    """How long a task takes goes by the rows it lists, not by the few bytes of what meets."""
    calls = spark.range(4500).select(F.col("id").alias("call_key"), F.lit(1).alias("k"))
    options = spark.range(9000).select(F.lit(1).alias("k"), F.col("id").alias("idx"))
    found = dispatch.listed(calls, options, ["k"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("call_key").alias("c")).collect()
    assert sum(r.n for r in found) == 4500 * 9000 and len(found) > 1 and max(r.n for r in found) < 4500 * 9000


def test_usages_list_callers_with_their_calls(spark):
    """What is worked out for each row that is listed is worked out calls times options often."""
    calls, impls, methods, known = _facts(spark)
    got = dispatch.candidates(calls, impls, methods, ["label", "target_id"], known, also=("choice",))
    want = dispatch.candidates(calls, impls, methods, ["label", "target_id"], known).join(calls.select("call_key", "choice"), "call_key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    plan = catalog.q_usages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(call_key" not in plan
