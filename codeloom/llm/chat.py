"""Chat formatting in Spark expressions only (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, with what stands for each inside a text.
HEAD, END, PART = "### ", "</turn>\n", "</part>"
ESCAPES = (("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p"))
ROLE_ESCAPES = ((":", "\\c"), ("\n", "\\l"))
#: Values of ``turn`` in one first-step group.
CHUNK = 64
#: Entries of an array that are looked at together, so that work stays linear in long arrays.
BLOCK = 256


def _swap(c: Column, pairs, back: bool = False) -> Column:
    for plain, coded in reversed(pairs) if back else pairs:
        c = F.replace(c, F.lit(coded if back else plain), F.lit(plain if back else coded))
    return c


def escape(text: Column) -> Column:
    """Text without control strings; every backslash is followed by a code letter."""
    return _swap(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _swap(text, ESCAPES, back=True)


def _header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), _swap(_swap(role, ESCAPES), ROLE_ESCAPES), F.lit(":\n"))


def _let(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once; what stands in a lambda is else computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(array: Column, f) -> Column:
    """``f`` (block, its number) of each ``BLOCK`` entries of ``array``, in order."""
    numbers = F.when(F.size(array) > 0, F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(numbers, lambda k: _let(F.slice(array, k * BLOCK + 1, F.lit(BLOCK)), lambda block: f(block, k)))


def _running(sizes: Column) -> Column:
    """The sum of the entries before each entry. Appending copies, so this is for blocks and for arrays of blocks."""
    none = F.expr("cast(array() as array<bigint>)")
    start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("before"))
    return F.aggregate(sizes, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before")))["before"]


def _placed(entries: Column, size) -> Column:
    """``entries`` as (at, e): each with the sum of ``size`` over those before it."""
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, e: a + size(e))
    within = lambda block, first: F.zip_with(_running(F.transform(block, size)), block, lambda at, e: F.struct((first + at).alias("at"), e.alias("e")))
    return _let(
        _running(_blocks(entries, lambda block, _: total(block))),
        lambda starts: F.flatten(_blocks(entries, lambda block, k: _let(F.get(starts, k), lambda first: within(block, first)))))


def chat_format(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length in code points, from 0).

    ``turns`` has conv_id, turn, role, text; rows follow each other by turn,
    then role, then text; null turns come first, null role and text are
    empty. Adjacent turns of one role share a header and an end mark, with a
    part mark between them, so every turn can be read back. Control strings
    inside texts are escaped reversibly; texts may be of any length.

    Equal rows are counted first and stay one entry until the string is
    built, so a conversation of many repeated rows does not weigh on one
    task; then structs are collected and sorted in chunks of 64 turn numbers,
    and the chunks' strings are joined for each conversation. Work is linear
    in the turns of a chunk and in the chunks of a conversation. Rows with a
    null conv_id form one conversation; other columns are ignored; no rows
    give no rows.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    chunks = counted.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n"))).alias("sorted"))
    chunks = chunks.select("conv_id", "chunk", F.transform("sorted", lambda x: F.struct(x.role.alias("role"), escape(x.text).alias("text"), x.n.alias("n"))).alias("turns"))
    # an entry is a turn and its repeats, each led by a part mark
    lead = lambda x, i: F.when(i == 0, "").when(F.get("turns", i - 1).role == x.role, PART).otherwise(F.concat(F.lit(END), _header(x.role)))
    chunks = chunks.select("conv_id", "chunk", F.transform("turns", lambda x, i: F.struct(lead(x, i).alias("lead"), x.text.alias("text"), x.role.alias("role"), x.n.alias("n"))).alias("turns"))
    size = lambda x: (F.length(x["lead"]) + F.length(x["text"]) * x["n"] + (x["n"] - 1) * len(PART)).cast("long")
    repeats = lambda p: F.transform(F.sequence(F.lit(0), p.e["n"] - 1), lambda r: F.struct((p.at + F.length(p.e["lead"]) + r * (F.length(p.e["text"]) + len(PART))).alias("start"), F.length(p.e["text"]).cast("long").alias("length")))
    spans = F.flatten(F.transform(F.filter(_placed(F.col("turns"), size), lambda p: p.e["role"] == loss_role), repeats))
    body = F.transform("turns", lambda x: F.concat(x.lead, x.text, F.repeat(F.concat(F.lit(PART), x.text), x.n - 1)))
    chunks = chunks.select("conv_id", F.struct(
        "chunk", F.array_join(body, "").alias("body"), F.get("turns", F.lit(0)).role.alias("first"), F.element_at("turns", -1).role.alias("last"), spans.alias("spans")).alias("c"))
    convs = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    convs = convs.select("conv_id", F.transform("cs", lambda c, i: F.struct(
        F.when(i == 0, _header(c["first"])).when(F.get("cs", i - 1)["last"] == c["first"], PART).otherwise(F.concat(F.lit(END), _header(c["first"]))).alias("lead"),
        c.body.alias("body"), c.spans.alias("spans"))).alias("cs"))
    moved = F.transform(
        _placed(F.col("cs"), lambda c: (F.length(c["lead"]) + F.length(c["body"])).cast("long")),
        lambda p: F.transform(p.e["spans"], lambda s: F.struct((s.start + p.at + F.length(p.e["lead"])).alias("start"), s.length.alias("length"))))
    return convs.select("conv_id", F.concat(F.array_join(F.transform("cs", lambda c: F.concat(c.lead, c.body)), ""), F.lit(END)).alias("formatted"), F.flatten(moved).alias("loss_spans"))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped: what ``loss_spans`` cut out of ``formatted``, joined.

    A block of spans is cut out of its part of the string, since places are
    found by counting code points from the start of what is cut.
    """
    cut = lambda text, start, length: text.substr((start + 1).cast("int"), length.cast("int"))

    def block(spans, _):
        first, last = F.get(spans, F.lit(0)), F.element_at(spans, -1)
        part = F.array(F.struct(cut(formatted, first["start"], last["start"] + last["length"] - first["start"]).alias("text"), first["start"].alias("start")))
        return F.array_join(F.flatten(F.transform(part, lambda p: F.transform(spans, lambda s: unescape(cut(p["text"], s["start"] - p["start"], s["length"]))))), "")

    return F.array_join(_blocks(loss_spans, block), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped, in order."""
    blocks = F.split(formatted, END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block):
        cut = F.instr(block, ":\n")
        role = _swap(_swap(block.substr(F.lit(len(HEAD) + 1), cut - len(HEAD) - 1), ROLE_ESCAPES, back=True), ESCAPES, back=True)
        parts = F.split(block.substr(cut + 2, F.length(block)), PART, -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))
