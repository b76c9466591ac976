"""Chat formatting: link tool calls with their results, order and validate them, write canonical JSON.

Calls and results meet by a hash join on (conversation, call id). A call's level is the longest chain of
calls that it depends on. Calls with one dependency form chains, which are followed by pointer jumping: a
chain of n calls takes log2(n) rounds of joins. What is left, calls with several dependencies, is ordered
topologically, one round for each such call on the longest path. Arguments are JSON; they are compared with
a schema table, in which a nested member is named by its path, and written with sorted names.

All of it is DataFrame operations; nothing gathers a conversation, so one conversation may hold any share
of the rows, and calls that many others depend on are joined in parts.

Defined results: a call without a result has a null result; of several results for a call the least
text is taken and n_results counts them; repeated calls are one call, the least by turn, name and arguments;
calls in a cycle, or behind one, have a null level; dependencies on unknown calls are ignored; a call with
a null conversation or call id has a row of its own, no result and a null level; null arguments are none;
a null argument counts as missing; arguments that aren't a JSON object have the problem ``arguments``, a
tool without schema ``tool``; very long texts are written whole; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.names import broadcast_if_small, spread_join
from voxtable.plans.storage import materialize

KEY = ["conv_id", "call_id"]
#: What a value's variant type begins with, by JSON schema type; integer has a rule of its own.
KINDS = {"string": "STRING", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
INTEGER = r"^(BIGINT|DECIMAL\(\d+,\s*0\))$"
#: Names of the tools' argument schemas that may be broadcast.
SCHEMA_ROWS = 20_000


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (conv_id, turn, call_id, name, arguments, depends_on) with result and n_results. Null keys match nothing."""
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    parts = ["turn", "name", "arguments", "depends_on"]
    once = calls.filter(known).groupBy(*KEY).agg(F.min(F.struct(*parts)).alias("c")).select(*KEY, "c.*")
    answers = results.groupBy(*KEY).agg(F.min("content").alias("result"), F.count("*").alias("n_results"))
    linked = once.join(answers, KEY, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    # calls without keys take no part in the join, where they would all be one key's rows
    alone = calls.filter(~known).select(*KEY, *parts, F.lit(None).cast("string").alias("result"), F.lit(0).cast("long").alias("n_results"))
    return linked.unionByName(alone)


def _chains(singles: DataFrame) -> DataFrame:
    """(conv_id, call_id, ahead, distance, moving): for calls with one dependency the first call on their way that
    has none or several. Those that still move after enough rounds are on the way to a cycle."""
    now = materialize(singles.select(*KEY, F.col("parent").alias("ahead"), F.lit(1).alias("distance"), F.lit(True).alias("moving")), "chains")
    for _ in range(math.ceil(math.log2(max(now.count(), 1) + 1)) + 1):
        step = now.select("conv_id", F.col("call_id").alias("ahead"), F.col("ahead").alias("next"), F.col("distance").alias("more"))
        met = spread_join(now.filter("moving"), step, ["conv_id", "ahead"], "call_id")
        moved = met.select(*KEY, F.coalesce("next", "ahead").alias("ahead"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), F.col("next").isNotNull().alias("moving"))
        now = materialize(now.filter("not moving").unionByName(moved), "chains")
        if now.filter("moving").isEmpty():
            break
    return now


def levels(linked: DataFrame) -> DataFrame:
    """linked with level: 0 for calls without known dependencies, else one more than the highest of theirs."""
    keyless = F.col("conv_id").isNull() | F.col("call_id").isNull()
    alone, linked = linked.filter(keyless).withColumn("level", F.lit(None).cast("int")), linked.filter(~keyless)
    nodes = materialize(linked.select(*KEY), "calls")
    asked = linked.join(nodes, KEY, "left_semi").select(*KEY, F.explode("depends_on").alias("parent")).filter("parent is not null").distinct()
    there = nodes.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("there"))
    edges = materialize(spread_join(asked, there, ["conv_id", "parent"], "call_id").filter("there").drop("there"), "dependencies")
    degree = edges.groupBy(*KEY).agg(F.count("*").alias("parents"), F.first("parent").alias("parent"))
    chains = _chains(degree.filter("parents = 1"))
    several = materialize(degree.filter("parents > 1").select(*KEY), "several")
    roots = nodes.join(degree, KEY, "left_anti").select(*KEY, F.lit(0).alias("level"))
    # dependencies of calls with several, moved along chains to calls with none or several; cycles stay blocked
    way = chains.select("conv_id", F.col("call_id").alias("parent"), "ahead", "distance", "moving")
    ways = spread_join(edges.join(several, KEY, "left_semi"), way, ["conv_id", "parent"], "call_id")
    waiting = materialize(ways.select(*KEY, F.coalesce("ahead", "parent").alias("ahead"), (F.coalesce("distance", F.lit(0)) + 1).alias("distance"), F.coalesce("moving", F.lit(False)).alias("blocked")), "waiting")
    done = materialize(roots, "levels")
    fresh_levels = done
    while not (waiting.isEmpty() or fresh_levels.isEmpty()):
        known = done.select("conv_id", F.col("call_id").alias("ahead"), F.col("level").alias("below"))
        met = spread_join(waiting, known, ["conv_id", "ahead"], "call_id").withColumn("open", F.col("blocked") | F.col("below").isNull())
        ready = met.groupBy(*KEY).agg(F.max("open").alias("open"), F.max(F.col("below") + F.col("distance")).alias("level")).filter("not open").select(*KEY, "level")
        fresh_levels = materialize(ready, "ready")
        waiting = materialize(waiting.join(fresh_levels, KEY, "left_anti"), "waiting")
        done = materialize(done.unionByName(fresh_levels), "levels")
    ends = done.select("conv_id", F.col("call_id").alias("ahead"), F.col("level").alias("below"))
    single = spread_join(chains.filter("not moving"), ends, ["conv_id", "ahead"], "call_id").select(*KEY, (F.col("below") + F.col("distance")).alias("level"))
    return linked.join(done.unionByName(single), KEY, "left").withColumn("level", F.col("level").cast("int")).unionByName(alone)


def _members(value: Column, path: Column | None = None) -> Column:
    """array<struct<path, parent, kind, json, value>> of an object's members."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    name = lambda e: e["key"] if path is None else F.concat(path, F.lit("."), e["key"])
    return F.transform(entries, lambda e: F.struct(name(e).alias("path"), (F.lit("") if path is None else path).alias("parent"), F.schema_of_variant(e["value"]).alias("kind"), F.to_json(e["value"]).alias("json"), e["value"].alias("value")))


def _flat(value: Column, depth: int) -> Column:
    """The members of an object and of the objects in it, ``depth`` levels down."""
    out = now = _members(value)
    for _ in range(depth):
        inner = F.filter(now, lambda m: m["kind"].startswith("OBJECT"))
        now = F.flatten(F.transform(inner, lambda m: _members(m["value"], m["path"])))
        out = F.concat(out, now)
    return F.transform(out, lambda m: F.struct(m["path"].alias("path"), m["parent"].alias("parent"), m["kind"].alias("kind"), m["json"].alias("json")))


def _fits(rule: Column, kind: Column) -> Column:
    """Whether a value's variant type is one of a rule's type."""
    fits = (rule["type"] == "integer") & kind.rlike(INTEGER)
    for name, pattern in KINDS.items():
        fits = fits | ((rule["type"] == name) & kind.rlike(f"^({pattern})"))
        if name not in ("array", "object"):
            fits = fits | ((rule["type"] == f"array<{name}>") & kind.rlike(rf"^ARRAY<({pattern}|VOID)"))
    return fits | ((rule["type"] == "array<integer>") & kind.rlike(r"^ARRAY<(BIGINT|DECIMAL\(\d+,\s*0\)|VOID)>"))


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with problems: arguments, tool, or unknown, missing and mistyped arguments and values that aren't
    allowed, with their paths, sorted. schemas: name, arg (path with dots), type, required and, if it has the
    column, allowed (array of values as JSON). Each call is checked in its own row."""
    held = schemas if "allowed" in schemas.columns else schemas.withColumn("allowed", F.lit(None).cast("array<string>"))
    held = materialize(held.select("name", "arg", "type", "required", "allowed"), "schemas")
    depth = (held.agg(F.max(F.size(F.split("arg", r"\.")))).first()[0] or 1) - 1
    rules = held.groupBy("name").agg(F.collect_list(F.struct("arg", "type", "required", "allowed")).alias("rules"))
    rules = broadcast_if_small(materialize(rules, "rules"), SCHEMA_ROWS)
    parsed = calls.withColumn("parsed", F.coalesce(F.try_parse_json("arguments"), F.when(F.col("arguments").isNull(), F.parse_json(F.lit("{}")))))
    parsed = parsed.withColumn("given", F.when(F.schema_of_variant("parsed").startswith("OBJECT"), _flat(F.col("parsed"), depth)))
    checked = parsed.join(rules, "name", "left")
    present = F.filter("given", lambda m: m["kind"] != "VOID")
    declared = lambda m: F.exists("rules", lambda r: r["arg"] == m["path"])
    strict = lambda m: (m["parent"] == "") | F.exists("rules", lambda r: r["arg"].startswith(F.concat(m["parent"], F.lit("."))))
    unknown = F.transform(F.filter(present, lambda m: ~declared(m) & strict(m)), lambda m: F.concat(F.lit("unknown:"), m["path"]))
    wrong = lambda r, m: (r["arg"] == m["path"]) & ~_fits(r, m["kind"])
    typed = F.transform(F.filter(present, lambda m: F.exists("rules", lambda r: wrong(r, m))), lambda m: F.concat(F.lit("type:"), m["path"]))
    barred = lambda r, m: (r["arg"] == m["path"]) & F.coalesce(~F.array_contains(r["allowed"], m["json"]), F.lit(False))
    valued = F.transform(F.filter(present, lambda m: F.exists("rules", lambda r: barred(r, m))), lambda m: F.concat(F.lit("value:"), m["path"]))
    has = lambda path: F.exists(present, lambda m: m["path"] == path)
    parent = lambda r: F.regexp_extract(r["arg"], r"^(.*)\.[^.]*$", 1)
    lacking = F.filter("rules", lambda r: F.coalesce(r["required"], F.lit(False)) & ~has(r["arg"]) & ((parent(r) == "") | has(parent(r))))
    missing = F.transform(lacking, lambda r: F.concat(F.lit("missing:"), r["arg"]))
    found = F.array_sort(F.array_distinct(F.concat(unknown, typed, valued, missing)))
    out = F.when(F.col("given").isNull(), F.array(F.lit("arguments"))).when(F.col("rules").isNull(), F.array(F.lit("tool"))).otherwise(found)
    return checked.withColumn("problems", out).drop("given", "rules")


def canonical(call_id: Column, name: Column, arguments: Column, result: Column) -> Column:
    """JSON with sorted names at every level and no white space, from parsed arguments; null members of the
    call are left out."""
    return F.to_json(F.struct(arguments.alias("arguments"), call_id.alias("id"), name.alias("name"), result.alias("result")))


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, level, turn (together its place in the topological order), call_id,
    n_results, valid, problems and its canonical JSON."""
    linked = materialize(link(calls, results), "linked")
    out = problems(levels(linked), schemas)
    return out.select("conv_id", "call_id", "level", "turn", "n_results", (F.size("problems") == 0).alias("valid"), F.array_join("problems", ",").alias("problems"), canonical(F.col("call_id"), F.col("name"), F.col("parsed"), F.col("result")).alias("json"))


def calls_from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations: a user turn calls the assistant, whose next turn is the
    result, and depends on the call two turns before; in every tenth conversation also on the one two turns
    later, which makes cycles. Long questions lack an option's member, and short ones have a wrong type."""
    users = turns.filter("role = 'user'")
    size = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    at = lambda k: F.concat(F.lit("call_"), F.col("turn") + k)
    options = F.struct(F.array(F.lit(2), size).alias("limits"), F.when(F.length("text") <= 200, F.col("turn") % 4 == 0).alias("deep"))
    texts = F.to_json(F.struct(F.col("text").alias("question"), options.alias("options"), F.when(F.length("text") < 40, size.cast("string")).alias("n_words")))
    numbers = F.to_json(F.struct(F.col("text").alias("question"), options.alias("options"), size.alias("n_words")))
    calls = users.select(
        "conv_id", "turn", at(0).alias("call_id"), F.lit("answer").alias("name"), F.when(F.length("text") < 40, texts).otherwise(numbers).alias("arguments"),
        F.when(F.col("conv_id") % 10 == 0, F.array(at(-2), at(2))).otherwise(F.array(at(-2))).alias("depends_on"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", at(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
