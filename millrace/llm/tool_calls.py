"""Chat formatting: link tool calls with their results, order, validate and serialise them.

A message is plain text, or a JSON object: {"tools": [{"name", "parameters": {"properties":
{name: {"type"}}, "required": [...]}}]} declares tools for its conversation, {"tool_calls":
[{"id", "name", "arguments"}]} calls them, {"tool_call_id", "content"} is a result. A call
whose arguments hold the string "$<id>" depends on the call of that id.

Calls and results meet in an equi-join on a hash of conversation and identifier (the
identifiers themselves are compared too). The order is topological: level 0 calls depend
on nothing, the others come after all that they depend on; a call in a cycle or behind one
has no level. A message's calls are put in that order, those without a level last.
JSON is canonical: keys sorted, no spaces.

Arguments are valid if they fit the tool's schema at every depth: type (one, or a list of
them), enum, required, properties and items. A name that isn't listed is invalid where the
schema lists names, unless additionalProperties is true; the top level always lists them.
A schema without type takes any. "$<id>" of a call in the conversation has any type;
any other string that begins with $ is a string.

Plan: SQL functions only. Plain messages pass one projection and are united with the rest;
only calls, results and tools are shuffled. A row is returned for each message, so a very
long conversation is never gathered. Schemas and arguments become rows of (path, value), a
round for each depth, and meet in a join by path. Each level of dependencies is one round
over the edges that are still open; tables go to the shared folder.

Defined results: a null or empty text is a plain message with an empty text; text that is
no JSON object of the above kinds is plain. Calls or results without an identifier link
with nothing. Where ids repeat in a conversation, the call at the smallest turn counts as
the one that others link to. Repeated rows each stay. Null conversation ids are one
conversation. Extra columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch

_SCHEMA = (
    "tools array<struct<name:string,parameters:string>>, "
    "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, content string"
)
#: What a JSON schema type is called in Spark's schema of a variant.
_TYPES = {"string": r"^STRING", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": r"^BOOLEAN", "array": r"^ARRAY", "object": r"^OBJECT", "null": r"^VOID"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(json))


def _key(*of: str) -> Column:
    return F.xxhash64(*of)


def _row_key(*of: str) -> Column:
    """128 bits of hashes of a whole row, as a string: 64 would collide among 10^12 messages."""
    return F.concat_ws("_", *[F.xxhash64(F.lit(seed), *of).cast("string") for seed in (1, 2)])


def parsed_messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, tools, calls, result_of, content): the last four null in plain messages."""
    whole = F.coalesce(F.col(text), F.lit(""))
    is_json = F.startswith(F.btrim(whole, F.lit(SPACES)), F.lit("{")) & whole.rlike('"(tools|tool_calls|tool_call_id)"')
    x = F.when(is_json, F.from_json(whole, _SCHEMA))
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), whole.alias("text"), x.alias("x"))
    return out.select("conv", "turn", "role", "text", F.col("x.tools").alias("tools"), F.col("x.tool_calls").alias("calls"), F.col("x.tool_call_id").alias("result_of"), F.col("x.content").alias("content"))


def levels(heads: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, id, level) of the heads (conv, id) that are in no cycle and behind none; needs: (conv, id, need)."""
    same = lambda x, c, d: F.col("conv").eqNullSafe(F.col(c)) & (F.col(x) == F.col(d))
    names = lambda df: df.select(F.col("conv").alias("c"), F.col("id").alias("d"))
    open_ = scratch.write(needs.distinct(), "needs")
    new = heads.join(names(open_), same("id", "c", "d"), "left_anti").select("conv", "id", F.lit(0).alias("level"))
    done, level = new, 0
    while not open_.isEmpty():
        new, level = new if level else scratch.write(new, "level"), level + 1
        done = new if level == 1 else done.union(new)
        met = open_.join(names(new), same("need", "c", "d"), "left_semi").select("conv", "id").distinct()
        rest = scratch.write(open_.join(names(new), same("need", "c", "d"), "left_anti"), "needs")
        new = scratch.write(met.join(names(rest), same("id", "c", "d"), "left_anti").withColumn("level", F.lit(level)), "level")
        scratch.drop(open_)
        open_ = rest
        if new.isEmpty():  # the rest is in cycles or behind them
            return done
    return done if level == 0 else done.union(new)


def by_path(rows: DataFrame, children, scratch: Scratch) -> DataFrame:
    """rows with a JSON value, and its parts at every depth: path, parent (a path) and json; children(variant) gives (step, json)."""
    keys = [c for c in rows.columns if c != "json"]
    now = scratch.write(rows.select(*keys, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), "json"), "depth")
    out = now
    while True:
        below = now.select(*keys, F.col("path").alias("parent"), F.explode(children(F.try_parse_json("json"))).alias("x"))
        now = scratch.write(below.select(*keys, F.concat("parent", "x.step").alias("path"), "parent", "x.json"), "depth")
        if now.isEmpty():
            return out
        out = out.union(now)


def _entries(v: Column, path: str) -> Column:
    parts = F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))
    return F.coalesce(F.transform(parts, lambda e: F.struct(F.concat(F.lit("/k:"), F.replace(e["key"], F.lit("/"), F.lit("//"))).alias("step"), F.to_json(e["value"]).alias("json"))), F.array())


def _item(v: Column) -> Column:
    return F.struct(F.lit("/i").alias("step"), F.to_json(v).alias("json"))


def schema_parts(v: Column) -> Column:
    items = F.try_variant_get(v, "$.items", "variant")
    return F.concat(_entries(v, "$.properties"), F.when(items.isNotNull(), F.array(_item(items))).otherwise(F.array()))


def value_parts(v: Column) -> Column:
    return F.concat(_entries(v, "$"), F.coalesce(F.transform(F.try_variant_get(v, "$", "array<variant>"), _item), F.array()))


def validated(values: DataFrame, tools: DataFrame, scratch: Scratch) -> DataFrame:
    """(call, valid): whether the values (call, conv, name, path, parent, json, known) fit the schemas (conv, name, json)."""
    v = F.try_parse_json("json")
    kinds = F.coalesce(F.try_variant_get(v, "$.type", "array<string>"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.type", "variant")) == "STRING", F.array(F.try_variant_get(v, "$.type", "string"))))
    names = F.try_variant_get(v, "$.properties", "map<string,variant>")
    schema = scratch.write(
        by_path(tools, schema_parts, scratch).select(
            F.col("conv").alias("c"),
            F.col("name").alias("tool"),
            F.col("path").alias("p"),
            kinds.alias("kinds"),
            F.transform(F.try_variant_get(v, "$.enum", "array<variant>"), lambda x: F.to_json(x)).alias("enum"),
            F.try_variant_get(v, "$.required", "array<string>").alias("required"),
            ((names.isNotNull() | (F.col("path") == "")) & ~F.coalesce(F.try_variant_get(v, "$.additionalProperties", "boolean"), F.lit(False))).alias("closed"),
        ),
        "schema",
    )
    at = lambda path: F.col("conv").eqNullSafe(F.col("c")) & (F.col("name") == F.col("tool")) & (F.col(path) == F.col("p"))
    met = values.join(schema, at("path"), "left").drop("c", "tool")
    up = schema.select("c", "tool", F.col("p").alias("pp"), F.col("closed").alias("shut"))
    met = met.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("name") == F.col("tool")) & (F.col("parent") == F.col("pp")), "left")
    kind, keys = F.schema_of_variant(v), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    of_kind = F.exists("kinds", lambda k: F.coalesce(*[F.when(k == name, kind.rlike(pattern)) for name, pattern in _TYPES.items()], F.lit(False)))
    fits = (
        (F.col("kinds").isNull() | of_kind)
        & (F.col("enum").isNull() | F.array_contains("enum", F.to_json(v)))
        & (F.col("required").isNull() | keys.isNull() | F.forall("required", lambda r: F.array_contains(keys, r)))
        & ((F.col("path") != "") | keys.isNotNull())
    )
    # Without a schema of its own, a part is free unless its parent lists names; the top level needs its tool.
    free = (F.col("path") != "") & ~(F.coalesce("shut", F.lit(False)) & F.startswith(F.substring("path", F.length("parent") + 1, F.lit(3)), F.lit("/k:")))
    good = F.when(F.col("p").isNull(), free).otherwise(fits | (F.col("known") & (F.col("path") != "")))
    return met.groupBy("call").agg(F.min(F.coalesce(good, F.lit(False))).alias("valid"))


def link_tool_calls(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: conv, turn, role, kind, n_calls, n_linked, n_valid, level and canonical json."""
    scratch = Scratch(rows.sparkSession, "calls")
    parsed = parsed_messages(rows, conv, turn, role, text)
    plain = F.col("calls").isNull() & F.col("result_of").isNull() & F.col("tools").isNull()
    special = scratch.write(parsed.where(~plain).withColumn("row", _row_key("conv", "turn", "role", "text")).dropDuplicates(["conv", "turn", "role", "text"]), "special")

    declared = special.select("conv", "turn", F.explode("tools").alias("t")).select("conv", "turn", "t.name", canonical(F.coalesce("t.parameters", F.lit("{}"))).alias("json"))
    first = Window.partitionBy("conv", "name").orderBy("turn", "json")
    declared = declared.where("name is not null").withColumn("n", F.row_number().over(first)).where("n = 1").select("conv", "name", "json")

    calls = special.select("conv", "turn", "row", F.posexplode("calls").alias("pos", "c")).select("conv", "turn", "row", "pos", "c.id", "c.name", canonical(F.col("c.arguments")).alias("arguments"))
    calls = scratch.write(calls.withColumns({"key": _key("conv", "id"), "call": F.concat_ws(":", "row", "pos")}), "calls")
    # The call that an id stands for.
    head = calls.where("id is not null").withColumn("n", F.row_number().over(Window.partitionBy("conv", "id").orderBy("turn", "pos", "row"))).where("n = 1")
    head = scratch.write(head.select("conv", "id", "key", "name", F.col("turn").alias("call_turn"), "call"), "heads")

    values = by_path(calls.where("arguments is not null").select("call", "conv", "name", F.col("arguments").alias("json")), value_parts, scratch)
    need = F.when(F.col("json").startswith('"$'), F.substring(F.try_variant_get(F.try_parse_json("json"), "$", "string"), 2, 1 << 30))
    heads_ = head.select(F.col("conv").alias("hc"), F.col("id").alias("hid"), F.lit(True).alias("known"))
    values = values.withColumn("need", need).join(heads_, F.col("conv").eqNullSafe(F.col("hc")) & (F.col("need") == F.col("hid")), "left")
    values = scratch.write(values.select("call", "conv", "name", "path", "parent", "json", F.when(F.col("known"), F.col("need")).alias("need"), F.coalesce("known", F.lit(False)).alias("known")), "values")
    needs = values.where("known").select("call", "need").join(head.select("conv", "id", "call"), "call").select("conv", "id", "need")
    level = levels(head, needs, scratch).select(F.col("conv").alias("lc"), F.col("id").alias("lid"), "level")
    calls = calls.join(validated(values, declared, scratch), "call", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))

    results = special.where("result_of is not null").select("conv", "turn", "row", F.col("result_of").alias("id"), "content").withColumn("key", _key("conv", "id"))
    answered = results.groupBy("key", "conv", "id").agg(F.min("turn").alias("result_turn")).withColumnsRenamed({"key": "k", "conv": "rc", "id": "rid"})
    same = lambda k, c, i: (F.col("key") == F.col(k)) & F.col("conv").eqNullSafe(F.col(c)) & (F.col("id") == F.col(i))
    joined = calls.join(answered, same("k", "rc", "rid"), "left").join(level, F.col("conv").eqNullSafe(F.col("lc")) & (F.col("id") == F.col("lid")), "left")
    place = F.coalesce("level", F.lit((1 << 31) - 1))
    one = F.struct(place.alias("place"), "pos", F.struct("arguments", "id", "level", "name", "result_turn", "valid").alias("call"))
    by_row = joined.groupBy("row").agg(
        F.array_sort(F.collect_list(one)).alias("found"),  # bounded by the message
        F.count("result_turn").alias("linked"),
        F.count_if("valid").alias("valid"),
        F.max("level").alias("top"),
    )
    heads = head.select(F.col("key").alias("k"), F.col("conv").alias("hc"), F.col("id").alias("hid"), "name", "call_turn").join(level, F.col("hc").eqNullSafe(F.col("lc")) & (F.col("hid") == F.col("lid")), "left")
    by_result = results.join(heads, same("k", "hc", "hid"), "left").select("row", "name", "call_turn", F.col("level").alias("result_level"))
    extra = by_row.withColumnRenamed("row", "r").join(by_result.withColumnRenamed("row", "r"), "r", "full")

    message = lambda **more: F.to_json(F.struct(*[c.alias(k) for k, c in sorted({"conv_id": F.col("conv"), "role": F.col("role"), "turn": F.col("turn"), **more}.items())]), {"ignoreNullFields": "false"})
    every = parsed.where(~plain).withColumn("row", _row_key("conv", "turn", "role", "text")).join(extra, F.col("row") == F.col("r"), "left")
    kind = F.when(F.col("calls").isNotNull(), "calls").when(F.col("result_of").isNotNull(), "result").when(F.col("tools").isNotNull(), "tools").otherwise("plain")
    calls_json = F.transform("found", lambda x: x["call"])
    json = (
        F.when(kind == "calls", message(calls=calls_json))
        .when(kind == "result", message(call_turn=F.col("call_turn"), content=F.coalesce(canonical(F.col("content")), F.col("content")), name=F.col("name"), tool_call_id=F.col("result_of")))
        .when(kind == "tools", message(tools=canonical(F.get_json_object("text", "$.tools"))))
        .otherwise(message(content=F.col("text")))
    )
    linked = every.select(
        F.col("conv").alias(conv),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        kind.alias("kind"),
        F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce(F.when(kind == "result", F.col("call_turn").isNotNull().cast("int")).otherwise(F.col("linked")), F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("valid", F.lit(0)).cast("long").alias("n_valid"),
        F.when(kind == "result", F.col("result_level")).otherwise(F.col("top")).alias("level"),
        json.alias("json"),
    )
    zero, no_level = F.lit(0).cast("long"), F.lit(None).cast("int")
    rest = parsed.where(plain).select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.lit("plain").alias("kind"), zero.alias("n_calls"), zero.alias("n_linked"), zero.alias("n_valid"), no_level.alias("level"), message(content=F.col("text")).alias("json"))
    return rest.union(linked)
