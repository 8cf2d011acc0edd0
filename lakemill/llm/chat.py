"""Chat formatting with linked tool calls, in DataFrame operations alone.

A message is one row. An assistant's text that is a JSON object with ``tool_calls`` (objects with id, name and arguments)
makes calls; a tool's text that is a JSON object with ``tool_call_id`` is a result. Calls and results are hash-joined by
conversation and identifier. An argument that is a string of "$" and an identifier refers to the result of an earlier call.
The order is topological: a result comes after its call, a message after the results that its calls refer to, and everything
else by its turn. Arguments are validated against the schemas of the tools. Every message is serialised as canonical JSON:
sorted keys, no spaces. Nothing gathers a conversation in one task, so one of any length is as good as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.store import materialise

#: Per tool, the type of each argument (string, number, boolean, object, array) and whether it is required.
Schemas = dict[str, dict[str, tuple[str, bool]]]
SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("number", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
}
_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _kind(value: Column) -> Column:
    of = F.schema_of_variant(value)
    return F.when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of == "VOID", "null").otherwise("number")


def errors_of(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """The faults of a call's arguments, sorted: unknown tool, malformed, missing, unknown or mistyped arguments."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(F.to_json(value))
    out = F.array(F.lit("unknown tool"))
    for tool, spec in schemas.items():
        faults = []
        for arg, (kind, required) in spec.items():
            own = F.try_variant_get(value, f'$["{arg}"]', "variant")
            there = F.array_contains(keys, arg)
            if required:
                faults.append(F.when(~there, f"missing {arg}"))
            faults.append(F.when(there & (F.coalesce(_kind(own), F.lit("null")) != kind), f"{arg} is not a {kind}"))
        unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, spec))), lambda k: F.concat(F.lit("unknown "), k))
        some = F.array_sort(F.concat(F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>"), unknown))
        out = F.when(name == tool, F.when(keys.isNull(), F.array(F.lit("malformed"))).otherwise(some)).otherwise(out)
    return out


def _places(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, anchor, level) of messages whose calls refer to results: the longest way there, in order of (anchor,
    level). A reference leads to an earlier turn, so there are no cycles; a round moves what lies behind late results by one
    reference, so a conversation in order takes one round and only chains of late results take more."""
    now = edges.select("conv_id", "turn").union(edges.select("conv_id", F.col("call_turn").alias("turn"))).distinct()
    now = materialise(now.withColumn("at", F.struct(F.col("turn").cast("long").alias("anchor"), F.lit(0).cast("long").alias("level"))), "places")
    after = lambda at: F.struct(at["anchor"].alias("anchor"), (at["level"] + 1).alias("level"))
    while True:
        before = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("at").alias("call_at"))
        reached = edges.join(before, (F.col("conv_id") == F.col("c")) & (F.col("call_turn") == F.col("t")))
        result_at = F.greatest(after(F.col("call_at")), F.struct(F.col("result_turn").cast("long").alias("anchor"), F.lit(0).cast("long").alias("level")))
        least = reached.groupBy("conv_id", "turn").agg(F.max(after(F.when(F.col("result_turn").isNull(), F.col("call_at")).otherwise(result_at))).alias("least"))
        least = least.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "least")
        moved = now.join(least, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
        moved = materialise(moved.select("conv_id", "turn", F.greatest("at", F.coalesce("least", "at")).alias("at"), F.coalesce(F.col("least") > F.col("at"), F.lit(False)).alias("moved")), "places")
        now = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return now.select("conv_id", "turn", "at.anchor", "at.level")


def link_tool_calls(messages: DataFrame, schemas: Schemas = SCHEMAS) -> DataFrame:
    """(conv_id, turn, anchor, level, role, n_calls, call_id, linked_turn, errors, message) for every message.

    Sorting a conversation by (anchor, level, turn) is its topological order: anchor is the turn itself or, for what must wait,
    that of the last message it waits for, and level counts the steps behind that one. ``linked_turn`` is the call's turn, null
    for an orphan. Of calls that repeat an identifier the first counts, and of results the first is what references wait for.
    ``errors`` lists the faults of a message's calls and references, sorted, and "orphan result". Null texts are empty content,
    null roles "user"; rows with null ids stay and link with nothing; repeated rows stay; no rows in, none out; extra columns
    are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), text.alias("text"))
    is_json = F.startswith(F.ltrim("text"), F.lit("{"))
    parsed = F.when(is_json & (F.col("role") == "assistant") & F.contains("text", F.lit("tool_calls")) & F.try_parse_json("text").isNotNull(), F.from_json("text", _CALLS))
    answer = F.when(is_json & (F.col("role") == "tool") & F.try_parse_json("text").isNotNull(), F.from_json("text", _RESULT))
    rows = rows.withColumn("p", parsed).withColumn("a", answer)
    asks = F.coalesce(F.col("a.tool_call_id").isNotNull(), F.lit(False))
    makes = F.coalesce(F.size("p.tool_calls") > 0, F.lit(False))
    calls = rows.where(makes).select("conv_id", "turn", F.explode("p.tool_calls").alias("c")).select("conv_id", "turn", "c.id", "c.arguments")
    calls = materialise(calls, "calls")
    first = calls.where("id is not null").groupBy(F.col("conv_id").alias("of"), "id").agg(F.min("turn").alias("made"))
    answers = rows.where(asks).groupBy(F.col("conv_id").alias("in"), F.col("a.tool_call_id").alias("to")).agg(F.min("turn").alias("result_turn"))
    named = F.filter(F.map_values(F.from_json("arguments", "map<string,string>")), lambda v: F.coalesce(F.startswith(v, F.lit("$")) & (F.length(v) > 1), F.lit(False)))
    refs = calls.select("conv_id", "turn", "id", F.explode(named).alias("ref")).select("conv_id", "turn", F.coalesce("id", F.lit("")).alias("by"), F.substring("ref", 2, 2**31 - 1).alias("ref")).distinct()
    refs = refs.join(first.withColumnRenamed("id", "known"), (F.col("conv_id") == F.col("of")) & (F.col("ref") == F.col("known")) & (F.col("made") < F.col("turn")), "left")
    refs = refs.join(answers, (F.col("conv_id") == F.col("in")) & (F.col("ref") == F.col("to")), "left")
    refs = materialise(refs.select("conv_id", "turn", "by", "ref", F.col("made").alias("call_turn"), F.when(F.col("made").isNotNull(), F.col("result_turn")).alias("result_turn")), "references")
    broken = F.when(F.col("call_turn").isNull(), F.concat("by", F.lit(": no earlier call "), "ref")).when(F.col("result_turn").isNull(), F.concat("by", F.lit(": no result of "), "ref"))
    broken = refs.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.array_sort(F.collect_set(broken)).alias("broken"))
    places = _places(refs.where("call_turn is not null")).select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), "anchor", "level")
    placed = materialise(first.join(places, (F.col("of") == F.col("c2")) & (F.col("made") == F.col("t2")), "left").select("of", "id", "made", F.coalesce("anchor", F.col("made").cast("long")).alias("call_anchor"), F.coalesce("level", F.lit(0)).cast("long").alias("call_level")), "placed")
    nothing = F.array().cast("array<string>")
    at = F.struct(F.col("turn").cast("long").alias("anchor"), F.lit(0).cast("long").alias("level"))
    behind = F.struct(F.col("call_anchor").alias("anchor"), (F.col("call_level") + 1).alias("level"))
    results = rows.where(asks).join(placed, (F.col("conv_id") == F.col("of")) & (F.col("a.tool_call_id") == F.col("id")), "left").withColumn("at", F.when(F.col("made").isNull(), at).otherwise(F.greatest(at, behind))).withColumn("broken", nothing)
    callers = rows.where(makes & ~asks).join(broken, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").join(places, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    callers = callers.withColumn("at", F.when(F.col("anchor").isNull(), at).otherwise(F.struct("anchor", "level"))).withColumn("broken", F.coalesce("broken", nothing)).withColumn("made", F.lit(None))
    plain = rows.where(~makes & ~asks).withColumn("at", at).withColumn("broken", nothing).withColumn("made", F.lit(None))
    columns = ["conv_id", "turn", "role", "text", "p", "a", "at", "broken", F.col("made").cast("long").alias("made")]
    everything = plain.select(*columns).union(callers.select(*columns)).union(results.select(*columns))
    faults = F.flatten(F.transform(F.coalesce("p.tool_calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: F.transform(errors_of(c["name"], F.coalesce(c["arguments"], F.lit("{}")), schemas), lambda e: F.concat_ws(": ", F.coalesce(c["id"], F.lit("")), e))))
    orphan = F.when(asks & F.col("made").isNull(), F.array(F.lit("orphan result"))).otherwise(F.array().cast("array<string>"))
    tidy = F.transform("p.tool_calls", lambda c: F.struct(F.coalesce(canonical(c["arguments"]), c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\x22v\x22:(.*)\}$", 1)
    made = F.concat(F.lit('{"content":'), quote(F.coalesce(F.col("p.content"), F.lit(""))), F.lit(',"role":"assistant","tool_calls":'), F.to_json(tidy), F.lit("}"))
    given = F.concat(F.lit('{"content":'), quote(F.coalesce(canonical(F.col("a.content")), F.col("a.content"), F.lit(""))), F.lit(',"role":"tool","tool_call_id":'), quote(F.col("a.tool_call_id")), F.lit("}"))
    plain = F.concat(F.lit('{"content":'), quote(F.col("text")), F.lit(',"role":'), quote(F.col("role")), F.lit("}"))
    return everything.select(
        "conv_id", "turn", "at.anchor", F.col("at.level").cast("int").alias("level"), "role",
        F.greatest(F.coalesce(F.size("p.tool_calls"), F.lit(0)), F.lit(0)).alias("n_calls"), F.col("a.tool_call_id").alias("call_id"), F.col("made").alias("linked_turn"),
        F.array_join(F.array_sort(F.concat(faults, "broken", orphan)), "; ").alias("errors"),
        F.when(F.size("p.tool_calls") > 0, made).when(asks, given).otherwise(plain).alias("message"),
    )


#: Links and order from DuckDB's own JSON functions and a recursion over references; canonical forms of tool messages and the
#: faults of arguments are left to the tests, and the given conversations hold none.
ORACLE = """
with recursive m as (
  select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text,
         case when ltrim(coalesce(text, '')) like '{%' and json_valid(text) then text::json end as doc from conversations),
r as (select *, case when role = 'assistant' and json_type(doc, '$.tool_calls') = 'ARRAY' then doc -> '$.tool_calls' end as calls,
             case when role = 'tool' then doc ->> '$.tool_call_id' end as call_id from m),
c as (select conv_id, turn, unnest(from_json(calls, '["json"]')) as call from r where calls is not null),
first as (select conv_id, call ->> '$.id' as id, min(turn) as made from c where call ->> '$.id' is not null group by 1, 2),
answer as (select conv_id, call_id as id, min(turn) as result_turn from r where call_id is not null group by 1, 2),
args as (select conv_id, turn, case when json_type(call, '$.arguments') = 'VARCHAR' then call ->> '$.arguments' else (call -> '$.arguments')::varchar end as a from c),
edge as (select n.conv_id, n.turn, f.made as call_turn, w.result_turn from
           (select distinct conv_id, turn, substring(e.value ->> '$', 2) as ref from args, json_each(args.a) e where json_valid(a) and json_type(e.value) = 'VARCHAR' and e.value ->> '$' like '$_%') n
           join first f on f.conv_id = n.conv_id and f.id = n.ref and f.made < n.turn left join answer w on w.conv_id = n.conv_id and w.id = n.ref),
way as (select distinct conv_id, call_turn as turn, call_turn::bigint as anchor, 0::bigint as level from edge
        union select conv_id, turn, turn::bigint, 0::bigint from edge
        union select e.conv_id, e.turn, case when e.result_turn > w.anchor then e.result_turn else w.anchor end,
                     case when e.result_turn is null then w.level + 1 when e.result_turn > w.anchor then 1 else w.level + 2 end
              from way w join edge e on e.conv_id = w.conv_id and e.call_turn = w.turn),
place as (select conv_id, turn, max((anchor, level)) as pl from way group by 1, 2),
placed as (select f.conv_id, f.id, f.made, coalesce(p.pl, (f.made::bigint, 0::bigint)) as pl from first f left join place p on p.conv_id = f.conv_id and p.turn = f.made),
o as (select r.*, d.made, case when d.made is not null then greatest((r.turn::bigint, 0::bigint), (d.pl[1], d.pl[2] + 1))
                               when r.calls is not null then coalesce(p.pl, (r.turn::bigint, 0::bigint)) else (r.turn::bigint, 0::bigint) end as pl
      from r left join placed d on d.conv_id = r.conv_id and d.id = r.call_id left join place p on p.conv_id = r.conv_id and p.turn = r.turn)
select conv_id, turn, pl[1]::bigint as anchor, pl[2]::integer as level, role, coalesce(json_array_length(calls), 0)::integer as n_calls,
       call_id, made::bigint as linked_turn, case when call_id is not null and made is null then 'orphan result' else '' end as errors,
       '{"content":' || to_json(text)::varchar || ',"role":' || to_json(role)::varchar || '}' as message
from o
"""
