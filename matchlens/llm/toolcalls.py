"""Chat formatting: linking tool calls with their results (operator 4), in DataFrame functions only.

Calls and results meet in a hash join by identifier; calls are put in topological order of
what they depend on, their arguments are validated against the tools' schemas, and each is
written as canonical JSON (keys in order, no white space).  Every row of the inputs is in
the result: what does not link is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import shared_dir, stored

#: Most tools whose schemas (about 1 kB each) are broadcast.
BROADCAST_TOOLS = 10_000
ID = ["conv_id", "call_id"]
#: Contraction goes on while a round takes at least this part of the edges.
WORTH = 0.1


class _Grown:
    """A table in the shared folder that rounds append to; it is read once, at the end."""

    def __init__(self, spark, schema: str):
        self.spark, self.schema, self.path = spark, schema, shared_dir(spark)
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _jumped(single: DataFrame) -> DataFrame:
    """*single* (conv_id, node, on, w: the one edge of each node) with every ``on`` moved to
    the first that has no single edge, or null where the edges run in a circle.

    Each round doubles the distance covered, so rounds are the logarithm of the longest
    chain; a conversation's chain is no longer than its nodes are many."""
    longest = single.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        to = single.select("conv_id", F.col("node").alias("on"), F.col("on").alias("_on"), F.col("w").alias("_w"))
        single = single.join(to, ["conv_id", "on"], "left").select("conv_id", "node", F.coalesce("_on", "on").alias("on"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.col("_on").isNotNull().alias("moved"))
        single = stored(single)
        if single.where("moved").isEmpty():
            return single.drop("moved")
        single = single.drop("moved")
    inside = single.select("conv_id", F.col("node").alias("on"), F.lit(True).alias("_in"))
    return stored(single.join(inside, ["conv_id", "on"], "left").select("conv_id", "node", F.when(F.col("_in").isNull(), F.col("on")).alias("on"), "w"))


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the highest of
    theirs; null on and behind a cycle.  *calls*: conv_id, call_id, depends_on (array).

    Chains of calls with one dependency each are contracted by pointer jumping (rounds: the
    logarithm of their length), which leaves calls with several; where all of those lead to
    one call, they are contracted in turn.  The rest is settled by a frontier, a round for
    each level of what is left.  Every round reads and writes tables of a fixed plan.
    Dependencies on calls that do not exist count for nothing; those of repeated calls all
    count.
    """
    spark = calls.sparkSession
    every = calls.select(*ID).distinct()
    raw = calls.select("conv_id", F.col("call_id").alias("node"), F.explode("depends_on").alias("on")).where("on is not null").distinct()
    edges = stored(raw.join(every.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi").select("conv_id", "node", "on", F.lit(1).alias("w")))
    sources = every.join(edges.select("conv_id", F.col("node").alias("call_id")), ID, "left_anti").withColumn("level", F.lit(0))
    levels = _Grown(spark, f"conv_id {dict(calls.dtypes)['conv_id']}, call_id {dict(calls.dtypes)['call_id']}, level int")
    levels.add(sources)
    chains: list[DataFrame] = []
    left = edges.count()
    while left:
        degree = edges.groupBy("conv_id", "node").agg(F.count("*").alias("n"))
        single = stored(edges.join(degree.where("n = 1"), ["conv_id", "node"], "left_semi").select("conv_id", "node", "on", "w"))
        if single.isEmpty():
            break
        chain = _jumped(single)
        chains.append(chain)
        to = chain.select("conv_id", F.col("node").alias("on"), F.col("on").alias("_on"), F.col("w").alias("_w"), F.lit(True).alias("_in"))
        several = edges.join(degree.where("n > 1"), ["conv_id", "node"], "left_semi").join(to, ["conv_id", "on"], "left")
        # An edge to a circle stays as it is: what it leads to is never settled.
        on = F.when(F.col("_in") & F.col("_on").isNotNull(), F.col("_on")).otherwise(F.col("on"))
        edges = stored(several.select("conv_id", "node", on.alias("on"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")).groupBy("conv_id", "node", "on").agg(F.max("w").alias("w")))
        before, left = left, edges.count()
        if before - left < WORTH * before:
            break
    _settle(edges, levels)
    for chain in reversed(chains):
        known = levels.read().select("conv_id", F.col("call_id").alias("on"), "level")
        levels.add(stored(chain.join(known, ["conv_id", "on"]).select("conv_id", F.col("node").alias("call_id"), (F.col("level") + F.col("w")).cast("int").alias("level"))))
    return every.join(levels.read(), ID, "left")


def _settle(edges: DataFrame, levels: _Grown) -> None:
    """Add the levels of the nodes of *edges* (conv_id, node, on, w) to those of *levels*, from the sources up."""
    new = levels.read()
    edges = edges.withColumn("high", F.lit(None).cast("long"))
    while not edges.isEmpty():
        known = new.select("conv_id", F.col("call_id").alias("on"), "level")
        met = edges.join(known, ["conv_id", "on"], "left").select("conv_id", "node", "on", "w", F.coalesce("high", F.col("level") + F.col("w")).alias("high"))
        met = stored(met)
        done = met.groupBy("conv_id", "node").agg(F.max("high").alias("level"), F.bool_and(F.col("high").isNotNull()).alias("all")).where("all")
        new = stored(done.select("conv_id", F.col("node").alias("call_id"), F.col("level").cast("int").alias("level")))
        if new.isEmpty():
            break
        levels.add(new)
        edges = stored(met.join(new.select("conv_id", F.col("call_id").alias("node")), ["conv_id", "node"], "left_anti").select("conv_id", "node", "on", "w", "high"))


def _kind(v: Column) -> Column:
    """JSON type of a variant: string, integer, number, boolean, object, array, null."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number").when(t == "BOOLEAN", "boolean")
        .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("null")
    )


def argument_errors(parsed: Column, fields: Column) -> Column:
    """What is wrong with arguments (a variant, null if they are no JSON) by *fields* (array of name, type, required); null fields: unknown tool."""
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    values = F.when(is_object, parsed).cast("map<string,variant>")

    def wrong(f: Column) -> Column:
        v = F.try_element_at(values, f["name"])
        fits = (_kind(v) == f["type"]) | ((f["type"] == "number") & (_kind(v) == "integer"))
        return F.when(v.isNull(), F.when(f["required"], F.concat(F.lit("missing:"), f["name"]))).when(~fits, F.concat(F.lit("type:"), f["name"]))

    extra = F.transform(F.array_except(F.map_keys(values), F.transform(fields, lambda f: f["name"])), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.concat(F.array_compact(F.transform(fields, wrong)), F.array_sort(extra))
    return F.when(fields.isNull(), F.array(F.lit("tool"))).when(~is_object, F.array(F.lit("json"))).otherwise(found)


def canonical(text: Column, parsed: Column) -> Column:
    """Canonical JSON of a JSON text (objects of a variant have their keys in order); a text
    that is none, e.g. one that names a key twice, is a JSON string, and null is null."""
    return F.coalesce(F.to_json(parsed), _quoted(text), F.lit("null"))


def _quoted(c: Column) -> Column:
    """A string as a JSON string; null is null."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substr(j, F.lit(6), F.length(j) - 6))


def _firsts(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of *rows* with an identifier the first by *order*, and all others of the same one.

    Only the identifiers are counted, so that texts travel twice only where one repeats."""
    named = rows.where("conv_id is not null and call_id is not null")
    first = named.groupBy(*ID).agg(F.min(F.struct(*order)).alias("c"))
    again = named.groupBy(*ID).agg(F.count("*").alias("n")).where("n > 1").select(*ID)
    each = named.join(again, ID, "left_semi").groupBy(*ID, *order).agg(F.count("*").alias("_n"))
    least = each.groupBy(*ID).agg(F.min(F.struct(*order)).alias("_least"))
    copies = F.col("_n") - F.struct(*order).eqNullSafe(F.col("_least")).cast("long")
    others = each.join(least, ID).withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return first.select(*ID, "c.*"), others.select(*ID, *order)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, with its result, and per result that no call has.

    *calls*: conv_id, turn, call_id, name, arguments (JSON text), depends_on; *results*:
    conv_id, call_id, content; *schemas*: name, field, type, required; other columns are
    ignored.  Returns conv_id, call_id, level (topological; null on and behind a cycle),
    turn, status, args_valid, errors and json.  status: ok, no_result or cycle for calls,
    orphan_result for results of calls that do not exist.  Of repeated calls the first (by
    turn, name, arguments) links, of repeated results the smallest content; the others are
    rows of status repeated_call and repeated_result.  Null identifiers never link: such
    calls have no result and level 0, such results are orphans.  A null content counts as
    empty.  Arguments that are no JSON object have the error ``json`` (also those that name
    a key twice, and those over the size of a variant), calls of unknown tools ``tool``.
    """
    fields = schemas.where("name is not null and field is not null").groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col("field").alias("name"), F.col("type").alias("type"), F.coalesce("required", F.lit(False)).alias("required")))).alias("fields"))
    fields = F.broadcast(fields) if fields.limit(BROADCAST_TOOLS + 1).count() <= BROADCAST_TOOLS else fields
    order = ["turn", "name", "arguments"]
    calls = calls.select(*ID, *order, "depends_on")
    results = results.select(*ID, F.coalesce("content", F.lit("")).alias("content"))
    unnamed = "conv_id is null or call_id is null"
    levels = topological_levels(calls.where(f"not ({unnamed})").select(*ID, "depends_on"))
    first, repeated = _firsts(calls, order)
    answer, lost = _firsts(results, ["content"])
    nothing = F.lit(None).cast("string")
    both = first.withColumn("called", F.lit(True)).join(answer.withColumn("answered", F.lit(True)), ID, "full").join(levels, ID, "left")
    status = F.when(F.col("called").isNull(), "orphan_result").when(F.col("level").isNull(), "cycle").when(F.col("answered"), "ok").otherwise("no_result")
    every = (
        both.select(*ID, "level", *order, "content", status.alias("status"))
        .unionByName(repeated.select(*ID, F.lit(None).cast("int").alias("level"), *order, nothing.alias("content"), F.lit("repeated_call").alias("status")))
        .unionByName(calls.where(unnamed).select(*ID, F.lit(0).alias("level"), *order, nothing.alias("content"), F.lit("no_result").alias("status")))
    )
    alone = lost.withColumn("status", F.lit("repeated_result")).unionByName(results.where(unnamed).withColumn("status", F.lit("orphan_result")))
    void = {"level": F.lit(None).cast("int"), "turn": F.lit(None).cast("long"), "name": nothing, "arguments": nothing}
    every = every.unionByName(alone.withColumns(void).select(*every.columns))
    is_result = F.col("status").isin("orphan_result", "repeated_result")
    linked = every.join(fields, "name", "left").withColumn("_parsed", F.try_parse_json("arguments"))
    linked = linked.withColumn("_errors", F.when(is_result, F.array().cast("array<string>")).otherwise(argument_errors(F.col("_parsed"), F.col("fields"))))
    own = F.concat(
        F.lit('{"arguments":'), canonical(F.col("arguments"), F.col("_parsed")), F.lit(',"id":'), _quoted(F.coalesce("call_id", F.lit(""))), F.lit(',"name":'), _quoted(F.coalesce("name", F.lit(""))),
        F.lit(',"result":'), F.coalesce(_quoted(F.col("content")), F.lit("null")), F.lit("}"),
    )
    orphan = F.concat(F.lit('{"id":'), _quoted(F.coalesce("call_id", F.lit(""))), F.lit(',"result":'), _quoted(F.col("content")), F.lit("}"))
    valid = ~is_result & (F.size("_errors") == 0)
    return linked.select(*ID, "level", F.col("turn").cast("long").alias("turn"), "status", valid.alias("args_valid"), F.array_join("_errors", ",").alias("errors"), F.when(is_result, orphan).otherwise(own).alias("json"))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, results, schemas and what is neither, from the conversations table, whose turns are plain text.

    Every assistant turn is a call whose query is its whole text; it depends on the call
    two turns before and, at every third turn, on the one four turns before.  Every user
    turn after turn 0 is the result of the turn before it.  The rest are messages."""
    c = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))

    def at(back: int) -> Column:
        return F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))

    name = F.element_at(F.array(*map(F.lit, ("search", "lookup", "note"))), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    n = F.length("text")
    limit = F.when(n % 7 == 0, F.lit('"many"')).otherwise((n % 50).cast("string"))
    arguments = F.concat(F.lit('{ "query" : '), _quoted(F.col("text")), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(', "limit":'), limit)), F.when(n % 11 == 0, F.lit(', "debug":true')).otherwise(""), F.lit(" }"))
    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    is_result = F.coalesce((F.col("role") == "user") & (F.col("turn") > 0), F.lit(False))
    depends = F.when(F.pmod("turn", F.lit(3)) == 0, F.array(at(2), at(4))).otherwise(F.array(at(2)))
    calls = c.where(is_call).select("conv_id", "turn", at(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = c.where(is_result).select("conv_id", at(1).alias("call_id"), F.col("text").alias("content"))
    rows = [(t, f, k, r) for t in ("search", "lookup", "note") for f, k, r in (("query", "string", True), ("limit", "integer", t == "search"))]
    schemas = conversations.sparkSession.createDataFrame(rows, "name string, field string, type string, required boolean")
    return calls, results, schemas, c.where(~is_call & ~is_result)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """link() over the conversations table, such that every row's whole text is in some json.

    Rows that are neither call nor result (system turns, opening user turns, other roles,
    user turns without a number) have status message, and a json of content and role."""
    calls, results, schemas, rest = from_conversations(conversations)
    json = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), F.coalesce(_quoted(F.col("role")), F.lit("null")), F.lit("}"))
    messages = rest.select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), "turn", F.lit("message").alias("status"),
        F.lit(False).alias("args_valid"), F.lit("").alias("errors"), json.alias("json"),
    )
    return link(calls, results, schemas).unionByName(messages)


SQL = """
WITH RECURSIVE c AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
every AS (SELECT *, 'call-' || turn AS call_id, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'note' END AS name, length(text) AS n,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM c WHERE role = 'assistant'),
call AS (SELECT * FROM every WHERE nth = 1),
dep AS (SELECT k.conv_id, k.turn, p.turn AS before FROM call k JOIN call p ON p.conv_id = k.conv_id AND (p.turn = k.turn - 2 OR k.turn % 3 = 0 AND p.turn = k.turn - 4)),
walk AS (SELECT conv_id, turn, 0 AS level FROM call UNION SELECT dep.conv_id, dep.turn, level + 1 FROM walk JOIN dep ON dep.conv_id = walk.conv_id AND dep.before = walk.turn),
lev AS (SELECT conv_id, turn, max(level) AS level FROM walk GROUP BY ALL),
answer AS (SELECT conv_id, turn - 1 AS turn, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM c WHERE role = 'user' AND turn > 0),
res AS (SELECT * FROM answer WHERE nth = 1),
err AS (SELECT e.*, l.level, r.content, CASE WHEN nth > 1 THEN 'repeated_call' WHEN r.content IS NULL THEN 'no_result' ELSE 'ok' END AS status,
    concat_ws(',', CASE WHEN n % 5 <> 0 AND n % 7 = 0 THEN 'type:limit' WHEN n % 5 = 0 AND name = 'search' THEN 'missing:limit' END, CASE WHEN n % 11 = 0 THEN 'unknown:debug' END) AS errors
  FROM every e LEFT JOIN lev l ON e.nth = 1 AND l.conv_id = e.conv_id AND l.turn = e.turn LEFT JOIN (SELECT conv_id, turn, content FROM res) r ON e.nth = 1 AND r.conv_id = e.conv_id AND r.turn = e.turn)
SELECT conv_id, call_id, level, turn, status, errors = '' AS args_valid, errors,
  '{"arguments":{' || CASE WHEN n % 11 = 0 THEN '"debug":true,' ELSE '' END || CASE WHEN n % 5 = 0 THEN '' WHEN n % 7 = 0 THEN '"limit":"many",' ELSE '"limit":' || (n % 50) || ',' END || '"query":' || CAST(to_json(text) AS VARCHAR) || '},"id":"' || call_id || '","name":"' || name || '","result":'
  || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM err
UNION ALL SELECT conv_id, 'call-' || turn, NULL, NULL, CASE WHEN nth > 1 THEN 'repeated_result' ELSE 'orphan_result' END, FALSE, '', '{"id":"call-' || turn || '","result":' || CAST(to_json(content) AS VARCHAR) || '}'
  FROM answer a WHERE nth > 1 OR NOT EXISTS (SELECT 1 FROM call k WHERE k.conv_id = a.conv_id AND k.turn = a.turn)
UNION ALL SELECT conv_id, NULL, NULL, turn, 'message', FALSE, '', '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
  FROM c WHERE NOT (role IS NOT DISTINCT FROM 'assistant' OR role IS NOT DISTINCT FROM 'user' AND coalesce(turn > 0, FALSE))
"""
