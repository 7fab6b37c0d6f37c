"""Chat formatting: tool calls linked with their results, checked, ordered and serialised.

Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoframe.session import checkpointed

#: Turns of a conversation that are numbered together; longer conversations are numbered part by part.
TURNS = 4096

TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$",
         "object": "^OBJECT", "array": "^ARRAY", "reference": "^STRING$"}


def calls_and_results(messages: DataFrame, conversation: str, turn: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results in messages whose text is JSON.

    A call is an element of ``tool_calls`` (id, name, arguments as an object or as JSON text), a result a
    message with ``tool_call_id`` and ``content``.  Other messages, and those without conversation or turn,
    have neither.  Of rows with one identifier in a conversation the earliest counts; ``copies`` says
    how many there are, and ``further`` holds the others' contents in order.
    """
    m = messages.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                        F.try_parse_json(F.col(f"`{text}`").cast("string")).alias("body"))
    m = m.where("conv is not null and turn is not null and body is not null")
    made = m.select("conv", "turn", F.posexplode(F.try_variant_get("body", "$.tool_calls", "array<variant>")).alias("place", "call"))
    given = F.try_variant_get("call", "$.arguments", "variant")
    as_text = F.try_parse_json(F.try_variant_get("call", "$.arguments", "string"))
    made = made.select("conv", "turn", F.col("place").cast("long").alias("place"), F.try_variant_get("call", "$.id", "string").alias("id"),
                       F.try_variant_get("call", "$.name", "string").alias("name"),
                       F.to_json(F.when(F.schema_of_variant(given) == "STRING", as_text).otherwise(given)).alias("arguments"))
    came = m.select("conv", "turn", F.lit(0).cast("long").alias("place"), F.try_variant_get("body", "$.tool_call_id", "string").alias("id"),
                    F.to_json(F.try_variant_get("body", "$.content", "variant")).alias("content"))

    def earliest(df: DataFrame, *columns: str) -> DataFrame:
        first = F.min(F.struct("turn", "place", *columns)).alias("first")
        return df.where("id is not null").groupBy("conv", "id").agg(
            first, F.count("*").alias("copies"), F.array_sort(F.collect_list(F.struct("turn", "place", *columns))).alias("all")).select(
            "conv", "id", "first.*", "copies", F.expr("slice(all, 2, size(all))").alias("further"))

    return earliest(made, "name", "arguments"), earliest(came, "content")


def _problems(schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments, by its name; an empty array if nothing is."""
    args, found = F.try_parse_json("arguments"), F.when(F.col("name").isNull(), F.array(F.lit("no name")))
    for name, properties in schemas.items():
        checks = [F.when(F.coalesce(~F.schema_of_variant(args).rlike(TYPES["object"]), F.lit(True)), F.lit("arguments: no object"))]
        for prop, rule in properties.items():
            value = F.try_variant_get(args, f"$.{prop}", "variant")
            absent = value.isNull() | (F.schema_of_variant(value) == "VOID")
            if rule.get("required"):
                checks.append(F.when(absent, F.lit(f"{prop}: missing")))
            checks.append(F.when(~absent & ~F.schema_of_variant(value).rlike(TYPES[rule["type"]]), F.lit(f"{prop}: no {rule['type']}")))
            number = F.try_variant_get(args, f"$.{prop}", "double")
            length = F.length(F.try_variant_get(args, f"$.{prop}", "string"))
            for key, bad, what in (("minimum", number < rule.get("minimum"), "too small"), ("maximum", number > rule.get("maximum"), "too large"),
                                   ("min_length", length < rule.get("min_length"), "too short"),
                                   ("max_length", length > rule.get("max_length"), "too long")):
                if key in rule:
                    checks.append(F.when(~absent & bad, F.lit(f"{prop}: {what}")))
            if "enum" in rule:
                checks.append(F.when(~absent & ~F.try_variant_get(args, f"$.{prop}", "string").isin(*rule["enum"]), F.lit(f"{prop}: not allowed")))
        found = found.when(F.col("name") == name, F.array_compact(F.array(*checks)))
    return found.otherwise(F.array(F.lit("unknown tool")))


def _references(schemas: dict[str, dict]) -> Column:
    """Identifiers that a call's arguments name, by properties of type ``reference``."""
    args, found = F.try_parse_json("arguments"), None
    for name, properties in schemas.items():
        own = [F.try_variant_get(args, f"$.{p}", "string") for p, rule in properties.items() if rule["type"] == "reference"]
        if own:
            branch = F.array_distinct(F.array_compact(F.array(*own)))
            found = F.when(F.col("name") == name, branch) if found is None else found.when(F.col("name") == name, branch)
    none = F.array().cast("array<string>")
    return none if found is None else found.otherwise(none)


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv, id, level of the calls in conversations where a call names a later one; null in a cycle.

    Calls whose references are all placed are placed, round by round; there are as many rounds as the
    longest chain of such conversations is long.
    """
    left, placed, level = checkpointed(calls.select("conv", "id")), None, 0
    while True:
        # What still waits for a call that is not placed.
        waits = edges.join(left.withColumnRenamed("id", "needs"), ["conv", "needs"], "left_semi").select("conv", "id").distinct()
        ready = checkpointed(left.join(waits, ["conv", "id"], "left_anti").withColumn("level", F.lit(level).cast("long")))
        if ready.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("long"))
            return rest if placed is None else placed.unionByName(rest)
        placed = ready if placed is None else placed.unionByName(ready)
        left, level = checkpointed(left.join(ready, ["conv", "id"], "left_anti")), level + 1


def _positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """``position`` of each row in its conversation by ``keys``, from 0.

    Rows are numbered in parts of TURNS turns (``keys[1]``) and counts of the parts before are added, so that
    a very long conversation is no single task.
    """
    part = F.floor(F.col(keys[1]) / TURNS).alias("part")
    head = F.coalesce(F.col(keys[0]), F.lit(-1)).alias("head")
    df = df.withColumns({"part": part, "head": head})
    counts = df.groupBy("conv", "head", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("head", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv", "head", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv", "head", "part").orderBy(*keys[1:])) - 1
    return (df.withColumn("own", own).join(counts, ["conv", "head", "part"])
            .withColumn("position", (F.col("before") + F.col("own")).cast("long")).drop("part", "head", "own", "before"))


def link_tool_calls(messages: DataFrame, conversation: str, turn: str, text: str, schemas: dict[str, dict],
                    every: bool = False) -> DataFrame:
    """One row for each tool call, and for each result without one.

    Columns: conv, id, turn, name, position (a topological order of the conversation's calls: after all
    that they name, else by turn; null for results without a call and calls in a cycle), answered,
    problems (array: arguments against ``schemas``, references, order, repeated identifiers), valid,
    and record: canonical JSON of the linked call (keys sorted, no white space).

    ``schemas`` has for each tool its properties with type (string, integer, number, boolean, object,
    array, reference) and required, minimum, maximum, min_length, max_length, enum.

    Calls and results are joined by conversation and identifier.  Where all references point to earlier
    calls the order of turns is topological already; only other conversations are ordered round by round.

    Messages that are null, empty, plain text or without conversation or turn have no rows.  Repeated
    identifiers make one row, with a problem; the contents of the others are in its record as
    ``further_calls`` and ``further_results``.  Long texts stay whole.

    With ``every``, nothing is left out: calls without identifier, conversation or turn are rows with a problem,
    and each message that neither calls nor answers is a row without name whose record has its content and role.
    """
    calls, results = calls_and_results(messages, conversation, turn, text)
    results = results.select("conv", "id", F.col("turn").alias("result_turn"), "content", F.col("copies").alias("result_copies"), F.col("further").alias("result_further"))
    linked = checkpointed(calls.join(results, ["conv", "id"], "full_outer").withColumn("is_call", F.col("turn").isNotNull())
                          .withColumn("needs", F.when(F.col("is_call"), _references(schemas)).otherwise(F.array().cast("array<string>"))))
    own = linked.where("is_call")
    places = own.select("conv", F.col("id").alias("need"), F.struct("turn", "place").alias("at"))
    edges = own.select("conv", "id", F.struct("turn", "place").alias("from"), F.explode("needs").alias("need")).join(
        places, ["conv", "need"], "left")
    state = edges.groupBy("conv", "id").agg(
        F.sum(F.col("at").isNull().cast("int")).alias("unknown"), F.sum((F.col("at") >= F.col("from")).cast("int")).alias("later"))
    state = checkpointed(state)
    linked = linked.join(state, ["conv", "id"], "left")
    mixed = state.where("later > 0").select("conv").distinct()
    if mixed.isEmpty():
        linked = linked.withColumn("level", F.lit(None).cast("long")).withColumn("cycle", F.lit(False))
    else:
        some = own.join(mixed, "conv", "left_semi")
        links = checkpointed(edges.where("at is not null").join(mixed, "conv", "left_semi").select("conv", "id", F.col("need").alias("needs")))
        levels = _levels(some, links).withColumn("cycle", F.col("level").isNull())
        linked = linked.join(levels, ["conv", "id"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))
    ordered = _positions(linked.where("is_call and not cycle"), ["level", "turn", "place", "id"])
    rest = linked.where("not is_call or cycle").withColumn("position", F.lit(None).cast("long"))
    out = ordered.unionByName(rest)

    answered = F.col("content").isNotNull() & F.col("is_call")
    more = F.array_compact(F.array(
        F.when(~F.col("is_call"), F.lit("result without a call")),
        F.when(F.col("unknown") > 0, F.lit("names an unknown call")), F.when(F.col("cycle"), F.lit("in a cycle")),
        F.when(F.col("copies") > 1, F.lit("identifier repeated")), F.when(F.col("result_copies") > 1, F.lit("several results")),
        F.when(F.col("is_call") & (F.col("result_turn") <= F.col("turn")), F.lit("result before its call"))))
    problems = F.concat(F.when(F.col("is_call"), _problems(schemas)).otherwise(F.array().cast("array<string>")), more)
    call_json = lambda c: _object(arguments=c["arguments"], name=_string(c["name"]))
    record = _object(arguments=F.col("arguments"), further_calls=_array("further", call_json),
                     further_results=_array("result_further", lambda c: F.coalesce(c["content"], F.lit("null"))),
                     id=_string(F.col("id")), name=_string(F.col("name")), result=F.col("content"))
    linked = out.withColumn("problems", problems).select(
        "conv", "id", F.coalesce("turn", "result_turn").alias("turn"), "name", "position", answered.alias("answered"), "problems",
        (F.size("problems") == 0).alias("valid"), record.alias("record"))
    return linked.unionByName(_unlinked(messages, conversation, turn, text, schemas)) if every else linked


def _string(c: Column) -> Column:
    return F.to_json(c.try_cast("string").cast("variant"))


def _object(**parts: Column) -> Column:
    """Canonical JSON of an object; parts ``further_...`` are left out where they are null."""
    each = [F.concat(F.lit(f'"{k}":'), v if k.startswith("further_") else F.coalesce(v, F.lit("null"))) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def _array(items: str, to_json) -> Column:
    """JSON of an array, null if it is empty."""
    return F.when(F.size(items) > 0, F.concat(F.lit("["), F.array_join(F.transform(items, to_json), ","), F.lit("]")))


def _unlinked(messages: DataFrame, conversation: str, turn: str, text: str, schemas: dict[str, dict]) -> DataFrame:
    """Rows of what cannot be linked: calls and results without identifier or place, and all other messages."""
    m = messages.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{text}`").cast("string").alias("text"))
    m = m.withColumn("body", F.try_parse_json("text"))
    m = m.withColumn("calls", F.try_variant_get("body", "$.tool_calls", "array<variant>"))
    placed = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    lost = F.when(~placed, F.lit("no conversation or turn"))
    given = F.try_variant_get("call", "$.arguments", "variant")
    as_text = F.try_parse_json(F.try_variant_get("call", "$.arguments", "string"))
    made = m.select("conv", "turn", F.explode("calls").alias("call")).select(
        "conv", "turn", F.try_variant_get("call", "$.id", "string").alias("id"), F.try_variant_get("call", "$.name", "string").alias("name"),
        F.to_json(F.when(F.schema_of_variant(given) == "STRING", as_text).otherwise(given)).alias("arguments"))
    made = made.where(F.col("id").isNull() | ~placed).select(
        "conv", "id", "turn", "name",
        F.concat(_problems(schemas), F.array_compact(F.array(F.when(F.col("id").isNull(), F.lit("no identifier")), lost))).alias("problems"),
        _object(arguments=F.col("arguments"), id=_string(F.col("id")), name=_string(F.col("name")), result=F.lit(None).cast("string")).alias("record"))
    m = m.withColumns({"id": F.try_variant_get("body", "$.tool_call_id", "string"), "role": F.try_variant_get("body", "$.role", "string")})
    content = F.coalesce(F.to_json(F.try_variant_get("body", "$.content", "variant")), _string(F.col("text")))
    rest = m.where((F.coalesce(F.size("calls"), F.lit(0)) <= 0) & (F.col("id").isNull() | ~placed)).select(
        "conv", "id", "turn", F.lit(None).cast("string").alias("name"),
        F.array_compact(F.array(F.when(F.col("id").isNull() & (F.col("role") == "tool"), F.lit("no identifier")), lost)).alias("problems"),
        _object(content=content, id=_string(F.col("id")), role=_string(F.col("role"))).alias("record"))
    return made.unionByName(rest).select("conv", "id", "turn", "name", F.lit(None).cast("long").alias("position"), F.lit(False).alias("answered"),
                                         "problems", (F.size("problems") == 0).alias("valid"), "record")


def as_protocol(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A plain dialogue in the form of tool messages: each user turn calls ``reply``, the next turn answers.

    A call names the user's call two turns before; a turn of any other role neither calls nor
    answers: its message has its role and content.
    """
    t, number = F.col(f"`{turn}`").cast("long"), lambda n: F.concat(F.lit("c"), (F.col(f"`{turn}`").cast("long") - n).cast("string"))
    call = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.when(t >= 2, number(2)).alias("after"), F.col(f"`{text}`").alias("text"), t.alias("turn")).alias("arguments"),
        number(0).alias("id"), F.lit("reply").alias("name"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.col(f"`{text}`").alias("content"), number(1).alias("tool_call_id")))
    body = F.when(F.col(f"`{role}`") == "user", call).when(F.col(f"`{role}`") == "assistant", result).otherwise(
        F.to_json(F.struct(F.col(f"`{text}`").alias("content"), F.col(f"`{role}`").alias("role"))))
    return turns.select(F.col(f"`{conversation}`").alias("conv"), t.alias("turn"), body.alias("text"))


#: What a call of ``reply`` must look like.
REPLY = {"reply": {"after": {"type": "reference"}, "text": {"type": "string", "required": True, "min_length": 1},
                   "turn": {"type": "integer", "required": True, "minimum": 0}}}
