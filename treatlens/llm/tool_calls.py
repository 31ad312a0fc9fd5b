"""Chat formatting: link tool calls with their results, order and check them, write canonical JSON.

Calls and results meet in a join on ``(conv_id, call_id)``. A call may name the
call it builds on (``parent_id``); its depth in that forest, found by pointer
doubling in about log2(depth) joins, orders it after everything it needs.
Nothing is gathered per conversation: each line stands for one call, so a
conversation of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.session import cut_lineage

#: Per tool: argument -> (JSON type, required).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
_KEY = ["conv_id", "call_id"]
#: SQL types that a JSON type may have once it is parsed.
_TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT",
    "boolean": "BOOLEAN",
    "object": "OBJECT.*",
    "array": "ARRAY.*",
    "null": "VOID",
}


def _first(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per identifier: the earliest position, then the smallest values."""
    pick = F.min(F.struct("position", *columns)).alias("_r")
    return df.groupBy(*_KEY).agg(pick, F.count(F.lit(1)).alias("_n")).select(*_KEY, "_r.*", "_n")


def _repeated(df: DataFrame, first: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of identifiers that ``_first`` did not choose, each as often as it occurs."""
    own = ["position", *columns]
    chosen = first.select(*_KEY, F.struct(*own).alias("_chosen"))
    counted = df.groupBy(*_KEY, *own).agg(F.count(F.lit(1)).alias("_times")).join(chosen, _KEY)
    left = F.col("_times") - F.struct(*own).eqNullSafe(F.col("_chosen")).cast("long")
    rows = counted.select(*_KEY, *own, left.alias("_left")).filter("_left > 0")
    return rows.select(*_KEY, *own, F.explode(F.sequence(F.lit(1).cast("long"), "_left")).alias("_n")).drop("_n")


def depths(calls: DataFrame) -> DataFrame:
    """``depth`` of every call: 0 without a known parent, null on or behind a cycle.

    ``calls`` has unique ``(conv_id, call_id)``. Each round doubles the length
    of the known way up, so the number of rounds is the logarithm of the depth.
    """
    known = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("_known"))
    start = calls.join(known, ["conv_id", "parent_id"], "left").select(
        *_KEY,
        F.when(F.col("_known"), F.col("parent_id")).alias("up"),
        F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth"),
    )
    state = cut_lineage(start, "depths")
    bound, rounds = max(2, state.count()), 0
    while True:
        open_calls = state.filter("up IS NOT NULL").count()
        if not open_calls or 2**rounds > bound:  # a way longer than the number of calls is a cycle
            break
        further = state.select(
            "conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth")
        )
        moved = (
            state.filter("up IS NOT NULL")
            .join(further, ["conv_id", "up"])
            .select(*_KEY, F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        )
        state = cut_lineage(state.filter("up IS NULL").unionByName(moved), "depths")
        rounds += 1
    return state.select(*_KEY, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def argument_errors(arguments: Column, name: Column, schemas: Schemas) -> Column:
    """Sorted error texts of parsed arguments (VARIANT); empty if they fit their tool's schema."""
    listed = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        checks = []
        for key, (kind, required) in sorted(fields.items()):
            value = F.variant_get(arguments, f"$['{key}']", "variant")
            absent = F.lit(f"missing {key}") if required else F.lit(None).cast("string")
            typed = F.schema_of_variant(value).rlike(f"^({_TYPES[kind]})$")
            checks.append(F.when(value.isNull(), absent).when(~typed, F.lit(f"{key} is not {kind}")))
        listed = F.when(name == tool, F.array_compact(F.array(*checks))).otherwise(listed)
    not_object = arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT")
    return (
        F.when(not_object, F.array(F.lit("arguments are not a JSON object")))
        .when(listed.isNull(), F.array(F.lit("unknown tool")))
        .otherwise(listed)
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, messages: DataFrame | None = None) -> DataFrame:
    """One row per call, and one per result without a call or beside an earlier one; one per message.

    ``calls``: conv_id, call_id, parent_id, position, name, arguments (JSON
    text); ``results``: conv_id, call_id, position, content; ``messages``, which
    call nothing: conv_id, position, name (who speaks), content. Returns the keys
    with ``position``, ``depth``, ``status`` and ``line``, canonical JSON (sorted
    keys, no white space). Sort by ``conv_id, depth, position`` for an order in
    which every call follows its parent.

    ``status``: ``ok``, ``invalid`` (see ``errors`` in the line), ``unanswered``,
    ``cycle``, ``no_id`` (call without conversation or identifier), ``orphan``
    (result without a call), ``duplicate`` or ``message``. Of several calls or
    results with one identifier the earliest counts, the others are duplicates
    without depth or partner. Malformed JSON and repeated keys are errors, not failures.
    Other columns are not read.
    """
    call_cols = ["parent_id", "name", "arguments"]
    calls = calls.select(*_KEY, "position", *call_cols)
    results = results.select(*_KEY, "position", "content")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    single = _first(calls.filter(named), call_cols).drop("_n")
    answered = _first(results.filter(named), ["content"]).drop("_n")
    answers = answered.select(*_KEY, F.col("position").alias("_at"), "content", F.lit(True).alias("_answered"))
    linked = single.join(depths(single), _KEY, "left").join(answers.hint("shuffle_hash"), _KEY, "full")
    loose = calls.filter(~named).select(
        *calls.columns,
        F.lit(None).cast("long").alias("depth"),
        F.lit(None).cast(calls.schema["position"].dataType).alias("_at"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("boolean").alias("_answered"),
    )
    strays = results.filter(~named).select(
        *_KEY,
        F.lit(None).cast(calls.schema["position"].dataType).alias("position"),
        *[F.lit(None).cast("string").alias(c) for c in call_cols],
        F.lit(None).cast("long").alias("depth"),
        F.col("position").alias("_at"),
        "content",
        F.lit(True).alias("_answered"),
    )
    text, no_depth = F.lit(None).cast("string"), F.lit(None).cast("long").alias("depth")
    again = _repeated(calls.filter(named), single, call_cols).select("*", no_depth, text.alias("content"), F.lit("duplicate").alias("_plain"))
    more = _repeated(results.filter(named), answered, ["content"]).select(
        *_KEY, "position", *[text.alias(c) for c in call_cols], no_depth, "content", F.lit("duplicate").alias("_plain")
    )
    plain = again.unionByName(more)
    if messages is not None:
        plain = plain.unionByName(messages.select(
            "conv_id", text.alias("call_id"), F.col("position").cast(calls.schema["position"].dataType).alias("position"),
            text.alias("parent_id"), "name", text.alias("arguments"), no_depth, "content", F.lit("message").alias("_plain"),
        ))
    plain = plain.withColumn("_at", F.lit(None).cast(calls.schema["position"].dataType)).withColumn("_answered", F.lit(None).cast("boolean"))
    rows = linked.unionByName(loose).unionByName(strays).withColumn("_plain", text).unionByName(plain)
    is_call = F.col("_plain").isNull() & (F.col("name").isNotNull() | F.col("arguments").isNotNull() | F.col("position").isNotNull())
    parsed = rows.select(
        "*", is_call.alias("_call"), F.try_parse_json("arguments").alias("_args"), named.alias("_named")
    )
    errors = argument_errors(F.col("_args"), F.col("name"), schemas)
    checked = parsed.withColumn("errors", F.when(F.col("_call"), errors).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("_plain").isNotNull(), F.col("_plain"))
        .when(~F.col("_call"), "orphan")
        .when(~F.col("_named"), "no_id")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("_answered").isNull(), "unanswered")
        .otherwise("ok")
    )
    done = checked.withColumn("status", status).withColumn("position", F.coalesce("position", "_at"))
    # Fields in alphabetical order; a parsed object keeps its keys sorted at every level.
    line = F.to_json(
        F.struct(
            F.col("_args").alias("arguments"), "call_id", "conv_id", "depth", "errors", "name", "parent_id",
            F.col("content").alias("result"), "status",
        ),
        {"ignoreNullFields": "false"},
    )
    return done.select(*_KEY, "position", "depth", "status", line.alias("line"))


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and messages of plain dialogue turns (conv_id, turn, role, text); every turn is one of these.

    A user turn is a call of the tool ``reply`` that builds on the user turn two
    places before it; the assistant turn that follows is its result. Turns of
    any other role, or none, are messages.
    """
    ident = F.concat_ws(":", "conv_id", "turn")
    calls = turns.filter("role = 'user'").select(
        "conv_id",
        F.when(F.col("turn").isNotNull(), ident).alias("call_id"),
        F.concat_ws(":", "conv_id", F.col("turn") - 2).alias("parent_id"),
        F.col("turn").alias("position"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.length("text").alias("chars"))).alias("arguments"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv_id",
        F.when(F.col("turn").isNotNull(), F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("call_id"),
        F.col("turn").alias("position"),
        F.col("text").alias("content"),
    )
    other = turns.filter("role IS NULL OR role NOT IN ('user', 'assistant')")
    messages = other.select("conv_id", F.col("turn").alias("position"), F.col("role").alias("name"), F.col("text").alias("content"))
    return calls, results, messages


REPLY_SCHEMA: Schemas = {"reply": {"prompt": ("string", True), "chars": ("integer", True)}}
