"""Tool-call linking: calls and results of conversations matched by identifier, ordered and serialised.

Calls and results are two tables joined by hash on (conv_id, call_id).  Calls of a conversation are
ordered topologically by their dependencies (Kahn's levels: inside a task for a conversation of up to ``HELD``
calls and dependencies, by one join a level beyond), then by turn and index.  Arguments are checked against the tool's JSON schema and serialised as canonical JSON:
sorted keys, no spaces, shortest numbers, UTF-8.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banditflow.session import materialize, release

#: Calls and dependencies of a conversation that one task orders.
HELD = 1 << 18

#: The tools of the conversations' calls, as JSON schemas of their arguments.
SCHEMAS: dict[str, dict] = {
    "search": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
            "after": {"type": "array", "items": {"type": "string"}},
        },
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "lookup": {
        "type": "object",
        "properties": {"key": {"type": "string", "minLength": 3}, "after": {"type": "array", "items": {"type": "string"}}},
        "required": ["key"],
        "additionalProperties": False,
    },
    "measure": {
        "type": "object",
        "properties": {
            "words": {"type": "integer", "minimum": 1, "maximum": 200},
            "unit": {"enum": ["word", "char"]},
            "after": {"type": "array", "items": {"type": "string"}},
        },
        "required": ["words", "unit"],
    },
}

_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer()),
    "number": lambda x: not isinstance(x, bool) and isinstance(x, int | float),
}


def problem(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first thing about ``value`` that the schema does not allow, None if nothing."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: type"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: enum"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            return f"{at}: length"
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            return f"{at}: range"
    elif isinstance(value, list):
        for i, x in enumerate(value):
            if found := problem(x, schema.get("items", {}), f"{at}[{i}]"):
                return found
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if found := problem(value[k], known[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: unknown"
    return None


#: Whole numbers below this are written as digits, as a float or not.
_DIGITS = 10**21


def canonical(value: Any) -> str:
    """Canonical JSON: keys sorted by code point, no spaces, one text for each number.

    Whole numbers below 10^21 are digits without a fraction; greater ones that a float holds exactly are that float's
    shortest text, the others digits.
    """

    def plain(x: Any) -> Any:
        if isinstance(x, float) and x.is_integer() and abs(x) < _DIGITS:
            return int(x)
        if isinstance(x, int) and not isinstance(x, bool) and _DIGITS <= abs(x) < 2**1023 and int(float(x)) == x:
            return float(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _check(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, str | None]:
    """(canonical arguments, problem) of one call; a lone surrogate is no text that could be written."""
    try:
        value = json.loads(arguments) if arguments is not None else None
        text = canonical(value)
        text.encode()
    except UnicodeEncodeError:
        return None, "not Unicode"
    except (ValueError, RecursionError):
        return None, "not JSON"
    if name not in schemas:
        return text, "unknown tool"
    return text, problem(value, schemas[name])


def check_arguments(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Add canonical (null if the arguments are no JSON) and problem (null if the schema is met) to each call."""
    kept = [c for c in calls.columns if c not in ("canonical", "problem")]
    src = calls.select(*kept, F.col("name").alias("__name__"), F.col("arguments").alias("__arguments__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_check(n, a, schemas) for n, a in zip(b.column("__name__").to_pylist(), b.column("__arguments__").to_pylist())]
            new = [pa.array([x[i] for x in got], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(kept))), *new], names=[*kept, "canonical", "problem"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.select(*kept).schema.fields)
    return src.mapInArrow(run, f"{fields}, canonical string, problem string")


def _kahn(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Levels of one conversation's calls; calls on a cycle, or behind one, have none."""
    waits, after = dict.fromkeys(nodes, 0), {}
    for source, to in edges:
        if source in waits and to in waits:
            waits[to] += 1
            after.setdefault(source, []).append(to)
    level = {n: 0 for n, w in waits.items() if not w}
    ready = list(level)
    for n in ready:  # grows as calls become ready
        for to in after.get(n, ()):
            waits[to] -= 1
            if not waits[to]:
                level[to] = level[n] + 1  # the last of the calls it waits for is on the highest level
                ready.append(to)
    return level


def _held_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, from, to) sorted by conversation, a call itself having no from -> levels."""
    conv, nodes, edges, first = None, [], [], True
    for b in batches:
        out: list[tuple] = []

        def close() -> None:
            out.extend((conv, c, n) for c, n in _kahn(nodes, edges).items())
            nodes.clear()
            edges.clear()

        kind = b.column("conv_id").type
        for c, source, to in zip(*(b.column(i).to_pylist() for i in range(3))):
            if not first and c != conv:
                close()
            conv, first = c, False
            if source is None:
                nodes.append(to)
            else:
                edges.append((source, to))
        if out:
            yield _levels_batch(out, kind)
    if nodes:
        yield _levels_batch([(conv, c, n) for c, n in _kahn(nodes, edges).items()], kind)


def _levels_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    convs, calls, level = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(calls, pa.string()), pa.array(level, pa.int32())], names=["conv_id", "call_id", "level"])


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the highest among them.

    ``calls``: conv_id, call_id, needs (array of call ids; ids the conversation does not have, nulls and the
    call itself do not count).  Calls on a cycle, or behind one, are left out.  Conversations of up to ``HELD``
    calls and dependencies are ordered inside tasks, one after the other; greater ones level by level.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key).distinct()
    edges = calls.select("conv_id", F.explode("needs").alias("from"), F.col("call_id").alias("to"))
    edges = edges.where("from is not null and from <> to").distinct()
    rows = materialize(nodes.select("conv_id", F.lit(None).cast("string").alias("from"), F.col("call_id").alias("to")).unionByName(edges))
    great = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HELD).select("conv_id")
    great = materialize(great)
    kind = f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, level int"
    if great.isEmpty():
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "from").mapInArrow(_held_levels, kind)
    small = rows.join(great, "conv_id", "left_anti").repartition("conv_id").sortWithinPartitions("conv_id", "from")
    return small.mapInArrow(_held_levels, kind).unionAll(_levels_by_joins(rows.join(great, "conv_id", "left_semi")))


def _levels_by_joins(rows: DataFrame) -> DataFrame:
    """The same, one join a level; a level's counts are kept until the next ones are written."""
    key = ["conv_id", "call_id"]
    nodes = rows.where("from is null").select("conv_id", F.col("to").alias("call_id"))
    edges = rows.where("from is not null").join(nodes.withColumnRenamed("call_id", "from"), ["conv_id", "from"])
    edges = materialize(edges)
    degree = edges.groupBy("conv_id", F.col("to").alias("call_id")).agg(F.count(F.lit(1)).alias("waits"))
    state = materialize(nodes.join(degree, key, "left").select(*key, F.coalesce("waits", F.lit(0)).alias("waits")))
    level, out = 0, None
    while True:
        done = materialize(state.where("waits = 0").select(*key, F.lit(level).alias("level")))
        out = done if out is None else out.unionAll(done)
        # what the level's calls free: the counts of those that wait for them fall
        freed = edges.join(done.select("conv_id", F.col("call_id").alias("from")), ["conv_id", "from"])
        freed = freed.groupBy("conv_id", F.col("to").alias("call_id")).agg(F.count(F.lit(1)).alias("n"))
        left = materialize(
            state.where("waits > 0").join(freed, key, "left").select(*key, (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"))
        )
        release(state)
        state = left
        if state.where("waits = 0").isEmpty():  # nothing left, or it waits for itself
            release(edges, state)
            return out
        level += 1


def _positions(calls: DataFrame, chunk: int = 256) -> DataFrame:
    """Add position: 0, 1, ... in each conversation by (level, turn, call_id).

    Numbered in runs of ``chunk`` turns of a level, then shifted by the sizes of the runs before: a very long
    conversation is no single task's work.
    """
    run = ["conv_id", "level", "run"]
    cut = calls.withColumn("run", F.floor(F.col("turn") / chunk))
    sizes = cut.where("level is not null").groupBy(*run).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("level", "run").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*run, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy(*run).orderBy("turn", "call_id")) - 1
    numbered = cut.withColumn("inside", inside).join(sizes, run, "left")
    return numbered.withColumn("position", (F.col("start") + F.col("inside")).cast("long")).drop("run", "inside", "start")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call: conv_id, call_id, turn, name, position, level, status, result_turn, n_results, record.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON), needs (array of call ids); ``results``:
    conv_id, turn, call_id, content.  A call's result is the first one of its id in a later turn, ties to the
    smaller content; n_results counts all of its id.  Of calls that share an id in a conversation the one of the
    smallest (turn, name, arguments) counts, the others have status ``duplicate``, no position and no result.
    status: ``linked``, ``unanswered``, ``invalid`` (arguments; the problem is given) or ``cycle``.  record: the call
    with its result as canonical JSON.  Calls without conv_id, call_id or turn are dropped; null results and results
    without a call link to nothing.
    """
    checked = check_arguments(
        calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn", "call_id", "name", "arguments", "needs"), schemas
    )
    same = W.partitionBy("conv_id", "call_id").orderBy("turn", F.col("name").asc_nulls_last(), F.col("arguments").asc_nulls_last())
    checked = materialize(checked.withColumn("copy", F.row_number().over(same)))
    first = checked.where("copy = 1")
    order = levels(first)
    first = _positions(first.join(order, ["conv_id", "call_id"], "left"))
    found = results.select("conv_id", "call_id", F.col("turn").alias("r_turn"), "content")
    found = first.select("conv_id", "call_id", "turn").join(found, ["conv_id", "call_id"])
    found = found.groupBy("conv_id", "call_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.min(F.when(F.col("r_turn") > F.col("turn"), F.struct("r_turn", F.coalesce("content", F.lit("")).alias("content")))).alias("r"),
    )
    linked = first.join(found, ["conv_id", "call_id"], "left").withColumn(
        "status",
        F.when(F.col("problem").isNotNull(), "invalid").when(F.col("level").isNull(), "cycle")
        .when(F.col("r").isNull(), "unanswered").otherwise("linked"),
    )
    again = checked.where("copy > 1").withColumns({
        "level": F.lit(None).cast("int"), "position": F.lit(None).cast("long"), "n_results": F.lit(0).cast("long"),
        "r": F.lit(None).cast("struct<r_turn:bigint,content:string>"), "status": F.lit("duplicate"),
    })
    both = linked.unionByName(again).withColumn("result", F.col("r.content"))
    fields = ["conv_id", "call_id", "turn", "name", "position", "level", "status", "problem", "result_turn", "n_results"]
    rows = both.select(
        "conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "name", "position", "level", "status", "problem",
        F.col("r.r_turn").cast("long").alias("result_turn"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "canonical", "result",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, given, got = (b.column(c).to_pylist() for c in ("name", "canonical", "result"))
            ids = b.column("call_id").to_pylist()
            records = [
                canonical({"arguments": None if a is None else json.loads(a), "id": i, "name": n, "result": r})
                for i, n, a, r in zip(ids, names, given, got)
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array(records, pa.string())], names=[*fields, "record"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in fields) + ", record string")


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off plain conversations, which have none of their own.

    Every assistant turn t is a call "c<t>"; its tool goes by t modulo 3, its arguments are the turn's first
    word, word count and size.  It needs call "c<t // 2>" where that is another assistant turn.  The user's
    turn t + 1 is the result.  Rows without conv_id or turn make nothing; texts may be null.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")
    rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", "role", "text", words.alias("words")
    )
    after = F.array(F.concat(F.lit("c"), F.floor(F.col("turn") / 2).cast("string")))
    n, first = F.size("words"), F.coalesce(F.try_element_at("words", F.lit(1)), F.lit(""))
    arguments = (
        F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(first.alias("query"), n.alias("limit"), after.alias("after"))))
        .when(F.col("turn") % 3 == 1, F.to_json(F.struct(after.alias("after"), first.alias("key"))))
        .otherwise(F.to_json(F.struct(F.lit("word").alias("unit"), n.alias("words"), after.alias("after"))))
    )
    name = F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "lookup").otherwise("measure")
    call_id = lambda t: F.concat(F.lit("c"), t.cast("string"))
    calls = rows.where(F.col("role") == "assistant").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), after.alias("needs")
    )
    results = rows.where(F.col("role") == "user").select(
        "conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results
