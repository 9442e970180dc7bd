"""Tool-call linking for chat data: calls meet their results by id, get a valid order, are checked and serialised.

Calls and results are hash-joined on conversation and call id. Order: a call's place is its own position, or
just behind the last of the calls it depends on where that comes later. Chains of calls with one dependency are
followed by doubling pointers. Arguments are checked against a JSON schema
per tool, and each call becomes one line of canonical JSON (sorted keys, no white space).

Nothing gathers a conversation into one task: a conversation may hold any share of the rows.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.session import materialize

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        return kind == "number" or float(value).is_integer()
    return isinstance(value, KINDS[kind])


def schema_errors(value, schema: dict, path: str = "") -> list[str]:
    """What is wrong with a value: type, enum, required, properties, bounds, lengths and items are checked."""
    kinds = schema.get("type")
    where = path or "/"
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{where}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    errors = []
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{where}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{path}/{name}: missing" for name in sorted(schema.get("required", [])) if name not in value]
        if schema.get("additionalProperties") is False:
            errors += [f"{path}/{name}: unknown" for name in sorted(value) if name not in known]
        for name in sorted(value):
            if name in known:
                errors += schema_errors(value[name], known[name], f"{path}/{name}")
    elif isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            errors += schema_errors(item, schema["items"], f"{path}/{i}")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            errors.append(f"{where}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            errors.append(f"{where}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            errors.append(f"{where}: too small")
        if value > schema.get("maximum", math.inf):
            errors.append(f"{where}: too large")
    return errors


def _no_constant(name: str):
    raise ValueError(name)


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """Parsed arguments (null if they are not JSON) and what is wrong with them."""
    try:
        value = json.loads("" if arguments is None else arguments, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None, ["/: not JSON"]
    if name not in schemas:
        return value, ["unknown tool"]
    return value, schema_errors(value, schemas[name])


def _at(p, l):
    """Place and level, compared in this order."""
    return F.struct(p.alias("p"), l.alias("l"))


def _chains(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls that depend on one other call: what they depend on in the end, over calls of their kind.

    ``conv, call_id, end, hops, p, l``: the greatest place and level that the calls passed on the way ask for.
    Pointers double in every round, so rounds are logarithmic. ``end`` is null for calls in or behind a cycle.
    """
    single = edges.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("end")).where("n = 1")
    chain = calls.join(single, ["conv", "call_id"]).select("conv", "call_id", "end", F.lit(1).cast("long").alias("hops"), F.col("position").alias("p"), F.lit(0).cast("long").alias("l"))
    chain = materialize(chain, "chains")
    longest = chain.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for last in [False] * longest.bit_length() + [True]:
        further = chain.select("conv", F.col("call_id").alias("end"), F.col("end").alias("end2"), F.col("hops").alias("hops2"), F.col("p").alias("p2"), F.col("l").alias("l2"))
        joined = chain.join(further, ["conv", "end"], "left")
        open_ = F.col("end2").isNotNull()
        if last:
            # More hops than a conversation has calls: only a cycle has so many.
            return materialize(joined.select("conv", "call_id", F.when(~open_, F.col("end")).alias("end"), "hops", "p", "l"), "chains")
        best = F.greatest(_at(F.col("p"), F.col("l")), F.when(open_, _at(F.col("p2"), F.col("l2") + F.col("hops"))))
        moved = joined.select(
            "conv", "call_id", F.coalesce("end2", "end").alias("end"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), best.alias("b"), open_.alias("open")
        )
        chain = materialize(moved.select("conv", "call_id", "end", "hops", "b.p", "b.l", "open"), "chains")
        if not chain.where("open").limit(1).count():
            return chain.drop("open")
        chain = chain.drop("open")


def _places(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv, call_id, place, level, cyclic``: by (place, level) each call stands behind all it depends on.

    A call keeps its position, or takes the place of the last call it depends on and the next level where that
    comes later. Calls with one dependency are followed by doubling pointers; those with several are placed in
    rounds, each when all it depends on is placed, as many rounds as such calls follow one another. What is never
    placed is in a cycle or behind one.
    """
    edges = materialize(edges, "edges")
    chain = _chains(calls, edges)
    alone = calls.join(edges, ["conv", "call_id"], "left_anti")
    placed = materialize(alone.select("conv", "call_id", F.col("position").alias("p"), F.lit(0).cast("long").alias("l")), "placed")
    several = edges.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    way = chain.select("conv", F.col("call_id").alias("needs"), F.lit(True).alias("chained"), "end", "hops", "p", "l")
    left = edges.join(several, ["conv", "call_id"]).join(way, ["conv", "needs"], "left").select(
        "conv",
        "call_id",
        "n",
        F.when(F.col("chained"), F.col("end")).otherwise(F.col("needs")).alias("end"),
        (F.coalesce("hops", F.lit(0)) + 1).alias("hops"),
        F.when(F.col("chained"), _at(F.col("p"), F.col("l") + 1)).alias("least"),
    )
    left = materialize(left.join(calls.select("conv", "call_id", "position"), ["conv", "call_id"]), "left")
    while True:
        known = placed.select("conv", F.col("call_id").alias("end"), "p", "l")
        asks = F.greatest("least", _at(F.col("p"), F.col("l") + F.col("hops")), _at(F.col("position"), F.lit(0).cast("long")))
        met = left.join(known, ["conv", "end"]).groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"), F.max(asks).alias("to"))
        fresh = materialize(met.where("met = n").select("conv", "call_id", "to.p", "to.l"), "fresh")
        if fresh.isEmpty():
            break
        placed = materialize(placed.union(fresh), "placed")
        left = materialize(left.join(fresh, ["conv", "call_id"], "left_anti"), "left")
    ends = placed.select("conv", F.col("call_id").alias("end"), F.col("p").alias("ep"), F.col("l").alias("el"))
    to = F.greatest(_at(F.col("p"), F.col("l")), _at(F.col("ep"), F.col("el") + F.col("hops")))
    placed = placed.union(chain.join(ends, ["conv", "end"]).select("conv", "call_id", to.alias("to")).select("conv", "call_id", "to.p", "to.l"))
    found = calls.join(placed, ["conv", "call_id"], "left")
    return found.select(
        "conv", "call_id", F.coalesce("p", "position").alias("place"), F.coalesce("l", F.lit(0)).cast("long").alias("level"), F.col("p").isNull().alias("cyclic")
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per conversation and call id found in either table.

    ``calls`` has ``conv, call_id, position, name, arguments, depends`` (JSON text; list of call ids), ``results``
    has ``conv, call_id, position, content``. Columns of the result: ``conv, call_id, place, level`` (sorting a
    conversation by the two is a valid order), ``status``, ``errors``, ``line`` (canonical JSON).

    Of several calls of one id the first by position counts, of its results the first behind it; the numbers of
    rows are ``n_calls`` and ``n_results``. Status: ``orphan`` (results only, or none behind the call although
    there are some), ``cyclic`` (depends on itself), ``invalid`` (arguments or dependencies), ``pending`` (no
    result), else ``ok``. Rows with a null conversation or call id take no part; a null position counts as 0; null
    arguments are not JSON; null content is JSON null; null and repeated dependencies are ignored.
    """
    key = ["conv", "call_id"]
    whole = [F.col(k).isNotNull() for k in key]
    call = F.struct(F.coalesce(F.col("position"), F.lit(0)).cast("long").alias("position"), "name", "arguments", F.coalesce("depends", F.array().cast("array<string>")).alias("depends"))
    calls = calls.where(whole[0] & whole[1]).groupBy(*key).agg(F.min(call).alias("call"), F.count(F.lit(1)).alias("n_calls"))
    calls = materialize(calls.select(*key, "call.*", "n_calls"), "calls")
    results = results.where(whole[0] & whole[1]).select(*key, F.coalesce(F.col("position"), F.lit(0)).cast("long").alias("at"), "content")

    asked = calls.select(*key, F.col("position").alias("asked"))
    behind = F.when(F.col("asked").isNull() | (F.col("at") > F.col("asked")), F.struct("at", "content"))
    answers = results.join(asked, key, "left").groupBy(*key).agg(
        F.min(behind).alias("answer"), F.count(F.lit(1)).alias("n_results"), F.min("at").alias("first_at")
    )

    edges = calls.select(*key, F.explode(F.array_distinct(F.filter("depends", lambda d: d.isNotNull()))).alias("needs"))
    known = edges.join(calls.select("conv", F.col("call_id").alias("needs"), F.lit(True).alias("known")), ["conv", "needs"], "left")
    known = materialize(known, "needs")
    unknown = known.where("known is null").groupBy(*key).agg(F.sort_array(F.collect_list("needs")).alias("unknown"))
    placed = _places(calls, known.where("known").select(*key, "needs"))

    joined = calls.join(placed, key).join(unknown, key, "left").join(answers, key, "full_outer")
    joined = joined.select(
        *key,
        F.coalesce("place", "first_at").alias("place"),
        F.coalesce("level", F.lit(0)).cast("long").alias("level"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "name",
        "arguments",
        F.sort_array(F.array_distinct(F.filter("depends", lambda d: d.isNotNull()))).alias("depends"),
        "unknown",
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.col("answer").isNotNull().alias("answered"),
        F.col("answer.content").alias("content"),
    )
    kinds = [f"{k} {joined.schema[k].dataType.simpleString()}" for k in key]
    schema = f"{', '.join(kinds)}, place long, level long, n_calls long, n_results long, status string, errors array<string>, line string"

    def serialise(batches):
        for batch in batches:
            states, wrong, lines = [], [], []
            for row in batch.select(["call_id", "n_calls", "n_results", "name", "arguments", "depends", "unknown", "cyclic", "answered", "content"]).to_pylist():
                errors: list[str] = []
                line = {"id": row["call_id"], "result": row["content"]}
                if row["n_calls"]:
                    value, errors = checked(row["name"], row["arguments"], schemas)
                    errors += [f"depends on unknown {d}" for d in row["unknown"] or []]
                    line |= {"name": row["name"], "arguments": value, "depends": row["depends"] or []}
                lost = row["n_results"] and (not row["n_calls"] or not row["answered"])
                state = "orphan" if lost else "cyclic" if row["cyclic"] else "invalid" if errors else "ok" if row["answered"] else "pending"
                states.append(state)
                wrong.append(errors)
                lines.append(canonical(line | {"status": state}))
            columns = [batch.column(i) for i in range(6)]
            columns += [pa.array(states, type=pa.string()), pa.array(wrong, type=pa.list_(pa.string())), pa.array(lines, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "call_id", "place", "level", "n_calls", "n_results", "status", "errors", "line"])

    return joined.mapInArrow(serialise, schema)
