"""Statistic requests linked to their results, ordered by dependence, checked and written as canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.operators.ordered import row_index
from popstat.session import cut_lineage

_KINDS = {
    "string": str, "boolean": bool, "object": dict, "array": list, "null": type(None),
}


#: Words of a schema that are checked, and those that check nothing.
_CHECKED = {"type", "enum", "minimum", "maximum", "required", "properties", "additionalProperties", "items"}
_NOTES = {"title", "description", "default", "examples", "format", "$schema", "$id", "$comment"}


def _is_kind(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return number if kind == "number" else isinstance(value, _KINDS.get(kind, object))


def argument_errors(value: object, schema: object, at: str = "$") -> list[str]:
    """Violations of a JSON schema's type, enum, bounds, required, properties, additionalProperties and items.

    A type may be a list; the schemas true and false allow everything and nothing. Words of a
    schema that are not checked here are errors themselves, as are schemas of another kind.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: schema is no object"]
    if unknown := sorted(schema.keys() - _CHECKED - _NOTES):
        return [f"{at}: schema word {word} is not supported" for word in unknown]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(_is_kind(value, kind) for kind in kinds):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    out = []
    if "enum" in schema and not any(x == value and isinstance(x, bool) == isinstance(value, bool) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if number and value < schema.get("minimum", -math.inf):
        out.append(f"{at}: below minimum")
    if number and value > schema.get("maximum", math.inf):
        out.append(f"{at}: above maximum")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in properties:
                out += argument_errors(value[k], properties[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += argument_errors(item, schema["items"], f"{at}[{i}]")
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys and no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _parsed(text: str | None) -> tuple[object, bool]:
    """A JSON value without duplicate keys, NaN, numbers beyond a double's range or lone surrogates."""
    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def refuse(name: str) -> None:
        raise ValueError(name)

    def finite(digits: str) -> float:
        number = float(digits)
        return number if math.isfinite(number) else refuse(digits)

    try:
        value = json.loads(text or "", object_pairs_hook=pairs, parse_constant=refuse, parse_float=finite)
        canonical(value).encode()
        return value, True
    except (ValueError, RecursionError):
        return None, False


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        status, errors, lines = [], [], []
        schemas: dict[str, object] = {}
        for r in batch.select(["request_id", "statistic", "arguments", "after", "schema", "returns", "result", "cyclic", "repeated"]).to_pylist():
            arguments, readable = _parsed(r["arguments"])
            if r["schema"] is not None and r["schema"] not in schemas:
                schemas[r["schema"]] = _parsed(r["schema"])[0]
            wrong = [] if readable else ["$: not JSON"]
            if r["schema"] is None:
                wrong.append("statistic: unknown")
            elif readable:
                wrong += argument_errors(arguments, schemas[r["schema"]])
            status.append(
                "repeated" if r["repeated"] else "cyclic" if r["cyclic"] else "invalid" if wrong
                else "unanswered" if r["result"] is None and r["returns"] else "linked"
            )
            errors.append(wrong)
            lines.append(canonical({
                "after": sorted(r["after"] or []), "arguments": arguments if readable else r["arguments"],
                "id": r["request_id"], "name": r["statistic"], "result": r["result"],
            }))
        keep = [n for n in batch.schema.names if n in ("_run", "request_id", "turn", "_late", "_depth")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(status), pa.array(errors, pa.list_(pa.string())), pa.array(lines)],
            names=[*keep, "status", "errors", "line"],
        )


def _ordered(requests: DataFrame) -> DataFrame:
    """Requests with ``_late``, ``_depth`` and ``cyclic``: (_late, _depth, turn) puts each after what it depends on.

    A request asked after all it depends on keeps its own turn; one asked too early takes the
    largest turn among them and stands one deeper. Only such rows change, so the rounds are
    as many as the longest chain of them, however long a run is. Rows that change after more
    rounds than there are rows that ever changed lie on or behind a cycle; as many rounds
    again reach all of them.
    """
    keys = ["_run", "request_id"]
    edges = cut_lineage(requests.select(*keys, F.explode("after").alias("_dep")).where("_dep is not null").distinct())
    nodes = cut_lineage(requests.select(*keys, "turn", F.col("turn").alias("_late"), F.lit(0).cast("long").alias("_depth"), F.lit(0).alias("_moved")))
    rounds = 0
    while True:
        rounds += 1
        above = nodes.select(F.col("_run").alias("_r"), F.col("request_id").alias("_d"), F.col("_late").alias("_l"), F.col("_depth").alias("_n"))
        met = edges.join(above, edges["_run"].eqNullSafe(above["_r"]) & (edges["_dep"] == above["_d"]))
        least = met.groupBy(F.col("_run").alias("_r"), F.col("request_id").alias("_q")).agg(
            F.max(F.struct(F.col("_l"), (F.col("_n") + 1).alias("_n"))).alias("_least")
        )
        own = F.struct(F.col("_late").alias("_l"), F.col("_depth").alias("_n"))
        joined = nodes.join(least, nodes["_run"].eqNullSafe(least["_r"]) & (nodes["request_id"] == least["_q"]), "left")
        now = F.greatest(own, F.coalesce("_least", own))
        moved = cut_lineage(joined.select(
            *keys, "turn", now["_l"].alias("_late"), now["_n"].alias("_depth"),
            F.when(now != own, F.lit(rounds)).otherwise(F.col("_moved")).alias("_moved"),
        ))
        changed, ever = moved.agg(F.count_if(F.col("_moved") == rounds), F.count_if(F.col("_moved") > 0)).first()
        nodes = moved
        if not changed or rounds > 2 * ever:
            return nodes.select(*keys, "_late", "_depth", (F.col("_moved") > ever).alias("cyclic"))


def link_requests(
    requests: DataFrame, results: DataFrame, schemas: DataFrame, run_id: str = "run_id",
) -> DataFrame:
    """Every statistic request of every run with its result, in an order that respects dependence.

    ``requests``: ``run_id``, ``request_id``, ``turn`` (when it was asked), ``statistic``,
    ``arguments`` (JSON) and ``after`` (request_ids it depends on, of the same run).
    ``results``: ``run_id``, ``request_id``, ``turn``, ``result``. ``schemas``: ``statistic``,
    ``schema`` (JSON schema of the arguments), ``returns`` (whether a result is expected).

    Result, one row per request: ``run_id``, ``request_id``, ``position`` (0-based within
    the run), ``status``, ``errors`` and ``line``, canonical JSON of id, name, arguments,
    dependences and result. Status, the first that holds: ``repeated`` (an id asked again;
    the first by turn, then arguments, is the request, exact copies of it are one),
    ``cyclic`` (on or behind a cycle), ``invalid`` (arguments are not JSON or violate the
    schema, or the statistic is unknown), ``unanswered``, ``linked``. The first result by
    turn, then text, answers; a result without request gives no row (``unasked_results``).
    Dependences on ids that were never asked are kept in the line and order nothing. A NULL
    run is a run of its own; rows with a NULL request_id are ignored; a NULL turn is -1.

    No run is gathered in one task: positions come from a sliced scan over all runs.
    """
    asked = requests.where(F.col("request_id").isNotNull()).select(
        F.col(run_id).alias("_run"), "request_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.col("statistic").cast("string").alias("statistic"), F.col("arguments").cast("string").alias("arguments"),
        F.array_sort(F.array_distinct(F.coalesce("after", F.array().cast(requests.schema["after"].dataType)))).alias("after"),
    ).distinct()
    asked = cut_lineage(asked)
    content = F.struct("turn", "statistic", "arguments", "after")
    first = asked.groupBy("_run", "request_id").agg(F.min(content).alias("_first"))
    order = cut_lineage(_ordered(first.select("_run", "request_id", "_first.turn", "_first.after")))
    answers = results.where(F.col("request_id").isNotNull()).groupBy(F.col(run_id).alias("_r"), F.col("request_id").alias("_q")).agg(
        F.min(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.col("result").cast("string").alias("result"))).alias("_a")
    )
    first, places = first.toDF("_fr", "_fq", "_first"), order.select(
        F.col("_run").alias("_or"), F.col("request_id").alias("_oq"), "_late", "_depth", "cyclic"
    )
    same = lambda df, r, q: asked["_run"].eqNullSafe(df[r]) & (asked["request_id"] == df[q])
    known = schemas.groupBy(F.col("statistic").alias("_s")).agg(F.min("schema").alias("schema"), F.max("returns").alias("returns"))
    linked = (
        asked.join(first, same(first, "_fr", "_fq")).join(places, same(places, "_or", "_oq"))
        .join(answers, same(answers, "_r", "_q"), "left").join(known, asked["statistic"] == known["_s"], "left")
    )
    rows = linked.select(
        "_run", "request_id", "turn", "_late", "_depth", "statistic", "arguments", "after", "schema",
        F.coalesce("returns", F.lit(True)).alias("returns"), F.col("_a.result").alias("result"), "cyclic",
        (content != F.col("_first")).alias("repeated"),
    )
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_run", "request_id")}
    written = rows.mapInArrow(
        _lines, f"_run {kinds['_run']}, request_id {kinds['request_id']}, turn long, _late long, _depth long, "
        "status string, errors array<string>, line string",
    )
    known_run = F.coalesce(F.concat(F.lit("="), F.col("_run").cast("string")), F.lit(""))  # NULL is a run, too
    written = written.withColumn("_by", known_run)
    numbered = row_index(written, "position", ["_late", "_depth", "turn", "request_id", "line"], ["_by"])
    return numbered.select(F.col("_run").alias(run_id), "request_id", "position", "status", "errors", "line")


def unasked_results(requests: DataFrame, results: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Results whose request is not in the table."""
    asked = requests.select(F.col(run_id).alias("_r"), F.col("request_id").alias("_q")).distinct()
    return results.join(asked, results[run_id].eqNullSafe(asked["_r"]) & (results["request_id"] == asked["_q"]), "left_anti")
