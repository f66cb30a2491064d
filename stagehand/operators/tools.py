"""What a language model is told of its tools, and its answers read as Columns.

``TOOLS`` has each tool's interface as JSON schema: judging a batch of shows, ordering the candidates of a search, and phrases beside
a query. An answer is a JSON text; ``read`` gives its fields by the same schema, and null for one that isn't such an answer, so that a job with a
million answers doesn't stop at one. Asking is left to injected callables (``judgement.Classifier``, ``search``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _object(**fields: dict) -> dict:
    """An object with these fields and no others; those marked ``optional`` may be missing."""
    needed = [name for name, f in fields.items() if not f.pop("optional", False)]
    return {"type": "object", "additionalProperties": False, "required": needed, "properties": fields}


def _list(of: dict, told: str = "") -> dict:
    return {"type": "array", "items": of} | ({"description": told} if told else {})


TEXT, FLAG, NUMBER = {"type": "string"}, {"type": "boolean"}, {"type": "integer"}
JUDGED = _object(i=NUMBER, keep=FLAG, tags=_list(TEXT), star=FLAG, why={**TEXT, "optional": True})
#: Names and fields are what a model's answers carry.
TOOLS = {
    tool["name"]: tool
    for tool in (
        {"name": "classify_events", "description": "Say of each show of the batch whether it stays, under which tags, and whether it is starred.", "input_schema": _object(results=_list(JUDGED))},
        {"name": "order_shows", "description": "Put all candidates in order, the best answer to the search first; none may be missing.", "input_schema": _object(ids=_list(TEXT, "Ids of all candidates, best first."))},
        {"name": "expand_query", "description": "Say the search in other words, to look near it too; nothing is filtered by them.", "input_schema": _object(phrases=_list(TEXT, "Five to eight short phrases."))},
    )
}
KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "integer": T.IntegerType()}


def schema(of: dict) -> T.DataType:
    """The Spark type of a JSON schema."""
    if of["type"] == "object":
        return T.StructType([T.StructField(name, schema(f)) for name, f in of["properties"].items()])
    return T.ArrayType(schema(of["items"])) if of["type"] == "array" else KINDS[of["type"]]


def _whole(value: Column, of: dict) -> Column:
    """Whether all that an answer must have is there."""
    if of["type"] == "object":
        parts = [_whole(value[name], f) if name in of["required"] else value[name].isNull() | _whole(value[name], f) for name, f in of["properties"].items()]
        found = value.isNotNull()
        for p in parts:
            found = found & p
        return found
    return value.isNotNull() & F.forall(value, lambda x: _whole(x, of["items"])) if of["type"] == "array" else value.isNotNull()


def read(answer: Column, tool: str) -> Column:
    """An answer's fields, or null if it lacks one that the tool needs."""
    of = TOOLS[tool]["input_schema"]
    told = F.from_json(answer, schema(of), {"mode": "PERMISSIVE"})
    return F.get(F.transform(F.array(told), lambda v: F.when(F.coalesce(_whole(v, of), F.lit(False)), v)), 0)


def verdicts(answer: Column) -> Column:
    """The judgements of an answer by their place in the batch, the last of each place; null if the answer can't be read."""
    results = read(answer, "classify_events")["results"]
    return F.filter(results, lambda r, n: ~F.exists(F.slice(results, n + 2, F.size(results)), lambda later: later["i"] == r["i"]))
