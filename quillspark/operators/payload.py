"""JSON payloads: objects found in texts, fields changed inside them, and payloads read as VARIANT with a schema on read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_object(text: Column) -> Column:
    """The whole text is one JSON object.

    The parser stops where its value ends and takes what follows for granted, so the text is read as a list's item and as a
    field's value: what may follow an object in the one, ``]`` or ``, value``, is wrong in the other, ``}`` or ``, "name":``.
    """
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    value = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    shape = F.startswith(F.trim(text), F.lit("{")) & F.endswith(F.trim(text), F.lit("}"))
    return F.coalesce(shape & item.isNotNull() & value.isNotNull(), F.lit(False))


def balanced_objects(text: Column) -> Column:
    """array<string>: the outermost ``{...}`` of a text, in order; braces inside strings do not count.

    A fold over the places where a brace, a quote or a backslash stands keeps depth, start and whether a string is open.
    """
    marks = F.regexp_extract_all(text, F.lit(r'(?s)\\.|[{}"]'), F.lit(0))
    gaps = F.transform(F.split(text, r'(?s)\\.|[{}"]', -1), lambda g: F.length(g))
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(False).alias("quoted"),
        F.array().cast("array<struct<start:int,stop:int>>").alias("found"),
    )

    def step(acc: Column, m: Column) -> Column:
        place = acc["at"] + m["gap"]
        quote = (m["mark"] == '"') & (acc["depth"] > 0)
        opens = (m["mark"] == "{") & ~acc["quoted"]
        closes = (m["mark"] == "}") & ~acc["quoted"] & (acc["depth"] > 0)
        depth = acc["depth"] + opens.cast("int") - closes.cast("int")
        span = F.struct(acc["start"].alias("start"), (place + 1).alias("stop"))
        return F.struct(
            (place + F.length(m["mark"])).alias("at"), depth.alias("depth"),
            F.when(opens & (acc["depth"] == 0), place).otherwise(acc["start"]).alias("start"),
            F.when(quote, ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            F.when(closes & (depth == 0), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    pairs = F.zip_with(marks, F.slice(gaps, 1, F.size(marks)), lambda m, g: F.struct(m.alias("mark"), g.alias("gap")))
    return F.transform(F.aggregate(pairs, zero, step, lambda acc: acc["found"]), lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"]))


def recover_object(text: Column) -> Column:
    """The JSON object of a text as a string: the text itself, else what lies from its first to its last brace, else the first
    balanced part that is an object; null where there is none."""
    whole = F.trim(text)
    greedy = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    parts = F.filter(balanced_objects(text), is_object)
    return F.when(is_object(whole), whole).when(is_object(greedy), greedy).otherwise(F.get(parts, F.lit(0)))


def with_fields(payload: Column, fields: dict[str, Column]) -> Column:
    """A JSON object as a string with some top-level fields set; the others stay as they are. A null value leaves its field, and
    a payload that is no object stays."""
    kind = "map<string,variant>"
    old = F.from_json(payload, kind)
    names = F.array(*map(F.lit, fields))
    values = F.array(*[F.to_json(F.struct(v.alias("v"))) for v in fields.values()])
    new = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda z: z["value"] != "{}")
    fresh = F.map_from_entries(F.transform(new, lambda z: F.struct(z["name"], F.variant_get(F.parse_json(z["value"]), "$.v", "variant"))))
    kept = F.map_filter(old, lambda k, _: ~F.exists(new, lambda z: z["name"] == k))
    return F.when(is_object(payload), F.to_json(F.map_concat(kept, fresh))).otherwise(payload)


def field(payload: Column, path: str, kind: str) -> Column:
    """A value inside a JSON payload, null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(payload), path, kind)
