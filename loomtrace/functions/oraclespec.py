"""Answer specs of generated cases, compiled to JSON schema texts with expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a spec may ask for, and its limits.
SCALARS = ("string", "number", "integer", "boolean", "null")
SPEC_TYPES = ("none", "object", "array", *SCALARS)
MOST_FIELDS, NAME_BYTES = 16, 128
SPEC = "struct<type:string,properties:array<struct<name:string,type:string,required:boolean>>,items:string>"


def _is(value: Column, *allowed: str) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def spec_valid(spec: Column, oracle: Column, schema_kind: Column | None = None) -> Column:
    """Whether a spec fits its oracle; exact and reference cases need a well-formed spec but do not use it."""
    kind, fields, items = spec["type"], spec["properties"], spec["items"]
    names = F.transform(fields, lambda f: f["name"])
    good_field = lambda f: (
        F.coalesce(F.octet_length(f["name"]).between(1, NAME_BYTES), F.lit(False))
        & ~F.coalesce(f["name"].rlike(r"[\x00-\x1f]"), F.lit(True))
        & _is(f["type"], *SCALARS)
        & f["required"].isNotNull()
    )
    shaped = spec.isNotNull() & _is(kind, *SPEC_TYPES) & fields.isNotNull() & (F.size(fields) <= MOST_FIELDS) & _is(items, "none", *SCALARS)
    object_ok = (F.size(fields) > 0) & F.forall(fields, good_field) & (F.size(F.array_distinct(names)) == F.size(names))
    wanted = F.lit(True) if schema_kind is None else kind.eqNullSafe(schema_kind)
    fits = (
        F.when(_is(oracle, "exact", "reference"), True)
        .when(~_is(oracle, "schema") | (kind == "none") | ~wanted, False)
        .when(kind == "object", object_ok)
        .when(kind == "array", items != "none")
        .otherwise(True)
    )
    return F.coalesce(shaped & fits, F.lit(False))


def compile_spec(spec: Column, oracle: Column, schema_kind: Column | None = None) -> Column:
    """Struct of the normalised spec, the schema text (NULL unless the oracle is schema) and `valid`."""
    valid = spec_valid(spec, oracle, schema_kind)
    kind = spec["type"]
    used = oracle == "schema"
    fields = F.array_sort(spec["properties"])
    none = F.array().cast("array<struct<name:string,type:string,required:boolean>>")
    normal = F.struct(
        F.when(used, kind).otherwise("none").alias("type"),
        F.when(used & (kind == "object"), fields).otherwise(none).alias("properties"),
        F.when(used & (kind == "array"), spec["items"]).otherwise("none").alias("items"),
    )
    entries = F.transform(fields, lambda f: F.struct(f["name"].alias("k"), F.struct(f["type"].alias("type")).alias("v")))
    required = F.transform(F.filter(fields, lambda f: f["required"]), lambda f: f["name"])
    as_object = F.to_json(F.struct(
        F.lit("object").alias("type"), F.map_from_entries(entries).alias("properties"), required.alias("required"), F.lit(False).alias("additionalProperties")
    ))
    as_array = F.to_json(F.struct(F.lit("array").alias("type"), F.struct(spec["items"].alias("type")).alias("items")))
    schema = F.when(kind == "object", as_object).when(kind == "array", as_array).otherwise(F.to_json(F.struct(kind.alias("type"))))
    return F.struct(
        F.when(valid, normal).alias("spec"), F.when(valid & used, schema).alias("schema"), valid.alias("valid")
    )


def spec_of_schema(schema: Column, oracle: Column) -> Column:
    """The spec a compiled schema came from, for sending a stored case back to its generator."""
    parsed = F.from_json(
        schema, "type string, properties map<string,struct<type:string>>, required array<string>, items struct<type:string>"
    )
    fields = F.transform(
        F.array_sort(F.map_entries(parsed["properties"])),
        lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), F.array_contains(parsed["required"], e["key"]).alias("required")),
    )
    none = F.array().cast("array<struct<name:string,type:string,required:boolean>>")
    of_schema = F.struct(
        parsed["type"].alias("type"),
        F.when(parsed["type"] == "object", fields).otherwise(none).alias("properties"),
        F.when(parsed["type"] == "array", parsed["items"]["type"]).otherwise("none").alias("items"),
    )
    plain = F.struct(F.lit("none").alias("type"), none.alias("properties"), F.lit("none").alias("items"))
    return F.when(oracle == "schema", of_schema).otherwise(plain)
