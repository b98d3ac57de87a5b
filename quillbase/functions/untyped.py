"""Values of unknown shape: JSON as VARIANT, read by path with its types kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KIND_OF = {"OBJECT": "object", "ARRAY": "array", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null"} | dict.fromkeys(("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), "number")
KINDS = ("object", "array", "text", "number", "boolean", "null", "other")


def kind(value: Column) -> Column:
    """What a VARIANT holds, one of ``KINDS``; null where there is no value at all.

    Only a scalar is asked for its schema: that of an object or array is worked out from all that it holds, to any depth.
    """
    said = F.substring_index(F.schema_of_variant(value), "(", 1)
    known = F.create_map(*(F.lit(x) for pair in _KIND_OF.items() for x in pair))
    scalar = F.when(value.isNotNull(), F.coalesce(F.try_element_at(known, said), F.lit("other")))
    return F.when(is_object(value), "object").when(is_array(value), "array").otherwise(scalar)


def is_object(value: Column) -> Column:
    """Whether a VARIANT holds an object; false where there is no value."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    """Whether a VARIANT holds an array; false where there is no value."""
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def at(value: Column, path: str) -> Column:
    """The value at a path such as ``$.a[0].b``; null where there is none."""
    return F.try_variant_get(value, path, "variant")


def text(value: Column, path: str) -> Column:
    """A text, number or boolean at a path as text; null for anything else."""
    scalar = F.substring_index(F.schema_of_variant(at(value, path)), "(", 1).isin("STRING", "BOOLEAN", *(n for n, of in _KIND_OF.items() if of == "number"))
    return F.when(scalar, F.try_variant_get(value, path, "string"))


def truthy(value: Column, of: Column | None = None) -> Column:
    """Whether a value counts as true: not null, false, zero, or an empty text. ``of``: its ``kind``, where that is a column already."""
    of = kind(value) if of is None else of
    return (
        F.when(of == "text", F.try_variant_get(value, "$", "string") != "")
        .when(of == "number", F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)))
        .when(of == "boolean", F.try_variant_get(value, "$", "boolean"))
        .otherwise(F.coalesce(of.isin("object", "array", "other"), F.lit(False)))
    )


def children(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with (pos, key, value) of every element or field of the VARIANT ``value``; rows without any are left out."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()))


def field_kinds(rows: DataFrame, group: str, value: str, most_depth: int = 32) -> DataFrame:
    """(group, path, kind, n): which kinds of values stand at each path of a column of documents, and in how many places.

    Elements of an array share the path ``[]``. One pass for each level of the deepest document, each over the values of
    that level only, summed at once; documents below ``most_depth`` levels are an error, not cut off.
    """
    from quillbase.operators.stored import Scratch

    with Scratch(rows.sparkSession) as scratch:
        level = rows.select(group, F.lit("$").alias("path"), F.col(value).alias("_v")).where("_v IS NOT NULL")
        out, depth = None, 0
        while True:
            counted = level.groupBy(group, "path", kind(F.col("_v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
            kept = scratch.keep(counted, last=True)
            out = kept if out is None else out.unionByName(kept)
            if kept.where(F.col("kind").isin("object", "array")).isEmpty():
                return out
            if depth == most_depth:
                raise ValueError(f"a document has more than {most_depth} levels")
            inner = children(level.where(kind(F.col("_v")).isin("object", "array")), "_v")
            step = F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), F.col("key")))
            level = inner.select(group, F.concat("path", step).alias("path"), F.col("value").alias("_v"))
            depth += 1
