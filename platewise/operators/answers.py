"""Nested model answers checked against a schema, with the path of everything that is wrong.

A schema is a DDL type; ``NOT NULL`` marks what an answer must hold. Checks are built from
it as one expression over the parsed answer, so an answer is checked where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEM = "array<struct<path:string,problem:string>>"
# What a value that should be there, and is not an answer at all, is called.
MISSING, UNREADABLE = "missing", "not json"
# Kinds of a parsed value that fit a type, as patterns, and what a misfit is called.
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
FITTING = {
    T.StringType: ("^STRING$", "not a string"),
    T.BooleanType: ("^BOOLEAN$", "not a boolean"),
    T.IntegerType: (r"^(BIGINT|DECIMAL\(\d+,0\))$", "not an integer"),
    T.LongType: (r"^(BIGINT|DECIMAL\(\d+,0\))$", "not an integer"),
    T.DoubleType: (_NUMBER, "not a number"),
    T.StructType: ("^OBJECT<", "not an object"),
    T.ArrayType: ("^ARRAY<", "not an array"),
}


def _found(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem"))).cast(PROBLEM)


def _inside(value: Column, kind: T.DataType, path: Column) -> Column:
    """Problems below a value of the right kind."""
    if isinstance(kind, T.StructType):
        parts = [
            _problems(F.try_variant_get(value, f"$.{f.name}", "variant"), f.dataType, not f.nullable, F.concat(path, F.lit(f".{f.name}")))
            for f in kind.fields
        ]
        return F.concat(*parts)
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.flatten(
            F.transform(items, lambda x, i: _problems(x, kind.elementType, True, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        )
    return F.array().cast(PROBLEM)


def _problems(value: Column, kind: T.DataType, required: bool, path: Column) -> Column:
    pattern, misfit = FITTING[type(kind)]
    absent = _found(path, MISSING) if required else F.array().cast(PROBLEM)
    checked = F.when(F.schema_of_variant(value).rlike(pattern), _inside(value, kind, path)).otherwise(_found(path, misfit))
    return F.when(value.isNull() | F.is_variant_null(value), absent).otherwise(checked)


def checked_answers(answers: DataFrame, schema: str, column: str = "response", fence: str = "`") -> DataFrame:
    """Answers with ``parsed``, the typed answer, and ``problems``, each with its path; none for a right answer.

    A fence of backticks, with the word json or without, is stripped. Elements of arrays
    must be there; null counts as missing. Fields that the schema does not name are ignored.
    """
    kind = T.DataType.fromDDL(schema)
    bare = F.trim(F.regexp_replace(F.trim(column), f"^{fence}+(json)?|{fence}+$", ""))
    read = answers.withColumn("_read", F.try_parse_json(bare))
    problems = F.when(F.col("_read").isNull(), _found(F.lit("$"), UNREADABLE)).otherwise(_problems(F.col("_read"), kind, True, F.lit("$")))
    return read.withColumns({"problems": problems, "parsed": F.from_json(bare, schema)}).drop("_read")


def violations(checked: DataFrame, *keys: str) -> DataFrame:
    """One row per problem of a checked answer: its keys, path and problem."""
    return checked.select(*keys, F.inline("problems"))
