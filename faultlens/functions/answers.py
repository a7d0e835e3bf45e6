"""Reading model answers: strictly typed fields out of loosely formed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions import fixed_values as fv

DIAGNOSIS = "struct<root_cause:string,analysis_process:string,solution_steps:array<string>,confidence:double>"
_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "variant")


def _object_or_null(parsed: Column) -> Column:
    return F.when(F.startswith(_kind(parsed), F.lit("OBJECT")), parsed)


def _strict_json(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    The parser stops after the first value, so trailing text would pass. It cannot pass inside both an array
    and an object: what closes one early is an error in the other.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull(), F.try_variant_get(named, "$.v", "variant"))


def parse_answers(df: DataFrame, raw: str = "raw_content") -> DataFrame:
    """Adds ``parsed`` (variant object or null) and ``parse_kind``: whole, embedded, empty or failed.

    ``null`` as the whole text is an empty answer; texts without any JSON object are failed.
    """
    text = F.col(raw)
    embedded = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    staged = df.withColumn("_whole", _strict_json(text)).withColumn(
        "_part", F.when(F.startswith(_kind(F.col("_whole")), F.lit("OBJECT")), None).otherwise(_strict_json(embedded))
    )
    whole, part = _object_or_null(F.col("_whole")), _object_or_null(F.col("_part"))
    kind = (
        F.when(text.isNull(), None)
        .when(whole.isNotNull(), "whole")
        .when(_kind(F.col("_whole")) == "VOID", "empty")
        .when(part.isNotNull(), "embedded")
        .otherwise("failed")
    )
    return staged.withColumn("parse_kind", kind).withColumn("parsed", F.coalesce(whole, part)).drop("_whole", "_part")


def _string(parsed: Column, name: str) -> Column:
    value = _field(parsed, name)
    return F.coalesce(F.when(_kind(value) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string")), F.lit(""))


def _number(parsed: Column, name: str) -> Column:
    value = _field(parsed, name)
    return F.coalesce(
        F.when(F.rlike(_kind(value), F.lit(_NUMBERS)), F.try_variant_get(parsed, f"$.{name}", "double")), F.lit(0.0)
    )


def _strings(parsed: Column, name: str) -> Column:
    value = _field(parsed, name)
    items = F.when(F.startswith(_kind(value), F.lit("ARRAY")), F.try_variant_get(parsed, f"$.{name}", "array<variant>"))
    typed = F.transform(
        items,
        lambda v: F.coalesce(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit("")),
    )
    return F.coalesce(typed, F.array().cast("array<string>"))


def answer_fields(df: DataFrame, raw: str = "raw_content") -> DataFrame:
    """Adds root_cause, analysis_process, solution_steps, confidence; expects ``parse_answers`` output."""
    parsed, failed = F.col("parsed"), F.col("parse_kind") == "failed"
    return (
        df.withColumn("root_cause", F.when(failed, fv.PARSE_FAILED).otherwise(_string(parsed, "root_cause")))
        .withColumn("analysis_process", F.when(failed, F.col(raw)).otherwise(_string(parsed, "analysis_process")))
        .withColumn("solution_steps", _strings(parsed, "solution_steps"))
        .withColumn("confidence", _number(parsed, "confidence"))
    )


def parsed_keys(parsed: Column) -> Column:
    keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    return F.coalesce(F.array_sort(keys), F.array().cast("array<string>"))


def diagnosis_to_json(diagnosis: Column) -> Column:
    return F.to_json(diagnosis)


def diagnosis_from_json(text: Column) -> Column:
    return F.from_json(text, DIAGNOSIS)
