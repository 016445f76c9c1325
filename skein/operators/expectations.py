"""Declared expectations on findings: what must, and what must not, be found in a segment.

An expectation is a row (the findings' keys, check_id, kind, alternative, category, field, op, values, quantifier). Rows of one check and
alternative must all hold; a check passes if one of its alternatives does. A row looks at the findings that cite its segment,
those of its category or, where that is null, all of them:

* op ``cited`` fits each of them, ``equals`` those whose field is one of the values, ``contains`` those whose field holds one of them,
  ``filled`` those whose field is not empty, ``true`` those whose field is true;
* quantifier ``any`` asks for one that fits, ``none`` for none, ``all`` that every one does, which holds where there are none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

SCHEMA = "check_id string, kind string, alternative int, category string, field string, op string, values array<string>, quantifier string"


def _unknown(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {what} of an expectation: "), F.coalesce(value, F.lit("null"))))


def test_of(findings: DataFrame, skip: Sequence[str]) -> Column:
    """One expression for all expectations: whether the finding beside an expectation fits it. A field that is null fits nothing but ``cited``."""
    text = None
    for f in findings.schema.fields:
        c = F.col(f"_f.{f.name}")
        if f.name in skip or not isinstance(f.dataType, (ArrayType, BooleanType, StringType)):
            continue
        value = F.array_join(F.transform(c, lambda x: x.cast("string")), "\n") if isinstance(f.dataType, ArrayType) else c.cast("string")
        text = F.when(F.col("field") == f.name, value) if text is None else text.when(F.col("field") == f.name, value)
    text = text.otherwise(_unknown("field", F.col("field")).cast("string"))
    op = F.col("op")
    fits = (
        F.when(op == "cited", F.lit(True)).when(op == "equals", F.array_contains("values", text)).when(op == "contains", F.exists("values", lambda v: F.contains(text, v)))
        .when(op == "filled", F.length(text) > 0).when(op == "true", text == "true").otherwise(_unknown("op", op).cast("boolean"))
    )
    return F.coalesce(fits, F.lit(False))


def evaluate(expectations: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, check_id, kind, passed) of each check; ``findings`` has a row for each finding and segment that it cites, with ``keys``, category and the fields.

    A row that names an unknown field, op or quantifier is an error. Keys that are null cite nothing. Equal rows count once.
    """
    rows = expectations.distinct()
    beside = findings.select(*keys, F.struct(*[c for c in findings.columns if c not in keys]).alias("_f"))
    met = rows.join(beside, list(keys), "left")
    ours = F.col("_f").isNotNull() & (F.col("category").isNull() | (F.col("category") == F.col("_f.category")))
    fits = F.when(ours, test_of(findings, keys))
    condition = [*keys, "check_id", "kind", "alternative", "category", "field", "op", "values", "quantifier"]
    counted = met.groupBy(*condition).agg(F.count_if(ours).alias("_n"), F.count_if(fits).alias("_fit"))
    q = F.col("quantifier")
    holds = F.when(q == "any", F.col("_fit") > 0).when(q == "none", F.col("_fit") == 0).when(q == "all", F.col("_fit") == F.col("_n")).otherwise(_unknown("quantifier", q).cast("boolean"))
    alternatives = counted.groupBy(*keys, "check_id", "kind", "alternative").agg(F.bool_and(holds).alias("_holds"))
    return alternatives.groupBy(*keys, "check_id", "kind").agg(F.bool_or("_holds").alias("passed"))


def counts(checks: DataFrame) -> DataFrame:
    """(kind, n_checks, n_passed) of evaluated checks."""
    return checks.groupBy("kind").agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"))


def declared(segments: DataFrame, keys: Sequence[str], rules: Sequence[tuple]) -> DataFrame:
    """The expectations that ``rules`` (check_id, kind, alternative, category, field, op, values, quantifier) make for each segment."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def one(value, name: str) -> Column:
        made = F.array(*map(F.lit, value)).cast("array<string>") if name == "values" else F.lit(value).cast("int" if name == "alternative" else "string")
        return made.alias(name)

    made = F.array(*[F.struct(*[one(v, name) for v, name in zip(rule, names)]) for rule in rules])
    return segments.select(*keys, F.explode(made).alias("_r")).select(*keys, "_r.*")
