"""Typed decoding of JSON rows: what fits the declared fields comes out as columns, everything else as a reject with its reasons."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """A declared field: its name, its type (string, bigint, double, boolean, or any nested type), the values it may have, and whether it may be missing or null.

    A ``flag`` is a boolean that is stored as 0 or 1.
    """

    name: str
    kind: str
    values: Sequence[str] | None = None
    required: bool = False
    flag: bool = False


#: The types that JSON values may have to be read as a declared type.
_FITS = {"string": "STRING", "bigint": "BIGINT", "double": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN"}


def _value(v: Column, f: Field) -> Column:
    path = f"$['{f.name}']"
    if f.flag:
        return F.try_variant_get(v, path, "bigint") == 1
    if f.kind in _FITS:
        return F.try_variant_get(v, path, f.kind)
    return F.from_json(F.to_json(F.try_variant_get(v, path, "variant")), f.kind)


def _reason(v: Column, f: Field) -> Column:
    path = f"$['{f.name}']"
    raw = F.try_variant_get(v, path, "variant")
    missing = raw.isNull() | F.is_variant_null(raw)
    if f.flag:
        wrong = ~F.coalesce(F.schema_of_variant(raw) == "BIGINT", F.lit(False)) | ~F.coalesce(F.try_variant_get(v, path, "bigint").isin(0, 1), F.lit(False))
    elif f.kind in _FITS:
        wrong = ~F.coalesce(F.schema_of_variant(raw).rlike(f"^({_FITS[f.kind]})$"), F.lit(False))
    else:
        # a value of another shape leaves its text as a corrupt record
        text = F.to_json(raw)
        whole = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {f.kind}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        wrong = whole["_corrupt"].isNotNull() | whole["v"].isNull()
    out = F.when(missing, F.lit(f"{f.name}: missing") if f.required else F.lit(None)).when(wrong, F.lit(f"{f.name}: not a {'flag' if f.flag else f.kind}"))
    if f.values is not None:
        text = F.try_variant_get(v, path, "string")
        out = out.when(~text.isin(*f.values), F.concat(F.lit(f"{f.name}: unknown value "), text))
    return out


def decode(rows: DataFrame, column: str, fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, rejects) of the JSON objects in ``column``.

    Decoded rows have the other columns of ``rows`` and one for each field, null where it is missing or null and may be. A reject has the columns of ``rows`` and ``reasons``, in the order of
    the fields: text that is null or no JSON, JSON that is no object, a required field that is missing, a value of another type, a value that is not among the field's. Fields that are not
    declared are passed over. A declared field takes the place of another column of its name. Empty tables give empty ones.
    """
    # an exploded value is computed once; as a column it would be computed anew for each use in the filters on reasons, which are pushed down to where it is made
    once = lambda x: F.explode(F.array(x))
    parsed = rows.withColumn("_v", once(F.try_parse_json(F.col(column).cast("string"))))
    v = F.col("_v")
    of_fields = F.array_compact(F.array(*[_reason(v, f) for f in fields]))
    none = F.array().cast("array<string>")
    reasons = F.when(v.isNull(), F.array(F.lit("not JSON"))).when(~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(F.coalesce(of_fields, none))
    judged = parsed.withColumn("_reasons", once(reasons))
    names = {f.name for f in fields}
    kept = [c for c in rows.columns if c != column and c not in names]
    good = judged.where(F.size("_reasons") == 0).select(*kept, *[_value(v, f).alias(f.name) for f in fields])
    return good, judged.where(F.size("_reasons") > 0).select(*rows.columns, F.col("_reasons").alias("reasons"))
