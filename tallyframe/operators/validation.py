"""Checks of JSON records: strict fields, call arguments, a small schema language, row validity. Codes, not exceptions.

Records are JSON texts that are parsed once into a variant; a null or malformed text has a defined code everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that no argument of a call may reach.
TRAVERSAL = r"\.\./|\.\.\\|^/etc/|^/root/|~/\.ssh"


def _none() -> Column:
    return F.array().cast("array<string>")


def _codes(*codes: Column) -> Column:
    """The codes that aren't null, in order."""
    return F.array_compact(F.array(*codes)) if codes else _none()


def kind(value: Column) -> Column:
    """string, integer, number, boolean, array, object or null for a variant; no value at all for an absent one.

    Numbers with a point or an exponent are `number`. Integers beyond 64 bits are decimals of 19 to 38 digits without a
    fraction; a number as long whose fraction is zero is taken for one of them, longer ones are `number`.
    """
    return kind_of(F.schema_of_variant(value))


def kind_of(name: Column) -> Column:
    """kind() of a variant's schema."""
    return (
        F.when((name == "BIGINT") | name.rlike(r"^DECIMAL\((19|2\d|3[0-8]),0\)$"), "integer").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name.isNotNull(), "number")
    )


def field(value: Column, name: str) -> Column:
    """The variant's field: no value if it is absent or the variant is no object."""
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _is(value: Column, wanted: str, boolean_counts: bool = False) -> Column:
    fits = {"integer": ["integer"], "number": ["integer", "number"]}.get(wanted, [wanted])
    return kind(value).isin(*fits, *(["boolean"] if boolean_counts and wanted in ("integer", "number") else []))


def strict_codes(record: Column, fields: dict[str, str], most: int = 8) -> Column:
    """schema:missing:f, schema:invalid:f and schema:extra_field:f, in the order of the fields and then of the record's
    own keys, at most `most`; schema:unparseable for what is no JSON object. A null field is invalid."""
    v = F.try_parse_json(record)
    own = [F.when(field(v, n).isNull(), f"schema:missing:{n}").when(~_is(field(v, n), t), f"schema:invalid:{n}") for n, t in fields.items()]
    extra = F.transform(F.array_except(F.json_object_keys(record), F.array(*[F.lit(n) for n in fields])), lambda k: F.concat(F.lit("schema:extra_field:"), k))
    bad = F.coalesce(kind(v) != "object", F.lit(True))
    return F.when(bad, F.array(F.lit("schema:unparseable"))).otherwise(F.slice(F.concat(_codes(*own), F.coalesce(extra, _none())), 1, most))


def argument_issues(arguments: Column, required: list[str], types: dict[str, str]) -> Column:
    """malformed_json alone, or missing_required:f (absent, null or empty) and then wrong_type:f. A boolean is no integer."""
    v = F.try_parse_json(arguments)
    absent = lambda x: x.isNull() | (kind(x) == "null") | (F.try_variant_get(x, "$", "string").eqNullSafe(""))
    missing = [F.when(absent(field(v, n)), f"missing_required:{n}") for n in required]
    wrong = [F.when(field(v, n).isNotNull() & (kind(field(v, n)) != "null") & ~_is(field(v, n), t), f"wrong_type:{n}") for n, t in types.items()]
    return F.when(v.isNull(), F.array(F.lit("malformed_json"))).otherwise(_codes(*missing, *wrong))


def path_traversal(arguments: Column) -> Column:
    """Does a text among the top values of a JSON object leave the allowed folders? False for what can't be parsed."""
    values = F.map_values(F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>"))
    text = lambda x: F.when(kind(x) == "string", F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.exists(values, lambda x: F.coalesce(text(x).rlike(TRAVERSAL), F.lit(False))), F.lit(False))


def _under(place: Column, errors: Column) -> Column:
    return F.transform(errors, lambda e: F.concat(place, e))


def schema_errors(value: Column, schema: dict) -> Column:
    """type:t, required:f, f.<error> and [i].<error> for a variant against type, required, properties and items.

    The schema is known when the plan is made, so it unfolds into one expression. Here a boolean is an integer.
    """
    parts: list[Column] = [_codes(*[F.when((kind(value) == "object") & field(value, n).isNull(), f"required:{n}") for n in schema.get("required", [])])]
    for n, sub in schema.get("properties", {}).items():
        parts.append(F.when(field(value, n).isNotNull(), _under(F.lit(f"{n}."), schema_errors(field(value, n), sub))).otherwise(_none()))
    if "items" in schema:
        within = lambda x, i: _under(F.concat(F.lit("["), i.cast("string"), F.lit("].")), schema_errors(x, schema["items"]))
        parts.append(F.coalesce(F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), within)), _none()))
    found = reduce(lambda a, b: F.concat(a, b), parts)
    if "type" not in schema:
        return found
    return F.when(F.coalesce(_is(value, schema["type"], boolean_counts=True), F.lit(False)), found).otherwise(F.array(F.lit(f"type:{schema['type']}")))


#: What a field's format has to look like as a whole.
FORMATS = {"email": r"\A[^@\s]+@[^@\s]+\.[a-z]+\z", "date": r"\A\d{4}-\d{2}-\d{2}\z"}


def row_valid(record: Column, spec: dict[str, dict]) -> Column:
    """Does a JSON record meet every field's type, required, min, max, enum and format, and start_date <= end_date?

    Dates compare as texts. Absent and null fields only fail if they are required; what is no object is invalid.
    """
    v = F.try_parse_json(record)
    checks = [kind(v) == "object"]
    for n, s in spec.items():
        x = field(v, n)
        number, text = F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "string")
        fits = [_is(x, s["type"])]
        fits += [number >= s["min"]] if "min" in s else []
        fits += [number <= s["max"]] if "max" in s else []
        fits += [text.isin(*s["enum"])] if "enum" in s else []
        fits += [text.rlike(FORMATS[s["format"]])] if "format" in s else []
        absent = x.isNull() | (kind(x) == "null")
        checks.append(F.when(absent, F.lit(not s.get("required", False))).otherwise(F.coalesce(reduce(lambda a, b: a & b, fits), F.lit(False))))
    start, end = (F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in ("start_date", "end_date"))
    checks.append(F.coalesce(start <= end, F.lit(True)))
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def _all_codes(checks: list[Column]) -> Column:
    return F.concat(*checks)


def with_reasons(rows: DataFrame, checks: list[Column]) -> DataFrame:
    """rows with `reasons`: the codes of all checks (arrays of text) in order. Clean rows have none."""
    return rows.withColumn("reasons", _all_codes(checks))


def clean(rows: DataFrame, checks: list[Column]) -> DataFrame:
    """The rows that no check has a code for: what is left when a written dataset is validated again."""
    return rows.where(F.size(_all_codes(checks)) == 0)
