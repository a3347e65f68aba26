"""JSON of any depth: every place of a record with its path, forbidden names, leak patterns over names and values."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators.validation import kind_of
from tallyframe.plans.session import stored

#: Levels that are unfolded between two writes.
LEVELS = 8

#: Names that a record's visible state must not have, and wordings that give a label away.
FORBIDDEN_NAME = (
    r"(?i)(preferred|acceptable|gold|truth|label|oracle|reason_code|answer_key|correct_(?:answer|option)|primary_(?:act|intent)|^intent$|urgency_level|^target$|^target_(?:option|level|label|value)$)"
)
LEAK_PATTERNS = (
    r"\bthe (?:correct|right|best|expected|preferred) (?:action|answer|option|label|choice|route|decision)\b",
    r"\b(?:gold|ground)[ -_]?(?:label|truth)\b",
    r"\bshould (?:use|choose|select|pick)\b",
    r"\bpreferred[ _]option\b",
    r"\bacceptable[ _]options?\b",
    r"\breason[ _]code\b",
    r"\boracle\b",
    r"\blabel[ _]source\b",
    r"\bworld[ _]?facts?\b",
    r"\bexpected per\b|\bper the ['\"`]?[\w ]+['\"`]? flag\b",
    r"\bthe (?:candidate )?answer (?:violates|fails|satisfies|meets|contradicts)\b",
    r"\b(?:self[_ ]check|facts[_ ]preserved|contains[_ ]label[_ ]hint)\b",
    r"\bdistractors?\b",
    r"\b(?:input|freshness|cache|completeness|safety) check:",
    r"\b(?:required|needed|necessary) (?:details|information|inputs?|fields?) (?:are|is) (?:missing|absent|lacking)\b",
    r"\b(?:file|document|source|entry) (?:already )?contains the (?:information|answer|details|data)",
    r"\bcontains the information (?:required|requested|needed)\b",
)


def pack_patterns(version: str, options: list[str], exclude: set[str] = frozenset(), extra: list[str] = ()) -> list[str]:
    """All patterns of a pack: the common ones, its own, its oracle's version, and the names of its options as whole words
    (a _ may be written as a blank or a hyphen), but for those in common use."""
    names = [rf"(?<![A-Za-z0-9]){re.escape(o).replace('_', '[ _-]')}(?![A-Za-z0-9])" for o in options if o not in exclude]
    return [*LEAK_PATTERNS, *extra, re.escape(version), *names]


def _place(path: Column, name: Column, node: Column) -> Column:
    """A place with kind and value; only arrays and objects, whose places are still to be made, keep their node."""

    def made(what: Column) -> Column:
        nested = what.isin("object", "array")
        value = F.when(~nested & (what != "null"), F.try_variant_get(node, "$", "string"))
        return F.struct(path.alias("path"), name.alias("name"), what.alias("kind"), value.alias("value"), F.when(nested, node).alias("node"))

    # A schema is worked out from the whole subtree: once a place, not once a kind.
    return T.let(F.schema_of_variant(node), lambda schema: T.let(kind_of(schema), made))


def _unfolded(p: Column) -> Column:
    """A place without a node stays; another one gives itself, without it, and the places right below it."""
    node = p["node"]
    fields = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
    items = F.try_variant_get(node, "$", "array<variant>")
    below = F.when(
        p["kind"] == "object", F.transform(fields, lambda e: _place(F.concat(p["path"], F.lit("."), e["key"]), e["key"], e["value"]))
    ).otherwise(F.transform(items, lambda x, i: _place(F.concat(p["path"], F.lit("["), i.cast("string"), F.lit("]")), F.lit(None).cast("string"), x)))
    own = F.struct(p["path"].alias("path"), p["name"].alias("name"), p["kind"].alias("kind"), p["value"].alias("value"), F.lit(None).cast("variant").alias("node"))
    return F.when(node.isNull(), F.array(p)).otherwise(F.concat(F.array(own), below))


def walk(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, name, kind, value: a row for each place of the JSON text in `column`, the root ($) included.

    name is the field's name, null for the root and items of arrays. kind: object, array, string, integer, number,
    boolean or null. value: the text of a scalar that isn't null. Null and malformed texts have no place; of fields
    that repeat a name the text is malformed. Levels are unfolded inside the row, LEVELS at a time, then written, until
    nothing nested is left, so any depth is walked and no plan grows with it. What is written of a place that is done
    holds no part of the JSON.
    """
    # A small file of records is one task to read and many times as large unfolded: records are dealt first.
    dealt = rows.select(key, column).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    level = dealt.select(key, T.let(F.try_parse_json(column), lambda root: _place(F.lit("$"), F.lit(None).cast("string"), root)).alias("p"))
    found = None
    while True:
        places = F.array("p")
        for _ in range(LEVELS):
            places = F.flatten(F.transform(places, _unfolded))
        # Exploded outer: for an inner explode the optimizer makes the places once more to see whether there are any.
        level = stored(level.select(key, F.explode_outer(places).alias("p")))
        done = level.where("p.node IS NULL AND p.kind IS NOT NULL").select(key, "p.path", "p.name", "p.kind", "p.value")
        found = done if found is None else found.unionByName(done)
        level = level.where("p.node IS NOT NULL")
        if level.isEmpty():
            break
    return found


def forbidden_names(walked: DataFrame, key: str, pattern: str = FORBIDDEN_NAME) -> DataFrame:
    """key, path, code (label_leak:gold_field_name:name) of the places whose name gives a label away."""
    return walked.where(F.col("name").rlike(pattern)).select(key, "path", F.concat(F.lit("label_leak:gold_field_name:"), "name").alias("code"))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but a-z, 0-9 and _ as one _, none at the ends, 40 signs at most."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "_"), F.lit("_")), 1, 40)


def leak_matches(texts: DataFrame, key: str, column: str, patterns: list[str], allow: list[str] = (), window: int = 20) -> DataFrame:
    """key, pattern, match, context, allowed: every match of a pattern, with `window` signs of each side.

    A match is allowed if an allow pattern is in it or in its context. Positions are needed, so matching is Python,
    batch by batch; a text that a batch repeats is looked at once. Null texts match nothing.
    """
    deny, allowed = [re.compile(p, re.IGNORECASE) for p in patterns], [re.compile(a, re.IGNORECASE) for a in allow]

    def told(text: str) -> list[tuple]:
        found = []
        for pattern in deny:
            for m in pattern.finditer(text):
                context = text[max(0, m.start() - window) : m.end() + window].replace("\n", " ")
                found.append((pattern.pattern, m[0], context, any(a.search(m[0]) or a.search(context) for a in allowed)))
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, pa.int64()), ("pattern", pa.string()), ("match", pa.string()), ("context", pa.string()), ("allowed", pa.bool_())])
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            matches = [told(t) if t else [] for t in coded.dictionary.to_pylist()]
            some = pa.array([bool(m) for m in matches], pa.bool_()).take(coded.indices)
            keys, codes = (c.filter(some).to_pylist() for c in (batch.column(0), coded.indices))
            found = [(k, *m) for k, code in zip(keys, codes) for m in matches[code]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return texts.select(key, column).mapInArrow(scan, f"{key} long, pattern string, match string, context string, allowed boolean")


def leak_codes(walked: DataFrame, key: str, patterns: list[str] = LEAK_PATTERNS, allow: list[str] = ()) -> DataFrame:
    """key, codes: distinct sorted codes of forbidden names and of leaking wordings among names and values. Clean records have no row."""
    texts = walked.select(key, F.explode(F.array_compact(F.array("name", "value"))).alias("text"))
    told = leak_matches(texts, key, "text", list(patterns), allow).where("NOT allowed").select(key, F.concat(F.lit("label_leak:"), slug(F.col("match"))).alias("code"))
    return told.unionByName(forbidden_names(walked, key).select(key, "code")).groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))
