"""Field schema of structured samples: which fields, how often, of which type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.arrays import ratio, runs
from logprism.functions.plan import computed_once
from logprism.functions.text import tokens
from logprism.operators.formats import with_format
from logprism.operators.lines import first_items, with_lines

# The field types in the order in which the later wins a tie.
TYPES = ("string", "number", "bool", "object", "array", "null")
# A name that ends so is taken for an identifier. The rule is a bare
# suffix test, so "valid" and "paid" are identifiers too.
IDENTIFIER = r"(?i)(id|_hash|_key)$"
_NUMBER = r"^[+-]?((?i:inf|infinity|nan)|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"

SCHEMA_TYPE = (
    "struct<fields:array<struct<name:string,inferred_type:string,presence_ratio:double,"
    "is_identifier:boolean>>,sample_coverage:double>"
)


def _type_rank(name: str) -> int:
    return TYPES.index(name)


def json_fields_of(lines: Column) -> Column:
    """Top-level fields of each JSON line as ``struct<name, type>``, type by rank in
    :data:`TYPES`. Duplicate keys stay apart.

    Spark parses a line, as the only item of an array so that a rest behind the
    object shows. Lines that are no proper JSON have no fields.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

    def parse(line: Column) -> Column:
        listed = F.concat(F.lit("["), line, F.lit("]"))
        return F.from_json(F.when(line.endswith("}"), listed), "array<map<string,variant>>", strict)

    def fields(items: Column) -> Column:
        proper = F.get(F.when(F.size(items) == 1, items), F.lit(0))
        return F.coalesce(
            _parsed_fields(F.map_entries(proper)), F.array().cast("array<struct<name:string,type:int>>")
        )

    # In two steps, because a lambda evaluates what it repeats each time it stands there.
    return F.transform(F.transform(lines, parse), fields)


def _parsed_fields(entries: Column) -> Column:
    fields = F.transform(
        F.filter(entries, lambda e: e.key != ""),
        lambda e: F.struct(e.key.alias("name"), F.schema_of_variant(e.value).alias("kind")),
    )
    return F.transform(
        fields,
        lambda f: F.struct(
            f["name"].alias("name"),
            F.when(f.kind == "STRING", _type_rank("string"))
            .when(f.kind == "BOOLEAN", _type_rank("bool"))
            .when(f.kind == "VOID", _type_rank("null"))
            .when(f.kind.startswith("OBJECT"), _type_rank("object"))
            .when(f.kind.startswith("ARRAY"), _type_rank("array"))
            .otherwise(_type_rank("number"))
            .alias("type"),
        ),
    )


def logfmt_fields_of(line: Column) -> Column:
    """``key=value`` tokens of one line, in the form of :func:`json_fields_of`.

    Tokens end at white space even inside quotes.
    """

    def field(token: Column) -> Column:
        value = F.substr(token, F.instr(token, "=") + 1)
        return F.struct(
            F.substring_index(token, "=", 1).alias("name"),
            F.when(value.isin("", "null"), _type_rank("null"))
            .when(value.isin("true", "false"), _type_rank("bool"))
            .when(value.rlike(_NUMBER), _type_rank("number"))
            .otherwise(_type_rank("string"))
            .alias("type"),
        )

    return F.transform(F.filter(tokens(line), lambda t: F.instr(t, "=") > 1), field)


def with_fields(df: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Add ``line_fields``: per candidate line of a json or logfmt sample the fields
    found in it; null for other formats. ``max_lines`` keeps the first candidates only."""
    json_lines = first_items(F.filter("trimmed", lambda x: x.startswith("{")), max_lines)
    logfmt_lines = first_items(
        F.filter("trimmed", lambda x: ~x.startswith("{") & x.contains("=")), max_lines
    )
    return df.withColumn(
        "line_fields",
        F.when(F.col("log_type") == "json", json_fields_of(json_lines)).when(
            F.col("log_type") == "logfmt", F.transform(logfmt_lines, logfmt_fields_of)
        ),
    )


def with_schema(df: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Add the struct ``schema``, null where no candidate line has a field."""
    observed = (
        with_fields(df, max_lines)
        .withColumn("_parsed", F.filter("line_fields", lambda f: F.size(f) > 0))
        .withColumn("_seen", F.array_sort(F.flatten("_parsed")))
        .withColumn("_by_name", runs(F.col("_seen"), lambda o: o["name"]))
    )
    parsed = F.size("_parsed")

    def info(seen: Column) -> Column:
        by_type = F.transform(
            runs(seen, lambda o: o.type),
            lambda r: F.struct(F.size(r).alias("n"), F.get(r, F.lit(0)).type.alias("type")),
        )
        name = F.get(seen, F.lit(0))["name"]
        presence = F.size(seen).cast("double") / parsed
        return F.struct(
            (-presence).alias("order"),
            name.alias("name"),
            F.get(F.array(*map(F.lit, TYPES)), F.array_max(by_type).type).alias("inferred_type"),
            presence.alias("presence_ratio"),
            name.rlike(IDENTIFIER).alias("is_identifier"),
        )

    infos = F.transform(
        F.array_sort(F.transform("_by_name", info)),
        lambda f: F.struct(f["name"], f.inferred_type, f.presence_ratio, f.is_identifier),
    )
    schema = F.struct(
        infos.alias("fields"), ratio(parsed, F.size("line_fields")).alias("sample_coverage")
    )
    described = observed.withColumn("schema", F.when(parsed > 0, schema).cast(SCHEMA_TYPE)).drop(
        "line_fields", "_parsed", "_seen", "_by_name"
    )
    return computed_once(described)


def typed_fields(samples: DataFrame, log_type: str, max_lines: int | None = None) -> DataFrame:
    """Observed fields of the samples of one format, counted per name and type."""
    rows = computed_once(with_fields(with_format(with_lines(samples)), max_lines)).where(
        F.col("log_type") == log_type
    )
    fields = rows.select("sample_hash", F.explode(F.flatten("line_fields")).alias("f"))
    names = F.array(*map(F.lit, TYPES))
    return (
        fields.select("sample_hash", F.col("f.name").alias("field"), F.get(names, F.col("f.type")).alias("type"))
        .groupBy("sample_hash", "field", "type")
        .agg(F.count("*").alias("n"))
    )


def field_schema(samples: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Long form: one row per sample and field."""
    schema = with_schema(with_format(with_lines(samples)), max_lines)
    fields = schema.select("sample_hash", F.posexplode("schema.fields").alias("position", "f"))
    return fields.select(
        "sample_hash", F.col("position").cast("bigint").alias("position"), "f.*"
    ).withColumnRenamed("name", "field")


def schema_coverage(samples: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Share of candidate lines with fields, for the samples that have a schema."""
    schema = with_schema(with_format(with_lines(samples)), max_lines).where(F.col("schema").isNotNull())
    return schema.select(
        "sample_hash", "schema.sample_coverage", F.size("schema.fields").cast("bigint").alias("fields")
    )
