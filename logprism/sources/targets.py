"""Target documents: reading, validation, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.plan import computed_once
from logprism.functions.text import present, utrim
from logprism.schemas import RAW_TARGET

# The alternative names of a field, and the reasons for rejection.
HOST_NAMES = ("host", "hostname", "server", "ip")
PORT_NAMES = ("port", "ssh_port")
USER_NAMES = ("username", "user")
PATH_NAMES = ("log_paths", "log_dirs", "log_directories", "folders", "paths")
KEY_FILE_NAMES = ("private_key_path", "private_key_file")

NO_TARGET = "missing `target_id`"
NO_HOST = "missing remote host"
NO_USER = "missing SSH username"
NO_PATHS = "missing at least one log directory path"
NO_PASSWORD = "password auth selected but no password was provided"
NO_KEY = "private_key auth selected but no key material was provided"
UNREADABLE = "failed to deserialize target document"

DEFAULT_PORT = 22


def read_targets(documents: DataFrame, column: str = "document") -> DataFrame:
    """Parse a column of JSON documents; an unreadable one keeps its text aside."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    return documents.select(F.from_json(column, RAW_TARGET, options).alias("t")).select("t.*")


def active_targets(raw: DataFrame) -> DataFrame:
    """Targets whose status is exactly ``active``."""
    return raw.where(F.col("status") == "active")


def _field(names: tuple[str, ...], parent: str = "") -> Column:
    return F.coalesce(*[F.col(parent + name) for name in names])


def _named_twice() -> Column:
    """True when a document gives one field under two of its names."""
    groups = [(names, parent) for parent in ("", "connection.") for names in
              (HOST_NAMES, PORT_NAMES, USER_NAMES, PATH_NAMES)]
    groups += [(KEY_FILE_NAMES, ""), (KEY_FILE_NAMES, "credentials.")]
    counts = [
        sum((F.col(parent + name).isNotNull().cast("int") for name in names), F.lit(0)) > 1
        for names, parent in groups
    ]
    return F.array_contains(F.array(*counts), True)


def _out_of_range() -> Column:
    limits = [(name, 65_535) for name in ("port", "ssh_port", "connection.port", "connection.ssh_port")]
    limits += [("sample_line_count", 4_294_967_295), ("max_files", 4_294_967_295)]
    checks = [F.coalesce(~F.col(name).between(0, top), F.lit(False)) for name, top in limits]
    return F.array_contains(F.array(*checks), True)


def with_auth(raw: DataFrame) -> DataFrame:
    """Add ``auth_kind`` (password, private_key_inline, private_key_path, none) and
    ``auth_error``. Secrets themselves are not carried along."""
    password = F.coalesce(present(F.col("password")), present(F.col("credentials.password")))
    key = F.coalesce(present(F.col("private_key")), present(F.col("credentials.private_key")))
    key_file = F.coalesce(
        present(_field(KEY_FILE_NAMES)), present(_field(KEY_FILE_NAMES, "credentials."))
    )
    # A blank secret still selects its method, and then fails for want of a value.
    has_password = F.coalesce(F.col("password"), F.col("credentials.password")).isNotNull()
    has_key = F.coalesce(
        F.col("private_key"),
        F.col("credentials.private_key"),
        _field(KEY_FILE_NAMES),
        _field(KEY_FILE_NAMES, "credentials."),
    ).isNotNull()
    method = F.coalesce(
        F.col("credentials.auth_method"),
        F.when(has_password, F.lit("password")).when(has_key, F.lit("private_key")),
    )
    method = F.lower(utrim(method))
    by_key = method.isin("private_key", "key")
    kind = (
        F.when(method.isNull(), F.lit("none"))
        .when((method == "password") & password.isNotNull(), F.lit("password"))
        .when(by_key & key.isNotNull(), F.lit("private_key_inline"))
        .when(by_key & key_file.isNotNull(), F.lit("private_key_path"))
    )
    error = (
        F.when(kind.isNotNull(), F.lit(None).cast("string"))
        .when(method == "password", F.lit(NO_PASSWORD))
        .when(by_key, F.lit(NO_KEY))
        .otherwise(F.concat(F.lit("unsupported auth_method `"), method, F.lit("`")))
    )
    return raw.withColumn("auth_kind", kind).withColumn("auth_error", error)


def auth_label() -> Column:
    """Label shown in listings: the strongest credential a document holds."""

    def filled(*columns: Column) -> Column:
        return F.array_contains(F.array(*[F.coalesce(c != "", F.lit(False)) for c in columns]), True)

    return (
        F.when(filled(F.col("private_key"), F.col("credentials.private_key")), F.lit("key-inline"))
        .when(
            filled(_field(KEY_FILE_NAMES), _field(KEY_FILE_NAMES, "credentials.")), F.lit("key-file")
        )
        .when(filled(F.col("password"), F.col("credentials.password")), F.lit("password"))
        .otherwise(F.lit("agent"))
    )


def check_targets(raw: DataFrame) -> DataFrame:
    """Merge alternative names and nested objects; add ``reasons``, the array of
    everything wrong with a document, empty for a usable one."""
    paths = F.coalesce(_field(PATH_NAMES), _field(PATH_NAMES, "connection."))
    merged = with_auth(raw).select(
        "document_id",
        present(F.col("target_id")).alias("target_id"),
        F.coalesce(utrim(F.col("status")), F.lit("")).alias("status"),
        F.coalesce(
            present(_field(HOST_NAMES)), present(_field(HOST_NAMES, "connection."))
        ).alias("host"),
        F.coalesce(_field(PORT_NAMES), _field(PORT_NAMES, "connection."), F.lit(DEFAULT_PORT))
        .cast("int")
        .alias("port"),
        F.coalesce(
            present(_field(USER_NAMES)), present(_field(USER_NAMES, "connection."))
        ).alias("username"),
        "auth_kind",
        "auth_error",
        F.coalesce(
            F.filter(F.transform(paths, utrim), lambda p: p != ""), F.array().cast("array<string>")
        ).alias("log_paths"),
        "sample_line_count",
        "max_files",
        F.when(
            F.col("_malformed").isNotNull() | _named_twice() | _out_of_range(), F.lit(UNREADABLE)
        ).alias("_unreadable"),
    )
    target, status = F.col("target_id"), F.col("status")
    bad_name = target.contains("\0") | target.contains("$") | target.startswith("system.")
    reasons = F.array(
        F.when(target.isNull(), F.lit(NO_TARGET)),
        F.when(
            F.lower(status) != "active",
            F.concat(F.lit("target status is `"), status, F.lit("` instead of `active`")),
        ),
        F.when(F.col("host").isNull(), F.lit(NO_HOST)),
        F.when(F.col("username").isNull(), F.lit(NO_USER)),
        F.when(F.size("log_paths") == 0, F.lit(NO_PATHS)),
        F.col("auth_error"),
        F.when(
            bad_name,
            F.concat(F.lit("target_id `"), target, F.lit("` is not a valid MongoDB collection name")),
        ),
    )
    return merged.withColumn(
        "reasons",
        F.when(F.col("_unreadable").isNotNull(), F.array("_unreadable")).otherwise(
            F.array_compact(reasons)
        ),
    ).drop("auth_error", "_unreadable")


def validate_targets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid targets, rejects)``; rejects are ``document_id, reasons``."""
    checked = computed_once(check_targets(raw))
    valid = checked.where(F.size("reasons") == 0).drop("reasons", "status")
    return valid, checked.where(F.size("reasons") > 0).select("document_id", "reasons")


def list_targets(raw: DataFrame) -> DataFrame:
    return raw.orderBy("target_id", "document_id")


def search_targets(raw: DataFrame, text: str = "", status: str = "") -> DataFrame:
    """Targets whose id or host holds ``text`` in any case, and of one exact status."""
    found = raw
    if text:
        # Listings know two of the host names.
        host = F.coalesce(F.nullif("host", F.lit("")), F.nullif("hostname", F.lit("")), F.lit(""))
        needle = F.lower(F.lit(text))
        found = found.where(
            F.coalesce(F.lower("target_id").contains(needle), F.lit(False))
            | F.lower(host).contains(needle)
        )
    return found.where(F.col("status") == status) if status else found


def target_counts(raw: DataFrame) -> DataFrame:
    active = F.count_if(F.col("status") == "active")
    return raw.agg(
        F.count("*").alias("total"), active.alias("active"), (F.count("*") - active).alias("inactive")
    )
