"""Text rules: search, redaction, caps and failure classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names whose contents are hidden.
SECRET_KEYS = [
    "password",
    "passwd",
    "secret",
    "secret_key",
    "app_passcode",
    "token",
    "access_token",
    "refresh_token",
    "jwt",
    "authorization",
    "r2_secret_access_key",
    "r2_access_key_id",
    "redis_auth_url",
    "database_url",
]
REDACTED = "***REDACTED***"
MESSAGE_CHARS = 500
TRACE_CHARS = 4000


def matches_search(column: Column, term: str) -> Column:
    """Case-blind substring search; ``%`` and ``_`` in the term are wildcards."""
    return column.ilike(f"%{term}%")


def redact(fields: Column) -> Column:
    """Map with the values of secret keys replaced, whatever their case."""
    return F.transform_values(
        fields,
        lambda key, value: F.when(F.lower(key).isin(SECRET_KEYS), F.lit(REDACTED)).otherwise(value),
    )


def cap_message(message: Column) -> Column:
    return F.substring(message, 1, MESSAGE_CHARS)


def cap_trace(trace: Column) -> Column:
    """The end of a stack trace, where the cause stands."""
    return F.right(trace, F.lit(TRACE_CHARS))


def failure_class(exception_type: Column, message: Column, errno: Column) -> Column:
    """Struct of category and status code of a failure; the first rule wins.

    ``exception_type`` is a class name, with or without its module.
    """
    name = F.substring_index(exception_type, ".", -1)
    disk = name.isin("OSError", "IOError", "PermissionError") & (errno == 28)
    rules = [
        ("bad_archive", 422, name == "BadZipFile"),
        ("cache", 503, (name == "RedisError") | exception_type.startswith("redis.")),
        ("database", 503, name == "OperationalError"),
        ("storage", 502, name.isin("BotoCoreError", "ClientError") | exception_type.startswith("botocore.")),
        ("disk_full", 507, disk),
        ("permission", 500, name == "PermissionError"),
        ("crop", 422, (name == "ValueError") & F.lower(message).contains("crop")),
    ]
    category, code = F, F
    for label, status, rule in rules:
        category = category.when(rule, label)
        code = code.when(rule, status)
    return F.struct(
        category.otherwise("other").alias("category"),
        code.otherwise(500).cast("int").alias("status_code"),
    )
