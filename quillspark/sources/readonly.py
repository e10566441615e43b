"""Ad-hoc SQL over registered tables: one statement that only reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MOST_CHARS = 8192
_READS = re.compile(r"\s*(select|with|from|values|table|show|describe|explain)\b", re.I)


def single_statement(sql: str) -> str:
    """The statement, if it is one: no second one after a semicolon, no backslash, no NUL, no more than MOST_CHARS."""
    if len(sql) > MOST_CHARS:
        raise ValueError(f"a statement has at most {MOST_CHARS} characters")
    if "\0" in sql or "\\" in sql:
        raise ValueError("a statement holds no NUL and no backslash")
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if ";" in bare.rstrip().removesuffix(";"):
        raise ValueError("one statement at a time")
    if not _READS.match(bare):
        raise ValueError("only statements that read")
    return sql.strip().removesuffix(";")


def read_only(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Runs a reading statement; {name} in it stands for a table given."""
    return spark.sql(single_statement(sql), **tables)
