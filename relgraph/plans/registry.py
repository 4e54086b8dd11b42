"""Registered queries, each with the SQL that must give the same rows.

Input relations are written once, as SQL both engines read: ``$table`` names a
given parquet table and ``@name`` another relation of this module. The queries
themselves run the library's DataFrame operators; the SQL beside them is written
independently of those.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relgraph.session import shared_dir

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

RELATIONS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"@([a-z_0-9]+)")
_TABLE = re.compile(r"\$(" + "|".join(TABLES) + r")\b")


# Relations that stand for stored tables: written once per session to the shared folder. Those are relations that
# take joins to make, texts that are split where they lie, and few rows out of whole tables that many parts of a plan read;
# a projection of another table is cheaper to compute again.
STORED: set[str] = set()
_written: dict[tuple[str, str, str], str] = {}
# Rows of one file of a stored relation: an input in one piece is read by many tasks afterwards, without a shuffle of its rows.
FILE_ROWS = 1 << 15


# Tables that Spark reads dealt by one column for a relation: distinct rows with this column and a join by it then find
# their rows in place and move them once.
DEALT: dict[str, dict[str, str]] = {}


def relation(name: str, sql: str, stored: bool = False, dealt: dict[str, str] | None = None) -> None:
    RELATIONS[name] = sql
    DEALT[name] = dealt or {}
    if stored:
        STORED.add(name)


def _ordered(sql: str, seen: list[str], bodies: dict[str, str]) -> list[str]:
    for name in _NAME.findall(sql):
        if name not in seen:
            _ordered(bodies[name], seen, bodies)
            seen.append(name)
    return seen


def _with(sql: str, bodies: dict[str, str] = RELATIONS) -> str:
    names = _ordered(sql, [], bodies)
    body = _NAME.sub(r"r_\1", sql)
    if not names:
        return body
    ctes = ",\n".join(f"r_{n} AS ({_NAME.sub(lambda m: 'r_' + m.group(1), bodies[n])})" for n in names)
    recursive = body.lstrip()
    if recursive.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{recursive[len('WITH RECURSIVE'):]}"
    if recursive.upper().startswith("WITH"):
        return f"WITH {ctes},\n{recursive[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def duck_sql(sql: str) -> str:
    text = _TABLE.sub(r"\1", _with(sql))
    text = re.sub(r"sha2\(([^()]*(?:\([^()]*\)[^()]*)*), 256\)", r"sha256(\1)", text)
    text = re.sub(r"unix_millis\((cast\(\w+ AS timestamp\))\)", r"(epoch_us(\1) // 1000)", text)
    return text.replace("octet_length(", "strlen(").replace(" div ", " // ")


def _dealt(name: str) -> str:
    """The SQL of a relation with its ``dealt`` tables read by their columns."""
    sql = RELATIONS[name]
    for table, column in DEALT[name].items():
        sql = re.sub(rf"\${table}\b", f"(SELECT /*+ REPARTITION({column}) */ * FROM ${table})", sql)
    return sql


def _run(spark: SparkSession, sf_dir: str, sql: str, once: bool = False, inline: tuple[str, ...] = ()) -> DataFrame:
    bodies = {name: _dealt(name) for name in RELATIONS}
    for name in _ordered(sql, [], RELATIONS):
        if name in STORED and not once and name not in inline:
            bodies[name] = f"SELECT * FROM parquet.`{_stored(spark, sf_dir, name)}`"
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", _with(sql, bodies)))


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        path = f"{shared_dir(spark)}/relgraph-tables/{key[0]}-{tag}-{uuid.uuid4().hex[:8]}/{name}"
        _run(spark, sf_dir, _dealt(name)).write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(path)
        _written[key] = path
    return _written[key]


def rows(spark: SparkSession, sf_dir: str, name: str, once: bool = False, inline: tuple[str, ...] = ()) -> DataFrame:
    """A relation as a DataFrame; a bare table name reads that table.

    A reader that goes over the rows ``once`` and takes few of their columns has nothing stored for it. One that takes
    few rows has the relations ``inline`` computed where it reads them, over those that stay stored, so its filters come before their joins.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = f"SELECT * FROM @{name}" if name in RELATIONS else f"SELECT * FROM ${name}"
    return _run(spark, sf_dir, sql, once, inline)


def query(name: str, sql: str | None = None):
    """Register ``fn(read)`` under ``name``; ``read(relation[, once][, inline])`` gives its input."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda relation_name, once=False, inline=(): rows(spark, sf_dir, relation_name, once, inline))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck_sql(sql)
        return fn

    return register
