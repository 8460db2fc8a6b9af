"""Registration of named queries with their SQL, and the pieces of SQL that they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.operators import index
from termloom.operators.corpus import STOP
from termloom.session import keep_until_exit, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: The stored index of each session's folders of tables.
_INDEXES: dict[tuple[str, str], str] = {}


class Tables:
    """The tables of a folder by name, and the index of its documents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, table: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        # a file of one row group is read by one task: tokenizing is worth a shuffle there, by the key of what follows
        if table == "documents" and df.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism:
            return df.repartition("doc_id")
        return df

    def index(self) -> index.Stored:
        """The stored index of documents, built by the first query that asks for it."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _INDEXES:
            path = f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
            index.write_index(self("documents"), path)
            keep_until_exit(self.spark, path)
            _INDEXES[key] = path
        return index.Stored(self.spark, _INDEXES[key])


def query(name: str, sql: str | None = None):
    """Register a function of Tables; sql is the same query for DuckDB."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP_SQL = quoted(STOP)


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(f'lower({x})')}, '[a-z]+(?:[-''][a-z]+)*')"


def tokens(name: str, table: str, key: str = "doc_id", alias: str = "doc_id") -> str:
    """CTE (alias, pos, term) of all words of a table."""
    return f"{name} AS (SELECT {alias}, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT {key} AS {alias}, {words('text')} AS ws FROM {table}))"


def is_valid(x: str = "term", low: int = 2, high: int = 25) -> str:
    return f"length({x}) BETWEEN {low} AND {high} AND {x} NOT IN ({STOP_SQL})"


TOK = tokens("tok", "documents")
VALID = f"val AS (SELECT * FROM tok WHERE {is_valid()})"
TF = f"{TOK}, {VALID}, tf AS (SELECT doc_id, term, count(*) AS tf FROM val GROUP BY ALL)"
TERMS = f"{TF}, terms AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term)"
QTERMS = f"{tokens('qtok', 'benchmark', 'item_id', 'qid')}, q AS (SELECT qid, term, count(*) AS qtf FROM qtok WHERE {is_valid()} GROUP BY ALL)"
