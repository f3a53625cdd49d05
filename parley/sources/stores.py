"""Data sources for record stores: SQLite files, and any server reached through a connection factory with retries."""

from __future__ import annotations

import importlib
import json
import random
import sqlite3
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

RAW_TURNS = "interview_id string, pos long, role string, text string, start double, end double, chunk_count long, source_turn_ids array<string>, chunk_ids array<string>"


class SqliteReader(DataSourceReader):
    """A read-only table scan; equality predicates go into the statement, rows are dealt by rowid ranges."""

    def __init__(self, options: dict[str, str], columns: Sequence[str]):
        self.path, self.table = options["path"], options["dbtable"]
        self.parts = int(options.get("partitions", 4))
        self.columns, self.where, self.values = list(columns), [], []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.where.append(f'"{f.attribute[0]}" = ?')
                self.values.append(f.value)
            else:
                yield f

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None:
            return [InputPartition((1, 0))]
        step = -(-(hi - lo + 1) // self.parts)
        return [InputPartition((a, min(a + step - 1, hi))) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        lo, hi = partition.value
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._connect() as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE {where}', [lo, hi, *self.values])


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "INT": "long", "REAL": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            info = db.execute(f'PRAGMA table_info("{self.options["dbtable"]}")').fetchall()
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in info)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema.fieldNames())


def read_sqlite(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    spark.dataSource.register(Sqlite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").options(path=path, dbtable=table, **options).load()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_sqlite(spark, path, "annotations")


def finished_transcripts(spark: SparkSession, path: str, line: str = "array<struct<text:string,start:double,end:double>>") -> DataFrame:
    """doc, annotator, line, text, start, end of transcripts that are done."""
    t = read_sqlite(spark, path, "transcripts").where("done = 1")
    return t.select(F.col("doc_id").alias("doc"), "annotator", F.posexplode(F.from_json("lines_json", line)).alias("line", "l")).select("doc", "annotator", "line", "l.*")


def timed_words(spark: SparkSession, path: str, word: str = "array<struct<word:string,start:double,end:double>>") -> DataFrame:
    """id, eid, role, pos, word, start, end of all documents' word lists."""
    t = read_sqlite(spark, path, "documents")
    return t.select("id", "eid", "role", F.posexplode(F.from_json("words_json", word)).alias("pos", "w")).select("id", "eid", "role", "pos", "w.*")


# -- servers ----------------------------------------------------------------------------------------------------------

TRANSIENT = (ConnectionError, TimeoutError, OSError)


def validate(url: str, attempts: int, base: float) -> None:
    if not url.startswith(("ws://", "wss://")):
        raise ValueError("only ws:// and wss:// addresses")
    if attempts < 1 or base < 0:
        raise ValueError("attempts must be positive, delays not negative")


def with_retries(run: Callable[[], object], attempts: int = 8, base: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, transient: tuple = TRANSIENT):
    """run() again after transient errors, after delays that double up to a bound and vary by chance."""
    for k in range(attempts):
        try:
            return run()
        except transient:
            if k + 1 == attempts:
                raise
            sleep(min(most, base * 2**k) * (0.5 + random.random() / 2))
    raise AssertionError


def unwrap(result) -> list[dict]:
    """Records from what a server returns: {"result": [...]}, a list of those, or one nested list."""
    while True:
        if isinstance(result, dict) and "result" in result:
            result = result["result"]
        elif isinstance(result, list) and len(result) == 1 and (isinstance(result[0], list) or (isinstance(result[0], dict) and set(result[0]) >= {"result"})):
            result = result[0]
        else:
            break
    if not isinstance(result, (list, tuple)):
        raise TypeError("the server returned no sequence of records")
    return list(result)


def load(name: str) -> Callable:
    """The function named module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class ServerReader(DataSourceReader):
    """Partitions are the keys that the factory's client lists; each is fetched with retries, then task retries on top."""

    def __init__(self, options: dict[str, str]):
        self.url, self.factory, self.query = options["url"], options["factory"], options.get("query", "turns")
        self.attempts, self.base = int(options.get("attempts", 8)), float(options.get("base", 0.5))
        validate(self.url, self.attempts, self.base)

    def _client(self):
        return load(self.factory)(self.url)

    def partitions(self):
        keys = with_retries(lambda: list(self._client().keys()), self.attempts, self.base)
        return [InputPartition(k) for k in keys] or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is None:
            return
        for r in unwrap(with_retries(lambda: self._client().query(self.query, partition.value), self.attempts, self.base)):
            for k, t in enumerate(r.get("turns") or ()):
                text = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)
                ids = [text(x) for x in t.get("source_turn_ids") or [t.get("turn_id") or k + 1]]
                yield (text(r["experiment"]), k, t.get("role"), t.get("text"), t.get("startTime"), t.get("endTime"), t.get("chunk_count"), ids, [text(x) for x in t.get("chunk_ids") or ()])


class TurnServer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "turns"

    def schema(self) -> str:
        return RAW_TURNS

    def reader(self, schema) -> ServerReader:
        return ServerReader(self.options)


def read_turns(spark: SparkSession, url: str, factory: str, **options) -> DataFrame:
    """Raw turns of all interviews; factory ("module:function") makes a client with keys() and query(name, key)."""
    spark.dataSource.register(TurnServer)
    return spark.read.format("turns").options(url=url, factory=factory, **{k: str(v) for k, v in options.items()}).load()


def with_interviewer(interviews: DataFrame, mapping: DataFrame) -> DataFrame:
    """interview_id joined with its interviewer; one without is an error."""
    out = interviews.join(mapping, "interview_id", "left")
    kind = mapping.schema["interviewer_id"].dataType.simpleString()
    known = F.when(F.col("interviewer_id").isNull(), F.raise_error(F.concat(F.lit("no interviewer for "), F.col("interview_id").cast("string"))).cast(kind)).otherwise(F.col("interviewer_id"))
    return out.withColumn("interviewer_id", known)
