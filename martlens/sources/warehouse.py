"""The warehouse: snapshots of gold tables over Parquet, laid out for pruning.

A load writes each table to a folder of its own and then commits one snapshot, a numbered record that names the folder of every
table. The record appears by a rename that fails if the number is taken, so a load is seen whole or not at all, and two loads
at a time are both kept. Readers hold a snapshot; the last KEPT ones stay, with their files. Views in the catalog follow
the newest snapshot for plain SQL; `query` reads one snapshot for all its tables.

Layout: the fact is partitioned by month, and bucketed by transaction_id, as many buckets as the load was joined in, so
a join or a count by transaction needs no exchange and one transaction's lines are in one bucket. Within a file rows are
sorted by customer_id, and Bloom filters on the lookup columns tell row groups without a key apart. A bound on days becomes
a bound on months: see `functions.exprs.on_days`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martlens.functions.exprs import on_days
from martlens.functions.lineage import cut
from martlens.operators.star import assert_unique
from martlens.sources import files

Made = Callable[[Callable[[str], DataFrame]], DataFrame]
#: Keys that must be unique, checked at load.
UNIQUE = {"dim_date": "date_key", "dim_customer": "customer_id", "dim_product": "product_id", "dim_store": "store_id"}
MONTH = "year_month"
KEPT = 3
#: What bronze tables and the fact are joined by.
KEY = "transaction_id"


@dataclass(frozen=True)
class Layout:
    """partition: by the month of `date`. bucket: a column. sort: within files. bloom: lookup columns. group_bytes: of a row group. keys: in one."""

    partition: bool = False
    bucket: str | None = None
    sort: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    group_bytes: int = 32 << 20
    keys: int = 100_000


LAYOUTS = {
    "fact_sales": Layout(True, KEY, ("customer_id",), (KEY, "customer_id", "product_id")),
    "dim_customer": Layout(sort=("customer_id",), bloom=("customer_id",)),
}


@dataclass(frozen=True)
class Stored:
    """A table of a snapshot: its name in the catalog, its folder, and what is needed to name it there again."""

    table: str
    path: str
    schema: str
    rows: int
    layout: dict[str, Any] = field(default_factory=dict)


class Snapshot:
    """One consistent state of all tables."""

    def __init__(self, warehouse: Warehouse, version: int, tables: dict[str, Stored]):
        self.warehouse, self.spark, self.version, self.tables = warehouse, warehouse.spark, version, tables

    def table(self, name: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """A table, of the days from since to until where these are given; the fact has its month as a last column."""
        if name not in self.tables:
            raise KeyError(f"no table {name} in snapshot {self.version}")
        self.warehouse._register(self.tables[name])
        df = self.spark.table(f"`{self.warehouse.db}`.`{self.tables[name].table}`")
        return on_days(df, since, until) if (since or until) and "date" in df.columns else df

    def query(self, sql: str, params: list | dict | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """Any SQL over this snapshot's tables, with ? or :name parameters. The bounds hold for every table that has days."""
        for name in self.tables:
            self.table(name, since, until).createOrReplaceTempView(name)
        try:
            return self.spark.sql(sql, args=params)
        finally:  # the plan is bound to the tables by now
            for name in self.tables:
                self.spark.catalog.dropTempView(name)

    def table_sizes(self) -> DataFrame:
        """table_name, rows: as counted when they were written."""
        return self.spark.createDataFrame([(n, t.rows) for n, t in sorted(self.tables.items())], "table_name string, rows long")

    def layout(self) -> DataFrame:
        """table_name, kind, column: what a lookup can use: partitions, buckets, sort orders, Bloom filters and unique keys."""
        rows = []
        for name, stored in sorted(self.tables.items()):
            how = stored.layout
            rows += [(name, "partition", MONTH)] if how.get("partition") else []
            rows += [(name, "bucket", how["bucket"])] if how.get("bucket") else []
            rows += [(name, kind, c) for kind in ("sort", "bloom") for c in how.get(kind, ())]
            rows += [(name, "unique", UNIQUE[name])] if name in UNIQUE else []
        return self.spark.createDataFrame(rows, "table_name string, kind string, column string")


class Warehouse:
    def __init__(self, spark: SparkSession, database: str = "martlens", buckets: int | None = None, kept: int = KEPT):
        self.spark, self.db, self.kept = spark, database, kept
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        self.home = spark.catalog.getDatabase(database).locationUri.rstrip("/")
        self.records = f"{self.home}/_snapshots"

    # snapshots

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, self.records) if n.endswith(".json") and n[0].isdigit()]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or that of a version; an empty one before the first load."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return Snapshot(self, 0, {})
        record = json.loads(files.read_text(self.spark, f"{self.records}/{version:012d}.json"))
        return Snapshot(self, version, {n: Stored(**t) for n, t in record.items()})

    def _commit(self, new: dict[str, Stored], tries: int = 20) -> Snapshot:
        draft = f"{self.records}/draft-{uuid.uuid4().hex}"
        for _ in range(tries):
            before = self.snapshot()
            after = before.tables | new
            files.write_text(self.spark, draft, json.dumps({n: vars(t) for n, t in after.items()}))
            if files.claim(self.spark, draft, f"{self.records}/{before.version + 1:012d}.json"):
                return Snapshot(self, before.version + 1, after)
        files.delete(self.spark, draft)
        raise RuntimeError(f"{tries} other loads were faster")

    # writing

    def _write(self, name: str, df: DataFrame, layout: Layout) -> Stored:
        """Write a table of its own, counted while it is written; nobody sees it before the commit."""
        table = f"{name}__{uuid.uuid4().hex[:12]}"
        path, full, seen = f"{self.home}/{table}", f"`{self.db}`.`{table}`", Observation()
        if layout.partition:
            df = df.withColumn(MONTH, F.date_format("date", "yyyy-MM"))
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if layout.bucket:  # Catalyst leaves this out where the rows are dealt like that already
            df = df.repartition(self.buckets, layout.bucket)
        elif layout.partition:
            # months are brought together, and a large one is split over as many tasks as its size asks for
            df = df.hint("rebalance", F.col(MONTH))
        if layout.sort and not layout.bucket:
            df = df.sortWithinPartitions(*layout.sort)
        out = df.write.format("parquet").option("path", path).option("parquet.block.size", layout.group_bytes)
        for c in layout.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(layout.keys))
        if layout.partition:
            out = out.partitionBy(MONTH)
        if layout.bucket:
            out = out.bucketBy(self.buckets, layout.bucket)
            out = out.sortBy(*layout.sort) if layout.sort else out
        out.saveAsTable(full)
        how = {"partition": layout.partition, "bucket": layout.bucket, "buckets": self.buckets, "sort": list(layout.sort), "bloom": list(layout.bloom)}
        return Stored(table, path, self.spark.table(full).schema.json(), seen.get["rows"], how)

    def _discard(self, stored: Stored) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.db}`.`{stored.table}`")
        files.delete(self.spark, stored.path)

    @contextmanager
    def staging(self) -> Iterator[Callable[[str, DataFrame], DataFrame]]:
        """A writer of tables that a load works with, bucketed by KEY where they have it; they go when the load ends.

        What is joined or aggregated by KEY from there on needs no exchange. A KEY with a large share of all rows is one task.
        """
        made: list[Stored] = []

        def write(name: str, df: DataFrame) -> DataFrame:
            if KEY not in df.columns:
                return cut(df)
            table = f"{name}__{uuid.uuid4().hex[:12]}"
            made.append(Stored(table, f"{self.home}/{table}", "", 0))
            dealt = df.repartition(self.buckets, KEY).write.format("parquet").option("path", made[-1].path)
            dealt.bucketBy(self.buckets, KEY).saveAsTable(f"`{self.db}`.`{table}`")
            return self.spark.table(f"`{self.db}`.`{table}`")

        try:
            yield write
        finally:
            for stored in made:
                self._discard(stored)

    def load(self, tables: dict[str, DataFrame | Made | None], analyze: bool = True, layouts: dict[str, Layout] = LAYOUTS) -> dict[str, int]:
        """Replace the given tables in one step; rows of each. Tables that are None are left out.

        A function in place of a table gets a reader of those that this load has written before it.
        """
        new: dict[str, Stored] = {}
        try:
            for name, df in tables.items():
                if callable(df):
                    df = df(Snapshot(self, 0, new).table)
                if df is not None:
                    new[name] = self._write(name, df, layouts.get(name, Layout()))
                    if name in UNIQUE:
                        assert_unique(self.spark.table(f"`{self.db}`.`{new[name].table}`"), UNIQUE[name])
                    if analyze:
                        self.spark.sql(f"ANALYZE TABLE `{self.db}`.`{new[name].table}` COMPUTE STATISTICS FOR ALL COLUMNS")
            done = self._commit(new)
        except Exception:
            for stored in new.values():
                self._discard(stored)
            raise
        self.publish(done)
        self.vacuum()
        return {n: t.rows for n, t in new.items()}

    def publish(self, snapshot: Snapshot | None = None) -> None:
        """Let the catalog's views follow a snapshot, the newest by default; each is replaced in one step."""
        snapshot = snapshot or self.snapshot()
        for name, stored in snapshot.tables.items():
            self._register(stored)
            self.spark.sql(f"CREATE OR REPLACE VIEW `{self.db}`.`{name}` AS SELECT * FROM `{self.db}`.`{stored.table}`")

    def _register(self, stored: Stored) -> None:
        """Name a table in this session's catalog, where it isn't: a catalog in memory forgets."""
        full = f"`{self.db}`.`{stored.table}`"
        if self.spark.catalog.tableExists(full):
            return
        if not files.exists(self.spark, stored.path):
            raise FileNotFoundError(f"{stored.path} is gone: only the last {self.kept} snapshots stay")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(stored.schema)))
        how = stored.layout
        parts = f"PARTITIONED BY (`{MONTH}`)" if how["partition"] else ""
        order = f"SORTED BY ({', '.join(how['sort'])})" if how["sort"] else ""
        buckets = f"CLUSTERED BY (`{how['bucket']}`) {order} INTO {how['buckets']} BUCKETS" if how["bucket"] else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING parquet {parts} {buckets} LOCATION '{stored.path}'")
        if parts:
            self.spark.sql(f"MSCK REPAIR TABLE {full}")

    def vacuum(self) -> list[str]:
        """Drop snapshots before the last `kept`, and the tables that only these name; the names of what went.

        Tables of loads that never committed stay as long as their loads may still run: `sweep` drops them.
        """
        versions = self.versions()
        old, kept = versions[: -self.kept], versions[-self.kept :]
        held = {t.table for v in kept for t in self.snapshot(v).tables.values()}
        gone = {t.table: t for v in old for t in self.snapshot(v).tables.values() if t.table not in held}
        for stored in gone.values():
            self._discard(stored)
        for v in old:
            files.delete(self.spark, f"{self.records}/{v:012d}.json")
        return sorted(gone)

    def sweep(self) -> list[str]:
        """Drop what no snapshot names: the remains of loads that were killed. No load may be running."""
        held = {t.table for v in self.versions() for t in self.snapshot(v).tables.values()}
        stray = [n for n in files.names(self.spark, self.home) if "__" in n and n not in held]
        for n in stray:
            self._discard(Stored(n, f"{self.home}/{n}", "", 0))
        for n in files.names(self.spark, self.records):
            if n.startswith("draft-"):
                files.delete(self.spark, f"{self.records}/{n}")
        return stray

    # reading the newest snapshot

    def table(self, name: str, since: str | None = None, until: str | None = None) -> DataFrame:
        return self.snapshot().table(name, since, until)

    def query(self, sql: str, params: list | dict | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        return self.snapshot().query(sql, params, since, until)

    def table_sizes(self) -> DataFrame:
        return self.snapshot().table_sizes()

    def layout(self) -> DataFrame:
        return self.snapshot().layout()


def write_csv(df: DataFrame, folder: str, name: str, order: list[Column | str] | None = None) -> None:
    """A result as CSV, in the given order; arrays become text joined by " + "."""
    df = df.orderBy(*order) if order else df
    flat = [F.array_join(F.col(c).cast("array<string>"), " + ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_json(value: Any, spark: SparkSession, folder: str, name: str) -> None:
    """A small record as one JSON file, through Spark's file system."""
    files.write_text(spark, f"{folder}/{name}.json", json.dumps(value, indent=2, default=str))
