"""Where tables lie: one folder per layer, table and load.

A table in parts is versioned by part: a load writes the parts that it touches and a list of which load holds each part,
so that the others are neither read nor copied, every load's version stays readable, and a rerun replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from salesloom.session import folders_in, read_text, write_text

# The layers.
LAYERS = ("raw_data", "processed_data", "analytics", "ml_features")

#: Tables in parts.
IN_PARTS = frozenset(
    "order_states customer_days customer_totals product_totals "
    "daily_sales_summary product_performance customer_features product_features".split()
)
#: Beside a table's files; Spark's readers pass over names with an underscore.
SCHEMA_FILE = "_schema.json"
PART_LIST = "name string, part string, load_id string, fields string"


@dataclass(frozen=True)
class Layout:
    """Each load writes its own folder, so no job overwrites what it reads and a rerun replaces itself."""

    root: str

    def path(self, layer: str, table: str, load_id: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"layer must be one of {LAYERS}")
        return f"{self.root.rstrip('/')}/{layer}/{table}/load_id={load_id}"

    def write(
        self, df: DataFrame, layer: str, table: str, load_id: str, partition_by: Sequence[str] = ()
    ) -> None:
        """Partitioned tables are rebalanced first: few files per partition, and a big partition in many."""
        if partition_by:
            writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
        else:
            writer = df.write
        path = self.path(layer, table, load_id)
        writer.mode("overwrite").parquet(path)
        write_text(df.sparkSession, f"{path}/{SCHEMA_FILE}", df.schema.json())

    def schema(self, spark: SparkSession, layer: str, table: str, load_id: str) -> T.StructType:
        """The schema that a table was written with, which a table without rows has too."""
        text = read_text(spark, f"{self.path(layer, table, load_id)}/{SCHEMA_FILE}")
        if text is None:
            raise FileNotFoundError(f"{layer}.{table} of load {load_id} was not written to its end")
        return T.StructType.fromJson(json.loads(text))

    def read(self, spark: SparkSession, layer: str, table: str, load_id: str) -> DataFrame:
        if table in IN_PARTS:
            whole = self.read_parts(spark, layer, table, load_id)
            return whole.drop("bucket", "order_month")
        return spark.read.schema(self.schema(spark, layer, table, load_id)).parquet(self.path(layer, table, load_id))

    def write_parts(
        self, df: DataFrame, layer: str, table: str, load_id: str, part: str, previous: str | None
    ) -> None:
        """``df`` has whole parts; those it lacks stay with the load that the previous version has them from."""
        spark = df.sparkSession
        fields = T.StructType([f for f in df.schema.fields if f.name != part])
        self.write(df, layer, table, load_id, [part])
        held = {} if previous is None else {r.part: r.load_id for r in self._parts(spark, layer, table, previous)}
        names = folders_in(spark, self.path(layer, table, load_id))
        held |= {n.partition("=")[2]: load_id for n in names if n.startswith(f"{part}=")}
        rows = [(part, p, owner, fields.json()) for p, owner in sorted(held.items())]
        listed = spark.createDataFrame(rows or [(part, None, load_id, fields.json())], PART_LIST).coalesce(1)
        self.write(listed, layer, f"{table}_parts", load_id)

    def read_parts(
        self, spark: SparkSession, layer: str, table: str, load_id: str, only: Iterable[str] | None = None
    ) -> DataFrame:
        """A version of a table in parts, or ``only`` some parts of it: no other part's files are listed or read."""
        rows = self._parts(spark, layer, table, load_id, with_empty=True)
        wanted = None if only is None else set(only)
        chosen = [r for r in rows if r.part is not None and (wanted is None or r.part in wanted)]
        own = T.StructType.fromJson(json.loads(rows[0].fields)).add(rows[0].name, "string")
        if not chosen:
            return spark.createDataFrame([], own)
        base = self.path(layer, table, load_id).rpartition("/")[0]
        paths = [f"{base}/load_id={r.load_id}/{r.name}={r.part}" for r in chosen]
        fields = T.StructType([*own.fields, T.StructField("load_id", T.StringType())])
        return spark.read.schema(fields).option("basePath", base).parquet(*paths).drop("load_id")

    def _parts(self, spark: SparkSession, layer: str, table: str, load_id: str, with_empty: bool = False) -> list:
        """The list of parts: a row for each, and a single one without a part for an empty table."""
        rows = spark.read.schema(PART_LIST).parquet(self.path(layer, f"{table}_parts", load_id)).collect()
        return rows if with_empty else [r for r in rows if r.part is not None]
