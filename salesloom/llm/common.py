"""What the operators share: input frames, the word pattern, stage tables, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.session import cut_lineage, find_package, tune

#: White space is blank and the five ASCII controls 9 to 13; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows that a Python worker holds at once; a batch of long texts stays in the tens of MB.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """The project's runtime settings, small batches for Python workers, and where those find this package."""
    tune(spark)
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def whole_text(docs: DataFrame, column: str = "text") -> Column:
    """The text of a row; a null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column's name can clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row of ``docs`` as the one column ``row``, beside the columns ``more``: no name of the table's can clash.

    ``select("row.*")`` gives the table's columns back.
    """
    row = F.struct(*[docs[quoted(c)].alias(c) for c in docs.columns]).alias("row")
    return docs.select(row, *[value.alias(name) for name, value in more.items()])


def one_per_key(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, row): of the ``wrapped`` rows of ``docs`` that share a key, the one whose columns hash lowest.

    Rows that differ in columns without an order (maps) alone are taken for equal. Rows meet in partial aggregations
    first, so that a row repeated without end is one per task when it shuffles.
    """
    kinds = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant", "void")]
    fields = [F.col("row")[c] for c in kinds]
    mark = F.struct(F.xxhash64(F.array(*[f.isNull() for f in fields]), *fields), F.xxhash64(F.lit(1), *fields))
    return rows.groupBy("key").agg(F.min_by("row", mark).alias("row"))


def row_key(doc_id: Column, digest: Column) -> Column:
    """A document's id and a digest of its text as one text, also without an id."""
    return F.concat_ws(":", digest.cast("string"), doc_id.cast("string"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder; what follows survives lost executors without computing them anew."""
    return cut_lineage(df, f"llm-{name}")


def per_batch(df: DataFrame, schema: str, make) -> DataFrame:
    """``make`` turns one Arrow batch into lists by column name; no state outlives a batch."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch)
            yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return df.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
