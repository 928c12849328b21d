"""What the training-data operators share: table readers, shared-folder tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Separators of words: space and the code points 9 to 13. Everything else is part of a word.
WHITE = " \t\n\x0b\f\r"

#: The same as a pattern of runs.
SEPARATORS = r"[\x20\x09-\x0D]+"

#: Text bytes that one step of an Arrow kernel handles at once.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); set here only where the session has none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def forget_at_end(spark: SparkSession, path: str) -> None:
    """The JVM removes the table at path when it ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    The table outlives lost executors; the JVM removes it when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about STEP_BYTES for what is run inside: executors hold one a task, on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(STEP_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spare_memory() -> None:
    """A reused Python worker gives back what earlier tasks left in it: the tokenizer's tables and freed memory."""
    bpe = sys.modules.get("helixframe.llm.bpe")
    if bpe and bpe._made:
        bpe._made.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def set_aside(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(docs with all columns but `keep` under names of no operator, what gives the columns of docs back, in order).

    So an operator's own columns can't meet a column of docs of the same name.
    """
    names = {c: c if c in keep else f"aside_{i}__" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda df: df.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text each; a longer text is a slice by itself."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def per_text(df: DataFrame, text: str, kernel: Callable[[list], dict], fields: str) -> DataFrame:
    """Append columns that `kernel` computes from the texts (bytes or None) of a step; rows keep all other columns.

    New columns replace columns of the same name (compared without case, as Spark resolves names).
    """
    new = [f.strip().split(" ")[0].lower() for f in fields.split(",")]
    keep = [c for c in df.columns if c.lower() not in new]
    taken = {c.lower() for c in df.columns} | set(new)
    raw = "text_bytes"
    while raw in taken:
        raw += "_"
    source = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("binary").alias(raw))
    out = StructType.fromDDL(fields)
    arrow = to_arrow_schema(out)
    full = StructType(df.select(*[f"`{c}`" for c in keep]).schema.fields + out.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, raw):
                at = part.schema.get_field_index(raw)
                got = kernel(part.column(at).to_pylist())
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                columns += [pa.array(got[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=names + arrow.names)

    return source.mapInArrow(run, full)
