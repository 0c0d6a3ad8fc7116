"""Helpers that the operators of this subpackage share: input selection, the shared folder, Arrow streaming."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: ASCII white space that separates words: U+0020 and U+0009 to U+000D; bytes.split() uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset on one machine, as in tests, a temporary folder takes its place; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandloom-"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder, unused so far."""
    use_shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Parquet tables that one run writes to the shared folder, each deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.held = spark, new_folder(spark, name), {}

    def save(self, df: DataFrame) -> DataFrame:
        """df as a written table: it outlives executors and cuts the lineage."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.held.items() if any(t is x for x in tables)]:
            discard(self.spark, path)
            del self.held[path]

    def close(self, *but: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*[t for t in self.held.values() if not any(t is x for x in but)])


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder: it outlives executors and cuts the lineage."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Returns to the system what this Python process has freed, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back() -> None:
    """The same, with what only a collection finds."""
    gc.collect()
    release()


def relieved(fn: Callable) -> Callable:
    """fn, after which the worker, which waits for its next task beside others, keeps no freed memory."""

    def run(*of):
        out = fn(*of)
        release()
        return out

    return run


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; else it waits for the driver's next collection.

    Checkpoints go too where spark.cleaner.referenceTracking.cleanCheckpoints is set; else they stay.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and rk, a key of the row's content.

    Rows that agree in id and text share a key and get the same result; rows that share only the id
    stay apart. Other columns of docs are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id"), text).alias("rk"))


def packed(docs: DataFrame) -> DataFrame:
    """Keyed documents with the text as zstd bytes: half of what a shuffle's own compression leaves of it."""
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield {"doc_id": b["doc_id"], "rk": b["rk"], "text": [press.compress(t) for t in as_bytes(b["text"])]}

    return stream(docs, run, f"doc_id {kind}, rk long, text binary")


def unpacked(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(t) for t in as_bytes(column)]


def coded(units: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the most frequent first; the number of each unit among them; how often each occurs."""
    plain = units.dictionary_encode()
    codes = np.asarray(plain.indices)
    counts = np.bincount(codes, minlength=len(plain.dictionary))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return plain.dictionary.take(pa.array(order)), rank[codes], counts[order]


def packed_codes(values: np.ndarray) -> bytes:
    """int32, by planes of bytes: of small numbers the high ones are nearly all zero."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["rk"] == b["rk"])


def stream(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with batches as dicts of lists (binary and string columns as bytes).

    fn gets an iterator over a partition's batches and yields dicts of lists or arrays.
    """
    out = schema_of(schema)
    session.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict]:
            for b in batches:
                yield {n: c for n, c in zip(b.schema.names, b.columns, strict=True)}

        x = None
        for x in fn(columns()):
            yield pa.RecordBatch.from_arrays([x[f.name] if isinstance(x[f.name], pa.Array) else pa.array(x[f.name], type=f.type) for f in out], schema=out)
        x = None
        release()

    return df.mapInArrow(run, schema)


def rewrite(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], drop: tuple[str, ...] = ()) -> DataFrame:
    """Batches of df, all columns, changed or filtered by fn; the result has df's columns but those in drop."""
    session.ship(df.sparkSession)

    def run(batches):
        yield from map(fn, batches)
        release()

    return df.mapInArrow(run, df.drop(*drop).schema)


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64()),
}


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as "a long, b array<int>"."""
    return pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in ddl.split(", ")])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string or binary column as a list of bytes."""
    return column.cast(pa.binary()).to_pylist()
