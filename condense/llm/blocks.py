"""Documents in blocks, and the exchange of hashes between blocks and buckets.

A block is some rows with about ``BLOCK`` bytes of text.  ``block_table`` cuts the documents into
blocks once, in one job, and writes them squeezed, a row for each with its name; every later job
reads that table, so names, rows and their order stay the same however Spark splits its files and
whichever executors are lost or join in between.

Operators that compare all documents send *distinct hashes of a block* to hash-range buckets,
packed as sorted differences, and get back one small array for each (block, bucket).  A value that a
third of all documents hold is thus one entry for each block, never one for each document, and no
row grows with the size of a group.  The number of buckets follows the bytes of the texts.

doc_id must be a whole number or null; 2 ** 63 - 1 stands for null and turns to it.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condense.llm.textkit import U64, buffer_of

BLOCK = 8 << 20
#: Stands for a null doc_id: it comes after every number and turns to null again in results.
NO_ID = np.iinfo(np.int64).max


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all executors see; set here only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir() + "/condense-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[tuple[SparkSession, str]] = []


def materialized(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: later reads survive lost executors and don't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._condense_path = path
    return out


def dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """df as a table in the shared folder whose files are dealt by a column into n parts: what meets it by that column is shuffled to it, and its own rows stay."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    path, table = f"{shared_folder(spark)}/tables/{name}", f"spark_catalog.default.condense_{name}"
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(n, by).saveAsTable(table)
    _written.append((spark, path))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only its name: out knows the files, and they stay
    out._condense_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    gone = {t._condense_path for t in tables}
    for spark, path in [x for x in _written if x[1] in gone]:
        _written.remove((spark, path))
        _delete(spark, path)


@contextlib.contextmanager
def scratch(keep: list[DataFrame]):
    """Delete the tables written inside when it ends, but for those put into keep."""
    before = len(_written)
    yield
    kept = {t._condense_path for t in keep}
    for entry in [x for x in _written[before:] if x[1] not in kept]:
        _written.remove(entry)
        _delete(*entry)


def repeatable(df: DataFrame) -> DataFrame:
    """df if it only scans and filters files, so that every job reads the same rows, else its written copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    plain = all(line.lstrip(" +-:").startswith(("Project", "Filter", "Relation")) for line in plan.splitlines() if line.strip())
    return df if plain else materialized(df)


#: Text behind the values of one bucket; a bucket's arrays take several times as much.
BUCKET = 128 << 20


def n_buckets(table: DataFrame, factor: int = 3) -> int:
    """As many buckets as the bytes of a block table ask for, and enough for all cores."""
    spark = table.sparkSession
    size = table.agg(F.sum("bytes")).first()[0] or 0
    return max(96, factor * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


class Block:
    """Some whole documents: ids, the bytes of their texts, offsets, and the other columns as Arrow arrays."""

    def __init__(self, name: int, table: pa.Table, text: str = "text", doc_id: str = "doc_id"):
        self.name, self.table = name, table
        self.buf, self.offsets = buffer_of(table[text])
        ids = table[doc_id].combine_chunks() if doc_id in table.column_names else pa.array(np.arange(table.num_rows))
        self.ids = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)

    @property
    def rows(self) -> int:
        return self.table.num_rows


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, type=pa.int64(), mask=ids == NO_ID)


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Bits of a row's number in its block, and of a block's in its partition.
ROW_BITS = 20
MOST_ROWS = 1 << 16


def iter_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK, text: str = "text") -> Iterator[Block]:
    """Cut the rows of this task into blocks of about size bytes and at most MOST_ROWS rows, whatever the batches are."""
    context = TaskContext.get()
    name = itertools.count((context.partitionId() if context else 0) << ROW_BITS)
    rows_held = 0
    held: list[pa.RecordBatch] = []
    bytes_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer_of(batch.column(batch.schema.get_field_index(text)))
        sizes, at = np.diff(offsets), 0
        total = np.cumsum(sizes)
        while at < batch.num_rows:
            done = int(total[at - 1]) if at else 0
            upto = min(batch.num_rows, at + MOST_ROWS - rows_held, int(np.searchsorted(total, done + size - bytes_held, "left")) + 1)
            held.append(batch.slice(at, upto - at))
            bytes_held += int(total[upto - 1]) - done
            rows_held += upto - at
            at = upto
            if bytes_held >= size or rows_held >= MOST_ROWS:
                yield Block(next(name), pa.Table.from_batches(held), text)
                held, bytes_held, rows_held = [], 0, 0
                trim()
    if held:
        yield Block(next(name), pa.Table.from_batches(held), text)
    held = []
    trim()


# --- packing -------------------------------------------------------------------------------

_codec: dict[str, object] = {}


def squeeze(data: bytes, level: int = 3) -> bytes:
    key = f"c{level}"
    if key not in _codec:
        _codec[key] = zstandard.ZstdCompressor(level=level)
    return _codec[key].compress(data)


def expand(data: bytes) -> bytes:
    if "d" not in _codec:
        _codec["d"] = zstandard.ZstdDecompressor()
    return _codec["d"].decompress(data, max_output_size=1 << 31)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Low bytes first, each byte position together: high ones are mostly zero and shrink away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as squeezed differences."""
    steps = np.diff(values, prepend=U64(0))
    return squeeze(_planes(steps, 8), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def pack_array(values: np.ndarray) -> bytes:
    return squeeze(values.dtype.str.encode().ljust(8) + np.ascontiguousarray(values).tobytes(), 1)


def unpack_array(data: bytes) -> np.ndarray:
    raw = expand(data)
    return np.frombuffer(raw[8:], np.dtype(raw[:8].decode().strip()))


def pack_bits(mask: np.ndarray) -> bytes:
    return squeeze(np.packbits(mask).tobytes(), 1)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(expand(data), np.uint8), count=n).astype(bool)


def split_sorted(values: np.ndarray, buckets: int) -> np.ndarray:
    """Places where each of the equal hash ranges begins in rising values; buckets + 1 of them."""
    bounds = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(values, bounds), [values.size]])


TEXT_SCHEMA = "block long, n int, bytes long, rows binary"


#: Parts of a dealt block table at most; with more blocks a task has more of them, one after another.
MOST_PARTS = 1 << 13


def n_parts(docs: DataFrame, size: int) -> int:
    """Parts for blocks of about size bytes: by Spark's estimate of the rows' bytes where it has one, and enough for all cores."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if guess > 1 << 50 else max(least, min(MOST_PARTS, guess // size))


def block_table(docs: DataFrame, size: int | None = None, level: int = 3, stay: bool = False) -> DataFrame:
    """One written row for each block: its name, rows, bytes of text, and its squeezed rows; with stay they are not shuffled where replies come to them."""
    size = size or BLOCK

    def pack(batches):
        for block in iter_blocks(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.table.schema) as out:
                out.write_table(block.table.combine_chunks())
            rows = squeeze(sink.getvalue().to_pybytes(), level)
            yield pa.RecordBatch.from_arrays([pa.array([block.name], pa.int64()), pa.array([block.rows], pa.int32()), pa.array([block.buf.size], pa.int64()), pa.array([rows], pa.binary())], ["block", "n", "bytes", "rows"])

    table = docs.mapInArrow(pack, TEXT_SCHEMA)
    return dealt(table, "block", n_parts(docs, size)) if stay else materialized(table, "none")


def open_block(name: int, rows: bytes) -> Block:
    return Block(name, pa.ipc.open_stream(pa.py_buffer(expand(rows))).read_all())


def each_block(table: DataFrame, function, schema) -> DataFrame:
    """The record batches that function(block) yields, for all blocks of a written table."""

    def run(batches):
        for batch in batches:
            for name, rows in zip(batch["block"], batch["rows"], strict=True):
                yield from function(open_block(name.as_py(), rows.as_py()))
                trim()

    return table.select("block", "rows").mapInArrow(run, schema)


# --- which hashes repeat -------------------------------------------------------------------

#: Bits of a hash that are compared; more than enough for a filter whose results are verified.
FILTER_BITS = 44


def filter_hashes(h: np.ndarray) -> np.ndarray:
    return h & ~U64((1 << (64 - FILTER_BITS)) - 1)


def bucket_rows(name: int, values: np.ndarray, marks: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, block, values, marks) of a block's rising distinct values and a small number for each."""
    at = split_sorted(values, buckets)
    low = U64(64 - FILTER_BITS)
    out = [(b, pack_sorted(values[i:j] >> low), pack_array(marks[i:j])) for b, (i, j) in enumerate(itertools.pairwise(at.tolist())) if j > i]
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.int32()), pa.array([name] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "block", "values", "marks"]
    )


BUCKET_SCHEMA = "bucket int, block long, values binary, marks binary"
REPLY_SCHEMA = "block long, kind int, bucket long, reply binary"


def tally(counted: DataFrame, cap: int = 255, kind: int = 0) -> DataFrame:
    """For rows of ``bucket_rows``: the sum over all blocks of the marks of each value, at most cap, in the order sent."""

    def total(key, table):
        trim()
        names = table["block"].to_numpy()
        values = [unpack_sorted(x.as_py()) for x in table["values"]]
        marks = [unpack_array(x.as_py()).astype(np.int64) for x in table["marks"]]
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(first) - 1
        sums = np.minimum(np.bincount(group, weights=np.concatenate(marks)[order]), cap).astype(np.uint8 if cap < 256 else np.uint32)
        answer = np.empty(every.size, sums.dtype)
        answer[order] = sums[group]
        cuts = np.cumsum([v.size for v in values])[:-1]
        return pa.table({"block": pa.array(names, pa.int64()), "kind": pa.array([kind] * len(names), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(names), pa.int64()), "reply": pa.array([pack_array(x) for x in np.split(answer, cuts)], pa.binary())})

    return counted.groupBy("bucket").applyInArrow(total, REPLY_SCHEMA)


def replies(table: pa.Table, kind: int) -> np.ndarray | None:
    """The replies of one kind to a block, in the order of its buckets and so of its rising values."""
    found = sorted((b, r) for k, b, r in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["reply"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([unpack_array(r) for _, r in found]) if found else None


def with_replies(blocks: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
    """function(block, table of its replies) for each block of a written table, where they meet by block."""

    def meet(key, rows, table):
        trim()
        return function(open_block(rows["block"][0].as_py(), rows["rows"][0].as_py()), table)

    return blocks.select("block", "rows").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
