"""Shared helpers of the training-data operators: staged tables, word hashing, document columns."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master has one of its own; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="impactgraph-shared-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        base = _OWN[app]
    return base.rstrip("/")


_OWN: dict[str, str] = {}


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    This cuts the lineage: what follows needs only the table, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.staged_path = path
    _STAGED.append(path)
    return out


def bucketed(df: DataFrame, name: str, keys: tuple[str, ...], parts: int) -> DataFrame:
    """df as a table in the shared folder, dealt to `parts` buckets by keys, so that several joins on them move it once."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/staged/{table}"
    df.repartition(parts, *keys).write.option("compression", "zstd").option("path", path).bucketBy(parts, *keys).saveAsTable(table)
    out = spark.table(table)
    out.staged_path = path
    _STAGED.append(path)
    return out


_STAGED: list[str] = []


def sweep(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables staged after the first `since`, but for those kept: what a result still reads must be kept or read before."""
    kept = {df.staged_path for df in keep}
    gone = [p for p in _STAGED[since:] if p not in kept]
    _STAGED[since:] = [p for p in _STAGED[since:] if p in kept]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged_count() -> int:
    return len(_STAGED)


def spare(names, wanted: str) -> str:
    """A column name like `wanted` that none of the names equals, whatever the case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        if df.staged_path in _STAGED:
            _STAGED.remove(df.staged_path)


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """df with the text as compressed bytes, so that a join moves about a third less; null stays null."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [None if t is None else pack.compress(t) for t in utf8(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if n == text_col else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text_col else f for f in df.schema.fields]))


def unpacked(data: bytes | None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that their Python workers can import it."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if spark.sparkContext.applicationId not in _SHIPPED and os.path.isdir(f"{here}/impactgraph"):
        _SHIPPED.add(spark.sparkContext.applicationId)
        folder = os.path.realpath(tempfile.mkdtemp(prefix="impactgraph-"))  # the driver serves the archive from here
        shutil.copytree(f"{here}/impactgraph", f"{folder}/copy/impactgraph", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/impactgraph", "zip", f"{folder}/copy"))


_SHIPPED: set[str] = set()


def release() -> None:
    """Gives the freed memory of a Python worker back to the system, as workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Readies Python workers: the package is there, and Arrow batches are bounded by bytes, whatever the texts' lengths."""
    ship(spark)
    spark.conf.set(ARROW_BYTES, str(4 << 20))
    spark.conf.set(ARROW_ROWS, "4096")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CUT = re.compile(rb"[\x20\x09-\x0D]")
#: ASCII white space that separates words: space, and tab to carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK, _STEPS = 1 << 22, 4
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 128-bit hashes of the words of one block."""
    n = len(data)
    raw = np.frombuffer(b" " + data + b" " * 8, dtype=np.uint8)
    space = SPACES[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])  # before each word and at its end
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    at = np.ndarray((n + 1,), dtype="<u8", buffer=raw, offset=1, strides=(1,))  # the eight bytes from each place on
    part = at[starts] & _MASK[np.minimum(size, 8)]
    length = size.astype(np.uint64)
    a = mix(part + length * np.uint64(0xA24BAED4963EE407) + np.uint64(1))
    b = mix((part ^ np.uint64(0x9FB21C651E98DF25)) + length * np.uint64(0xD6E8FEB86659FD93))
    for step in range(1, _STEPS):
        own = np.flatnonzero(size > 8 * step)
        if not len(own):
            break
        part = at[starts[own] + 8 * step] & _MASK[np.minimum(size[own] - 8 * step, 8)]
        a[own], b[own] = joint(a[own], part ^ b[own]), joint(b[own] + np.uint64(step), mix(part))
    for i in np.flatnonzero(size > 8 * _STEPS).tolist():
        a[i], b[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
    return starts, np.stack((a, b), axis=1)


def word_table(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 128-bit hashes (two unsigned 64-bit halves a row) of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes.

    Eight bytes at a time go into both halves through a mixing that is a bijection and not linear, so words of up to eight bytes and one length never agree in a half
    and regular longer ones do not either; words of more than 32 bytes get BLAKE2b. Long texts are split block by block.
    """
    data, starts, hashes, at = data.lower() if lower else data, [], [], 0
    while at < len(data):
        found = _CUT.search(data, at + _BLOCK)
        end = found.start() if found else len(data)
        own, h = _hashed(data[at:end])
        starts.append(own + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.uint64))


def words_of(data: bytes, lower: bool = False) -> np.ndarray:
    """The hashes of a text's words."""
    return word_table(data, lower)[1]


def words_of_many(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of several texts, and where each text's words begin among them (one more entry than texts)."""
    starts, hashes = word_table(b"\n".join(texts), lower)
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, ends)


def runs_of(sizes: list[int], limit: int = 1 << 19):
    """Cuts rows into runs (from, to) whose sizes add up to about limit, so that work on a run has bounded memory."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def utf8(column) -> list[bytes | None]:
    """The bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def windows_of(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of each window of `size` consecutive words, given one column of their hashes.

    By doubling: a window is two windows of half its size, whose hashes are mixed together without linear relations, so rearranged or regular windows differ.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, have, done, offset, left = None, mix(hashes + np.uint64((seed * 0xD1342543DE82EF95 + 1) % 2**64)), 1, 0, size
    while left:
        if left & 1:
            part = have[offset : offset + n]
            out = part if out is None else joint(out, part)
            offset += done
        left >>= 1
        if left:
            have = joint(have[:-done], have[done:])
            done *= 2
    return out


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two in order."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0xA24BAED4963EE407)))


def wide_windows(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of windows, as two halves that come from the halves of the word hashes."""
    return windows_of(hashes[:, 0], size), windows_of(hashes[:, 1], size, 7)
