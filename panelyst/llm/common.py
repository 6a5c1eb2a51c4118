"""Helpers shared by the corpus operators: input, scratch tables, hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyspark.sql.functions as F
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: White space of the word definition, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="panelyst-")


def scratch(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    It is the one in ``spark.checkpoint.dir``. Only where that is unset and all
    of Spark is one process, as in tests, a temporary folder stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset; intermediate tables need a folder that all executors share")
    return (folder or _local_scratch()).rstrip("/")


#: The setting of how many rows go to a Python worker at once, and its value while a table is written: whole texts are in them.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


class Tables:
    """Intermediate tables of one operator call, in the shared scratch folder.

    A written table cuts the lineage: an executor lost later costs no
    recomputation of what came before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{scratch(spark)}/panelyst/{name}-{uuid.uuid4().hex}", {}

    def path(self, name: str) -> str:
        return f"{self.root}/{len(self.made) + 1:03d}-{name}"

    def cut(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(BATCH, None)
        self.spark.conf.set(BATCH, BATCH_ROWS)
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.unset(BATCH) if before is None else self.spark.conf.set(BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[path] = out
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for path in [p for p, t in self.made.items() if t is not None and any(t is f for f in frames)]:
            self.made[path] = None
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep_only(self, *frames: DataFrame) -> None:
        self.drop(*[t for t in self.made.values() if t is not None and not any(t is f for f in frames)])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps; it does so when the driver collects garbage.

    The driver's memory outside its heap goes back to the system as well: what
    planning and compiling have freed there stays with the C library's allocator
    otherwise, and adds up over the many plans of a pipeline.
    """
    gc.collect()
    spark._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """The JVM's own command for it (jcmd's System.trim_native_heap); a JVM or system without it is left alone."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types = gateway.new_array(jvm.java.lang.Class, len(kinds))
    for k, kind in enumerate(kinds):
        types[k] = jvm.java.lang.Class.forName(kind)
    given = gateway.new_array(jvm.java.lang.Object, len(kinds))
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with suppress(Py4JJavaError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()  # its class is hidden, its interface is not
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, given)


def free(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has yet (names are compared without regard to case)."""
    used = {c.lower() for f in frames for c in f.columns}
    while name.lower() in used:
        name += "_"
    return name


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more fields behind it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, the first by a hash of the key; spread over all of the input.

    A count sets a share to keep first, so that no task has more than its part
    of the sample to send.
    """
    total = rows.count()
    h = F.xxhash64(F.lit(11), F.col(key))
    if total > 4 * n:
        rows = rows.where(F.shiftrightunsigned(h, 24) < int(2**40 * 2 * n / total))
    return rows.orderBy(h, key).limit(n)


def slices(batches, rows: int = 500):
    """The batches of a partition in smaller frames, so that what is made of one stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def crc_bucket(n: int, col: str = "doc_id"):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


_M = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (public-domain murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M[0]
    h ^= h >> np.uint64(33)
    h = h * _M[1]
    h ^= h >> np.uint64(33)
    return h


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes are split at exactly the blanks of the word definition."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(31).integers(0, 2**64, 256, dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text, one after another, in linear time."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", np.uint8)
    edge = np.diff(np.r_[True, _BLANK[b], True].view(np.int8))
    start, stop = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    up, down = _powers(8, len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start])


_BASES = {seed: np.uint64(int(np.random.default_rng(900 + seed).integers(1, 2**62)) * 4 + 1) for seed in range(1, 9)}
_POWERS: dict = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        size = 1 << max(12, max(n - 1, 0).bit_length())
        base = _BASES[seed]
        inverse = np.uint64(pow(int(base), -1, 2**64))
        _POWERS[seed] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, inverse))
    return _POWERS[seed]


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all k-word windows, from the hashes of the words, in linear time."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(seed, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def least_in(g: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours, by doubling."""
    m, size = g, 1
    while 2 * size <= k:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return m if size == k else np.minimum(m[: len(g) - k + 1], m[k - size :])
