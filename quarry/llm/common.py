"""What the operators share: staged tables in the shared folder, bounded Arrow batches and size-checked small joins."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Documents in one Arrow batch. A Python worker holds one batch at a time, so this and the longest text bound its memory.
BATCH_ROWS = 256

#: A side of a join with at most so many rows, and so many bytes where it is stored, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where it is unset, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors on several machines need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="staged-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, keeps columns prunable."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small: texts may be long, and a worker holds a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def small(df: DataFrame, name: str = "small", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Stage df; mark it for broadcast only if its counted rows and its files' bytes are within the limits, else leave a shuffled (skew-aware) join."""
    out = staged(df, name)
    size = int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(out) if size <= BROADCAST_BYTES and out.count() <= limit else out


#: Rows of one key that one task joins.
HOT = 500


def matched(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """many left join one, which has each key once. A key of more than HOT rows is dealt out by a salt, with a copy of its one row for each share."""
    n, shares, salt = fresh(many.join(one.limit(0), key), "n", "shares", "salt")
    hot = small(many.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > HOT).select(key, F.ceil(F.col(n) / HOT).cast("int").alias(shares)), "hot")
    of = F.coalesce(shares, F.lit(1))
    dealt = many.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*many.columns), of).cast("int")).drop(shares)
    copies = one.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), of - 1))).drop(shares)
    return dealt.join(copies, [key, salt], "left").drop(salt)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns, none of which df has in any case."""
    taken, lead = {c.lower() for c in df.columns}, "__"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: bytes.translate table for the same on UTF-8 (multi-byte sequences have no byte in A-Z).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_az(text: str) -> str:
    return text.encode("utf-8", "replace").translate(LOWER).decode("utf-8")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def map_rows(df: DataFrame, fn: Callable[[dict], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """Apply fn to each row's dict; rows leave in batches of the size they came in. fn returns one tuple in schema's order."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            cols = [batch.column(i) for i in range(len(names))]
            rows = [fn({n: c[k].as_py() for n, c in zip(names, cols, strict=True)}) for k in range(batch.num_rows)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)
