"""What the operators share: the shared folder, shipping the package, durable cuts of lineage, batch slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


#: Limits of an Arrow batch, which both sides hold whole: Spark's own are for short rows, texts are long.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application, and keep Arrow batches small, unless the session
    has limits of its own."""
    for name, limit in _BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, limit)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where that is unset, a folder of our own, if
    Spark runs on this machine alone; on a cluster RuntimeError, as each executor would write to its own disk."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "tagsmith-shared")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tagsmith-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables and files of this application, when its results have been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, what: str) -> DataFrame:
    """Like durable, but columnar, so later reads can take single columns."""
    where = fresh_dir(df.sparkSession, what)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def hashed(text: Column) -> Column:
    """A hash of a text, 0 to 2^63 - 1; texts are sampled by it, so that copies count once."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def quotas(sizes: dict[str, int], n: int, even: float) -> dict[str, int]:
    """How many to take from each stratum, n in all, or everything if there is no more: the share `even` of n is dealt
    evenly (one each at least, if they aren't more than n), the rest by size."""
    if sum(sizes.values()) <= n:
        return dict(sizes)
    least = max(1, int(even * n) // len(sizes)) if len(sizes) <= n else 0
    out = {k: min(c, least) for k, c in sizes.items()}
    rest, left = n - sum(out.values()), sum(sizes.values()) - sum(out.values())
    exact = {k: (sizes[k] - out[k]) * rest / left for k in sizes}
    out = {k: out[k] + int(exact[k]) for k in sizes}
    for k in sorted(sizes, key=lambda k: (int(exact[k]) - exact[k], k))[: n - sum(out.values())]:
        out[k] += out[k] < sizes[k]
    return out


def smallest_hashes(table: DataFrame, n: int, even: float) -> list[tuple[str, int]]:
    """table: stratum and h (as of hashed), distinct. For each stratum its smallest hashes, as many as its quota; n in
    all. Of more than n strata the largest n have a part."""
    sizes = {r.stratum: r[1] for r in table.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(n).collect()}
    own = quotas(sizes, n, even)
    if not own:
        return []
    # hashes are uniform: below these bounds there are enough, and not many more
    bounds = [(k, min((1 << 63) - 1, int((1.5 * q + 50) / sizes[k] * (1 << 63)))) for k, q in own.items()]
    near = table.join(F.broadcast(table.sparkSession.createDataFrame(bounds, "stratum string, bound long")), "stratum").filter("h <= bound").select("stratum", "h").collect()
    of: dict[str, list[int]] = {}
    for k, h in near:
        of.setdefault(k, []).append(h)
    return [(k, h) for k in sorted(of) for h in sorted(of[k])[: own[k]]]


#: Bits of the filter that likely() sends to all tasks: 8 MB at most, whatever the tables' sizes.
FILTER_BITS = 1 << 26


def likely(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of df whose keys (nulls are equal) are among wanted's, and of all others about one in FILTER_BITS / (rows of
    wanted): a filter before an exact join, that keeps what can't match from being shuffled."""
    bucket, bits, place = (free_name(df, n) for n in ("bucket", "bits", "place"))
    at = (F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1).alias(place)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = wanted.select(at).select(F.bitmap_bucket_number(place).alias(bucket), F.bitmap_bit_position(place).alias(place))
    sets = places.repartition(n, bucket).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bits))
    own = df.withColumn(place, at).withColumn(bucket, F.bitmap_bucket_number(place)).withColumn(place, F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({place} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return own.join(F.broadcast(sets), bucket).filter(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({place} % 8 as int))")) != 0).select(*(F.col(f"`{c}`") for c in df.columns))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have yet, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about budget bytes of the column, one row at least: bounds what Python holds at once."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > budget:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
