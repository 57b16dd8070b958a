"""Operator 10: exact de-duplication by a tree merge of sorted digest runs. DataFrame operations only.

Each input partition makes one run: its rows' digests, in order, written where they are made. Of each run the distinct
digests go on, with the row to keep and the number of rows. They are exchanged in rounds, like the rounds of a binomial
tree but several runs at a time: in each round, the nodes that differ in one digit of their number meet, each takes the
digests with its own digit, and merges what it gets, in order of the digest. After the last round each node has a range
of digests whole. As every run gives a digest once, a group of copies, however large, is at most one row a run. The merged
digests go back to the runs that have them, and each run's rows join their own: no task gets all copies of a text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.llm.common import write_table

#: Equal digests are taken for equal texts only if these agree too, in every merge.
KEY = ["digest", "n_bytes", "check"]


def tree_shape(partitions: int, fan_in: int = 16) -> tuple[int, int]:
    """Runs that meet in a round, and rounds, so that fan ** rounds nodes are about as many as asked for."""
    rounds = max(1, math.ceil(math.log(max(2, partitions), fan_in) - 1e-9))
    return max(2, math.ceil(partitions ** (1 / rounds) - 1e-9)), rounds


def first_runs(df: DataFrame, nodes: int, text: str, doc_id: str) -> DataFrame:
    """The rows with their digests, a sorted run for each partition; nothing is exchanged."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.pmod(F.spark_partition_id(), F.lit(nodes)).alias("node"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.octet_length(body).alias("n_bytes"),
        F.xxhash64(body).alias("check"),
    )
    return write_table(rows.sortWithinPartitions(*KEY), "digest-runs")


def heads(runs: DataFrame, largest: bool) -> DataFrame:
    """Each run's distinct digests; its rows are put together where they are before anything is exchanged."""
    best = F.max(F.struct("doc_id", "row")) if largest else F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return runs.groupBy("run", "node", *KEY).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))


def merge_runs(runs: DataFrame, fan: int, rounds: int, largest: bool) -> DataFrame:
    """Rounds of exchange and merge; then each digest is in one row."""
    best = F.max("best") if largest else F.min("best")
    home = F.pmod(F.xxhash64("digest"), F.lit(fan**rounds)).cast("int")
    run = runs.select("node", *KEY, "best", "n")
    for k in range(rounds):
        step = fan**k
        digit = lambda c: F.floor(c / F.lit(step)).cast("int") % F.lit(fan)  # noqa: E731, B023
        node = F.col("node") + (digit(home) - digit(F.col("node"))) * F.lit(step)
        met = run.withColumn("node", node.cast("int")).repartition(fan**rounds, "node").sortWithinPartitions("node", *KEY)
        run = met.groupBy("node", *KEY).agg(best.alias("best"), F.sum("n").alias("n"))
    return run.select(*KEY, "best", "n")


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest", fan_in: int = 16) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256 (binary).

    Texts are equal if all their bytes are. Null text counts as an empty one. Of equal texts the row with the largest
    (or smallest) doc_id stays; rows without a doc_id come after all others, and of rows that tie, one stays. keep_id is
    null only if no row of the group has a doc_id. Other columns are left out, whatever their names. An empty table
    gives no rows."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep!r}")
    largest = keep == "largest"
    fan, rounds = tree_shape(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_in)
    runs = first_runs(df, fan**rounds, text, doc_id)
    own = write_table(heads(runs, largest), "digest-heads")
    whole = merge_runs(own, fan, rounds, largest).withColumnsRenamed({"best": "kept_row", "n": "group_size"})
    back = own.select("run", *KEY).join(whole, KEY)
    each = runs.select("run", *KEY, "doc_id", "row").join(back, ["run", *KEY])
    return each.select(
        "doc_id",
        F.col("kept_row.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("kept_row.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
