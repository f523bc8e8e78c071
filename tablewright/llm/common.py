"""What the operators of this subpackage share: text rules, scratch tables in the shared folder, bounded filters."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 both read these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Text that is wholly ASCII takes Spark's byte-wise lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own if driver and executors are one
    process (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tablewright-')}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh(name: str, *taken: list[str]) -> str:
    """The name, lengthened until no column (whatever its case) has it."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


class Scratch:
    """Tables written under the shared folder. A lost executor costs a reread, never a recomputation.

    drop() removes tables that no returned DataFrame reads any more; the last ones of an operator live as long as the
    cluster keeps its checkpoint folder, as checkpoint files do.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/tablewright-{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.path(df, partition_by))

    def path(self, df: DataFrame, partition_by: str | None = None) -> str:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return path

    def drop(self, *frames: DataFrame | str) -> None:
        """Deletes the tables behind these frames, or at these paths."""
        jvm = self.spark._jvm
        for f in frames:
            paths = [f] if isinstance(f, str) else {p.rsplit("/", 1)[0] for p in f.inputFiles()}
            for p in paths:
                if p.startswith("file:/") and not p.startswith("file:///"):
                    p = "file://" + p[5:]
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Has Spark delete the shuffle files of what has been written: it does so once the driver's garbage is collected, which by
        itself may be half an hour later."""
        gc.collect()
        self.spark._jvm.System.gc()


# A slot filter is a bitmap of a fixed number of slots, as rows (word, mask) of 64 slots each. Its size is bounded by
# its number of slots, whatever the input: SLOTS / 64 rows of 16 bytes, 1 MB. A row whose slot is clear certainly
# lacks the property; a set slot may be shared, so an exact test follows.
SLOTS = 1 << 22


def slot_filter(slots: DataFrame, slot: str = "slot") -> DataFrame:
    s = F.col(slot)
    return slots.groupBy(F.shiftright(s, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias("_mask"))


def slot_test(df: DataFrame, slot: str, words: DataFrame, flag: str) -> DataFrame:
    """Adds whether the row's slot is set; the broadcast side has at most SLOTS / 64 rows."""
    w = words.select(F.col("_word").alias(f"_w_{flag}"), F.col("_mask").alias(f"_m_{flag}"))
    joined = df.withColumn(f"_k_{flag}", F.shiftright(F.col(slot), 6)).join(F.broadcast(w), F.col(f"_k_{flag}") == F.col(f"_w_{flag}"), "left")
    return joined.withColumn(flag, F.expr(f"coalesce(getbit(_m_{flag}, cast({slot} & 63 as int)) = 1, false)")).drop(f"_k_{flag}", f"_w_{flag}", f"_m_{flag}")


def slot_of(*cols: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots))


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """docs without the rows whose id is in ids (one column). Rows that a slot filter clears pass without a shuffle; the
    rest, few of which are false hits, meet the ids in an anti-join. Columns of docs may have any names."""
    ids = ids.toDF("_gone")
    words = slot_filter(ids.select(slot_of(F.col("_gone")).alias("slot")))
    rows = docs.select(F.col(id_col).alias("_id"), packed(docs))
    marked = slot_test(rows.withColumn("_slot", slot_of(F.col("_id"))), "_slot", words, "_maybe")
    sure = marked.filter(~F.col("_maybe")).select("_row.*")
    return sure.unionAll(marked.filter("_maybe").join(ids, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*"))


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one, _row, so that names of one's own beside it can't clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
