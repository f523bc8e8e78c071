"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, ascii_lower, or_empty, slot_filter, slot_of, slot_test, table

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_IN = 2


class LineRuns:
    """A log-structured store of line hashes: level 0 holds the newest runs, each sorted by hash; as soon as a level holds
    fan_in runs they are merged into one run of the next. Run rows are (h1, h2, docs, keeper): a 128-bit line hash, the
    number of documents of some batches that hold the line, and the largest id of those.

    The driver knows only the paths of the runs, a number logarithmic in the number of batches.
    """

    def __init__(self, scratch: Scratch, fan_in: int = FAN_IN):
        self.scratch, self.fan_in, self.levels = scratch, fan_in, [[]]

    @staticmethod
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return self.scratch.write(rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2"))

    def view(self) -> DataFrame | None:
        """All runs as one, merged."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionAll(r)
        return self.merge(rows)

    def add(self, batch: DataFrame, settled: int) -> None:
        """Adds a batch (h1, h2, docs, keeper), one row per line, as a run of its own, without the lines that the runs
        already hold in `settled` documents: a merge join against the sorted runs drops those."""
        view = self.view()
        if view is not None:
            batch = batch.hint("merge").join(view.filter(F.col("docs") >= settled), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._sorted(batch))
        for i, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                rows = level[0]
                for r in level[1:]:
                    rows = rows.unionAll(r)
                merged = self._sorted(self.merge(rows))
                self.scratch.drop(*level)
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: the id, n_lines, n_dropped, kept_text.

    Texts are split at \\n (null or empty text: one empty line). A line's key is the line with ASCII white space stripped
    at both ends and A-Z lower-cased. Keys of at least min_chars code points found in at least min_docs documents lose
    all their lines but those of the largest id that holds them; a document that repeats the key keeps all of them. Rows
    that share an id count as one document, each row keeping its own lines; a null id is below all others.

    Ids are taken in `batches` ranges from the largest down, so the first batch that holds a line holds its keeper, and
    a line found in min_docs documents is settled: later batches merge-anti-join it away and it takes no further room.
    A line that all documents share costs one row per document in one even shuffle, then one partial sum per task.
    Texts that lose a line are shuffled once, by id, to meet the list of its number; a slot filter of bounded size lets the others pass. An empty
    table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).alias("_id"), or_empty(F.col(text_col)).alias("_text")).withColumn("_rid", F.xxhash64("_text"))
    edges = docs.select(F.percentile_approx(F.col(id_col), [i / batches for i in range(1, batches)], 1000).alias("e")).first()["e"] or []
    batch = F.lit(0)
    for e in edges:  # ids up to the lowest edge, and null ones, come last
        batch = batch + F.when(F.col("_id") > F.lit(e), 0).otherwise(1)
    found = rows.select("_id", "_rid", batch.alias("_batch"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    key = line_key(F.col("_line"))
    found = found.filter(F.char_length("_line") >= min_chars).withColumn("_key", key).filter(F.char_length("_key") >= min_chars)
    lines = scratch.write(found.select("_id", "_rid", "_pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"), "_batch"), "_batch")

    runs = LineRuns(scratch, fan_in)
    for b in range(len(edges) + 1):
        held = lines.filter(F.col("_batch") == b).select("h1", "h2", "_id").distinct()
        runs.add(held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("_id").alias("keeper")), min_docs)
    common = runs.view().filter(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    lost = lines.join(common, ["h1", "h2"]).filter(~F.col("_id").eqNullSafe(F.col("keeper")))
    lost = scratch.write(lost.groupBy("_id", "_rid").agg(F.sort_array(F.collect_set("_pos")).alias("_lost")))
    scratch.release()

    # texts that lose no line stay where they are, but for a few that share a slot with one that does; the lists grow with the table, so they
    # aren't broadcast even where they would fit
    touched = scratch.write(slot_filter(lost.select(slot_of(F.col("_id"), F.col("_rid")).alias("slot")).distinct()))
    marked = slot_test(rows.withColumn("_slot", slot_of(F.col("_id"), F.col("_rid"))), "_slot", touched, "_maybe").select("_id", "_rid", "_text", "_maybe")
    met = marked.filter("_maybe").join(lost.withColumnsRenamed({"_id": "_lid", "_rid": "_lrid"}).hint("merge"), F.col("_id").eqNullSafe(F.col("_lid")) & (F.col("_rid") == F.col("_lrid")), "left")
    # what stays are the slices between dropped line numbers
    text = marked.filter(~F.col("_maybe")).select("_id", "_text", F.lit(None).cast("array<int>").alias("_lost")).unionAll(met.select("_id", "_text", "_lost"))
    text = text.withColumn("_lines", F.split("_text", "\n"))
    kept = F.expr("""array_join(flatten(transform(sequence(0, size(_lost)), i ->
        slice(_lines, if(i = 0, 0, _lost[i - 1] + 1) + 1, if(i = size(_lost), size(_lines), _lost[i]) - if(i = 0, 0, _lost[i - 1] + 1)))), '\n')""")
    return text.select(
        F.col("_id").alias(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost")).cast("long").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS lost FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
