"""Files and pastes that mix RIS, EndNote and BibTeX records with plain text: one table of chunks in order.

Lines come from Spark's text source, which splits large files; a line is known by its file, the
start of its split and its place there. What a line needs to know of those before it (which record
is open, how deep its braces are, which chunk it is in) is a running value: counted within
each split, and carried over from the splits before by their totals, so a file of many splits
is no group of one task. A step that carries over reads its lines twice, so they are cut off
from their plan before (checkpointed where the session names a folder, else persisted).
Contents of a column are one split each, and nothing is carried.

A null or blank file gives no chunks. Line ends of all kinds and a leading byte-order mark are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.sources.tagged import ENW_START, RIS_START

RIS_END = r"^\s*ER\s{1,2}-\s*$"
BIB_START = r"^\s*@[A-Za-z][\w-]*\s*[{(]"
ENW_LINE = r"^\s*%\S(?:\s|$)"
ORDER = ("file_id", "split", "line_no")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_id, split, line_no, line) of text files; a file's splits are read by tasks of their own."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return lines.withColumn("line", F.regexp_replace("line", r"^\x{FEFF}|\r$", ""))


def lines_of(files: DataFrame, at_once: int | None = None) -> DataFrame:
    """(file_id, split, line_no, line) of (file_id, content); a content is one split, or so many lines are."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), "^\\x{FEFF}", ""), r"\r\n?", "\n")
    each = files.select("file_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return each.select("file_id", (F.floor(F.col("line_no") / at_once) if at_once else F.lit(0)).cast("long").alias("split"), F.col("line_no").cast("long").alias("line_no"), "line")


def _cut_off(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def _carried(lines: DataFrame, value: Column, name: str, inside: Column, total: Column, over: Column, joined, several: bool) -> DataFrame:
    """``inside`` within splits; with ``several`` splits joined to what ``over`` makes of the totals of those before."""
    valued = lines.withColumn("_v", value)
    if not several:
        return valued.withColumn(name, inside).drop("_v")
    valued = _cut_off(valued)
    starts = valued.groupBy("file_id", "split").agg(total.alias("_t")).select("file_id", "split", over.alias("_s"))
    return valued.withColumn("_w", inside).join(starts, ["file_id", "split"]).withColumn(name, joined(F.col("_w"), F.col("_s"))).drop("_v", "_w", "_s")


_AHEAD = lambda: Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731 (a row a split)


def carried_sum(lines: DataFrame, value: Column, name: str, several: bool = True) -> DataFrame:
    """``lines`` with ``name``: the sum of ``value`` over the lines of the file before each one."""
    before = Window.partitionBy("file_id", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside, over = F.coalesce(F.sum("_v").over(before), F.lit(0)), F.coalesce(F.sum("_t").over(_AHEAD()), F.lit(0))
    return _carried(lines, value, name, inside, F.sum("_v"), over, lambda w, s: w + s, several)


def carried_last(lines: DataFrame, value: Column, name: str, inclusive: bool, several: bool = True) -> DataFrame:
    """``lines`` with ``name``: the last ``value`` that is not null before each line (or on it)."""
    frame = Window.partitionBy("file_id", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line_no")))
    return _carried(lines, value, name, F.last_value("_v", True).over(frame), last, F.last_value("_t", True).over(_AHEAD()), F.coalesce, several)


def _braces(line: Column) -> Column:
    """Opened less closed braces of a line; escaped ones don't count."""
    bare = F.regexp_replace(line, r"\\.", "")
    return F.char_length(F.regexp_replace(bare, r"[^{]", "")) - F.char_length(F.regexp_replace(bare, r"[^}]", ""))


def chunks(lines: DataFrame, several: bool = True) -> DataFrame:
    """(file_id, chunk_no, kind, text): records (ris, enw, bibtex) and plain texts of each file, in order, without blank ones.

    A RIS record goes from its TY to its ER line, an EndNote record to the first blank line, a
    BibTeX entry to where its braces close. A record that starts ends one that is open, but
    for what looks like a start inside braces. An entry that never closes ends with the next start of an entry.
    ``several``: files may have more than one split.
    """
    line = F.col("line")
    event = F.when(line.rlike(RIS_START), "ris").when(line.rlike(ENW_START), "enw").when(line.rlike(BIB_START), "bibtex")
    marked = lines.withColumn("starts", event)
    # Braces count from the entry on that stands last before a line.
    deep = carried_sum(marked, _braces(line), "depth", several)
    based = carried_last(deep, F.when(F.col("starts") == "bibtex", F.col("depth")), "base", True, several)
    rise = F.col("depth") - F.coalesce("base", F.lit(0))  # before the line
    after = rise + _braces(line)
    kept = based.withColumn("opening", F.when((F.col("starts") == "bibtex") | F.col("base").isNull() | (rise <= 0), F.col("starts")))
    last = carried_last(kept, F.col("opening"), "open", True, several)
    ends = F.when(F.col("open") == "ris", line.rlike(RIS_END)).when(F.col("open") == "enw", line.rlike(r"^\s*$")).when(F.col("open") == "bibtex", (after <= 0) & (line.contains("}") | line.contains(")")))
    closed = last.withColumn("ends", F.coalesce(ends, F.lit(False)))
    # Whether the record that opened last has closed before this line.
    since = carried_last(closed, F.when(F.col("ends"), "closed").when(F.col("opening").isNotNull(), "open"), "state", False, several)
    kind = F.when(F.col("opening").isNotNull(), F.col("opening")).when(F.col("state") == "open", F.col("open")).otherwise("plain")
    typed = since.withColumn("kind", kind)
    changed = carried_last(typed, F.concat_ws(" ", "kind", F.col("ends").cast("string")), "previous", False, several)
    new = F.col("opening").isNotNull() | F.col("previous").isNull() | (F.split("previous", " ")[0] != F.col("kind")) | (F.col("previous").endswith("true") & (F.col("kind") != "plain"))
    numbered = carried_sum(changed, new.cast("int"), "before", several).withColumn("chunk", F.col("before") + new.cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "line_no", "line"))), lambda x: x["line"]), "\n")
    whole = numbered.groupBy("file_id", "chunk").agg(F.first("kind").alias("kind"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    return whole.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("chunk")) - 1).alias("chunk_no"), "kind", "text")
