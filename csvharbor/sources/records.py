"""Lenient CSV records from files that Spark may split anywhere.

Lines are read through the splittable text source, so one huge file spreads over as many tasks as its
size asks for. A first pass leaves one small row per file split: how many lines it holds, whether any
line opens a quoted cell that the line does not close, and the first line that looks like the header.
Where no quoted cell spans lines, every line is a record and record numbers are the split's offset plus
the position in the split: no shuffle. Only files with such cells take the second way: each line maps
"outside quotes" and "inside quotes" to the state after it, the maps are chained in line order (within
splits, then across them), and lines that belong together are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from csvharbor.functions import cells
from csvharbor.operators.joins import small_side
from csvharbor.session import cut

SPLIT = ["file", "block", "part"]
MAX_BROADCAST_SPLITS = 1_000_000
HEADER_SEARCH_RECORDS = 20

# A quoted cell ends at a quote that a comma or the end follows; other quotes inside it are text.
_INSIDE = r'(?:[^"]++|""|"(?![",]|\z))*+'
_CELL = rf'(?:"{_INSIDE}"|[^",][^,]*+|)'
_CLOSED_FROM_OUTSIDE = rf"\A{_CELL}(?:,{_CELL})*+\z"
_CLOSED_FROM_INSIDE = rf'\A{_INSIDE}"(?:,{_CELL})*+\z'
_TOKEN = rf',({_CELL})'
_STRICT_CELL = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
_STRICT_RECORD = rf"\A{_STRICT_CELL}(?:,{_STRICT_CELL})*+\z"


def tokenize(raw: Column) -> Column:
    """Record text to its cells, as many as there are."""

    def unquote(token: Column) -> Column:
        inside = F.substr(token, F.lit(2), F.length(token) - 2)
        return F.when(token.startswith('"'), F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(token)

    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(_TOKEN), F.lit(1)), unquote)
    return F.when(raw.contains('"'), quoted).otherwise(F.split(raw, ",", -1))


def _closed(raw: Column) -> Column:
    """A quoted cell that the end of the file cuts off ends there."""
    return F.when(raw.rlike(_CLOSED_FROM_OUTSIDE), raw).otherwise(F.concat(raw, F.lit('"')))


def strict_error(raw: Column) -> Column:
    """What a reader without leniency for stray quotes would refuse."""
    return F.when(raw.contains('"') & ~raw.rlike(_STRICT_RECORD), 'bare or extraneous " in field')


def blank_record(tokens: Column) -> Column:
    return F.forall(tokens, cells.is_blank)


def header_matches(tokens: Column, columns: Sequence[str]) -> Column:
    """Leading cells equal the expected columns, in order, in any case."""
    if not columns:
        return F.lit(True)
    expected, found = (F.transform(cells.clean_cells(c), F.lower) for c in (F.array(*[F.lit(c) for c in columns]), F.slice(tokens, 1, len(columns))))
    return (F.size(tokens) >= len(columns)) & (found == expected)


@dataclass(frozen=True)
class Scan:
    """``records``: file, record_no, raw. ``headers``: file, header_no, header (one row per file that has one)."""

    records: DataFrame
    headers: DataFrame
    files: DataFrame


def read_lines(spark: SparkSession, paths: str | Sequence[str], replacement: str = "\ufffd", **options: str) -> DataFrame:
    text = spark.read.options(lineSep="\n", **options).text(paths)
    value = F.when(F.col("value").endswith("\r"), F.substr("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.spark_partition_id().alias("part"),
        cells.repair_utf8(value, replacement).alias("line"),
    )


def given_files(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    """Every file that the paths name, also those without a byte, from the listing that the driver holds for any read."""
    names = spark.read.options(**options).text(paths).inputFiles()
    return spark.createDataFrame([(name,) for name in names], "file string")


def _after(line: Column) -> tuple[Column, Column]:
    """Quote state (1 = inside) after the line, had it begun outside and inside."""
    quote = line.contains('"')
    outside = F.when(quote & ~line.rlike(_CLOSED_FROM_OUTSIDE), 1).otherwise(0)
    inside = F.when(quote & line.rlike(_CLOSED_FROM_INSIDE), 0).otherwise(1)
    return outside, inside


def _chain(df: DataFrame, from_outside: str, from_inside: str, order: WindowSpec) -> DataFrame:
    """State before each row, ``before0``/``before1``, by the state before the first row of the window.

    A row keeps, flips or sets the state. The state is the last one set, flipped once per flip since.
    """
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    flip = F.when((F.col(from_outside) == 1) & (F.col(from_inside) == 0), 1).otherwise(0)
    df = df.withColumn("_flip", flip).withColumn("_flips", F.sum("_flip").over(through))
    set_to = F.when(F.col(from_outside) == F.col(from_inside), F.pmod(F.col(from_outside) + F.col("_flips"), F.lit(2)))
    df = df.withColumn("_set", set_to).withColumn("_last", F.last("_set", ignorenulls=True).over(earlier))
    flips_before = F.col("_flips") - F.col("_flip")
    for start in (0, 1):
        df = df.withColumn(f"before{start}", F.pmod(F.coalesce("_last", F.lit(start)) + flips_before, F.lit(2)))
    return df.drop("_flip", "_flips", "_set", "_last")


def _split_summary(lines: DataFrame, candidate: Column) -> DataFrame:
    outside, _ = _after(F.col("line"))
    at = F.when(candidate, F.col("at"))
    splits = lines.groupBy(SPLIT).agg(
        F.min("at").alias("base"),
        F.count("*").alias("n"),
        F.max(outside).alias("opens"),
        F.min(at).alias("header_at"),
        F.min_by("line", at).alias("header_line"),
    )
    by_file = Window.partitionBy("file")
    earlier = by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn(
        "spans", F.max("opens").over(by_file)
    )


def _moved() -> Column:
    return F.raise_error(F.lit("files changed between passes")).cast("long")


def _plain_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    offsets = splits.select(*SPLIT, "base", "first", "spans")
    joined = lines.join(small_side(offsets, MAX_BROADCAST_SPLITS), SPLIT, "left")
    number = F.when(F.col("base").isNull(), _moved()).otherwise(F.col("first") + F.col("at") - F.col("base") + 1)
    plain = joined.filter(F.coalesce("spans", F.lit(0)) == 0)
    return plain.select("file", number.alias("record_no"), F.col("line").alias("raw"))


def _spanning_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    files = splits.filter("spans = 1").select("file").distinct()
    outside, inside = _after(F.col("line"))
    marked = (
        lines.withColumn("at", F.monotonically_increasing_id())
        .join(small_side(files, MAX_BROADCAST_SPLITS), "file", "left_semi")
        .withColumn("out", outside)
        .withColumn("ins", inside)
    )
    within = Window.partitionBy(SPLIT).orderBy("at")
    marked = _chain(marked, "out", "ins", within)
    through = within.rowsBetween(Window.unboundedPreceding, 0)
    for start in (0, 1):
        begins = ((F.col(f"before{start}") == 0) & (F.col("line") != "")).cast("int")
        marked = marked.withColumn(f"begun{start}", F.sum(begins).over(through))
    marked = cut(marked)

    def by_start(stem: str) -> Column:
        return F.when(F.col("start") == 0, F.col(f"{stem}0")).otherwise(F.col(f"{stem}1"))

    after = [F.when(F.col(f"before{s}") == 0, F.col("out")).otherwise(F.col("ins")) for s in (0, 1)]
    ends = marked.groupBy(SPLIT).agg(
        F.max_by(after[0], "at").alias("end0"),
        F.max_by(after[1], "at").alias("end1"),
        F.max("begun0").alias("n0"),
        F.max("begun1").alias("n1"),
        F.count_if(F.col("line") != "").alias("lines"),
    )
    across = Window.partitionBy("file").orderBy("block")
    starts = _chain(ends, "end0", "end1", across).withColumn("start", F.col("before0"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("first", F.coalesce(F.sum(by_start("n")).over(earlier), F.lit(0)))
    # The lines are read a second time, blank ones too: a file must have as many others as in the first pass.
    seen = splits.groupBy("file").agg(F.sum("n").alias("seen"))
    starts = starts.withColumn("now", F.sum("lines").over(Window.partitionBy("file"))).join(small_side(seen), "file", "left")
    first = F.when(F.col("now").eqNullSafe(F.col("seen")), F.col("first")).otherwise(_moved()).alias("first")
    starts = starts.select(*SPLIT, "start", first)
    numbered = marked.join(small_side(starts, MAX_BROADCAST_SPLITS), SPLIT).select(
        "file", "block", "at", "line", (F.col("first") + by_start("begun")).alias("record_no"),
        by_start("before").alias("open"), F.when(by_start("before") == 0, F.col("out")).otherwise(F.col("ins")).alias("left_open"),
    )
    whole = (F.col("open") == 0) & (F.col("left_open") == 0)
    single = numbered.filter(whole & (F.col("line") != "")).select("file", "record_no", F.col("line").alias("raw"))
    # Only lines of records that span lines move; a record is as long as its row of the file.
    lines_of = F.sort_array(F.collect_list(F.struct("block", "at", "line")))
    joined = F.array_join(F.transform(lines_of, lambda x: x["line"]), "\n")
    several = numbered.filter(~whole).groupBy("file", "record_no").agg(joined.alias("raw"))
    return single.unionByName(several.withColumn("raw", _closed(F.col("raw"))))


def scan(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    replacement: str = "\ufffd",
    **options: str,
) -> Scan:
    """Records of all files; with ``columns`` the header is looked for, without them the first record is it."""
    lines = read_lines(spark, paths, replacement, **options)
    # The lines are written down with their places, so that later steps do not hang on how the files are split again.
    numbered = cut(lines.filter("line != ''").withColumn("at", F.monotonically_increasing_id()))
    line = F.col("line")
    is_header: Callable[[Column], Column] = lambda raw: F.lit(True)
    if columns is not None:
        is_header = lambda raw: header_matches(tokenize(raw), columns)
        # A header line holds every name; few data lines do, so few lines are tokenized here.
        names = [F.lower(line).contains(F.lower(cells.clean_cell(F.lit(c)))) for c in columns if '"' not in c]
        candidate = reduce(and_, [*names, is_header(line)])
    else:
        candidate = F.lit(True)
    splits = cut(_split_summary(numbered, candidate))
    records = _plain_records(numbered, splits)
    found = splits.filter("spans = 0 and header_at is not null").select(
        "file", (F.col("first") + F.col("header_at") - F.col("base") + 1).alias("header_no"), F.col("header_line").alias("raw")
    )
    if splits.filter("spans = 1").limit(1).count():
        spanning = cut(_spanning_records(lines, splits))
        records = records.unionByName(spanning)
        early = spanning.filter(F.col("record_no") <= HEADER_SEARCH_RECORDS).filter(is_header(F.col("raw")))
        found = found.unionByName(early.select("file", F.col("record_no").alias("header_no"), "raw"))
    headers = (
        found.filter(F.col("header_no") <= HEADER_SEARCH_RECORDS)
        .groupBy("file")
        .agg(F.min("header_no").alias("header_no"), F.min_by("raw", "header_no").alias("raw"))
        .select("file", "header_no", tokenize(F.col("raw")).alias("header"))
    )
    return Scan(records, headers, splits.groupBy("file").agg(F.sum("n").alias("lines")))
