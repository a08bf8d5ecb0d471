"""Vendor export scans (S1-S5) with normalisation to the unified schema.

The files of a folder are read as lines, distributed, with the file each line is from and its place in
it, and put together to records: a quoted field may hold commas, doubled quotes and line breaks.  A
line begins a record if the quotes before it in its file are even in number; that is a prefix sum over
the splits of a file and the lines of a split, taken only in files in which a line has an odd number.

A file's first record is its header.  Only the distinct headers reach the driver; each gives the places
of its vendor's columns, and one pass cuts every record into cells, checks their number against the
header's, and picks the columns by place.  So files of one vendor may differ in column order or have
extra columns (an unnamed index).  The vendor is a column expression on the file name: the first of
google / bing / meta that it contains, in either case; other files are skipped.

What a strict cast would not take fails the job: a bad number or date, empty clicks or impressions, a
record with more or fewer cells than its header, a quote inside a cell that isn't quoted, and quotes
left open at a file's end.  Line breaks inside a cell become a line feed each; blank lines are skipped.
"""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.functions.expr import map_campaign_type, meta_prefix_type, nan_to_null

# Accepted date layouts, tried in order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy", "yyyyMMdd"]

# Columns that each vendor's export must name in its header.
LAYOUTS = {
    "google": ["segments_date", "campaign_advertising_channel_type", "campaign_name", "campaign_id", "metrics_conversions_value",
               "metrics_cost_micros", "metrics_clicks", "metrics_impressions", "metrics_conversions", "campaign_budget_amount"],
    "bing": ["TimePeriod", "CampaignType", "CampaignName", "CampaignId", "Revenue", "Spend", "Clicks", "Impressions", "Conversions", "DailyBudget"],
    "meta": ["date_start", "campaign_name", "campaign_id", "conversion", "spend", "clicks", "impressions", "daily_budget"],
}


class NoInputError(RuntimeError):
    pass


def parse_date(c: Column) -> Column:
    """The date of a text in one of DATE_FORMATS; null for null or blank, an error for any other text."""
    # a format that fails costs an exception a row: it is tried only on texts that hold its signs, a year's four digits before the first
    year = F.instr(c, "/") > 4
    may = {"yyyy-MM-dd": c.contains("-") & ~c.contains(":"), "yyyy-MM-dd HH:mm:ss": c.contains(":"), "yyyy/MM/dd": year, "M/d/yyyy": c.contains("/")}
    tried = [F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS]
    tried = [F.when(may[f], t) if f in may else t for f, t in zip(DATE_FORMATS, tried, strict=True)]
    return F.coalesce(*tried, F.when(F.trim(c) != "", F.raise_error(F.concat(F.lit("not a date: "), c)).cast("date")))


def _double(c: Column) -> Column:
    return nan_to_null(c.cast("double"))


def _count(c: Column, name: str) -> Column:
    """A whole number; decimals are cut off, an empty cell is an error."""
    # no text with a point is a bigint; trying costs an exception a row
    number = F.coalesce(F.when(~c.contains("."), c.try_cast("bigint")), c.cast("double").cast("bigint"))
    return F.when(c.isNull(), F.raise_error(F.lit(f"empty {name}")).cast("bigint")).otherwise(number)


Cell = Callable[[str], Column]


def google_columns(cell: Cell) -> list[Column]:
    return [
        parse_date(cell("segments_date")).alias("date"),
        F.lit("google").alias("channel"),
        map_campaign_type(cell("campaign_advertising_channel_type")).alias("campaign_type"),
        cell("campaign_name").cast("string").alias("campaign_name"),
        cell("campaign_id").cast("string").alias("campaign_id"),
        _double(cell("metrics_conversions_value")).alias("revenue"),
        (_double(cell("metrics_cost_micros")) / 1_000_000).alias("spend"),
        _count(cell("metrics_clicks"), "clicks").alias("clicks"),
        _count(cell("metrics_impressions"), "impressions").alias("impressions"),
        _double(cell("metrics_conversions")).alias("conversions"),
        _double(cell("campaign_budget_amount")).alias("daily_budget")]


def bing_columns(cell: Cell) -> list[Column]:
    return [
        parse_date(cell("TimePeriod")).alias("date"),
        F.lit("bing").alias("channel"),
        map_campaign_type(cell("CampaignType")).alias("campaign_type"),
        cell("CampaignName").cast("string").alias("campaign_name"),
        cell("CampaignId").cast("string").alias("campaign_id"),
        _double(cell("Revenue")).alias("revenue"),
        _double(cell("Spend")).alias("spend"),
        _count(cell("Clicks"), "clicks").alias("clicks"),
        _count(cell("Impressions"), "impressions").alias("impressions"),
        _double(cell("Conversions")).alias("conversions"),
        _double(cell("DailyBudget")).alias("daily_budget")]


def meta_columns(cell: Cell) -> list[Column]:
    return [
        parse_date(cell("date_start")).alias("date"),
        F.lit("meta").alias("channel"),
        meta_prefix_type(cell("campaign_name")).alias("campaign_type"),
        cell("campaign_name").cast("string").alias("campaign_name"),
        cell("campaign_id").cast("string").alias("campaign_id"),
        _double(cell("conversion")).alias("revenue"),          # money, not a count
        _double(cell("spend")).alias("spend"),
        _count(cell("clicks"), "clicks").alias("clicks"),      # float text, truncated
        _count(cell("impressions"), "impressions").alias("impressions"),
        F.lit(None).cast("double").alias("conversions"),
        _double(cell("daily_budget")).alias("daily_budget")]


VENDORS = {"google": google_columns, "bing": bing_columns, "meta": meta_columns}


def channel_of(file_name: Column) -> Column:
    """The vendor a file name tells of, null for other files."""
    name = F.lower(file_name)
    return F.coalesce(*[F.when(name.contains(ch), F.lit(ch)) for ch in K.CHANNELS])


# ------------------------------------------------------------------ records
def vendor_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """(file, channel, block, at, line) of the recognised CSV files; (block, at) is a line's place in its file."""
    try:
        lines = spark.read.option("pathGlobFilter", "*.csv").text(data_dir)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise NoInputError(f"{data_dir} does not exist") from e
        raise
    meta = F.col("_metadata")
    lines = lines.select(meta["file_path"].alias("file"), channel_of(meta["file_name"]).alias("channel"), meta["file_block_start"].alias("block"),
                         F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return lines.where(F.col("channel").isNotNull())


def _odd_quotes() -> Column:
    return (F.length("line") - F.length(F.replace("line", F.lit('"')))) % 2


def glued_records(lines: DataFrame) -> DataFrame:
    """(file, channel, block, at, record): lines put together where a quoted field goes on over line breaks;
    the place is the first line's."""
    split = Window.partitionBy("file", "block").orderBy("at")
    # parity before each line, first as if its split began outside quotes
    inside = lines.withColumn("odd", _odd_quotes()).withColumn("before", F.sum("odd").over(split) - F.col("odd"))
    even, uneven = (F.count(F.when(F.col("before") % 2 == k, 1)) for k in (0, 1))
    splits = inside.groupBy("file", "block").agg(F.sum("odd").alias("odds"), even.alias("even"), uneven.alias("uneven"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("turn", F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("records", F.coalesce(F.sum(F.when(F.col("turn") == 0, F.col("even")).otherwise(F.col("uneven"))).over(earlier), F.lit(0)))
    left_open = F.sum("odds").over(Window.partitionBy("file")) % 2 == 1
    splits = splits.withColumn("turn", F.when(left_open, F.raise_error(F.concat(F.lit("quotes are left open in "), "file")).cast("bigint")).otherwise(F.col("turn")))
    placed = inside.join(splits.select("file", "block", "turn", "records"), ["file", "block"])
    first = ((F.col("before") + F.col("turn")) % 2 == 0).cast("bigint")
    numbered = placed.withColumn("number", F.col("records") + F.sum(first).over(split))
    glued = numbered.groupBy("file", "channel", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))
    return glued.select("file", "channel", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"),
                        F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record")).where(F.trim("record") != "")


#: A cell after its comma: quoted (with doubled quotes), or without quotes, or empty.
_CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^",]++|)'


def raw_cells(record: Column) -> Column:
    """A record's cells as they stand, quotes included."""
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))


def checked_cells(record: Column, raw: Column, width: Column) -> Column:
    """The raw cells; an error where they aren't the whole record (quotes amid a cell) or not as many as the header's."""
    told = F.concat(F.size(raw), F.lit(" cells where the header has "), width, F.lit(": "), record)
    stop = lambda text: F.raise_error(text).cast("array<string>")
    return (F.when(F.array_join(raw, ",") != record, stop(F.concat(F.lit("not a CSV record: "), record)))
            .when(F.size(raw) != width, stop(told)).otherwise(raw))


def unquoted(raw: Column) -> Column:
    """A cell's text; null for an empty one."""
    inner = F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    return F.nullif(F.when(raw.startswith('"'), inner).otherwise(raw), F.lit(""))


def header_names(head: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([head.lstrip("\ufeff")]))]


def unified_of(records: DataFrame, heads: DataFrame) -> DataFrame:
    """The unified rows of ``records`` (file, channel, record); ``heads`` has each file's width (cells) and
    places (of its vendor's layout columns, in the layout's order).  Heads go to the records, which stay in
    the tasks that read them: without the hint Spark, not knowing the size of rows made on the driver, may
    send all records to one task, or broadcast them."""
    rows = records.join(F.broadcast(heads.select("file", "width", "places")), "file").withColumn("record", F.ltrim("record", F.lit("\ufeff")))
    # one step each, so that a record is cut once and a cell unquoted once, however many expressions read them
    rows = rows.withColumn("raw", raw_cells(F.col("record")))
    rows = rows.select("channel", "places", checked_cells(F.col("record"), F.col("raw"), F.col("width")).alias("cells"))
    rows = rows.select("channel", *[unquoted(F.get("cells", F.get("places", F.lit(i)))).alias(f"cell_{i}") for i in range(max(map(len, LAYOUTS.values())))])
    each = None
    for channel, columns in VENDORS.items():
        place = {name: i for i, name in enumerate(LAYOUTS[channel])}
        row = F.struct(*columns(lambda name, place=place: F.col(f"cell_{place[name]}")))
        each = F.when(F.col("channel") == channel, row) if each is None else each.when(F.col("channel") == channel, row)
    return rows.select(each.alias("u")).select("u.*").select(*K.UNIFIED_COLUMNS)


def load_all_channels(spark: SparkSession, data_dir: str) -> DataFrame:
    """Union of every recognised vendor file in the fixed unified column order."""
    from revcast.plans.daily import materialize  # late import: plans depend on sources

    lines = vendor_lines(spark, data_dir)
    place = F.struct("block", "at")
    # one pass tells each file's first line, and whether a line has an odd number of quotes
    files = materialize(lines.where(F.trim("line") != "").groupBy("file", "channel").agg(
        F.min_by("line", place).alias("head"), F.min(place).alias("first"), (F.max(_odd_quotes()) == 1).alias("broken")), "files")
    broken = files.where("broken")
    records, heads = lines.where(F.trim("line") != "").withColumnRenamed("line", "record"), files.select("file", "channel", "head", "first")
    if not broken.isEmpty():
        glued = glued_records(lines.join(broken.select("file"), "file", "left_semi"))
        records = records.join(broken.select("file"), "file", "left_anti").unionByName(glued)
        first = glued.groupBy("file", "channel").agg(F.min_by("record", place).alias("head"), F.min(place).alias("first"))
        heads = materialize(heads.join(broken.select("file"), "file", "left_anti").unionByName(first), "files")
    distinct = heads.groupBy("channel", "head").agg(F.min("file").alias("file")).orderBy("channel", "head").collect()     # distinct headers, not files
    if not distinct:
        raise NoInputError(f"{data_dir} holds no CSV file of {', '.join(K.CHANNELS)}")
    layouts = []
    for r in distinct:
        names = header_names(r["head"])
        missing = [c for c in LAYOUTS[r["channel"]] if c not in names]
        if missing:
            raise ValueError(f"the header of {r['file']} does not name {', '.join(missing)}")
        layouts.append((r["channel"], r["head"], len(names), [names.index(c) for c in LAYOUTS[r["channel"]]]))
    known = spark.createDataFrame(layouts, "channel string, head string, width int, places array<int>")
    heads = heads.join(F.broadcast(known), ["channel", "head"]).select("file", "first", "width", "places")
    body = records.join(F.broadcast(heads.select("file", "first")), "file").where(place != F.col("first")).select("file", "channel", "record")
    return unified_of(body, heads)


def source_profile(unified: DataFrame) -> DataFrame:
    """Rows, campaigns and date range per channel."""
    return unified.groupBy("channel").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("campaign_name").alias("campaigns"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"))
