"""Landed vendor files (CSV, JSON) and result sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.scalars import epoch_millis_day, to_number
from panelloom.operators.normalize import LEGACY_POSITION_NAMES, NONCOMMERCIAL_BUCKETS, noncommercial
from panelloom.session import stored

# The columns of the headerless positioning report, in file order.
REPORT_COLUMNS = """
Market_and_Exchange_Names As_of_Date_In_Form_YYMMDD Report_Date_as_YYYY-MM-DD
CFTC_Contract_Market_Code CFTC_Market_Code CFTC_Region_Code CFTC_Commodity_Code Open_Interest_All
Dealer_Positions_Long_All Dealer_Positions_Short_All Dealer_Positions_Spread_All
Asset_Mgr_Positions_Long_All Asset_Mgr_Positions_Short_All Asset_Mgr_Positions_Spread_All
Lev_Money_Positions_Long_All Lev_Money_Positions_Short_All Lev_Money_Positions_Spread_All
Other_Rept_Positions_Long_All Other_Rept_Positions_Short_All Other_Rept_Positions_Spread_All
Tot_Rept_Positions_Long_All Tot_Rept_Positions_Short_All NonRept_Positions_Long_All NonRept_Positions_Short_All
Change_in_Open_Interest_All
Change_in_Dealer_Long_All Change_in_Dealer_Short_All Change_in_Dealer_Spread_All
Change_in_Asset_Mgr_Long_All Change_in_Asset_Mgr_Short_All Change_in_Asset_Mgr_Spread_All
Change_in_Lev_Money_Long_All Change_in_Lev_Money_Short_All Change_in_Lev_Money_Spread_All
Change_in_Other_Rept_Long_All Change_in_Other_Rept_Short_All Change_in_Other_Rept_Spread_All
Change_in_Tot_Rept_Long_All Change_in_Tot_Rept_Short_All Change_in_NonRept_Long_All Change_in_NonRept_Short_All
Pct_of_Open_Interest_All
Pct_of_OI_Dealer_Long_All Pct_of_OI_Dealer_Short_All Pct_of_OI_Dealer_Spread_All
Pct_of_OI_Asset_Mgr_Long_All Pct_of_OI_Asset_Mgr_Short_All Pct_of_OI_Asset_Mgr_Spread_All
Pct_of_OI_Lev_Money_Long_All Pct_of_OI_Lev_Money_Short_All Pct_of_OI_Lev_Money_Spread_All
Pct_of_OI_Other_Rept_Long_All Pct_of_OI_Other_Rept_Short_All Pct_of_OI_Other_Rept_Spread_All
Pct_of_OI_Tot_Rept_Long_All Pct_of_OI_Tot_Rept_Short_All Pct_of_OI_NonRept_Long_All Pct_of_OI_NonRept_Short_All
Traders_Tot_All
Traders_Dealer_Long_All Traders_Dealer_Short_All Traders_Dealer_Spread_All
Traders_Asset_Mgr_Long_All Traders_Asset_Mgr_Short_All Traders_Asset_Mgr_Spread_All
Traders_Lev_Money_Long_All Traders_Lev_Money_Short_All Traders_Lev_Money_Spread_All
Traders_Other_Rept_Long_All Traders_Other_Rept_Short_All Traders_Other_Rept_Spread_All
Traders_Tot_Rept_Long_All Traders_Tot_Rept_Short_All
Conc_Gross_LE_4_TDR_Long_All Conc_Gross_LE_4_TDR_Short_All Conc_Gross_LE_8_TDR_Long_All Conc_Gross_LE_8_TDR_Short_All
Conc_Net_LE_4_TDR_Long_All Conc_Net_LE_4_TDR_Short_All Conc_Net_LE_8_TDR_Long_All Conc_Net_LE_8_TDR_Short_All
Contract_Units CFTC_Contract_Market_Code_Quotes CFTC_Market_Code_Quotes CFTC_Commodity_Code_Quotes
CFTC_SubGroup_Code FutOnly_or_Combined
""".split()

REQUIRED_REPORT_FIELDS = set(LEGACY_POSITION_NAMES)
NEWER_REPORT_FIELDS = {
    "Market_and_Exchange_Names", "Report_Date_as_YYYY-MM-DD", "Open_Interest_All",
    *[f"{bucket}_Positions_{side}_All" for bucket in NONCOMMERCIAL_BUCKETS for side in ("Long", "Short")],
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV with a declared schema; values are text until a lenient cast reads them."""
    return spark.read.schema(schema).option("header", header).csv(path)


def _text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positioning reports in the older layout's columns; each file may have a layout of its own.

    A file with a named header is read by that header, any other by position. Older reports
    pass through, newer ones are reduced to their non-commercial sums. A file in neither
    layout, or with another number of cells, is an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    lines = lines.withColumn("named", F.col("value").rlike('^\\s*"?Market_and_Exchange_Names'))
    # The headers of the files are looked for once. A layout takes only the files it belongs to: by their names Spark drops
    # the other files before it reads them, and the names are no more than its own list of the folder.
    heads = stored(lines.where("named").groupBy("file").agg(F.min("value").alias("head"), F.max(cells("value")).alias("wanted")), "report-heads")
    # One row per layout that occurs, of which a vendor has a few.
    layouts = heads.groupBy("head", "wanted").agg(F.collect_list("file").alias("files")).collect()
    rows = lines.where("not named")
    parts = [_report_rows(rows.where(~F.col("file").isin([f for r in layouts for f in r["files"]])), REPORT_COLUMNS, len(REPORT_COLUMNS))]
    for r in layouts:
        names = [cell.strip().strip('"') for cell in r["head"].split(",")]
        parts.append(_report_rows(rows.where(F.col("file").isin(r["files"])), names, r["wanted"]))
    return reduce(DataFrame.unionByName, parts)


def cells(line: str) -> Column:
    """Commas with an even number of quotes behind them separate cells; found in time linear in the line.

    From the end, quoted stretches drop out in pairs of quotes, and so does all before a quote without its pair.
    """
    bare = F.when(F.col(line).contains('"'), F.regexp_replace(F.reverse(F.col(line)), '"[^"]*(?:"|$)', "")).otherwise(F.col(line))
    return F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _report_rows(rows: DataFrame, names: list[str], wanted: int) -> DataFrame:
    if not (REQUIRED_REPORT_FIELDS <= set(names) or NEWER_REPORT_FIELDS <= set(names)):
        raise ValueError(f"unknown report layout: {names[:6]}")
    message = F.concat(F.lit("report line with another number of cells: "), F.substring("value", 1, 80))
    line = F.when(cells("value") == wanted, F.col("value")).otherwise(F.raise_error(message))
    # A generator's row is read once; conditions on a plain column's cells would parse the line again for each of them.
    parsed = rows.select(F.inline(F.array(F.from_csv(line, ", ".join(f"`{n}` STRING" for n in names)))))
    frame = parsed.select(*[F.trim(F.col(f"`{n}`")).alias(n) for n in names])
    if REQUIRED_REPORT_FIELDS <= set(names):
        return frame.select(*[F.col(f"`{n}`") for n in LEGACY_POSITION_NAMES])
    reduced = noncommercial(frame)
    return reduced.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in LEGACY_POSITION_NAMES])


OBSERVATION_SCHEMA = "ticker string, observations array<struct<date: string, value: string>>"
BAR_SCHEMA = "ticker string, results array<struct<t: bigint, c: double>>"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents with an observations list to (dt, ticker, px_last)."""
    docs = spark.read.schema(OBSERVATION_SCHEMA).json(path)
    flat = docs.select("ticker", F.inline("observations"))
    return flat.select(
        F.col("date").try_cast("date").alias("dt"), "ticker", to_number(F.col("value")).alias("px_last")
    )


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents with epoch-millisecond bars to (dt, ticker, px_last)."""
    docs = spark.read.schema(BAR_SCHEMA).json(path)
    flat = docs.select("ticker", F.inline("results"))
    return flat.select(epoch_millis_day(F.col("t")).alias("dt"), "ticker", F.col("c").alias("px_last"))


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Result table partitioned by run, as parquet, csv or json."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown sink {kind!r}")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
