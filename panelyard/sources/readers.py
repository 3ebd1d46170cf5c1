"""Readers and writers: panel CSV, price files, per-company JSON, samples and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.calendar import number
from ..functions.draws import draw
from .schemas import AS_OF, HISTORY, INSIDER, METRICS, PANEL_CSV, REGISTRANTS


def read_panel(spark: SparkSession, full: str, sample: str) -> DataFrame:
    """The full export if it is there, else the sample; plain or gzipped CSV with a header.

    A gzipped file is read by one task, so rows are dealt out by company right after."""
    for path in (full, sample):
        try:
            raw = spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        typed = {f.name: f.dataType for f in PANEL_CSV}
        rows = raw.select(*(F.col(c).try_cast(typed.get(c, "string")).alias(c) for c in raw.columns))
        return normalise_panel(rows).repartition("cik")
    raise FileNotFoundError(f"neither {full} nor {sample} is there")


def normalise_panel(raw: DataFrame) -> DataFrame:
    """Dates, company number, flag text and missing numbers made explicit; columns an older panel lacks are null."""
    out = raw
    for c in ("listed_until", "listing_end_source"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    flag = F.coalesce(F.lower(F.trim(F.col("is_listed_equity").cast("string"))) == "true", F.lit(False))
    out = out.withColumn("as_of_date", F.to_date("as_of_date")).withColumn("listed_until", F.to_date("listed_until")).withColumn("is_listed_equity", flag).withColumn("cik", F.col("cik").try_cast("long")).withColumn("fiscal_year", F.col("fiscal_year").try_cast("double").cast("int"))
    for c in METRICS:
        if c in out.columns:
            out = out.withColumn(c, number(F.col(c)))
    return out


def symbol_key(ticker: Column) -> Column:
    """BRK.B as BRK-B."""
    return F.upper(F.replace(ticker, F.lit("."), F.lit("-")))


def read_bars(spark: SparkSession, root: str, suffix: str = ".us.txt") -> DataFrame:
    """(ticker, date, close, volume, is_fund, path) of all price files under root: a header line,
    then at least nine fields. Short and unreadable rows are dropped, as are invalid dates. A
    file lies in a fund folder if any folder from root down has a name that ends in etfs."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root).select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"))
    f = F.split("value", ",")
    below = F.element_at(F.split("path", F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/"), 2), -1)
    rows = lines.where(F.size(f) >= 9).select(
        F.upper(F.regexp_extract("path", r"([^/]+)\.us\.txt$", 1)).alias("ticker"), F.to_date(F.try_to_timestamp(F.get(f, F.lit(2)), F.lit("yyyyMMdd"))).alias("date"),
        F.get(f, F.lit(7)).try_cast("double").alias("close"), F.get(f, F.lit(8)).try_cast("double").cast("long").alias("volume"), below.rlike(r"(?i)etfs/").alias("is_fund"), "path",
    )
    return rows.where("close is not null and volume is not null and date is not null")


def symbol_index(bars: DataFrame, include_funds: bool = False) -> DataFrame:
    """(ticker, path, is_fund): one file per ticker. Funds only on demand; an equity file goes
    before a fund's, then the first path."""
    files = bars.select("ticker", "path", "is_fund").distinct()
    files = files if include_funds else files.where("not is_fund")
    return files.groupBy("ticker").agg(F.min(F.struct("is_fund", "path")).alias("f")).select("ticker", "f.path", "f.is_fund")


def indexed_bars(bars: DataFrame, include_funds: bool = False) -> DataFrame:
    """The bars of the indexed files."""
    return bars.join(symbol_index(bars, include_funds).select("ticker", "path"), ["ticker", "path"], "left_semi")


def read_registrants(spark: SparkSession, path: str) -> DataFrame:
    """(cik, name, tickers) from the registrant list, a JSON object of numbered entries: tickers
    in the list's order, each once; the first title."""
    return registrants(spark.read.option("wholetext", True).text(path).select("value"))


def registrants(texts: DataFrame) -> DataFrame:
    entries = texts.select(F.explode(F.from_json("value", REGISTRANTS)).alias("i", "e")).select(F.col("i").cast("long").alias("i"), F.col("e.cik_str").alias("cik"), F.col("e.ticker").alias("ticker"), F.col("e.title").alias("title"))
    g = entries.groupBy("cik").agg(F.min_by("title", "i").alias("name"), F.array_sort(F.collect_list(F.struct("i", "ticker"))).alias("t"))
    return g.select("cik", "name", F.array_distinct(F.transform("t", lambda x: x["ticker"])).alias("tickers"))


def holders(reg: DataFrame) -> DataFrame:
    """(ticker, ciks): every company that holds a ticker, upper case."""
    return reg.select("cik", F.explode("tickers").alias("t")).groupBy(F.upper("t").alias("ticker")).agg(F.array_sort(F.collect_set("cik")).alias("ciks"))


def by_cik(rows: DataFrame, reg: DataFrame, key: str = "cik") -> DataFrame:
    """rows with the registrant's name and tickers; zero-padded text keys are fine, unknown ones give nulls."""
    return rows.withColumn("_c", F.col(key).try_cast("long")).join(reg.withColumnRenamed("cik", "_c"), "_c", "left").drop("_c")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def fiscal_years(docs: DataFrame) -> DataFrame:
    """(cik, fiscal_year, period_end, year_offset, month_day) of history documents: errors and
    entries without either field are left out, the latest period end stands for its key."""
    rows = docs.where("error is null").select(F.col("cikNumber").alias("cik"), F.explode("years").alias("y")).select("cik", F.col("y.fiscalYear").alias("fiscal_year"), F.to_date("y.periodEnd").alias("period_end")).where("cik is not null and fiscal_year is not null and period_end is not null")
    out = rows.groupBy("cik", "fiscal_year").agg(F.max("period_end").alias("period_end"))
    return out.withColumn("year_offset", F.col("fiscal_year") - F.year("period_end")).withColumn("month_day", F.date_format("period_end", "MM-dd"))


def fundamentals(docs: DataFrame) -> DataFrame:
    """History documents as a frame per (cik, fiscal_year)."""
    y = docs.where("error is null").select(F.col("cikNumber").alias("cik"), F.explode("years").alias("y"))
    return y.select("cik", F.col("y.fiscalYear").alias("fiscal_year"), F.to_date("y.periodEnd").alias("period_end"), F.col("y.revenue").alias("revenue"), F.col("y.netIncome").alias("net_income"), F.col("y.sharesOutstanding").alias("outstanding"), F.col("y.epsDiluted").alias("eps_diluted"), F.col("y.weightedAverageSharesDiluted").alias("diluted"))


def insider_transactions(docs: DataFrame) -> DataFrame:
    """Transactions of insider pages, with `open_market` (code P or S, no derivative, a value) and `side`."""
    t = docs.where("error is null").select(F.col("cikNumber").alias("cik"), F.explode("transactions").alias("t"))
    open_ = F.col("t.code").isin("P", "S") & ~F.coalesce(F.col("t.isDerivative"), F.lit(False)) & (F.coalesce(F.col("t.value"), F.lit(0.0)) != 0)
    return t.select("cik", F.col("t.code").alias("code"), F.to_date("t.transactionDate").alias("day"), F.col("t.value").alias("value"), F.coalesce(open_, F.lit(False)).alias("open_market"), F.when(F.col("t.code") == "P", "buy").when(F.col("t.code") == "S", "sell").alias("side"))


def latest_annual(docs: DataFrame, concept: str = "Revenue") -> DataFrame:
    """(cik, period_end, value, filed_at): the first listed value of the concept; the record's newest filing `probe`."""
    v = docs.where("error is null").select(F.col("cikNumber").alias("cik"), F.posexplode("values").alias("i", "v"))
    one = v.where(F.col("v.conceptGroup") == concept).groupBy("cik").agg(F.min_by("v", "i").alias("v"))
    return one.select("cik", F.to_date("v.periodEnd").alias("period_end"), F.col("v.value").alias("value"), F.to_date("v.filedAt").alias("filed_at")).join(v.groupBy("cik").agg(F.max(F.to_date("v.filedAt")).alias("probe")), "cik")


def pinned(make, spark: SparkSession, path: str) -> DataFrame:
    """What make() gives, written the first time and read ever after."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def entity_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Every row of n keys, the lowest by seeded hash."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(draw(F.lit(seed), key), key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")  # n keys, the caller's own bound


def write_ordered(df: DataFrame, path: str, order: list[str], kind: str = "parquet", rows_a_file: int = 1_000_000, **options) -> DataFrame:
    """df as files in an order: ranges of the order in ranges of file names, sorted inside, at most rows_a_file rows each.

    Returns the manifest (file, rows, first, last): a row a file, in the files' order, with the first and last of `order`;
    it is also written beside the files, as JSON lines in `path`-manifest."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options).option("maxRecordsPerFile", rows_a_file).format(kind).save(path)
    kept = df.sparkSession.read.schema(df.schema).options(**options).format(kind).load(path)
    key = F.struct(*order)
    found = kept.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    found.repartitionByRange("file").sortWithinPartitions("file").write.json(f"{path}-manifest")
    return found.orderBy("file")


def in_order(manifest: DataFrame) -> DataFrame:
    """One row (files, rows, in_order): whether each file begins where the one before it has ended, or later. A row a file is sorted."""
    w = Window.orderBy("file")
    return manifest.withColumn("_fits", F.coalesce(F.lag("last").over(w) <= F.col("first"), F.lit(True))).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.coalesce(F.bool_and("_fits"), F.lit(True)).alias("in_order"))


def write_sample_csv(df: DataFrame, path: str, key: str = "cik", day: str = "as_of_date", rows_a_file: int = 1_000_000) -> DataFrame:
    """The sample as gzipped CSV files in order of key and day; their manifest."""
    return write_ordered(df, path, [key, day], "csv", rows_a_file, compression="gzip", header=True)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, strata: int, seed: int = 0) -> DataFrame:
    """n keys: the first n div strata of each stratum by hash, then the rest by hash."""
    keys = df.groupBy(F.col(key).alias("key")).agg(F.min(stratum).alias("stratum")).withColumn("h", draw(F.lit(seed), "key"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("h", "key"))
    return keys.withColumn("rest", (rank > max(1, n // strata)).cast("int")).orderBy("rest", "h", "key").limit(n).select(F.col("key").alias(key), "stratum")


def write_tables(path: str, parquet: dict[str, DataFrame] | None = None, csv: dict[str, DataFrame] | None = None, json: dict[str, DataFrame] | None = None) -> None:
    """Frames as Parquet, tables as CSV with a header, summaries as JSON lines, each in a folder of its name."""
    for k, df in (parquet or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/{k}")
    for k, df in (csv or {}).items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{k}")
    for k, df in (json or {}).items():
        df.write.mode("overwrite").json(f"{path}/{k}")
