"""Look-alike tables on the driver's star schema, and their SQL for the oracle.

Derived numbers are rounded here, once, well above their noise, so that ranks and ties do not
depend on the order in which an engine adds up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tickers, the mean unit price of a ship date as the close."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity")
    days = li.groupBy("l_suppkey", "date").agg(F.round(F.avg("p"), 8).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
    return days.select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), "date", "close", "volume")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean unit price over all suppliers by ship date."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 8).alias("close"))


def panel_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense priced panel: suppliers by quarter of the ship date."""
    li = table(spark, sf_dir, "lineitem")
    as_of = F.last_day(F.make_date(F.year("l_shipdate"), F.quarter("l_shipdate") * 3, F.lit(1)))
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    g = li.groupBy(F.col("l_suppkey").alias("cik"), as_of.alias("as_of_date")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - d)), 4).alias("revenue"), F.round(0.3 - 4 * F.avg(d), 8).alias("operating_margin"), F.round(0.2 - 3 * F.avg(t), 8).alias("net_margin"), F.round(F.avg(q) / 100, 8).alias("gross_margin"),
        F.round(4 * F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 8).alias("z"), F.round(F.avg(t) - 0.04, 8).alias("net_dilution"), F.round(2 * F.avg(q), 8).alias("health_score"), (F.count("*") % 10).cast("int").alias("piotroski"),
    )
    g = g.withColumn("ticker", F.concat(F.lit("S"), "cik")).withColumn("sector", F.concat(F.lit("sec"), F.pmod("cik", F.lit(5)))).withColumn("altman_z", F.when(F.pmod("cik", F.lit(5)) != 4, F.col("z"))).drop("z")
    g = g.withColumn("fiscal_year", F.expr("least(year(add_months(as_of_date, cast(-(3 + 3 * pmod(cik, 4)) as int))), if(pmod(cik, 11) = 0, 1998, 9999))"))
    g = g.withColumn("listed_until", F.expr("if(pmod(cik, 7) = 0, date_add(date'1999-06-30', cast(pmod(cik, 90) as int)), null)"))
    return g.where("listed_until is null or as_of_date <= listed_until").withColumn("is_listed_equity", F.lit(True)).withColumn("qi", F.expr("year(as_of_date) * 4 + quarter(as_of_date) - 1"))


def panel_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse, unbalanced panel: customers by quarter of the order date; one in twenty shares a ticker."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    as_of = F.last_day(F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3, F.lit(1)))
    g = o.groupBy(F.col("o_custkey").alias("cik"), as_of.alias("as_of_date")).agg(F.round(F.sum("o_totalprice"), 4).alias("revenue"), F.count("*").cast("int").alias("n_orders"))
    g = g.join(c.select(F.col("c_custkey").alias("cik"), F.col("c_mktsegment").alias("sector")), "cik")
    g = g.withColumn("ticker", F.expr("concat('T', cik - if(pmod(cik, 20) = 19, 1, 0))")).withColumn("fiscal_year", F.year(F.add_months("as_of_date", -6)))
    return g.withColumn("listed_until", F.lit(None).cast("date")).withColumn("is_listed_equity", F.lit(True)).withColumn("qi", F.expr("year(as_of_date) * 4 + quarter(as_of_date) - 1"))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ticker, day): a supplier's order days, one event a month: the first."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", F.trunc("day", "month").alias("m")).agg(F.min("day").alias("day"))
    e = e.select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), "day")
    return e.select(F.concat_ws("|", "ticker", "day").alias("event_id"), "ticker", "day")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of filings: an order's lines, the relative change discount less tax; every 13th accession is missing."""
    li = table(spark, sf_dir, "lineitem")
    acc = F.when(F.pmod("l_orderkey", F.lit(13)) != 0, F.concat(F.lit("acc-"), "l_orderkey"))
    return li.select(acc.alias("changedAccession"), F.to_date("l_shipdate").alias("changedFiled"), F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("relDelta"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("conceptGroup"))


def share_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, fiscal_year, outstanding, diluted): parts by ship year. Every 6th part splits 4 for 1
    in 1999: the outstanding count steps then, the diluted one two years before."""
    li = table(spark, sf_dir, "lineitem")
    y = F.year("l_shipdate")
    g = li.groupBy(F.col("l_partkey").alias("cik"), y.alias("fiscal_year")).agg((F.count("*") % 7).cast("long").alias("n"))
    base = 1000 + F.col("n")
    split = F.pmod("cik", F.lit(6)) == 0
    out = F.when(split & (F.col("fiscal_year") >= 1999), base * 4).otherwise(base)
    dil = F.when(split & (F.col("fiscal_year") >= 1997), base * 4 + 3).otherwise(base + 3)
    return g.select("cik", "fiscal_year", out.cast("double").alias("outstanding"), dil.cast("double").alias("diluted"))


def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incomplete vendor has of the bars: nothing of every fifth supplier."""
    return bars(spark, sf_dir).where(F.pmod(F.substring("ticker", 2, 12).cast("long"), F.lit(5)) != 3)


def sparse_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market series that starts late and is quoted on some days only."""
    return bench(spark, sf_dir).where("date >= '1995-06-01' and day(date) % 3 = 0")


def listed_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, cik) that a later registrant list still knows."""
    return panel_c(spark, sf_dir).where("as_of_date >= '1999-01-01' and pmod(cik, 3) <> 0").select("ticker", "cik")


def insider_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, code, day): open-market purchases (P), sales (S) and other entries (M) of a part's lines."""
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cik"), code.alias("code"), F.to_date("l_shipdate").alias("day"))


def annual_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, fiscal_year, rev): parts by ship year."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cik"), F.year("l_shipdate").alias("fiscal_year")).agg(F.round(F.sum("l_extendedprice"), 4).alias("rev"))


SQL = {
    "vendor_bars": "vendor_bars as (select * from bars where substr(ticker, 2)::bigint % 5 <> 3)",
    "sparse_bench": "sparse_bench as (select * from bench where date >= date '1995-06-01' and day(date) % 3 = 0)",
    "listed_holders": "listed_holders as (select ticker, cik from panel_c where as_of_date >= date '1999-01-01' and cik % 3 <> 0)",
    "insider_trades": "insider_trades as (select l_partkey as cik, case l_returnflag when 'A' then 'P' when 'R' then 'S' else 'M' end as code, l_shipdate::date as day from lineitem)",
    "annual_revenue": "annual_revenue as (select l_partkey as cik, year(l_shipdate)::int as fiscal_year, round(sum(l_extendedprice), 4) as rev from lineitem group by 1, 2)",
    "bars": "bars as (select 'S' || l_suppkey as ticker, l_shipdate::date as date, round(avg(l_extendedprice / l_quantity), 8) as close, sum(l_quantity)::bigint as volume from lineitem group by 1, 2)",
    "bench": "bench as (select l_shipdate::date as date, round(avg(l_extendedprice / l_quantity), 8) as close from lineitem group by 1)",
    "panel_s": """ps0 as (select l_suppkey as cik, last_day(make_date(year(l_shipdate)::int, quarter(l_shipdate)::int * 3, 1)) as as_of_date, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue,
 round(0.3 - 4 * avg(l_discount), 8) as operating_margin, round(0.2 - 3 * avg(l_tax), 8) as net_margin, round(avg(l_quantity) / 100, 8) as gross_margin, round(4 * avg(case when l_returnflag = 'R' then 1.0::double else 0.0::double end), 8) as z,
 round(avg(l_tax) - 0.04, 8) as net_dilution, round(2 * avg(l_quantity), 8) as health_score, (count(*) % 10)::int as piotroski from lineitem group by 1, 2),
 ps1 as (select * exclude (z), 'S' || cik as ticker, 'sec' || (cik % 5) as sector, case when cik % 5 <> 4 then z end as altman_z,
 least(year((as_of_date - to_months((3 + 3 * (cik % 4))::int))::date), case when cik % 11 = 0 then 1998 else 9999 end)::int as fiscal_year,
 case when cik % 7 = 0 then date '1999-06-30' + (cik % 90)::int end as listed_until, true as is_listed_equity, (year(as_of_date) * 4 + quarter(as_of_date) - 1)::int as qi from ps0),
 panel_s as (select * from ps1 where listed_until is null or as_of_date <= listed_until)""",
    "panel_c": """pc0 as (select o_custkey as cik, last_day(make_date(year(o_orderdate)::int, quarter(o_orderdate)::int * 3, 1)) as as_of_date, round(sum(o_totalprice), 4) as revenue, count(*)::int as n_orders from orders group by 1, 2),
 panel_c as (select pc0.*, c_mktsegment as sector, 'T' || (cik - case when cik % 20 = 19 then 1 else 0 end) as ticker, year((as_of_date - to_months(6))::date)::int as fiscal_year, null::date as listed_until, true as is_listed_equity,
 (year(as_of_date) * 4 + quarter(as_of_date) - 1)::int as qi from pc0 join customer on c_custkey = cik)""",
    "event_days": "ev0 as (select 'S' || l_suppkey as ticker, date_trunc('month', o_orderdate) as m, min(o_orderdate::date) as day from lineitem join orders on l_orderkey = o_orderkey group by 1, 2), event_days as (select ticker || '|' || day as event_id, ticker, day from ev0)",
    "revisions": "revisions as (select case when l_orderkey % 13 <> 0 then 'acc-' || l_orderkey end as accession, l_shipdate::date as filed, 'S' || l_suppkey as ticker, round(l_discount - l_tax, 4) as rel, 'c' || l_linenumber as concept from lineitem)",
    "share_series": """ss0 as (select l_partkey as cik, year(l_shipdate)::int as fiscal_year, 1000 + count(*) % 7 as base from lineitem group by 1, 2),
 shares as (select cik, fiscal_year, (case when cik % 6 = 0 and fiscal_year >= 1999 then base * 4 else base end)::double as outstanding, (case when cik % 6 = 0 and fiscal_year >= 1997 then base * 4 + 3 else base + 3 end)::double as diluted from ss0)""",
}


def with_views(*names: str) -> str:
    """The opening WITH of an oracle query over the named views."""
    return "with " + ", ".join(SQL[n] for n in names)
