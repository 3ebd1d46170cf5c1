"""Explicit schemas."""

from pyspark.sql import types as T

METRICS = (
    "revenue net_margin gross_margin operating_margin debt_to_ebitda net_debt_to_ebitda rnd_intensity dso dio capex_intensity buyback_intensity net_dilution piotroski "
    "interest_coverage dpo ccc altman_z fcf_margin fcf_conversion asset_growth accruals_ratio m_score_5 gp_to_assets"
).split()

#: The panel as it lies in CSV: keys, dates and flags as text, normalised after reading.
PANEL_CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("as_of_date", "ticker", "cik", "sector", "fiscal_year")] + [T.StructField(c, T.DoubleType()) for c in METRICS] + [T.StructField(c, T.StringType()) for c in ("is_listed_equity", "listed_until", "listing_end_source")])

HISTORY = "cikNumber long, error string, years array<struct<fiscalYear:int,periodEnd:string,revenue:double,netIncome:double,sharesOutstanding:double,epsDiluted:double,weightedAverageSharesDiluted:double>>"
AS_OF = "cikNumber long, error string, values array<struct<conceptGroup:string,periodEnd:string,value:double,filedAt:string,accessionNumber:string>>"
INSIDER = "cikNumber long, error string, transactions array<struct<code:string,isDerivative:boolean,value:double,transactionDate:string>>"
REGISTRANTS = "map<string,struct<cik_str:long,ticker:string,title:string>>"
