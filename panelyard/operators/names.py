"""Joining two datasets on company names alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import RULES, core, rule, rule_keys, usable


def blocks(names: DataFrame, col: str, alias: bool, extra_stopwords=()) -> DataFrame:
    """(col, block): the distinct cores of a column with their keys. Words rank by how many of the cores have them."""
    cores = names.select(col).distinct()
    if alias:
        return cores.withColumn("block", F.explode(rule_keys(F.col(col), True, F.lit(None).cast("string"), extra_stopwords)))
    words = cores.withColumn("_word", F.explode(F.array_distinct(F.split(col, " "))))
    common = words.groupBy("_word").agg(F.count("*").alias("_cores"))
    rarest = words.join(common.hint("merge"), "_word").groupBy(col).agg(F.min(F.struct("_cores", "_word")).alias("_rarest"))
    return rarest.select(col, F.explode(rule_keys(F.col(col), False, F.col("_rarest._word"), extra_stopwords)).alias("block"))


def match_all(aliases: DataFrame, candidates: DataFrame, extra_stopwords=()) -> DataFrame:
    """aliases (key, alias) and candidates (candidate) -> all pairs (key, alias, alias_core,
    candidate, candidate_core, rule, ambiguous), the best rule per key and candidate core,
    expanded to every spelling of the core. `ambiguous`: more than one key claims the candidate.

    Cores meet by an equi-join on keys that the rules themselves imply (see rule_keys), so that the
    pairs are those of comparing everything and hardly more than those are looked at; names of common words only meet on their rarest one. A core that
    many spellings share meets once.

    All joins merge sorted shuffles: Spark's size check goes by the files, which hold neither cores nor keys, and would
    have the driver build a broadcast of all names."""
    a = aliases.select("key", "alias", core(F.col("alias")).alias("alias_core")).where(usable(F.col("alias_core"), extra_stopwords))
    c = candidates.select("candidate", core(F.col("candidate")).alias("candidate_core")).where(usable(F.col("candidate_core"), extra_stopwords))
    left, right = blocks(a, "alias_core", True, extra_stopwords), blocks(c, "candidate_core", False, extra_stopwords)
    near = left.join(right.hint("merge"), "block").select("alias_core", "candidate_core").distinct()
    near = near.withColumn("rule", rule(F.col("alias_core"), F.col("candidate_core"), extra_stopwords)).where("rule is not null").join(a.hint("merge"), "alias_core")
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    best = near.groupBy("key", "candidate_core").agg(F.min(F.struct(order.alias("o"), "alias", "alias_core", "rule")).alias("b"))
    pairs = best.join(c.hint("merge"), "candidate_core").select("key", "b.alias", "b.alias_core", "candidate", "candidate_core", "b.rule")
    owners = pairs.groupBy("candidate").agg((F.min("key") != F.max("key")).alias("ambiguous"))
    return pairs.join(owners.hint("merge"), "candidate").select("key", "alias", "alias_core", "candidate", "candidate_core", "rule", "ambiguous")


def match(aliases: DataFrame, candidates: DataFrame, extra_stopwords=()) -> DataFrame:
    """match_all without candidates that several keys claim."""
    return match_all(aliases, candidates, extra_stopwords).where("not ambiguous").drop("ambiguous")


def diagnostics(aliases: DataFrame, candidates: DataFrame, extra_stopwords=()) -> DataFrame:
    """One row of what a study has to state about the match."""
    pairs = match_all(aliases, candidates, extra_stopwords)
    keys = aliases.groupBy("key").agg(F.max(usable(core(F.col("alias")), extra_stopwords)).alias("can"))
    a = keys.agg(F.count("*").alias("keys_with_aliases"), F.count_if(~F.col("can")).alias("keys_unmatchable_by_name"))
    c = candidates.select(core(F.col("candidate")).alias("c")).agg(F.count("*").alias("candidate_names_in"), F.count_distinct(F.when(usable(F.col("c"), extra_stopwords), F.col("c"))).alias("candidate_cores_usable"))
    p = pairs.agg(
        F.count("*").alias("raw_pairs"), F.count_distinct(F.when(F.col("ambiguous"), F.col("candidate"))).alias("ambiguous_candidate_names"), F.count_if(F.col("ambiguous")).alias("pairs_dropped"),
        F.count_distinct(F.when(~F.col("ambiguous"), F.col("key"))).alias("keys_matched"), *(F.count_if(~F.col("ambiguous") & (F.col("rule") == r)).alias(f"by_{r.lower()}") for r in RULES),
    )
    return a.crossJoin(c).crossJoin(p)  # one row each


def lookup_outcome(asked: DataFrame, holders: DataFrame) -> DataFrame:
    """asked (cik, ticker) against holders (ticker, cik): the company asked for, a different one, or nothing."""
    held = holders.groupBy(F.upper("ticker").alias("_t")).agg(F.collect_set("cik").alias("_c"))
    outcome = F.when(F.col("_c").isNull(), "nothing").when(F.array_contains("_c", F.col("cik")), "asked for").otherwise("different company")
    return asked.join(held, F.upper("ticker") == F.col("_t"), "left").withColumn("outcome", outcome).drop("_t", "_c")


def landing(asked: DataFrame, panel: DataFrame) -> DataFrame:
    """asked (cik, ticker, returned_cik, last_row): the returned company's span under the same
    ticker against the asked firm's last row: later, earlier or overlapping, absent; and the gap in days."""
    spans = panel.groupBy("ticker", F.col("cik").alias("returned_cik")).agg(F.min("as_of_date").alias("first_seen"), F.max("as_of_date").alias("last_seen"))
    out = asked.join(spans, ["ticker", "returned_cik"], "left")
    where = F.when(F.col("first_seen").isNull(), "absent").when(F.col("first_seen") > F.col("last_row"), "later").otherwise("earlier or overlapping")
    return out.withColumn("landing", where).withColumn("gap_days", F.datediff("first_seen", "last_row"))


def first_claims(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
