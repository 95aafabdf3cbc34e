"""Operator 1: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Shelf, draw, fresh

# Rates of at most this many sources are broadcast; more are joined with the documents spread over SALTS keys each.
BROADCAST_SOURCES = 100_000
SALTS = 64


def rates(docs: DataFrame, weights: dict | None = None, rows: float | None = None, power: float = 0.5, by: str = "source") -> DataFrame:
    """One row per source: its documents, its target share and its mean repetition rate.

    The share of a source is its entry in ``weights`` (0 if it has none), or without weights its document count to
    the ``power``; shares are normalised over the sources that exist. rate = share * rows / documents, with ``rows``
    the wanted size of the mixture (the input's by default). A null source is a source like any other.
    """
    counts = docs.groupBy(F.col(by).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n").cast("double") if rows is None else F.lit(float(rows))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(F.lit(0.0))
    return counts.crossJoin(total).select("src", "n", share.alias("share"), (share * wanted / F.col("n")).alias("rate"))


def with_distribution(rate_rows: DataFrame) -> DataFrame:
    """Adds ``cdf``: the Poisson distribution function of the rate at 0, 1, 2, ... far into the tail."""
    rate = F.col("rate")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        logp = acc["logp"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(logp.alias("logp"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(logp))).alias("cdf"))

    grown = F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]
    return rate_rows.withColumn("cdf", F.when(rate > 0, grown).otherwise(F.array(F.lit(1.0))))


def mix(docs: DataFrame, weights: dict | None = None, rows: float | None = None, power: float = 0.5, seed: int = 1, by: str = "source", key: str = "doc_id") -> DataFrame:
    """Repeat every document a Poisson number of times whose mean is its source's rate, and shuffle globally.

    The count inverts the Poisson distribution at a uniform hash of (seed, key), so a retried task repeats its
    choice. Returns the input's columns, ``copy`` (int from 0) and ``shuffle_key`` (uniform double); rows are dealt
    to partitions by shuffle_key and ordered by it within them, which is a random order of the whole mixture.
    Rows with equal keys get equal counts; a null key hashes as 'null'; texts are not looked at. Input columns named
    copy or shuffle_key are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy", "shuffle_key")
    shelf = Shelf(spark)
    table = shelf.put(with_distribution(rates(docs, weights, rows, power, by)).select("src", "cdf"), "rates")
    columns = docs.columns
    src, cdf, u, n, salt, salt2 = fresh(columns, "__src", "__cdf", "__u", "__n", "__salt", "__salt2")
    count = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
    table = table.select(F.col("src").alias(src), F.col("cdf").alias(cdf))
    docs = docs.withColumn(u, draw(f"{seed}-count", key))
    if table.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), docs[by].eqNullSafe(table[src]))
    else:
        docs = docs.withColumn(salt, F.floor(draw(f"{seed}-salt", key) * SALTS))
        table = table.withColumn(salt2, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(table, docs[by].eqNullSafe(table[src]) & (F.col(salt) == F.col(salt2)))
    copies = joined.withColumn(n, count).filter(F.col(n) > 0).select(*columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    copies = copies.withColumn("shuffle_key", draw(f"{seed}-order", key, "copy"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", key)


def mix_sql(docs: str, columns: list[str], power: float = 0.5, seed: int = 1) -> str:
    """DuckDB SQL of ``mix`` with default weights over the table or subquery ``docs``."""
    u = "(('0x' || substr(md5('{s}:' || {k}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    key = "coalesce(d.doc_id::VARCHAR, 'null')"
    return f"""
    WITH RECURSIVE docs AS ({docs}),
    counts AS (SELECT source AS src, count(*) AS n, pow(count(*)::DOUBLE, {power}::DOUBLE) AS weight FROM docs GROUP BY 1),
    rates AS (SELECT src, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts),
    cdf(src, rate, k, logp, cum) AS (
      SELECT src, rate, 0, -rate, exp(-rate) FROM rates
      UNION ALL
      SELECT src, rate, k + 1, logp + ln(rate) - ln((k + 1)::DOUBLE), cum + exp(logp + ln(rate) - ln((k + 1)::DOUBLE)) FROM cdf
      WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
    arrays AS (SELECT src, list(cum ORDER BY k) AS cum FROM cdf GROUP BY src),
    counted AS (
      SELECT d.*, len(list_filter(a.cum, lambda c: c <= {u.format(s=f'{seed}-count', k=key)})) AS n_copies
      FROM docs d JOIN arrays a ON d.source IS NOT DISTINCT FROM a.src),
    copies AS (SELECT d.*, unnest(range(n_copies))::INTEGER AS "copy" FROM counted d)
    SELECT {', '.join(columns)}, "copy", {u.format(s=f'{seed}-order', k=key + " || ':' || d.copy")} AS shuffle_key FROM copies d
    """
