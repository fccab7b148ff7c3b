"""Mixing sources to target weights by hash-seeded Poisson replication (native).

Each row's repetition count is the quantile of a Poisson distribution at a
uniform number drawn from a hash of the seed and the row's id. The mean of the
distribution is the row's source's target repetition rate, so that the expected
size of each source is its target share, and a rerun, a lost executor or another
number of partitions changes nothing. The copies are dealt out by a second hash.

Defined cases: a null and an empty source are one source; a null id hashes as
the empty string; rows with equal ids get equal counts; an empty table gives an
empty result; a source absent from ``weights`` has weight 0; columns that are
named like the added ones (``replica``, ``shuffle_key``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.scratch import cut

#: The uniform number has this many hexadecimal digits of the hash (52 bits).
HEX_DIGITS = 13


def _uniform(seed: str, *cols):
    text = F.concat_ws(":", F.lit(seed), *cols)
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def _key(seed: str, *cols):
    return F.md5(F.concat_ws(":", F.lit(seed), *cols))


def target_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None,
                 alpha: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """Mean repetitions of each source: (stratum, n, rate).

    ``weights`` gives each source's share of the mixture; without it shares are
    proportional to the source's row count to the power ``alpha``. The mixture
    has ``epochs`` times the input's rows in expectation.
    """
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("stratum")).agg(F.count("*").alias("n"))
    if weights is None:
        raw = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        raw = counts.withColumn("w", F.coalesce(F.try_element_at(table, F.col("stratum")), F.lit(0.0)))
    totals = raw.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    return (raw.crossJoin(totals)  # one row of totals
            .select("stratum", "n", F.coalesce(F.try_divide(F.lit(float(epochs)) * F.col("tn") * F.col("w"), F.col("tw") * F.col("n")), F.lit(0.0)).alias("rate")))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(stratum, cdf): cumulative probabilities of 0, 1, ... until the rest is below 2**-52."""
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    by_k = Window.partitionBy("stratum").orderBy("k")
    terms = (rates.where("rate > 0").select("stratum", "rate", F.explode(F.sequence(F.lit(0), most)).alias("k"))
             .withColumn("log_fact", F.sum(F.when(F.col("k") > 0, F.ln(F.greatest("k", F.lit(1)).cast("double"))).otherwise(0.0)).over(by_k))
             .withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_fact")))
             .withColumn("cdf", F.sum("p").over(by_k)))
    lists = terms.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("t"))
    return lists.select("stratum", F.col("t.cdf").alias("cdf"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None,
        alpha: float = 0.7, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global random order.

    Adds ``replica`` (from 0) and ``shuffle_key``; rows are dealt to partitions
    by the key and sorted by it there, which is a random permutation of the whole.
    The table of the sources' distributions is joined after it is written, so
    Spark broadcasts it only when its files are small, and shuffles otherwise.
    """
    rows = docs.drop("replica", "shuffle_key")
    table = cut(poisson_tables(target_rates(rows, source, weights, alpha, epochs)), "mix").select(F.col("stratum").alias("__stratum"), F.col("cdf").alias("__cdf"))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    counted = (rows.withColumn("__s", F.coalesce(F.col(source).cast("string"), F.lit("")))
               .join(table, F.col("__s") == F.col("__stratum"))
               .withColumn("__u", _uniform(seed, name))
               .withColumn("__n", F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))))
               .where("__n > 0")
               .drop("__s", "__stratum", "__cdf", "__u"))
    copies = counted.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    keyed = copies.withColumn("shuffle_key", _key(seed + "-order", name, F.col("replica").cast("string")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = f"""
WITH counts AS (SELECT coalesce(source, '') AS stratum, count(*) AS n FROM documents GROUP BY 1),
raw AS (SELECT stratum, n, pow(n::DOUBLE, 0.7) AS w FROM counts),
rates AS (SELECT stratum, (SELECT sum(n)::DOUBLE FROM raw) * w / ((SELECT sum(w) FROM raw) * n) AS rate FROM raw),
ks AS (SELECT stratum, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates),
facts AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(greatest(k, 1)::DOUBLE) ELSE 0.0 END) OVER (PARTITION BY stratum ORDER BY k) AS lf FROM ks),
cdfs AS (SELECT stratum, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY stratum ORDER BY k) AS c FROM facts),
tabs AS (SELECT stratum, list(c ORDER BY k) AS cdf FROM cdfs GROUP BY 1),
us AS (SELECT *, ('0x' || substr(md5('mix:' || doc_id), 1, {HEX_DIGITS}))::BIGINT / {float(16**HEX_DIGITS)} AS u FROM documents),
ns AS (SELECT us.*, len(list_filter(cdf, lambda c: c <= u)) AS m FROM us JOIN tabs ON coalesce(us.source, '') = tabs.stratum),
xs AS (SELECT *, unnest(range(0, m)) AS r FROM ns WHERE m > 0)
SELECT doc_id, text, lang, source, n_chars, r::INT AS replica, md5('mix-order:' || doc_id || ':' || r) AS shuffle_key FROM xs
"""
