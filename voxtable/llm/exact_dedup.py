"""Exact duplicates with a heavy-hitter split (native).

Texts are equal when their SHA-256 digests agree after every ASCII white space
character is deleted. Digests that may have more than a share SUPPORT of all rows
are found by a Misra-Gries summary with 1 / SUPPORT counters for each task
(Spark's ``freqItems``, in the form of Karp, Shenker and Papadimitriou), so there are
at most that many. The summary misses none and may name others: the named
digests' exact sizes and winners are aggregated, in part before the shuffle, and
broadcast, and their rows are decided where they are read, without a shuffle.
All other digests have at most that share of the rows and are shuffled as usual:
sizes and winners are aggregated in part by digest and joined back to the rows,
so that no group is ever gathered.

Of equal texts, the row with the most code points in the original text stays;
among those the smallest id, a null id last; among rows that agree in both, one.

Defined cases: a null text is empty; texts without any other character are one
group; repeated rows and rows of equal or null ids are rows of their own, each
counted and exactly one of a group kept; an empty table gives an empty result;
other columns are not read by :func:`groups`, and :func:`keep_one` returns them
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.scratch import cut

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
#: Share of all rows above which a digest counts as heavy for certain; at most 1 / SUPPORT digests are broadcast, about 120 KB.
SUPPORT = 0.001
ROW = "__row"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, "")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, text_sha256) and ROW, if ``docs`` has it: a narrow row for each document, no shuffle."""
    length = F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), length.alias("n_chars"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"), *[c for c in docs.columns if c == ROW])


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(heavy): at most 1 / ``support`` digests, among them each with more than that share of the rows."""
    return rows.select(F.col("text_sha256").alias("heavy")).stat.freqItems(["heavy"], support).select(F.explode("heavy_freqItems").alias("heavy"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, group_size, best) of each digest; the row that stays is the least of (-n_chars, no id, id, ROW)."""
    order = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    return rows.groupBy(F.col("text_sha256").alias("digest")).agg(F.count("*").alias("group_size"), F.min(order).alias("best"))


def decided(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``rows`` with keep_id, group_size and kept."""
    heavy = cut(frequent(rows, support), "frequent")
    # At most 1 / support digests, whose winners are exact.
    few = F.broadcast(heavy.select("heavy"))
    best = cut(winners(rows.join(few, F.col("text_sha256") == F.col("heavy"), "left_semi")), "heavy")
    split = rows.join(F.broadcast(best), F.col("text_sha256") == F.col("digest"), "left")
    rest = rows.join(few, F.col("text_sha256") == F.col("heavy"), "left_anti")
    light = rest.join(winners(rest), F.col("text_sha256") == F.col("digest"))
    return split.where("digest IS NOT NULL").unionByName(light).select(*rows.columns, F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col(ROW)).alias("kept"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``, dropped ones too."""
    rows = cut(digests(docs, doc_id, text).withColumn(ROW, F.monotonically_increasing_id()), "digests")
    return decided(rows, support).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    whole = cut(docs.select("*", F.monotonically_increasing_id().alias(ROW)), "rows")
    rows = cut(digests(whole, doc_id, text), "digests")
    return whole.join(decided(rows, support).where("kept").select(F.col(ROW).alias("__kept")), F.col(ROW) == F.col("__kept"), "left_semi").select(*docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, length(t) AS n, sha256(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM t),
r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
