"""Line dedup by overlapping three-line windows [native].

The non-blank lines of a text, trimmed, are its line sequence. Every three consecutive ones are a window, keyed by
128 bits of hash. The first occurrence of a window in the corpus, by (doc_id, text hash, position), stays; every other
one goes, and a line goes when a window that goes covers it. Blank lines stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .base import BLANKS, written

WINDOW = 3


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def removals(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text hash, sorted 0-based indexes of the non-blank lines to remove), for texts that lose a line.

    The smallest occurrence of each window is a grouped minimum, combined before the shuffle; windows that occur once
    end there. What joins back is a key and a position, so that a window in a third of all texts is a join partition
    that adaptive execution may split; no list of a window's occurrences is ever built.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _trimmed), lambda x: x != "")
    own = docs.select("doc_id", F.xxhash64(text).alias("th"), lines.alias("ls")).where(F.size("ls") >= WINDOW)
    keyed = F.transform(
        F.sequence(F.lit(0), F.size("ls") - WINDOW),
        lambda i: F.struct(F.xxhash64(*(F.get("ls", i + k) for k in range(WINDOW))).alias("h1"), F.xxhash64(F.lit(7), *(F.get("ls", i + k) for k in reversed(range(WINDOW)))).alias("h2"), i.alias("pos")),
    )
    wins = written(own.select("doc_id", "th", F.explode(keyed).alias("w")).select("doc_id", "th", "w.*"), "windows")
    first = wins.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first")).where("n > 1").drop("n")
    later = wins.join(first, ["h1", "h2"]).where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    # Positions of one text meet in one row: as many as the text has lines.
    return later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("starts")).select("doc_id", "th", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (WINDOW - 1)))))).alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the lines of later occurrences taken out, and `n_lines_removed`.

    A text without removals is returned unchanged, null and empty ones included; one that loses every line becomes
    empty. Rows with one doc_id and the same text count as one text and get the same result. A column n_lines_removed
    of `docs` is replaced; names that begin with two underscores and "sx" are reserved. Null ids come before all others, and
    ties of one id go by the text's hash. A text of any length is one row of its task; an empty table gives an empty one.
    """
    gone = removals(docs, text).select(F.col("doc_id").alias("__sx_id"), F.col("th").alias("__sx_th"), F.col("gone").alias("__sx_gone"))
    base = docs.drop("n_lines_removed")
    hit = F.col("__sx_gone").isNotNull()
    one = base.join(gone, F.col("doc_id").eqNullSafe(F.col("__sx_id")) & (F.xxhash64(text) == F.col("__sx_th")), "left")
    two = one.withColumn("__sx_raw", F.when(hit, F.split(F.col(text), "\n")))
    full = F.transform("__sx_raw", lambda x, i: F.when(_trimmed(x) != "", i))
    three = two.withColumn("__sx_full", F.when(hit, F.filter(full, lambda i: i.isNotNull())))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__sx_raw") - 1), F.transform("__sx_gone", lambda g: F.get("__sx_full", g)))
    left = F.array_join(F.transform(stay, lambda i: F.get("__sx_raw", i)), "\n")
    out = three.withColumn("n_lines_removed", F.when(hit, F.size("__sx_gone")).otherwise(0).cast("long")).withColumn(text, F.when(hit, left).otherwise(F.col(text)))
    return out.select(*base.columns, "n_lines_removed")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All `documents` without repeated three-line windows. Awkward rows: see dedup_lines."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, i, ls[i + 1] AS line, trim(ls[i + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM raw)),
num AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM line WHERE t <> ''),
win AS (SELECT doc_id, pos, t AS a, lead(t) OVER w AS b, lead(t, 2) OVER w AS c FROM num WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
occ AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM win WHERE b IS NOT NULL AND c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM occ, range(3) AS r(d) WHERE k > 1),
dead AS (SELECT num.doc_id, num.i FROM num JOIN gone ON num.doc_id = gone.doc_id AND num.pos = gone.pos),
lost AS (SELECT doc_id, count(*) AS n FROM dead GROUP BY doc_id),
left_over AS (SELECT line.doc_id, string_agg(line.line, chr(10) ORDER BY line.i) AS text FROM line LEFT JOIN dead ON line.doc_id = dead.doc_id AND line.i = dead.i
  WHERE dead.i IS NULL GROUP BY line.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines_removed, length(coalesce(o.text, ''))::BIGINT AS n_chars_left, sha256(coalesce(o.text, '')) AS text_sha256
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id
"""
