"""Readers and writers for plain files, and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandex.functions.symbols import random_weight, symbols
from strandex.operators.lineage import written


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each file is one text, without one trailing newline. doc_id is the file's rank by name.

    Inner newlines and carriage returns are ordinary symbols. Only the (path, row) list is ordered, not the texts.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\n\z", "").alias("text"))
    names = raw.select("file").distinct().withColumn("doc_id", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    return raw.join(names, "file").select("doc_id", "text")


def read_spans(spark: SparkSession, path: str, span: int = 1 << 16, overlap: int = 64, sep: str = "\n") -> DataFrame:
    """(doc_id, span_start, span_own, text): one text file of any size in spans of `span` symbols and `overlap` more.

    The file is read in parallel by ranges of bytes and cut at `sep`, any string that is frequent in it; what lies
    between two of them has to fit in a row, the text doesn't. Pieces are put in place by the byte at which their range
    begins and their order there. One row for each range is ordered in one task; all else goes by span. A trailing
    newline is dropped.
    """
    raw = spark.read.text(path, lineSep=sep).select(F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("row"), F.col("value"))
    raw = written(raw.withColumn("n", F.length("value") + len(sep)), "pieces")  # numbers of rows stay as they are
    inner = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = raw.groupBy("block").agg(F.sum("n").alias("t")).select("block", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("b"))
    at = raw.withColumn("i", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(before, "block").select((F.col("b") + F.col("i")).alias("at"), "value", "n")
    # The reader drops the last separator whether it is there or not: the length in bytes tells.
    total = raw.agg(F.sum("n").alias("n"), F.sum(F.octet_length("value") + len(sep.encode())).alias("u"), F.max("bytes").alias("bytes"), F.max_by(F.col("value").endswith("\n"), F.struct("block", "row")).alias("newline")).first()
    if total["n"] is None:
        return spark.createDataFrame([], "doc_id long, span_start long, span_own int, text string")
    added = total["u"] > total["bytes"]
    end = total["n"] - len(sep) * (added or sep == "\n") - (added and total["newline"])
    piece = F.concat("value", F.lit(sep))
    first, last = F.greatest(F.lit(0), F.floor((F.col("at") - overlap) / span)), F.floor((F.col("at") + F.col("n") - 1) / span)
    cut = at.withColumn("s", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    low, high = F.greatest(F.col("at"), F.col("s") * span), F.least(F.col("at") + F.col("n"), (F.col("s") + 1) * span + overlap, F.lit(end))
    parts = cut.withColumn("low", low).withColumn("part", F.substring(piece, (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))).where("part <> ''")
    spans = parts.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("ps"))
    own = F.least(F.lit(span), F.lit(end) - F.col("s") * span)
    return spans.where(own > 0).select(F.lit(0).cast("long").alias("doc_id"), (F.col("s") * span).cast("long").alias("span_start"), own.cast("int").alias("span_own"), F.array_join("ps.part", "").alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """As read_text, with a byte as the symbol: each byte is the character of its number."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("t"))
    names = raw.select("path").distinct().withColumn("doc_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    return raw.join(names, "path").select("doc_id", F.regexp_replace("t", r"\n\z", "").alias("text"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, weights): the numbers of each file up to the first token that is not one."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v"))
    names = raw.select("file").distinct().withColumn("doc_id", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    numbers = F.transform("v", lambda x: x.try_cast("double"))
    got = raw.join(names, "file").select("doc_id", numbers.alias("w"))
    stop = F.array_position(F.transform("w", lambda x: x.isNull()), True)
    return got.select("doc_id", F.when(stop > 0, F.slice("w", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("w")).alias("weights"))


def with_weights(corpus: DataFrame, weights: DataFrame) -> DataFrame:
    """`corpus` with its array of weights; it is an error if a text has not exactly one weight for each symbol."""
    joined = corpus.join(weights, "doc_id", "left")
    same = F.coalesce(F.size("weights"), F.lit(0)) == F.length("text")
    return joined.withColumn("weights", F.when(same, F.col("weights")).otherwise(F.raise_error(F.concat(F.lit("the number of weights differs from the length of document "), F.col("doc_id").cast("string")))))


def weight_rows(corpus: DataFrame, seed: int = 12345) -> DataFrame:
    """(doc_id, pos, ch, w): random weights for every symbol."""
    rows = corpus.select("doc_id", F.posexplode(symbols(F.col("text"))).alias("pos", "ch")).withColumn("pos", F.col("pos").cast("long"))
    return rows.withColumn("w", random_weight(F.col("doc_id"), F.col("pos"), seed))


def read_patterns(spark: SparkSession, path: str, to_first_empty: bool = True, drop_unended: bool = False) -> DataFrame:
    """(query_id, pattern) of one file in line order; duplicates stay.

    `to_first_empty` ends the list at the first empty line, as the format says; `drop_unended` leaves out a last line
    that has no newline. A pattern file is one ordered list, which is why it is numbered in one place.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("ls"))
    rows = whole.select(F.posexplode("ls").alias("query_id", "pattern"), F.size("ls").alias("n")).withColumn("query_id", F.col("query_id").cast("long"))
    if drop_unended:
        rows = rows.where("query_id < n - 1")
    if to_first_empty:
        rows = rows.withColumn("e", F.sum(F.when(F.col("pattern") == "", 1).otherwise(0)).over(Window.orderBy("query_id"))).where("e = 0")
    return rows.where("pattern <> ''").select("query_id", "pattern")


def random_patterns(corpus: DataFrame, count: int, shortest: int, longest: int, seed: int = 12345) -> DataFrame:
    """(query_id, doc_id, pos, pattern): substrings at hashed starts with hashed lengths, `count` over texts in turn.

    Starts leave room for the longest pattern where the text has it. Empty texts give none.
    """
    texts = corpus.where("length(text) > 0").select("doc_id", "text")
    # Ids are numbered in parts of their order; only the parts' sizes are summed in one place.
    ids = written(texts.select("doc_id").orderBy("doc_id").select("doc_id", F.monotonically_increasing_id().alias("at")), "ids")
    ids = ids.select("doc_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = ids.groupBy("part").agg(F.count("*").alias("size"))
    n = sizes.agg(F.sum("size")).first()[0]
    if not n:
        return corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, pos long, pattern string")
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ids.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("doc_id", (F.col("before") + F.col("at")).alias("k"))
    mixed = lambda a: (F.col("query_id") * a + F.lit(seed)) % 1000003
    rows = corpus.sparkSession.range(count).withColumnRenamed("id", "query_id").withColumn("k", F.col("query_id") % n)
    got = rows.join(ids, "k").join(texts, "doc_id")
    got = got.withColumn("pos", (mixed(7919) * mixed(104729)) % F.greatest(F.lit(1), F.length("text") - longest + 1)).withColumn("len", (mixed(15485863) % (longest - shortest + 1) + shortest).cast("int"))
    return got.select("query_id", "doc_id", "pos", F.expr("substring(text, cast(pos + 1 as int), len)").alias("pattern")).where("pattern <> ''")


def write_topk(topk: DataFrame, path: str) -> None:
    """One substring per line, best first."""
    topk.orderBy("rank").select("substr").coalesce(1).write.mode("overwrite").text(path)


def write_frequencies(grams: DataFrame, path: str) -> None:
    """`substr freq` lines."""
    grams.select(F.concat_ws(" ", "substr", F.col("freq").cast("string"))).write.mode("overwrite").text(path)
