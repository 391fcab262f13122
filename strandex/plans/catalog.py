"""The registered queries of the engine and their SQL.

`documents` is the corpus, `benchmark` the small one; a symbol's weight is the integer (code point % 7 + 14) * 5. The
query streams are the words of each conversation, in order of turn and word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandex.functions import fingerprint
from strandex.functions.symbols import gram_weight, symbol_weight, symbols
from strandex.operators import cache, extensions, grams, index, lineage, merging, metrics, prefix, sketch, suffixes, topk, utility
from strandex.sources import files

PATTERNS = ("the", "a", "ion", "zzzq", "e ", "tion", "the ", "er", "on the", "schein", "eau", "ción", "Licensed under", "and of", "xyz", "the", "é", "\n")
K = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d):
    return _table(spark, d, "documents")


def benchmark(spark, d):
    return _table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")


def patterns(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PATTERNS)), "query_id long, pattern string")


def streams(spark, d) -> DataFrame:
    """(stream_id, seq, pattern): a stream for each conversation, numbered by turn and place in it."""
    c = _table(spark, d, "conversations").where("length(text) > 0")
    ws = c.select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("i", "pattern")).where("pattern <> ''")
    return ws.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * (1 << 31) + F.col("i")).cast("long").alias("seq"), "pattern")


def char_alphabet(spark, d):
    return documents(spark, d).select(F.explode(symbols(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("freq"))


def weight_prefix_sums(spark, d):
    rows = benchmark(spark, d).select("doc_id", F.posexplode(symbols(F.col("text"))).alias("pos", "ch"))
    rows = rows.select(F.col("doc_id"), F.col("pos").cast("long").alias("pos"), symbol_weight(F.col("ch")).alias("w"))
    return prefix.prefix_sums(rows, 128).select(F.col("doc_id").alias("item_id"), "pos", "w", "ps")


def random_weights(spark, d):
    return files.weight_rows(benchmark(spark, d)).select(F.col("doc_id").alias("item_id"), "pos", "w")


def random_patterns(spark, d):
    return files.random_patterns(benchmark(spark, d), 500, 3, 12)


def pattern_utility(spark, d):
    return utility.answers(documents(spark, d), patterns(spark))


def utility_by_lang(spark, d):
    return utility.pattern_utility(documents(spark, d), patterns(spark), ("lang",))


def _weighted(b: DataFrame) -> DataFrame:
    w = files.weight_rows(b).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"].cast("double")).alias("weights"))
    return files.with_weights(b, w)


def utility_position_weights(spark, d):
    """Weights by position, not by symbol."""
    return utility.answers(_weighted(benchmark(spark, d)), patterns(spark), weights="weights", distinct_ids=True).withColumn("utility", F.col("utility").cast("long"))


def table_position_weights(spark, d):
    """The utility table of frequent substrings, with weights by position."""
    b = benchmark(spark, d)
    frequent = lineage.written(topk.expanded(topk.top_nodes(b, K, 12)).select(F.col("substr").alias("pattern")), "frequent")
    return utility.weighted_utility(_weighted(b), frequent, "weights").select(F.col("pattern").alias("substr"), F.col("occurrences").alias("freq"), F.col("utility").cast("long").alias("utility"))


def pattern_positions(spark, d):
    few = patterns(spark).where(F.col("pattern").isin("schein", "Licensed under", "ción", "on the"))
    return utility.matches(documents(spark, d), few).select("pattern", "doc_id", "pos")


def gram_counts(spark, d):
    return grams.counts(grams.grams(benchmark(spark, d), list(range(1, 7))))


def topk_exact(spark, d):
    return topk.exact(documents(spark, d), K, 6)


def topk_nodes(spark, d):
    return topk.top_nodes(benchmark(spark, d), K, 12)


def topk_summary(spark, d):
    return topk.summary(topk_nodes(spark, d))


def _utility_table(spark, d):
    g = topk.expanded(topk.top_nodes(documents(spark, d), K))
    return g.select("substr", "freq", (F.col("freq") * gram_weight(F.col("substr"))).alias("utility"))


def topk_utility_table(spark, d):
    return _utility_table(spark, d)


def topk_levelwise(spark, d):
    return topk.levelwise(documents(spark, d), K, 6)


def topk_levelwise_unbounded(spark, d):
    return topk.levelwise(benchmark(spark, d), 2000)


def topk_sampled(spark, d):
    return topk.sampled(benchmark(spark, d), K, 12, 4)


def topk_sampled_pruned(spark, d):
    return topk.sampled_pruned(benchmark(spark, d), K, 12, 4)


def topk_recall(spark, d):
    b = benchmark(spark, d)
    truth = topk.expanded(topk.top_nodes(b, K, 12))
    return topk.recall(truth, topk.sampled(b, K, 12, 4), K)


def topk_heavykeeper(spark, d):
    return sketch.heavy_keeper(documents(spark, d), K, None)


def topk_merged(spark, d):
    return merging.top(documents(spark, d), K, 6)


def topk_approx(spark, d):
    return sketch.approximate(documents(spark, d), K)


def table_answer(spark, d):
    table = lineage.written(_utility_table(spark, d), "table")
    return utility.table_answers(documents(spark, d), patterns(spark), table)


def _with_utility(rows: DataFrame) -> DataFrame:
    return rows.withColumn("utility", gram_weight(F.col("pattern")))


def cache_lru_replay(spark, d):
    return _with_utility(cache.lru_hits(streams(spark, d), 16))


def cache_lru_evictions(spark, d):
    return cache.replay(streams(spark, d), "lru", 16).where("evicted IS NOT NULL").groupBy("stream_id").agg(F.count("*").alias("evictions"))


def cache_lfu_replay(spark, d):
    return _with_utility(cache.replay(streams(spark, d), "lfu", 16)).select("stream_id", "seq", "pattern", "hit", "utility")


def cache_sketch_replay(spark, d):
    return _with_utility(cache.replay(streams(spark, d), "sketch", 16)).select("stream_id", "seq", "pattern", "hit", "utility")


def kr_fingerprint(spark, d):
    return benchmark(spark, d).select(F.col("doc_id").alias("item_id"), fingerprint.fingerprint(F.col("text")).alias("fp"))


def kr_composition(spark, d):
    """Fingerprints of halves, joined and taken apart again."""
    b = benchmark(spark, d).where("text IS NOT NULL").withColumn("h", F.floor(F.length("text") / 2).cast("int")).withColumn("n", F.length("text") - F.col("h"))
    b = b.select("doc_id", "n", fingerprint.fingerprint(F.col("text")).alias("whole"), fingerprint.fingerprint(F.expr("substring(text, 1, h)")).alias("a"), fingerprint.fingerprint(F.expr("substring(text, h + 1, n)")).alias("b"))
    p = fingerprint.power(F.col("n"))
    return b.select(F.col("doc_id").alias("item_id"), (fingerprint.concat(F.col("a"), F.col("b"), p) == F.col("whole")).alias("joined"), (fingerprint.suffix(F.col("whole"), F.col("a"), p) == F.col("b")).alias("split"))


def topk_rollup(spark, d):
    return topk.rollup(documents(spark, d), 10, 3, ("lang", "source")).select("lang", "source", F.col("g").cast("long").alias("g"), "rank", "substr", "freq")


def suffix_array(spark, d):
    return suffixes.suffix_array(benchmark(spark, d)).select(F.col("doc_id").alias("item_id"), "rank", "pos")


def lcp_array(spark, d):
    b = benchmark(spark, d)
    return suffixes.lcp_array(b, suffixes.suffix_array(b)).select(F.col("doc_id").alias("item_id"), "rank", "pos", "lcp")


def suffix_array_end_last(spark, d):
    return suffixes.suffix_array(benchmark(spark, d), end_last=True).select(F.col("doc_id").alias("item_id"), "rank", "pos")


def range_minima(spark, d):
    """Least common prefix over up to 17 ranks from each rank on, as far as there are."""
    rows = lcp_array(spark, d).withColumnRenamed("item_id", "doc_id")
    last = F.max("rank").over(Window.partitionBy("doc_id"))
    asked = rows.select("doc_id", F.col("rank").alias("low"), F.least(F.col("rank") + F.col("rank") % 17, last).alias("high"))
    return extensions.range_minima(rows, asked).withColumnRenamed("doc_id", "item_id")


def common_extensions(spark, d):
    """How far the text goes on alike from each 'e ' and the next one."""
    b = benchmark(spark, d)
    found = utility.matches(b, spark.createDataFrame([("e ",)], "pattern string"))
    pairs = found.select("doc_id", F.col("pos").alias("i"), F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")).alias("j")).where("j IS NOT NULL")
    return extensions.fingerprint_extensions(b, pairs).withColumnRenamed("doc_id", "item_id")


def pattern_prefixes(spark, d):
    """How much of each pattern stands wherever its first symbol does."""
    b = benchmark(spark, d)
    starts = b.select("doc_id", F.posexplode(symbols(F.col("text"))).alias("pos", "ch"))
    asked = starts.join(F.broadcast(patterns(spark).withColumn("ch", F.substring("pattern", 1, 1))), "ch").select("doc_id", F.col("pos").cast("long").alias("pos"), "query_id", "pattern")
    return extensions.pattern_prefixes(b, asked).withColumnRenamed("doc_id", "item_id")


def kr_prefixes(spark, d):
    return extensions.prefix_fingerprints(benchmark(spark, d)).withColumnRenamed("doc_id", "item_id")


def kr_substrings(spark, d):
    """Fingerprints of all substrings of five symbols, from those of prefixes."""
    b = benchmark(spark, d)
    found = grams.grams(b, [5]).select("doc_id", "pos", "len")
    return extensions.substring_fingerprints(extensions.prefix_fingerprints(b), found).withColumnRenamed("doc_id", "item_id")


def answer_metrics(spark, d):
    b = benchmark(spark, d)
    frequent = topk.expanded(topk.top_nodes(b, K, 12))
    table = frequent.select("substr", (F.col("freq") * gram_weight(F.col("substr"))).alias("utility"))
    return metrics.sources(utility.table_answers(b, patterns(spark), table), table)


def cache_metrics(spark, d):
    return metrics.cache_use(cache.lru_hits(streams(spark, d), 16))


def cache_lru_contents(spark, d):
    return cache.contents(streams(spark, d), "lru", 16).drop("count")


def pattern_intervals(spark, d):
    """Ranks of the suffixes that begin with each of 500 patterns, from a stored index."""
    path = f"{lineage.folder(spark)}/index-{uuid.uuid4().hex}"
    b = benchmark(spark, d)
    index.build(b, path)
    return index.search(spark, path, files.random_patterns(b, 500, 3, 12).select("query_id", "pattern"))


def index_lcps(spark, d):
    """Order and common prefixes of each text's suffixes, with no text in a row or task."""
    order = index.suffix_order(benchmark(spark, d), per_text=True)
    first = order.ranks.groupBy("row").agg(F.min("rank").alias("first"))
    lcps = index.common_prefixes(order, per_text=True).join(first, "row")
    return lcps.select(F.col("doc_id").alias("item_id"), (F.col("rank") - F.col("first")).alias("rank"), "pos", "lcp")


def lcp_intervals(spark, d):
    """All suffix-tree nodes of the small corpus, of any depth."""
    b = benchmark(spark, d)
    return index.nodes(b, index.suffix_order(b))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pattern_utility, utility_by_lang, utility_position_weights, table_answer, pattern_positions, char_alphabet, weight_prefix_sums, random_weights, random_patterns, gram_counts, topk_exact, topk_nodes,
        topk_summary, topk_utility_table, topk_levelwise, topk_levelwise_unbounded, topk_sampled, topk_sampled_pruned, topk_recall, topk_heavykeeper, topk_merged, topk_approx, topk_rollup, cache_lru_replay, cache_lru_evictions,
        cache_lfu_replay, cache_sketch_replay, kr_fingerprint, kr_composition, suffix_array, lcp_array,
        table_position_weights, suffix_array_end_last, range_minima, common_extensions, pattern_prefixes, kr_prefixes, kr_substrings, answer_metrics, cache_metrics, cache_lru_contents,
        pattern_intervals, index_lcps, lcp_intervals,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PATTERNS = "p(query_id, pattern) AS (VALUES " + ", ".join(f"({i}::BIGINT, {_quoted(p)})" for i, p in enumerate(PATTERNS)) + ")"
_WEIGHT = "((unicode({}) % 7 + 14) * 5)"
_GRAM_WEIGHT = f"list_sum(list_transform(string_split({{}}, ''), lambda c: {_WEIGHT.format('c')}))::BIGINT"


def _chars(table: str, key: str, extra: str = "") -> str:
    """c(key, pos, ch): the symbols of a table, and s(key, cs): their arrays."""
    return f"s AS (SELECT {key}{extra}, string_split(text, '') AS cs FROM {table} WHERE length(text) > 0), c AS (SELECT {key}{extra}, unnest(cs) AS ch, unnest(range(len(cs))) AS pos FROM s)"


def _grams(table: str, key: str, longest: int, extra: str = "", lengths: str | None = None) -> str:
    """g(key, pos, len, substr): all substrings, put together symbol by symbol with window functions."""
    at = "".join(f", lead(ch, {i}) OVER w AS c{i}" for i in range(1, longest))
    some = lengths or ", ".join(map(str, range(1, longest + 1)))
    parts = " ".join(f"WHEN {n} THEN ch{''.join(f' || c{i}' for i in range(1, n))}" for n in range(1, longest + 1))
    return f"{_chars(table, key, extra)}, l AS (SELECT {key}{extra}, pos, ch{at} FROM c WINDOW w AS (PARTITION BY {key} ORDER BY pos)), g AS (SELECT * FROM (SELECT {key}{extra}, pos, n::INT AS len, CASE n {parts} END AS substr FROM l, unnest([{some}]) AS t(n)) WHERE substr IS NOT NULL)"


_LENGTHS = sorted({len(p) for p in PATTERNS})


def _found(extra: str = "") -> str:
    grams_ = _grams("documents", "doc_id", max(_LENGTHS), extra, ", ".join(map(str, _LENGTHS)))
    return f"{_PATTERNS}, {grams_}, f AS (SELECT doc_id{extra}, pos, substr AS pattern FROM g WHERE substr IN (SELECT pattern FROM p))"


_TIES = "freq DESC, len, substr"


def _node_sql(table: str, key: str, longest: int) -> str:
    return f"""{_grams(table, key, longest)}, gc AS (SELECT substr, len, count(*) AS freq, min(({key}, pos)) AS first FROM g GROUP BY substr, len HAVING count(*) >= 2),
n AS (SELECT arg_max(substr, len) AS label, freq, min(len) - 1 AS pd, max(len) AS d FROM gc GROUP BY first, freq),
k AS (SELECT * FROM (SELECT *, coalesce(sum(d - pd) OVER (ORDER BY freq DESC, d, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) WHERE b < {K})"""


_EXPANDED = "e AS (SELECT label[1:len] AS substr, len::INT AS len, freq FROM k, LATERAL (SELECT unnest(range(pd + 1, d + 1)) AS len))"
# No node of 8 symbols is as frequent as the 100th best, so that no longer one can be: its prefix of 8 would be.
_TABLE = f"{_node_sql('documents', 'doc_id', 8)}, {_EXPANDED}, h AS (SELECT substr, freq, freq * {_GRAM_WEIGHT.format('substr')} AS utility FROM e)"

_SAMPLED = f"""{_grams("benchmark", "item_id", 12)}, rc AS (SELECT pos % 4 AS r, substr, len, count(*) AS freq, min((item_id, pos)) AS first FROM g GROUP BY ALL HAVING count(*) >= 2),
rn AS (SELECT r, arg_max(substr, len) AS label, freq, min(len) - 1 AS pd, max(len) AS d FROM rc GROUP BY r, first, freq),
rk AS (SELECT * FROM (SELECT *, coalesce(sum(d - pd) OVER (PARTITION BY r ORDER BY freq DESC, d, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM rn) WHERE b < {K}),
re AS (SELECT label[1:len] AS substr, len::INT AS len, freq FROM rk, LATERAL (SELECT unnest(range(pd + 1, d + 1)) AS len)),
m AS (SELECT substr, len, sum(freq)::BIGINT AS freq FROM re GROUP BY substr, len ORDER BY {_TIES} LIMIT {K}),
sampled AS (SELECT m.substr, m.len, m.freq AS est_freq, count(*) AS freq FROM m JOIN g ON g.substr = m.substr GROUP BY ALL)"""

_WORDS = r"""q AS (SELECT conv_id AS stream_id, (turn * 2147483648 + i)::BIGINT AS seq, w AS pattern FROM (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') AS ws FROM conversations WHERE length(text) > 0)) WHERE w <> '')"""
_KR = f"list_reduce(list_prepend(0::HUGEINT, list_transform(list_filter(string_split({{}}, ''), lambda c: c <> ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * {fingerprint.BASE} + c) % {fingerprint.PRIME})"
_HASH = f"(item_id * 1103515 + pos * 40503 + 12345) % 1000003"
_QUERY_HASH = "((query_id * {} + 12345) % 1000003)"

ORACLES: dict[str, str] = {
    "pattern_utility": f"WITH {_found()}, o AS (SELECT pattern, count(*) AS n FROM f GROUP BY pattern) SELECT query_id, p.pattern, coalesce(n, 0)::BIGINT AS occurrences, (coalesce(n, 0) * {_GRAM_WEIGHT.format('p.pattern')})::BIGINT AS utility FROM p LEFT JOIN o ON p.pattern = o.pattern",
    "utility_by_lang": f"WITH {_found(', lang')} SELECT lang, pattern, count(*) AS occurrences, (count(*) * {_GRAM_WEIGHT.format('pattern')})::BIGINT AS utility FROM f GROUP BY lang, pattern",
    "utility_position_weights": f"""WITH {_PATTERNS}, {_grams("benchmark", "item_id", max(_LENGTHS), "", ", ".join(map(str, _LENGTHS)))}, w AS (SELECT item_id, pos, [70, 75, 80, 85, 90, 95, 100][(({_HASH}) * ({_HASH})) % 1000003 % 7 + 1] AS w FROM c),
o AS (SELECT g.substr, count(DISTINCT (g.item_id, g.pos)) AS n, sum(w.w) AS u FROM g JOIN w ON g.item_id = w.item_id AND w.pos BETWEEN g.pos AND g.pos + g.len - 1 WHERE g.substr IN (SELECT pattern FROM p) GROUP BY g.substr)
SELECT query_id, pattern, coalesce(n, 0)::BIGINT AS occurrences, coalesce(u, 0)::BIGINT AS utility FROM p LEFT JOIN o ON p.pattern = o.substr""",
    "table_answer": f"""WITH {_TABLE}, {_PATTERNS}, o AS (SELECT p.query_id, p.pattern, (SELECT sum((length(d.text) - length(replace(d.text, p.pattern, ''))) // length(p.pattern)) FROM documents d) AS n FROM p)
SELECT o.query_id, o.pattern, coalesce(h.utility, n * {_GRAM_WEIGHT.format('o.pattern')})::BIGINT AS utility, CASE WHEN h.utility IS NULL THEN 'index' ELSE 'table' END AS source FROM o LEFT JOIN h ON h.substr = o.pattern""",
    "pattern_positions": f"WITH {_found()} SELECT pattern, doc_id, pos FROM f WHERE pattern IN ('schein', 'Licensed under', 'ción', 'on the')",
    "char_alphabet": f"WITH {_chars('documents', 'doc_id')} SELECT ch, count(*) AS freq FROM c GROUP BY ch",
    "weight_prefix_sums": f"WITH {_chars('benchmark', 'item_id')} SELECT item_id, pos, {_WEIGHT.format('ch')}::BIGINT AS w, sum({_WEIGHT.format('ch')}) OVER (PARTITION BY item_id ORDER BY pos)::BIGINT AS ps FROM c",
    "random_weights": f"WITH {_chars('benchmark', 'item_id')} SELECT item_id, pos, [70, 75, 80, 85, 90, 95, 100][(({_HASH}) * ({_HASH})) % 1000003 % 7 + 1]::BIGINT AS w FROM c",
    "random_patterns": f"""WITH t AS (SELECT item_id AS doc_id, text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark WHERE length(text) > 0),
r AS (SELECT q.query_id, t.doc_id, text, ({_QUERY_HASH.format(7919)} * {_QUERY_HASH.format(104729)}) % greatest(1, length(text) - 11) AS pos, {_QUERY_HASH.format(15485863)} % 10 + 3 AS len FROM range(500) AS q(query_id) JOIN t ON q.query_id % t.n = t.k)
SELECT query_id, doc_id, pos, substr(text, pos + 1, len) AS pattern FROM r""",
    "gram_counts": f"WITH {_grams('benchmark', 'item_id', 6)} SELECT substr, len, count(*) AS freq FROM g GROUP BY substr, len",
    "topk_exact": f"WITH {_grams('documents', 'doc_id', 6)}, x AS (SELECT substr, len, count(*) AS freq FROM g GROUP BY substr, len HAVING count(*) >= 2) SELECT row_number() OVER (ORDER BY {_TIES}) AS rank, substr, len, freq FROM x ORDER BY {_TIES} LIMIT {K}",
    "topk_nodes": f"WITH {_node_sql('benchmark', 'item_id', 12)} SELECT label, freq, pd, d FROM k",
    "topk_summary": f"WITH {_node_sql('benchmark', 'item_id', 12)} SELECT min(freq) AS tau, max(d) AS longest_len, count(*) AS n_nodes, sum(d - pd)::BIGINT AS n_substrings FROM k",
    "topk_utility_table": f"WITH {_TABLE} SELECT substr, freq, utility FROM h",
    "topk_recall": f"WITH {_SAMPLED}, gc AS (SELECT substr, len, count(*) AS freq, min((item_id, pos)) AS first FROM g GROUP BY substr, len HAVING count(*) >= 2), n AS (SELECT arg_max(substr, len) AS label, freq, min(len) - 1 AS pd, max(len) AS d FROM gc GROUP BY first, freq), k AS (SELECT * FROM (SELECT *, coalesce(sum(d - pd) OVER (ORDER BY freq DESC, d, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) WHERE b < {K}), {_EXPANDED} SELECT {K}::BIGINT AS k, count(*) FILTER (substr IN (SELECT substr FROM sampled)) AS hits, count(*) FILTER (substr IN (SELECT substr FROM sampled)) / count(*) AS recall FROM e",
    "topk_sampled": f"WITH {_SAMPLED} SELECT substr, len, est_freq, freq FROM sampled",
    "topk_rollup": f"""WITH {_grams("documents", "doc_id", 3, ", lang, source")}, x AS (SELECT lang, source, grouping(lang, source) AS b, substr, len, count(*) AS freq FROM g GROUP BY GROUPING SETS ((lang, source, substr, len), (lang, substr, len), (source, substr, len), (substr, len))),
y AS (SELECT lang, source, CASE b WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END::BIGINT AS g, substr, freq, row_number() OVER (PARTITION BY b, lang, source ORDER BY {_TIES}) AS rank FROM x) SELECT lang, source, g, rank, substr, freq FROM y WHERE rank <= 10""",
    "cache_lru_replay": f"""WITH {_WORDS}, u AS (SELECT *, lag(seq) OVER p AS prev, coalesce(lead(seq) OVER p, 4611686018427387904) AS nxt FROM q WINDOW p AS (PARTITION BY stream_id, pattern ORDER BY seq)),
d AS (SELECT a.stream_id, a.seq, count(*) AS n FROM u a JOIN u b ON a.stream_id = b.stream_id AND b.seq > a.prev AND b.seq < a.seq AND b.nxt >= a.seq GROUP BY a.stream_id, a.seq)
SELECT u.stream_id, u.seq, u.pattern, u.prev IS NOT NULL AND coalesce(d.n, 0) < 16 AS hit, {_GRAM_WEIGHT.format('u.pattern')} AS utility FROM u LEFT JOIN d ON u.stream_id = d.stream_id AND u.seq = d.seq""",
    "kr_fingerprint": f"SELECT item_id, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(text, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * {fingerprint.BASE} + c) % {fingerprint.PRIME})::BIGINT AS fp FROM benchmark",
    "kr_composition": f"""WITH h AS (SELECT item_id, text, length(text) // 2 AS h FROM benchmark WHERE text IS NOT NULL),
f AS (SELECT item_id, length(text) - h AS n, {_KR.format('text')} AS whole, {_KR.format('substr(text, 1, h)')} AS a, {_KR.format('substr(text, h + 1)')} AS b FROM h),
p AS (SELECT *, list_reduce(list_prepend(1::HUGEINT, list_transform(range(n), lambda i: {fingerprint.BASE}::HUGEINT)), lambda x, y: (x * y) % {fingerprint.PRIME}) AS p FROM f)
SELECT item_id, (a * p + b) % {fingerprint.PRIME} = whole AS joined, ((whole - a * p % {fingerprint.PRIME}) + {fingerprint.PRIME}) % {fingerprint.PRIME} = b AS split FROM p""",
    "suffix_array": f"WITH {_chars('benchmark', 'item_id')}, x AS (SELECT c.item_id, c.pos, substr(b.text, c.pos::INT + 1) AS t FROM c JOIN benchmark b ON b.item_id = c.item_id) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY t) - 1 AS rank, pos FROM x",
    "lcp_array": f"""WITH {_chars("benchmark", "item_id")}, x AS (SELECT c.item_id, c.pos, substr(b.text, c.pos::INT + 1) AS t FROM c JOIN benchmark b ON b.item_id = c.item_id),
y AS (SELECT item_id, row_number() OVER w - 1 AS rank, pos, t, lag(t) OVER w AS p FROM x WINDOW w AS (PARTITION BY item_id ORDER BY t))
SELECT item_id, rank, pos, coalesce(list_max(list_filter(range(0, least(length(t), length(p)) + 1), lambda n: substr(t, 1, n::INT) = substr(p, 1, n::INT))), 0)::BIGINT AS lcp FROM y""",
}
ORACLES["topk_levelwise"] = ORACLES["topk_exact"]
ORACLES["topk_merged"] = f"WITH {_grams('documents', 'doc_id', 6)}, x AS (SELECT substr, len, count(*) AS freq, min({{'d': doc_id, 'p': pos}}) AS f FROM g GROUP BY substr, len HAVING count(*) >= 2) SELECT row_number() OVER (ORDER BY {_TIES}) AS rank, substr, len, freq, f.d AS first_doc, f.p AS first_pos FROM x ORDER BY {_TIES} LIMIT {K}"
# No substring of more than 16 symbols is among the 2000 best of the small corpus.
ORACLES["topk_levelwise_unbounded"] = f"WITH {_grams('benchmark', 'item_id', 16)}, x AS (SELECT substr, len, count(*) AS freq FROM g GROUP BY substr, len HAVING count(*) >= 2) SELECT row_number() OVER (ORDER BY {_TIES}) AS rank, substr, len, freq FROM x ORDER BY {_TIES} LIMIT 2000"
# A full cache evicts at every further miss.
ORACLES["cache_lru_evictions"] = f"WITH hits AS ({ORACLES['cache_lru_replay']}) SELECT stream_id, count(*) - 16 AS evictions FROM hits WHERE NOT hit GROUP BY stream_id HAVING count(*) > 16"


_TEXTS = f"{_chars('benchmark', 'item_id')}, x AS (SELECT c.item_id, c.pos, c.ch, b.text FROM c JOIN benchmark b ON b.item_id = c.item_id)"
_SAME = "list_max(list_filter(range(0, least(length({0}), length({1})) + 1), lambda n: substr({0}, 1, n::INT) = substr({1}, 1, n::INT)))::BIGINT"
ORACLES["suffix_array_end_last"] = f"WITH {_TEXTS} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY substr(text, pos::INT + 1) || chr(1114111)) - 1 AS rank, pos FROM x"
ORACLES["range_minima"] = f"""WITH l AS ({ORACLES['lcp_array']}), n AS (SELECT item_id, max(rank) AS m FROM l GROUP BY item_id)
SELECT a.item_id, a.rank AS low, least(a.rank + a.rank % 17, max(n.m)) AS high, min(b.lcp) AS least
FROM l a JOIN n ON n.item_id = a.item_id JOIN l b ON b.item_id = a.item_id AND b.rank BETWEEN a.rank AND a.rank + a.rank % 17 GROUP BY a.item_id, a.rank"""
ORACLES["common_extensions"] = f"""WITH {_TEXTS}, y AS (SELECT item_id, text, pos AS i, lead(pos) OVER (PARTITION BY item_id ORDER BY pos) AS j FROM x WHERE substr(text, pos::INT + 1, 2) = 'e '),
z AS (SELECT item_id, i, j, substr(text, i::INT + 1) AS a, substr(text, j::INT + 1) AS b FROM y WHERE j IS NOT NULL) SELECT item_id, i, j, {_SAME.format('a', 'b')} AS lce FROM z"""
ORACLES["pattern_prefixes"] = f"WITH {_PATTERNS}, {_TEXTS}, y AS (SELECT item_id, pos, query_id, pattern, substr(text, pos::INT + 1, length(pattern)) AS a FROM x JOIN p ON substr(pattern, 1, 1) = ch) SELECT item_id, pos, query_id, pattern, {_SAME.format('a', 'pattern')} AS lcp FROM y"
ORACLES["kr_prefixes"] = f"WITH {_TEXTS} SELECT item_id, pos, {_KR.format('substr(text, 1, pos::INT + 1)')}::BIGINT AS fp FROM x"
ORACLES["kr_substrings"] = f"WITH {_grams('benchmark', 'item_id', 5, '', '5')} SELECT item_id, pos, len, {_KR.format('substr')}::BIGINT AS fp FROM g"
ORACLES["table_position_weights"] = f"""WITH {_node_sql('benchmark', 'item_id', 12)}, {_EXPANDED}, w AS (SELECT item_id, pos, [70, 75, 80, 85, 90, 95, 100][(({_HASH}) * ({_HASH})) % 1000003 % 7 + 1] AS w FROM c),
ps AS (SELECT item_id, pos, w, sum(w) OVER (PARTITION BY item_id ORDER BY pos) AS ps FROM w)
SELECT g.substr, count(*) AS freq, sum(hi.ps - lo.ps + lo.w)::BIGINT AS utility FROM e JOIN g ON g.substr = e.substr JOIN ps lo ON lo.item_id = g.item_id AND lo.pos = g.pos JOIN ps hi ON hi.item_id = g.item_id AND hi.pos = g.pos + g.len - 1 GROUP BY g.substr"""
ORACLES["answer_metrics"] = f"""WITH {_PATTERNS}, {_node_sql('benchmark', 'item_id', 12)}, {_EXPANDED}, h AS (SELECT query_id, pattern, pattern IN (SELECT substr FROM e) AS hit FROM p)
SELECT (SELECT count(*) FROM e) AS table_rows, count(*) AS queries, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, avg(hit::INT) AS hit_rate, avg(length(pattern)) AS avg_length FROM h"""
ORACLES["cache_metrics"] = f"WITH r AS ({ORACLES['cache_lru_replay']}) SELECT stream_id, count(*) AS queries, count(*) FILTER (hit) AS hits, avg(hit::INT) AS hit_rate FROM r GROUP BY stream_id"
ORACLES["cache_lru_contents"] = f"""WITH {_WORDS}, u AS (SELECT stream_id, pattern, max(seq) AS used FROM q GROUP BY stream_id, pattern),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY used DESC) AS r FROM u) SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY used) - 1 AS place, pattern FROM k WHERE r <= 16"""


def _pruned_sql() -> str:
    rounds = _SAMPLED.split(",\nre AS")[0]
    out = f"{rounds},\nre AS (SELECT r, label[1:len] AS substr, len::INT AS len, freq FROM rk, LATERAL (SELECT unnest(range(pd + 1, d + 1)) AS len)),\nk0 AS (SELECT substr, len, freq FROM re WHERE r = 0 ORDER BY {_TIES} LIMIT {K})"
    for r in range(1, 4):
        out += f",\nk{r} AS (SELECT substr, len, sum(freq)::BIGINT AS freq FROM (SELECT * FROM k{r - 1} UNION ALL SELECT substr, len, freq FROM re WHERE r = {r}) GROUP BY substr, len ORDER BY {_TIES} LIMIT {K})"
    return f"WITH {out} SELECT k3.substr, k3.len, k3.freq AS est_freq, count(*) AS freq FROM k3 JOIN g ON g.substr = k3.substr GROUP BY ALL"


ORACLES["topk_sampled_pruned"] = _pruned_sql()
ORACLES["index_lcps"] = ORACLES["lcp_array"]
# No substring of 24 symbols occurs twice in the small corpus, so that no deeper node exists.
ORACLES["lcp_intervals"] = f"WITH {_node_sql('benchmark', 'item_id', 24)} SELECT label, freq, pd, d FROM n"
ORACLES["pattern_intervals"] = f"""WITH q AS ({ORACLES["random_patterns"]}), {_TEXTS}, t AS (SELECT substr(text, pos::INT + 1) AS t FROM x),
n AS (SELECT pattern, count(*) FILTER (t < pattern) AS low, count(*) FILTER (starts_with(t, pattern)) AS n FROM (SELECT DISTINCT pattern FROM q) CROSS JOIN t GROUP BY pattern)
SELECT query_id, q.pattern, low, low + n - 1 AS high, n AS occurrences FROM q JOIN n ON n.pattern = q.pattern"""
