"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each distinct set of word n-grams (texts with equal sets are one row) and a column for each
n-gram, in one order for the whole corpus: by hash, the commonest n-grams last. An entry of rows times rows is the
overlap of two sets. Similarity t asks of sets of x and y elements an overlap of t (x + y) / (1 + t), and entries are
discarded as soon as what they have and what is left to add stay below that.

The first block of columns brings up the entries. It has the first |x| - ceil(t |x|) + 1 columns of a row, one of which
two linking rows share, and no less than the columns up to a place that is the same for all rows. Each column is first
multiplied with two of its rows (pivots) only; the links found are contracted to components. Then the product is taken
between rows of different components in a column, so that a column shared by thousands of near copies never yields all
their pairs. A row must share many columns of the block with a larger one that links with it, so that it leaves out the
commonest of its own; a passage that unrelated texts share brings up no pairs of them. Columns that a row shares with no
other count against it, and so do places in the order and parity sketches.

The other blocks add up the overlap of the entries that are left, discarding on the way; after the last one it is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .base import components, forget, written

HOT = 1 << 18  # columns that are put last; bounds what is broadcast to 2 MB
FLUSH = 2_000_000  # n-grams whose repeats are counted at once in a task
GIVE = 500_000  # n-grams that a task holds before it gives rows away
BITS = (1024, 1 << 16)  # a sketch has as many bits as its set has elements, a power of two between these
FOLDED = 256  # bits of a sketch while rows of a column meet
BROADCAST_IDS = 1_000_000  # candidates (16 MB) up to which texts are picked where they are; beyond, they are shuffled
HIGH = np.uint64(1 << 62)  # set in the place of a common n-gram
PARTS = 8  # parts of a row's range of columns, for each of which the columns that are its own alone are counted
SPARE = 0.15  # by how much the place up to which every row brings its columns lies beyond the share of them that it must bring
BLOCKS = (0.25, 1.0)  # parts of the order of columns where the blocks of the final product end
MEET = 3  # columns in which two rows must meet, if their sizes allow it, to be an entry
SALTS = 64  # parts of the entries of one row, which may be a pivot of very many
FEW = 16  # components in a column, up to which its rows are joined by pairs of components

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(max(n, 1), _ODD[0], np.uint64))


def sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word n-grams, letters A-Z lower-cased.

    A text with fewer than k words is one n-gram, its whole sequence; one without words has an empty set.
    """
    i = 0
    while i < len(texts):  # blocks of about a megabyte
        j, size = i, 0
        while j < len(texts) and (j == i or size < 1_000_000):
            size += len(texts[j] or "")
            j += 1
        yield from _block([(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]], k)
        i = j


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of some texts, letters A-Z lower-cased, and where each text's words begin and the last's end."""
    b = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    gap = _GAP[b]
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    at = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw]))))
    if not len(start):
        return np.empty(0, np.uint64), at
    with np.errstate(over="ignore"):
        before = np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(b))))))
        place = np.arange(len(b)) - before
        value = np.where(gap, np.uint64(0), _BYTE[b] * _powers(int(place.max()) + 1)[place])
        return _mix(np.add.reduceat(value, start) + (end - start).astype(np.uint64)), at


def _block(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    word, at = word_hashes(raw)
    n = len(word) - k + 1
    with np.errstate(over="ignore"):
        if n > 0:
            gram = np.zeros(n, np.uint64)
            for d in range(k):
                gram += word[d : d + n] * _ODD[1 + d]
            gram = _mix(gram)
        for x in range(len(raw)):
            lo, hi = int(at[x]), int(at[x + 1])
            if hi - lo >= k:
                yield np.unique(gram[lo : hi - k + 1])
            elif hi > lo:
                short = np.uint64(hi - lo) * _ODD[40]
                for d in range(hi - lo):
                    short = short + word[lo + d] * _ODD[1 + d]
                yield _mix(np.array([short], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def required(n: int, percent: int) -> int:
    """Least overlap with any set at `percent` similarity or more: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def common(docs: DataFrame, k: int, text: str = "text") -> np.ndarray:
    """The n-grams to put last, sorted: the HOT commonest of those that repeat within a task's block of documents.

    It reads every document. It only sets the order of columns, which may be any, so it cannot change a result.
    """

    def count(batches):
        held: list[np.ndarray] = []

        def flush():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pd.DataFrame({"g": v[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})

        for pdf in batches:
            for s in sets(list(pdf["t"]), k):
                held.append(s)
                if sum(map(len, held[-1:])) and len(held) % 256 == 0 and sum(map(len, held)) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "g long, n long")
    top = rows.groupBy("g").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "g").limit(HOT).select("g").toPandas()
    return np.sort(top["g"].to_numpy(np.int64).view(np.uint64))


def place(percent: int) -> int:
    """Up to this place in the order, every row brings all its columns."""
    return int((1 - percent / 100) * (1 + SPARE) * (1 << 62))


def incidence(docs: DataFrame, k: int, percent: int, hot: np.ndarray, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n, s1, s2, cols, last, early, below, sketch, small): size and 128-bit fingerprint of each set, its columns for the
    product as places in their order, the place up to which it has all, how many are up to place(), how many in the first
    1 to PARTS parts of the range, and its parity sketch, whole and folded.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(hot)

    def rows(batches):
        hot, common_end = known.value, place(percent)
        seen = np.zeros(1 << 22, bool)
        seen[(hot >> np.uint64(42)).astype(np.int64)] = True
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("id", "n", "s1", "s2", "cols", "last", "early", "below", "sketch", "small")}
            held = 0
            for i, s in zip(pdf["i"], sets(list(pdf["t"]), k), strict=True):
                held += len(s)
                if held > GIVE:
                    yield pd.DataFrame(out)
                    out, held = {c: [] for c in out}, len(s)
                n = len(s)
                p = n - required(n, percent) + 1 if n else 0
                late = seen[(s >> np.uint64(42)).astype(np.int64)]
                if late.any():
                    at = np.minimum(np.searchsorted(hot, s[late]), len(hot) - 1)
                    late[late] = hot[at] == s[late]
                cols = np.concatenate((s[~late] >> np.uint64(2), (s[late] >> np.uint64(2)) | HIGH)).view(np.int64)
                early = int(np.searchsorted(cols, common_end, side="right"))
                cols = cols[: max(p, early)]
                last = max(common_end, int(cols[-1])) if n else 0
                ends = last // PARTS * np.arange(1, PARTS + 1)
                ends[-1] = last
                with np.errstate(over="ignore"):
                    a, b = _mix(s + _ODD[50]), _mix(s ^ _ODD[51])
                    bits = min(BITS[1], max(BITS[0], 1 << max(n - 1, 0).bit_length()))
                    parity = (np.bincount((b & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
                    out["s1"].append(np.add.reduce(a).view(np.int64) if n else 0)
                    out["s2"].append(np.bitwise_xor.reduce(b).view(np.int64) if n else 0)
                out["id"].append(i)
                out["n"].append(n)
                out["cols"].append(cols)
                out["last"].append(last)
                out["early"].append(early)
                out["below"].append(np.searchsorted(cols, ends, side="right"))
                out["sketch"].append(np.packbits(parity).view(np.int64))
                out["small"].append(np.packbits(parity.reshape(-1, FOLDED).sum(axis=0, dtype=np.uint32).astype(np.uint8) & 1).view(np.int64))
            yield pd.DataFrame(out)

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("i"), F.col(text).alias("t")).mapInPandas(rows, f"id {kind}, n long, s1 long, s2 long, cols array<long>, last long, early long, below array<long>, sketch array<long>, small array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, grams): the whole sorted sets of the documents in `ids`."""

    def rows(batches):
        for pdf in batches:
            ids, grams, held = [], [], 0
            for i, s in zip(pdf["i"], sets(list(pdf["t"]), k), strict=True):
                ids.append(i)
                grams.append(s.view(np.int64))
                held += len(s)
                if held > GIVE:
                    yield pd.DataFrame({"id": ids, "grams": grams})
                    ids, grams, held = [], [], 0
            yield pd.DataFrame({"id": ids, "grams": grams})

    kind = dict(docs.dtypes)[id]
    wanted = ids.select(F.col("id").alias("i"))
    wanted = F.broadcast(wanted) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else wanted
    some = docs.select(F.col(id).alias("i"), F.col(text).alias("t")).join(wanted, "i", "left_semi")
    return some.mapInPandas(rows, f"id {kind}, grams array<long>")


def _beside(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """`pairs`, a stored table, with the columns of `x` for the id in `a` and of `y` for `b`.

    A row goes to each of SALTS parts of its pairs that has any. Which those are is read from the table for either side, so that no plan holds another twice.
    """
    salted = out = pairs.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
    for key, rows in (("a", x), ("b", y)):
        wanted = salted.select(key, "salt").distinct().join(rows.withColumnRenamed("id", key), key)
        out = out.join(wanted, [key, "salt"])
    return out.drop("salt")


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int, text: str, id: str) -> DataFrame:
    """Of (a, b) those that link: their overlap is added up block by block, and what can't reach the similarity goes."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    full = written(whole_sets(docs, ids, k, text, id), "sets")
    kind = dict(pairs.dtypes)["a"]

    def block(low: float, high: float) -> DataFrame:
        # Sorted arrays of hashes: signed, so that a range of the order is a range of them.
        ends = [F.lit(int(x * (1 << 64)) - (1 << 63) - (x == 1.0)) for x in (low, high)]
        own = F.filter("grams", lambda g: (g >= ends[0] if low == 0 else g > ends[0]) & (g <= ends[1]))
        return full.select("id", F.size("grams").alias("n"), F.size(F.filter("grams", lambda g: g > ends[1])).alias("rest"), own.alias("g"))

    def add(batches):
        for pdf in batches:
            had = pdf["overlap"].to_numpy() + np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(pdf["gx"], pdf["gy"], strict=True)], np.int64)
            most = had + np.minimum(pdf["rx"].to_numpy(), pdf["ry"].to_numpy())
            yield pdf[["a", "b"]].assign(overlap=had)[(100 + percent) * most >= percent * (pdf["nx"].to_numpy() + pdf["ny"].to_numpy())]

    at, entries = 0.0, pairs.select("a", "b", F.lit(0).cast("long").alias("overlap"))
    for end in BLOCKS:
        part = block(at, end)
        x, y = (part.select("id", F.col("n").alias(f"n{z}"), F.col("rest").alias(f"r{z}"), F.col("g").alias(f"g{z}")) for z in "xy")
        both = _beside(entries, x, y)
        now = written(both.mapInPandas(add, f"a {kind}, b {kind}, overlap long"), "entries")
        forget(entries)
        entries, at = now, end
    links = written(entries.select("a", "b").distinct(), "links")
    forget(ids, full, entries)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of `docs` whose id is not null.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word n-grams; component_id is
    the smallest id that links reach. Null, empty and blank texts have no n-grams and link with nothing; a text with
    fewer than k words is one n-gram. A text of any length is hashed whole, in its task's memory. Repeated ids keep their
    rows; their texts count as texts of one document. Rows without an id are left out. An empty table gives none. Other
    columns of `docs`, whatever their names, are ignored.
    """
    docs = docs.select(F.col(id), F.col(text)).where(F.col(id).isNotNull())
    hot = common(docs, k, text)
    rows = written(incidence(docs, k, percent, hot, text, id), "rows")
    # Equal sets are one row of the matrix. The smallest id stands for them.
    classes = written(rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "classes")
    heads = rows.join(classes.select(F.col("rep").alias("id"), "n", "s1", "s2"), ["id", "n", "s1", "s2"], "left_semi")
    # A row needs another in its column that is near in size. Sizes that may link fall in one of 64 cyclic bands or two
    # neighbouring ones; where a column has a row for each band that it has, a row without a neighbour is alone.
    band = F.pmod(F.floor(F.log(F.col("n")) / F.lit(-math.log(percent / 100 - 0.005))), F.lit(64)).cast("int")
    inc = heads.select("id", "n", F.size("cols").cast("long").alias("q"), "last", F.posexplode("cols").alias("pos", "col"))
    shared = inc.groupBy("col").agg(F.count("*").alias("c"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), band)).alias("bands")).where("c > 1")
    bit = lambda d: F.call_function("getbit", "bands", F.pmod(band + d, F.lit(64))) == 1
    met = inc.join(shared, "col").where((F.col("c") > F.bit_count("bands")) | bit(1) | bit(-1))
    met = block = written(met.select("col", "id", "n", "q", "last", "pos"), "block")

    def alone(rows_: DataFrame) -> DataFrame:
        """(id, fade): for each part of a row's range, how many of its columns up to there are not in `rows_`, in 255ths of all.

        Such columns are lost to its overlap with any other row. A byte for each part, rounded down.
        """
        ends = [f"(last div {PARTS}) * {j}" for j in range(1, PARTS)] + ["last"]
        live = rows_.groupBy("id", "q").agg(*(F.sum(F.expr(f"CASE WHEN col <= {e} THEN 1L ELSE 0L END")).alias(f"l{j}") for j, e in enumerate(ends)))
        part = [f"shiftleft(greatest(0L, (255L * (below[{j}] - l{j})) div q), {8 * j})" for j in range(PARTS)]
        return live.join(heads.select("id", "below"), "id").select("id", F.expr(" | ".join(part)).alias("fade"))

    block = block.join(alone(block), "id")

    def fits(x: str, y: str) -> str:
        """Near in size, and the overlap can suffice: columns of either row that it shares with no one are lost to it."""

        def most(z: str) -> str:
            part = f"CASE WHEN {z}.last <= least({x}.last, {y}.last) THEN {PARTS} ELSE least({PARTS}L, least({x}.last, {y}.last) div greatest({z}.last div {PARTS}, 1L)) END"
            return f"{z}.n - CASE WHEN {part} = 0 THEN 0L ELSE ((shiftright({z}.fade, cast(8 * ({part} - 1) as int)) & 255L) * {z}.q) div 255 END"

        return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) AND {100 + percent} * least({most(x)}, {most(y)}) >= {percent} * ({x}.n + {y}.n)"

    # Two rows of each column, by which block one goes on; most columns have no others, and end here if those don't fit.
    own = F.struct("id", "n", "q", "last", "fade")
    ends = block.groupBy("col").agg(F.count("*").alias("c"), F.min(own).alias("p1"), F.max(own).alias("p2"))
    block = written(block.join(ends.where(f"c > 2 OR {fits('p1', 'p2')}").drop("c"), "col"), "block")
    forget(met)

    sketch = written(heads.join(block.select("id").distinct(), "id", "left_semi").select("id", "n", "sketch", "small"), "sketch")

    def differs(nx: str, ny: str) -> str:
        """The most elements that two linking sets of these sizes have in one of them only; parity sketches differ in no more bits."""
        return f"{nx} + {ny} - 2 * cast(ceil({percent} * ({nx} + {ny}) / {100 + percent}) as bigint)"

    def halved(x: str, y: str) -> str:
        """Folding a parity sketch by exclusive or gives the parity sketch of fewer bits."""
        return f"CASE WHEN size({x}) > size({y}) THEN transform(sequence(0, size({y}) - 1), i -> {x}[i] ^ {x}[i + size({y})]) ELSE {x} END"

    def plausible(pairs: DataFrame) -> DataFrame:
        """Discard pairs of (a, b) by size and by the parity of their symmetric difference, which the set bits never exceed. Gives a stored table."""
        pairs = written(pairs, "tried")
        x = sketch.select("id", F.col("n").alias("na"), F.col("sketch").alias("x"))
        y = sketch.select("id", F.col("n").alias("nb"), F.col("sketch").alias("y"))
        near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
        bits = f"aggregate(zip_with({halved('x', 'y')}, {halved('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
        unlike = "size(x) > 2 * size(y) OR size(y) > 2 * size(x)"  # not for similarities over a half
        left = written(_beside(pairs, x, y).where(near).where(f"{unlike} OR {bits} <= {differs('na', 'nb')}").select("a", "b").distinct(), "pairs")
        forget(pairs)
        return left

    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]

    # Each column times two of its rows.
    one = block.select(own.alias("x"), F.explode(F.array("p1", "p2")).alias("y"))
    one = one.where("x.id <> y.id").where(fits("x", "y")).select(*pair).distinct()
    tried = plausible(one)
    near = _linked(tried, docs, k, percent, text, id)
    label = components(near)

    # Rows of different components in a column. Most columns have one component by now.
    part = written(block.join(label, "id", "left").select("col", "id", "n", "q", "last", "pos", F.coalesce("component", "id").alias("c")), "named")
    kinds = part.groupBy("col", "c").agg(F.count("*").alias("m"))
    mixed = kinds.groupBy("col").agg(F.count("*").alias("k"), F.sum("m").alias("m")).where("k > 1")
    named = several = written(part.join(mixed, "col"), "several")
    forget(part)
    # By now a column that only one component has is lost as well. Of the columns up to place() a row shares `need` or more with
    # any row of its size or larger that it links with. So it looks in all its columns but need - few of the commonest, and
    # meets such a row in `few` of them at least, which is more than rows share by chance.
    need = f"greatest(1L, cast(ceil(2 * {percent} * n / {100 + percent}) as bigint) - n + early)"
    common_first = Window.partitionBy("id").orderBy(F.desc("m"), F.desc("col"))
    named = named.withColumn("late", F.row_number().over(common_first))
    spare = heads.select("id", "small", F.expr(need).alias("need"), (F.col("n") - F.col("early")).alias("open"))
    named = named.join(alone(named), "id").join(spare, "id").withColumn("left_out", F.greatest(F.lit(0), F.col("need") - MEET))
    named = named.select("col", "k", "id", "n", "q", "last", "pos", "c", "fade", "small", (F.col("late") > F.col("left_out")).alias("looks"), (F.col("left_out") + F.col("open")).alias("open"))
    named = written(named, "mixed")
    forget(several)
    # A shared column leaves the rests of x and y behind it for the overlap, and what may be shared before it.
    places = f"{100 + percent} * (1 + least(x.n - x.pos - 1, y.n - y.pos - 1) + least(x.pos, y.pos)) >= {percent} * (x.n + y.n)"
    differ = " + ".join(f"bit_count(x.small[{w}] ^ y.small[{w}])" for w in range(FOLDED // 64))
    linkable = f"x.looks AND (x.n < y.n OR x.n = y.n AND x.id < y.id) AND {fits('x', 'y')} AND {places} AND {differ} <= {differs('x.n', 'y.n')}"
    # Columns of few components, which may be large, are joined by component, so that rows of one never meet.
    few, many = named.where(f"k <= {FEW}"), named.where(f"k > {FEW}")
    kinds = few.groupBy("col", "c").agg(F.max("looks").alias("looks"))
    meet = kinds.where("looks").alias("u").join(kinds.alias("v"), F.expr("u.col = v.col AND u.c <> v.c")).select("u.col", F.col("u.c").alias("c1"), F.col("v.c").alias("c2"))
    x = meet.join(few.where("looks").withColumnRenamed("c", "c1"), ["col", "c1"]).alias("x")
    entry = [*pair, F.col("x.open").alias("open"), F.expr("x.n + y.n").alias("both")]
    two = x.join(few.alias("y"), F.expr(f"x.col = y.col AND x.c2 = y.c AND {linkable}")).select(*entry)
    two = two.unionByName(many.where("looks").alias("x").join(many.alias("y"), F.expr(f"x.col = y.col AND x.c <> y.c AND {linkable}")).select(*entry))
    # Overlap is at most what these columns add up to, those left out and those after place().
    two = two.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.max("open").alias("open"), F.max("both").alias("both"))
    two = two.where(f"{100 + percent} * (overlap + open) >= {percent} * both").select("a", "b")
    rest = plausible(two.join(tried, ["a", "b"], "left_anti"))
    far = _linked(rest, docs, k, percent, text, id)
    links = near.unionByName(far)
    # Rows that share an id are one document: its classes link.
    ids = rows.where("n > 0").join(classes, ["n", "s1", "s2"]).select("id", "rep")
    repeated = ids.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = components(links.unionByName(repeated.join(ids.groupBy("id").agg(F.count_distinct("rep").alias("k")).where("k > 1").select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")))
    out = rows.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("id", "n", "rep")
    out = out.join(final.withColumnRenamed("id", "rep").withColumnRenamed("component", "c"), "rep", "left")
    out = written(out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "rep", "id").alias("component_id")), "groups")
    forget(rows, classes, block, sketch, tried, near, label, named, rest, far, final)
    return out


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near copies among `documents`: three words, similarity 0.9. Awkward rows: see jaccard_components."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN unnest(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i:i + 2], ' '))) ELSE array_to_string(ws, ' ') END AS g FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
