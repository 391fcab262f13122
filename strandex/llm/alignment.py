"""Cross-tokenizer alignment.

Both tokenizers cut the bytes of one text; where tokens of both end, a group ends. Two tokens overlap in exactly one of
the ranges between neighbouring ends of either kind, so that the union of both kinds of ends has one entry for each link,
and the tokens that hold the byte before such an end are the linked ones. A task encodes its texts and takes groups and
links of many texts at a time, in arrays; pairs are counted and looked up by Spark.

Texts are encoded word by word where that is the same, with the words seen lately kept, and in whole otherwise. The links of a long
text are handed on in parts that end where a group does.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import forget, written

PART = 1 << 14  # bytes after which a text is cut at the next end of a group
WORDS = 200_000  # words whose tokens a task keeps
TOKENS = 1 << 17  # tokens whose groups and links are taken at a time, or those of one part
#: Distinct pairs of ids up to this many are broadcast with their counts; more are joined by a shuffle.
PAIRS = 1_000_000

_POOL: dict[tuple, Encoders] = {}
# A blank that another kind of blank, or the text's end, follows: words can't be told apart by blanks there.
_ODD = re.compile(" (?:[\\s\x1c-\x1f\x85᠎​⁠﻿]|\\Z)")


def _byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Two public tokenizers, with the bytes of each of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        own = _byte_level()
        with open(byte_path, encoding="utf-8") as f:
            added = {t["id"]: t["content"].encode() for t in json.load(f)["added_tokens"]}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = added[i] if i in added else bytes(own[c] for c in token)
        self.a_len = np.array([len(b) for b in self.a_bytes], np.int32)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(b) for b in self.b_bytes], np.int32)
        self.a_own, self.b_own = Bytes(self.a_bytes), Bytes(self.b_bytes)
        self.shown = _shown(max(len(self.a_bytes), len(self.b_bytes)))
        # No piece has a blank after something else, so that none crosses the blank ahead of a word.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.words: dict[str, int] = {}
        self.kept = (Flat(), Flat())
        # The same vocabulary as ranks, which another library encodes faster.
        self.fast = _ranked(byte_path)

    def encode_a(self, text: str) -> list[int]:
        if self.fast and len(text) < 100_000:  # its matcher may overflow at long runs of blanks
            return self.fast(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; empty for a text whose tokens' bytes aren't those of a blank and the text."""
        if self.by_word and text[:1].strip() and not _ODD.search(text):
            words = text.split(" ")
            known = self.words
            missing = [w for w in dict.fromkeys(words) if w not in known]
            if missing:
                if len(known) + len(missing) > WORDS:
                    known.clear()
                    self.kept = (Flat(), Flat())
                    missing = list(dict.fromkeys(words))
                self.learn(missing)
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            if at.min() < 0:
                return _NONE, _NONE
            return self.kept[0].take(at), self.kept[1].take(at)
        a, b = self.both(text)
        if self.joined(a, b) != b" " + text.encode():
            return _NONE, _NONE
        return a, b

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.encode_a(" " + text), np.int32), np.array(self.b.encode(text), np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode new words, some at a time as one text; words with bytes of their own changed are known as -1."""
        step = 2000
        for low in range(0, len(words), step):
            some = words[low : low + step]
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            a, b = self.both(" ".join(some))
            if self.joined(a, b) == b" " + " ".join(some).encode():
                sizes = [np.diff(np.searchsorted(np.cumsum(n[x]), ends, "left") + 1, prepend=0) for x, n in ((a, self.a_len), (b, self.b_len))]
                first = self.kept[0].add(a, sizes[0])
                self.kept[1].add(b, sizes[1])
                self.words.update(zip(some, range(first, first + len(some)), strict=True))
            else:
                for w in some:
                    a, b = self.both(w)
                    good = self.joined(a, b) == b" " + w.encode()
                    at = self.kept[0].add(a, np.array([len(a)]))
                    self.kept[1].add(b, np.array([len(b)]))
                    self.words[w] = at if good else -1

    def joined(self, a: np.ndarray, b: np.ndarray) -> bytes | None:
        """The bytes of the tokens, if those of both are the same."""
        one = self.a_own.joined(a)
        return one if one == self.b_own.joined(b) else None


class Bytes:
    """The bytes of a vocabulary in one array."""

    def __init__(self, tokens_: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens_), np.uint8)
        self.size = np.array([len(b) for b in tokens_], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()


def _shown(n: int) -> np.ndarray:
    """The decimal digits of ids up to n, first digit in the lowest byte; the highest is free for what stands behind."""
    return np.array([int.from_bytes(str(i).encode(), "little") for i in range(n)], "<u8")


class Flat:
    """Lists of ids, one after the other in one array that grows."""

    def __init__(self):
        self.ids, self.start, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append lists of the given sizes; the number of the first."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        first = self.n
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(sizes)] = sizes
        self.n, self.used = first + len(sizes), self.used + len(ids)
        return first

    def take(self, at: np.ndarray) -> np.ndarray:
        """The lists of the given numbers, joined."""
        size = self.size[at]
        moved = np.repeat(self.start[at] - np.cumsum(size) + size, size)
        return self.ids[moved + np.arange(len(moved))]


_NONE = np.empty(0, np.int32)


def _ranked(path: str):
    """Encoding by the file of ranks beside a byte-level vocabulary, if there is one with the same tokens."""
    import base64
    import os

    twin = re.sub(r"\.json$", ".tiktoken", path)
    if twin == path or not os.path.exists(twin):
        return None
    import public_tokenizers
    import tiktoken

    with open(twin, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoders(byte_path: str, piece_path: str) -> Encoders:
    key = (byte_path, piece_path)
    if key not in _POOL:
        _POOL[key] = Encoders(*key)
    return _POOL[key]


def _parts(a_end: np.ndarray, b_end: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(base, end, a from, a to, b from, b to) of the parts of one text."""
    total = int(a_end[-1])
    if total <= PART:
        return [(0, total, 0, len(a_end), 0, len(b_end))]
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    cut, ends = 0, []
    while cut < total:
        at = int(np.searchsorted(both, cut + PART))
        cut = int(both[min(at, len(both) - 1)])
        ends.append(cut)
    out, base, ia, ib = [], 0, 0, 0
    for e in ends:
        ja, jb = int(np.searchsorted(a_end, e, "right")), int(np.searchsorted(b_end, e, "right"))
        out.append((base, e, ia, ja, ib, jb))
        base, ia, ib = e, ja, jb
    return out


def _split(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Values as lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, both: Encoders) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Links (an id pair a * 2^32 + b for each) of texts or parts one after the other, none empty, `n_a` and `n_b` tokens each; then
    for each text its number of links, of groups, and its groups, `a1,a2|b1;a3|b2,b3`.
    """
    a_end, b_end = np.cumsum(both.a_len[a], dtype=np.int64), np.cumsum(both.b_len[b], dtype=np.int64)
    last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
    on_a, on_b = np.zeros(a_end[-1] + 1, bool), np.zeros(a_end[-1] + 1, bool)
    on_a[a_end] = True
    on_b[b_end] = True
    ends = np.flatnonzero(on_a | on_b)
    is_a, is_b = on_a[ends], on_b[ends]
    til_a, til_b = np.cumsum(is_a), np.cumsum(is_b)
    links = (a[til_a - is_a].astype(np.int64) << 32) | b[til_b - is_b]

    shared = np.flatnonzero(is_a & is_b)
    til_a, til_b = til_a[shared], til_b[shared]
    behind = lambda n, sign: np.full(n, ord(sign) << 56, "<u8")
    after_a, after_b = behind(len(a), ","), behind(len(b), ",")
    after_a[til_a - 1] = ord("|") << 56
    after_b[til_b - 1] = ord(";") << 56
    after_b[last_b] = ord("\n") << 56
    shown = np.empty(len(a) + len(b), "<u8")  # a group's tokens of a, then those of b
    shown[np.arange(len(a)) + np.repeat(til_b - np.diff(til_b, prepend=0), np.diff(til_a, prepend=0))] = both.shown[a] | after_a
    shown[np.arange(len(b)) + np.repeat(til_a, np.diff(til_b, prepend=0))] = both.shown[b] | after_b
    flat = shown.view(np.uint8)
    groups = flat[flat > 0].tobytes().split(b"\n")[:-1]

    upto = np.searchsorted(ends, a_end[last_a], "right")
    return links, np.diff(upto, prepend=0), np.diff(np.searchsorted(ends[shared], a_end[last_a], "right"), prepend=0), groups


def linked(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(row, doc_id, parts, n_a, n_b, n_groups, links, digest): both tokenizers' tokens, groups and links (an id pair a * 2^32 + b for each), part by part.

    A text without tokens is one part with an empty array. `digest` hashes a text's groups and stands in its last part; elsewhere it is ''. `row`
    tells rows apart that share an id; a task that runs again numbers them anew, so that a table is to be written before `row` joins anything.
    """
    kind = dict(docs.dtypes)[id]
    names = ["row", "doc_id", "parts", "n_a", "n_b", "n_groups", "links", "digest"]

    def run(batches):
        both = encoders(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 40
        rows, some_a, some_b = [], [], []  # (row, doc_id, part, parts), and ids
        hashed = None  # of the parts so far of the text whose parts are under way

        def give(of):
            nonlocal rows, some_a, some_b, hashed
            n_a, n_b = (np.array([len(x) for x in some], np.int64) for some in (some_a, some_b))
            n_links, n_groups, digests = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), [""] * len(rows)
            links, held = np.empty(0, np.int64), np.flatnonzero(n_a)
            if len(held):
                links, n_links[held], n_groups[held], groups = _linked(np.concatenate(some_a), np.concatenate(some_b), n_a[held], n_b[held], both)
                for i, g in zip(held.tolist(), groups, strict=True):
                    _, _, part, parts = rows[i]
                    if part == 0:
                        hashed = hashlib.sha256(g)
                    else:
                        hashed.update(b";" + g)
                    if part == parts - 1:
                        digests[i] = hashed.hexdigest()
            numbers, ids, _, parts = zip(*rows, strict=True)
            cols = [pa.array(numbers, pa.int64()), pa.array(ids, of), pa.array(parts, pa.int32()), *(pa.array(n, pa.int32()) for n in (n_a, n_b, n_groups))]
            rows, some_a, some_b = [], [], []
            return pa.RecordBatch.from_arrays([*cols, _split(links, n_links), pa.array(digests, pa.string())], names)

        for batch in batches:
            of, held = batch.schema.field("i").type, 0
            for doc, whole in zip(batch.column("i").to_pylist(), batch.column("t"), strict=True):
                t = whole.as_py()
                a, b = both.encode(t) if t else (_NONE, _NONE)
                cut = [(0, 0, 0, len(a), 0, len(b))]
                if len(a) and 4 * len(t) >= PART:
                    cut = _parts(np.cumsum(both.a_len[a], dtype=np.int64), np.cumsum(both.b_len[b], dtype=np.int64))
                for p, (_, _, ia, ja, ib, jb) in enumerate(cut):
                    rows.append((number, doc, p, len(cut)))
                    some_a.append(a[ia:ja])
                    some_b.append(b[ib:jb])
                    held += ja - ia
                    if held > TOKENS:
                        yield give(of)
                        held = 0
                number += 1
            if rows:
                yield give(of)

    schema = f"row long, doc_id {kind}, parts int, n_a int, n_b int, n_groups int, links array<long>, digest string"
    return docs.select(F.col(id).alias("i"), F.col(text).alias("t")).mapInArrow(run, schema)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of its first id is in more.

    Documents of one part are told apart in their row; pairs of longer ones are made distinct first.
    """
    short = table.where("parts = 1").select(F.explode(F.array_distinct("links")).alias("pair"))
    long_ = table.where("parts > 1").select("row", F.explode(F.array_distinct("links")).alias("pair")).distinct().select("pair")
    n = short.groupBy("pair").agg(F.count("*").alias("n")).unionByName(long_.groupBy("pair").agg(F.count("*").alias("n"))).groupBy("pair").agg(F.sum("n").alias("n"))
    n = written(n, "pairs")
    top = n.groupBy(F.shiftrightunsigned("pair", 32).alias("a")).agg(F.max("n").alias("top"))  # as many rows as the vocabulary has ids, at most
    out = written(n.join(F.broadcast(top), F.shiftrightunsigned("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")
    forget(n)
    return out


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", id: str = "doc_id", pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of `docs`.

    Null and empty texts, and those that a tokenizer changes, have no tokens: zeros, and '' for the hash. Each row is a document, whatever its
    id, null included. A text of any length is encoded in its task's memory and then goes by parts. Columns of `docs` but id and
    text are ignored; an empty table gives an empty one.
    """
    table = written(linked(docs, byte_path, piece_path, text, id), "links")
    counts = pair_counts(table)
    each = table.select("row", F.explode("links").alias("pair"))
    if counts.count() <= pairs:
        rated = each.join(F.broadcast(counts), "pair")
    else:  # what a document repeats is one row of the shuffle, which a skewed join deals out
        rated = each.groupBy("row", "pair").agg(F.count("*").alias("times")).join(counts, "pair").select("row", (F.col("n") * F.col("times")).alias("n"), F.when(F.col("best"), F.col("times")).alias("best"))
    best = F.col("best").cast("long")
    sums = rated.groupBy("row").agg(F.sum(best).alias("n_best"), F.sum("n").alias("count_sum"))
    docs_ = table.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("digest").alias("groups_sha256"),
        *(F.sum(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")), F.sum(F.size("links")).cast("long").alias("n_links"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return docs_.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of both public tokenizers over all `documents`. Awkward rows: see align."""
    import public_tokenizers as tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
