"""Packing by power-of-two decomposition.

A document's ids and its end id are cut into pieces of power-of-two length, the largest first and none longer than a
sequence: as many whole sequences as fit, then one piece for each binary digit of the rest. Pieces of one length share
a bucket; each fills a sequence of that length by itself, so that nothing is padded and no sequence crosses documents.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LENGTH = 2048
END = 1
_POOL: dict[str, object] = {}


def encoder(path: str):
    """Text to ids with a public byte-level BPE file (.json with its .tiktoken twin beside it).

    The ids are those of the tokenizers library with the .json file and add_special_tokens=False: a special token's string
    in a text is that token. Both files hold one vocabulary, and the twin's library needs a third of the time; it is used
    where the .json file's added tokens are plain strings. Without a twin, and for texts that its library can't take, the .json file is used itself.
    """
    if path not in _POOL:
        import json
        import os

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        twin = re.sub(r"\.json$", ".tiktoken", path)
        tok = Tokenizer.from_file(path)
        plainly = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, np.uint32)
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
        if os.path.exists(twin) and twin != path and plain:
            import public_tokenizers
            import tiktoken

            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

            def twice(t: str) -> np.ndarray:
                try:
                    return own.encode_to_numpy(t, allowed_special="all") if t else np.empty(0, np.uint32)
                except ValueError:  # its matcher's stack ends at very long runs of blanks
                    return plainly(t)

            _POOL[path] = twice
        else:
            _POOL[path] = plainly
    return _POOL[path]


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids, in order; `length` is a power of two."""
    out = [(s, length) for s in range(0, n - length + 1, length)]
    at = n - n % length
    for bit in range(length.bit_length() - 2, -1, -1):
        if (n % length) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pieces(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", length: int = LENGTH, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]), a row for each piece; null and empty texts are their end id."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids

    def run(batches):
        encode = encoder(path)
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for i, t in zip(pdf["i"], pdf["t"], strict=True):
                own = np.append(encode(t or ""), np.uint32(END)).astype("<u4")
                for start, size in cuts(len(own), length):
                    part = own[start : start + size]
                    for c, v in zip(columns, (i, start, size, zlib.crc32(part.tobytes()), len(own), part.astype(np.int32)), strict=False):
                        out[c].append(v)
            yield pd.DataFrame(out)

    kind = dict(docs.dtypes)[id]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return docs.select(F.col(id).alias("i"), F.col(text).alias("t")).mapInPandas(run, schema)


def pack(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", length: int = LENGTH, ids: bool = False) -> DataFrame:
    """The pieces with `bucket` (their power of two), `sequence_id` and `offset`.

    Null and empty texts are one piece, their end id. Repeated rows and ids are packed each on their own, and a null id
    stays null. A text of any length is encoded whole, in its task's memory. Columns of `docs` other than its id and text
    are ignored, whatever their names; an empty table gives an empty one.

    A piece is a sequence, so numbering needs no sort and no shuffle: a sequence's number is its partition and its row
    there, and a task that runs again gives the same numbers. Nothing is broadcast or gathered.
    """
    return pieces(docs, path, text, id, length, ids).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"), *(["ids"] * ids)
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader takes batches of equal sequences."""
    packed.write.partitionBy("bucket").parquet(path)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all `documents`, in sequences of at most 2048 tokens. Awkward rows: see pack."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
