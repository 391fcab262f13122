"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with a space before it. The model is unigram: pieces of a public vocabulary, independent, with
Zipf-Mandelbrot probabilities by rank; a pre-token's count is the pieces of its likeliest segmentation (of equal ones,
the fewest pieces). The forward score of a prefix, the best score of its segmentations, depends on the prefix only.
So the distinct pre-tokens of a batch are walked in byte order, which is the depth-first walk of their trie: what two
neighbours share is scored once, and only the terminals' counts are stored. Nothing is shuffled: a document's words are
counted where they are read.
"""

from __future__ import annotations

import base64
import math

from pyspark.sql import DataFrame, functions as F

STORED = 400_000  # terminals that a task keeps between batches; more are counted anew
SHIFT = 2.7
_MODELS: dict[str, tuple[dict[bytes, float], int]] = {}


def model(path: str) -> tuple[dict[bytes, float], int]:
    """Log-probability of each piece, and the longest piece's bytes. Every single byte must be a piece."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        norm = math.log(math.fsum(1 / (r + SHIFT) for r in ranks.values()))
        _MODELS[path] = {p: -math.log(r + SHIFT) - norm for p, r in ranks.items()}, max(map(len, ranks))
    return _MODELS[path]


def forward(pretokens: list[bytes], score: dict[bytes, float], longest: int) -> dict[bytes, int]:
    """Pieces of each pre-token; the list is sorted."""
    best, count = [0.0], [0]
    last, out = b"", {}
    get = score.get
    for w in pretokens:
        shared = 0
        for x, y in zip(last, w, strict=False):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(w) + 1):
            top, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                p = get(w[start:end])
                if p is not None:
                    p += best[start]
                    if p > top or p == top and count[start] + 1 < n:
                        top, n = p, count[start] + 1
            best.append(top)
            count.append(n)
        out[w] = count[-1]
        last = w
    return out


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words and n_tokens for each row; null, empty and blank texts have none.

    Repeated rows give repeated results, and a null id stays null. A text of any length is counted whole, in its task's memory;
    a pre-token takes time in proportion to its length. Other columns, whatever their names, are ignored, and an empty
    table gives an empty one.
    """

    def run(batches):
        score, longest = model(path)
        known: dict[bytes, int] = {}
        for pdf in batches:
            texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in pdf.pop("__sx_text")]
            words, tokens, i = [], [], 0
            while i < len(texts):  # blocks of about four megabytes
                size, block = 0, []
                while i < len(texts) and (not block or size < 4_000_000):
                    size += len(texts[i])
                    block.append(texts[i].split())
                    i += 1
                if len(known) > STORED:
                    known.clear()
                known |= {w[1:]: n for w, n in forward(sorted(b" " + w for w in set().union(*block) - known.keys()), score, longest).items()}
                words += map(len, block)
                tokens += (sum(map(known.__getitem__, ws)) for ws in block)
            yield pdf.assign(n_words=words, n_tokens=tokens)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__sx_text")).mapInPandas(run, f"{schema}, n_words long, n_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words and tokens of all `documents`. Awkward rows: see token_counts."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
