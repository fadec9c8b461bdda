"""Problem 6: filling fixed-capacity containers by cost-balanced packing.

Sizes are tokens of a public tokenizer. A document larger than a container is split into full containers and one
rest; nothing else is split. Items are hashed into groups of bounded size; in a group the items, largest first, go to
the sequence of lowest cost (linear plus quadratic attention cost) that still has room for them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer at ``path``, loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row with a key and text; empty and null texts have no tokens and are left out."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_key": b[key], "n_tokens": [len(enc.encode_ordinary(t)) for t in b[text]]})

    source = docs.select(key, text).where(F.col(key).isNotNull() & (F.length(text) > 0))
    return source.mapInPandas(count, f"doc_key {kind}, n_tokens int")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_key, piece, start_token, n_tokens): one piece for what fits, full pieces and a rest for what does not."""
    n = F.col("n_tokens")
    last = F.ceil(n / capacity).cast("int") - 1
    return sizes.where(n > 0).select("doc_key", n.alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_key", "piece", (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).alias("n_tokens")
    )


def balanced(sizes: np.ndarray, capacity: int, quadratic: float = 1.0) -> np.ndarray:
    """Sequence numbers for ``sizes`` (each at most ``capacity``); deterministic, ties go to the lower number."""
    sizes = np.asarray(sizes, dtype=np.int64)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    cost = sizes + quadratic * sizes.astype(float) ** 2 / capacity
    k = max(1, -(-int(sizes.sum()) // capacity))
    room, load, out = np.full(len(sizes) + k, capacity, dtype=np.int64), np.zeros(len(sizes) + k), np.zeros(len(sizes), dtype=np.int64)
    for i in order:
        fits = np.flatnonzero(room[:k] >= sizes[i])
        if len(fits):
            j = fits[load[fits].argmin()]
        else:
            j, k = k, k + 1
        out[i] = j
        room[j] -= sizes[i]
        load[j] += cost[i]
    return out


def sizes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``token_counts``, written once: packing reads them several times, and every text is tokenised only once."""
    return cut(token_counts(docs, key, text, tokenizer))


def place(sizes: DataFrame, capacity: int, group_items: int = 4000, quadratic: float = 1.0) -> DataFrame:
    """(container, doc_key, piece, start_token, n_tokens): a place for every token of every document in ``sizes`` (``sizes_of``).

    Full pieces fill a container of their own at once. The others are hashed by (key, piece) into groups of about
    ``group_items``, whose number follows from a count, so a task's memory is bounded however many items there are.
    A key that comes with several texts gets a place for each. No documents, no rows.
    """
    parts = pieces(sizes, capacity)
    kind = sizes.schema["doc_key"].dataType.simpleString()
    schema = f"container string, doc_key {kind}, piece int, start_token int, n_tokens int"
    full = parts.where(F.col("n_tokens") == capacity).select(F.concat_ws("-", F.lit("full"), F.col("doc_key").cast("string"), F.col("piece").cast("string")).alias("container"), "doc_key", "piece", "start_token", "n_tokens")
    groups = max(1, -(-sizes.count() // group_items))
    rest = parts.where(F.col("n_tokens") < capacity).withColumn("grp", F.pmod(F.xxhash64("doc_key", "piece", "n_tokens"), F.lit(groups)).cast("int"))

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "doc_key", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        at = balanced(g["n_tokens"].to_numpy(), capacity, quadratic)
        names = [f"g{g['grp'].iloc[0]}-{j}" for j in at] if len(g) else []
        return pd.DataFrame({"container": names, "doc_key": g["doc_key"], "piece": g["piece"], "start_token": g["start_token"], "n_tokens": g["n_tokens"]})

    return full.unionByName(rest.groupBy("grp").applyInPandas(fill, schema))


def pack(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, group_items: int = 4000, quadratic: float = 1.0) -> DataFrame:
    """``place`` for the texts of ``docs``."""
    return place(sizes_of(docs, key, text, tokenizer), capacity, group_items, quadratic)
