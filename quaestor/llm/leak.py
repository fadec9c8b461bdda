"""Problem 7: evaluation texts inside training text, by Wu-Manber search over words.

Texts are word sequences (runs of a-z0-9 in lower case), so case, punctuation and layout fall away. The patterns are
all windows of ``run`` consecutive words of the test items: every hit of at least that length contains one. The
search reads a block of two words at the end of the current window; a shift table says how far the window may jump
because no pattern has that block nearer to its end; a zero shift opens the suffix bucket, whose patterns are
compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WuManber:
    """Search tables for equally long word patterns; each pattern carries the ids it stands for."""

    def __init__(self, patterns: dict[tuple[str, ...], set[int]]):
        self.m = len(next(iter(patterns)))
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], list] = {}
        for p, ids in patterns.items():
            for end in range(2, self.m + 1):
                block, far = (p[end - 2], p[end - 1]), self.m - end
                if far < self.shift.get(block, self.m):
                    self.shift[block] = far
            self.bucket.setdefault(p[-2:], []).append((p, ids))
        self.jump = self.m - 1  # no pattern has the block at all

    def search(self, w: list[str]) -> set[int]:
        found: set[int] = set()
        m, shift, bucket, jump, at, n = self.m, self.shift, self.bucket, self.jump, self.m, len(w)
        while at <= n:
            block = (w[at - 2], w[at - 1])
            s = shift.get(block, jump)
            if s:
                at += s
                continue
            window = tuple(w[at - m : at])
            for p, ids in bucket.get(block, ()):
                if p == window:
                    found |= ids
            at += 1
        return found


def windows(items: list[tuple[int, str | None]], run: int) -> dict[tuple[str, ...], set[int]]:
    """Every window of ``run`` words with the items that have it; items of fewer words give none."""
    out: dict[tuple[str, ...], set[int]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(len(w) - run + 1):
            out.setdefault(tuple(w[i : i + run]), set()).add(item)
    return out


def leaks(docs: DataFrame, items: DataFrame, run: int = 12, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "question", block: int = 20_000) -> DataFrame:
    """(doc_key, item_key) for every document that holds at least ``run`` consecutive words of an item, in order.

    The search tables are built once on the driver and sent to the executors; items beyond about ``block`` are hashed into
    blocks of that size, one scan of the documents each, so that the tables stay bounded however many items there are.
    Documents are never shuffled. Copies of a document count each, a window that several items share counts for each. Null
    texts and keys give nothing.
    """
    spark = docs.sparkSession
    own = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text).distinct()
    blocks = max(1, -(-own.count() // block))
    schema = f"{doc_key} {docs.schema[doc_key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}"
    source = docs.select(doc_key, text).where(F.col(doc_key).isNotNull() & F.col(text).isNotNull())
    found = [spark.createDataFrame([], schema)]
    for k in range(blocks):
        mine = own.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == k).collect()
        patterns = windows([(r[0], r[1]) for r in mine], run)
        if patterns:
            found.append(_search(source, spark.sparkContext.broadcast(WuManber(patterns)), doc_key, text, item_key, schema))
    return reduce(DataFrame.unionByName, found[1:] or found).distinct()


def _search(source: DataFrame, engine: Broadcast, doc_key: str, text: str, item_key: str, schema: str) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = engine.value.search
        for b in batches:
            keys, ids = [], []
            for key, t in zip(b[doc_key], b[text]):
                for i in sorted(search(words_of(t))):
                    keys.append(key)
                    ids.append(i)
            yield pd.DataFrame({doc_key: keys, item_key: ids})

    return source.mapInPandas(scan, schema)
