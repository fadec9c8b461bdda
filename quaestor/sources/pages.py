"""Text of documents that come as pages: HTML in the JVM, binary formats through a back end.

A back end for a binary format is a function from the bytes of a file to the texts of its pages; none ships here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.text import strip, txt
from quaestor.operators.dataset import clean_text

# The named characters of HTML that text needs, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
PAGE_END = r'<hr class="page"\s*/?>'


def html_text(c: Column) -> Column:
    """Visible text: scripts, styles and comments out, block ends and line breaks as line ends, entities resolved."""
    x = F.regexp_replace(txt(c), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])\s*>", "\n")
    x = F.regexp_replace(x, r"</?[A-Za-z][^<>]*>", "")
    for name, sign in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def html_document(c: Column) -> Column:
    """The pages of a document, each stripped, joined by a blank line and cleaned; null and blank pages leave nothing."""
    pages = F.filter(F.transform(F.split(txt(c), PAGE_END), lambda p: strip(html_text(p))), lambda p: p != "")
    return clean_text(F.array_join(pages, "\n\n"))


def read_pages(spark: SparkSession, pattern: str, backend: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text) of binary documents; a file that the back end can't read comes with a null text and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows.append((path, "\n\n".join(p or "" for p in backend(bytes(content))), None))
                except Exception as e:  # one bad file must not end the job
                    rows.append((path, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(run, "path string, text string, error string").withColumn("text", clean_text(F.col("text")))
