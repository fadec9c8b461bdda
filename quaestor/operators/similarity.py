"""Similarity of a text to its own reference texts, as map-only Arrow UDFs.

The references of a row travel with the row (an array column), so nothing is joined or shuffled: cost is linear in rows
and each row is scored in one task. Alignment against a corpus, which needs a join, is in ``align``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.stem import stem
from quaestor.functions.text import alpha_words, ratio, strip, txt

WS = re.compile(r"\s+")


def references(objectives: Column) -> Column:
    """Objectives without blank entries."""
    return F.filter(F.coalesce(objectives, F.array().cast("array<string>")), lambda x: strip(x) != "")


def content_reference(content: Column) -> Column:
    """The content as a list of one, kept even when it is only whitespace; empty for null and empty."""
    return F.when(F.length(txt(content)) > 0, F.array(content)).otherwise(F.array().cast("array<string>"))


def grams(seq, n: int) -> Counter:
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


def overlap(a: Counter, b: Counter) -> int:
    return sum(min(k, b[g]) for g, k in a.items() if g in b)


def word_tokens(text: str) -> list[str]:
    """Words with inner marks, and punctuation marks one by one."""
    return re.findall(r"\w+(?:[-'’.]\w+)*|[^\w\s]", text.lower())


def bleu(text: str, refs: list[str], weights=(0.25, 0.25, 0.25, 0.25)) -> float:
    """Joint multi-reference BLEU; a zero count is smoothed to 0.1, the closest length sets the brevity penalty."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    h, rs = word_tokens(text), [word_tokens(r) for r in refs]
    if not h:
        return 0.0
    logs = 0.0
    for n, w in enumerate(weights, 1):
        mine = grams(h, n)
        best: Counter = Counter()
        for r in rs:
            best |= grams(r, n)
        hit, total = overlap(mine, best), max(1, len(h) - n + 1)
        if n == 1 and not hit:
            return 0.0
        logs += w * math.log((hit or 0.1) / total)
    near = min((abs(len(r) - len(h)), len(r)) for r in rs)[1]
    return (1.0 if len(h) > near else math.exp(1 - near / len(h))) * math.exp(logs)


def lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = row & where.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


def rouge_tokens(text: str, stemmed: bool = True) -> list[str]:
    ws = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [stem(w) if len(w) > 3 else w for w in ws] if stemmed else ws


def rouge_l(text: str, refs: list[str], stemmed: bool = True) -> float:
    h, best = rouge_tokens(text, stemmed), 0.0
    for r in refs:
        t = rouge_tokens(r, stemmed)
        k = lcs(t, h) if t and h else 0
        if k:
            p, q = k / len(h), k / len(t)
            best = max(best, 2 * p * q / (p + q))
    return best


def meteor(text: str, refs: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Exact and stem stages; the synonym stage needs a word net and is left out."""
    h, best = word_tokens(text), 0.0
    for r in refs:
        t, pairs = word_tokens(r), []
        free_h, free_t = set(range(len(h))), set(range(len(t)))
        for form in (lambda w: w, stem):
            at: dict[str, list[int]] = {}
            for j in sorted(free_t, reverse=True):
                at.setdefault(form(t[j]), []).append(j)
            for i in sorted(free_h):
                js = at.get(form(h[i]))
                if js:
                    j = js.pop()
                    pairs.append((i, j))
                    free_h.discard(i)
                    free_t.discard(j)
        m = len(pairs)
        if not m:
            continue
        pairs.sort()
        chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
        p, q = m / len(h), m / len(t)
        f = p * q / (alpha * p + (1 - alpha) * q)
        best = max(best, f * (1 - gamma * (chunks / m) ** beta))
    return best


def chrf(text: str, refs: list[str], order: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F over text without whitespace, precision and recall averaged over the orders both texts have."""
    h, best = WS.sub("", text), 0.0
    mine = [grams(h, n) for n in range(1, order + 1)]
    for r in refs:
        t = WS.sub("", r)
        ps, qs = [], []
        for n in range(1, order + 1):
            theirs = grams(t, n)
            a, b = max(0, len(h) - n + 1), max(0, len(t) - n + 1)
            if a and b:
                k = overlap(mine[n - 1], theirs)
                ps.append(k / a)
                qs.append(k / b)
        if ps:
            p, q = sum(ps) / len(ps), sum(qs) / len(qs)
            if p + q > 0:
                best = max(best, (1 + beta**2) * p * q / (beta**2 * p + q))
    return best


def tfidf(text: str, refs: list[str]) -> float:
    """Cosine of 1-2-gram vectors with smoothed idf, fitted on the text and its references; the highest of them."""
    docs = []
    for x in [text, *refs]:
        w = re.findall(r"\b\w\w+\b", x.lower())
        docs.append(Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:])))
    df: Counter = Counter()
    for d in docs:
        df.update(d.keys())
    n = len(docs)
    vectors = [{g: k * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in d.items()} for d in docs]
    norms = [math.sqrt(sum(v * v for v in x.values())) for x in vectors]
    q, nq = vectors[0], norms[0]
    return max((sum(v * x.get(g, 0.0) for g, v in q.items()) / (nq * m) if nq and m else 0.0 for x, m in zip(vectors[1:], norms[1:])), default=0.0)


def bm25_raw(text: str, refs: list[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> float:
    """The highest Okapi score of the text as a query against its references as the corpus."""
    docs = [Counter(r.lower().split()) for r in refs]
    n, sizes = len(docs), [sum(d.values()) for d in docs]
    mean = sum(sizes) / n
    df: Counter = Counter()
    for d in docs:
        df.update(d.keys())
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf) if idf else 0.0
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    query = text.lower().split()
    return max(sum(idf.get(t, 0.0) * d[t] * (k1 + 1) / (d[t] + k1 * (1 - b + b * s / mean)) for t in query if d[t]) for d, s in zip(docs, sizes))


def bm25(text: str, refs: list[str], norm: float = 10.0) -> float:
    return min(1.0, max(0.0, bm25_raw(text, refs) / norm))


def self_bleu(text: str, batch: list[str]) -> float:
    """1 minus the mean BLEU-2 (linear brevity) against the other texts of the batch; 1 without others."""
    w = lambda s: re.findall("[a-z]+", s.lower())
    peers = [x for x in batch if x and x.strip() and x.strip() != text.strip()]
    if not peers:
        return 1.0
    h = w(text)
    one, two, out = grams(h, 1), grams(h, 2), 0.0
    for p in peers:
        r = w(p)
        if not h or not r:
            continue
        p1 = overlap(one, grams(r, 1)) / max(1, len(h))
        p2 = overlap(two, grams(r, 2)) / max(1, len(h) - 1)
        if p1 and p2:
            out += min(1.0, len(h) / len(r)) * math.sqrt(p1 * p2)
    return max(0.0, 1 - out / len(peers))


SCORERS: dict[str, Callable[[str, list[str]], float]] = {"bleu": bleu, "rouge_l": rouge_l, "meteor": meteor, "chrf": chrf, "tfidf": tfidf, "bm25": bm25, "self_bleu": self_bleu}
FLAG_BELOW = {"bleu": 0.3, "rouge_l": 0.3, "meteor": 0.3, "chrf": 0.3, "tfidf": 0.3, "bm25": 0.3, "self_bleu": 0.3}


def scored(name: str) -> Callable[[Column, Column], Column]:
    f = SCORERS[name]

    @F.pandas_udf("double")
    def run(text: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([f(t, list(r)) for t, r in zip(text, refs)], dtype=float)

    return run


def score(df: DataFrame, name: str, text: str = "text", refs: str = "refs") -> DataFrame:
    """Adds ``score`` and ``flagged``. No references: 0, flagged. Blank text: 0, flagged. ``self_bleu`` has no such rule:
    a text without peers scores 1 and is not flagged. Null references inside the array are left out."""
    r = F.filter(F.coalesce(F.col(refs), F.array().cast("array<string>")), lambda x: x.isNotNull())
    blank = strip(F.col(text)) == ""
    void = blank if name == "self_bleu" else blank | (F.size(r) == 0)
    # the UDF sees every row, so it gets a harmless pair where there is nothing to score
    safe = scored(name)(F.when(void, "x").otherwise(txt(F.col(text))), F.when(void, F.array(F.lit("y"))).otherwise(r))
    out = df.withColumn("score", F.when(void, 0.0).otherwise(safe))
    return out.withColumn("flagged", void | (F.col("score") < FLAG_BELOW[name]))


def vocabulary_novelty(text: Column, content: Column) -> Column:
    """Share of the text's distinct words that the content does not have; 0 without words or content."""
    w = F.array_distinct(alpha_words(text))
    return F.when((F.size(w) == 0) | (F.length(txt(content)) == 0), 0.0).otherwise(ratio(F.size(F.array_except(w, alpha_words(content))), F.size(w)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in the JVM; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
