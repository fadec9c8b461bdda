"""The `rules` annotator: a deterministic stand-in for a parser, so that annotated metrics can run without one.

It is an approximation by word lists, endings and neighbourhood, never parity with a trained parser; rows scored with it
say so. Entities are not recognised. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor import lexicons as L
from quaestor.functions.text import txt

NAME = "rules"
DETERMINERS = "the a an this that these those each every some any no all both".split()
PREPOSITIONS = "of in on at by for with from to into through under over between near above below after before during".split()
BE = "is are was were be been being am".split()
AUX = [*BE, "do", "does", "did", "has", "have", "had", "can", "could", "will", "would", "should", "may", "might", "must", "shall"]
ADVERBS = "not never often always then there here very too also only just still again".split()
VERBS = sorted({*L.levels(L.BLOOM), *L.HOTS, *L.LOTS, "find", "prove", "take", "make", "see", "say", "go", "get", "need"})


def tag(w: Column) -> Column:
    """A part-of-speech tag for a lower-case word."""
    return (
        F.when(w.isin(*DETERMINERS), "DT").when(w.isin(*L.PRONOUNS), "PRP").when(w.isin(*L.COORDINATORS), "CC")
        .when(w.isin(*PREPOSITIONS, *L.CONJUNCTION_SUBORDINATORS), "IN").when(w.isin(*L.WH_SCORES), "WP").when(w.isin("can", "could", "will", "would", "should", "may", "might", "must", "shall"), "MD")
        .when(w.isin(*AUX), "VBZ").when(w.isin(*VERBS), "VB").when(w.isin(*ADVERBS) | w.rlike("^[a-z]{2,}ly$"), "RB").when(w.rlike("^[a-z]{3,}ed$"), "VBD").when(w.rlike("^[a-z]{3,}ing$"), "VBG")
        .when(w.rlike("^[a-z]{2,}(ous|ful|ive|al|ic|able|ible|less|ary)$"), "JJ").when(w.rlike("^[a-z]{2,}[^s]s$"), "NNS").otherwise("NN")
    )


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens ARRAY<STRUCT<text, pos, tag, dep, head, number, ent>>; empty for null and blank text.

    The root is the first verb, else the first token. A noun right before the root's group is its subject; determiners and
    adjectives hang on the next token, prepositions and everything else on the root."""
    words = F.regexp_extract_all(txt(F.col(text)), F.lit("[A-Za-z]+"), F.lit(0))
    # stages, as a column used inside a lambda must not be computed anew for every token
    x = df.withColumn("_raw", F.transform(words, lambda w: F.struct(w.alias("text"), tag(F.lower(w)).alias("tag"))))
    verbs = F.filter(F.transform("_raw", lambda x, i: F.when(x["tag"].rlike("^(VB|MD)"), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    x = x.withColumn("_root", F.coalesce(F.get(verbs, F.lit(0)), F.lit(0))).withColumn("_size", F.size("_raw"))
    raw, root, n = F.col("_raw"), F.col("_root"), F.col("_size")

    def full(x: Column, i: Column) -> Column:
        t, nxt = x["tag"], F.get(raw, i + 1)
        verb, noun = t.rlike("^(VB|MD)"), t.rlike("^(NN|PRP)")
        be_before = (i > 0) & F.lower(F.get(raw, F.greatest(i - 1, F.lit(0)))["text"]).isin(*BE)
        subject = noun & (i < root) & ((i + 1 == root) | nxt["tag"].rlike("^(RB|MD|VB)"))
        dep = (
            F.when(i == root, "ROOT").when(F.lower(x["text"]).isin("not", "never", "no"), "neg").when(subject, "nsubj").when(F.lower(x["text"]).isin(*BE) & nxt["tag"].isin("VBD"), "auxpass")
            .when(verb & be_before, "conj").when(verb & (F.get(raw, F.greatest(i - 1, F.lit(0)))["tag"] == "IN") & (i > 0), "advcl").when(verb, "conj").when(t == "DT", "det").when(t == "JJ", "amod").otherwise("dep")
        )
        head = F.when(i == root, i).when(t.isin("DT", "JJ", "PRP$") & (i + 1 < n), i + 1).otherwise(root)
        number = F.when(t == "NNS", "Plur").when(t == "NN", "Sing").when(F.lower(x["text"]).isin("are", "were", "have", "do"), "Plur").when(F.lower(x["text"]).isin("is", "was", "has", "does"), "Sing")
        pos = F.when(F.lower(x["text"]).isin(*AUX), "AUX").when(verb, "VERB").when(noun, "NOUN").when(t == "JJ", "ADJ").when(t == "RB", "ADV").otherwise("X")
        return F.struct(x["text"].alias("text"), pos.alias("pos"), t.alias("tag"), dep.alias("dep"), head.cast("int").alias("head"), number.alias("number"), F.lit("").alias("ent"))

    return x.withColumn("tokens", F.transform(raw, full)).drop("_raw", "_root", "_size")


def noun_chunks(tokens: Column) -> Column:
    """Runs of nouns, counted at their first token."""
    starts = F.transform(tokens, lambda x, i: F.when(x["tag"].rlike("^NN") & ((i == 0) | ~F.get(tokens, F.greatest(i - 1, F.lit(0)))["tag"].rlike("^NN")), 1).otherwise(0))
    return F.aggregate(starts, F.lit(0), lambda a, b: a + b)
