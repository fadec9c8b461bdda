"""Building the item dataset from raw document text: cleaning, sections, chunks, stems, options, objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import strip, txt, ws_tokens

MAX_TOKENS, OVERLAP, MIN_TOKENS, MIN_STEM_CHARS, OPTION_WINDOW, OBJECTIVE_WINDOW = 500, 50, 20, 30, 800, 2000
# Glyph ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# Patterns that define headings, stems, options and objectives.
HEADING = r"\n(?=[A-Z][A-Za-z0-9 \-:]{3,60}\n)"
LABELLED = r"(?is)(?:^|\n)((?:Problem|Exercise|Question|Part)\s+\d+[a-z]?\.?\s*(?:\[\d+\s*(?:pts?|points?)\])?.+?(?=\n(?:Problem|Exercise|Question|Part)\s+\d|\z))"
NUMBERED = r"(?is)(?:^|\n)\s*(\d+[.\)]\s{1,3}(?:[A-Z].{15,}?)(?:\?|(?:explain|describe|prove|show|find|calculate|derive|state|define|give|list|compare|discuss|evaluate)[^.\n]*\.))"
OPTION = r"^\s*[A-E][.\)]\s"
OBJECTIVE_HEAD = r"(?i)(learning\s+objectives?|course\s+objectives?|learning\s+outcomes?|goals?)"
BULLET, NUMBER = r"(?m)^\s*[-•*]\s+(.+)", r"(?m)^\s*\d+[.\)]\s+(.+)"


def clean_text(c: Column) -> Column:
    """Drops glyph placeholders, spells ligatures out, folds runs of blanks and tabs. Null stays null."""
    x = F.regexp_replace(c, r"\(cid:\d+\)", "")
    for glyph, letters in LIGATURES.items():
        x = F.replace(x, F.lit(glyph), F.lit(letters))
    return F.regexp_replace(x, r"[ \t]{2,}", " ")


def approx_tokens(c: Column) -> Column:
    return F.size(ws_tokens(c))


def sections(c: Column) -> Column:
    """Parts that start at title-like lines, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(txt(c), HEADING), lambda x: strip(x)), lambda x: x != "")


def packed(text: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """An array of chunks: paragraphs gathered up to ``most`` words, each chunk after the first led in by the last ``overlap``
    words of the one before. A text that fits comes back as it is, a paragraph that is too long by itself stays whole; null
    gives null, a blank text itself."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), ws_tokens), lambda p: F.size(p) > 0)
    none = F.array().cast("array<string>")
    tail = lambda words: F.slice(words, F.greatest(F.lit(1), F.size(words) - overlap + 1), F.lit(overlap)) if overlap else none

    def gather(state: Column, para: Column) -> Column:
        full = (F.size(state["words"]) > 0) & (F.size(state["words"]) + F.size(para) > most)
        done = F.when(full, F.concat(state["done"], F.array(F.array_join(state["words"], " ")))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.concat(F.when(full, tail(state["words"])).otherwise(state["words"]), para).alias("words"))

    def close(state: Column) -> Column:
        return F.when(F.size(state["words"]) > 0, F.concat(state["done"], F.array(F.array_join(state["words"], " ")))).otherwise(state["done"])

    chunks = F.aggregate(paragraphs, F.struct(none.alias("done"), none.alias("words")), gather, close)
    return F.when(text.isNull(), None).when(F.size(ws_tokens(text)) <= most, F.array(text)).otherwise(chunks)


def chunk(docs: DataFrame, file: str, course: str, text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> DataFrame:
    """(course_id, source_file, pos, topic, text, token_count): the chunks of every document in order.

    Null and blank texts give none; chunks of fewer than ``least`` tokens are left out."""
    s = docs.select(F.col(course).alias("course_id"), F.col(file).alias("source_file"), F.posexplode(sections(clean_text(F.col(text)))).alias("sec", "section"))
    c = s.select("course_id", "source_file", "sec", F.posexplode(packed(F.col("section"), most, overlap)).alias("part", "text"))
    c = c.withColumn("token_count", approx_tokens(F.col("text"))).where(F.col("token_count") >= least)
    topic = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80)
    return c.select("course_id", "source_file", (F.col("sec") * 100000 + F.col("part")).alias("pos"), topic.alias("topic"), "text", "token_count")


def number_within(df: DataFrame, group: str, order: list[str], per_file: str = "source_file") -> DataFrame:
    """Adds ``n``, the row's number from 0 within ``group`` by ``order`` whose first column is ``per_file``.

    Two steps keep a hot group out of one task: rows are numbered inside their file, and files get offsets from counts."""
    inside = Window.partitionBy(group, per_file).orderBy(*[o for o in order if o != per_file])
    files = df.groupBy(group, per_file).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(group).orderBy(per_file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = files.withColumn("_o", before).drop("_k")
    return df.withColumn("_i", F.row_number().over(inside) - 1).join(offset, [group, per_file]).withColumn("n", F.col("_i") + F.col("_o")).drop("_i", "_o")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    x = number_within(chunks.where(F.col("course_id").isNotNull() & F.col("source_file").isNotNull()), "course_id", ["source_file", "pos"])
    return x.withColumn("chunk_id", F.format_string("%s-content-%04d", "course_id", "n")).drop("n")


def stems(c: Column) -> Column:
    """Labelled stems, else numbered ones; spacing folded, short ones left out."""
    first = F.regexp_extract_all(txt(c), F.lit(LABELLED), F.lit(1))
    second = F.regexp_extract_all(txt(c), F.lit(NUMBERED), F.lit(1))
    tidy = F.transform(F.when(F.size(first) > 0, first).otherwise(second), lambda x: F.regexp_replace(strip(x), r"\s{2,}", " "))
    return F.filter(tidy, lambda x: F.length(x) >= MIN_STEM_CHARS)


def question_ids(df: DataFrame, kind: str = "source_type") -> DataFrame:
    """Adds q_id: course, A or E, and a running number over the files of the course and kind; never used twice."""
    x = df.withColumn("_g", F.concat_ws("\x1f", "course_id", kind))
    x = number_within(x, "_g", ["source_file", "pos"]).drop("_g")
    return x.withColumn("q_id", F.format_string("%s-%s%04d", F.col("course_id"), F.upper(F.substring(F.col(kind), 1, 1)), F.col("n") + 1)).drop("n")


def source_label(file: Column) -> Column:
    """The last three parts of the file's stem in title case; the stem itself where it has no underscore."""
    stem = F.regexp_replace(file, r"\.[^./]+$", "")
    parts = F.split(stem, "_")
    label = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), " ")
    return F.when(F.size(parts) > 1, F.initcap(F.replace(label, F.lit("-"), F.lit(" ")))).otherwise(stem)


def options_after(full: Column, stem: Column) -> Column:
    """Option lines in the 800 characters after the stem, up to the first other line; null where there are none."""
    at = F.position(stem, full)
    seg = F.when(at > 0, F.substr(full, at + F.length(stem), F.lit(OPTION_WINDOW)))
    lines = F.filter(F.split(seg, "\n"), lambda x: strip(x) != "")
    # state: options so far, and whether the block is over
    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("over"))

    def step(acc: Column, line: Column) -> Column:
        is_option = line.rlike(OPTION)
        keep = is_option & ~acc["over"]
        return F.struct(F.when(keep, F.concat(acc["got"], F.array(strip(line)))).otherwise(acc["got"]).alias("got"), (acc["over"] | (~is_option & (F.size(acc["got"]) > 0))).alias("over"))

    got = F.aggregate(lines, start, step)["got"]
    return F.when(F.size(got) > 0, got)


def objectives(c: Column) -> Column:
    """Bulleted, then numbered entries of more than ten characters in the 2000 characters from the first heading about
    objectives, outcomes or goals; from the whole text where there is no heading."""
    head = F.regexp_instr(txt(c), F.lit(OBJECTIVE_HEAD))
    part = F.when(head > 0, F.substr(txt(c), head, F.lit(OBJECTIVE_WINDOW))).otherwise(txt(c))
    found = F.concat(F.regexp_extract_all(part, F.lit(BULLET), F.lit(1)), F.regexp_extract_all(part, F.lit(NUMBER), F.lit(1)))
    return F.filter(F.transform(found, lambda x: strip(x)), lambda x: F.length(x) > 10)


def enrich_course(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join of subject, level and field by course; a course that comes twice in ``meta`` counts once."""
    one = meta.where("course_id is not null").groupBy("course_id").agg(*[F.min(c).alias(c) for c in ("subject", "level", "field")])
    return df.join(one, "course_id", "left")
