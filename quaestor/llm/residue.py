"""Problem 8: template residue, filler, error pages and script notices instead of content.

Every line is normalised (placeholders, addresses, dates, ids and numbers masked, case and spacing folded) and its hash is
grouped over documents and sources, different texts counted once. What recurs widely is classified: phrase rules name the
messages and filler; of what no phrase knows, a line that hardly ever stands beside content is a message of unseen wording, a
line that does is furniture (menus, footers). Phrase and placeholder rules also hold for lines too rare to recur. A document
is residue when it has an unfilled placeholder, when messages and filler outweigh what else it says, or when nothing but
recurring messages is in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import WS, is_blank, txt
from quaestor.runtime import cut

# Phrase rules, for lines in lower case with digits masked as #. English first, then other languages.
STATUS = (
    r"\b(not found|forbidden|bad gateway|gateway time-?out|internal server error|service unavailable|bad request|unauthorized|gone|too many requests|access denied|"
    r"introuvable|interdit|non trouvée?|no encontrada|prohibido|nicht gefunden|verboten|nicht erreichbar)\b"
)
ERROR_LINE = (
    rf"^(?:(oops!? |sorry,? |http )*((error|erreur|fehler|http|code|status)\s*:?\s*#|#\s*[-–:]?\s*(error\b)?).{{0,20}}{STATUS}|(oops!?|sorry|http error #)\b.{{0,30}}{STATUS}|"
    r"(erreur|error|fehler) #|code # ref|request id\b|"
    r"(we are |we're )?sorry,? .{0,20}(something|an error|the page|this page)|something went wrong|an? (unexpected |internal )?error (has )?occurred|"
    r"the (page|file|resource|document) (you are looking for|you requested|requested)|the requested (file|page|url|resource)\b.*(could not|cannot|was not|is not|not found)|"
    r"you (do not|don't) have (permission|access)|access (to this|denied)|please (try again|come back|check back)|(the|this) [a-z ]{2,40} is (down|closed|unavailable|offline) for\b|"
    r"(this|the) (page|site|service|server) is (temporarily |currently )?(unavailable|down|offline)|your session (has )?expired|traceback \(most recent| *file \"[^\"]+\", line #|[a-z]*(error|exception): |"
    r"back to the (start|home) ?page|check back soon|"
    r"(la página|la page|die seite|diese seite|esta página|cette page)\b.*(no existe|no se|introuvable|n'existe|nicht|demandée|solicitada|angeforderte)|"
    r"(bitte versuchen|veuillez réessayer|inténtelo|vuelva a intentar|lo sentimos|désolée?|es ist ein fehler|une erreur|se ha producido|zugriff verweigert|accès refusé|acceso denegado))"
)
SCRIPT_LINE = (
    r"^(?:(please |you need to |you must )?(enable|turn on|activate|allow|switch on|accept) (javascript|java script|scripts?|cookies)\b|you need to (enable|turn on|allow)\b.{0,20}(javascript|scripts?|cookies)|"
    r"(this|the|our) (site|page|website|app|application|course|lecture|quiz)\b.{0,30}(requires?|needs?|uses)\b.{0,30}(javascript|scripts?|cookies)\b|"
    r"(javascript|scripts?|cookies) (is|are|must|has|have|need)\b.{0,30}(disabled|required|enabled|turned|off|blocked|be)|your browser (is|does|has)\b.{0,40}(javascript|scripts?|cookies|blocking)|"
    r"noscript\b|how to (turn on|enable|allow|activate) (javascript|scripts?|cookies)|loading\b.{0,30}(if nothing happens|switch on|scripts|cookies|please wait))"
)
# Where the words may stand anywhere; tried only on sentences that name scripts or cookies.
SCRIPT_ANYWHERE = (
    r"\b(activez|activer|aktivieren|activar|active|habilite|habilitar|permita|autorisez|erlauben|einschalten)\b.{0,40}\b(javascript|scripts?|cookies)\b|"
    r"\b(javascript|scripts?|cookies)\b.{0,40}\b(activez|activé|activés|aktivieren|aktiviert|activado|activar|habilite|habilitar|einschalten|erlauben|requis|nécessaires?|erforderlich|necesarios?|benötigt|autorisez)\b"
)
FILLER_LINE = (
    r"^(?:(click|tap) (here )?to (edit|add)|(your|my|some|insert|add|type|enter) (text|content|title|heading|subtitle|caption|description|name) (goes |go )?here|this is (a |some |an )?(sample|dummy|example|placeholder|test) (text|paragraph|page|content)|"
    r"(dummy|sample|placeholder) (text|paragraph|content)|replace this\b|add (a|your|some) (description|text|title|content)\b|(insert|type|enter) (your )?(text|content)\b|"
    r"(?<again>[a-z]{2,6})( \k<again>){2,}\W*$|(asdf|qwer|jkl|foo|bar|baz|test|blah|xxx|lorem|ipsum|text|abc)( (asdf|qwer|jkl|foo|bar|baz|test|blah|xxx|lorem|ipsum|text|abc))+\W*$|"
    r"(coming soon|under construction|page intentionally left blank|content to be added)\b|(hier steht|ihr text|ici votre texte|votre texte|su texto|texto de (ejemplo|relleno)|texte d'exemple|beispieltext|platzhalter))"
)
# Words of the customary Latin filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur"
).split()

NAME = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9]*(?:[_ .-][A-Za-zÀ-ÿ0-9]+){0,4}"
PLACEHOLDER = (
    rf"\{{\{{\s*{NAME}\s*\}}\}}|\$\{{\s*{NAME}\s*\}}|<%=?\s*{NAME}\s*%>|\[\[\s*{NAME}\s*\]\]|%%\s*{NAME}\s*%%|\b__[A-ZÀ-Ý][A-ZÀ-Ý0-9_]*[A-ZÀ-Ý0-9]__|"
    r"(?<![\w$\\^_{])\{[a-z]{4,}(?:_[a-z0-9]+)*\}(?!\})|(?<![\w$\\^_{])\{[a-z]+(?:_[a-z0-9]+)+\}(?!\})|"
    r"<[A-Za-z][^<>\n]{0,60} goes here>|<(?:insert|enter|your|add)\b[^<>\n]{0,60}>|\[(?i:insert|enter|your|add|replace|type)\b[^\]\n]{0,60}\]|\((?:replace|fill in|insert) with [^)\n]{1,60}\)|\(replace [^)\n]{1,60}\)|\(insert [^)\n]{1,40} here\)|"
    rf"\bTBD:\s*{NAME}|\[[A-ZÀ-Ý][A-ZÀ-Ý ]+(?:À COMPLÉTER|AQUÍ|EINTRAGEN|EINFÜGEN|HIER|ICI)\]|\[(?:INSÉRER|INSERTAR|ESCRIBA|EINFÜGEN|COMPLÉTER|À COMPLÉTER)\b[^\]\n]{{0,60}}\]"
)
SKELETON = r"(?m)^\s*(?:[A-ZÀ-Ý][\p{L}]+ [0-9]+|[A-ZÀ-Ý][\p{L} ]{2,30}):\s*(?:TODO|TBD|TBA|\?\?\?|xxx|XXX|Untitled|\[title\]|\[titre\]|\[Titel\]|\[título\]|to be filled in|to be added|fill me in)\s*$"
# What every placeholder begins with; looked for first, as it is found faster.
OPENING = (
    r"[{$<\[%_(T](?:(?<=\{)(?:\{|[a-z]{4}|[a-z]+_)|(?<=\$)\{|(?<=<)[%A-Za-z]|(?<=\[)(?:\[|[A-ZÀ-Ýa-zà-ÿ]{3})|(?<=%)%|(?<=_)_[A-ZÀ-Ý]|(?<=\()(?:replace|fill|insert) |(?<=T)BD)"
)
# What ends an outline row of the kind above; looked for first, as it is found faster.
OUTLINE_END = r"(?m):\s*(?:TODO|TBD|TBA|\?\?\?|xxx|XXX|Untitled|\[[Tt]it|\[tít|to be filled in|to be added|fill me in)"
MARK = "\x00marked"
# A mark right after these words, or in quotes, is being talked about.
MENTION = rf"(?:such as|like|called|named|mark|marks|string|tag|tags|token|syntax|variable|form|written(?: as)?|e\.g\.|for example|for instance|means|notation|script|shell|template|type|write|writes|using|use)[,:]?\s+[\"'`“‘(]?(?:{PLACEHOLDER})|[\"'`“‘](?:{PLACEHOLDER})[\"'`”’]|(?:{PLACEHOLDER})[\"'`”’)]? (?:stands for|stand for|means|denotes|refers to|is replaced|are replaced|is a (?:mark|placeholder|variable|token))"


def _let(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(c), then).getItem(0)


def normalised(line: Column) -> Column:
    """Lower case, with placeholders, addresses, dates, ids and numbers masked and spacing folded."""
    date = r"\b\d{4}-\d{1,2}-\d{1,2}([t ]\d{1,2}:\d{2}(:\d{2})?)?|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"
    number = r"(?<![a-z0-9])[a-z]*+\d[a-z0-9]*+(?:[.,:][a-z]*+\d[a-z0-9]*+)*"
    steps = [
        lambda x: F.lower(F.when(x.rlike(OPENING), F.regexp_replace(x, PLACEHOLDER, "<ph>")).otherwise(x)),
        lambda x: F.when(x.contains("@") | x.contains("://") | x.contains("www."), F.regexp_replace(x, r"(https?://|www\.)\S+|(?<!\S)[^\s@]+@\S+\.\S+", "<addr>")).otherwise(x),
        lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(F.when(x.rlike(r"\d[-./]\d"), F.regexp_replace(x, date, "<date>")).otherwise(x), number, "#")).otherwise(x),
        lambda x: F.when(x.contains("  ") | x.startswith(" ") | x.endswith(" ") | x.rlike(r"[\s\p{Z}&&[^ ]]"), F.trim(F.regexp_replace(x, WS, " "))).otherwise(x),
    ]
    for step in steps:
        line = _let(line, step)
    return line


def has_unfilled_placeholder(text: Column) -> Column:
    """A placeholder that the sentence does not merely mention, or an outline row whose title was never given."""
    flat = F.regexp_replace(txt(text), r"\s*\n\s*", " ")
    stands = _let(flat, lambda x: x.rlike(PLACEHOLDER) & F.regexp_replace(x, MENTION, " ").rlike(PLACEHOLDER))
    marked = F.when(txt(text).rlike(OPENING), stands).otherwise(False)
    return marked | (txt(text).rlike(OUTLINE_END) & txt(text).rlike(SKELETON))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}#]+"), F.lit(0))


def line_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_key, text_id, src, line_hash, n_words, message, filler, n): the lines of every document by normalised hash, with
    their words and how many of these stand in sentences that are messages or filler; repeated lines counted.

    ``line_hash`` 0 with ``n_words`` -1 marks a document with an unfilled placeholder. The texts are read once and stay in
    the scan; only hashes and counts are shuffled."""
    t = txt(F.col(text))
    rows = F.split(t, r"\r?\n")
    rows = F.when(has_unfilled_placeholder(t), F.concat(rows, F.array(F.lit(MARK)))).otherwise(rows)
    one = docs.where(F.col(key).isNotNull() & ~is_blank(F.col(text))).select(
        F.col(key).alias("doc_key"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.xxhash64(t).alias("text_id"), F.explode(rows).alias("line")
    )
    one = one.where(F.trim("line") != "").withColumn("norm", F.when(F.col("line") == MARK, F.col("line")).otherwise(normalised(F.col("line"))))
    one = one.select("doc_key", "src", "text_id", "norm", _words(F.col("norm")).alias("ws"))
    c, n = F.col("norm"), F.size("ws")
    script = lambda x: x.rlike(SCRIPT_LINE) | ((x.contains("script") | x.contains("cookie")) & x.rlike(SCRIPT_ANYWHERE))
    rule = lambda x: F.when(x.rlike(FILLER_LINE), 1).when(x.rlike(ERROR_LINE) | script(x), 2).otherwise(0)

    def words_told(parts: Column, told: Column) -> Column:
        """The words of filler (1) and of messages (2). What a rule finds brings the sentence after it along."""
        of = lambda k: F.aggregate(F.filter(parts, lambda x, i: (F.get(told, i) == k) | F.coalesce((F.get(told, i - 1) == k) & (F.get(told, i) == 0), F.lit(False))), F.lit(0), lambda a, x: a + F.size(_words(x)))
        return F.when(F.exists(told, lambda k: k > 0), F.struct(of(1).alias("filler"), of(2).alias("message")))

    # a rule is tried at the start of the line and of every later sentence
    told = _let(F.split(c, r"(?<=[.!?…])\s+"), lambda parts: _let(F.transform(parts, lambda x, i: F.when(i == 0, rule(c)).otherwise(rule(x))), lambda t: words_told(parts, t)))
    latin = (n >= 3) & (F.size(F.filter("ws", lambda w: w.isin(*LATIN))) >= 0.7 * n)
    one = one.withColumns({"told": told, "latin": latin})
    filler = F.when(F.col("latin"), n).otherwise(F.least(n, F.coalesce("told.filler", F.lit(0))))
    message = F.when(F.col("latin"), 0).otherwise(F.least(n, F.coalesce("told.message", F.lit(0))))
    mark = c == MARK
    tagged = one.select(
        "doc_key", "text_id", "src", F.when(mark, F.lit(0)).otherwise(F.xxhash64("norm")).alias("line_hash"), F.when(mark, F.lit(-1)).otherwise(n).alias("n_words"),
        F.when(mark, 0).otherwise(message).alias("message"), F.when(mark, 0).otherwise(filler).alias("filler"),
    )
    return tagged.groupBy("doc_key", "text_id", "src", "line_hash", "n_words", "message", "filler").agg(F.count("*").alias("n"))


def recurring(lines: DataFrame, share: float = 1e-4, least: int = 3, source_share: float = 0.01) -> DataFrame:
    """(line_hash, texts): the lines that recur widely: in at least ``share`` of all different texts, from two sources or more,
    or in at least ``source_share`` of the texts of one source; never in fewer than ``least`` texts, which would be chance.

    As every line stands in that share of the texts, there are at most (lines of a text on average) / ``share`` of them."""
    by_text = lines.where("n_words > 0").groupBy("line_hash", "text_id").agg(F.min("src").alias("low"), F.max("src").alias("high"))
    by_source = by_text.groupBy("line_hash", "low").agg(F.count("*").alias("d"), F.max("high").alias("high"))
    texts = lines.groupBy("text_id").agg(F.min("src").alias("low"))
    sizes = texts.groupBy("low").agg(F.count("*").alias("of"))
    all_texts = texts.agg(F.count("*").alias("all"))
    x = by_source.join(sizes, "low")
    x = x.groupBy("line_hash").agg(F.sum("d").alias("texts"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.when(F.col("d") >= least, F.col("d") / F.col("of"))).alias("most"))
    x = x.crossJoin(F.broadcast(all_texts)).where((F.col("texts") >= least) & ((F.col("low") != F.col("high")) & (F.col("texts") >= share * F.col("all")) | (F.col("most") >= source_share)))
    return x.select("line_hash", "texts")


def _with_lines(lines: DataFrame, few: DataFrame, largest: int = 200_000, salts: int = 16) -> DataFrame:
    """``lines`` left-joined with the recurring ones: broadcast when a count says that they are few, else with every line
    spread over ``salts`` tasks, so that one that a large part of all documents share is not in one task."""
    if few.limit(largest + 1).count() <= largest:
        return lines.join(F.broadcast(few), "line_hash", "left")
    wide = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_key"), F.lit(salts)).cast("int")).join(wide, ["line_hash", "salt"], "left").drop("salt")


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1e-4, alone: float = 0.8, message_lines: int = 2) -> DataFrame:
    """(doc_key, reason) of the documents that are residue or hold an unfilled placeholder.

    Known messages and filler count as such wherever they stand. A recurring line (see ``recurring``) that no phrase knows is a
    message when at least ``alone`` of the texts that hold it say nothing else but recurring lines and known messages, else
    furniture; a document of nothing but such lines is residue when it has a message among them, which is short, a title and
    a sentence: at most ``message_lines`` different lines. Null and blank texts and null keys give no row; a key that comes with several texts is
    residue when one of them is. Copies of a text count once for recurrence and are judged each.
    """
    lines = cut(line_counts(docs, key, text, source))
    few = cut(recurring(lines, share))
    each = _with_lines(lines, few)
    words, n = F.col("n_words") * F.col("n"), F.col("n")
    plain = (F.col("message") + F.col("filler") == 0) & (F.col("n_words") > 0)
    said = plain & F.col("texts").isNull() & (F.col("n_words") > 1)
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    rest = F.greatest(F.lit(0), F.col("n_words") - F.col("message") - F.col("filler"))
    per = each.groupBy("doc_key", "text_id").agg(
        F.coalesce(F.sum(F.col("message") * n), F.lit(0)).alias("message"),
        F.coalesce(F.sum(F.col("filler") * n), F.lit(0)).alias("filler"),
        (total(said, words) + total((F.col("n_words") > 0) & ~plain, rest * n)).alias("content"),
        F.coalesce(F.max(F.when(said & (n >= 3), n)), F.lit(0)).alias("most"),
        total(said, n).alias("said_lines"),
        F.max(F.col("n_words") < 0).alias("marked"),
    )
    per = cut(per)
    reason = (
        F.when((F.col("filler") > 0) & (F.col("filler") >= F.col("content") + F.col("message")), "filler")
        .when((F.col("message") > 0) & (F.col("message") + F.col("filler") >= F.col("content")), "message")
        .when(F.col("marked"), "placeholder")
        .when((F.col("most") >= 3) & (F.col("most") >= 0.8 * F.col("said_lines")), "repeated line")
    )
    known = per.select("doc_key", reason.alias("reason")).where("reason is not null")
    # documents of nothing but recurring lines and messages: few, and only their lines are looked at again
    bare = per.where("content = 0").select("doc_key", "text_id")
    there = each.where(plain & F.col("texts").isNotNull()).join(bare, ["doc_key", "text_id"], "left_semi").select("doc_key", "text_id", "line_hash", "texts")
    lone = there.groupBy("line_hash", "text_id", "texts").agg(F.lit(1).alias("one")).groupBy("line_hash", "texts").agg(F.count("*").alias("lone"))
    unseen = lone.where(F.col("lone") >= alone * F.col("texts")).select("line_hash")
    told = _with_lines(there.drop("texts"), unseen.withColumn("texts", F.lit(1))).where("texts = 1")
    other = told.groupBy("doc_key", "text_id").agg(F.count("*").alias("k")).where(F.col("k") <= message_lines).select("doc_key", F.lit("recurring message").alias("reason"))
    return known.unionByName(other).groupBy("doc_key").agg(F.min("reason").alias("reason"))
