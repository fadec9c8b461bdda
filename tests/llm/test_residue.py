from pyspark.sql import functions as F

from quaestor.llm import residue

PROSE = "The rate of the reaction grows with the temperature, because more particles have the energy that is needed. We return to this in the next lecture."
BAD = {
    1: "Menu\nHelp\n404 Not Found\nThe requested file lens_5eec7a.pdf could not be delivered.\nSite map",
    2: "Please enable JavaScript to view this page.",
    3: "Lorem ipsum dolor sit amet consectetur adipiscing elit. Sed do eiusmod tempor.",
    4: "Click to edit this paragraph.\nClick to edit this paragraph.",
    5: f"{PROSE}\nThis unit was revised in {{{{ term }}}} by the office.",
    6: "Welcome to [INSERT COURSE TITLE HERE]",
    7: "Week 1: TODO\nWeek 2: ???",
    8: "Erreur 404 : la page demandée est introuvable.",
    9: "Bitte aktivieren Sie JavaScript in Ihrem Browser.",
    10: "Traceback (most recent call last):\n  File \"render_1f.py\", line 3, in build\nKeyError: 'room'",
    11: "Kurs: %%TITEL%%\nRaum: [RAUM EINTRAGEN]",
    12: "Heading 1 / Body\nHeading 1 / Body\nHeading 1 / Body",
}
GOOD = {
    101: PROSE,
    102: f"{PROSE} A server answers with the status 404 Not Found when the page does not exist.",
    103: f"{PROSE} Designers often use filler such as lorem ipsum to judge a layout.",
    104: f"{PROSE} A template engine reads a mark such as {{{{ name }}}} and puts the value in its place.",
    105: f"{PROSE} In a shell script ${{total}} stands for the value of the variable.",
    106: "Fill in the blank: the log of a token is called its ________.",
    107: "Short note.",
    108: f"Menu\nHelp\n{PROSE}\nSite map",
    109: "- stable value at 3.1\n- lower rate at 4.5\n- upper rate at 5.5",
    110: None,
    111: "",
    112: " \n ",
    113: "Let {x} be a set and x_{max} its largest element, a < b > c.",
    114: PROSE * 3000,
}


def docs(spark, extra=()):
    rows = [(k, t, "ab"[k % 2]) for k, t in {**BAD, **GOOD}.items()]
    rows += [(1000 + i, f"Menu\nHelp\n{PROSE} Part {i}.\nSite map", "abc"[i % 3]) for i in range(9)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, source string")


def test_found_and_kept(spark):
    extra = [(1, BAD[1], "a"), (None, BAD[2], "a"), (50, BAD[2], None), (51, BAD[2], "b")]
    df = docs(spark, extra).withColumn("kind", F.lit("clash")).withColumn("norm", F.lit("clash")).withColumn("line", F.lit("clash"))
    got = {r["doc_key"]: r["reason"] for r in residue.residue(df).collect()}
    assert set(got) == {*BAD, 50, 51}
    assert got[5] == got[6] == got[7] == got[11] == "placeholder" and got[3] == got[4] == "filler" and got[1] == "message"


def test_masks(spark):
    x = spark.createDataFrame([("Request id: 16a3322637 on 2026-01-02 at Page  7",), ("mail a@b.org or https://x.org/y",)], "l string")
    assert [r[0] for r in x.select(residue.normalised(F.col("l"))).collect()] == ["request id: # on <date> at page #", "mail <addr> or <addr>"]


def test_empty_and_partitioning(spark):
    assert residue.residue(docs(spark).limit(0)).count() == 0
    a = sorted(map(tuple, residue.residue(docs(spark)).collect()))
    assert a == sorted(map(tuple, residue.residue(docs(spark).repartition(7)).collect()))


def test_recurring_message_of_unseen_wording(spark):
    """No phrase knows the line; it recurs over sources and never stands beside content. Menus do, and are furniture."""
    extra = [(2000 + i, f"Menu\nHelp\nThe room of this unit has moved behind the wall ({i}f3c{i}).\nSite map", "abc"[i % 3]) for i in range(5)]
    other = ["Heat flows from the warm body to the cold one.", "A proof by cases is often the longest.", "Rivers carry more sand in spring.", "The index falls when prices do.", "Cells divide.", "A norm is convex.", "Verbs agree with nouns.", "Light bends in glass."]
    extra += [(2500 + i, f"Menu\nHelp\n{t}\nSite map", "ab"[i % 2]) for i, t in enumerate(other)]
    extra += [(3000, "Menu\nHelp\nSite map", "a"), (3001, "A line that stands alone once.", "b")]
    got = {r["doc_key"]: r["reason"] for r in residue.residue(docs(spark, extra)).collect()}
    assert {k for k in got if k >= 2000} == {2000 + i for i in range(5)} and got[2000] == "recurring message"


def test_copies_of_a_real_text_do_not_recur(spark):
    extra = [(4000 + i, "A short real text of one line only, copied often.", "abc"[i % 3]) for i in range(30)]
    assert not {r["doc_key"] for r in residue.residue(docs(spark, extra)).collect()} & set(range(4000, 4030))


def test_messages_in_one_long_line_and_wrapped_filler(spark):
    long = "Oops! 404 not found. " + "The requested file lens_5eec7a.pdf could not be delivered. Please try again later. " * 4 + "You do not have permission to see this page."
    wrapped = "sed do eiusmod tempor incididunt ut labore et dolore magna aliqua\nut enim ad minim veniam quis nostrud"
    digits = " ".join(f"the {i} of {i * 7}" for i in range(120))
    got = {r["doc_key"]: r["reason"] for r in residue.residue(docs(spark, [(5000, long, "a"), (5001, wrapped, "b"), (5002, digits, "a"), (5003, "blah blah blah blah", "a")])).collect()}
    assert got[5000] == "message" and got[5001] == "filler" and 5002 not in got and got[5003] == "filler"


def test_long_lines_are_masked_like_short_ones(spark):
    text = "on 2026-01-02 the id was 16a3322637 " * 20
    row = spark.createDataFrame([(text,)], "l string").select(residue.normalised(F.col("l"))).first()[0]
    assert row == ("on <date> the id was # " * 20).strip()
