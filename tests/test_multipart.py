from pyspark.sql import functions as F

from quaestor.operators import annotate, rules
from quaestor.plans import all_queries


def test_two_tasks_joined_by_and(spark):
    want = {"Define osmosis and explain its use.": 0.5, "Define osmosis.": 1.0, "Cats and dogs.": 1.0, "Define x and y and z.": 0.5, "Define x and explain y or compare z.": 0.0, "What? Why? How?": 0.0, "": 1.0}
    df = rules.annotate(spark.createDataFrame([(t,) for t in want], "text string"))
    got = {r[0]: r[1] for r in df.select("text", annotate.multipart_question(F.col("tokens"), F.col("text"))).collect()}
    assert got == want
    assert "multipart_question_annotated" in all_queries()
