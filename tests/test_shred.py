from pyspark.sql import functions as F

from quaestor.operators import shred

SCHEMA = "q struct<id:string, meta:struct<course:string>>, c struct<goals:array<string>, parts:array<struct<n:int, tags:array<string>>>, meta:struct<chunk:string>>, object_id string"


def rows(spark):
    a = (("q1", ("k",)), (["x", None, "x", " "], [(1, ["t"]), None], ("c1",)), "z")
    b = (("q2", ("k",)), (["x", None, "x", " "], [(1, ["t"]), None], ("c1",)), "z")
    c = (("q3", None), None, None)
    d = (None, ([], None, None), None)
    return spark.createDataFrame([a, a, b, c, d, (None, None, None)], SCHEMA)


def test_identical_objects_once_and_every_occurrence(spark):
    t = shred.shred(rows(spark), "row")
    assert t["objects:"].count() == 5  # the repeated record once
    assert t["objects:q.meta"].count() == 1  # shared by q1 and q2
    assert t["objects:c"].count() == 2
    assert shred.spine(rows(spark), "row").agg(F.sum("copies")).first()[0] == 6
    e = t["elements:c.goals"].orderBy("ordinal").collect()
    assert [(r["ordinal"], r["value"]) for r in e] == [(1, "x"), (2, None), (3, "x"), (4, " ")]
    assert e[0]["child_id"] == e[2]["child_id"] and e[1]["child_id"] is None
    p = t["elements:c.parts"].orderBy("ordinal").collect()
    assert p[0]["value"]["n"] == 1 and p[1]["value"] is None
    b = t["bridge"].groupBy("parent", "field").count().collect()
    assert {(r[0], r[1]): r[2] for r in b} == {
        ("row", "q"): 3, ("row", "c"): 3, ("row__q", "meta"): 2, ("row__c", "meta"): 1, ("row__c", "goals"): 4, ("row__c", "parts"): 2, ("row__c__parts[]", "tags"): 1,
    }
    assert t["values:c.goals[]"].count() == 2 and t["values:c.parts[].tags[]"].collect()[0]["value"] == "t"
    assert sorted(r["copies"] for r in t["occurrences"].collect()) == [1, 1, 1, 1, 2]


def test_identity_ignores_field_order_and_partitioning(spark):
    x = spark.createDataFrame([((1, "a"),)], "s struct<a:int, b:string>")
    y = spark.createDataFrame([(("a", 1),)], "s struct<b:string, a:int>")
    assert shred.objects(x, "s").first()["object_id"] == shred.objects(y, "s").first()["object_id"]
    ids = lambda df: {r["object_id"] for r in shred.objects(df, "q").collect()}
    assert ids(rows(spark)) == ids(rows(spark).repartition(3))


def test_links_rebuild_the_records(spark):
    df = rows(spark)
    s = shred.spine(df, "row")
    q = shred.objects(df, "q").select(F.col("object_id").alias("row__q"), "id")
    m = shred.objects(df, "q.meta").select(F.col("object_id").alias("row__q__meta"), "course")
    got = {(r["id"], r["course"]) for r in s.join(q, "row__q", "left").join(m, "row__q__meta", "left").collect()}
    assert got == {("q1", "k"), ("q2", "k"), ("q3", None), (None, None)}


def test_empty_table_and_maps(spark):
    assert all(x.count() == 0 for x in shred.shred(rows(spark).limit(0)).values())
    a = spark.createDataFrame([({"x": 1, "y": 2},)], "m map<string,int>").select(F.struct("m").alias("s"))
    b = spark.createDataFrame([({"y": 2, "x": 1},)], "m map<string,int>").select(F.struct("m").alias("s"))
    assert shred.spine(a, "r").first()["r"] == shred.spine(b, "r").first()["r"]


def test_long_text_and_clashing_column(spark):
    df = spark.createDataFrame([(("y" * 500_000,), "own")], "s struct<object_id:string>, object_id string")
    assert len(shred.objects(df, "s").first()["object_id_"]) == 500_000


DEEP = "k int, o struct<xs:array<struct<a:int, b:array<struct<c:string, m:map<string,struct<z:int>>>>, n:array<array<int>>>>>"


def deep(spark):
    b1, b2 = ("p", {"u": (1,), "v": None}), ("q", {})
    rows = [(1, ([(10, [b1, None, b2], [[1, 2], [], None]), (11, [b1], None)],)), (2, ([(10, [b1, None, b2], [[1, 2], [], None]), None],)), (3, None), (4, ([],)), (1, ([(10, [b1, None, b2], [[1, 2], [], None]), (11, [b1], None)],))]
    return spark.createDataFrame(rows, DEEP)


def test_arrays_of_objects_are_rebuilt_from_the_flat_tables_alone(spark):
    df = deep(spark)
    t = {k: v.collect() for k, v in shred.shred(df, "row").items()}
    assert len(t["objects:o.xs[]"]) == 2 and len(t["objects:o.xs[].b[]"]) == 2  # equal objects once
    links = {}
    for r in t["bridge"]:
        links.setdefault((r["parent_id"], r["field"]), {})[r["ordinal"]] = (r["key"], r["child_id"])
    table = lambda name: {r["object_id"]: r.asDict() for r in t[name]}
    many = lambda pid, field, make: [None if links[pid, field][i][1] is None else make(links[pid, field][i][1]) for i in sorted(links.get((pid, field), {}))]
    z, c, a, ints, rec = table("objects:o.xs[].b[].m{}"), table("objects:o.xs[].b[]"), table("objects:o.xs[]"), table("values:o.xs[].n[][]"), table("objects:")
    make_b = lambda i: {"c": c[i]["c"], "m": {k: z[v]["z"] if v else None for k, v in links.get((i, "m"), {}).values()}}
    make_n = lambda i: many(i, "", lambda v: ints[v]["value"])
    make_x = lambda i: {"a": a[i]["a"], "b": many(i, "b", make_b), "n": many(i, "n", make_n)}
    got = []
    for r in t["occurrences"]:
        o = links.get((r["object_id"], "o"), {})
        got += [(rec[r["object_id"]]["k"], many(o[1][1], "xs", make_x) if o else None)] * r["copies"]

    def plain(x):
        return {"a": x["a"], "b": [None if b is None else {"c": b["c"], "m": {k: v["z"] if v else None for k, v in b["m"].items()}} for b in x["b"] or []], "n": x["n"] or []}

    want = [(r["k"], None if r["o"] is None else [None if x is None else plain(x) for x in r["o"]["xs"]]) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flat_records_have_no_links(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "n int, s string")
    t = shred.shred(df)
    assert t["bridge"].count() == 0 and t["objects:"].count() == 2 and t["occurrences"].agg(F.sum("copies")).first()[0] == 3


def test_tags_are_the_identities(spark):
    df = deep(spark)
    x = df.select(shred.tagged(F.col("o"), df.schema["o"].dataType)["id"].alias("a"), shred.identity(F.col("o"), df.schema["o"].dataType).alias("b"))
    assert all(r["a"] == r["b"] for r in x.collect())
