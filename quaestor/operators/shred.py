"""Nested records as related flat tables, with Merkle identities.

Every object gets the hash of its canonical form, built bottom-up: scalars by value, arrays by the hashes of their
elements in order, structs by the hashes of their fields in name order. Equal subtrees have equal identities whatever
row they came from, so each object is stored once; bridge rows (parent, field, ordinal, child) keep every occurrence.

Paths: ``a.b`` is field b of struct a, ``a[]`` stands for the entries of array a and ``a{}`` for the values of map a, to any
depth (``a[].b[][].c``). In names of parents the parts are joined by ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identity(c: Column, kind: T.DataType) -> Column:
    """The Merkle identity of a value; null where the value is null. Field order, and null against absent fields, do not matter."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f.name + "="), identity(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.sha2(F.concat_ws("\x1f", F.lit("{"), *parts), 256))
    if isinstance(kind, T.ArrayType):
        each = F.transform(c, lambda x: F.coalesce(identity(x, kind.elementType), F.lit("null")))
        return F.when(c.isNotNull(), F.sha2(F.concat_ws("\x1f", F.lit("["), each), 256))
    if isinstance(kind, T.MapType):
        entry = F.transform(
            F.array_sort(F.map_entries(c)) if not isinstance(kind.valueType, T.MapType) else F.map_entries(c),
            lambda e: F.concat(F.coalesce(identity(e["key"], kind.keyType), F.lit("null")), F.lit("\x1e"), F.coalesce(identity(e["value"], kind.valueType), F.lit("null"))),
        )
        return F.when(c.isNotNull(), F.sha2(F.concat_ws("\x1f", F.lit("<"), F.array_sort(entry)), 256))
    return F.when(c.isNotNull(), F.sha2(F.concat(F.lit(kind.simpleString() + ":"), c.cast("string")), 256))


def _is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _let(c: Column, then) -> Column:
    return F.transform(F.array(c), then).getItem(0)


def tagged(c: Column, kind: T.DataType) -> Column:
    """The value as a tree of (id, v): every object carries its identity, made of the identities of its parts, so that each
    level is hashed once. Structs keep their fields, arrays become arrays of tagged entries and maps arrays of (key, id, v)
    in the order of their keys; null where the value is null. The identities are those of ``identity``."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[tagged(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]) if kind.fields else F.struct(F.lit(None).cast("string").alias("none"))
        order = sorted(range(len(kind.fields)), key=lambda i: kind.fields[i].name)
        made = _let(inner, lambda s: F.struct(_sha(F.lit("{"), *[F.concat(F.lit(kind.fields[i].name + "="), s.getField(f"f{i}").getField("id")) for i in order]).alias("id"), s.alias("v")))
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: tagged(x, kind.elementType))
        return F.when(c.isNotNull(), _let(items, lambda a: F.struct(_sha(F.lit("["), F.transform(a, lambda x: F.coalesce(x.getField("id"), F.lit("null")))).alias("id"), a.alias("v"))))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(
            F.coalesce(identity(e["key"], kind.keyType), F.lit("null")).alias("k"), e["key"].cast("string").alias("key"), tagged(e["value"], kind.valueType).alias("e")
        )
        pairs = F.array_sort(F.transform(F.map_entries(c), entry), lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
        line = lambda x: F.concat(x["k"], F.lit("\x1e"), F.coalesce(x["e"].getField("id"), F.lit("null")))
        return F.when(c.isNotNull(), _let(pairs, lambda a: F.struct(_sha(F.lit("<"), F.array_sort(F.transform(a, line))).alias("id"), a.alias("v"))))
    return F.when(c.isNotNull(), F.struct(identity(c, kind).alias("id"), c.alias("v")))


def _record(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{f.name}`") for f in df.schema.fields])


def records(df: DataFrame) -> DataFrame:
    """(node): every row as a tagged tree."""
    return df.select(tagged(_record(df), df.schema).alias("node"))


def spine(df: DataFrame, root: str = "record") -> DataFrame:
    """One row per distinct record: the identities of the record and of every struct reached without an array, and
    ``copies``, how often the record came. Column names are the paths with ``__`` between the fields. Only hashes are shuffled."""
    cols = []

    def walk(c: Column, k: T.StructType, path: str) -> None:
        cols.append(c.getField("id").alias(path))
        for i, f in enumerate(k.fields):
            if isinstance(f.dataType, T.StructType):
                walk(c.getField("v").getField(f"f{i}"), f.dataType, f"{path}__{f.name}")

    walk(F.col("node"), df.schema, root)
    wide = records(df).select(*cols)
    return wide.groupBy(*wide.columns).agg(F.count("*").alias("copies"))


def _steps(path: str) -> list[str]:
    out = []
    for part in [p for p in path.split(".") if p]:
        name = part.rstrip("[]{}")
        out += [name, *[part[len(name) :][i : i + 2] for i in range(0, len(part) - len(name), 2)]]
    return out


def _at(df: DataFrame, path: str) -> tuple[DataFrame, T.DataType]:
    """(node) of every value at a path, with its type. Null values are left out."""
    rows, kind = df.select(_record(df).alias("_v")), df.schema
    for s in _steps(path):
        if s == "[]":
            rows, kind = rows.select(F.explode("_v").alias("_v")), kind.elementType
        elif s == "{}":
            rows, kind = rows.select(F.explode(F.map_values("_v")).alias("_v")), kind.valueType
        else:
            rows, kind = rows.select(F.col("_v").getField(s).alias("_v")), kind[s].dataType
    return rows.select(tagged(F.col("_v"), kind).alias("node")).where("node is not null"), kind


def objects(df: DataFrame, path: str = "") -> DataFrame:
    """The distinct objects at a struct path (the record itself for ""): (object_id, its scalar fields).

    Empty input gives an empty table; null objects are no objects. A field called ``object_id`` is renamed ``object_id_``."""
    rows, kind = _at(df, path)
    taken = lambda n: n + "_" if n == "object_id" else n
    scalars = [F.col("node").getField("v").getField(f"f{i}").getField("v").alias(taken(f.name)) for i, f in enumerate(kind.fields) if _is_scalar(f.dataType)]
    rows = rows.select(F.col("node").getField("id").alias("object_id"), *scalars)
    names = [x for x in rows.columns if x != "object_id"]
    return rows.groupBy("object_id").agg(*[F.first(F.col(f"`{n}`")).alias(n) for n in names]) if names else rows.distinct()


def values(df: DataFrame, path: str) -> DataFrame:
    """The distinct scalars at a path that ends in ``[]`` or ``{}``: (object_id, value)."""
    rows, _ = _at(df, path)
    return rows.select("node.id", "node.v").groupBy(F.col("id").alias("object_id")).agg(F.first("v").alias("value"))


def elements(df: DataFrame, path: str) -> DataFrame:
    """The entries of the array at a path, tied to the object that holds it: (parent_id, ordinal, child_id, value).

    ``ordinal`` counts from 1 in the stored order; null entries keep theirs and have a null child. Equal parents are
    the same object, so each (parent, ordinal) comes once. Struct entries give their scalar fields as a struct; what lies
    deeper has tables and bridge rows of its own."""
    front, _, last = path.rpartition(".")
    rows, kind = _at(df, front)
    i = [f.name for f in kind.fields].index(last)
    element = kind[last].dataType.elementType
    x = rows.select(F.col("node.id").alias("parent_id"), F.posexplode(F.col("node").getField("v").getField(f"f{i}").getField("v")).alias("pos", "e"))
    v = F.col("e").getField("v")
    if isinstance(element, T.StructType):
        fields = [v.getField(f"f{j}").getField("v").alias(f.name) for j, f in enumerate(element.fields) if _is_scalar(f.dataType)]
        v = F.when(F.col("e").isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    elif not _is_scalar(element):
        v = F.lit(None)
    rows = x.select("parent_id", (F.col("pos") + 1).cast("int").alias("ordinal"), F.col("e").getField("id").alias("child_id"), v.alias("value"))
    return rows.groupBy("parent_id", "ordinal").agg(F.first("child_id").alias("child_id"), F.first("value").alias("value"))


LINK = "array<struct<parent:string,field:string,parent_id:string,ordinal:int,key:string,child_id:string>>"


def _links(c: Column, kind: T.DataType, path: str) -> Column | None:
    """All links below a tagged value, as one array; None where the type has none."""
    link = lambda field, ordinal, key, child: F.struct(
        F.lit(path).alias("parent"), F.lit(field).alias("field"), c.getField("id").alias("parent_id"), ordinal.cast("int").alias("ordinal"), key.cast("string").alias("key"), child.getField("id").alias("child_id")
    )
    nothing, none = F.lit(None), F.array().cast(LINK)
    out = []

    def entries(held: Column, sort: T.DataType, field: str, below: str) -> None:
        if isinstance(sort, T.MapType):
            out.append(F.transform(held, lambda x, i: link(field, i + 1, x["key"], x["e"])))
            deep = lambda x: _links(x["e"], sort.valueType, below + "{}")
        else:
            out.append(F.transform(held, lambda x, i: link(field, i + 1, nothing, x)))
            deep = lambda x: _links(x, sort.elementType, below + "[]")
        inner = sort.valueType if isinstance(sort, T.MapType) else sort.elementType
        if not _is_scalar(inner):
            out.append(F.flatten(F.transform(held, lambda x: F.coalesce(deep(x), none))))

    if isinstance(kind, T.StructType):
        for i, f in enumerate(kind.fields):
            held = c.getField("v").getField(f"f{i}")
            if isinstance(f.dataType, T.StructType):
                out += [F.when(held.isNotNull(), F.array(link(f.name, F.lit(1), nothing, held))), F.coalesce(_links(held, f.dataType, f"{path}__{f.name}"), none)]
            elif not _is_scalar(f.dataType):
                entries(held.getField("v"), f.dataType, f.name, f"{path}__{f.name}")
    elif not _is_scalar(kind):
        entries(c.getField("v"), kind, "", path)
    return F.concat(none, *[F.coalesce(x.cast(LINK), none) for x in out])


def bridge(df: DataFrame, root: str = "record") -> DataFrame:
    """(parent, field, parent_id, ordinal, key, child_id): every link from an object to what it holds: structs (ordinal 1),
    entries of arrays in their stored order (null entries keep their ordinal and have a null child) and values of maps in
    the order of the identities of their keys (``key``). One read of the table; flat records have no links."""
    links = records(df).select(F.explode(_links(F.col("node"), df.schema, root)).alias("l")).select("l.*")
    return links.distinct()


def shred(df: DataFrame, root: str = "record") -> dict[str, DataFrame]:
    """All flat tables of ``df``: `objects:<path>` for structs wherever they stand, `values:<path>` for scalars in arrays and
    maps, `elements:<path>` for arrays in structs, `bridge`, and `occurrences` (object_id, copies) of the records."""
    out: dict[str, DataFrame] = {"bridge": bridge(df, root), "occurrences": spine(df, root).groupBy(F.col(root).alias("object_id")).agg(F.sum("copies").alias("copies"))}

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            out[f"objects:{path}"] = objects(df, path)
            for f in kind.fields:
                at = f"{path}.{f.name}" if path else f.name
                if isinstance(f.dataType, T.ArrayType):
                    out[f"elements:{at}"] = elements(df, at)
                if not _is_scalar(f.dataType):
                    walk(f.dataType, at)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            below, at = (kind.elementType, path + "[]") if isinstance(kind, T.ArrayType) else (kind.valueType, path + "{}")
            if _is_scalar(below):
                out[f"values:{at}"] = values(df, at)
            walk(below, at)

    walk(df.schema, "")
    return out
