import pytest

from parley import operators as op


def test_missing_columns_are_null(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "id INT, a STRING")
    b = spark.createDataFrame([("y", 2)], "b STRING, id INT")
    out = op.union_datasets(a, b)
    assert out.columns == ["id", "a", "b"]
    assert sorted(tuple(r) for r in out.collect() if r.a) == [(1, "x", None)] * 2
    assert [tuple(r) for r in out.where("a IS NULL").collect()] == [(2, None, "y")]
    assert op.column_set(a, b) == ["a", "b", "id"]


def test_clash(spark):
    a = spark.createDataFrame([(1, 5)], "id INT, x BIGINT")
    b = spark.createDataFrame([(2, "five")], "id INT, x STRING")
    with pytest.raises(op.TypeClash):
        op.union_datasets(a, b)
    out = op.union_datasets(a, b, on_clash="string")
    assert sorted(r.x for r in out.collect()) == ["5", "five"]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("int", "bigint", "bigint"), ("tinyint", "smallint", "smallint"), ("int", "double", "double"), ("smallint", "float", "float"),
        ("int", "float", "double"), ("bigint", "double", "string"), ("float", "double", "double"), ("bigint", "decimal(10,2)", "decimal(21,2)"),
        ("decimal(38,0)", "decimal(10,5)", "string"), ("date", "timestamp", "timestamp"), ("int", "string", "string"), ("void", "int", "int"),
        ("array<int>", "array<bigint>", "array<bigint>"), ("map<string,int>", "map<string,double>", "map<string,double>"),
        ("struct<a:int,b:struct<x:int>>", "struct<b:struct<y:string,x:bigint>,c:date>", "struct<a:int,b:struct<x:bigint,y:string>,c:date>"),
        ("struct<a:int>", "array<int>", "string"), ("boolean", "int", "string"),
    ],
)
def test_common_type(spark, a, b, want):
    left, right = (spark.createDataFrame([], f"x {t}").schema["x"].dataType for t in (a, b))
    assert op.common_type(left, right).simpleString() == want
    mirrored = op.common_type(right, left)
    assert sorted(mirrored.simpleString()) == sorted(want)
    union = op.union_datasets(spark.createDataFrame([(None,)], f"x {a}"), spark.createDataFrame([(None,)], f"x {b}"), "widen")
    assert [r.x for r in union.collect()] == [None, None]


def test_widened_values(spark):
    a = spark.sql("SELECT 1 AS id, named_struct('p', 2, 'q', array(named_struct('r', 3))) AS x UNION ALL SELECT 2, NULL")
    b = spark.sql("SELECT 3000000000 AS id, named_struct('q', array(named_struct('r', 'y', 's', true), NULL)) AS x")
    out = {r.id: r.x.asDict(True) if r.x else None for r in op.union_datasets(a, b, "widen").collect()}
    assert out == {
        1: {"p": 2, "q": [{"r": "3", "s": None}]}, 2: None,
        3_000_000_000: {"p": None, "q": [{"r": "y", "s": True}, None]},
    }
    c = spark.sql("SELECT 5 AS id, array(1) AS x")
    assert {r.x for r in op.union_datasets(a, c, "widen").collect()} == {'{"p":2,"q":[{"r":3}]}', None, "[1]"}
