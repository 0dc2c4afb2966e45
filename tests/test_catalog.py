import json

import pytest
from pyspark.sql import functions as F

from parley import functions as fn
from parley import operators as op
from parley import sources as io

CARD = "model STRING, dataset STRING, info STRING"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_splits(spark):
    catalog = spark.createDataFrame(
        [
            ("a", "x", "test"), ("a", "x", "train"), ("a", "y", "test"), ("a", "y", "dev"),
            ("b", None, "dev"), ("c", "x", None),
        ],
        "dataset STRING, config STRING, split STRING",
    )
    assert rows(op.select_split(catalog), "dataset", "config", "split") == sorted(
        [("a", "x", "train"), ("a", "y", "test"), ("b", None, "train"), ("c", "x", "train")], key=repr
    )
    other = op.select_split(catalog, default="all").where("dataset = 'b'")
    assert other.first().split == "all"


def test_configs(spark):
    catalog = spark.createDataFrame(
        [("a", "y", 1), ("a", "x", 0), ("b", "p", 0), ("c", "q", 3), ("c", "r", 2), ("d", None, 0)],
        "dataset STRING, config STRING, position INT",
    )
    saved = spark.createDataFrame([("b", "kept"), ("z", "old"), ("c", None)], "dataset STRING, config STRING")
    resolved = op.resolve_config(catalog, saved)
    assert rows(resolved, "dataset", "config") == [
        ("a", "x"), ("b", "kept"), ("c", None), ("d", None)
    ]
    recorded = op.record_configs(saved, resolved)
    assert rows(recorded, "dataset", "config") == [
        ("a", "x"), ("b", "kept"), ("c", None), ("d", None), ("z", "old")
    ]


def test_file_patterns(spark):
    names = ["a.json", "x/y.csv", "p.parquet", "z.zip", "a.JSON", "b.json.gz", "c_json", "100%.csv"]
    listing = spark.createDataFrame([(n,) for n in names], "path STRING")
    got = [r.path for r in op.filter_files(listing).collect()]
    assert got == ["a.json", "x/y.csv", "p.parquet", "z.zip", "100%.csv"]
    assert [r.path for r in op.filter_files(listing, ["c_json", "?.zip", "100%*"]).collect()] == [
        "z.zip", "c_json", "100%.csv",
    ]
    with pytest.raises(ValueError):
        op.filter_files(listing, ["[ab].json"])


def test_upsert(spark):
    card = spark.createDataFrame(
        [("m1", "old", "x"), ("m2", "kept", "y"), ("m3", None, "")], CARD
    )
    models = spark.createDataFrame([("m1",), ("new",), ("m1",)], "model STRING")
    datasets = spark.createDataFrame([("d1",), ("d2",), ("d1",)], "dataset STRING")
    got = rows(op.upsert_manifest(card, models, datasets), "model", "dataset", "info")
    assert got == sorted(
        [
            ("m1", "d1", ""), ("m1", "d2", ""), ("new", "d1", ""), ("new", "d2", ""),
            ("m2", "kept", "y"), ("m3", None, ""),
        ],
        key=repr,
    )
    got = rows(op.upsert_manifest(card, models, datasets.limit(0)), "model", "dataset")
    assert got == sorted([("m1", None), ("new", None), ("m2", "kept"), ("m3", None)], key=repr)
    assert op.upsert_manifest(card, models.limit(0), datasets).count() == 3


def test_manifest_files(spark, tmp_path):
    card = {"model": {"m/1": {"d/1": "", "d2": "cols"}, "empty": {}, 'q"': {"é": "x"}}}
    want = sorted(
        [("m/1", "d/1", ""), ("m/1", "d2", "cols"), ("empty", None, None), ('q"', "é", "x")], key=repr
    )
    path = tmp_path / "card.json"
    path.write_text(json.dumps(card, ensure_ascii=False, indent=4))
    read = io.read_manifest(spark, str(path))
    assert rows(read, "model", "dataset", "info") == want

    io.write_manifest(read, str(tmp_path / "lines"))
    again = io.read_manifest(spark, str(tmp_path / "lines"))
    assert rows(again, "model", "dataset", "info") == want

    io.write_manifest(read, str(tmp_path / "one"), lines=False)
    document = json.loads(io.single_document(read).first().value)
    assert document == card
    one = io.read_manifest(spark, str(tmp_path / "one"))
    assert rows(one, "model", "dataset", "info") == want


def test_unreadable_manifests_are_empty(spark, tmp_path):
    assert io.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    broken = tmp_path / "broken.json"
    broken.write_text("{not json")
    assert io.read_manifest(spark, str(broken)).count() == 0
    assert io.read_configs(spark, str(broken)).count() == 0
    assert io.read_configs(spark, str(tmp_path / "none.json")).count() == 0


def test_manifests_in_many_forms_and_files(spark, tmp_path):
    """Indented, in one line, in lines, and what is no card, side by side."""
    folder = tmp_path / "cards"
    folder.mkdir()
    (folder / "indented.json").write_text(json.dumps({"model": {"a": {"1": ""}}}, indent=2))
    (folder / "single.json").write_text(json.dumps({"model": {"b": {"2": "", "3": ""}}}))
    lines = [json.dumps({"model": {f"c{i}": {"x": ""}}}) for i in range(20)]
    (folder / "lines.json").write_text("\n".join(lines[:10]) + "\n\n")
    (folder / "more.json").write_text("\n".join(lines[10:]))
    (folder / "broken.json").write_text(lines[0] + "\n{")
    (folder / "other.json").write_text('{"a": "x"}')
    assert io.read_manifest(spark, str(folder)).count() == 24
    unread = {(r.file.rsplit("/", 1)[-1], r.value) for r in io.unparsed_manifest(spark, str(folder)).collect()}
    assert unread == {("broken.json", "{"), ("other.json", '{"a": "x"}')}
    configs = tmp_path / "configs"
    configs.mkdir()
    for i in range(2):
        (configs / f"{i}.json").write_text("\n".join(json.dumps({f"d{i}{j}": "c"}) for j in range(10)))
    (configs / "indented.json").write_text(json.dumps({"e": None}, indent=2))
    (configs / "bad.json").write_text("[")
    assert io.read_configs(spark, str(configs)).count() == 21
    assert [r.value for r in io.unparsed_configs(spark, str(configs)).collect()] == ["["]
    assert io.unparsed_manifest(spark, str(tmp_path / "none")).count() == 0


def test_config_files(spark, tmp_path):
    path = tmp_path / "configs.json"
    path.write_text(json.dumps({"a": "x", "b/c": None}, indent=4))
    saved = io.read_configs(spark, str(path))
    assert rows(saved, "dataset", "config") == [("a", "x"), ("b/c", None)]
    io.write_configs(saved, str(tmp_path / "lines"))
    again = io.read_configs(spark, str(tmp_path / "lines"))
    assert rows(again, "dataset", "config") == [("a", "x"), ("b/c", None)]


def test_names(spark):
    names = ["org/data", "data", "a/b/c", "x/custom_models/my", "custom_models", "C:\\custom_models\\my"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    n = F.col("n")
    got = df.select(
        fn.dataset_dir(n), fn.formatted_name(n), fn.formatted_name(n, union=True), fn.checkpoint_name(n)
    ).collect()
    assert [r[0] for r in got][:3] == ["data", "data", "c"]
    assert [r[1] for r in got][:3] == ["org_data_formatted", "data_formatted", "a_b_c_formatted"]
    assert [r[2] for r in got][0] == "concat_org_data_formatted"
    assert [r[3] for r in got] == ["org_data", "data", "a_b_c", "my", "custom_models", "my"]


def test_routes(spark):
    sets = [["conversations"], ["conversations", "image"], ["images"], ["image_size", "conversations"], ["x"]]
    df = spark.createDataFrame([(s,) for s in sets], "c ARRAY<STRING>")
    got = df.select(
        fn.route_task(F.col("c")), fn.route_task(F.array_join("c", ","), substring=True)
    ).collect()
    text, vision = "text-generation", "text-vision-text-generation"
    assert [r[0] for r in got] == [text, vision, vision, text, None]
    assert [r[1] for r in got] == [text, vision, vision, vision, None]
