import zipfile

from pyspark.sql import functions as F

from parley import functions as fn
from parley import operators as op
from parley import sources as io

LISTING = [
    ("zip", "/d/z.zip/a.jpg", "a.jpg"),
    ("folder", "/d/y/a.jpg", "a.jpg"),
    ("folder", "/d/x/a.jpg", "a.jpg"),
    ("top", "/d/b.png", "b.png"),
    ("folder", "/d/x/b.png", "b.png"),
    ("zip", "/d/z.zip/in/c.jpeg", "in/c.jpeg"),
    ("top", "/d/s.wav", "s.wav"),
    ("top", "/d/t.txt", "t.txt"),
]


def listing(spark):
    return spark.createDataFrame(LISTING, "place STRING, path STRING, name STRING")


def test_first_place_then_first_path(spark):
    names = ["a.jpg", "b.png", "in/c.jpeg", "s.wav", "t.txt", "none.jpg", "a"]
    refs = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "id INT, pos INT, ref STRING")
    got = {r.ref: (r.place, r.path, r.kind) for r in op.resolve_media(refs, listing(spark)).collect()}
    assert got == {
        "a.jpg": ("folder", "/d/x/a.jpg", "image"),
        "b.png": ("top", "/d/b.png", "image"),
        "in/c.jpeg": ("zip", "/d/z.zip/in/c.jpeg", "image"),
        "s.wav": ("top", "/d/s.wav", "audio"),
        "t.txt": ("top", "/d/t.txt", None),
    }
    left = op.resolve_media(refs, listing(spark), "left")
    assert left.count() == len(names)
    assert left.where("path IS NULL").count() == 2


def test_hot_name_joins_one_to_one(spark):
    """Many rows refer to one name that many files have."""
    refs = spark.range(2000).select("id", F.lit(0).alias("pos"), F.lit("a.jpg").alias("ref"))
    files = spark.range(2000).select(
        F.lit("folder").alias("place"),
        F.format_string("/d/%05d/a.jpg", "id").alias("path"),
        F.lit("a.jpg").alias("name"),
    )
    got = op.resolve_media(refs, files)
    assert got.count() == 2000
    assert [r[0] for r in got.select("path").distinct().collect()] == ["/d/00000/a.jpg"]


def test_references(spark):
    df = spark.createDataFrame(
        [(1, "a.jpg", ["x", None, "y"]), (2, None, []), (3, "b.png", None)],
        "id INT, image STRING, audios ARRAY<STRING>",
    )
    scalar = sorted(tuple(r) for r in op.explode_media(df, "id", "image").collect())
    assert scalar == [(1, 0, "a.jpg"), (3, 0, "b.png")]
    lists = sorted(tuple(r) for r in op.explode_media(df, "id", "audios").collect())
    assert lists == [(1, 0, "x"), (1, 2, "y")]


def test_readable_rows(spark):
    rows = [
        (1, ["a.jpg", "b.png"]),
        (2, ["a.jpg", "none.jpg"]),
        (3, ["s.wav"]),
        (4, []),
        (5, None),
    ]
    df = spark.createDataFrame(rows, "id INT, images ARRAY<STRING>")

    def kept(require):
        out = op.keep_readable(df, "id", ["images"], listing(spark), require)
        return sorted(r.id for r in out.collect())

    assert kept("all") == [1]
    assert kept("any") == [1, 2]


def test_one_readable_column_is_enough(spark):
    df = spark.createDataFrame(
        [(1, "a.jpg", "s.wav"), (2, "none.jpg", "s.wav")], "id INT, image STRING, audio STRING"
    )
    out = op.keep_readable(df, "id", ["image", "audio"], listing(spark))
    assert [r.id for r in out.collect()] == [1]


def test_pairs_are_matched_by_id(spark):
    df = spark.createDataFrame(
        [(1, "one", ["none.jpg", "b.png"]), (2, "two", ["a.jpg"]), (3, "three", ["s.wav"])],
        "id INT, caption STRING, images ARRAY<STRING>",
    )
    resolved = op.resolve_media(op.explode_media(df, "id", "images"), listing(spark))
    pairs = op.pair_media(op.to_conversations(df, "id").drop("images"), "id", resolved)
    got = sorted((r.id, r.pos, r.image, r.conversations[1].content) for r in pairs.collect())
    assert got == [(1, 1, "/d/b.png", "one"), (2, 0, "/d/x/a.jpg", "two")]


def test_embedded_media_need_no_file(spark):
    df = spark.createDataFrame(
        [(1, bytearray(b"x"), None), (2, None, "s.wav"), (3, None, "none"), (4, None, None)],
        "id INT, image BINARY, images STRING",
    ).withColumn("images", F.when(F.col("id") == 2, "b.png").otherwise(F.col("images")))
    out = op.keep_readable(df, "id", ["image", "images"], listing(spark))
    assert sorted(r.id for r in out.collect()) == [1, 2]
    assert [r.id for r in op.keep_readable(df, "id", ["image"], listing(spark)).collect()] == [1]


def test_references_with_folders(spark, tmp_path):
    (tmp_path / "train" / "images").mkdir(parents=True)
    (tmp_path / "test" / "images").mkdir(parents=True)
    for name in ("train/images/1.jpg", "test/images/1.jpg", "test/images/2.jpg"):
        (tmp_path / name).write_bytes(b"x")
    names = ["images/1.jpg", "images/2.jpg", "1.jpg", "train/images/1.jpg", "ages/1.jpg"]
    refs = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "id INT, pos INT, ref STRING")
    resolved = op.resolve_media(refs, io.media_listing(spark, str(tmp_path)))
    got = {r.ref: r.path.removeprefix(f"file://{tmp_path}/") for r in resolved.collect()}
    # As in the folders themselves: a reference does not repeat the top folder's name.
    assert got == {
        "images/1.jpg": "test/images/1.jpg",
        "images/2.jpg": "test/images/2.jpg",
        "1.jpg": "test/images/1.jpg",
    }


def test_media_training_rows(spark):
    df = spark.createDataFrame(
        [(1, "cat", "a.jpg"), (2, "dog", "none.jpg"), (3, "cow", None)],
        "id INT, caption STRING, image STRING",
    )
    rows = op.prepare_dataset(df, "id", listing=listing(spark)).collect()
    assert [(r.id, r.image) for r in rows] == [(1, "a.jpg")]


def test_native_rows_without_media_go(spark):
    df = spark.createDataFrame(
        [(1, [("user", "a")], "a.jpg"), (2, [("user", "b")], None)],
        "id INT, conversations ARRAY<STRUCT<role: STRING, content: STRING>>, image STRING",
    )
    assert [r.id for r in op.prepare_dataset(df, "id").collect()] == [1]


def test_kinds(spark):
    names = ["a.JPG", "b.c.jpeg", "x.png", "s.Mp3", "t.wav", "u.gif", "noext", "jpg", ""]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    got = [r[0] for r in df.select(fn.media_kind(F.col("n"))).collect()]
    assert got == ["image"] * 3 + ["audio"] * 2 + [None, None, "image", None]


def test_listing(spark, tmp_path):
    root = tmp_path / "da ta"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "da ta").mkdir()
    for name in ("top.jpg", "sub/a.jpg", "sub/deep/b.jpg", "da ta/c.jpg"):
        (root / name).write_bytes(b"x")
    with zipfile.ZipFile(root / "pack.zip", "w") as pack:
        pack.writestr("in/d.jpg", b"x")
        pack.writestr("e.jpg", b"x")
    with zipfile.ZipFile(root / "sub" / "inner.zip", "w") as pack:
        pack.writestr("unseen.jpg", b"x")
    got = {(r.place, r.name) for r in io.media_listing(spark, str(root)).collect()}
    assert got == {
        ("top", "top.jpg"),
        ("top", "pack.zip"),
        ("folder", "a.jpg"),
        ("folder", "b.jpg"),
        ("folder", "deep/b.jpg"),
        ("folder", "c.jpg"),
        ("folder", "inner.zip"),
        ("zip", "in/d.jpg"),
        ("zip", "e.jpg"),
    }
    files = io.media_listing(spark, f"file://{root}/").where("place = 'top'")
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    assert files.count() == 2


def test_media_inside_the_table(spark):
    """Bytes and structs of bytes and path, single and in lists, next to references."""
    listing = spark.createDataFrame([("top", "/m/a.jpg", "a.jpg")], "place STRING, path STRING, name STRING")
    x = bytearray(b"x")
    medium = "STRUCT<bytes: BINARY, path: STRING>"
    df = spark.createDataFrame(
        [
            (1, (x, None), [(x, "no.jpg"), (None, "a.jpg")], [x], "no.jpg"),
            (2, (None, "a.jpg"), [(None, "no.jpg"), (x, None)], [None], None),
            (3, (None, "no.jpg"), [], [], "a.jpg"),
            (4, None, None, None, None),
        ],
        f"id INT, one {medium}, many ARRAY<{medium}>, data ARRAY<BINARY>, name STRING",
    )

    def readable(*columns, require="all"):
        return sorted(r.id for r in op.keep_readable(df, "id", list(columns), listing, require).collect())

    assert readable("one") == [1, 2]
    assert readable("many") == [1] and readable("many", require="any") == [1, 2]
    assert readable("data") == [1]
    assert readable("name") == [3] and readable("one", "name") == [1, 2, 3]
    refs = op.explode_media(df, "id", "many").collect()
    assert sorted((r.id, r.pos, r.ref) for r in refs) == [(1, 1, "a.jpg"), (2, 0, "no.jpg")]
    captions = df.select("id", F.lit("c").alias("caption"), F.col("one").alias("image"))
    prepared = op.prepare_dataset(captions, "id", listing=listing, pad="none")
    assert sorted(r.id for r in prepared.collect()) == [1, 2]


def test_readable_media_are_found_in_one_pass(spark):
    df = spark.createDataFrame([(1, ["a"], ["b"])], "id INT, images ARRAY<STRING>, audios ARRAY<STRING>")
    listing = spark.createDataFrame([("top", "p", "a")], "place STRING, path STRING, name STRING")
    plan = op.keep_readable(df, "id", ["images", "audios"], listing)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3


def test_images_next_to_their_messages(spark):
    talks = spark.createDataFrame(
        [(1, [("system", "s"), ("user", "a"), ("user", "b")]), (2, [("assistant", "c")]), (3, [("user", "d")]), (4, [])],
        "id INT, conversations ARRAY<STRUCT<role: STRING, content: STRING>>",
    )
    rows = [(1, 3, 2, "x.png"), (1, 1, 2, "z.png"), (1, 0, None, "y.png"), (1, 2, 9, "w.png"), (2, 0, None, "v.png"), (4, 0, 0, "u.png")]
    resolved = spark.createDataFrame(
        [(i, pos, m, "top", p, "image") for i, pos, m, p in rows] + [(3, 0, None, "top", "s.wav", "audio")],
        "id INT, pos INT, turn INT, place STRING, path STRING, kind STRING",
    )
    got = {r.id: r.images for r in op.pair_media_grouped(talks, "id", resolved, "turn").collect()}
    assert got == {1: [[], ["y.png", "w.png"], ["z.png", "x.png"]], 2: [["v.png"]], 4: []}
    got = {r.id: r.images for r in op.pair_media_grouped(talks, "id", resolved).collect()}
    assert got == {1: [[], ["y.png", "z.png", "w.png", "x.png"], []], 2: [["v.png"]], 4: []}
    text = op.pair_media_grouped(talks, "id", resolved, "turn").where("id = 1")
    text = text.select(fn.render_chat(F.col("conversations"), images=F.col("images"))).first()[0]
    assert "b<images>z.png</images><images>x.png</images>" in text


def test_a_conversation_of_many_images_is_one_row(spark):
    talks = spark.range(50).select(
        "id", F.array(F.struct(F.lit("user").alias("role"), F.lit("t").alias("content"))).alias("conversations")
    )
    resolved = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("id"), F.col("id").cast("int").alias("pos"),
        F.lit("image").alias("kind"), F.lit("top").alias("place"), F.concat(F.col("id"), F.lit(".png")).alias("path"),
    )
    got = {r.id: r.images for r in op.pair_media_grouped(talks, "id", resolved).collect()}
    assert len(got) == 50 and sum(len(i[0]) for i in got.values()) == 40_000 and len(got[7][0]) > 13_000
    assert all([int(p[:-4]) for p in i[0]] == sorted(int(p[:-4]) for p in i[0]) for i in got.values())
