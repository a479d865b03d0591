import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import functions as fn
from orrery import sources
from orrery.operators import clouds, datasets, models, pairing


def test_stem(spark):
    paths = {"a/b.glb": "b", "a.b.glb": "a.b", ".glb": ".glb", "a.": "a", "x/": "", "": "", "..a.glb": "..a"}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", fn.stem(F.col("p")).alias("s"))
    assert {r.p: r.s for r in df.collect()} == paths


def test_mapping_and_misses(spark):
    tasks = spark.createDataFrame([("0", "a", "/i/0/a"), ("0", "b", "/i/0/b"), ("1", "c", "/i/1/c")], "i string, folder string, src_path string")
    index = spark.createDataFrame([("0/a", "x/o1.glb"), ("0/b", "x/o2.glb")], "key string, glb_path string")
    found = spark.createDataFrame([("o1", "/c/p0/o1")], "object_id string, path string")
    m = pairing.build_mapping(tasks, index, found, "/i", "/c")
    assert sorted((r.src, r.dst) for r in m.collect()) == [("0/a", "p0/o1"), ("0/b", ""), ("1/c", "")]
    assert pairing.miss_report(m).first().asDict() == {"n_out": 3, "missing_index": 1, "missing_cloud": 1}
    assert pairing.find_first(m, "o1", "src").first().src == "0/a"


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "i.json").write_text('{"a": "1", "b": "2", "a": "3"}')
    assert {r.key: r.glb_path for r in sources.read_index(spark, str(tmp_path / "in" / "i.json")).collect()} == {"a": "3", "b": "2"}
    (tmp_path / "m.json").write_text(json.dumps([{"src": "s", "dst": ""}]))
    assert sources.read_mapping(spark, str(tmp_path / "m.json")).first() == (0, "s", "")
    (tmp_path / "root" / "p0" / "o1").mkdir(parents=True)
    (tmp_path / "root" / "p0" / "file").write_text("")
    assert [(r.parent, r.name) for r in sources.scan_folders(spark, str(tmp_path / "root")).collect()] == [("p0", "o1")]
    np.save(tmp_path / "root" / "p0" / "o1" / "xyzc.npy", np.arange(60.0).reshape(2, 6, 5))
    np.save(tmp_path / "root" / "p0" / "o1" / "bad.npy", np.zeros((3, 5)))
    got = sources.read_clouds(spark, str(tmp_path / "root")).collect()
    assert sorted((r.x, r.b) for r in got if r.error is None) == [(0.0, 25.0), (30.0, 55.0)] and sum(r.error is not None for r in got) == 1


def test_clouds(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 255.0, 0.0), ("a", 3.0, 4.0, 0.0, 0.0, 0.0, 0.0), ("b", 1.0, 1.0, 1.0, 0.5, 1.0, 0.0)],
                                "cloud_id string, x double, y double, z double, r double, g double, b double")
    out = {(r.cloud_id, r.x) for r in clouds.normalise(pts).collect()}
    assert out == {("a", -0.3), ("a", 0.3), ("b", None)}
    assert sorted(r.g for r in clouds.rescale_colours(pts).collect()) == [0.0, 1.0, 1.0]
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0)], "mesh_id string, vid int, x double, y double, z double")
    t = spark.createDataFrame([("m", 0, 0, 1, 2)], "mesh_id string, tid int, a int, b int, c int")
    assert {(r.nx, r.ny, r.nz) for r in clouds.vertex_normals(v, t).collect()} == {(0.0, 0.0, 1.0)}


def test_stem_equals_splitext(spark):
    names = ["a.b.glb", ".glb", "..a.glb", "a.", "..", "x/y/", "", "...", "a/.b.c", "no", "a.b/c", "é.x"]
    df = spark.createDataFrame([(p,) for p in names], "p string").select("p", fn.stem(F.col("p")).alias("s"))
    assert {r.p: r.s for r in df.collect()} == {p: os.path.splitext(os.path.basename(p))[0] for p in names}


def test_relative_equals_relpath(spark):
    paths = ["/a/b/c", "/a/b", "/a", "/a/bc/d", "/x", "/a//b/./c"]
    for root in ("/a/b", "/a/b/", "/a/b/c/d", "/"):
        df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", fn.relative(F.col("p"), root).alias("r"))
        want = {p: p if root == "/" else os.path.relpath(p, root) for p in paths}
        assert {r.p: r.r for r in df.collect()} == want
    assert spark.range(1).select(fn.relative(F.lit(""), "/a")).first()[0] == ""


def trees(tmp_path):
    cl, im = tmp_path / "clouds", tmp_path / "images"
    for p in ("p0/aaa", "p0/dup", "p1/dup", "p1/bbb", "p1/empty"):
        (cl / p).mkdir(parents=True)
    for p in ("0/10", "2/7", "10/5", "3"):
        (im / p).mkdir(parents=True)
    for p in (cl / "plain", cl / "p0" / "plain", im / "plain", im / "0" / "plain"):
        p.write_text("")
    (cl / "link").symlink_to(cl / "p1", target_is_directory=True)
    np.save(cl / "p0" / "aaa" / "xyzc.npy", np.ones((2, 4)))
    (tmp_path / "index.json").write_text('{"0/10": "d/aaa.glb", "2/7": "d/zzz.glb", "0/10": "d/dup.glb", "0/10": "d/aaa.glb"}')
    return cl, im


def test_mapping_from_folders_to_array_and_back(spark, tmp_path):
    cl, im = trees(tmp_path)
    clouds_found = sources.scan_clouds(spark, str(cl))
    assert sorted((r.parent, r.object_id) for r in clouds_found.collect()) == [
        ("link", "bbb"), ("link", "dup"), ("link", "empty"), ("p0", "aaa"), ("p0", "dup"), ("p1", "bbb"), ("p1", "dup"), ("p1", "empty")
    ]
    assert {r.object_id: (r.path.split("/")[-2], r.n_dups) for r in pairing.cloud_index(clouds_found).collect()}["dup"] == ("p1", 3)
    tasks = pairing.with_ordinal(sources.scan_tasks(spark, str(im)))
    index = sources.read_index(spark, str(tmp_path / "index.json"))
    m = pairing.build_mapping(tasks, index, clouds_found, str(tmp_path), str(tmp_path))
    out = tmp_path / "new" / "mapping.json"
    assert sources.write_mapping(m, str(out)) == 3
    want = [{"src": "images/0/10", "dst": "clouds/p0/aaa"}, {"src": "images/10/5", "dst": ""}, {"src": "images/2/7", "dst": ""}]
    assert out.read_text() == json.dumps(want, indent=2)
    back = sources.read_mapping(spark, str(out))
    assert [(r.ordinal, r.src, r.dst) for r in back.orderBy("ordinal").collect()] == [(i, w["src"], w["dst"]) for i, w in enumerate(want)]
    assert pairing.miss_report(m).first().asDict() == {"n_out": 3, "missing_index": 1, "missing_cloud": 1}
    assert pairing.find_item(back, "p0").src == "images/0/10" and pairing.find_item(back, "").ordinal == 0
    with pytest.raises(LookupError):
        pairing.find_item(back, "nothing")
    files = sources.list_files(spark, str(tmp_path), "*.npy").select(F.replace("path", F.lit(f"{tmp_path}/")).alias("path"))
    got = {r.src: (r.file, r.error is None) for r in pairing.cloud_files(back, files).collect()}
    assert got["images/0/10"] == ("clouds/p0/aaa/xyzc.npy", True) and got["images/2/7"] == (None, False)
    direct = spark.createDataFrame([("clouds/p0/aaa/xyzc.npy",)], "dst string")
    assert pairing.cloud_files(direct, files).first().file == "clouds/p0/aaa/xyzc.npy"
    assert sources.write_mapping(m.limit(0), str(tmp_path / "none.json")) == 0 and json.loads((tmp_path / "none.json").read_text()) == []
    sources.write_mapping_lines(m, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    with pytest.raises(Exception):
        sources.scan_folders(spark, str(tmp_path / "absent")).collect()
    (tmp_path / "bad.json").write_text('{"a":"b"')
    with pytest.raises(Exception):
        sources.read_index(spark, str(tmp_path / "bad.json")).collect()


def test_cloud_layouts(spark, tmp_path):
    rng = np.random.default_rng(3)
    shapes = {"last4": (7, 4, 5), "first4": (5, 7, 4), "both": (5, 4, 5), "last6": (7, 6, 5), "first6": (5, 7, 6), "two4": (7, 4), "two9": (7, 9), "r3": (3, 4, 6), "c3": (7, 3), "c5": (7, 5), "r1": (7,), "r4": (2, 2, 2, 2), "none": (0, 4)}
    arrays = {k: rng.random(s) for k, s in shapes.items()}
    for k, a in arrays.items():
        np.save(tmp_path / f"{k}.npy", a)
    np.save(tmp_path / "object.npy", np.array([{}]), allow_pickle=True)
    (tmp_path / "broken.npy").write_bytes(b"no array")
    rows = sources.read_clouds(spark, str(tmp_path), None).collect()
    name = lambda r: r.path.rsplit("/", 1)[1][:-4]
    assert {name(r) for r in rows if r.error} == {"r3", "c3", "c5", "r1", "r4", "object", "broken"}
    by = {}
    for r in rows:
        by.setdefault((name(r), r.rendering), []).append(r)
    for k, layers in (("last4", lambda a, i: a[:, :, i]), ("both", lambda a, i: a[:, :, i]), ("first4", lambda a, i: a[i]), ("last6", lambda a, i: a[:, :, i]), ("first6", lambda a, i: a[i])):
        for i in range(5):
            want = layers(arrays[k], i)
            got = sorted(by[k, i], key=lambda r: r.point_id)
            assert [[r.x, r.y, r.z] for r in got] == want[:, :3].tolist()
            assert ([r.label for r in got] if want.shape[1] == 4 else [[r.r, r.g, r.b] for r in got]) == (want[:, 3] if want.shape[1] == 4 else want[:, 3:6]).tolist()
    assert ("none", 0) not in by and len(by["two9", 0]) == 7
    assert {r.rendering for r in sources.read_clouds(spark, str(tmp_path)).filter("error IS NULL").collect()} == {0}


def test_colours(spark):
    nan = float("nan")
    rows = [("over", 255.0, 0.0, 51.0), ("over", 0.5, 0.0, 0.0), ("at", 1.0, 0.5, 0.0), ("nan", nan, 255.0, 0.0)]
    df = spark.createDataFrame(rows, "cloud_id string, r double, g double, b double")
    got = sorted((r.cloud_id, r.g, r.b) for r in clouds.rescale_colours(df).collect())
    assert got == [("at", 0.5, 0.0), ("nan", 255.0, 0.0), ("over", 0.0, 0.0), ("over", 0.0, 0.2)]
    df = spark.createDataFrame([(0.0, None), (1.0, None), (1.0, None), (nan, None), (nan, None), (None, 0.25), (2.0, 0.5)], "label double, r double").withColumns({"g": F.col("r"), "b": F.col("r")})
    out = [(r.r, r.g, r.b) for r in clouds.colour_labels(df).collect()]
    assert out[1] == out[2] != out[0] and out[3] == out[4] and out[5] == (0.25,) * 3 and out[6] == (0.5,) * 3 and all(0 <= v <= 1 for c in out for v in c)


def cube(tmp_path, **node):
    v = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], "<f4")
    t = np.array([[0, 1, 3], [0, 3, 2], [4, 6, 7], [4, 7, 5], [0, 4, 5], [0, 5, 1], [2, 3, 7], [2, 7, 6], [0, 2, 6], [0, 6, 4], [1, 5, 7], [1, 7, 3]], "<u2")
    data = v.tobytes() + t.tobytes()
    scene = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, **node}], "buffers": [{"byteLength": len(data)}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 1}]}],
        "bufferViews": [{"buffer": 0, "byteLength": 96}, {"buffer": 0, "byteOffset": 96, "byteLength": 72}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 8, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 36, "type": "SCALAR"}],
    }
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(data), 0x004E4942) + data
    return struct.pack("<III", 0x46546C67, 2, 12 + len(body)) + body


def test_meshes(spark, tmp_path):
    (tmp_path / "cube.glb").write_bytes(cube(tmp_path))
    (tmp_path / "moved.glb").write_bytes(cube(tmp_path, translation=[10, 0, 0], scale=[2, 1, 1], rotation=[0, 0, 2**-0.5, 2**-0.5]))
    (tmp_path / "bad.glb").write_bytes(b"glTF")
    v, t, e = sources.read_meshes(spark, str(tmp_path))
    v, t = v.withColumn("mesh_id", F.element_at(F.split("mesh_id", "/"), -1)), t.withColumn("mesh_id", F.element_at(F.split("mesh_id", "/"), -1))
    assert v.filter("mesh_id = 'cube.glb'").count() == 8 and t.filter("mesh_id = 'cube.glb'").count() == 12
    assert [r.mesh_id.rsplit("/", 1)[1] for r in e.collect()] == ["bad.glb"]
    far = v.filter("mesh_id = 'moved.glb'").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(far) == pytest.approx((9, 10, 0, 2), abs=1e-6)
    lone = spark.createDataFrame([("cube.glb", 99, 5.0, 5.0, 5.0)], v.schema)
    normals = clouds.vertex_normals(v.filter("mesh_id = 'cube.glb'").union(lone), t).collect()
    assert len(normals) == 9 and all(r.nx is None if r.vid == 99 else abs(r.nx**2 + r.ny**2 + r.nz**2 - 1) < 1e-9 for r in normals)
    assert all((r.nx > 0, r.ny > 0, r.nz > 0) == (r.vid >= 4, r.vid % 4 >= 2, r.vid % 2 == 1) for r in normals if r.vid != 99)


def test_images_and_frames(spark, tmp_path):
    def png(path, pixels, kind):
        h, w = pixels.shape[:2]
        raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    rgb = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    png(tmp_path / "im" / "a" / "0.png", rgb, 2)
    png(tmp_path / "im" / "a" / "1.png", np.array([[7, 9]], np.uint8), 0)
    png(tmp_path / "im" / "b" / "0.png", np.dstack([rgb, np.full((2, 2), 255, np.uint8)]), 6)
    png(tmp_path / "gt" / "a" / "0.png", rgb, 2)
    got = {r.origin[-7:]: bytes(r.rgb) for r in sources.read_images(spark, str(tmp_path / "im")).collect()}
    assert got == {"a/0.png": rgb.tobytes(), "a/1.png": bytes([7, 7, 7, 9, 9, 9]), "b/0.png": rgb.tobytes()}
    (tmp_path / "list.txt").write_text("a\n\nc\n")
    rows = sorted(sources.read_frames(spark, str(tmp_path / "im"), str(tmp_path / "gt"), str(tmp_path / "list.txt"), "*.png").collect())
    assert [(r.video, r.frame, r.mask_path is None) for r in rows] == [("a", "0", False), ("a", "1", True)]


def test_datasets(spark):
    rows = spark.createDataFrame([(v, f) for v in "ab" for f in range(10)], "video string, frame int")
    some = datasets.sampled(rows, "video", "frame", 4, 1)
    assert sorted(some.groupBy("video").count().collect()) == [("a", 4), ("b", 4)]
    assert sorted(some.collect()) == sorted(datasets.sampled(rows.repartition(3), "video", "frame", 4, 1).collect()) != sorted(datasets.sampled(rows, "video", "frame", 4, 2).collect())
    assert datasets.repeated(rows, 3).count() == 60 and datasets.repeated(rows, 0).count() == 0
    order = [tuple(r) for r in datasets.shuffled(rows, 5, "video", "frame").collect()]
    assert sorted(order) == sorted(map(tuple, rows.collect())) and order != sorted(order)
    b = datasets.batched(rows, 6, 5, "video", "frame")
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [6, 6, 6]
    placed = {(r.video, r.frame): r.batch for r in datasets.batched(rows, 6, 5, "video", "frame", drop_last=False).collect()}
    assert [placed[k] for k in order] == [i // 6 for i in range(20)]
    assert datasets.concat(rows, rows.drop("frame")).filter("frame IS NULL").count() == 20
    assert datasets.batched(rows.limit(0), 6, 5, "video", "frame").count() == 0


def test_chat(spark):
    df = spark.createDataFrame([("hi", None), ("yo", "sys")], "u string, s string")
    first = df.select(fn.messages(F.col("u")).alias("m")).first().m
    assert [(t.role, t.content[0].text) for t in first] == [("system", "You are a helpful assistant."), ("user", "hi")]
    assert [r.m[0].content[0].text for r in df.select(fn.messages(F.col("u"), F.col("s")).alias("m")).collect()] == [fn.DEFAULT_SYSTEM, "sys"]
    image = df.select(fn.messages(F.col("u"), None, F.lit("http://x/i.jpg")).alias("m")).first().m
    assert [(p.type, p.text, p.url) for p in image[0].content] == [("image", None, "http://x/i.jpg"), ("text", "hi", None)]
    assert df.select(fn.rendered(fn.messages(F.col("u"), None, F.lit("u")))).first()[0] == "user: <u> hi\nassistant:"
    assert spark.range(1).select(fn.without_special(fn.reply_tokens(F.array(*map(F.lit, [1, 2, 3, 0, 4])), F.lit(2)), [0])).first()[0] == [3, 4]
    assert [r[0] for r in spark.createDataFrame([("a.bias",), ("bias_b",), ("weight",)], "n string").select(fn.matches(F.col("n"), ["*bias*"])).collect()] == [True, True, False]


def test_predictor_is_built_once_for_each_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make(how):
        import os
        import tempfile

        tempfile.mkstemp(dir=folder, prefix=f"{os.getpid()}-{how.max_new_tokens}-")
        return lambda chats: [f"{how.temperature}" for _ in chats]

    df = spark.range(40, numPartitions=20).withColumn("m", fn.messages(F.col("id").cast("string")))
    out = models.attach_replies(df, "m", make, models.SAMPLED)
    assert {r.reply for r in out.collect()} == {"0.7"}
    built = [n.split("-")[:2] for n in os.listdir(folder)]
    assert len({p for p, _ in built}) == len(built) <= 4 and {n for _, n in built} == {"512"}


def test_model_calls(spark):
    df = spark.createDataFrame([("hi",)], "t string").withColumn("m", fn.messages(F.col("t"), "sys"))
    out = models.attach_replies(df, "m", lambda how: lambda chats: [str(json.loads(c)[1]["content"][0]["text"]) for c in chats])
    assert out.first().reply == "hi"
