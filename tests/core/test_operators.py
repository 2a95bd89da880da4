"""Operators without a query of their own: backups, thumbnails' names, pixels, streams, policies."""

import datetime

from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.operators import evidence, items, passes, rules
from tracewell.streaming import distinct_stream, session_stream


def test_backups(spark):
    files = spark.createDataFrame([("/b/u1/Manifest.db",), ("/b/u1/Info.plist",), ("/b/u2/Manifest.db",), ("/b/u3/Info.plist",)], "path string")
    plist = "<dict><key>Device Name</key>\n<string>My phone</string><key>Last Backup Date</key><date>2024-01-02T03:04:05Z</date></dict>"
    info = spark.createDataFrame([("/b/u1/Info.plist", plist), ("/b/u3/Info.plist", plist)], "path string, text string")
    got = {r.udid: r for r in items.backups(files, "path", info, "path", "text").collect()}
    assert set(got) == {"u1", "u2"} and got["u1"].device_name == "My phone" and got["u1"].last_backup == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert got["u2"].device_name == "u2" and got["u2"].last_backup is None


def test_android_thumbnails(spark):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("/t/1.jpg", " DCIM/IMG_7.JPG ", t[0], t[1], t[2]), ("/t/123.jpg", None, None, t[1], t[2]), ("/t/IMG_5.JPG", "no dot", None, None, t[2]), ("/t/x.png", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, d string, h timestamp, o timestamp, m timestamp")
    got = {r.path: (r.original_name, r.taken) for r in items.android_thumbnails(df, "path", "d", "h", "o", "m").collect()}
    assert got == {"/t/1.jpg": ("IMG_7.JPG", t[0]), "/t/123.jpg": (None, t[1]), "/t/IMG_5.JPG": ("IMG_5.jpg", t[2])}


def test_pixels(spark):
    ramp, flat = [min(255, c * 30) for _ in range(8) for c in range(9)], [7] * 72
    df = spark.createDataFrame([(ramp, flat), (flat, ramp), ([1], []), (None, flat)], "a array<int>, b array<int>")
    got = df.select(scalars.dhash(F.col("a")).alias("h"), scalars.mean_difference(F.col("a"), F.col("b")).alias("d"), rules.pixel_difference(scalars.mean_difference(F.col("a"), F.col("b")))["id"].alias("f")).collect()
    assert [r.h for r in got] == [-1, 0, None, None]
    assert got[0].d == got[1].d == sum(abs(x - 7) for x in ramp) / 72 and got[0].f == "thumb-pixel-significant-diff" and got[2].d is None and got[3].d is None
    assert spark.range(1).select(scalars.luma(F.lit(255), F.lit(0), F.lit(10)).alias("x")).first().x == 77


def test_small_predicates(spark):
    df = spark.createDataFrame([(bytearray(b"x"), None, None, "p"), (bytearray(), 5, 7, ""), (None, 5, 0, None)], "d binary, o long, n long, s string")
    assert [tuple(r) for r in df.select(items.extractable(F.col("d"), F.col("o"), F.col("n")), items.has_bytes(F.col("s"), F.lit(None))).collect()] == [(True, True), (True, False), (False, False)]
    named = spark.createDataFrame([(4, "Canon", "Canon R5"), (7, "Make", "X1"), (9, None, "X1"), (5, "Make", None)], "v int, k string, m string")
    got = named.select(scalars.os_hint(F.col("v")), scalars.camera_name(F.col("k"), F.col("m")), scalars.span_text(F.col("v") * 1000), scalars.looked_up(F.col("v"), {4: "four"}, "other")).collect()
    assert [tuple(r) for r in got] == [("Windows 98/ME/2000", "Canon R5", "1.1 h", "four"), ("Windows XP SP2+", "Make X1", "1.9 h", "other"), (None, "X1", "2.5 h", "other"), ("Windows XP", "Make", "1.4 h", "other")]
    assert items.visible(named, ["k"]).columns == ["v", "m"]
    dirs = spark.createDataFrame([("b", False), ("A", False), ("z", True)], "p string, d boolean")
    assert [r.p for r in dirs.orderBy(*items.directory_order("p", "d")).collect()] == ["z", "A", "b"]


def test_rules_on_both_sides(spark):
    t = datetime.datetime(2024, 6, 1)
    hours = [-25, -24, -1, 0, 24, 25]
    df = spark.createDataFrame([(h, t, t + datetime.timedelta(hours=h)) for h in hours], "h int, c timestamp, w timestamp")
    got = {r.item: r.id for r in rules.findings(df, "h", rules.file_time(F.col("c"), F.col("w"))).collect()}
    assert got == {-25: "ts-fs-precedes-exif", -24: "ts-fs-consistent", -1: "ts-fs-consistent", 0: "ts-fs-consistent", 24: "ts-fs-consistent", 25: "ts-fs-later"}
    tools = ["Instagram", "Lens Studio 4", "ACDSee", "Pixelmator", "Nikon COOLPIX P950", " ", None, "Adobe Camera Raw"]
    found = {r.item: r.id for r in rules.findings(spark.createDataFrame(list(enumerate(tools)), "i int, s string"), "i", rules.software(F.col("s"))).collect()}
    assert found == {0: "software-editing-tool", 1: "software-editing-tool", 2: "software-field-present", 3: "software-field-present", 4: "software-field-present", 7: "software-editing-tool"}
    ext = spark.createDataFrame([(e,) for e in (".jpe", ".JFIF", ".dib", ".xyz")], "e string").select(rules.expected_format(F.col("e")).alias("f")).collect()
    assert [r.f for r in ext] == ["JPEG", "JPEG", "BMP", None]
    cut = spark.createDataFrame([(bytearray(bytes.fromhex("89504E4700000000")),)], "c binary").select(rules.detect_format(F.col("c")).alias("f")).first()
    assert cut.f is None


def test_platforms_and_screenshots(spark):
    rows = [(1, "Pixel 7", None, True, 1, 1), (2, None, "iOS 17", False, 1, 1), (3, "SM-G990", None, None, 1, 1), (4, None, "Screenshot tool", None, 1, 1), (5, None, None, False, 1170, 2532), (6, "Canon", None, True, 1170, 2532)]
    df = spark.createDataFrame(rows, "i int, m string, s string, g boolean, w int, h int")
    assert {r.item: (r.profile_id, r.strength) for r in evidence.platform_matches(df, "i", "m", "s", "g").collect()} == {1: ("platform.google-pixel", 3), 2: ("platform.apple-iphone", 2), 3: ("platform.samsung-galaxy", 2)}
    assert {r.item: r.strength for r in evidence.screenshot_matches(df, "i", "m", "s", "w", "h", "g").collect()} == {4: 3, 5: 1}


def test_content_hash_error(spark):
    df = spark.createDataFrame([(1, bytearray(b"a")), (2, None)], "i int, c binary")
    got = {r.item: (r.id, r.priority, r.observation[:24]) for r in passes.content_hashes(df, "i", "c").collect()}
    assert got == {1: ("file-hash-sha256", 0, "SHA-256:  CA978112 CA1BB"), 2: ("file-hash-error", 1, "Could not compute SHA-25")}


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 6, 1)
    at = lambda m: t + datetime.timedelta(minutes=m)
    schema = "user long, ts timestamp"
    spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(100)), (2, at(5)), (2, at(5)), (3, at(600))], schema).write.parquet(str(tmp_path / "in"))

    def run(df, name):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    sessions = {(r.user, r.first, r.end, r.n) for r in run(session_stream(source(), "ts", ["user"]), "sessions")}
    assert sessions == {(1, at(0), at(40), 2), (1, at(100), at(130), 1), (2, at(5), at(35), 2)}
    assert len(run(distinct_stream(source(), "ts", ["user", "ts"]), "firsts")) == 5
