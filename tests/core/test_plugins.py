"""Manifests, trust and activation; analyzers in one pass; streams that are superseded or enriched."""

import json
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import plugins
from tracewell.streaming import control

MANIFEST = {"Id": "own.analyzer", "name": "Own", "VERSION": "1", "author": "a", "license": "MIT", "isOpenSource": True, "assemblyName": "own.py", "entryTypeName": "Own"}
MODULE = """
from pyspark.sql import functions as F
from tracewell import plugins
from tracewell.operators import rules

def Own():
    return plugins.Analyzer("own.analyzer", "Own", 1, ("software",), lambda c: [F.when(c["software"] == "x", rules.finding("own", 1, 50))])
"""


def put(folder, manifest, module=MODULE):
    folder.mkdir(parents=True)
    (folder / "plugin.json").write_text(manifest if isinstance(manifest, str) else json.dumps(manifest))
    (folder / "own.py").write_text(module)


def test_manifests_policies_activation(tmp_path):
    root = tmp_path / "plugins"
    put(root / "a", MANIFEST)
    put(root / "b" / "deep", MANIFEST | {"Id": "closed", "isOpenSource": False, "signatureInfo": "s"}, "def Own():\n    raise RuntimeError\n")
    put(root / "c", "{broken")
    put(root / "d", {"id": "lacks the rest"})
    put(root / "e", "[]")
    put(root / "f", MANIFEST | {"Id": "outside", "assemblyName": "../a/own.py", "isOpenSource": False})
    found = plugins.discover(str(root))
    assert [m.id for m in found] == ["own.analyzer", "closed", "outside"] and plugins.discover(str(tmp_path / "none")) == []
    want = {"CoreOnly": [], "CoreAndOpenSource": ["own.analyzer"], "CoreAndSigned": ["closed"], "Full": ["own.analyzer", "closed", "outside"], "other": []}
    assert {p: [m.id for m in plugins.permitted(found, p)] for p in want} == want
    assert plugins.activate(found[0], plugins.Analyzer).id == "own.analyzer"
    assert plugins.activate(found[0], plugins.Exporter) is None  # of another kind
    assert plugins.activate(found[1], plugins.Analyzer) is None  # fails
    assert plugins.activate(found[2], plugins.Analyzer) is None  # not in its folder
    assert "own.analyzer" in plugins.Registry().add_from(str(root), "Full").analyzers
    assert "own.analyzer" not in plugins.Registry().add_from(str(root), "CoreOnly").analyzers


def test_registry_analyzes_in_one_pass(spark, tmp_path):
    rows = [("a.png", bytearray(b"\xff\xd8\xff\xe0"), "GIMP 2"), ("b.jpg", bytearray(b"\xff\xd8\xff\xe0"), "x"), ("c.jpg", None, None)]
    df = spark.createDataFrame(rows, "path string, content binary, software string")
    put(tmp_path / "p" / "a", MANIFEST)
    registry = plugins.Registry().add_from(str(tmp_path / "p"), "CoreAndOpenSource")
    got = registry.analyze(df, "path", {"path": "path", "content": "content", "software": "software"})
    assert {(r.item, r.analyzer, r.id) for r in got.collect()} == {
        ("a.png", "core.analyzer.format-mismatch", "format-mismatch"), ("b.jpg", "core.analyzer.format-mismatch", "format-match"),
        ("a.png", "core.analyzer.software", "software-editing-tool"), ("b.jpg", "core.analyzer.software", "software-field-present"), ("b.jpg", "own.analyzer", "own"),
        ("a.png", "core.analyzer.file-hash", "file-hash-sha256"), ("b.jpg", "core.analyzer.file-hash", "file-hash-sha256"), ("c.jpg", "core.analyzer.file-hash", "file-hash-error"),
    }
    only = registry.analyze(df, "path", {"software": "software"}, {"core.analyzer.software"})
    assert only.count() == 2 and registry.analyze(df, "path", {}).count() == 0
    text = registry.exporter("txt").run(got.drop("analyzer")).collect()
    assert {r.item for r in text} == {"a.png", "b.jpg", "c.jpg"} and registry.exporter("pdf") is None
    assert registry.processors["core.processor.embedded-artifact-extractor"].run(df.select("path", "content")).count() == 0
    assert set(registry.parse_payloads(df)) == set(plugins.PAYLOADS)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.JPG").write_bytes(b"\xff\xd8")
    (tmp_path / "m" / "a.txt").write_bytes(b"t")
    assert registry.sources["filesystem"].open(spark, str(tmp_path / "m")).count() == 2
    assert registry.sources["core.source.folder"].open(spark, str(tmp_path / "m")).count() == 1


def test_streams_superseded_and_enriched(spark, tmp_path):
    schema = T.StructType.fromDDL("path string, version int, findings int")
    spark.createDataFrame([("a", 1, None), ("b", 1, None)], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 2, 3)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    seen: list[int] = []
    listener = control.Progress(seen.append, every=2)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = control.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
        got = control.current_rows(spark, str(tmp_path / "out"), schema, "path", "version").collect()
        assert {tuple(r) for r in got} == {("a", 2, 3), ("b", 1, None)}
        end = time.time() + 20
        while not seen and time.time() < end:
            time.sleep(0.1)
        assert seen and seen[-1] >= 2
    finally:
        spark.streams.removeListener(listener)
    loads = control.Loads()

    def begin():
        return spark.readStream.format("rate").load().select(F.col("value")).writeStream.format("noop").start()

    first = loads.start("folder", begin)
    second = loads.start("folder", begin)
    assert not first.isActive and second.isActive
    assert loads.cancel("folder") and not second.isActive and not loads.cancel("folder")
