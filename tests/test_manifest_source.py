"""The manifest source in batches and in streams that stop and go on."""

import json

from pluvio.sources import manifest_source
from pluvio.sources.manifest_source import StreamReader, listed


def manifest(path, times, nowcast=()):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"version": "2.0", "radar": {"past": [{"time": t, "path": f"/v2/{t}"} for t in times], "nowcast": [{"time": t, "path": f"/v2/{t}"} for t in nowcast]}}))


def batch(spark, folder, **options):
    manifest_source.register(spark)
    return spark.read.format("pluvio_manifest").options(path=str(folder), **options).load()


def test_a_batch_names_frames_in_their_order(spark, tmp_path):
    manifest(tmp_path / "a" / "m.json", [600, 0], [1200])
    manifest(tmp_path / "b.json", [])
    (tmp_path / "_hidden.json").write_text("{}")
    (tmp_path / "bad.json").write_text('{"radar": {"past": [{"time": 5}]}}')
    (tmp_path / "cut.json").write_text('{"radar": {"pa')
    (tmp_path / "other.txt").write_text("x")
    df = batch(spark, tmp_path, pattern="*.json")
    assert df.rdd.getNumPartitions() == 4
    rows = {(r.manifest.rsplit("/", 1)[1], r.kind, r.place, r.epoch, r.path, r.error is not None) for r in df.collect()}
    assert rows == {("m.json", "past", 0, 600, "/v2/600", False), ("m.json", "past", 1, 0, "/v2/0", False), ("m.json", "nowcast", 0, 1200, "/v2/1200", False), ("bad.json", None, None, None, None, True), ("cut.json", None, None, None, None, True)}


def test_an_empty_or_absent_folder(spark, tmp_path):
    assert batch(spark, tmp_path / "none").count() == 0


def test_a_stream_stops_and_goes_on(spark, tmp_path):
    manifest_source.register(spark)

    def poll():
        s = spark.readStream.format("pluvio_manifest").options(path=str(tmp_path / "in"), log=str(tmp_path / "log")).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.epoch for r in spark.read.schema(manifest_source.SCHEMA).parquet(str(tmp_path / "out")).collect()))

    manifest(tmp_path / "in" / "z.json", [0, 600])
    assert poll() == [0, 600]
    assert poll() == [0, 600]
    manifest(tmp_path / "in" / "a.json", [1200])  # earlier by name
    manifest(tmp_path / "in" / "deep" / "b.json", [1800])
    assert poll() == [0, 600, 1200, 1800]


def test_offsets_stand_for_the_same_files_after_a_crash(tmp_path):
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log")}
    manifest(tmp_path / "in" / "a.json", [0])
    first = StreamReader(options)
    assert first.initialOffset() == {"entries": 0}
    one = first.latestOffset()
    manifest(tmp_path / "in" / "b.json", [1])
    two = first.latestOffset()
    assert first.latestOffset() == two
    (tmp_path / "log" / "000000002.json.part").write_text("[")  # a crash amid an entry
    again = StreamReader(options)
    manifest(tmp_path / "in" / "c.json", [2])
    three = again.latestOffset()

    def names(a, b):
        return [p.name.rsplit("/", 1)[1] for p in again.partitions(a, b)]

    assert names({"entries": 0}, one) == ["a.json"] and names(one, two) == ["b.json"] and names(two, three) == ["c.json"] and names(three, three) == []
    assert len(listed(options["path"], "*")) == 3
    gone = again.partitions(two, three)[0]
    (tmp_path / "in" / "c.json").unlink()
    ((*_, error),) = list(again.read(gone))
    assert error.startswith("FileNotFoundError")
