"""Arrow IPC files by record batch."""

import json

import numpy as np
import pyarrow as pa
import pytest

from loomtide.sources import arrow_ipc

RNG = np.random.default_rng(5)


def table(first, n):
    k = range(first, first + n)
    kinds = pa.schema([("id", pa.int64()), ("img", pa.binary()), ("kind", pa.dictionary(pa.int32(), pa.string())), ("note", pa.string())])
    return pa.table({"id": list(k), "img": [bytes([i % 256] * (i % 5)) for i in k], "kind": [f"k{i % 3}" for i in k], "note": [None if i % 4 == 0 else f"n{i}" for i in k]}, schema=kinds)


def write(path, t, batch, stream, compression=None):
    options = pa.ipc.IpcWriteOptions(compression=compression, emit_dictionary_deltas=False, unify_dictionaries=True)
    with pa.OSFile(str(path), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, t.schema, options=options) as w:
        for b in t.to_batches(max_chunksize=batch):
            w.write_batch(b)
    return str(path)


@pytest.fixture()
def files(tmp_path):
    return [
        write(tmp_path / "b.arrow", table(0, 100), 7, True), write(tmp_path / "a.arrow", table(100, 50), 50, False, "zstd"),
        write(tmp_path / "empty.arrow", table(0, 0), 5, True), write(tmp_path / "c.arrow", table(150, 33), 10, False, "lz4"),
    ]


COLUMNS = {"note": "string", "id": "long", "kind": "string"}


def test_scans_deal_record_batches(spark, files):
    rows = arrow_ipc.scan_arrow(spark, files, COLUMNS)
    assert rows.rdd.getNumPartitions() >= 4 and rows.columns == ["pos", "note", "id", "kind"]
    got = rows.orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["kind"], r["note"]) for r in got] == [(i, i, f"k{i % 3}", None if i % 4 == 0 else f"n{i}") for i in range(183)]
    index = arrow_ipc.arrow_index(spark, files).orderBy("pos").collect()
    assert [r["rows"] for r in index] == [7] * 14 + [2, 50, 10, 10, 10, 3] and [r["pos"] for r in index][-1] == 180


def test_data_source(spark, files, monkeypatch):
    spark.dataSource.register(arrow_ipc.ArrowIpc)
    read = spark.read.format("arrow_ipc").option("paths", json.dumps(files))
    assert sorted(r["id"] for r in read.load().collect()) == list(range(183))
    some = read.option("columns", json.dumps(["id", "img"])).load()
    assert some.columns == ["id", "img"] and {r["id"]: bytes(r["img"]) for r in some.collect()} == {i: bytes([i % 256] * (i % 5)) for i in range(183)}
    assert some.where("id % 50 = 3").count() == 4
    monkeypatch.setattr(arrow_ipc, "SPLIT", 1000)
    assert len(arrow_ipc._Reader(files, ["id"]).partitions()) > 10
    with pytest.raises(Exception, match="missing"):
        read.option("columns", json.dumps(["nothing"])).load()


def test_fetch_reads_only_the_batches_of_wanted_rows(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_ipc, "BLOCK", 16)
    places = [*RNG.integers(0, 183, 60).tolist(), 5, 5, 182, 0]
    wanted = spark.createDataFrame(list(enumerate(places)), "req long, pos long").repartition(3)
    got = {r["req"]: (r["pos"], r["id"], r["kind"]) for r in arrow_ipc.fetch_arrow(spark, files, wanted, {"id": "long", "kind": "string"}).collect()}
    assert got == {i: (p, p, f"k{p % 3}") for i, p in enumerate(places)}
    # all bodies but the one of rows 14 to 20 are spoilt
    data = bytearray(open(files[0], "rb").read())
    for x in arrow_ipc.batches_of(files[0]):
        if x["first"] != 14:
            data[x["at"] + x["size"] - 64 : x["at"] + x["size"]] = b"\xee" * 64
    path = tmp_path / "spoilt.arrow"
    path.write_bytes(bytes(data))
    ask = spark.createDataFrame([(0, 20), (1, 14), (2, 14)], "req long, pos long")
    got = sorted((r["req"], r["id"], r["note"]) for r in arrow_ipc.fetch_arrow(spark, [str(path)], ask, {"id": "long", "note": "string"}).collect())
    assert got == [(0, 20, None), (1, 14, "n14"), (2, 14, "n14")]
    with pytest.raises(Exception, match="no row at 183"):
        arrow_ipc.fetch_arrow(spark, files, spark.createDataFrame([(0, 183)], "req long, pos long"), {"id": "long"}).collect()


def test_files_that_are_none(spark, files, tmp_path):
    (tmp_path / "x.arrow").write_bytes(b"no arrow file at all")
    with pytest.raises(Exception, match="not an Arrow IPC file"):
        arrow_ipc.scan_arrow(spark, [str(tmp_path / "x.arrow")], {"id": "long"}).collect()
    (tmp_path / "y.arrow").write_bytes(open(files[0], "rb").read()[:-200])
    with pytest.raises(Exception, match="ends inside"):
        arrow_ipc.scan_arrow(spark, [str(tmp_path / "y.arrow")], {"id": "long"}).collect()
    other = write(tmp_path / "o.arrow", pa.table({"id": pa.array([1], pa.int32())}), 1, True)
    with pytest.raises(Exception, match="schema mismatch"):
        arrow_ipc.scan_arrow(spark, [files[0], other], {"id": "long"}).collect()
    with pytest.raises(Exception, match="missing"):
        arrow_ipc.scan_arrow(spark, files, {"nothing": "long"}).collect()
