import pytest
from pyspark.sql import functions as F

from cohortflow.operators import incremental
from cohortflow.sources import files, readers, sinks

HEADER = "P0001 3 200 60000\nP0001.dat 16+0 100 16 0 X\nP0001.dat 16+0 100 16 0 Y\nP0001.dat 16+0 100 16 0 Z\n"


def test_header(spark, tmp_path):
    (tmp_path / "P0001.hea").write_text(HEADER)
    (tmp_path / "bad.hea").write_text("bad 1 200\n")
    (tmp_path / "P0002_H.hea").write_text("other 2 200 100\nP0002.dat 12 X\n")
    (tmp_path / "P0003.hea").write_text("# nothing\n")
    got = {r.record_id: r for r in files.header_inventory(files.read_headers(spark, str(tmp_path))).collect()}
    r = got["P0001"]
    assert (r.path, r.entity_id, r.duration_sec, r.lead_names, r.expected_bytes, r.anomalies) == ("P0001.hea", "P0001", 300.0, ["X", "Y", "Z"], 360000, [])
    assert got["bad"].anomalies == ["UNPARSEABLE_PATIENT_ID", "MALFORMED_RECORD_LINE"]
    assert got["P0002_H"].anomalies == ["RECORD_NAME_MISMATCH", "SIGNAL_LINE_COUNT_MISMATCH", "NON_BYTE_ALIGNED_SIGNAL_FORMAT"]
    assert got["P0003"].anomalies == ["EMPTY_HEADER"]


@pytest.mark.parametrize("encoding,name", [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("cp1252", "windows-1252")])
def test_delimited_encodings(spark, tmp_path, encoding, name):
    p = tmp_path / "t.csv"
    p.write_bytes("id;wert (mm) ;wert (mm)\n1;ä–x;1,5\n2;;NA\n".encode(encoding))
    assert readers.choose_encoding(spark, str(p)) == name
    rows = readers.scan_delimited(spark, str(p)).collect()
    assert rows[0].asDict()["id"] == "1" and rows[0][1] == "ä–x" and rows[1][1] is None and rows[0][2] == "1,5"


def test_latin1_fallback(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes(b"id;v\n1;\x81\xe4\n")
    assert readers.choose_encoding(spark, str(p)) == "ISO-8859-1"


def test_json_report_absent_or_broken(spark, tmp_path):
    assert readers.scan_json_report(spark, str(tmp_path / "no.json"), "a int").count() == 0
    (tmp_path / "b.json").write_text("{broken")
    assert readers.scan_json_report(spark, str(tmp_path / "b.json"), "a int").count() == 0
    (tmp_path / "g.json").write_text('{\n "a": 3\n}')
    assert readers.scan_json_report(spark, str(tmp_path / "g.json"), "a int").first().a == 3


def test_hashes_and_inventory(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.csv").write_bytes(b"1\n")
    got = {r.path: r.digest for r in files.file_hash_table(spark, str(tmp_path)).collect()}
    assert got["d/x.bin"] == hashlib.sha256(b"abc").hexdigest() and set(got) == {"d/x.bin", "y.csv"}
    totals = {r.category: r.bytes for r in files.inventory_totals(files.file_inventory(spark, str(tmp_path))).collect()}
    assert totals == {"OTHER": 3, "REPORT": 2}


def test_range_shards_keep_entities_whole(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 37).alias("entity_id"), F.col("id").alias("window_id"))
    m = sinks.write_range_shards(df, str(tmp_path / "s"), shard_rows=150)
    ranges = sorted((r.first_entity, r.last_entity) for r in m.collect())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and m.agg(F.sum("rows")).first()[0] == 1000


def test_reuse(spark):
    inputs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "entity_id string, fingerprint string")
    done = spark.createDataFrame(
        [("a", "1", "COMPLETE", 3, 3, 1), ("b", "0", "COMPLETE", 3, 3, 1), ("c", "1", "COMPLETE", 3, 2, 1)],
        "entity_id string, fingerprint string, status string, row_count int, stored_rows int, finished_at int",
    )
    assert sorted(r.entity_id for r in incremental.pending_work(inputs, done).collect()) == ["b", "c", "d"]
    assert {r.entity_id: r.work_state for r in incremental.reuse_report(inputs, done).collect()} == {"a": "REUSED", "b": "STALE", "c": "STALE", "d": "NEW"}


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_quoted_line_breaks_stay_in_their_record(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes('id;v\n1;"a\nb;""c"""\n2;plain\n'.encode("cp1252") + "3;\"ä\n–\"\n".encode("cp1252"))
    got = {r.id: r.v for r in readers.scan_delimited(spark, str(p)).collect()}
    assert got == {"1": 'a\nb;"c"', "2": "plain", "3": "ä\n–"}
    lines = tmp_path / "l.csv"
    lines.write_text("id;v\n1;a\n2;b\n")
    assert readers.scan_delimited(spark, str(lines), quoted_breaks=False).count() == 2


def test_shards_are_named_by_their_path(spark, tmp_path):
    base = str(tmp_path / "d")
    spark.range(30).selectExpr("id as entity_id", "id % 3 as part").coalesce(1).write.partitionBy("part").parquet(base)
    names = {r.shard for r in readers.scan_sharded(spark, f"file://{base}").select("shard").distinct().collect()}
    manifest = {r.shard: r["rows"] for r in sinks.shard_manifest(spark.read.parquet(base), base).collect()}
    assert names == set(manifest) and len(names) == 3 and all(n.startswith("part=") for n in names) and set(manifest.values()) == {10}


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    import hashlib

    (tmp_path / "big file.bin").write_bytes(b"x" * 5000)
    (tmp_path / "small.bin").write_bytes(b"y" * 10)
    got = {r.path: (r.digest, r.length) for r in files.file_hash_table(spark, str(tmp_path), stream_bytes=100).collect()}
    assert got == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in (("big file.bin", b"x" * 5000), ("small.bin", b"y" * 10))}


def test_overlapping_shards(spark):
    rows = [("a", 0, 9), ("b", 10, 19), ("c", 19, 25), ("d", 30, 90), ("e", 40, 41), ("f", 95, 99)]
    m = spark.createDataFrame(rows, "shard string, first_entity int, last_entity int")
    for ranges in (1, 3, 8):
        assert sorted(r.shard for r in sinks.overlapping_shards(m, ranges).collect()) == ["c", "e"]


def test_scratch_is_cleared_on_request(spark):
    import os

    from cohortflow import session

    path = session.scratch_path(spark, "once")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path.removeprefix("file:"))
    assert session.clear_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file:")) and session.clear_scratch(spark) == 0


def _small_splits(spark, size):
    """Spark cuts files into splits of at most this many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, str(size))
    return old


@pytest.mark.parametrize("encoding,end", [("utf-8", "\n"), ("utf-8-sig", "\n"), ("cp1252", "\n"), ("utf-8", "\r\n")])
def test_quoted_breaks_across_splits(spark, tmp_path, encoding, end):
    import csv
    import random

    rng = random.Random(5)
    words = ["a", "ü–", ";", '"', "\n", "\n\n", '";"', " ", "x y", "7,5"]
    rows = [[str(i), *["".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(2)]] for i in range(300)]
    rows[40][1] = "line\n" * 400  # spans many splits
    for part in (0, 1):
        with open(tmp_path / f"p{part}.csv", "w", encoding=encoding, newline="") as f:
            w = csv.writer(f, delimiter=";", lineterminator=end, quoting=csv.QUOTE_ALL if part else csv.QUOTE_MINIMAL)
            w.writerow(["id", "one", "two"])
            w.writerows(rows[part * 150:part * 150 + 150])
    want = sorted((a, b, c) for a, b, c in rows)
    old = _small_splits(spark, 600)
    try:
        records = readers.records_across_splits(spark, str(tmp_path), "UTF-8" if encoding != "cp1252" else "ISO-8859-1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8 and records.filter("not header").count() == 300
        split = readers.scan_delimited(spark, str(tmp_path), split_bytes=0)
        got = sorted(tuple(v or "" for v in r) for r in split.collect())
        assert split.columns == ["id", "one", "two"] and got == want
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, readers.scan_delimited(spark, str(tmp_path)).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_stray_quotes_are_read_file_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;size\n1;5" pipe\n2;"x\ny"\n3;z\n')
    old = _small_splits(spark, 8)
    try:
        assert readers.records_across_splits(spark, str(tmp_path)).filter(readers._stray_quote(F.col("record"), ";")).count() > 0
        got = readers.scan_delimited(spark, str(tmp_path), split_bytes=0).collect()
        assert sorted(map(tuple, got)) == [("1", '5" pipe'), ("2", "x\ny"), ("3", "z")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["scan_delimited_encoded", "scan_delimited_split"])
def test_scans_keep_nulls_empty_texts_and_rare_characters(spark, tmp_path, name):
    import duckdb

    from cohortflow import plans
    from cohortflow.plans.registry import ORACLES, QUERIES

    plans.load()
    texts = [None, "", " ", "a\x00b", 'q\x00"\x00"', "\x00\n\x00", "\x01", '"', '""', "a\r\nb", "\r", "\n", ";", "\\", " lead", "trail ", "\ufeffx", "\x85", "é" * 9]
    rows = [(i if i != 6 else None, t, [None, "", "en"][i % 3], len(t or "") if i % 4 else None) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(ORACLES[name]).fetchall(), key=repr)


@pytest.mark.parametrize("mark", [b"\x00", b"\x01", b""])
def test_encoding_is_checked_in_whole_lines(spark, tmp_path, mark):
    (tmp_path / "t.csv").write_bytes(b"id;v\n1;a" + mark + b"\xe4\n")
    assert readers.choose_encoding(spark, str(tmp_path)) == "windows-1252"


def test_split_text_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n")
    got = readers.scan_delimited(spark, str(tmp_path), split_bytes=0)
    assert got.columns == ["id", "v"] and got.count() == 0


def test_value_preservation_counts_cells_in_tasks_by_their_number(spark, monkeypatch):
    from cohortflow.operators import quality

    monkeypatch.setattr(quality, "TASK_CELLS", 100)
    a = spark.createDataFrame([(i, "x", "y") for i in range(600)] + [(1, "x", "y"), (1, "x", " "), (None, "z", None)], "k long, s string, u string")
    b = spark.createDataFrame([(i, " x ", "y") for i in range(600) if i != 7] + [(None, "z", ""), (9, "x", "w"), (9, "x", "w")], "k long, s string, u string")
    out = quality.value_preservation(a, b, "k", ["s", "u"])
    want = [(1, "s", "x", "SOURCE")] * 2 + [(1, "u", None, "SOURCE"), (1, "u", "y", "SOURCE"), (7, "s", "x", "SOURCE"), (7, "u", "y", "SOURCE")]
    want += [(9, "s", "x", "STORED")] * 2 + [(9, "u", "w", "STORED")] * 2
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert out.rdd.getNumPartitions() >= 24  # 2 406 cells


def test_header_files_are_written_by_tasks_of_their_number(spark, sf, tmp_path, monkeypatch):
    from cohortflow import plans
    from cohortflow.plans import source_queries
    from cohortflow.plans.registry import QUERIES

    plans.load()
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(source_queries, "HEADERS_PER_TASK", 1)
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert QUERIES["read_headers"](spark, sf).count() == n
    written = [f.name for f in tmp_path.rglob("part-*.txt")]
    assert len(written) == n and len({f.split("-")[1] for f in written}) > 2  # the number of the task that wrote it
