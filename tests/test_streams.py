import json

from pyspark.sql import functions as F

from citeloom.bindings.accounts import _write_snapshot
from citeloom.bindings.events import q_config_stream, q_config_stream_rejects, q_file_stream
from citeloom.operators.events import created_paths, routed
from citeloom.plans.access import snapshot_plan
from citeloom.streaming import jobs
from tests.helpers import rows


def _event(name, bucket, key):
    return {"eventName": name, "s3": {"bucket": {"name": bucket}, "object": {"key": key}}}


def test_bucket_event_stream_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def drop(name, *records):
        (inbox / name).write_text(json.dumps({"Records": list(records)}))
        stream = jobs.bucket_event_stream(spark, str(inbox), "/r")
        jobs.append_sink(stream, out, checkpoint).awaitTermination()
        return rows(spark.read.parquet(out), "path", "route")

    first = drop(
        "1.json",
        _event("s3:ObjectCreated:Put", "p", "pdf/a%20b.pdf"),
        _event("s3:ObjectRemoved:Delete", "p", "pdf/b.pdf"),
        {"eventName": "s3:ObjectCreated:Copy"},
        {},
    )
    assert first == [("/r//", "ignored"), ("/r/p/pdf/a%20b.pdf", "pdf")]
    second = drop("2.json", _event("s3:ObjectCreated:Put", "p", "config/q.json"))
    assert second == sorted([*first, ("/r/p/config/q.json", "config")])


def test_folder_stream(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("p/pdf/a.pdf", "p/pdf/.gitkeep", "p/config/q.yml", "p/html/a.html", "p/pdf/b.txt"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    stream = jobs.folder_stream(spark, str(root), f"file:{root}")
    jobs.append_sink(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, F.substring_index("path", "/", -1), "project", "route") == [
        ("a.pdf", "p", "pdf"),
        ("q.yml", "p", "config"),
    ]


def test_config_folder_stream(spark, tmp_path):
    root = tmp_path / "root"
    folder = root / "p" / "config"
    folder.mkdir(parents=True)
    url = f"file:{root}"
    done = [("p/metadata/old.json",)]

    def run():
        existing = lambda: spark.createDataFrame([(f"{url}/{d[0]}",) for d in done], "path string")
        jobs.config_folder_stream(
            spark, str(root), existing, url, str(tmp_path / "out"), str(tmp_path / "c")
        ).awaitTermination()
        name = F.substring_index("path", "/", -1)
        requests = spark.read.parquet(f"{tmp_path}/out/requests")
        rejects = spark.read.parquet(f"{tmp_path}/out/rejects")
        return rows(requests, name, "query_str"), rows(rejects, name, "reason")

    (folder / "old.json").write_text('{"query_str": "x"}')
    (folder / "new.yaml").write_text("query_str: y\n")
    assert run() == ([("new.yaml", "y")], [("old.json", "destination_exists")])
    done.append(("p/metadata/late.json",))
    (folder / "late.json").write_text('{"query_str": "z"}')
    assert run() == (
        [("new.yaml", "y")],
        [("late.json", "destination_exists"), ("old.json", "destination_exists")],
    )
    status = spark.read.parquet(f"{tmp_path}/out/status")
    assert rows(status.groupBy("stage").count()) == [
        ("config_parsed", 1), ("config_received", 3), ("destination_exists", 2),
    ]


def test_conversion_stream_scans_touched_projects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text(
        json.dumps({"Records": [_event("s3:ObjectCreated:Put", "p", "pdf/new.pdf")]})
    )
    pdfs = spark.createDataFrame(
        [("p", "new.pdf"), ("p", "old.pdf"), ("p", "done.pdf"), ("q", "other.pdf")], "project string, name string"
    )
    htmls = spark.createDataFrame([("p", "done.html"), ("q", "old.html")], "project string, name string")
    jobs.conversion_stream(
        jobs.bucket_event_stream(spark, str(tmp_path / "in"), "/r"),
        lambda: (pdfs, htmls),
        str(tmp_path / "out"),
        str(tmp_path / "c"),
    ).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "name") == [("new.pdf",), ("old.pdf",)]


def test_access_refresh_keeps_the_latest_snapshot(spark, tmp_path, sf_dir):
    inbox, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c"

    def refresh(number):
        _write_snapshot(spark, sf_dir, f"{inbox}/snapshot={number}")
        jobs.access_refresh(spark, inbox, out, checkpoint).awaitTermination()
        return jobs.latest_plan(spark, out)

    refresh(9)
    latest = refresh(10)
    assert rows(latest.select("snapshot").distinct()) == [(10,)]
    want = snapshot_plan(spark, f"{inbox}/snapshot=10")
    assert latest.drop("snapshot").exceptAll(want).count() == 0
    refresh(8)
    assert rows(jobs.latest_plan(spark, out).select("snapshot").distinct()) == [(10,)]


def test_status_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = {"Records": [_event("s3:ObjectCreated:Put", "p", k) for k in ("pdf/a.pdf", "config/a.txt", "html/x")]}
    (tmp_path / "in" / "e.json").write_text(json.dumps(events))
    notifications = spark.read.schema("Records array<struct<eventName: string, s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>").json(str(tmp_path / "in"))
    batch = routed(created_paths(notifications, "/r"), "/r").withColumn("time", F.lit("t"))
    stream = jobs.bucket_event_stream(spark, str(tmp_path / "in"), "/r").withColumn("time", F.lit("t"))
    jobs.append_sink(jobs.status_stream(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "project", "stage", "message")
    assert got == rows(jobs.status_stream(batch), "project", "stage", "message")
    assert [g[1] for g in got] == ["config_bad_format", "config_unreadable", "pdf_received"]


def test_a_large_pdf_beside_a_config_is_not_read(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("config", "pdf"):
        (root / "p" / name).mkdir(parents=True)
    (root / "p" / "pdf" / "big.pdf").write_bytes(b"x" * 10_000)
    (root / "p" / "config" / "q.json").write_text('{"query_str": "x"}')
    (root / "p" / "config" / "r.json").write_text('{"query_str": "y"}')
    none = spark.createDataFrame([], "path string")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        jobs.config_folder_stream(
            spark,
            str(root),
            lambda: none,
            f"file:{root}",
            str(tmp_path / "out"),
            str(tmp_path / "c"),
            files_per_trigger=1,
        ).awaitTermination()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    requests = spark.read.parquet(f"{tmp_path}/out/requests")
    assert rows(requests, "query_str", "batch") == [("x", 0), ("y", 1)] or rows(
        requests, "query_str", "batch"
    ) == [("x", 1), ("y", 0)]


def _config_rows(spark, tmp_path, root, existing=()):
    none = spark.createDataFrame([(f"file:{root}/{x}",) for x in existing], "path string")
    jobs.config_folder_stream(
        spark, str(root), lambda: none, f"file:{root}", str(tmp_path / "out"), str(tmp_path / "c")
    ).awaitTermination()
    name = F.substring_index("path", "/", -1)
    return (
        rows(spark.read.parquet(f"{tmp_path}/out/requests"), name),
        rows(spark.read.parquet(f"{tmp_path}/out/rejects"), name, "reason"),
    )


def test_one_destination_one_request(spark, tmp_path):
    """In one batch, in a later one, and after a restart."""
    root = tmp_path / "root"
    folder = root / "p" / "config"
    folder.mkdir(parents=True)
    (folder / "q.json").write_text('{"query_str": "x"}')
    (folder / "q.yaml").write_text("query_str: y\n")
    (folder / "r.yaml").write_text("query_str: z\n")
    (folder / "e.json").write_text('{"query_str": ""}')
    assert _config_rows(spark, tmp_path, root) == (
        [("q.json",), ("r.yaml",)],
        [("e.json", "empty_query"), ("q.yaml", "destination_exists")],
    )
    # Each call starts the stream anew from its checkpoint; no metadata file is there yet.
    (folder / "r.json").write_text('{"query_str": "z"}')
    (folder / "q.bib").write_text("@article{a, pmid = {1}}")
    # An empty query takes nothing, so another config may have its destination.
    (folder / "e.yaml").write_text("query_str: now\n")
    assert _config_rows(spark, tmp_path, root) == (
        [("e.yaml",), ("q.json",), ("r.yaml",)],
        [
            ("e.json", "empty_query"),
            ("q.bib", "destination_exists"),
            ("q.yaml", "destination_exists"),
            ("r.json", "destination_exists"),
        ],
    )
    (folder / "x.txt").write_text("?")
    (folder / "old.json").write_text('{"query_str": "x"}')
    assert ("old.json", "destination_exists") in _config_rows(spark, tmp_path, root, ["p/metadata/old.json"])[1]


def test_streams_of_tables_that_are_folders(spark, tmp_path, sf_dir):
    """A table may be one file or a folder of parts; its stream has the same rows."""
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (q_config_stream, q_config_stream_rejects, q_file_stream):
        want = rows(query(spark, sf_dir))
        assert want and rows(query(spark, str(tmp_path))) == want
