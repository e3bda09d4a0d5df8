import hashlib
import io

import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

from sitegrade.llm import warc as W

HTML = "<html>" + "é" * 100 + "</html>"
ROWS = [
    (5, "http://a/1", HTML),
    (3, None, HTML),
    (9, "http://a/\r\nX: 1", HTML),
    (9, "http://a/2", HTML),
    (4, "http://a/3", "short"),
    (6, "http://a/4", "short"),
    (7, "http://a/5", None),
    (8, "http://a/6", ""),
    (None, "http://a/7", HTML),
    (None, "http://a/8", "a" * 200),
    (None, "http://a/9", "a" * 200),
    (10, "http://b/", "WARC/1.1\r\n\r\n" + "x" * 700_000),
    (3, "http://a/1", HTML),
]


@pytest.fixture
def pages(spark, edge):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string").withColumn("bundle", F.lit("mine"))


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = W.write_archives(pages.repartition(3), folder, frame_bytes=400)
    got = W.read_archives(index, folder).collect()
    assert len(got) == len(ROWS) and len({r.record_id for r in got}) == len(ROWS)
    for r in got:
        same = [html for i, _, html in ROWS if i == r.page_id]
        full = next(h for h in same if hashlib.sha256((h or "").encode()).hexdigest() == r.payload_digest) or ""
        assert r.payload_bytes == len(full.encode())
        if full == HTML and r.page_id != 3:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 3, None)
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
            assert bytes(r.payload) == full.encode()
    (one,) = W.lookup(index, spark.createDataFrame([(10,)], "page_id bigint"), folder).collect()
    assert one.payload_bytes == 700_012


def test_bundles_are_plain_zstandard_with_a_seek_table(pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = W.write_archives(pages.coalesce(1), folder, frame_bytes=1000)
    places = index.collect()
    for bundle in {r.bundle for r in places}:
        data = open(bundle, "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        frames = W.seek_table(pafs.LocalFileSystem().open_input_file(bundle))
        assert len(whole) == sum(f.size for f in frames) and whole.startswith(b"WARC/1.1")
        for r in (r for r in places if r.bundle == bundle):
            frame = frames[r.frame]
            assert (frame.offset, frame.compressed, frame.size) == (r.frame_offset, r.frame_compressed, r.frame_size)
            start = sum(f.size for f in frames[: r.frame]) + r.record_offset
            headers, _, _ = W.parse_record(whole, start)
            assert headers["WARC-Record-ID"] == f"<{r.record_id}>"


def test_empty_table(pages):
    assert W.archive_round_trip(pages.filter("false")).collect() == []


def test_text_ids(spark, edge, tmp_path):
    ids = ["a:b", "<x>", "é 1", "00", None, "z\r\n"]
    rows = [(i, HTML + str(i)) for i in ids] + [("copy", HTML + "00")]
    pages = spark.createDataFrame(rows, "page_id string, html string").withColumn("url", F.lit("http://a/"))
    got = {r.page_id: r for r in W.archive_round_trip(pages).collect()}
    assert set(got) == {*ids, "copy"}
    assert got["copy"].refers_to == "00" and got["<x>"].record_type == "response"


def test_an_index_that_is_not_the_bundles_is_refused(pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = W.write_archives(pages.coalesce(1), folder, frame_bytes=1000)
    wrong = index.withColumn("frame_size", F.col("frame_size") + 1)
    with pytest.raises(Exception, match="seek table"):
        W.read_archives(wrong, folder).collect()


def test_tasks_follow_the_data(pages, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/warc"
    index = W.write_archives(pages.coalesce(1), folder, frame_bytes=400)
    monkeypatch.setattr(W, "TASK_BYTES", 100_000)
    assert W.read_archives(index, folder).rdd.getNumPartitions() == 8


def test_hadoop_names_of_a_store():
    assert W.file_system("file:///tmp/x")[1] == "/tmp/x"
