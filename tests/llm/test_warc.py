import hashlib
import io
import zipfile

from quillspark.llm import warc


def rows(spark, pages):
    return sorted(warc.read_archives(spark, warc.write_archives(pages, max_records=3), records_a_task=2).collect(), key=repr)


def test_round_trip_and_revisits(spark):
    big, small = "é" * 60, "x" * 99
    data = [(5, "u", big, 1), (2, "u\r\nv", big, 1), (9, None, big, 1), (1, "u", small, 1), (3, "u", small, 1), (4, "u", None, 1), (6, "u", "", 1), (2, "u", big, 1), (None, "u", big, 1), (7, "u", "a\r\n\r\nb" * 5000, 1)]
    got = rows(spark, spark.createDataFrame(data, "page_id long, url string, html string, payload long"))
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [x.record_type for x in by[2]] == ["response"] * 2
    for i in (5, 9, None):
        assert (by[i][0].record_type, by[i][0].refers_to, by[i][0].payload) == ("revisit", 2, None)
        assert by[i][0].payload_bytes == 120 and by[i][0].payload_digest == hashlib.sha256(big.encode()).hexdigest()
    assert {by[i][0].record_type for i in (1, 3, 4, 6, 7)} == {"response"}
    assert by[4][0].payload == b"" and by[7][0].payload == b"a\r\n\r\nb" * 5000


def test_reading_tasks_grow_with_the_archives(spark):
    from pyspark.sql import functions as F

    for n in (12, 120):
        pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(n)], "page_id long, url string, html string").repartition(3)
        manifest = warc.write_archives(pages, max_records=20)
        read = warc.read_archives(spark, manifest, records_a_task=4)
        assert read.count() == n and read.select(F.spark_partition_id()).distinct().count() >= n // 8
        read = warc.read_archives(spark, manifest, bytes_a_task=400)
        assert read.count() == n and read.select(F.spark_partition_id()).distinct().count() >= n // 8


def test_empty(spark):
    assert rows(spark, spark.createDataFrame([], "page_id long, url string, html string")) == []


def test_zip64_directory_agrees_with_zipfile():
    sink = io.BytesIO()

    class Stream:  # can't seek
        write, flush = sink.write, sink.flush

    a = warc.Archive(Stream())
    for i in range(5):
        a.add(i, warc.record(i, "u", b"p" * i, i, hashlib.sha256(b"p" * i).hexdigest(), None))
    a.close()
    raw = sink.getvalue()
    assert zipfile.ZipFile(io.BytesIO(raw)).namelist() == list(warc.members(io.BytesIO(raw)))
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(raw), 1, 4)] == [1, 2, 3]
    # the same archive with a ZIP64 end record and saturated fields
    m = warc.members(io.BytesIO(raw))
    at = raw.rfind(warc.END)
    count, length, start = warc.struct.unpack_from("<HII", raw, at + 10)
    directory, p = b"", start
    for x in m.values():
        entry = raw[p : p + 46 + len(x.name)]
        n_extra = warc.struct.unpack_from("<H", entry, 30)[0]
        extra = warc.struct.pack("<HHQQQ", 1, 24, x.size, x.size, x.header)
        directory += entry[:20] + b"\xff" * 8 + entry[28:30] + warc.struct.pack("<H", len(extra)) + entry[32:42] + b"\xff" * 4 + x.name.encode() + extra
        p += 46 + len(x.name) + n_extra
    end64 = warc.END64 + warc.struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(directory), start)
    locator = warc.LOCATOR64 + warc.struct.pack("<IQI", 0, start + len(directory), 1)
    end = warc.END + warc.struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = raw[:start] + directory + end64 + locator + end
    assert warc.members(io.BytesIO(big)) == m
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(big))] == [0, 1, 2, 3, 4]
