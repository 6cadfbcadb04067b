import gzip

from kgforge.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    out = set()
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        data = (html or "").encode()
        out.add((page, len(data), warc.base32_sha1(data), "response" if page == first else "revisit", None if page == first else first))
    return out


def test_round_trip(spark):
    rows = [(5, "http://a/ b\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (7, "u", ""), (11, "u", "x\r\n\r\ny" * 50_000), (None, "u", "<p>é</p>"), (3, None, "<p>é</p>")]
    got = [tuple(r) for r in warc.op10(spark.createDataFrame(rows, PAGES)).collect()]
    assert len(got) == len(rows) and set(got) == expected(rows)


def test_payloads_come_back(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 3}</p>" * 100) for k in range(20)]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES))
    for r in index.where("record_type = 'response'").collect():
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            x = warc.parse(gzip.decompress(f.read(r["length"])))
        assert x["payload"].decode() == rows[r["page_id"]][2] and x["warc-target-uri"] == rows[r["page_id"]][1]
    some = warc.read_records(index.where("page_id % 7 = 0"), index.archive_root, gap=0, most=100)
    assert sorted(r["page_id"] for r in some.collect()) == [0, 7, 14]


def test_empty_table(spark):
    assert warc.op10(spark.createDataFrame([], PAGES)).count() == 0


def test_other_columns(spark):
    rows = spark.createDataFrame([(1, "u", "h", "x", 2)], PAGES + ", digest string, salt int")
    assert warc.op10(rows).count() == 1
