"""Web archives: records, revisits, the merged index and reading back."""

import gzip
import hashlib
import random

import pytest

from stagecraft.llm import warc
from stagecraft.llm.common import file_system, work_dir

from .common_rows import SF


def expected(rows, least=100):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = data in first and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                    first[data] if again else None))
    return sorted(map(str, out))


def archived(spark, df, **options):
    folder = work_dir(spark, "warc-test")
    runs = warc.write_archives(df, folder, **{k: v for k, v in options.items() if k == "archive_bytes"})
    index = warc.capture_index(runs, folder, **{k: v for k, v in options.items() if k != "archive_bytes"})
    return folder, runs, index, warc.read_captures(index, folder)


def test_pages_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    rows += [(i + 10_000, u, h) for i, u, h in rows[:40]] + [(9, "http://a.b/", "short"), (8, "http://a.b/", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, _, index, got = archived(spark, df)
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == expected(rows)
    assert index.count() == len(rows)


def test_index_is_globally_ordered_over_many_runs(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{'www.' * rng.randint(0, 1)}h{rng.randint(0, 3)}.example.org/p{rng.randint(0, 9)}", f"page {i} " * 30)
            for i in range(700)]
    rows += [(1000 + i, "http://hot.example.org/", f"hot {i} " * 30) for i in range(400)]  # one URL, a third of all
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    folder, runs, index, got = archived(spark, df, archive_bytes=2000, ranges=7, fan_in=4)
    assert runs.count() > 16  # several rounds of merging
    lines = [(r["url_key"], r["captured"], r["page_id"]) for r in index.orderBy("part", "place").collect()]
    assert lines == sorted((warc.url_key(u), (warc.FIRST_CAPTURE + warc.timedelta(seconds=i)).strftime("%Y-%m-%dT%H:%M:%SZ"), i)
                           for i, u, _ in rows)
    sizes = [r["count"] for r in index.groupBy("part").count().collect()]
    assert max(sizes) < len(rows) / 2  # the hot URL is spread over ranges
    back = got.orderBy("position").collect()
    assert [r["page_id"] for r in back] == [x[2] for x in lines] and [r["position"] for r in back] == list(range(len(rows)))
    name = index.first()["archive"]
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/{name}.warc.gz", compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")  # an ordinary gzip file


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 21])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(str(rng.randint(0, 30)) for _ in range(rng.randint(0, 12))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Thering.example.org:80/de/1.html#top") == "org,example,thering)/de/1.html"
    assert warc.url_key("https://a.b") == "b,a)/" and warc.url_key(None) == "" == warc.url_key("")
    assert " " not in warc.url_key("http://a.b/x y?q=1 2") and warc.url_key("http://[bad") != ""


def test_odd_pages(spark):
    big = "<p>" + "x" * 400_000
    rows = [(1, None, None), (2, "", ""), (3, "http://a\r\nX: y", big), (4, "http://a/", big), (4, "http://a/", big),
            (None, "http://a/", big), (None, "no url at all", "é" * 60), (3, "http://b/", big), (-5, "http://n/", "n" * 200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, part int")
    _, _, _, got = archived(spark, df)
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == expected(rows)
    assert archived(spark, df.where("false"))[3].count() == 0


def test_a_damaged_payload_is_noticed():
    data = warc.record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(data.replace(b"payload", b"Payload"))


def test_other_readers_can_follow_the_records(spark):
    big, other = "b" * 300, "o" * 300
    rows = [(5, "http://a/5", big), (7, "http://a/7", big), (8, None, big), (1, "http://t/", other), (1, "http://t/", other),
            (2, "http://t/2", other), (9, "http://s/", "short"), (9, "http://s/", "short"), (None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, _, index, _ = archived(spark, df)
    fs, base = file_system(folder)
    heads = []
    for name in {r["archive"] for r in index.collect()}:
        with fs.open_input_stream(f"{base}/{name}.warc.gz", compression=None) as f:
            data = gzip.decompress(f.read())
        heads += [dict(line.split(": ", 1) for line in part.split("\r\n\r\n")[0].split("\r\n") if ": " in line)
                  for part in data.decode().split("WARC/1.1")[1:]]
    assert len(heads) == len(rows) and len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    assert all(h["WARC-Target-URI"] for h in heads)
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert sorted(h["WARC-Page-ID"] for h in revisits) == ["2", "7", "8"]
    for h in revisits:
        if h["WARC-Refers-To-Page"] == "5":
            first = by_id[h["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Page-ID"] == "5"
            assert first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
            assert (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]) == (first["WARC-Target-URI"], first["WARC-Date"])
        else:  # its response stands twice: named by target and date
            assert "WARC-Refers-To" not in h and h["WARC-Refers-To-Target-URI"] == "http://t/"
