"""Web archives with revisit records and an externally merged capture index.

* Every page becomes one WARC 1.1 record, a gzip member of its own.  Of equal payloads of
  at least ``min_bytes`` the row with the smallest page_id is a ``response``; the others
  are ``revisit`` records without payload that name its page, target, date and record id.
* Each archive file comes with a locally sorted run of its captures: URL key (host parts
  reversed, as archive indexes have it), timestamp, page id, archive, offset and length.
* The runs are merged by k-way loser trees.  While there are more than ``FAN_IN`` runs,
  tasks merge ``FAN_IN`` of them into one; the last merge is split into key ranges (cut at
  sampled keys), one task each, which reads only its range of every run.  Keys are whole
  (URL key, timestamp, page id, place), so a host or URL with a third of all captures is
  spread over ranges like any others.
* Records are read back through the merged index.

Files are written under names of their own attempt; a written manifest names those that
counted, so lost executors and speculative tasks do no harm.

Defined cases: a null html is an empty payload; payloads below ``min_bytes`` are always
responses; a null url has an empty key and a target that names the page; rows that repeat both the smallest
page_id and its payload are all responses; a null page_id is never the smallest unless all
of its group are null, which are then all responses; an empty table gives no archive and
no row; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, materialize, shuffle_partitions, slices, work_dir

MIN_BYTES = 100
FAN_IN = 64
ARCHIVE_BYTES = 256 << 20
MARK_EVERY = 16
MARKS = 1024
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host parts reversed, no ``www``, port or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").lower()
    except ValueError:
        return quote(url.strip().lower(), safe="/:?&=%#;,+@!$'()*[]~")
    host = re.sub(r"^www\d*\.", "", host)
    path = quote(u.path or "/", safe="/%:@!$&'()*+,;=~")
    query = "?" + quote(u.query, safe="/?%:@!$&'()*+,;=~") if u.query else ""
    return ",".join(reversed(host.split("."))) + ")" + path + query


def header_text(value: str) -> str:
    """A header value without line ends or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def decisions(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages with payload, digest and, for revisits, the response's page_id, url and whether it
    is one record (rows that repeat it are several); ``named`` marks the record they point to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # written first, so that adaptive execution can split the join at a payload of many pages
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "n")))
    again = materialize(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest", "page_id")
                        .agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
                        .groupBy("digest").agg(first.alias("first"), F.sum("n").alias("total"))
                        .where("total > 1").select("digest", F.col("first.page_id").alias("first_id"),
                                                   F.col("first.url").alias("first_url"),
                                                   (F.col("first.n") == 1).alias("single")), "warc-digests")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(again, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("first_url"), F.coalesce(revisit & F.col("single"), F.lit(False)).alias("single"),
        F.coalesce(F.col("single") & F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)).alias("named"))


def capture_time(page_id) -> str:
    """Pages carry no capture time: ``FIRST_CAPTURE`` plus the id in seconds."""
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def response_id(page_id, url, digest: str) -> str:
    """The id of a response that revisits name."""
    return record_id(page_id, capture_time(page_id), url, digest)


def target(page_id, url) -> str:
    """The target URI: the url, or a name of the page where there is none."""
    return header_text(url) if url else "about:blank" if page_id is None else f"urn:page:{page_id}"


def record(page_id, url, payload: bytes, digest: str, refers_to, when: str, own_id: str | None = None,
           first_url=None, single: bool = False) -> bytes:
    """One WARC record; the HTTP head keeps the payload's length, in revisits too.

    A revisit names its response's target, date and, where that is a ``single`` record, id.
    """
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {own_id or response_id(page_id, url, digest)}",
            f"WARC-Date: {when}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Target-URI: {target(page_id, url)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Page: {refers_to}",
                 f"WARC-Refers-To-Target-URI: {target(refers_to, first_url)}",
                 f"WARC-Refers-To-Date: {capture_time(refers_to)}"]
        if single:
            head.append(f"WARC-Refers-To: {response_id(refers_to, first_url, digest)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one stored record; a response's payload digest is verified."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    field = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = block[:int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^content-length: (\d+)", http)[1])
    digest = field["warc-payload-digest"].removeprefix("sha256:")
    if field["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {field['warc-record-id']} does not match its digest")
    page = field.get("warc-page-id", "")
    return {"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest,
            "record_type": field["warc-type"],
            "refers_to": int(field["warc-refers-to-page"]) if "warc-refers-to-page" in field else None,
            "payload": payload if field["warc-type"] == "response" else None}


def run_line(key: str, when: str, page_id, archive: str, offset: int, length: int) -> str:
    """One line of a run; lines sort by URL key, timestamp, page id and place."""
    page = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{key} {when} {page} {archive} {offset:015d} {length}"


def parse_line(line: str):
    key, when, page, archive, offset, length = line.rsplit(" ", 5)
    return key, when, None if page == "-" else int(page) - (1 << 63), archive, int(offset), int(length)


class RunWriter:
    """Writes sorted lines and notes evenly spaced ones with their byte offsets.

    The spacing doubles whenever there are ``MARKS`` notes, so their number is bounded.
    """

    def __init__(self, fs, path: str):
        self.file, self.path = fs.open_output_stream(path, compression=None), path
        self.marks: list[str] = []
        self.offsets: list[int] = []
        self.n = self.size = 0
        self.spacing = MARK_EVERY
        self.held: list[bytes] = []

    def write(self, line: str) -> None:
        if self.n % self.spacing == 0:
            if len(self.marks) == MARKS:
                self.marks, self.offsets, self.spacing = self.marks[::2], self.offsets[::2], 2 * self.spacing
            if self.n % self.spacing == 0:
                self.marks.append(line)
                self.offsets.append(self.size)
        data = line.encode("utf-8", "surrogatepass") + b"\n"
        self.n += 1
        self.size += len(data)
        self.held.append(data)
        if len(self.held) >= 4096:
            self.file.write(b"".join(self.held))
            self.held = []

    def close(self) -> None:
        self.file.write(b"".join(self.held))
        self.file.close()


def read_run(folder: str, name: str, size: int, marks: list[str], offsets: list[int], low, high, block=1 << 16):
    """Lines of a run in [low, high), from the last mark not above ``low``; no handle is kept open."""
    start = offsets[max(0, bisect_right(marks, low) - 1)] if low is not None else 0
    stop = size
    if high is not None:
        k = bisect_left(marks, high)
        stop = offsets[k] if k < len(marks) else size
    fs, base = file_system(folder)
    rest = b""
    while start < stop:
        with fs.open_input_file(f"{base}/{name}") as f:
            data = rest + f.read_at(min(block, stop - start), start)
        start += block
        lines = data.split(b"\n")
        rest = lines.pop()
        for raw in lines:
            line = raw.decode("utf-8", "surrogatepass")
            if low is not None and line < low:
                continue
            if high is not None and line >= high:
                return
            yield line


class LoserTree:
    """k-way merge: inner nodes keep the loser of each match, the top is the next smallest.

    A finished run loses every match; equal lines come in the order of their runs.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [next(r, None) for r in self.runs] or [None]
        self.loser = [-1] * self.k
        self.top = self._play(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self):
        while self.head[self.top] is not None:
            winner = self.top
            yield self.head[winner]
            self.head[winner] = next(self.runs[winner], None)
            node = (winner + self.k) // 2
            while node:
                other = self.loser[node]
                if self._beats(other, winner):
                    self.loser[node], winner = winner, other
                node //= 2
            self.top = winner


RUNS = "name string, n long, size long, marks array<string>, offsets array<long>"


def _run_batch(runs: list[RunWriter], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "name": names, "n": pa.array([r.n for r in runs], pa.int64()),
        "size": pa.array([r.size for r in runs], pa.int64()),
        "marks": pa.array([r.marks for r in runs], pa.list_(pa.string())),
        "offsets": pa.array([r.offsets for r in runs], pa.list_(pa.int64()))})


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all records and each archive's sorted run; returns the runs (materialised)."""
    def write(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out, name, at, lines = None, "", 0, []

        def finish():
            out.close()
            run = RunWriter(fs, f"{base}/{name}.run")
            for line in sorted(lines):
                run.write(line)
            run.close()
            return _run_batch([run], [f"{name}.run"])

        for batch in slices(batches, 256):
            for page_id, url, payload, digest, refers_to, first_url, single, named in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, at, lines = f"archive-{uuid.uuid4().hex}", 0, []
                    out = fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                when = capture_time(page_id)
                # a place in an archive is one record's own; what revisits point to goes by its content
                own_id = None if named else record_id(name, at)
                data = gzip.compress(record(page_id, url, payload, digest, refers_to, when, own_id,
                                            first_url, single), 3, mtime=0)
                out.write(data)
                lines.append(run_line(url_key(url), when, page_id, name, at, len(data)))
                at += len(data)
                if at >= archive_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return materialize(decisions(pages, min_bytes).mapInArrow(write, RUNS), "warc-runs")


def _merge_runs(runs: DataFrame, folder: str, groups: int) -> DataFrame:
    """One round: groups of runs, each merged into one longer run."""
    place = Window.orderBy("name")  # one row per run
    dealt = (runs.withColumn("g", ((F.row_number().over(place) - 1) % groups).cast("int"))
             .repartitionByRange(groups, "g"))

    def merge(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        fs, base = file_system(folder)
        for g in sorted({r["g"] for r in rows}):
            name = f"merged-{uuid.uuid4().hex}.run"
            run = RunWriter(fs, f"{base}/{name}")
            for line in LoserTree([read_run(folder, r["name"], r["size"], r["marks"], r["offsets"], None, None)
                                   for r in rows if r["g"] == g]):
                run.write(line)
            run.close()
            yield _run_batch([run], [name])

    return materialize(dealt.mapInArrow(merge, RUNS), "warc-runs")


def cut_keys(runs: list[dict], n: int) -> list[str]:
    """Up to n - 1 keys that cut the runs' lines into about equal parts: each mark stands
    for the lines from it to the next one."""
    marks = sorted((m, r["n"] / len(r["marks"])) for r in runs for m in r["marks"])
    total, seen, cuts = sum(w for _, w in marks), 0.0, []
    for m, w in marks:
        if seen >= total * (len(cuts) + 1) / n and len(cuts) < n - 1 and (not cuts or m > cuts[-1]):
            cuts.append(m)
        seen += w
    return cuts


CAPTURES = ("part int, place long, url_key string, captured string, page_id long, archive string, "
            "offset long, length long")


def capture_index(runs: DataFrame, folder: str, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """The globally ordered captures: ascending (part, place) is ascending key (materialised)."""
    spark = runs.sparkSession
    n_runs = runs.count()
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        runs = _merge_runs(runs, folder, n_runs)
    n = ranges or shuffle_partitions(spark)
    final = [r.asDict() for r in runs.collect()]  # at most ``fan_in`` runs of ``MARKS`` marks
    cuts = cut_keys(final, n)
    bounds = list(zip([None, *cuts], [*cuts, None]))

    def merge(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                low, high = bounds[part]
                rows, place = [], 0
                for line in LoserTree([read_run(folder, r["name"], r["size"], r["marks"], r["offsets"], low, high)
                                       for r in final]):
                    rows.append((part, place, *parse_line(line)))
                    place += 1
                    if len(rows) == 4096:
                        yield _captures(rows)
                        rows = []
                if rows:
                    yield _captures(rows)

    def _captures(rows):
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in CAPTURES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    parts = spark.range(len(bounds)).select(F.col("id").cast("int").alias("part"))
    return materialize(parts.repartitionByRange(len(bounds), "part").mapInArrow(merge, CAPTURES), "warc-index")


RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url_key string, captured string, position long")


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """Read each capture's record from its archive; ``position`` is its place in the index."""
    n = shuffle_partitions(captures.sparkSession)
    sizes = captures.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per key range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (captures.join(sizes.select("part", before.alias("before")), "part")
              .select("archive", "offset", "length", "url_key", "captured",
                      (F.col("before") + F.col("place")).alias("position")))

    def read(batches):
        fs, base = file_system(folder)
        name, file = None, None
        for batch in slices(batches, 512):
            found = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{base}/{archive}.warc.gz")
                found.append(parse_record(zlib.decompress(file.read_at(length, offset), 31)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in (
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()))]
                + [batch.column(i) for i in (3, 4, 5)], names=[f.split()[0] for f in RECORDS.split(", ")])
        if file is not None:
            file.close()

    return (placed.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
            .mapInArrow(read, RECORDS))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, merge their capture index and read the records back through it."""
    folder = work_dir(spark, "warc")
    runs = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_captures(capture_index(runs, folder), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
