"""WARC archives and their capture index by external merge.

Records are put together by SQL functions and written by Spark's text writer with the
record separator as line end, so the archives land in any shared store and a lost task
is simply written again. Payloads that were seen before become revisit records.

Reading parses each archive by its content lengths and gives one sorted run of captures
a file. Runs are dealt by ranges of (URL key, time, record), and each range merges its
slices of the runs with a loser tree, so the whole index comes out in one global order
without a task that sees more than its range.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import mapped
from ledgerlight.session import ensure_checkpoint_dir

NEWLINE = "\r\n"
SMALLEST = 100  # bytes of a payload that can be revisited
FILE_BYTES = 1 << 28
FILE_RECORDS = 4_000
RANGE_ROWS = 200_000
BROADCAST_DIGESTS = 100_000  # rows of about 60 bytes
# Fixed value: the profile of revisits with equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def planned(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, time_col: str, smallest: int = SMALLEST
) -> DataFrame:
    """Id, URL, time, payload, its size and digest, and the record it repeats (null: none), one row a page.

    Digests are counted first; only those of several records are joined back, by
    broadcast after a count, else by shuffle, where Spark splits a hot digest.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("time"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    base = base.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    many = (
        base.where(F.col("bytes") >= smallest).groupBy(F.unhex("digest").alias("key"))
        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("key", "first")
    )
    side = F.broadcast(many) if many.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else many
    joined = base.join(side, (F.unhex("digest") == F.col("key")) & (F.col("bytes") >= smallest), "left")
    return joined.withColumn("first", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))).drop("key")


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(NEWLINE)), F.lit(""))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record() -> Column:
    """The text of one record of ``planned`` without its closing separator."""
    again = F.col("first").isNotNull()
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(NEWLINE * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + NEWLINE),
        F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit(NEWLINE),
        _header("WARC-Record-ID", urn(F.col("id"))),
        _header("WARC-Target-URI", _one_line(F.col("url"))),
        _header("WARC-Date", F.date_format(F.to_utc_timestamp(F.col("time"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(again, urn(F.col("first")))),
        _header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        F.lit("Content-Type: application/http;msgtype=response" + NEWLINE),
        F.lit("Content-Length: "), length.cast("string"), F.lit(NEWLINE * 2),
        block,
    )


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    time_col: str = "captured", smallest: int = SMALLEST,
) -> None:
    """One record for every row of ``pages``, in files of at most ``FILE_BYTES``.

    Null payloads are empty, null URLs and times are left out, line ends in a URL are
    written as %0D and %0A. Among records of one payload of ``smallest`` bytes or more,
    those with the smallest id are responses (repeated rows all of them) and the others
    revisit it. A payload above 1 GB does not fit a record. An empty table writes no record.
    """
    ready = planned(pages, id_col, url_col, payload_col, time_col, smallest)
    largest = pages.agg(F.max(F.octet_length(F.col(payload_col).cast("string")))).first()[0] or 0
    records = max(1, min(FILE_RECORDS, FILE_BYTES // (largest + 1024)))
    ready.select(record()).write.option("lineSep", NEWLINE * 2).option(
        "maxRecordsPerFile", records
    ).text(path)


def url_key(url: str | None) -> str:
    """Host labels from the top level down, then path and query; scheme and fragment play no part."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return key + (parts.path or "/") + ("?" + parts.query if parts.query else "")


ENTRY = (
    "url_key string, captured string, page_id long, url string, record_type string, refers_to long,"
    " payload_bytes long, payload_digest string, file string, offset long, length long"
)
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in ENTRY.split(", ")]
_URN = re.compile(r"<urn:page:(-?[0-9]+)>")


def _page_of(urn: str | None) -> int | None:
    m = _URN.fullmatch(urn or "")
    return int(m.group(1)) if m else None


def records_of(data: bytes, file: str) -> Iterator[tuple]:
    """Index entries of an archive; raises where a payload does not agree with its digest."""
    at = 0
    while at < len(data):
        start, head_end = at, data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split(NEWLINE)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"{file}: no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        body = head_end + 4
        stop = body + int(fields["Content-Length"])
        http_end = data.index(b"\r\n\r\n", body) + 4
        size = int(re.search(rb"Content-Length: ([0-9]+)", data[body:http_end]).group(1))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "response":
            payload = data[http_end:stop]
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{file}: payload at {start} does not agree with its digest")
        url = fields.get("WARC-Target-URI")
        yield (
            url_key(url), fields.get("WARC-Date", ""), _page_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"],
            _page_of(fields.get("WARC-Refers-To")), size, digest, file, start, stop - start,
        )
        at = stop + 4


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``; those of one file are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = sorted(records_of(data.as_py(), file), key=_order)
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return mapped(files, run, ENTRY)


def merge_sorted(runs: list[list[tuple]]) -> Iterator[tuple]:
    """k sorted lists in one order, by a tree of losers: one comparison a level for each row."""
    runs = [r for r in runs if r]
    width = 1
    while width < max(len(runs), 1):
        width *= 2
    at = [0] * width
    last = (1,)  # after every real key

    def head(k: int) -> tuple:
        return (0, _order(runs[k][at[k]])) if k < len(runs) and at[k] < len(runs[k]) else last

    keys = [head(k) for k in range(width)]
    loser = [0] * width
    winners = list(range(width))
    level = width
    while level > 1:  # first round: losers stay at their node, winners move up
        level //= 2
        moved = []
        for j in range(level):
            a, b = winners[2 * j], winners[2 * j + 1]
            win, lose = (a, b) if keys[a] <= keys[b] else (b, a)
            loser[level + j] = lose
            moved.append(win)
        winners = moved
    top = winners[0]
    while keys[top] != last:
        yield runs[top][at[top]]
        at[top] += 1
        keys[top] = head(top)
        node = (width + top) // 2
        while node:
            if keys[loser[node]] < keys[top]:
                top, loser[node] = loser[node], top
            node //= 2


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the order of URL key, time and page: partition after partition.

    The number of ranges follows the number of rows; a hot URL is cut by time and page.
    """
    ranges = max(1, -(-runs.count() // range_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                slices.setdefault(row[8], []).append(row)
        for own in slices.values():
            own.sort(key=_order)  # blocks of one run may arrive in any order; sorted parts cost a pass
        out = []
        for row in merge_sorted(list(slices.values())):
            out.append(row)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return mapped(dealt, run, ENTRY)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; it goes when the application ends."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def capture_history(pages: DataFrame, path: str, **columns: str) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and return their merged index, read back."""
    write_archives(pages, path, **columns)
    spark = pages.sparkSession
    from ledgerlight.llm.common import stored

    return merged_index(stored(read_runs(spark, path)))
