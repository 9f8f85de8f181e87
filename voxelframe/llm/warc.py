"""WARC archives of pages with deduplicated payloads, and the merged index of their captures.

Archives are written with Spark's text writer: one record per line, the line separator being the two empty lines that end a
record. They are WARC files, compressed as a whole, on any store. Of pages with equal payloads (SHA-1 and length) of at least ``min_bytes`` bytes
the one with the smallest id is a response; the others are revisit records that refer to it and hold no payload.

Reading parses whole archives by their content lengths. The captures of each archive are sorted by URL key and time: a run.
The index is cut into key ranges; in each, a loser tree merges the parts of all runs, so the ranges, one after the other, hold
the captures of all archives in global order. A URL with very many captures is cut by time and id like anything else.

Defined results: a null payload is empty, a null URL an empty key; a null capture time is ``FIRST_CAPTURE``, one outside the years 1970
to 9999 raises; a null id is never referred to and is a response only if no
page with the payload has an id; rows that share the smallest id of a payload are all responses; no pages give no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.text import sized
from voxelframe.session import scratch_path

MIN_BYTES = 0
SALTS = 16
RANGE_BYTES = 16 << 20
RECORDS_PER_ARCHIVE = 5000
FIRST_CAPTURE = 1_704_067_200
CAPTURE_SPAN = 366 * 86_400
LAST_CAPTURE = 253_402_300_799  # the end of the year 9999: later times have no text of the same length
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "urn:page:"


def url_key(url: str) -> str:
    """Host labels reversed, then path and sorted query; scheme, ``www.`` and letter case of the host don't count."""
    try:
        u = urlsplit(url.strip())
        host = (u.netloc.rpartition("@")[2] or "").lower()
    except ValueError:
        return url
    host = re.sub(r"^www\d*\.", "", re.sub(r":(80|443)$", "", host))
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{query}" if query else "")


def digests(pages: DataFrame) -> DataFrame:
    """The table (page_id, url, html, at) with payload_bytes and payload_digest (base32 SHA-1)."""

    def run(batches):
        for b in batches:
            html = b.column(b.schema.get_field_index("html")).to_pylist()
            data = [x.encode() for x in html]
            digest = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in data]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(len, data), pa.int64()), pa.array(digest)], [*b.schema.names, "payload_bytes", "payload_digest"])

    return pages.mapInArrow(run, "page_id long, url string, at long, html string, payload_bytes long, payload_digest string")


def _header(name: str, value):
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None, min_bytes: int = MIN_BYTES) -> None:
    """Write the archives of a table of pages to a new folder.

    ``captured``: seconds since 1970, up to the year 9999; default the page id modulo a year, from ``FIRST_CAPTURE`` on.
    """
    if captured:
        at = F.coalesce(F.col(f"`{captured}`").cast("long"), F.lit(FIRST_CAPTURE))
        at = F.when(at.between(0, LAST_CAPTURE), at).otherwise(F.raise_error(F.lit("a capture time is not between 1970 and 9999")).cast("long"))
    else:
        at = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col(f"`{page_id}`").cast("long"), F.lit(0)), F.lit(CAPTURE_SPAN))
    slim = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), at.alias("at"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
    )
    full = digests(slim)
    firsts = digests(slim).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # pages that share no payload are responses; the others meet their first page under a salt, however many there are of one payload
    shared = firsts.filter("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    full = full.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = full.join(shared, ["payload_digest", "payload_bytes", "salt"], "left")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    body = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    date = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    safe_url = F.regexp_replace("url", r"[\r\n]", "")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Target-URI", safe_url), _header("WARC-Date", date),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), _header("X-Payload-Length", F.col("payload_bytes")),
        F.when(again, F.concat(
            _header("WARC-Refers-To", F.concat(F.lit(f"<{PAGE}"), F.col("first_id").cast("string"), F.lit(">"))),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _header("Content-Length", F.octet_length(body)), F.lit("\r\n"), body,
    )
    joined.select(record.alias("value")).write.mode("error").option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).option("compression", "gzip").text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset) of every record of an archive."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:split].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = split + 4
        end = begin + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield headers, data[begin:end], at
        at = end + 4


CAPTURES = (
    "page_id long, url string, url_key string, captured string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, archive string, at long, length long"
)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives of a folder, each archive's sorted by URL key, time, id; payloads are checked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = gzip.decompress(data) if name.endswith(".gz") else data
                rows = []
                for h, block, at in records(data):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, n = h["warc-payload-digest"].partition(":")[2], int(h["x-payload-length"])
                    if h["warc-type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: the payload at {at} isn't what its header says")
                    ids = [int(x) if x else None for x in (h.get(k, "").removeprefix(f"<{PAGE}").rstrip(">") for k in ("warc-record-id", "warc-refers-to"))]
                    url = h["warc-target-uri"]
                    rows.append((url_key(url), h["warc-date"], ids[0] is not None, ids[0] or 0, at, url, h["warc-type"], ids[1], n, digest, len(block)))
                rows.sort(key=lambda r: r[:5])
                if rows:
                    key, date, has, page, at, url, kind, refers, n, digest, length = map(list, zip(*rows))
                    page = [p if x else None for p, x in zip(page, has)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in ((page, pa.int64()), (url, pa.string()), (key, pa.string()), (date, pa.string()), (kind, pa.string()), (refers, pa.int64()), (n, pa.int64()), (digest, pa.string()), ([name] * len(rows), pa.string()), (at, pa.int64()), (length, pa.int64()))],
                        ["page_id", "url", "url_key", "captured", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "at", "length"],
                    )

    return files.mapInArrow(parse, CAPTURES)


def loser_tree_merge(sorted_runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists: each inner node keeps the loser of its match, so a step replays one path from leaf to root."""
    k = len(sorted_runs)
    if not k:
        return
    heads = [r[0] if r else None for r in sorted_runs]
    at = [0] * k
    tree = [-1] * k  # tree[0] is the winner

    def beats(a: int, b: int) -> bool:
        if b < 0 or heads[b] is None:
            return b >= 0 or heads[a] is not None
        return heads[a] is not None and (heads[a], a) < (heads[b], b)

    def replay(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                return
            if not beats(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2
        tree[0] = winner

    for leaf in range(k):
        replay(leaf)
    while heads[w := tree[0]] is not None:
        yield heads[w]
        at[w] += 1
        heads[w] = sorted_runs[w][at[w]] if at[w] < len(sorted_runs[w]) else None
        replay(w)


def merged_index(runs_: DataFrame, ranges: int) -> DataFrame:
    """Captures in global order: by ``range_no``, then ``range_pos``. Input: stored runs, as of :func:`runs`."""
    keys = ["url_key", "captured", "page_id", "archive", "at"]
    names = runs_.columns

    def merge(batches):
        from pyspark import TaskContext

        parts: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            column = b.column(names.index("archive")).dictionary_encode()
            of = column.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(column.dictionary.to_pylist()):
                parts.setdefault(name, []).append(b.filter(pa.array(of == i)))
        tables = [pa.Table.from_batches(p) for _, p in sorted(parts.items())]
        lists = []
        for number, t in enumerate(tables):
            cols = [t.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "at")]
            rows = [(k, c, p is not None, p or 0, a, number, i) for i, (k, c, p, a) in enumerate(zip(*cols))]
            if any(a > b for a, b in zip(rows, rows[1:])):  # blocks of a run may come in any order
                rows.sort()
            lists.append(rows)
        if not tables:
            return
        starts, n = [], 0
        for t in tables:
            starts.append(n)
            n += len(t)
        order = [starts[r[5]] + r[6] for r in loser_tree_merge(lists)]
        whole = pa.concat_tables(tables).take(pa.array(order, pa.int64()))
        whole = whole.append_column("range_no", pa.array([TaskContext.get().partitionId()] * n, pa.int32())).append_column("range_pos", pa.array(range(n), pa.int64()))
        yield from whole.combine_chunks().to_batches()

    return runs_.repartitionByRange(ranges, *keys).mapInArrow(merge, f"{CAPTURES}, range_no int, range_pos long")


def write_and_read(pages: DataFrame, **names) -> DataFrame:
    """Write archives and their runs to new folders below the shared one; return the merged index."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, f"{folder}/archives", **names)
    runs(spark, f"{folder}/archives").write.parquet(f"{folder}/runs")
    stored = spark.read.schema(CAPTURES).parquet(f"{folder}/runs")
    return merged_index(stored, sized(stored, RANGE_BYTES))
