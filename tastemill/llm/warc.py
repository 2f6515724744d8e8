"""Operator 4: WARC archives and their capture index.

Archives are written by Spark's text sink (a record ends with two line ends, which is the
sink's separator) and read back as binary files, so they can lie in any store that Spark
reaches. Each reading task sorts the captures it saw into a run; the runs are cut at
common split keys, every slice goes to the task of its key range, and there a loser tree
merges the slices by URL key and timestamp. The result is the globally ordered history of
captures: by (range_no, position).
"""

from __future__ import annotations

import bisect
import hashlib
import io
import pickle
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._jobs import parts, shared_path, split_listed, written
from tastemill.llm._merge import LoserTree

CAPTURES = "url_key string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, at long"
RUNS = "run long, line long, " + CAPTURES
_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
# Record fields of the WARC 1.1 format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE, GAP = "\r\n", "\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: reversed host, then path and query, lower case, no www., fragment or scheme."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.split(bare, r"[/?]", 2)[0], r"^.*@|:\d+$", ""), r"^(www\d*|m)\.", "")
    path = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path)))


def with_first_capture(pages: DataFrame, least: int = 100) -> DataFrame:
    """Adds payload, n, digest and ``first``: the smallest page_id with the same payload, if that has ``least`` bytes."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), F.col("date"))
    full = full.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    firsts = full.where(F.col("n") >= least).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    firsts = written(firsts, "warc-repeated")
    # only pages whose payload may occur twice are shuffled; a hot payload is split by the adaptive skew join
    stay, asked = split_listed(full, ["digest"], firsts, ["d"])
    return asked.join(firsts.hint("merge"), F.col("digest") == F.col("d"), "left").drop("d").unionByName(stay, allowMissingColumns=True)


def records(captures: DataFrame) -> DataFrame:
    """(value, size): one WARC record a row, without the two line ends behind it, and the bytes of its block."""
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + LINE + "Content-Type: text/html; charset=utf-8" + LINE + "Content-Length: "), F.col("n").cast("string"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), target)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"), F.lit(LINE + "WARC-Profile: " + PROFILE))),
        F.concat(F.lit("X-URL-Key: "), url_key(F.col("url"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return captures.select(F.concat(F.concat_ws(LINE, *lines), F.lit(GAP), block).alias("value"), F.octet_length(block).alias("size"))


def write_archives(pages: DataFrame, path: str, per_file: int = 5000, small: int = 1 << 16) -> None:
    """Gzipped WARC files under ``path``; pages: page_id, url, html, date (ISO, UTC).

    A file holds at most ``per_file`` records of less than ``small`` bytes, half as many of
    less than twice that, and so on: about per_file * small bytes, or one record.
    """
    # a record's number in its task, without the task's own number
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    grade = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)) / small)) + 1).cast("int")
    each = F.greatest(F.lit(1), F.floor(F.lit(per_file) / F.pow(F.lit(2.0), "grade")))
    rows = records(with_first_capture(pages)).withColumns({"grade": grade, "number": number}).select("value", "grade", F.floor(F.col("number") / each).alias("volume"))
    rows.write.partitionBy("grade", "volume").option("lineSep", GAP).option("compression", "gzip").text(path)


def _stream(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive in steps of about 1 MB; gzip members may follow one another."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        data = member.decompress(content, 1 << 20)
        while data or not member.eof:
            yield data
            if member.eof:
                break
            left = member.unconsumed_tail
            if not left and not data:
                raise ValueError("a gzip member is cut off")
            data = member.decompress(left, 1 << 20)
        content = member.unused_data


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields in lower case, block) of every record of an archive."""
    have, at, source = bytearray(), 0, _stream(content)

    def more() -> bool:
        data = next(source, None)
        have.extend(data or b"")
        return data is not None

    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not more():
                if have.strip():
                    raise ValueError("a record's header is cut off")
                return
        first, *lines = have[:end].decode("utf-8", "replace").split(LINE)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        while len(have) < end + 4 + length + 4:
            if not more():
                raise ValueError("a record is cut off")
        yield at, fields, bytes(have[end + 4 : end + 4 + length])
        at += end + 4 + length + 4
        del have[: end + 4 + length + 4]


def _page(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def _capture(file: str, at: int, f: dict[str, str], block: bytes) -> tuple:
    revisit = f["warc-type"] == "revisit"
    head, _, payload = block.partition(b"\r\n\r\n")
    if revisit:  # the payload is in the record referred to; its size and digest are in the headers
        n = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = f["warc-payload-digest"].removeprefix("sha256:")
    else:
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return f.get("x-url-key", ""), f["warc-date"], _page(f["warc-record-id"]), f["warc-type"], _page(f.get("warc-refers-to")), n, digest, file, at


def _key(c: tuple) -> tuple:
    """The order of histories: URL key, timestamp, page (null first), place."""
    return c[0], c[1], c[2] is not None, c[2] or 0, c[7], c[8]


def _read(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the captures in a task's archives."""
    run, held = TaskContext.get().partitionId() << 32, []

    def out() -> pa.RecordBatch:
        held.sort(key=_key)
        m = len(held)
        return pa.RecordBatch.from_arrays([pa.array([run] * m, pa.int64()), pa.array(range(m), pa.int64()), *(pa.array([c[i] for c in held], t) for i, t in enumerate(_TYPES))], names=["run", "line", *_NAMES])

    for batch in batches:
        for i in range(batch.num_rows):
            file = "/".join(batch.column(0)[i].as_py().rsplit("/", 3)[1:])  # grade, volume, name
            for at, fields, block in parse(batch.column(1)[i].as_py()):
                if fields["warc-type"] in ("response", "revisit"):
                    held.append(_capture(file, at, fields, block))
                    if len(held) == run_rows:
                        yield out()
                        run, held = run + 1, []
    if held:
        yield out()


def _cut(batches: Iterator[pa.RecordBatch], splits: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Each run's slices between the split keys, packed."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for run, lines in groupby(rows, key=lambda r: r[0]):
            captures = [r[2:] for r in lines]
            captures.sort(key=_key)  # already in order, unless a reader has mixed the lines
            for part, own in groupby(captures, key=lambda c: bisect.bisect_right(splits, _key(c)[:4])):
                out.append((part, run, pickle.dumps(list(own), 5)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["part", "run", "slice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def slices() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for part, own in groupby(slices(), key=lambda s: s[0]):
        tree = LoserTree([((_key(c), c) for c in pickle.load(io.BytesIO(s[2]))) for s in own])
        rows, position = [], 0
        for _, c in tree:
            rows.append((*c, part, position))
            position += 1
            if len(rows) == 20_000:
                yield _histories(rows)
                rows = []
        if rows:
            yield _histories(rows)


HISTORIES = CAPTURES + ", range_no int, position long"


def _histories(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([*_TYPES, pa.int32(), pa.int64()])], names=[*_NAMES, "range_no", "position"])


def capture_histories(spark: SparkSession, path: str, run_rows: int = 50_000, sample: int = 20_000) -> DataFrame:
    """The captures in the archives under ``path``, globally ordered by (range_no, position).

    Columns: url_key, timestamp, page_id, record_type, refers_to, payload_bytes,
    payload_digest, file, at (offset in the unpacked archive), range_no, position.
    ``run_rows`` bounds a run, ``sample`` about bounds the keys that the driver looks at to
    choose the ranges; ranges end at (URL key, timestamp, page), so one URL's captures may
    fill several.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = written(files.mapInArrow(lambda b: _read(b, run_rows), RUNS), "warc-runs")
    n = runs.count()
    ranges = parts(spark, 300 * n)
    keys = runs.select("url_key", "timestamp", F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0))).sample(min(1.0, sample / max(n, 1)), seed=1)
    seen = sorted(tuple(r) for r in keys.toLocalIterator())
    splits = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    cut = runs.mapInArrow(lambda b: _cut(b, splits), "part int, run long, slice binary")
    dealt = cut.repartition(ranges, "part").sortWithinPartitions("part", "run")
    return dealt.mapInArrow(_merge, HISTORIES)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html, date) as archives in the shared folder and read the histories back.

    Null html: an empty payload. Null url: no target, URL key "". Of records with equal
    payloads of at least 100 bytes, that with the smallest page_id is the response; rows
    that repeat its page_id are responses too. Null page_id: never referred to, revisits
    others. Empty table: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return capture_histories(spark, path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # pages carry no capture time: one second a page, from a fixed day
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return archived(pages.select("page_id", "url", "html", date.alias("date"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT page_id, n, sha256(h) AS d, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY sha256(h)) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM q
"""
