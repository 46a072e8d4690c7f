"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.llm.files import make_folder, open_store, write_atomically
from itemlake.plans.scratch import materialise

_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_PROBE = 1 << 14
_CHUNK = 1 << 20
_SCHEMA = (
    "path string, offset long, length long, record_id string, record_type string, target_uri string, "
    "payload_digest string, refers_to string, payload_bytes long, payload binary"
)


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: 40 hex digits, ten (50 -> 8 digits of 5 bits) at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _member(page_id, url, kind: str, digest: str, refers, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "" if page_id is None else page_id
    url = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{name}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers}>"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one gzip member per row into WARC files below folder; returns the manifest (path, records, bytes).

    Of rows whose payloads (UTF-8 html; null: empty) are equal and at least min_bytes long, the one
    with the largest id is a response and the others revisit it. Rows that repeat that id are all
    responses; a null id never is the largest unless all are null. Other columns are ignored. An empty
    table leaves an empty folder.
    One file per shuffle partition, rows sorted by id and digest, so that a task that runs again
    writes the same bytes; files appear under their final name only when whole.
    """
    make_folder(folder)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload")))
    equal = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first_id")
    )
    rows = rows.join(equal, "digest", "left").withColumn(
        "kind", F.when(F.col("first_id").isNull() | F.col("first_id").eqNullSafe(F.col("page_id")), "response").otherwise("revisit")
    )
    rows = rows.sortWithinPartitions("page_id", "digest", "url").select("page_id", "url", "kind", "digest", "first_id", "payload")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, done = TaskContext.get(), [0]

        def members():
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    done[0] += 1
                    yield _member(*row)

        stream = members()
        if (first := next(stream, None)) is not None:
            path = f"{folder}/part-{context.partitionId():06d}.warc.gz"
            size = write_atomically(path, str(context.taskAttemptId()), (x for part in ([first], stream) for x in part))
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [done[0]], "bytes": [size]})

    return materialise(rows.mapInArrow(put, "path string, records long, bytes long"), "warc-manifest")


class _File:
    """Random reads of a file in chunks."""

    def __init__(self, path: str, size: int):
        store, name = open_store(path)
        self.file, self.size = store.open_input_file(name), size

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - at), at) if at < self.size else b""


def _headers(raw: bytes) -> dict[str, str] | None:
    head, found, _ = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _valid_start(f: _File, at: int) -> bool:
    """Does a gzip member whose first bytes decode to a WARC header begin here?"""
    raw = f.read(at, _PROBE)
    if not raw.startswith(_MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(raw, 256).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflate(f: _File, at: int, keep: bool) -> tuple[int, bytes] | None:
    """(end of the member, its content if kept); None if it isn't whole."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        raw = f.read(at, _CHUNK)
        if not raw:
            return None
        try:
            got = unpack.decompress(raw)
        except zlib.error:
            return None
        if keep:
            out.append(got)
        at += len(raw) - len(unpack.unused_data)
    return at, b"".join(out)


def _scan(f: _File, at: int, end: int) -> int | None:
    """The first offset in [at, end) with a valid member."""
    while at < end:
        raw = f.read(at, min(_CHUNK, end - at) + len(_MAGIC) - 1)
        hit = raw.find(_MAGIC)
        while hit >= 0:
            if at + hit < end and _valid_start(f, at + hit):
                return at + hit
            hit = raw.find(_MAGIC, hit + 1)
        at += _CHUNK
    return None


def chain_in_range(path: str, size: int, start: int, end: int) -> tuple[int, int] | None:
    """(first, stop): the first member in [start, end) from which members follow one another past the range's end, and where they do.

    A range inside a payload that holds stored members may begin with such a chain, of which the
    caller rids itself: it lies before the stop of an earlier range's chain. Where a chain breaks,
    the search goes on behind the break, so a range is inflated once; None if no chain gets through.
    """
    f, at = _File(path, size), start
    while (first := _scan(f, at, end)) is not None:
        stop = first
        while stop < end and _valid_start(f, stop) and (got := _inflate(f, stop, False)) is not None:
            stop = got[0]
        if stop >= size or (stop >= end and _valid_start(f, stop)):
            return first, stop
        at = stop + 1
    return None


def records_from(path: str, size: int, first: int, end: int) -> Iterator[dict]:
    """Records from first, where one begins, that start before end; the last one may end beyond it."""
    f, at = _File(path, size), first
    while at < end:
        got = _inflate(f, at, True)
        if got is None or (head := _headers(got[1])) is None:
            raise ValueError(f"{path}: broken record at {at}")
        block = got[1].partition(b"\r\n\r\n")[2]
        length = int(head.get("content-length", 0))
        if len(block) != length + 4 or not block.endswith(b"\r\n\r\n"):
            raise ValueError(f"{path}: wrong Content-Length at {at}")
        http, _, payload = block[:length].partition(b"\r\n\r\n") if "http" in head.get("content-type", "") else (b"", b"", block[:length])
        kind = head.get("warc-type")
        told = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        yield {
            "path": path, "offset": at, "length": got[0] - at, "record_id": head.get("warc-record-id", "").strip("<>"), "record_type": kind,
            "target_uri": head.get("warc-target-uri"), "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_bytes": int(told[0]) if kind == "revisit" and told else len(payload), "payload": None if kind == "revisit" else payload,
        }
        at = got[0]


def read_warc(spark: SparkSession, paths: str | list[str], range_bytes: int = 64 << 20) -> DataFrame:
    """One row per record of the gzip-member archives at paths (files, folders or globs).

    Files are cut into byte ranges. A task looks for the gzip magic in its ranges, accepts a candidate
    whose first bytes decode to a WARC header and whose chain of members reaches past the range, and
    owns the records that start inside. Chains that begin before an earlier range's chain stops lie
    within a payload and are dropped. The chains that stay must follow one another from a file's
    first byte to its last; a damaged or truncated archive leaves a hole and raises, whatever
    range_bytes is. An empty archive gives no row; several records may have the same id. Revisits
    have a null payload and the length that their HTTP header tells.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(paths).select("path", "length")
    ranges = files.filter("length > 0").select(
        "path", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    )
    tasks = max(spark.sparkContext.defaultParallelism * 2, 8)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                end = min(start + range_bytes, length)
                chain = chain_in_range(path, length, start, end)
                if chain is not None or start == 0:
                    first, stop = chain or (0, 0)
                    yield pa.RecordBatch.from_pydict({"path": [path], "size": [length], "first": [first], "end": [end], "stop": [stop]})

    chains = ranges.repartition(tasks, "path", "start").mapInArrow(index, "path string, size long, first long, end long, stop long")
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of the file
    after = Window.partitionBy("path").orderBy("first")
    chains = chains.withColumn("before", F.coalesce(F.max("stop").over(before), F.lit(0))).filter("first >= before")
    chains = chains.withColumn("next", F.coalesce(F.lead("first").over(after), "size"))
    hole = F.raise_error(F.concat("path", F.lit(": broken record at or after byte "), F.when(F.col("first") == F.col("before"), F.col("stop")).otherwise(F.col("before")).cast("string")))
    whole = (F.col("first") == F.col("before")) & (F.col("stop") == F.col("next"))
    chains = chains.select("path", "size", F.when(whole, F.col("first")).otherwise(hole.cast("long")).alias("first"), "end")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for chain in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for record in records_from(*chain):
                    held.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return chains.repartition(tasks, "path", "first").mapInArrow(get, _SCHEMA)


def page_digests(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (recomputed for responses, else as recorded), record_type, refers_to.

    A record whose id names no page has a null page_id; repeated records each give a row, no record
    none. Other columns are ignored.
    """
    number = lambda c: F.nullif(F.substring_index(F.col(c), ":", -1), F.lit("")).cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes",
        F.coalesce(sha1_base32(F.col("payload")), F.col("payload_digest")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )
