"""Web archives: monolithic gzip streams made seekable.

Pages are captured as records of archives that are one gzip stream each, as a
plain ``gzip`` of a whole file gives. The normaliser inflates such a stream
once, from front to end, rewrites every record as a gzip member of its own, and
writes a sidecar of member offsets beside it, so any record can be read alone.
On the way it turns a record whose payload another one has too into a revisit
of that one. Archives are files in the folder that driver and executors share;
which of them count is a staged table, so a lost task's files count for nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import stage
from acrelight.sources.shared import fresh_path

#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 128 << 20
READ_BYTES = 1 << 20
GZIP = 31
CAPTURED = "archive string, at long, page_id long, payload_key binary, payload_bytes long"
CAPTURED_TYPES = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("payload_key", pa.binary()), ("payload_bytes", pa.int64())])
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
READ_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def opened(path: str):
    """(file system, path in it) of a path or URI of the shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def http_header(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def uri_of(url: str | None) -> str:
    """A URL that fits on a header line."""
    from urllib.parse import quote

    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")


def capture(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a response record for every row into archives of one gzip stream each; the staged table of records.

    A null page is an empty payload, a null URL an empty one. Rows that share an
    id, or have none, are records of their own. Other columns are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, home = opened(folder)
        out = None
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal out
            out.write(packer.flush())
            out.close()
            out = None
            done, rows[:] = list(zip(*rows)), []
            return pa.record_batch([pa.array(x, t) for x, t in zip(done, CAPTURED_TYPES.types)], schema=CAPTURED_TYPES)

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer, size = files.open_output_stream(f"{home}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0
                    out.write(packer.compress(record([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", record_id(name, 0)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                payload = (html.as_py() or "").encode()
                at = len(rows) + 1
                headers = [("WARC-Type", "response"), ("WARC-Date", date), ("WARC-Record-ID", record_id(name, at)), ("WARC-Target-URI", uri_of(url)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
                if page_id is not None:
                    headers.append(("X-Page-Id", str(page_id)))
                data = record(headers, http_header(len(payload)) + payload)
                out.write(packer.compress(data))
                size += len(data)
                rows.append((name, at, page_id, hashlib.sha256(payload).digest()[:16], len(payload)))
                if size >= ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    files, home = opened(folder)
    files.create_dir(home, recursive=True)
    return stage(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, CAPTURED))


def revisits_of(captured: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, at, refers_archive, refers_at, refers_to) of records whose payload, of ``least_bytes`` or more, an earlier one has.

    Earliest is the smallest page id; a missing id comes last, and of equal ids
    the first record. Payloads meet by 128 bits of their SHA-256 and their size.
    Only keys that occur twice take the join, whose rows are narrow; adaptive
    execution splits those of a frequent payload.
    """
    key = ["payload_key", "payload_bytes"]
    own: Column = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "archive", "at")
    wide = captured.where(F.col("payload_bytes") >= least_bytes)
    firsts = wide.groupBy(*key).agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = wide.join(firsts, key).where((F.col("archive") != F.col("first.archive")) | (F.col("at") != F.col("first.at")))
    return later.select("archive", "at", F.col("first.archive").alias("refers_archive"), F.col("first.at").alias("refers_at"), F.col("first.page_id").alias("refers_to"))


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a gzip stream of one or more members, inflated piece by piece."""
    inflate, held, pending = zlib.decompressobj(GZIP), bytearray(), b""

    def more() -> bool:
        nonlocal inflate, pending
        pending = pending or stream.read(READ_BYTES)
        if not pending:
            if not inflate.eof:
                raise ValueError("an archive's gzip stream is cut short")
            return False
        if inflate.eof:
            inflate = zlib.decompressobj(GZIP)
        held.extend(inflate.decompress(pending, 8 * READ_BYTES))
        pending = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        want = end + 4 + int(headers["Content-Length"]) + 4
        while len(held) < want:
            if not more():
                raise ValueError("an archive ends within a record")
        yield headers, bytes(held[end + 4 : want - 4])
        del held[:want]


def normalise_archive(files, source: str, target: str, revisits: dict[int, tuple]) -> int:
    """Rewrite one archive with a gzip member for each record and a sidecar of JSON lines; the number of records.

    ``revisits`` has, by a record's number, the record that it revisits: its payload is left out.
    """
    records = offset = 0
    with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(target, compression=None) as out, files.open_output_stream(f"{target}.idx", compression=None) as index:
        for number, (headers, block) in enumerate(records_of(stream)):
            earlier = revisits.get(number)
            if earlier is not None:
                refers, refers_to = earlier
                headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers}
                if refers_to is not None:
                    headers["X-Refers-To-Page-Id"] = str(refers_to)
                block = block[: block.index(b"\r\n\r\n") + 4]
            packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            member = packer.compress(record([(k, v) for k, v in headers.items() if k != "Content-Length"], block)) + packer.flush()
            out.write(member)
            index.write((json.dumps({"offset": offset, "length": len(member), "type": headers["WARC-Type"], "id": headers["WARC-Record-ID"], "uri": headers.get("WARC-Target-URI")}) + "\n").encode())
            offset += len(member)
            records += 1
    return records


def normalise(captured: DataFrame, revisits: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise every archive of ``captured`` from folder ``source`` to ``target``; (archive, file, records), staged.

    An archive's revisits meet it in one task: no more rows than it has records.
    """
    marks = captured.select("archive").distinct().select("archive", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("refers_archive"), F.lit(None).cast("long").alias("refers_at"), F.lit(None).cast("long").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, home = opened(source)
        _, away = opened(target)
        archive: str | None = None
        found: dict[int, tuple] = {}

        def finish() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            n = normalise_archive(files, f"{home}/{archive}", f"{away}/{name}", found)
            found.clear()
            return pa.record_batch([pa.array([archive]), pa.array([name]), pa.array([n], pa.int64())], names=["archive", "file", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] < 0:
                    if archive is not None:
                        yield finish()
                    archive = row[0]
                else:
                    found[row[1]] = (record_id(row[2], row[3]), row[4])
        if archive is not None:
            yield finish()

    files, home = opened(target)
    files.create_dir(home, recursive=True)
    rows = marks.unionByName(revisits).repartition("archive").sortWithinPartitions("archive", "at")
    return stage(rows.mapInArrow(run, "archive string, file string, records long"))


def read_archives(normalised: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every page's record, each read alone at its sidecar's offset.

    A response's digest is that of the payload read, and must be the one that its
    header states; a revisit has the size and digest of the payload that it
    revisits, and no payload. Without ``payloads`` that column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, home = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(f"{home}/{name}") as data, files.open_input_stream(f"{home}/{name}.idx", compression=None) as sidecar:
                    for line in sidecar.read().splitlines():
                        entry = json.loads(line)
                        if entry["type"] == "warcinfo":
                            continue
                        data.seek(entry["offset"])
                        (headers, block), *rest = records_of(pa.BufferReader(data.read(entry["length"])))
                        if rest or headers["WARC-Record-ID"] != entry["id"]:
                            raise ValueError(f"the sidecar of {name} does not fit it")
                        end = block.index(b"\r\n\r\n") + 4
                        size = int(next(x for x in block[:end].split(b"\r\n") if x.startswith(b"Content-Length:"))[15:])
                        stated, payload = headers["WARC-Payload-Digest"].removeprefix("sha1:"), block[end:]
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != stated):
                            raise ValueError(f"record {entry['id']} of {name} is damaged")
                        number = lambda key: int(headers[key]) if key in headers else None  # noqa: B023, E731
                        rows.append((number("X-Page-Id"), headers["WARC-Target-URI"], size, stated, kind, number("X-Refers-To-Page-Id"), payload if payloads and kind == "response" else None))
                        held += len(payload) if payloads else 0
                        if held > 32 << 20 or len(rows) >= 20_000:
                            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), READ_TYPES.types)], schema=READ_TYPES)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), READ_TYPES.types)], schema=READ_TYPES)

    return normalised.select("file").repartition("file").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Capture ``pages``, normalise the archives and return the staged list of the normalised ones, in ``folder``/normalised."""
    captured = capture(pages, f"{folder}/captured")
    return normalise(captured, revisits_of(captured, least_bytes), f"{folder}/captured", f"{folder}/normalised")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark)
    normalised = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(normalised, f"{folder}/normalised", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits are twenty bits: four letters of base 32.
_LETTERS = " || ".join(f"substr('{ALPHABET}', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)" for i in range(8) for shift in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
