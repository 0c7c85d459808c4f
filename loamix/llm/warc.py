"""WARC archives: a writer that turns repeated payloads into revisit records, and a splittable reader.

Every record is a gzip member of its own. Each writing task streams its records into one file under a name of its own and
moves it into place when it is complete; the names of finished files are the writer's result, so files of lost or
repeated attempts are never read. The reader deals out byte ranges. A task scans its range for the gzip magic,
decodes the start of each candidate member and takes it for a record only if WARC headers come out; a record belongs
to the range in which its member starts, and is read past the range's end. A member whose headers are valid
but whose data or checksum is not raises an error.

Files are read and written through pyarrow's file systems, by the URI of the shared folder.

Defined results: a null payload is empty. Of equal payloads of at least ``least`` bytes the records with the largest id are responses,
the others revisit them; repeated rows with the largest id are all responses. A null id sorts below all
others and has no id header. Control characters of a URL are percent-encoded; a null URL gives no header.
An empty table gives files without response records. Columns other than id, URL and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.plans.shared import Workspace, broadcast_if_small, partitions

#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, LONGEST_HEADER = 1 << 18, 1 << 20
RECORD = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long"


def _id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None, date: str) -> bytes:
    """One record, compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id, digest) if kind == 'response' else _id(f'{page_id} revisit', digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row; the result, (path, length, records), is to be kept: it names the valid files.

    ``folder`` must exist and be shared. The result writes when it is computed.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    groups = own.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("last"))
    repeated = groups.where("n > 1").select("sha1", F.lit(True).alias("repeated"), F.col("last.page_id").alias("last_id"), F.col("last.url").alias("last_url"))
    marked = own.join(broadcast_if_small(repeated, 512), "sha1", "left")
    revisit = F.col("repeated").isNotNull() & (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    rows = marked.select("page_id", "url", F.encode("payload", "UTF-8").alias("payload"), "sha1", revisit.alias("revisit"), "last_id", "last_url")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        own = f"part-{uuid.uuid4().hex}.warc.gz"
        name = f"{root}/{own}"
        count = length = 0
        with fs.open_output_stream(f"{name}.open", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    data = record("revisit" if row["revisit"] else "response", row["page_id"], row["url"], row["payload"], digest, row["last_id"], row["last_url"], date)
                    out.write(data)
                    count, length = count + 1, length + len(data)
        if count:
            fs.move(f"{name}.open", name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{own}"], "length": [length], "records": [count]})
        else:
            fs.delete_file(f"{name}.open")

    return rows.mapInArrow(written, "path string, length long, records long")


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")


class _Window:
    """Bytes of a file from a moving place on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def need(self, n: int) -> bytes:
        while len(self.data) < n:
            more = self.file.read(max(CHUNK, n - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n
        if n and not self.data:
            self.file.seek(self.at)


def members(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose members start in [start, end)."""
    window = _Window(file, start)
    while window.at < end:
        data = window.need(CHUNK)
        place = data.find(MAGIC)
        if place < 0:
            if len(data) < CHUNK:
                return
            window.skip(len(data) - 2)
            continue
        window.skip(place)
        if window.at >= end:
            return
        found = _decode(window)
        if found is None:
            window.skip(1)
        else:
            yield found


def _decode(window: _Window) -> tuple[dict[str, str], bytes] | None:
    """The record at the window's place, which then moves behind it; None if no record starts there."""
    inflate, out, used, headers = zlib.decompressobj(31), bytearray(), 0, None
    while not inflate.eof:
        chunk = window.need(used + 1)[used : used + (1 << 14 if headers is None else CHUNK)]
        try:
            if not chunk:
                raise zlib.error("the file ends inside a member")
            out += inflate.decompress(chunk)
        except zlib.error as error:
            if headers is None:
                return None
            raise ValueError(f"broken WARC member at byte {window.at}") from error
        used += len(chunk)
        if headers is None:
            if not out[:5].startswith(b"WARC/"[: len(out)]):
                return None
            if (stop := out.find(b"\r\n\r\n")) >= 0:
                lines = out[:stop].decode("utf-8", "replace").split("\r\n")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not headers.get("content-length", "").isdigit():
                    return None
            elif len(out) > LONGEST_HEADER:
                return None
    if headers is None:
        return None
    window.skip(used - len(inflate.unused_data))
    size = int(headers["content-length"])
    block = bytes(out[stop + 4 : stop + 4 + size])
    if len(block) != size:
        raise ValueError(f"a WARC record before byte {window.at} is shorter than its length")
    return headers, block


def read_warc(files: DataFrame, split_bytes: int = 32 << 20, payload: bool = False) -> DataFrame:
    """Records of the archives listed in ``files`` (path, length); with ``payload`` also the payload's bytes.

    The digest of a response is that of the payload read, and must equal the one in its header.
    """
    spark = files.sparkSession
    splits = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "length")
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")).repartition(partitions(spark), "path", "start")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                path = split["path"]
                fs, local = pa.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(local) as file:
                    for headers, block in members(file, split["start"], split["end"]):
                        rows.append(_row(headers, block, payload))
                        held += len(block)
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[*names, "payload"][: len(columns)])

    return splits.mapInArrow(scanned, RECORD + (", payload binary" if payload else ""))


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x not in ("None", "") else None


def _row(headers: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    head, gap, body = block.partition(b"\r\n\r\n")
    length = None
    if kind in ("response", "revisit") and gap:
        length = len(body)
        if kind == "revisit":
            fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
            length = int(fields.get(b"content-length", b"0"))
        else:
            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if digest not in (None, own):
                raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
            digest = own
    row = (kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), _number(headers.get("x-page-id")), _number(headers.get("x-refers-to-page-id")), digest, length)
    return (*row, body) if payload else row


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op7")
    files = work.save(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), work.make("archives")), "files")
    back = read_warc(files)
    return back.where("record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "translate(" + " || ".join(f"lpad(to_base(('0x' || substr(h, {i}, 5))::BIGINT, 32), 4, '0')" for i in range(1, 41, 5)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
ORACLE = {
    "op7_warc_round_trip": f"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last_id FROM h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to FROM m"""
}
