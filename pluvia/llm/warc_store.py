"""A content-addressed WARC archive: payloads once by digest, exact record headers apart."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
#: Responses of one payload that are joined with one copy of it; more get further copies, so that a common payload is dealt over tasks.
CROWD = 256
#: Bytes after which an exported file is closed and the next one begun, and bytes that a reader unpacks at once at most.
FILE_BYTES, PIECE = 1 << 28, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [x or b"" for x in b.column(2).to_pylist()]
        cols = [
            b.column(0),
            b.column(1),
            pa.array([len(x) for x in raw], pa.int64()),
            pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw], pa.string()),
            pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "payload_bytes", "sha1", "digest"])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload of the partition once, packed."""
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for x in b.column(0).to_pylist():
            d = hashlib.sha256(x or b"").digest()
            if d not in seen:
                seen.add(d)
                new.append((d, zlib.compress(x or b"", 6)))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], pa.binary()), pa.array([p for _, p in new], pa.binary())], ["digest", "packed"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of each run of equal digests, verified against what it unpacks to."""
    last = None
    for b in batches:
        keep = []
        for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if d != last:
                if hashlib.sha256(zlib.decompress(p)).digest() != d:
                    raise ValueError("a payload doesn't match its digest")
                keep.append((d, p))
                last = d
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in keep], pa.binary()), pa.array([p for _, p in keep], pa.binary())], ["digest", "packed"])


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def build(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, payloads), both written to the shared folder.

    records: digest, revisit, salt, header (the record's exact bytes up to its payload,
    without the payload); payloads: digest, copies, packed (zlib), each payload once. Of
    records with equal payloads of at least ``min_revisit`` bytes the one with the smallest
    page_id is a response and the others revisit it. A payload that many responses hold
    (those without a page_id, or below ``min_revisit``) is joined in ``copies`` copies, and
    each record's salt says with which.

    A null payload is empty, a null url too; line ends in a url go. Repeated rows are
    records of their own, an empty table gives two empty ones, extra columns are ignored.
    """
    payload = F.col(payload_col).cast("string").cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    index = materialize(src.mapInArrow(_digests, "page_id long, url string, payload_bytes long, sha1 string, digest binary"), "index")
    shared = F.col("payload_bytes") >= min_revisit
    # written first: a table of its own lets Spark split the join where a digest is common
    first = index.groupBy(F.col("digest").alias("of")).agg(F.min(F.when(shared, F.col("page_id"))).alias("first"), F.count(F.when(F.col("page_id").isNull() | ~shared, 1)).alias("n"))
    first = materialize(first.withColumn("copies", F.expr(f"n div {CROWD} + 1")), "firsts")
    rows = index.join(first, F.col("digest") == F.col("of"))
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("first")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http).cast("binary")
    salt = F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.col("copies"))
    records = materialize(rows.select("digest", revisit.alias("revisit"), salt.alias("salt"), header.alias("header")), "records")
    packed = src.select("payload").mapInArrow(_payloads, "digest binary, packed binary")
    packed = packed.repartition("digest").sortWithinPartitions("digest").mapInArrow(_once, "digest binary, packed binary")
    # few payloads are so common, if any, so most often the payloads needn't be shuffled for this
    common = materialize(first.where("copies > 1").select("of", "copies"), "common_payloads")
    packed = packed.join(common, F.col("digest") == F.col("of"), "left").select("digest", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "packed")
    return records, materialize(packed, "payloads")


def parse(record: bytes) -> dict[str, str | int]:
    """A record's headers in lower case, and where its HTTP payload starts."""
    head, _, block = record.partition(END)
    lines = head.decode().split("\r\n")
    out: dict[str, str | int] = {"version": lines[0]}
    for line in lines[1:]:
        k, _, v = line.partition(": ")
        out[k.lower()] = v
    out["payload_at"] = len(head) + len(END) + block.index(END) + len(END)
    return out


def originals(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(digest, header, packed): each record as it is stored in a file; a revisit has no payload (null). Repeated records repeat."""
    copies = payloads.select(F.col("digest").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "packed")
    own = records.where("not revisit").join(copies, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("copy")))
    return own.select("digest", "header", "packed").union(records.where("revisit").select("digest", "header", F.lit(None).cast("binary")))


def _page(x: str | None) -> int | None:
    at = None if x is None else x.removeprefix("<urn:x-page:").removesuffix(">")
    return None if at in (None, "none") else int(at)


_READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())


def _facts(header: bytes, size: int, sha1: str) -> tuple:
    """What a record says of itself; what it says of its payload must be so."""
    got = parse(header)
    if got["warc-payload-digest"] != f"sha1:{sha1}":
        raise ValueError("a payload doesn't match its record")
    block = len(header) - header.index(END) - len(END)
    if int(got["content-length"]) != block + (0 if got["warc-type"] == "revisit" else size):
        raise ValueError("a record's length isn't what it says")
    return _page(got["warc-record-id"]), size, sha1, got["warc-type"], _page(got.get("warc-refers-to"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records put together from header and payload, byte for byte, and read."""
    for b in batches:
        rows = []
        for digest, header, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            record = header + zlib.decompress(packed)
            payload = memoryview(record)[parse(record)["payload_at"] :]
            if hashlib.sha256(payload).digest() != digest:
                raise ValueError("a payload doesn't match its digest")
            rows.append((digest, *_facts(record[: len(record) - len(payload)], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), *_TYPES), strict=True)], ["digest", *_READ])


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revisits, read from their exact bytes and the facts of the payload that they revisit."""
    for b in batches:
        rows = [_facts(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _READ)


def read_back(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, read from the reconstructed records.

    A response is its header joined with its payload (``originals``); the whole record is
    parsed, its payload digested anew and compared with what the archive's key and the
    record's own lines say. A revisit has no payload: it is joined with the facts that
    were read from responses of its payload, so a common payload costs its revisits
    nothing. Repeated records repeat; no records give no rows.
    """
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    responses = originals(records, payloads).where("packed is not null").mapInArrow(_whole, f"digest binary, {kind}")
    responses = materialize(responses, "responses")
    facts = responses.groupBy(F.col("digest").alias("of")).agg(F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("sha1"))
    facts = materialize(facts, "facts")
    rows = records.where("revisit").join(facts, F.col("digest") == F.col("of")).select("header", "bytes", "sha1")
    return responses.select(*_READ).union(rows.mapInArrow(_revisits, kind))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """One row per page, read back from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null payload is empty. A null page_id is a response of its own kind (it isn't
    the smallest and refers to nothing). Rows that repeat the smallest page_id of a
    payload are all responses. Very long payloads are held one at a time. An empty
    table gives no rows; extra columns are ignored.
    """
    return read_back(*build(pages, id_col, url_col, payload_col, min_revisit))


def export(records: DataFrame, payloads: DataFrame, uri: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Plain ``.warc.gz`` files under ``uri``, a folder that all executors reach (any that pyarrow knows); (file, records) of each.

    A task begins a new file once one holds ``file_bytes``. A retried task replaces
    its own files whole. Empty tables give one empty file or none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        task, made, f = TaskContext.get(), [], None

        def close() -> None:
            f.close()
            store.move(part, f"{root}/{made[-1][0]}")

        for b in batches:
            for _, header, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f is not None and f.tell() >= file_bytes:
                    close()
                    f = None
                if f is None:
                    made.append([f"part-{task.partitionId():05d}-{len(made):05d}.warc.gz", 0])
                    part = f"{root}/.{made[-1][0]}.{task.taskAttemptId()}"
                    f = store.open_output_stream(part, compression=None)
                body = b"" if packed is None else zlib.decompress(packed)
                f.write(gzip.compress(header + body + END, 6, mtime=0))
                made[-1][1] += 1
        if f is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["file", "records"])

    return originals(records, payloads).mapInArrow(run, "file string, records long")


def unpacked(raw: bytes) -> Iterator[bytes]:
    """The members of a ``.warc.gz`` file one by one, in time linear in its bytes."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        d, out, step = zlib.decompressobj(31), [], 1 << 12
        while not d.eof and at < len(raw):
            piece = view[at : at + step]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
            step = min(2 * step, PIECE)  # what lies behind a member's end is copied, so short members take short pieces
        if not d.eof:
            raise ValueError("a record is cut off")
        yield b"".join(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(record): each record of the ``.warc.gz`` files under ``path``. A task holds one file at a time; ``export`` bounds their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                for record in unpacked(raw):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInArrow(run, "record binary")
