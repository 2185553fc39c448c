"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record follows as a frame of its own, so any record
can be read alone. The dictionary is built once from a bounded sample of the records. Tasks write archives straight to the shared
folder under names of their own attempt; the committed table of archives names those of attempts that succeeded, and
only they are read, so lost executors leave no doubled records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, first_by_hash, saved, shared_folder

MAGIC = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page, url, payload: bytes, size: int, digest: str, refers, date: str) -> bytes:
    """One WARC record. A revisit has no payload; its header tells size and digest of the full one."""
    name = "none-" + uuid.uuid4().hex if page is None else str(page)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    if refers is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block + CRLF + CRLF


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, a binary file or bytes; one record is held at a time."""
    import zstandard

    data = io.BytesIO(data) if isinstance(data, bytes) else data
    if not (head := data.read(8)):
        return
    if head[:4] != MAGIC:
        raise ValueError("no dictionary frame at the archive's start")
    size = int.from_bytes(head[4:8], "little")
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data.read(size))) if size else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(frames.stream_reader(data, read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:20]!r}")
        head = {}
        while (line := stream.readline()) != CRLF:
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != CRLF + CRLF:
            raise ValueError("a record's end is missing")
        yield head, block


def build_dictionary(pages: DataFrame, id_col: str, payload_col: str, sample: int, clip: int, size: int) -> bytes:
    """Dictionary from the first `clip` bytes of at most `sample` payloads, those whose ids hash lowest; empty if there is too little to learn from."""
    import zstandard

    part = F.substring(F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8"), 1, clip)
    rows = first_by_hash(pages.select(F.col(id_col), part.alias("p")), id_col, sample).collect()
    texts = [_record("response", k, None, bytes(r.p), len(r.p), "", None, "") for k, r in enumerate(rows)]
    if sum(map(len, texts)) < 8 * size:
        size = sum(map(len, texts)) // 8
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0,
    archive_bytes: int = 16_000_000, date: str = "1970-01-01T00:00:00Z", sample: int = 2000, clip: int = 4096, dictionary_bytes: int = 65_536, level: int = 3,
) -> DataFrame:
    """Write a record for each row and return the table of archives: path, records, bytes.

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at least min_revisit_bytes bytes that with the largest id is the
    response and the others revisit it; smaller ones are all responses. Rows with a null id are responses, as is each repeated
    row of the largest id. A null url has no WARC-Target-URI. An empty table writes no archive. Other columns are not read.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(text, "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    owner = rows.select("id", "sha", "size").where(F.col("size") >= min_revisit_bytes).groupBy("sha", "size").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n"))
    # only repeated payloads have an owner to look up, each under several salts: a page that a third of all rows repeat is dealt to many tasks
    owner = owner.where("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.expr(f"int(pmod(xxhash64(id, url), {SALTS}))"))
    dealt = rows.join(owner, ["sha", "size", "salt"], "left").select("id", "url", "payload", F.when(F.col("owner") != F.col("id"), F.col("owner")).alias("refers"))
    dictionary = build_dictionary(pages, id_col, payload_col, sample, clip, dictionary_bytes)

    def write(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        here, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, path, count, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        number = 0
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers")), strict=True):
                if out is None:
                    path, count, size = f"{root}/part-{here:05d}-{number:04d}-{mine}.warc.zst", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    size += out.write(MAGIC + len(dictionary).to_bytes(4, "little") + dictionary)
                    number += 1
                body, to = payload.as_py(), refers.as_py()
                frame = pack(_record("response" if to is None else "revisit", page.as_py(), url.as_py(), body if to is None else b"", len(body), payload_digest(body), to, date))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return saved(dealt.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """Records of the committed archives: id, record_type, payload_bytes, payload_digest (both of the full payload), refers_to, payload (null for revisits).

    The names of the archives are rows like any others; tasks open them in the folder and read record by record. A response whose payload doesn't have its header's
    digest is an error.
    """
    shape = "id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        columns = ["id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        page = lambda x: int(x[10:-1]) if x and not x.startswith("<urn:page:none-") else None
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as archive:
                    for head, block in records(archive):
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = head["WARC-Type"] == "response"
                        if whole and (payload_digest(payload) != digest or len(payload) != int(head["WARC-Payload-Length"])):
                            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                        rows.append((page(head["WARC-Record-ID"]), head["WARC-Type"], int(head["WARC-Payload-Length"]), digest, page(head.get("WARC-Refers-To")), payload if whole else None))
                        held += len(payload)
                        if held > 4_000_000:
                            yield make(rows)
                            rows, held = [], 0
                if rows:
                    yield make(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts, "path").mapInArrow(read, shape)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    root = shared_folder(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/warc-{uuid.uuid4().hex}"
