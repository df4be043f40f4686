"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction.

Every writing task makes one package: a ZIP with stored (uncompressed) members ``archive/data.warc.gz``, one gzip member
per record, and ``indexes/index.cdxj``, a line with each record's place. A reader
parses the end record, its ZIP64 form and the central directory from the package's tail, finds the stored members, reads the
index, and deals out runs of records, each of which is fetched with one ranged read. Packages without an index are
walked record by record. Files are reached through the shared folder's file system, never a local temporary folder.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import checkpointed, shared_dir, slices

#: The signatures and formats of ZIP's records, and names of members.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
STORED = 0
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Compressed bytes of one ranged read, and of a reading task.
RUN_BYTES = 4 << 20
TASK_BYTES = 32 << 20
BLOCK = 1 << 20


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# Records


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit of the record ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """The record's fields; the payload's length and digest are of the full payload, checked for responses."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"]}
    if out["record_type"] == "revisit":
        sizes = [int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")]
        return out | {"payload": None, "payload_bytes": sizes[0], "payload_digest": told, "refers_to": number(fields["WARC-Refers-To"])}
    digest = hashlib.sha256(payload).hexdigest()
    if digest != told:
        raise ValueError(f"record {out['page_id']}: payload has digest {digest}, not {told}")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "refers_to": None}


# ZIP directories


def central_directory(file) -> dict[str, dict]:
    """Members by name: method, compressed size and where their data start. Reads the tail, the directory, local headers."""
    size = file.size()
    tail_at = max(0, size - 65_557 - 20)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        (end64_at,) = struct.unpack_from("<Q", tail, at - 20 + 8)
        end64 = file.read_at(56, end64_at)
        if end64[:4] != END64:
            raise ValueError("ZIP64 locator points at no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, members, at = file.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        packed, plain, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", directory, at + 20)
        (header_at,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_len].decode()
        extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
        k = 0
        while k + 4 <= len(extra):
            kind, own = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values, in this order, for those fields that are full
                values = list(struct.unpack_from(f"<{own // 8}Q", extra, k + 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header_at = values.pop(0) if header_at == 0xFFFFFFFF else header_at
            k += 4 + own
        local = file.read_at(30, header_at)
        if local[:4] != LOCAL:
            raise ValueError(f"{name}: no local header")
        local_name, local_extra = struct.unpack_from("<HH", local, 26)
        members[name] = {"method": method, "size": packed, "at": header_at + 30 + local_name + local_extra}
        at += 46 + name_len + extra_len + note_len
    return members


def record_places(file, members: dict[str, dict]) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of every record, by the index or else by walking the gzip members."""
    data = members[DATA_MEMBER]
    if data["method"] != STORED:
        raise ValueError("archive members must be stored, or they can't be read by ranges")
    if index := members.get(INDEX_MEMBER):
        if index["method"] != STORED:
            raise ValueError("the index must be stored")
        for line in file.read_at(index["size"], index["at"]).splitlines():
            place = json.loads(line[line.index(b"{") :])
            yield data["at"] + int(place["offset"]), int(place["length"])
        return
    at, end = data["at"], data["at"] + data["size"]
    start, unpacker = at, zlib.decompressobj(31)
    while at < end:
        block = file.read_at(min(BLOCK, end - at), at)
        used = 0
        while used < len(block):
            unpacker.decompress(block[used:])
            if not unpacker.eof:
                used = len(block)
                break
            used = len(block) - len(unpacker.unused_data)
            yield start, at + used - start
            start, unpacker = at + used, zlib.decompressobj(31)
        at += len(block)


# Spark


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, length, refers_to (null: a response). Copies find their first by the digest."""
    payload = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    firsts = rows.where(F.col("length") >= LEAST_REVISIT).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"))
    # short payloads revisit nothing, so each is a key of its own: the empty ones, however many, are spread over all tasks
    own = F.when(F.col("length") >= LEAST_REVISIT, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("short"), "page_id", "url"))
    found = rows.withColumn("_own", own).join(firsts.hint("shuffle_hash"), F.col("_own") == F.col("_digest"), "left")
    return found.select("page_id", "url", "payload", "digest", "length", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes one package per task into ``folder``; a row (path, records, bytes) for each. Runs at once.

    A task writes under a name of its attempt and then renames, so repeated and lost attempts leave one whole package.
    """

    def run(batches):
        task = TaskContext.get()
        store, base = open_store(folder)
        name = f"part-{task.partitionId():06d}.wacz"
        temp = f"{base}/_{name}.{task.taskAttemptId()}"
        zipped = data = stream = None
        index: list[bytes] = []
        at = 0
        for part in slices(batches):
            if not part.num_rows:
                continue
            if zipped is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(temp)
                zipped = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = zipped.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True)
            for page_id, url, payload, digest, length, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = record_bytes(page_id, url, payload, digest, length, refers_to)
                data.write(raw)
                place = {"offset": str(at), "length": str(len(raw)), "digest": f"sha256:{digest}", "filename": "data.warc.gz"}
                index.append(f"{quote(url or '', safe=':/?=&')} 19700101000000 {json.dumps(place)}\n".encode())
                at += len(raw)
        if zipped is None:
            return
        data.close()
        with zipped.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as out:
            out.writelines(index)
        zipped.close()
        stream.close()
        store.move(temp, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], names=["path", "records", "bytes"])

    return checkpointed(records.select("page_id", "url", "payload", "digest", "length", "refers_to").mapInArrow(run, "path string, records long, bytes long"))


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the packages in column ``path``, with their whole payloads or only their lengths and digests."""

    def runs_of(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, own = open_store(path)
                with store.open_input_file(own) as file:
                    offsets, lengths, held = [], [], 0
                    rows = []
                    for offset, length in record_places(file, central_directory(file)):
                        if held + length > RUN_BYTES and offsets:
                            rows.append((path, offsets, lengths))
                            offsets, lengths, held = [], [], 0
                        offsets.append(offset)
                        lengths.append(length)
                        held += length
                    rows += [(path, offsets, lengths)] if offsets else []
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], kind)], names=["path", "offsets", "lengths"])

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def fetch(batches):
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, own = open_store(path)
                with store.open_input_file(own) as file:
                    run = memoryview(file.read_at(offsets[-1] + lengths[-1] - offsets[0], offsets[0]))
                found = [parse_record(zlib.decompress(run[o - offsets[0] : o - offsets[0] + n], 31)) for o, n in zip(offsets, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], kinds.get(n, pa.string())) for n in names], names=names)

    total = packages.agg(F.sum("bytes")).first()[0] or 0 if "bytes" in packages.columns else 0
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)
    return packages.select("path").mapInArrow(runs_of, "path string, offsets array<long>, lengths array<long>").repartition(int(tasks)).mapInArrow(fetch, schema)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages as packages into a new folder of the shared one and reads the records back, without payloads.

    Null html counts as empty. Of rows with one payload (100 bytes or more) all with the smallest page_id are
    responses. An empty table gives no package and no rows. Columns other than the three named are ignored.
    """
    folder = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    written = write_packages(with_record_types(pages, id_col, url_col, html_col), folder)
    return read_packages(written, with_payload=False).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""
