"""Operator 7: WARC archives in Zstandard, one frame a record, with their dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, saved, shared_dir, slices

#: Magic number of the skippable frame that holds a dictionary, as the WARC-Zstandard convention has it.
DICT_FRAME = 0x184D2A5D
MANIFEST = "archive string, n_records long, n_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def classify(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of `least` bytes or more, all rows but one refer to its page_id.

    That one has the largest page_id; of several rows with it, the one with the largest url, of equal ones the last in the
    table. Null payloads are empty; null ids are below all others and refer to the largest id if there is one, else
    they are responses. Only digests with several pages reach the join; they are written first, so that Spark knows their
    size: a small table of them goes to the pages, which then aren't shuffled, and a large one is joined with a sort, in
    which Spark splits a partition that one digest makes large.
    """
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1(F.col("html").cast("binary"))))).withColumn("row", F.monotonically_increasing_id())
    p = p.withColumn("name", F.coalesce("url", F.lit("")))
    same = p.where("digest is not null").groupBy("digest", "page_id", "name").agg(F.count("*").alias("m"), F.max("row").alias("row"))
    kept = same.groupBy("digest").agg(F.max(F.struct("page_id", "name", "m", "row")).alias("last"), F.sum("m").alias("n"))
    kept = saved(kept.where("n > 1 and last.page_id is not null").select("digest", "last"))
    is_last = F.expr("page_id <=> last.page_id and name = last.name and (last.m = 1 or row = last.row)")
    refers = F.when(~is_last, F.col("last.page_id"))
    return p.join(kept, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def _record(page_id: int | None, url: str | None, html: bytes, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{i}>"
    kind = "response" if refers_to is None else "revisit"
    block = html if refers_to is None else b""
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(html)}"), ("X-Payload-Length", len(html)), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block)),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the archive's first records; where they are too few, their own text."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def write_archives(records: DataFrame, folder: str, level: int = 6, dict_bytes: int = 65536, sample_bytes: int = 4_000_000) -> DataFrame:
    """One archive a task; archive, n_records, n_bytes of each. A task that runs again writes a new file; only files that
    the returned table names count, so leave none out and take no others."""
    out = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        rows = (r for b in slices(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        head, held = [], 0
        for r in rows:
            head.append(_record(r[0], r[1], r[2].encode(), r[3]))
            held += len(head[-1])
            if held >= sample_bytes:
                break
        if not head:
            return
        n = 0
        raw = _dictionary(head, dict_bytes)
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw))
        with fs.open_output_stream(path) as f:
            f.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
            for record in head:
                f.write(press.compress(record))
                n += 1
            for r in rows:
                f.write(press.compress(_record(r[0], r[1], r[2].encode(), r[3])))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64()), pa.array([fs.get_file_info(path).size], pa.int64())], schema=out)

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST)


class BadArchive(ValueError):
    """An archive whose frames, headers or lengths are wrong."""


def frames(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one by one."""
    head = f.read(8)
    if len(head) < 8:
        raise BadArchive("no leading frame")
    magic, size = struct.unpack("<II", head)
    raw = f.read(size) if magic == DICT_FRAME else b""
    if magic != DICT_FRAME or len(raw) < size:
        raise BadArchive("the leading frame isn't a whole dictionary")
    if raw[:4] == struct.pack("<I", 0xFD2FB528):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
    back, left = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
    while left or (left := f.read(chunk)):
        one, got = back.decompressobj(), []
        while not one.eof:
            if not left and not (left := f.read(chunk)):
                raise BadArchive("a frame ends early")
            got.append(one.decompress(left))
            left = one.unused_data
        yield b"".join(got)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; its version line, header lines, lengths and digests must hold."""
    end = record.find(b"\r\n\r\n")
    lines = record[: max(end, 0)].decode("utf-8", "strict").split("\r\n")
    if end < 0 or not re.fullmatch(r"WARC/1\.[01]", lines[0]) or not all(": " in x for x in lines[1:]):
        raise BadArchive("bad header")
    head = dict(x.split(": ", 1) for x in lines[1:])
    try:
        length = int(head["Content-Length"])
    except (KeyError, ValueError):
        raise BadArchive("no length") from None
    block = record[end + 4 : end + 4 + length]
    if len(block) != length or record[end + 4 + length :] != b"\r\n\r\n":
        raise BadArchive("the length doesn't match the record")
    if not {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest"} <= head.keys() or head.get("WARC-Block-Digest") != f"sha1:{sha1_base32(block)}":
        raise BadArchive("a header is missing or a digest doesn't match")
    return head, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that manifest lists, one archive at a time in each task, read as a stream."""
    out = arrow_schema(RECORD)

    def page(urn: str | None) -> int | None:
        got = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return None if got in (None, "None") else int(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, n = [], 0
                with fs.open_input_stream(path) as f:
                    for record in frames(f):
                        head, block = parse(record)
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (size, digest) != (len(block), sha1_base32(block)):
                            raise BadArchive("the payload doesn't match its header")
                        rows.append((page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], page(head.get("WARC-Refers-To"))))
                        n += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=out)
                            rows = []
                if n != want:
                    raise BadArchive(f"{n} records for {want}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=out)

    files = manifest.select("archive", "n_records")
    return files.repartition(max(1, files.count())).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write a record for each row of pages, then read all archives back: a row for each row, repeated ones too (see
    classify). No rows give no archives and no rows."""
    folder = folder or shared_dir(pages.sparkSession)
    manifest = saved(write_archives(classify(pages, least), f"{folder}/warc"), f"{folder}/manifest")
    return read_archives(manifest)
