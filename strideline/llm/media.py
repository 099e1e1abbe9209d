"""Operator 10: media columns. Payloads become PNG members of archives; a Spark data source reads them by byte range."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import arrow_schema, saved, shared_dir, slices, spread, two_columns

#: Bytes of a row of samples: 64 RGB pixels of 8 bits.
ROW = 192
MANIFEST = "archive string, n_members long"
MEMBER = "doc_id long, media binary"


def encode_media(data: bytes) -> bytes:
    """A PNG of 8-bit RGB samples, 64 pixels wide, lossless; the unpadded length is kept in a text chunk."""
    rows = max(1, -(-len(data) // ROW))
    payload = data + b" " * (rows * ROW - len(data))
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"Length\0" + str(len(data)).encode()) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk; one that fails its checksum, or a PNG that ends early, raises ValueError."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while at < len(png):
        if len(png) < at + 12:
            raise ValueError("a chunk ends early")
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if len(png) < at + 12 + size or struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        yield kind, body
        at += 12 + size
    if kind != b"IEND":
        raise ValueError("no last chunk")


def decode_media(png: bytes) -> tuple[np.ndarray, int]:
    """The samples, one line a row, and the unpadded length; a damaged PNG raises ValueError."""
    idat, head, length = [], None, None
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
    if head is None or head[2:] != (8, 2, 0, 0, 0) or length is None:
        raise ValueError("not a PNG of this kind")
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(head[1], 3 * head[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't written here")
    return lines[:, 1:], length


def features(samples: np.ndarray) -> str:
    """Mean, spread, an 8-bin histogram in thousandths and a 16-bit hash of brightness changes over 17 parts, as text."""
    flat = samples.reshape(-1)
    bins = np.bincount(flat >> 5, minlength=8) * 1000 // len(flat)
    edges = np.linspace(0, len(flat), 18).astype(np.int64)
    sums = np.add.reduceat(flat.astype(np.int64), edges[:-1]) / np.diff(edges)
    bits = "".join("01"[int(a < b)] for a, b in zip(sums, sums[1:], strict=False))
    return f"mean={flat.mean():.4f};std={flat.std():.4f};hist={','.join(map(str, bins))};dhash={int(bits, 2):04x}"


def write_archives(df: DataFrame, folder: str, archive_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """archive, n_members: TAR archives of up to about archive_bytes with a PNG for each row, and beside each the list of
    its members' offsets. Files that the table doesn't name are of lost tasks and are left out by the reader."""
    out = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        rows = (r for b in slices(batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        row, names, counts = next(rows, None), [], []
        while row is not None:
            name = f"part-{TaskContext.get().partitionId():06d}-{len(names):04d}-{uuid.uuid4().hex}.tar"
            starts, at = [], 0
            with fs.open_output_stream(f"{root}/{name}") as f:
                while row is not None and at < archive_bytes:
                    png = encode_media(row[1].encode())
                    info = tarfile.TarInfo(f"{row[0]}.png")
                    info.size = len(png)
                    member = info.tobuf(tarfile.USTAR_FORMAT) + png + b"\0" * (-len(png) % 512)
                    f.write(member)
                    starts.append(at)
                    at += len(member)
                    row = next(rows, None)
                f.write(b"\0" * 1024)
            with fs.open_output_stream(f"{root}/{name}.offsets") as f:
                f.write(np.array([*starts, at], "<i8").tobytes())
            names.append(name)
            counts.append(len(starts))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], schema=out)

    return spread(two_columns(df, id_col, text_col)).mapInArrow(run, MANIFEST)


class Range(InputPartition):
    """Members whose headers begin in [start, end) of an archive."""

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


def read_member(fs, path: str, start: int, end: int, tries: int = 3, opened=None) -> tuple[int | None, bytes]:
    """One member by its offset, its header and all its chunks checked; after an error it alone is read again, from a newly
    opened file."""
    for left in range(tries - 1, -1, -1):
        f, own = (opened, False) if opened is not None else (fs.open_input_file(path), True)
        opened = None
        try:
            f.seek(start)
            raw = f.read(end - start)
            info = tarfile.TarInfo.frombuf(raw[:512], "utf-8", "strict")  # checks the header's checksum
            body = raw[512 : 512 + info.size]
            if len(body) < info.size:
                raise OSError("short member")
            for _ in chunks(body):
                pass
            name = info.name.removesuffix(".png")
            return None if name == "None" else int(name), body
        except (OSError, ValueError, tarfile.TarError):
            if not left:
                raise
        finally:
            if own:
                f.close()
    raise AssertionError


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.batch = options["path"], int(options.get("batchBytes", 8 << 20))
        self.range_bytes = int(options.get("rangeBytes", 32 << 20))
        self.manifest = options["manifest"]

    def partitions(self) -> list[Range]:
        """Byte ranges of the listed archives; the driver sees file names and sizes only."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        at, listed = pafs.FileSystem.from_uri(self.manifest)
        import pyarrow.dataset as ds

        names = set(ds.dataset(listed, filesystem=at, format="parquet", exclude_invalid_files=False).to_table(columns=["archive"]).column(0).to_pylist())
        out = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name in names:
                out += [Range(info.base_name, s, min(s + self.range_bytes, info.size)) for s in range(0, info.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])  # no session here to parse MEMBER
        if not part.archive:
            return
        fs, root = pafs.FileSystem.from_uri(self.folder)
        path = f"{root}/{part.archive}"
        with fs.open_input_stream(f"{path}.offsets") as f:
            edges = np.frombuffer(f.read(), "<i8")
        lo, hi = np.searchsorted(edges[:-1], [part.start, part.end])
        ids, media, held = [], [], 0
        with fs.open_input_file(path) as opened:
            for k in range(int(lo), int(hi)):
                doc, body = read_member(fs, path, int(edges[k]), int(edges[k + 1]), opened=opened)
                ids.append(doc)
                media.append(body)
                held += len(body)
                if held >= self.batch or len(ids) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], schema=out)
                    ids, media, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], schema=out)


class MediaSource(DataSource):
    """spark.read.format("media_archives"): options path (the archives' folder) and manifest (the table that lists them)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def store(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as media and return doc_id, media as the data source reads them back: a member for each row, repeated
    rows too. Null texts are empty; a null id stays null. The driver lists archives of 256 MB: 400,000 names at 100 TB."""
    folder = folder or shared_dir(df.sparkSession)
    saved(write_archives(df, f"{folder}/media", id_col=id_col, text_col=text_col), f"{folder}/manifest")
    return read(df.sparkSession, f"{folder}/media", f"{folder}/manifest")


def read(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archives").option("path", path).option("manifest", manifest).load()


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of the decoded samples, a row for each row. Equal texts have equal values; null ids stay null."""
    out = arrow_schema(DESCRIBED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                samples, n = decode_media(png)
                payload = samples.tobytes()
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), features(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=out)

    return media.mapInArrow(run, DESCRIBED)
