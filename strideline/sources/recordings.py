"""Binary recordings (FIT) as a Spark data source, and as files written from samples.

A recording is a stream of messages whose layouts are declared inside it, so it can't be cut: a partition takes whole
files, as many as come to `partitionBytes`, and reads each as a stream (through gunzip for names that end in .gz). Layouts
are kept by their local number while a file lasts. A file that is damaged gives one row of message `error` and no other.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strideline.shipping import ship

# Fixed values of the format: base types (number: code of one value, the value that says none), messages, and of each
# message the fields that are read (number: name, base type, scale, offset).
BASE = {
    0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x07: ("s", None), 0x88: ("f", None), 0x89: ("d", None),
    0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF), 0x8E: ("q", 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0),
}
BYTE, TEXT = 0x0D, 0x07
MESSAGES = {18: "session", 19: "lap", 20: "record"}
WHOLE = {
    253: ("at", 0x86, 1, 0), 2: ("start", 0x86, 1, 0), 7: ("elapsed_s", 0x86, 1000, 0), 8: ("timer_s", 0x86, 1000, 0), 9: ("distance_m", 0x86, 100, 0), 11: ("calories", 0x84, 1, 0),
}
FIELDS = {
    "session": WHOLE | {5: ("sport", 0x00, 1, 0), 14: ("speed_mps", 0x84, 1000, 0), 15: ("max_speed_mps", 0x84, 1000, 0), 16: ("heart_rate", 0x02, 1, 0), 17: ("max_heart_rate", 0x02, 1, 0), 18: ("cadence", 0x02, 1, 0), 20: ("power", 0x84, 1, 0), 22: ("ascent_m", 0x84, 1, 0), 23: ("descent_m", 0x84, 1, 0), 35: ("stress", 0x84, 10, 0)},
    "lap": WHOLE | {13: ("speed_mps", 0x84, 1000, 0), 14: ("max_speed_mps", 0x84, 1000, 0), 15: ("heart_rate", 0x02, 1, 0), 16: ("max_heart_rate", 0x02, 1, 0), 17: ("cadence", 0x02, 1, 0), 19: ("power", 0x84, 1, 0), 21: ("ascent_m", 0x84, 1, 0), 22: ("descent_m", 0x84, 1, 0)},
    "record": {253: ("at", 0x86, 1, 0), 0: ("lat", 0x85, 2**31 / 180, 0), 1: ("lon", 0x85, 2**31 / 180, 0), 2: ("altitude_m", 0x84, 5, 500), 3: ("heart_rate", 0x02, 1, 0), 4: ("cadence", 0x02, 1, 0), 5: ("distance_m", 0x86, 100, 0), 6: ("speed_mps", 0x84, 1000, 0), 7: ("power", 0x84, 1, 0), 53: ("half_cadence", 0x02, 128, 0), 73: ("fine_speed", 0x86, 1000, 0), 78: ("fine_altitude", 0x86, 5, 500)},
}
SPORTS = ("generic", "running", "cycling", "transition", "fitness_equipment", "swimming", "basketball", "soccer", "tennis", "american_football", "training", "walking", "cross_country_skiing", "alpine_skiing", "snowboarding", "rowing", "mountaineering", "hiking")
#: Seconds from 1970 to the format's own first second.
FIRST_SECOND = 631_065_600
TIMES = ("at", "start")
NUMBERS = ("lat", "lon", "distance_m", "altitude_m", "speed_mps", "max_speed_mps", "heart_rate", "max_heart_rate", "cadence", "power", "elapsed_s", "timer_s", "ascent_m", "descent_m", "calories", "stress")
SCHEMA = "file string, message string, n int, at long, start long, sport string, " + ", ".join(f"{c} double" for c in NUMBERS) + ", error string"


class Damaged(ValueError):
    """A recording that doesn't keep to the format."""


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ 0xA001, c >> 1).astype(np.uint16)
    return c


_CRC = _crc_table()


def checksum(data: bytes, lanes: int = 256) -> int:
    """The format's 16-bit check sum. Equal stretches go through the table side by side; a stretch's sum is carried over the
    next one by what that many zeros make of each of its bits."""
    size = len(data) // lanes
    done = 0
    if size:
        rows = np.frombuffer(data, np.uint8, size * lanes).reshape(lanes, size)
        c, unit = np.zeros(lanes, np.uint16), np.left_shift(1, np.arange(16)).astype(np.uint16)
        for i in range(size):
            c = _CRC[(c ^ rows[:, i]) & 255] ^ c >> 8
            unit = _CRC[unit & 255] ^ unit >> 8
        for x in c.tolist():
            moved = 0
            for bit in range(16):
                if done >> bit & 1:
                    moved ^= int(unit[bit])
            done = moved ^ x
    for b in data[size * lanes :]:
        done = int(_CRC[(done ^ b) & 255]) ^ done >> 8
    return done


class Layout:
    """How one kind of message lies in the stream: read at once, of which the wanted fields are kept."""

    def __init__(self, message: str | None, endian: str, fields: list[tuple[int, int, int]], extra: int):
        self.message, codes, self.take = message, [], []
        for number, size, kind in fields:
            name, own, scale, offset = FIELDS.get(message, {}).get(number, (None, None, 1, 0))
            if name and kind == BYTE and own != BYTE and size > 1 and struct.calcsize("=" + BASE[own][0]) == size:
                kind = own  # some devices declare numbers as plain bytes
            code, none = BASE.get(kind, ("B", None))
            if name and code != "s" and struct.calcsize("=" + code) == size:
                self.take.append((len(codes), name, none, scale, offset))
                codes.append(code)
            else:  # not wanted, a text or several values: passed over as one
                codes.append(f"{size}s")
        self.reader = struct.Struct(endian + "".join(codes) + f"{extra}s")

    def values(self, raw: bytes) -> dict[str, float]:
        got = self.reader.unpack(raw)
        return {name: v / scale - offset if scale != 1 or offset else v for i, name, none, scale, offset in self.take if (v := got[i]) != none and v == v}


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise Damaged("the recording ends too early")
    return data


def _parts(f: BinaryIO, check: bool) -> Iterator[BinaryIO]:
    """The bodies of a file, one after another: it may hold several recordings."""
    while first := f.read(1):
        head = first + _exactly(f, 11)
        if head[0] < 12 or head[8:12] != b".FIT":
            raise Damaged("no recording begins here")
        head += _exactly(f, head[0] - 12)
        body = _exactly(f, int.from_bytes(head[4:8], "little"))
        told = int.from_bytes(_exactly(f, 2), "little")
        if check and checksum(head + body) != told:
            raise Damaged("the check sum is another one")
        yield io.BytesIO(body)


def messages(f: BinaryIO, check: bool = True) -> Iterator[tuple[str, dict[str, float]]]:
    """The wanted messages of a recording with their fields; none-values and unknown fields are left out."""
    for body in _parts(f, check):
        layouts: dict[int, Layout] = {}
        clock = 0
        while first := body.read(1):
            h = first[0]
            at = None
            if h & 0x80:  # a short header: five bits of the time, which go on from the last time
                local = h >> 5 & 3
                clock += (h & 31) - clock & 31
                at = clock
            else:
                local = h & 15
            if not h & 0x80 and h & 0x40:
                _, big, number, n = struct.unpack("BB2sB", _exactly(body, 5))
                endian = ">" if big else "<"
                fields = [tuple(_exactly(body, 3)) for _ in range(n)]
                extra = sum(_exactly(body, 3)[1] for _ in range(_exactly(body, 1)[0])) if h & 0x20 else 0
                layouts[local] = Layout(MESSAGES.get(struct.unpack(endian + "H", number)[0]), endian, fields, extra)
                continue
            if (layout := layouts.get(local)) is None:
                raise Damaged(f"no layout {local} was declared")
            got = layout.values(_exactly(body, layout.reader.size))
            if at is not None:
                got["at"] = at
            clock = got.get("at", clock)
            if layout.message:
                yield layout.message, got


def rows(name: str, f: BinaryIO, check: bool = True) -> list[tuple]:
    """The rows of SCHEMA of one file. A cadence counts both feet in records, as sessions and laps have it otherwise."""
    out, n = [], 0
    blank = dict.fromkeys(NUMBERS)
    try:
        for message, got in messages(f, check):
            n += 1
            if message == "record":
                for fine, coarse in (("fine_speed", "speed_mps"), ("fine_altitude", "altitude_m")):
                    if fine in got:
                        got[coarse] = got[fine]
                if "cadence" in got:
                    got["cadence"] = 2 * (got["cadence"] + got.get("half_cadence", 0.0))
            sport = got.get("sport")
            sport = None if sport is None else SPORTS[sport] if sport < len(SPORTS) else str(sport)
            numbers = blank | {k: float(v) for k, v in got.items() if k in blank}
            out.append((name, message, n, *(got[t] + FIRST_SECOND if t in got else None for t in TIMES), sport, *numbers.values(), None))
    except (Damaged, OSError, EOFError, zlib.error, struct.error, KeyError) as e:
        return [(name, "error", 0, None, None, None, *blank.values(), str(e) or type(e).__name__)]
    return out


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the option path names a folder of recordings or one of them")
        self.path, self.most = options["path"], int(options.get("partitionbytes", 64 << 20))
        self.check = str(options.get("checksum", "true")).lower() == "true"

    def partitions(self) -> list[Files]:
        """Whole files, in the order of their names, until they come to the wanted bytes."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        out: list[Files] = []
        size = self.most
        for x in sorted((x for x in found if x.type == pafs.FileType.File and x.path.lower().endswith((".fit", ".fit.gz"))), key=lambda x: x.path):
            if size >= self.most:
                out.append(Files([]))
                size = 0
            out[-1].names.append(x.path)
            size += x.size
        return out or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([("file", pa.string()), ("message", pa.string()), ("n", pa.int32()), *((t, pa.int64()) for t in TIMES), ("sport", pa.string()), *((c, pa.float64()) for c in NUMBERS), ("error", pa.string())])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held.clear()
            return done

        for name in part.names:
            short = name.rsplit("/", 1)[-1].split(".")[0]
            try:
                with fs.open_input_stream(name, compression=None) as raw:
                    held += rows(short, gzip.GzipFile(fileobj=raw) if name.lower().endswith(".gz") else raw, self.check)
            except OSError as e:
                held += [(short, "error", 0, None, None, None, *[None] * len(NUMBERS), str(e))]
            if len(held) >= 10_000:
                yield batch()
        if held:
            yield batch()


class Recordings(DataSource):
    """spark.read.format("recordings"): rows of SCHEMA from all files *.fit and *.fit.gz under `path`."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


def read_recordings(spark: SparkSession, path: str, partition_bytes: int = 64 << 20, check: bool = True) -> DataFrame:
    """file, message, n and the fields of each session, lap and record below path, an URI or a folder; null where a file
    doesn't have a field. n is the place among the file's messages of these kinds."""
    ship(spark)
    spark.dataSource.register(Recordings)
    where = path if "://" in path else f"file://{path}"
    return spark.read.format("recordings").option("path", where).option("partitionBytes", partition_bytes).option("checksum", str(check).lower()).load()


def encoded(samples: dict[str, list], sport: int = 1, endian: str = "<") -> bytes:
    """A recording with a record for each sample (columns of SCHEMA's names, None where there is none), a lap and a session."""
    at = [t for t in samples["at"] if t is not None]
    numbers = {name: (number, kind, scale, offset) for number, (name, kind, scale, offset) in FIELDS["record"].items()}
    names = [n for n in samples if n in numbers]
    out = io.BytesIO()

    def declare(local: int, message: int, fields: list[tuple[int, int]]) -> struct.Struct:
        sizes = [(number, struct.calcsize("=" + BASE[kind][0]), kind) for number, kind in fields]
        out.write(struct.pack(endian + "BBBHB", 0x40 | local, 0, int(endian == ">"), message, len(fields)) + b"".join(map(bytes, sizes)))
        return struct.Struct(endian + "B" + "".join(BASE[kind][0] for _, kind in fields))

    def cell(v, kind: int, scale: float, offset: float, name: str = ""):
        return BASE[kind][1] if v is None else round(((v - FIRST_SECOND if name in TIMES else v) + offset) * scale)

    record = declare(0, 20, [numbers[n][:2] for n in names])
    for row in zip(*(samples[n] for n in names), strict=True):
        out.write(record.pack(0, *(cell(v, *numbers[n][1:], n) for n, v in zip(names, row, strict=True))))
    dist = [d for d in samples.get("distance_m", []) if d is not None]
    whole = [at[0] - FIRST_SECOND, at[-1] - FIRST_SECOND, (at[-1] - at[0]) * 1000, round((dist[-1] - dist[0]) * 100)] if at and dist else [BASE[0x86][1]] * 4
    for local, message, more in ((1, 19, []), (2, 18, [(5, 0x00)])):
        out.write(declare(local, message, [(2, 0x86), (253, 0x86), (8, 0x86), (9, 0x86), *more]).pack(local, *whole, *[sport] * len(more)))
    body = out.getvalue()
    head = struct.pack("<BBHI4s", 12, 0x10, 2100, len(body), b".FIT")
    return head + body + struct.pack("<H", checksum(head + body))


def write_recordings(df: DataFrame, key: str, order: str, path: str, zipped: bool = True) -> DataFrame:
    """file, bytes of a recording for each key of df, written below path from its samples in order; columns have SCHEMA's names."""
    ship(df.sparkSession)
    where = path if "://" in path else f"file://{path}"
    names = [c for c in df.columns if c in {n for n, *_ in FIELDS["record"].values()}]

    def write(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        data = encoded({n: tab.sort_by(order)[n].to_pylist() for n in names})
        data = gzip.compress(data, 1, mtime=0) if zipped else data
        name = f"{keys[0].as_py()}.fit" + (".gz" if zipped else "")
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:  # the same bytes when a task runs again
            f.write(data)
        return pa.table({"file": pa.array([name]), "bytes": pa.array([len(data)], pa.int64())})

    return df.select(key, order, *(n for n in names if n not in (key, order))).groupBy(key).applyInArrow(write, "file string, bytes long")


def run_stats(read: DataFrame) -> DataFrame:
    """A row a file: what its last session says, its laps in order, how many records it has, their places and samples with a
    distance, and the error of a damaged one.

    A lap's pace is in minutes a km. Laps, places and samples are one recording's, so a row is bounded by its file.
    """
    kind = lambda k: F.col("message") == k
    listed = lambda cond, *cols: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("n", *cols)))), lambda x: F.struct(*(x[c].alias(c) for c in cols)))
    km = F.when(F.col("distance_m") != 0, F.round(F.col("distance_m") / 1000, 3))
    s = read.withColumn("dist_km", km).withColumn("pace_min_km", F.when((F.col("dist_km") > 0) & (F.col("timer_s") != 0), F.round(F.col("timer_s") / 60 / F.col("dist_km"), 3)))
    last = F.max_by(F.when(kind("session"), F.struct("sport", "start", (F.round(F.col("distance_m") / 1000, 4)).alias("total_km"), "timer_s", "elapsed_s", "speed_mps", "max_speed_mps", "heart_rate", "max_heart_rate", "cadence", "ascent_m", "descent_m", "power", "calories", "stress")), F.when(kind("session"), F.col("n")))
    out = s.groupBy("file").agg(
        last.alias("s"), F.count(F.when(kind("record"), 1)).alias("records"), listed(kind("lap"), "dist_km", "timer_s", "speed_mps", "heart_rate", "cadence", "ascent_m", "descent_m", "pace_min_km").alias("laps"),
        listed(kind("record") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), "lat", "lon").alias("places"),
        listed(kind("record") & F.col("at").isNotNull() & F.col("distance_m").isNotNull(), "at", "distance_m", "speed_mps", "altitude_m", "cadence", "lat", "lon").alias("samples"),
        listed(kind("record") & F.col("at").isNotNull() & F.col("heart_rate").isNotNull(), "at", "heart_rate").alias("beats"), F.max("error").alias("error"),
    )
    return out.select("file", "s.*", "records", "laps", "places", "samples", "beats", "error")
