"""Binary recordings: hand-made streams, damage, partitions and the round trip."""

import gzip
import struct

import pytest

from strideline.sources import recordings as rec

AT = 1_700_000_000


def whole(body, head_size=12):
    head = struct.pack("<BBHI4s", head_size, 0x10, 2100, len(body), b".FIT") + b"\0" * (head_size - 12)
    return head + body + struct.pack("<H", rec.checksum(head + body))


def definition(local, message, fields, endian="<", extra=()):
    out = struct.pack(endian + "BBBHB", 0x40 | local | (0x20 if extra else 0), 0, int(endian == ">"), message, len(fields)) + b"".join(map(bytes, fields))
    return out + (bytes([len(extra)]) + b"".join(map(bytes, extra)) if extra else b"")


def read(data, check=True):
    import io

    return [dict(zip([c.split()[0] for c in rec.SCHEMA.split(", ")], r)) for r in rec.rows("f", io.BytesIO(data), check)]


def by_bits(data):
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0xA001 if c & 1 else 0)
    return c


def test_checksum_equals_bit_by_bit():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        data = bytes((i * 37 + i // 7) % 256 for i in range(n))
        assert rec.checksum(data) == by_bits(data)
    assert rec.checksum(b"123456789") == 0xBB3D


def test_fields_scales_none_values_and_both_byte_orders():
    for endian in "<>":
        body = definition(0, 20, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84), (3, 1, 2), (4, 1, 2), (5, 4, 0x86), (6, 2, 0x84), (53, 1, 2), (200, 3, 2), (8, 6, 7)], endian)
        fmt = endian + "BIiiHBBIHB3s6s"
        body += struct.pack(fmt, 0, AT - rec.FIRST_SECOND, 2**29, -(2**29), 3000, 140, 85, 123456, 3210, 64, b"abc", b"text\0\0")
        body += struct.pack(fmt, 0, AT + 1 - rec.FIRST_SECOND, 0x7FFFFFFF, 0x7FFFFFFF, 0xFFFF, 0xFF, 0xFF, 0xFFFFFFFF, 0xFFFF, 0xFF, b"abc", b"\0" * 6)
        a, b = read(whole(body, 14 if endian == ">" else 12))
        assert (a["at"], a["lat"], a["lon"], a["altitude_m"], a["heart_rate"], a["distance_m"], a["speed_mps"]) == (AT, 45.0, -45.0, 100.0, 140.0, 1234.56, 3.21)
        assert a["cadence"] == 171.0 and a["message"] == "record" and a["n"] == 1  # both feet, with the half
        assert b["at"] == AT + 1 and all(b[k] is None for k in ("lat", "lon", "altitude_m", "heart_rate", "cadence", "distance_m", "speed_mps"))


def test_numbers_declared_as_bytes_are_mended_and_arrays_left_out():
    body = definition(0, 18, [(253, 4, 0x0D), (9, 4, 0x0D), (7, 4, 0x0D), (5, 1, 0), (14, 4, 0x84), (22, 2, 0x0D), (16, 1, 0x0D)])
    body += struct.pack("<BIIIBIHB", 0, AT - rec.FIRST_SECOND, 610400, 0xFFFFFFFF, 2, 99, 120, 150)
    (s,) = read(whole(body))
    assert (s["message"], s["at"], s["distance_m"], s["elapsed_s"], s["sport"], s["speed_mps"], s["ascent_m"], s["heart_rate"]) == ("session", AT, 6104.0, None, "cycling", None, 120.0, 150.0)


def test_short_headers_carry_the_clock_on_and_layouts_are_replaced():
    t = AT - rec.FIRST_SECOND
    t += 29 - t % 32  # close to where five bits wrap
    body = definition(0, 20, [(253, 4, 0x86), (3, 1, 2)]) + struct.pack("<BIB", 0, t, 100)
    body += definition(1, 20, [(3, 1, 2)], extra=[(0, 2, 0), (1, 3, 1)])
    for k, hr in ((1, 101), (5, 102), (9, 103)):
        body += bytes([0x80 | 1 << 5 | (t + k) % 32, hr]) + b"\x01\x02\x03\x04\x05"
    body += definition(1, 99, [(3, 2, 0x84)]) + b"\x01\x05\x00" + definition(1, 19, [(7, 4, 0x86)]) + struct.pack("<BI", 1, 90500)
    got = read(whole(body))
    assert [(r["message"], r["heart_rate"]) for r in got] == [("record", 100.0), ("record", 101.0), ("record", 102.0), ("record", 103.0), ("lap", None)]
    assert [r["at"] - rec.FIRST_SECOND - t for r in got[:4]] == [0, 1, 5, 9] and got[4]["elapsed_s"] == 90.5


def test_damage_gives_one_row_of_error():
    good = rec.encoded({"at": [AT, AT + 5], "heart_rate": [100, None], "distance_m": [0.0, 15.0]})
    assert [r["message"] for r in read(good)] == ["record", "record", "lap", "session"] and [r["message"] for r in read(good + good)] == ["record", "record", "lap", "session"] * 2
    flipped = good[:40] + bytes([good[40] ^ 1]) + good[41:]
    for bad in (good[:-1], good[:30], flipped, b"not a recording at all", good + b"x", whole(b"\x03\x01"), whole(definition(0, 20, [(253, 4, 0x86)])[:-1])):
        (r,) = read(bad)
        assert r["message"] == "error" and r["error"] and r["n"] == 0
    assert len(read(flipped, check=False)) == 4 and read(b"") == [] and read(whole(b"")) == []


def test_source_reads_folders_in_partitions(spark, tmp_path):
    (tmp_path / "more").mkdir()
    for i in range(7):
        data = rec.encoded({"at": [AT + k for k in range(50)], "heart_rate": [100 + k % 7 if k % 3 else None for k in range(50)], "distance_m": [3.0 * k + i for k in range(50)], "lat": [10.0] * 50, "lon": [None, *[20.0] * 49]}, endian="<>"[i % 2])
        where = tmp_path / ("more" if i % 2 else ".") / f"a{i}.fit"
        if i == 3:
            (tmp_path / "more" / "a3.fit.gz").write_bytes(gzip.compress(data)[:-20])
        elif i == 4:
            (tmp_path / "A4.FIT.GZ").write_bytes(gzip.compress(data))
        else:
            where.write_bytes(data)
    (tmp_path / "notes.txt").write_text("x")
    for size, parts in ((1, 7), (1 << 20, 1)):
        got = rec.read_recordings(spark, str(tmp_path), size)
        assert got.rdd.getNumPartitions() == parts
        n = {r.file: r["count"] for r in got.groupBy("file").count().collect()}
        assert n == {"a0": 52, "a1": 52, "a2": 52, "a3": 1, "A4": 52, "a5": 52, "a6": 52}
    stats = {r.file: r for r in rec.run_stats(got).collect()}
    s = stats["a5"]
    assert (s.sport, s.records, s.total_km, s.timer_s, s.error) == ("running", 50, 0.147, 49.0, None) and len(s.places) == 49 and len(s.samples) == 50 and len(s.beats) == 33
    assert [(x.dist_km, x.timer_s, x.pace_min_km) for x in s.laps] == [(0.147, 49.0, round(49 / 60 / 0.147, 3))] and [x.at for x in s.samples] == [AT + k for k in range(50)]
    assert stats["a3"].error and stats["a3"].records == 0 and stats["a3"].laps == []
    empty = tmp_path / "empty"
    empty.mkdir()
    assert rec.read_recordings(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="option path"):
        spark.dataSource.register(rec.Recordings)
        spark.read.format("recordings").load().count()


def test_written_recordings_come_back(spark, tmp_path):
    rows = [(k, i, AT + 10 * i, None if i == 2 else 46.1 + i / 1e4, 7.5, 3.0 * i, 120.0 + i, 400.2 + i / 5, "x") for k in ("a", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "run string, i int, at long, lat double, lon double, distance_m double, heart_rate double, altitude_m double, more string")
    assert rec.write_recordings(df, "run", "i", str(tmp_path / "out")).count() == 2
    got = rec.read_recordings(spark, str(tmp_path / "out")).where("message = 'record'").orderBy("file", "n").collect()
    assert [(r.file, r.at, r.distance_m, r.heart_rate) for r in got] == [(r[0], r[2], r[5], r[6]) for r in rows]
    assert all((r.lat is None) == (w[3] is None) and (w[3] is None or abs(r.lat - w[3]) < 1e-7) and abs(r.altitude_m - w[7]) <= 0.1 for r, w in zip(got, rows))
