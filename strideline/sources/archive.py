"""An activity export as Spark tables: finding it, its CSV, recordings listed in it, snapshots of earlier results, settings."""

from __future__ import annotations

import json
import math
import re
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of activities.csv that are used; fixed names of the export's format.
COLUMNS = [
    "Activity ID", "Activity Date", "Activity Name", "Activity Description", "Activity Type", "Filename", "Distance", "Moving Time", "Elapsed Time",
    "Elevation Gain", "Elevation Loss", "Average Heart Rate", "Max Heart Rate",
]


def newest_export(folder: str) -> str:
    """The newest zip of an export in a local folder by its time, else the newest folder export_*; FileNotFoundError if there is none."""
    found = sorted(Path(folder).glob("export_*.zip"), key=lambda p: p.stat().st_mtime) or sorted((p for p in Path(folder).glob("export_*") if p.is_dir()), key=lambda p: p.stat().st_mtime)
    if not found:
        raise FileNotFoundError(f"no export in {folder}")
    return str(found[-1])


def unpacked(path: str, to: str) -> str:
    """The folder that holds activities.csv: of a zip, after unpacking it to `to`; the first one in the order of names."""
    root = Path(path)
    if root.suffix == ".zip":
        with zipfile.ZipFile(root) as z:
            z.extractall(to)
        root = Path(to)
    found = sorted(p.parent for p in root.rglob("activities.csv"))
    if not found:
        raise FileNotFoundError(f"no activities.csv in {path}")
    return str(found[0])


def newest_by_name(folder: str, pattern: str = "activities_*.csv") -> str | None:
    """The last file by its name, not by its time."""
    return max((str(p) for p in Path(folder).glob(pattern)), key=lambda p: Path(p).name, default=None)


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """activities.csv with every column as text; a byte-order mark goes, quoted cells may hold line breaks and doubled
    quotes, and columns that the file lacks are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("inferSchema", False).csv(path)
    raw = raw.toDF(*(c.removeprefix("﻿") for c in raw.columns))
    return raw.select(*(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS), *(F.col(f"`{c}`") for c in raw.columns if c not in COLUMNS))


def number(name: str) -> Column:
    """A cell as a number; blank or garbage is null."""
    return F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)")


def typed(raw: DataFrame) -> DataFrame:
    """activity_id, start (UTC), epoch, name, description, sport, recording, dist_m, moving_s, elapsed_s, gain_m, loss_m,
    avg_hr, max_hr. What doesn't parse is null; the recording's id is its file's name up to the first point."""
    col = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    num = lambda c: number(c) if c in raw.columns else F.lit(None).cast("double")
    start = F.try_to_timestamp(col("Activity Date"), F.lit("MMM d, yyyy, h:mm:ss a"))
    return raw.select(
        col("Activity ID").alias("activity_id"), start.alias("start"), F.unix_seconds(start).alias("epoch"), col("Activity Name").alias("name"), col("Activity Description").alias("description"),
        F.lower(col("Activity Type")).alias("sport"), F.nullif(F.regexp_extract(F.substring_index(col("Filename"), "/", -1), r"^([^.]+)", 1), F.lit("")).alias("recording"),
        num("Distance").alias("dist_m"), num("Moving Time").alias("moving_s"), num("Elapsed Time").alias("elapsed_s"), num("Elevation Gain").alias("gain_m"), num("Elevation Loss").alias("loss_m"),
        num("Average Heart Rate").alias("avg_hr"), num("Max Heart Rate").alias("max_hr"),
    )


def recordings(files: DataFrame, path_col: str = "path") -> DataFrame:
    """recording, path: one file for each recording; the compressed one where there are both."""
    name = F.substring_index(F.col(path_col), "/", -1)
    f = files.select(F.regexp_replace(name, r"\.fit(\.gz)?$", "").alias("recording"), F.col(path_col).alias("path")).where(name.rlike(r"\.fit(\.gz)?$"))
    return f.groupBy("recording").agg(F.max_by("path", F.struct(F.col("path").endswith(".gz"), F.col("path"))).alias("path"))


def parsed_before(snapshot: DataFrame, id_col: str = "fit_file", order: list[str] | None = None) -> DataFrame:
    """Of an earlier result the first row of each recording in which anything was parsed, so that failed ones are read again.

    First is by the columns in `order`, then by all columns, so that it doesn't depend on how files are split: rows of one
    recording were parsed from the same bytes and differ in the export's columns only.
    """
    parsed = [c for c in snapshot.columns if c.startswith("fit_") and c != id_col]
    some = F.greatest(*(F.coalesce(F.col(f"`{c}`").cast("string") != "", F.lit(False)) for c in parsed), F.lit(False))
    rows = snapshot.where(F.coalesce(F.col(id_col), F.lit("")) != "").where(some)
    key = F.struct(*(F.col(f"`{c}`") for c in order or []), F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(snapshot.columns)))))
    first = rows.groupBy(id_col).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in snapshot.columns)), key).alias("_r"))
    return first.select("_r.*")


def still_to_parse(files: DataFrame, done: DataFrame) -> DataFrame:
    """Recordings that no earlier result has."""
    return files.join(done.select(F.col("fit_file").alias("recording")), "recording", "left_anti")


#: JSON columns of the enriched table, with what they hold; fixed names of its format.
POINT = "struct<d:double,t:double,pace:double,elev:double,hr:int,cad:int,lat:double,lon:double>"
SPLIT = "struct<km:int,time_s:double,gain_m:int,loss_m:int,cad:int>"


def json_array(name: str, of: str) -> Column:
    """A JSON text column as an array; missing or corrupt text is an empty one."""
    return F.coalesce(F.from_json(F.col(name), f"array<{of}>"), F.array().cast(f"array<{of}>"))


def to_json_array(name: str) -> Column:
    return F.to_json(F.col(name))


@dataclass(frozen=True)
class Race:
    name: str
    distance_m: float
    date: str | None = None
    target_time_s: int | None = None
    target_wave_s: tuple[int, int] | None = None
    notes: str = ""
    activity_id: str | None = None


@dataclass(frozen=True)
class Settings:
    races: tuple[Race, ...] = ()
    segment_anchors: tuple[dict, ...] = ()
    not_duplicates: tuple[tuple[str, str], ...] = ()
    force_duplicate: dict[str, str] = field(default_factory=dict)
    force_primary: tuple[str, ...] = ()
    hr_max: int | None = None
    hr_rest: int | None = None
    age: int | None = None
    sex: str | None = None


def _whole(v, lo: int, hi: int) -> int | None:
    """A whole number, also one that is written as text, within bounds."""
    try:
        n = int(v)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if not isinstance(v, bool) and lo <= n <= hi else None


def _real(v) -> float | None:
    try:
        x = float(v)
    except (TypeError, ValueError):
        return None
    return x if not isinstance(v, bool) and math.isfinite(x) else None


def _text(v) -> str:
    return "" if v is None else str(v).strip()


def _race(x: dict) -> Race | None:
    name, dist = _text(x.get("name")), _real(x.get("distance_m"))
    wave, target = x.get("target_wave_s"), x.get("target_time_s")
    times = [None if target is None else _whole(target, 1, 10**7), *([_whole(w, 0, 10**7) for w in wave[:2]] if isinstance(wave, list) and len(wave) > 1 else [])]
    if not name or not dist or dist <= 0 or (target is not None and times[0] is None) or (wave and (len(times) < 3 or None in times[1:])):
        return None
    date = _text(x.get("date"))
    return Race(name, dist, date if re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", date) else None, times[0], tuple(times[1:]) or None, str(x.get("notes") or ""), _text(x.get("activity_id")) or None)


def _anchor(x: dict) -> dict | None:
    at = [_real(v) for v in x["center"][:2]] if isinstance(x.get("center"), list) else []
    length = _real(x.get("len_m"))
    return {"name": str(x["name"]), "center": at, "len_m": length} if x.get("name") is not None and len(at) == 2 and None not in at and length is not None and length > 0 else None


#: How each sex may be written.
SEXES = {"m": "M", "male": "M", "f": "F", "female": "F"}


def settings(path: str) -> Settings:
    """The settings file. It never fails: a missing or corrupt file gives defaults, and a malformed entry is left out by
    itself. Numbers may be text, ids lose the blanks around them; blank ids and pairs of one id are left out."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return Settings()
    if not isinstance(raw, dict):
        return Settings()
    part = lambda of, k, kind: of[k] if isinstance(of.get(k), kind) else kind()
    dup, body = part(raw, "duplicates", dict), part(raw, "physiology", dict)
    named = lambda rows: [(a, b) for a, b in ((_text(a), _text(b)) for a, b in rows) if a and b and a != b]
    pairs = named(p[:2] for p in part(dup, "not_duplicates", list) if isinstance(p, list) and len(p) > 1)
    return Settings(
        tuple(r for x in part(raw, "races", list) if isinstance(x, dict) and (r := _race(x))), tuple(a for x in part(raw, "segment_anchors", list) if isinstance(x, dict) and (a := _anchor(x))),
        tuple(pairs), dict(named(part(dup, "force_duplicate", dict).items())), tuple(a for x in part(dup, "force_primary", list) if (a := _text(x))),
        _whole(body.get("hr_max"), 120, 230), _whole(body.get("hr_rest"), 25, 100), _whole(body.get("age"), 5, 100), SEXES.get(_text(body.get("sex")).lower()),
    )


def races_table(spark: SparkSession, s: Settings) -> DataFrame:
    rows = [(i, r.name, r.distance_m, r.date, r.target_time_s, r.notes, r.activity_id) for i, r in enumerate(s.races)]
    return spark.createDataFrame(rows, "n int, name string, distance_m double, date string, target_time_s int, notes string, activity_id string")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV of one header a file; nested columns as JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def cached_values(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a key-value cache (key, value): the keys with their values, and the distinct keys that it lacks. A cached null
    value is known: it isn't asked for again."""
    known = keys.join(cache, "key", "left")
    return known, keys.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def input_signature(df: DataFrame, version: str) -> str:
    """A digest of the rows of df, in any order, and a version of the parameters: results kept under it hold as long as it does."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4))).first()
    import hashlib

    return hashlib.sha1(json.dumps([version, sorted(df.columns), *map(str, parts)]).encode()).hexdigest()


def kept_or_made(spark: SparkSession, folder: str, signature: str, make, force: bool = False) -> DataFrame:
    """The table kept under this signature; made and kept if there is none, or if force."""
    where = f"{folder.rstrip('/')}/{signature}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if force or not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def read_age_factors(spark: SparkSession, path: str) -> DataFrame:
    """sex, label, age, factor, open_s of a published table in JSON ({sex: {label: {age_min, open_s, factors}}}); other
    entries, as its source, and what isn't there or isn't well-formed give no rows."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        raw = {}
    rows = []
    for sex, by_label in raw.items() if isinstance(raw, dict) else []:
        for label, e in by_label.items() if isinstance(by_label, dict) else []:
            try:
                rows += [(sex, label, int(e["age_min"]) + i, float(f), float(e["open_s"])) for i, f in enumerate(e["factors"])]
            except (KeyError, TypeError, ValueError):
                continue
    return spark.createDataFrame(rows, "sex string, label string, age long, factor double, open_s double")


def read_stars(path: str) -> list[str]:
    """The starred keys of an exported list; a missing or corrupt file has none."""
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return []
    return [k for k in raw if isinstance(k, str)] if isinstance(raw, list) else []


def write_stars(keys: list[str], path: str) -> None:
    Path(path).write_text(json.dumps(sorted(set(keys))))


def provided(missing: DataFrame, ask=None, batch: int = 100, tries: int = 3) -> DataFrame:
    """key, value of keys that a cache lacks. ask takes a list of keys and returns their values, None where there is none;
    without one (offline) nothing is asked and no row comes back. Keys are asked for in batches, each again after an error;
    a batch that keeps failing gives no rows, so its keys are asked for another time."""
    if ask is None:
        return missing.select("key", F.lit(None).cast("double").alias("value")).limit(0)
    import pandas as pd

    def run(frames):
        for frame in frames:
            keys = frame["key"].tolist()
            for i in range(0, len(keys), batch):
                some = keys[i : i + batch]
                for _ in range(tries):
                    try:
                        yield pd.DataFrame({"key": some, "value": pd.array(ask(some), dtype="Float64")})
                        break
                    except OSError:
                        continue

    return missing.select("key").distinct().mapInPandas(run, "key string, value double")


def compile_export(spark: SparkSession, source: str, out: str, recordings_table: DataFrame | None = None, sport: str = "running", workspace: str | None = None, force: bool = False) -> DataFrame:
    """An export (zip or folder) to an enriched table at `out`: all rows with what their recordings gave, of one sport. An
    earlier result for the same rows is taken as it is unless force."""
    from strideline.operators.runs import with_recordings

    rows = typed(read_activities(spark, f"{unpacked(source, workspace or f'{source}_files')}/activities.csv"))
    table = recordings_table if recordings_table is not None else spark.createDataFrame([], "fit_file string, fit_sport string")
    joined = with_recordings(rows, table, sport)
    return kept_or_made(spark, out, input_signature(joined, f"v1 {sport}"), lambda: joined, force)
