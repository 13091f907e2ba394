"""Queries on files: written from table rows to the shared folder, read back by the sources, compared with the rows."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut, shared_folder
from driftloom.operators import audio as A
from driftloom.operators import matching as MT
from driftloom.plans import tables as T
from driftloom.plans.recordings import recorded_parts
from driftloom.plans.registering import registry
from driftloom.sources import annotations, archives, datasets, manifest, matlab, ranges, sink, store

QUERIES, ORACLES, query = registry()


def through_files(files: DataFrame, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in a folder with the ``files`` (name, content); the folder is deleted again."""
    spark = files.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    try:
        sink.write_files(files, folder)
        return cut(read(folder))
    finally:
        system, path = store.located(folder)
        system.delete_dir(path)


def packed(rows: DataFrame, name: Column, encode: Callable[[dict], bytes]) -> DataFrame:
    """name and content: each row as a file, as ``encode`` lays out its columns.

    Rows are small and files take time, so they are dealt out to all tasks first.
    """
    fields = [c for c in rows.columns]
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(name))

    @F.pandas_udf("binary")
    def content(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([encode(x) for x in frame.to_dict("records")])

    return rows.select(name.alias("name"), content(F.struct(*fields)).alias("content"))


def _measurement_file(x: dict) -> bytes:
    notes = [{"text": f" {n['text'].upper()} ", "timestamp": float(n["timestamp"])} for n in x["notes"]]
    values = {"birdname": x["bird"], "group": x["kind"], "timestamps": [p["at"] for p in x["points"]], "quantity": [p["value"] for p in x["points"]]}
    return matlab.encoded({"D": {**values, "annotations": notes}})


#: What stands for a treatment among the events, and a stamp in days.
MARKER = "purchase"
_DAYS = "(unix_micros(cast(ts as timestamp)) / 86400000000d)"


@query(f"""
with e as (select user_id % 40 as recording, event_type, value, epoch_us(ts) / 86400000000.0::double as days from events where user_id is not null and value is not null and ts is not null),
t as (select recording, min(days) filter (event_type = '{MARKER}') as t0 from e group by recording)
select recording, count(*)::bigint as n, {T.sql_round("sum(value)")} as total, {T.sql_round("any_value(t0)")} as t0,
    count(*) filter (days < t0)::bigint as n_before, count(*) filter (days > t0)::bigint as n_after
from e join t using (recording) group by recording
""")
def mat_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of 40 recordings in a MATLAB file a day, read as typed rows: events before and after the first marker."""
    events = T.events(spark, sf_dir).where("user_id is not null and value is not null and ts is not null").withColumn("recording", F.col("user_id") % 40)
    point = F.struct(F.expr(_DAYS).alias("at"), "value")
    note = F.when(F.col("event_type") == MARKER, F.struct(F.lit(MARKER).alias("text"), F.expr(_DAYS).alias("timestamp")))
    per = events.groupBy("recording", "day").agg(F.sort_array(F.collect_list(point)).alias("points"), F.collect_list(note).alias("notes"))
    per = per.withColumns({"bird": F.col("recording").cast("string"), "kind": F.lit("group")})
    name = F.format_string("%s/%s.mat", "bird", F.col("day").cast("string"))

    def read(folder: str) -> DataFrame:
        found = datasets.marked(matlab.measurements(spark, folder), "annotations", [MARKER])
        first = found.groupBy("birdname").agg(F.min("t0").alias("t0"))
        rows = found.select("birdname", F.explode(F.arrays_zip("timestamps", "quantity")).alias("p")).join(first, "birdname")
        at = F.col("p.timestamps")
        return rows.groupBy(F.col("birdname").cast("bigint").alias("recording")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("p.quantity"), 6).alias("total"), F.round(F.first("t0"), 6).alias("t0"),
            F.count_if(at < F.col("t0")).alias("n_before"), F.count_if(at > F.col("t0")).alias("n_after"),
        )

    return through_files(packed(per, name, _measurement_file), read)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and notes: a segment of each turn, in milliseconds, with a label from its text that needs quotes in a table."""
    turns = T.read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    letters = F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(6)), r"[^\w]", "")
    label = F.concat(F.lit('x,"'), letters, F.lit('"'))
    onset = F.col("turn") * 500 + 125
    note = F.struct(onset.alias("onset"), (onset + 100 + F.length(letters)).alias("offset"), F.coalesce(F.left("role", F.lit(1)), F.lit("?")).alias("letter"), label.alias("label"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(note)).alias("notes"))


_SQL_TURNS = """
k as (select conv_id, turn * 500 + 125 as onset, regexp_replace(left(coalesce(text, ''), 6), '[^0-9A-Za-z_]', '', 'g') as letters,
    coalesce(left(role, 1), '?') as letter from conversations where conv_id is not null and turn is not null),
n as (select conv_id, onset / 1000.0::double as onset_s, (onset + 100 + length(letters)) / 1000.0::double as offset_s, letter, 'x,"' || letters || '"' as label from k)
"""


def _notmat_file(x: dict) -> bytes:
    columns = [[float(n[c]) for n in x["notes"]] for c in ("onset", "offset")]
    return matlab.encoded({"onsets": columns[0], "offsets": columns[1], "labels": "".join(n["letter"] for n in x["notes"]), "Fs": 32000.0})


@query(f"with {_SQL_TURNS} select conv_id, onset_s, offset_s, letter as label, 'bird' || conv_id % 7 as bird from n")
def notmat_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation in a notmat file, read back through a manifest as the canonical table."""
    turns = _turns(spark, sf_dir)

    def read(folder: str) -> DataFrame:
        path = F.concat(F.lit(f"{folder}/"), F.col("conv_id").cast("string"), F.lit(".wav.not.mat"))
        rows = turns.select(
            F.concat(F.lit("bird"), (F.col("conv_id") % 7).cast("string")).alias("bird"), F.lit("2024-05-01 08:30:00").alias("timestamp"),
            F.concat(F.lit("/sounds/"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("audio_path"), path.alias("annot_path"),
        )
        listed = f"{folder}-manifest"
        rows.write.csv(listed, header=True)
        try:
            table, _ = annotations.load_from_manifest(spark, manifest.load_manifest(spark, listed), folder, "notmat")
            conv = F.regexp_extract("audio_file", r"^(\d+)", 1).cast("bigint")
            return cut(table.select(conv.alias("conv_id"), "onset_s", "offset_s", "label", "bird"))
        finally:
            system, path = store.located(listed)
            system.delete_dir(path)

    return through_files(packed(turns, F.format_string("%s.wav.not.mat", F.col("conv_id").cast("string")), _notmat_file), read)


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _text_file(kind: str) -> Callable[[dict], bytes]:
    def encode(x: dict) -> bytes:
        notes = [(n["onset"] / 1000, n["offset"] / 1000, n["label"]) for n in x["notes"]]
        if kind == "raven":
            rows = ["Selection\tBegin Time (s)\tEnd Time (s)\tAnnotation", *(f"{i}\t{a!r}\t{b!r}\t{_quoted(c)}" for i, (a, b, c) in enumerate(notes, 1))]
        elif kind == "aud-seq":
            rows = [f"{a!r}\t{b!r}\t{c}" for a, b, c in notes]
        elif kind == "textgrid":
            inner = [f"        intervals [{i}]:\n            xmin = {a!r}\n            xmax = {b!r}\n            text = {_quoted(c)}" for i, (a, b, c) in enumerate(notes, 1)]
            rows = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "item [1]:", '    class = "IntervalTier"', f"    intervals: size = {len(notes)}", *inner]
        else:
            rows = ["label,offset_s,onset_s", *(f"{_quoted(c)},{b!r},{a!r}" for a, b, c in notes)]
        return ("\n".join(rows) + "\n").encode()

    return encode


TEXT_FORMATS = ("simple-seq", "raven", "aud-seq", "textgrid")


@query(f"with {_SQL_TURNS} select f.format, conv_id, onset_s, offset_s, label from n, (select unnest({list(TEXT_FORMATS)!r}) as format) f")
def annotation_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as annotation files of four formats, labels with separators and quotes among them, read back."""
    turns = _turns(spark, sf_dir)
    found = []
    for kind in TEXT_FORMATS:
        files = packed(turns, F.format_string("%s.txt", F.col("conv_id").cast("string")), _text_file(kind))
        rows = through_files(files, lambda folder, kind=kind: annotations.READERS[kind](annotations.texts(spark, folder, ".txt")))
        conv = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint")
        found.append(rows.select(F.lit(kind).alias("format"), conv.alias("conv_id"), "onset_s", "offset_s", "label"))
    one, *rest = found
    for more in rest:
        one = one.unionByName(more)
    return one


#: Bytes of a range: most recordings are cut several times. Bytes of recordings that lie in files at a time, about.
RANGE, ON_DISK = 20_000, 4 << 30


@query("select conv_id, count(*)::bigint as n_true, count(*)::bigint as n_found, count(*)::bigint as n_within_10_ms, 0::bigint as n_unlike_whole from conversations group by conv_id")
def ranged_amplitude_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the recorded conversations found in WAV files by ranges of samples, and how many segments differ from whole files'."""
    parts, truth = recorded_parts(spark, sf_dir, ON_DISK)
    segmenter = A.AmplitudeSegmenter(threshold=0.2)

    def read(folder: str) -> DataFrame:
        pieces = ranges.ranged_segments(spark, folder, segmenter, bytes=RANGE)
        whole = A.amplitude_segments(datasets.wav_files(spark, folder), segmenter)
        both = pieces.withColumn("ranged", F.lit(True)).unionByName(whole.withColumn("ranged", F.lit(False)))
        return both.withColumn("audio_path", F.regexp_extract("audio_path", r"(\d+)\.wav$", 1))

    both = [through_files(r.select(F.concat("audio_path", F.lit(".wav")).alias("name"), "content"), read) for r in parts]
    both = reduce(DataFrame.unionAll, both)
    found, whole = both.where("ranged").drop("ranged"), both.where("not ranged").drop("ranged").withColumn("whole", F.lit(1))
    both = found.withColumn("ranged", F.lit(1)).join(whole, ["audio_path", "onset_s", "offset_s"], "full")
    unlike = both.groupBy("audio_path").agg(F.count_if(F.col("whole").isNull() | F.col("ranged").isNull()).alias("n_unlike_whole"))
    counts = MT.segment_counts(truth, found, ["audio_path"], 0.01).join(unlike, "audio_path", "left")
    return counts.select(
        F.col("audio_path").cast("bigint").alias("conv_id"), "n_true", F.col("n_pred").alias("n_found"), F.col("n_matched").alias("n_within_10_ms"),
        F.coalesce("n_unlike_whole", F.lit(0).cast("long")).alias("n_unlike_whole"),
    )


def _zip_of_days(x: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d in x["days"]:
            lines = [f"{n['at']} {n['at'] + n['length']}" for n in d["notes"]]
            z.writestr(f"{x['bird']}/{d['day']}.txt", "# onset offset\n" + "\n".join(lines) + "\nnot a segment\n")
        z.writestr("readme.md", "1 2")
    return out.getvalue()


@query("""
with e as (select user_id % 40 as bird, ts::date::varchar as day, 1 + length(event_type) as length from events
    where user_id is not null and ts is not null and event_type is not null),
f as (select bird, day, count(*) as sounds, sum(length) as seconds from e group by all)
select bird::varchar as bird, day, count(*)::bigint as n_files, sum(sounds)::bigint as n_sounds, sum(seconds)::double as seconds,
    grouping_id(bird, day)::bigint as level from f group by rollup (bird, day)
""")
def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds of 40 individuals and every day from text members of zip archives, one for each, with subtotals."""
    events = T.events(spark, sf_dir).where("user_id is not null and ts is not null and event_type is not null")
    at = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    note = F.struct(at.alias("at"), (1 + F.length("event_type")).alias("length"))
    bird = (F.col("user_id") % 40).cast("string").alias("bird")
    days = events.groupBy(bird, F.col("day").cast("string").alias("day")).agg(F.sort_array(F.collect_list(note)).alias("notes"))
    users = days.groupBy("bird").agg(F.collect_list(F.struct("day", "notes")).alias("days"))

    def read(folder: str) -> DataFrame:
        segments = datasets.text_segments(archives.lines(archives.read_members(spark, folder, members="*.txt")))
        sums = [F.count(F.lit(1)).alias("sounds"), F.sum(F.expr("offset_s - onset_s")).alias("seconds")]
        parts = F.split("member", "[/.]")
        per = segments.groupBy("path", "member").agg(*sums).select(parts[0].alias("bird"), parts[1].alias("day"), "sounds", "seconds")
        return datasets.inventory(per).select("bird", "day", "n_files", "n_sounds", "seconds", F.col("level").cast("long").alias("level"))

    return through_files(packed(users, F.concat("bird", F.lit(".zip")), _zip_of_days), read)


def _npz_of_vectors(x: dict) -> bytes:
    out = io.BytesIO()
    rows = sorted(x["rows"], key=lambda r: r["vec_id"])
    np.savez_compressed(out, ids=np.array([r["vec_id"] for r in rows]), vectors=np.stack([np.asarray(r["embedding"], np.float32) for r in rows]))
    return out.getvalue()


@query(f"""
select label, count(*)::bigint as n, min(vec_id)::bigint as first_id, max(vec_id)::bigint as last_id,
    {T.sql_round("sum(list_sum(list_transform(embedding, lambda x: x::double)))", 4)} as total,
    {T.sql_round("sum(list_sum(list_transform(embedding, lambda x: x::double * x::double)))", 4)} as squares
from embeddings where embedding is not null and label is not null group by label
""")
def npz_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each label in npz files of some 200, read back a row each and joined with their ids by row."""
    rows = T.read(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    many = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows.count() // 2000))).cast("string")
    per = rows.groupBy("label", many.alias("part")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))

    def read(folder: str) -> DataFrame:
        arrays = archives.read_arrays(spark, folder)
        ids = arrays.where("array = 'ids'").select("path", "row", F.col("vector")[0].cast("bigint").alias("vec_id"))
        both = arrays.where("array = 'vectors'").join(ids, ["path", "row"])
        total = lambda f: F.sum(F.aggregate("vector", F.lit(0.0), lambda s, x: s + f(x)))
        return both.groupBy(F.regexp_extract("path", r"(-?\d+)-\d+\.npz$", 1).cast("int").alias("label")).agg(
            F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"),
            F.round(total(lambda x: x), 4).alias("total"), F.round(total(lambda x: x * x), 4).alias("squares"),
        )

    return through_files(packed(per, F.format_string("%s-%s.npz", F.col("label").cast("string"), "part"), _npz_of_vectors), read)
