"""Files in temporary folders: names, manifests, annotations, day trees."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftloom import schema
from driftloom.sources import annotations, datasets, manifest, names


def write(path, text=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


NOTES = "onset_s,offset_s,label\n0.1,0.2,a\n0.3,0.5,0\n"


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("wr4ub2_220312_0836.1.wav", ("wr4ub2", None, dt.datetime(2012, 3, 22, 8, 36), 1)),
        ("ok71vy3_baseline_280912_0705.-26369.wav", ("ok71vy3", "baseline", dt.datetime(2012, 9, 28, 7, 5), -26369)),
        ("mn30po9__two_words_190412_1721.20144.wav.csv", ("mn30po9", "two_words", dt.datetime(2012, 4, 19, 17, 21), 20144)),
        ("notes.txt", (None, None, None, None)),
        ("bird_991399_2561.1.wav", ("bird", None, None, 1)),
    ],
)
def test_recording_names(spark, name, want):
    df = spark.createDataFrame([(f"/data/x/{name}",)], "path string")
    row = df.select(*[c.alias(k) for k, c in names.recording("path").items()]).first()
    assert (row["bird"], row["template"], row["timestamp"], row["serial"]) == want


def test_day_directories(spark):
    df = spark.createDataFrame([("032212",), ("133212",), ("x",)], "d string")
    assert [r[0] for r in df.select(names.directory_day("d")).collect()] == [dt.date(2012, 3, 22), None, None]


def test_manifest_is_validated(spark, tmp_path):
    good = write(tmp_path / "m.csv", "bird,timestamp,audio_path,annot_path,group\nb,2024-05-01T08:30:00,a.wav,a.csv,treated\nb,2024-05-02 09:00,b.wav,b.csv,treated\n")
    rows = manifest.load_manifest(spark, str(good)).collect()
    assert [r["timestamp"] for r in rows] == [dt.datetime(2024, 5, 1, 8, 30), dt.datetime(2024, 5, 2, 9)]
    with pytest.raises(ValueError, match="annot_path"):
        manifest.load_manifest(spark, str(write(tmp_path / "n.csv", "bird,timestamp,audio_path\nb,2024-05-01,a\n")))
    with pytest.raises(ValueError, match="someday"):
        manifest.load_manifest(spark, str(write(tmp_path / "o.csv", "bird,timestamp,audio_path,annot_path\nb,someday,a,b\n")))


def test_manifest_from_a_directory(spark, tmp_path):
    write(tmp_path / "in/gr41_2024-05-01T0830.wav")
    write(tmp_path / "in/gr41_2024-05-01T0830.wav.csv", NOTES)
    write(tmp_path / "in/odd.wav")
    pattern = r"^(?P<bird>[^_]+)_(?P<timestamp>\d{4}-\d\d-\d\dT\d{4})"
    made, unmatched = manifest.build_manifest(spark, str(tmp_path / "in"), pattern, "%Y-%m-%dT%H%M", out=str(tmp_path / "out"))
    row = made.first()
    assert (row["bird"], row["timestamp"]) == ("gr41", dt.datetime(2024, 5, 1, 8, 30))
    assert row["annot_path"].endswith("gr41_2024-05-01T0830.wav.csv")
    assert [r["name"] for r in unmatched.collect()] == ["odd.wav"]
    assert manifest.load_manifest(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError, match="timestamp"):
        manifest.build_manifest(spark, str(tmp_path / "in"), r"(?P<bird>x)", "%Y")


def made_manifest(spark, tmp_path, files):
    rows = []
    for i, (name, text) in enumerate(files):
        path = tmp_path / "notes" / f"{name}.wav.csv"
        if text is not None:
            write(path, text)
        rows.append(("b", dt.datetime(2024, 5, 1 + i, 8), f"/audio/{name}.wav", str(path), "treated"))
    return spark.createDataFrame(rows, "bird string, timestamp timestamp_ntz, audio_path string, annot_path string, group string")


def test_annotations_through_a_manifest(spark, tmp_path):
    df = made_manifest(spark, tmp_path, [("one", NOTES), ("two", NOTES), ("three", None)])
    table, counts = annotations.load_from_manifest(spark, df, str(tmp_path / "notes"), on_missing="skip")
    assert counts.first()["n_missing"] == 1
    rows = table.orderBy("timestamp", "onset_s").collect()
    assert [(r["audio_file"], r["label"], r["group"], r["day"]) for r in rows][:2] == [
        ("one.wav", "a", "treated", dt.date(2024, 5, 1)), ("one.wav", "0", "treated", dt.date(2024, 5, 1))]
    assert rows[1]["duration_s"] == pytest.approx(0.2)
    assert table.columns[: len(schema.EVENTS.names)] == schema.EVENTS.names
    with pytest.raises(FileNotFoundError, match="three"):
        annotations.load_from_manifest(spark, df, str(tmp_path / "notes"))
    with pytest.raises(ValueError, match="simple-seq"):
        annotations.load_from_manifest(spark, df, str(tmp_path / "notes"), annot_format="nope")


def test_reversed_annotations_fail(spark, tmp_path):
    df = made_manifest(spark, tmp_path, [("one", "onset_s,offset_s,label\n0.5,0.4,a\n")])
    table, _ = annotations.load_from_manifest(spark, df, str(tmp_path / "notes"))
    with pytest.raises(Exception, match="offset does not follow onset"):
        table.collect()


def test_formats():
    assert annotations.audacity("0.1\t0.2\ta\n\\\t100\t200\n0.3\t0.4\tb") == [(0.1, 0.2, "a"), (0.3, 0.4, "b")]
    grid = 'item [1]:\n class = "IntervalTier"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = ""\n intervals [2]:\n xmin = 0.5\n xmax = 0.7\n text = "a"\n'
    assert annotations.textgrid(grid) == [(0.5, 0.7, "a")]
    xml = "<S><Sequence><Position>32000</Position><Note><Position>3200</Position><Length>6400</Length><Label>b</Label></Note></Sequence></S>"
    assert annotations.song_xml(xml) == [(1.1, 1.3, "b")]


def test_raven_columns(spark, tmp_path):
    path = write(tmp_path / "a.txt", "Selection\tBegin Time (s)\tEnd Time (s)\tAnnotation\n1\t0.5\t0.9\tx\n")
    assert [tuple(r)[1:] for r in annotations.reader("raven")(annotations.texts(spark, str(path.parent), ".txt")).collect()] == [(0.5, 0.9, "x")]


def test_flat_annotations(spark):
    notes = spark.createDataFrame(
        [("d/zed7_0002_2018_04_23_14_18_03.wav", 0.1, 0.2, "1"), ("zed7_0002_2018_04_23_14_18_03.wav", 0.3, 0.2, "2"), ("zed7_0003_2018_04_24_10_00_00.wav", 0.1, 0.4, "1"), ("gone_2018_04_24_10_00_00.wav", 0.1, 0.4, "1")],
        "file string, on double, off double, label string",
    )
    audio = spark.createDataFrame([("/z/zed7_0002_2018_04_23_14_18_03.wav",), ("/a/zed7_0002_2018_04_23_14_18_03.wav",), ("/a/zed7_0003_2018_04_24_10_00_00.wav",)], "path string")
    columns = {"audio_file": "file", "onset_s": "on", "offset_s": "off"}
    settings = ("zed7", r"(?P<timestamp>\d{4}(?:_\d\d){5})", "%Y_%m_%d_%H_%M_%S", columns)
    table, counts = annotations.load_flat(notes, audio, *settings, on_missing="skip", group="control")
    assert tuple(counts.first()) == (1, 0, 1)
    rows = table.orderBy("timestamp").collect()
    assert [(r["day"], r["audio_path"], r["group"]) for r in rows] == [
        (dt.date(2018, 4, 23), "/a/zed7_0002_2018_04_23_14_18_03.wav", "control"), (dt.date(2018, 4, 24), "/a/zed7_0003_2018_04_24_10_00_00.wav", "control")]
    with pytest.raises(FileNotFoundError):
        annotations.load_flat(notes, audio, *settings)
    with pytest.raises(ValueError, match="missing required"):
        annotations.load_flat(notes, audio, *settings[:3], on_missing="skip")


def tree(tmp_path, wrong=False):
    for i, day in enumerate(("032212", "032312")):
        for k in range(3):
            stem = f"b1_{'2' + str(2 + i)}0312_08{k}0.{k}.wav"
            write(tmp_path / f"b1/{day}/{stem}")
            if k < 2:
                write(tmp_path / f"b1/{day}/{stem}.csv", NOTES)
    if wrong:
        write(tmp_path / "b1/032212/b1_250312_0900.9.wav.csv", NOTES)
    return str(tmp_path)


def test_day_trees(spark, tmp_path):
    table, cover = datasets.load_dataset(spark, tree(tmp_path, wrong=True), on_date_mismatch="skip")
    assert table.count() == 8
    counts = {r["dir_day"]: (r["n_audio"], r["n_annotated"], r["n_unannotated"], r["n_date_mismatch"]) for r in cover.collect()}
    assert counts == {dt.date(2012, 3, 22): (3, 2, 1, 1), dt.date(2012, 3, 23): (3, 2, 1, 0)}
    with pytest.raises(ValueError, match="250312"):
        datasets.load_dataset(spark, str(tmp_path))


def test_segments_and_wide_tables(spark, tmp_path):
    lines = spark.createDataFrame([("# c",), ("0.1 0.2",), ("x 1",), ("0.5 0.7 z",), ("",)], "value string")
    assert [(r["onset_s"], r["offset_s"]) for r in datasets.text_segments(lines).collect()] == [(0.1, 0.2), (0.5, 0.7)]
    path = write(tmp_path / "l.csv", "type,file,dph,l1,l2\na,f,day 45x,1,2\na,f,none,1,2\na,f,50,,2\n")
    rows, counts = datasets.wide_table(spark, str(path), "l", 2)
    assert [(r["age"], r["z"]) for r in rows.collect()] == [(45, [1.0, 2.0])]
    assert tuple(counts.first()) == (3, 1, 1)


def test_inventory_has_totals(spark):
    files = spark.createDataFrame([("b", 1, 5, 1.0), ("b", 1, 3, 2.0), ("b", 2, 1, 1.0)], "bird string, day int, sounds long, seconds double")
    found = {(r["bird"], r["day"]): r["n_sounds"] for r in datasets.inventory(files).collect()}
    assert found == {("b", 1): 8, ("b", 2): 1, ("b", None): 9, (None, None): 9}


def test_markers(spark):
    df = spark.createDataFrame([([(" Deafened ", 5.0), ("deafened", 3.0), ("other", 1.0)],)], "notes array<struct<text:string,timestamp:double>>")
    assert datasets.marked(df, "notes", ["deafened"]).first()["t0"] == 3.0


def test_schema(spark):
    empty = schema.empty_events(spark)
    assert schema.validated(empty).count() == 0
    with pytest.raises(ValueError, match="onset_s"):
        schema.validated(empty.drop("onset_s"))
    assert "group" in schema.canonical(empty.withColumn("group", F.lit("x"))).columns


def test_largest_file(spark, tmp_path):
    write(tmp_path / "a.csv", "x" * 2000)
    write(tmp_path / "b/c.csv", "x" * 3000)
    assert names.largest(names.sizes(spark, str(tmp_path), ".csv")).endswith("b/c.csv")
    with pytest.raises(ValueError):
        names.largest(names.sizes(spark, str(tmp_path), ".csv"), 10_000)
