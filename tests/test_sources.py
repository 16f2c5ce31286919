import pytest
from pyspark.sql import functions as F

from dwellkit.operators import features, segment
from dwellkit.sources import recordings


def write(path, header, rows):
    path.write_text("\n".join([header, *[",".join(map(str, r)) for r in rows]]) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("csv")
    for name, states in (("a.csv", [2, 0, 0, 1, 1, 0, 0, 2]), ("b.csv", [0, 0, 0, 1, "nan", 1, 1, 1])):
        write(base / name, "Time,Current,State", [(i * 0.001, 1.5 * i, s) for i, s in enumerate(states)])
    return base


@pytest.mark.parametrize("reader", [recordings.read_recordings, recordings.read_positional])
def test_read_csv(spark, folder, reader):
    sig = reader(spark, str(folder))
    rows = sig.filter("record_id = 'b.csv'").orderBy("sample_idx").collect()
    assert [r.state for r in rows] == [0, 0, 0, 1, None, 1, 1, 1]
    assert [r.sample_idx for r in rows] == list(range(8)) and rows[3].time == 0.003 and rows[3].current == 4.5
    ev = {r.record_id: r for r in features.event_features(sig).collect()}
    assert ev["a.csv"].event_duration == 6 and ev["b.csv"].event_duration == 7
    assert ev["b.csv"].num_transitions == 1


def test_positional_ignores_names(spark, tmp_path):
    write(tmp_path / "x.csv", "t,pA,channels", [(0.0, 3.0, 1.0), (0.001, 4.0, 2.0)])
    got = recordings.read_positional(spark, str(tmp_path)).orderBy("sample_idx").collect()
    assert [(r.current, r.state) for r in got] == [(3.0, 1), (4.0, 2)]


def test_classes_by_file(spark, folder):
    sig = recordings.read_recordings(spark, [str(folder / "a.csv"), str(folder / "b.csv")])
    got = recordings.with_classes(sig, {"PeptideA": 0, "PeptideB": 1}, {"a.csv": "PeptideA", "b.csv": "PeptideB"})
    assert {(r.record_id, r.label) for r in got.select("record_id", "label").distinct().collect()} == {("a.csv", 0), ("b.csv", 1)}
    with pytest.raises(KeyError):
        recordings.with_classes(sig, {}, {"a.csv": "PeptideA"})
    with pytest.raises(Exception, match="no class for recording b.csv"):
        recordings.with_classes(sig, {"PeptideA": 0}, {"a.csv": "PeptideA"}).collect()
    kept = recordings.with_classes(sig, {"PeptideA": 0}, {"a.csv": "PeptideA"}, unclassed="drop")
    assert [r.record_id for r in kept.select("record_id").distinct().collect()] == ["a.csv"]


@pytest.fixture(scope="module")
def nested(tmp_path_factory):
    base = tmp_path_factory.mktemp("nested")
    for name in ("r1/rec.csv", "r2/rec.csv", "r1/with space+%41.csv"):
        (base / name).parent.mkdir(exist_ok=True)
        write(base / name, "Time,Current,State", [(i * 0.001, 1.0, 0.0) for i in range(8)])
    return base


def counts(sig):
    return {r["record_id"]: r["count"] for r in sig.groupBy("record_id").count().collect()}


@pytest.mark.parametrize("reader", [recordings.read_recordings, recordings.read_positional])
def test_ids_are_paths_below_the_root(spark, nested, reader):
    both = [str(nested / "r1/rec.csv"), str(nested / "r2/rec.csv")]
    assert counts(reader(spark, both, root=str(nested))) == {"r1/rec.csv": 8, "r2/rec.csv": 8}
    # The id of a file does not depend on what else is read.
    assert counts(reader(spark, both[0], root=f"file://{nested}/")) == {"r1/rec.csv": 8}
    assert counts(reader(spark, str(nested / "*/rec.csv"), root=str(nested))) == {"r1/rec.csv": 8, "r2/rec.csv": 8}
    assert counts(reader(spark, str(nested / "r1"))) == {"rec.csv": 8, "with space+%41.csv": 8}
    assert counts(reader(spark, both[0])) == {"rec.csv": 8}
    with pytest.raises(ValueError, match="rec.csv"):
        reader(spark, both)
    with pytest.raises(Exception, match="does not lie below"):
        reader(spark, both[0], root=str(nested / "r2")).collect()


def test_relative_root(spark, nested):
    sig = recordings.read_recordings(spark, str(nested / "r2"), root=nested.name)
    assert counts(sig) == {"r2/rec.csv": 8}


def test_csv_round_trip(spark, tmp_path):
    rows = [(f"a/b {r}=%", i, i * 0.1, r + i / 3, None if i == 4 else i % 3, i % 4) for r in range(3) for i in range(40)]
    sig = spark.createDataFrame(rows, "record_id string, sample_idx long, time double, current double, state int, species int")
    recordings.write_recordings(sig.repartition(5), str(tmp_path / "csv"))
    again = recordings.read_written(spark, str(tmp_path / "csv"), species=True)
    assert sorted(map(tuple, again.select(sig.columns).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_csv_files_are_opened_once_and_by_all_tasks(spark, tmp_path):
    """However few bytes there are, every task writes; what follows reads no CSV file again."""
    rows = [(r, i, i * 0.1, 1.0, 0) for r in range(40) for i in range(10)]
    sig = spark.createDataFrame(rows, "record_id long, sample_idx long, time double, current double, state int")
    recordings.write_recordings(sig.repartition(5), str(tmp_path / "csv"))
    writers = {f.name.split("-")[1] for f in (tmp_path / "csv").glob("record_id=*/part-*.csv")}
    assert len(writers) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = recordings.read_written(spark, str(tmp_path / "csv"), "bigint")
    assert not any(".csv" in f for f in back.inputFiles())
    assert sorted(map(tuple, back.select(sig.columns).collect())) == rows


def test_event_set_keeps_class_type(spark, tmp_path):
    ev = spark.createDataFrame([("007", 1), ("7", 2)], "label string, event_id long")
    recordings.write_events(ev, str(tmp_path / "e"))
    back = recordings.read_events(spark, str(tmp_path / "e"), kind="string")
    assert sorted((r.label, r.event_id) for r in back.collect()) == [("007", 1), ("7", 2)]
    assert {r.label for r in recordings.read_events(spark, str(tmp_path / "e")).collect()} == {7}


def test_round_trips(spark, folder, tmp_path):
    sig = recordings.read_recordings(spark, str(folder))
    recordings.write_recordings(sig, str(tmp_path / "csv"))
    again = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert set(again.columns) == {"Time", "Current", "State", "record_id"} and again.count() == 16
    recordings.write_signal(sig, str(tmp_path / "parquet"))
    stored = spark.read.parquet(str(tmp_path / "parquet"))
    want = sorted(map(tuple, segment.runs(sig).collect()))
    assert sorted(map(tuple, segment.runs(stored).collect())) == want
    ev = features.event_features(sig).withColumn("label", F.lit(3))
    recordings.write_events(ev, str(tmp_path / "events"))
    back = recordings.read_events(spark, str(tmp_path / "events"))
    assert back.count() == 2 and {r.label for r in back.collect()} == {3}


def test_species_recording(spark, tmp_path):
    write(tmp_path / "g.csv", "Time,Current,State,Species", [(0.0, 0.0, 0, 1), (0.001, 1.0, 1, 2)])
    got = recordings.read_recordings(spark, str(tmp_path), species=True).orderBy("sample_idx").collect()
    assert [r.species for r in got] == [1, 2]


def test_shared_dir_follows_the_session(spark):
    from dwellkit.session import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.checkpoint.dir": "hdfs://names/shared"}.get(key, default))

    assert shared_dir(Session, "events").startswith("hdfs://names/shared/events-")
    one, two = shared_dir(spark, "events"), shared_dir(spark, "events")
    assert one != two

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared_dir(Cluster, "events")
