from __future__ import annotations

import csv
import io
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from devicelog.plans.load import load_files
from devicelog.session import use_utc
from devicelog.sources import csv_files
from devicelog.sources.claims import Claim, Claims
from devicelog.sources.store import Store
from devicelog.streaming.ingest import stream_ingest

A = "Timestamp,Case Number,Flow rate L/min,Overall alarm status\n"


def read(spark, folder):
    use_utc(spark)
    raw, files, headers, _ = csv_files.read_sessions(spark, folder)
    return raw.join(files, "session_id"), files, headers


def test_headers_in_another_order_keep_their_values(spark, write_csv):
    write_csv("a.csv", A + "2026-01-01 00:00:00,1,2.5,Alarm\n")
    folder = write_csv(
        "b.csv",
        '﻿ Flow rate L/min ,"Bubble, note", Case Number ,Timestamp\n3.5," x ",2,2026-01-02 00:00:00\n',
    )
    raw, _, headers = read(spark, folder)
    rows = {r.filename: r for r in raw.collect()}
    assert (rows["a.csv"].flow_rate_lpm, rows["a.csv"].alarm_overall) == ("2.5", "Alarm")
    assert (rows["b.csv"].flow_rate_lpm, rows["b.csv"].case_id) == ("3.5", "2")
    assert rows["b.csv"].alarm_overall is None
    assert rows["b.csv"].extra == {"Bubble, note": "x"}
    assert rows["a.csv"].extra is None
    unmapped = {r.source_file.rsplit("/", 1)[1]: r.unmapped for r in headers.collect()}
    assert unmapped == {"a.csv": [], "b.csv": ["Bubble, note"]}


def test_repeated_and_quoted_headers(spark, write_csv):
    folder = write_csv("a.csv", 'x,"say ""hi""",x,,Case Number\n1,2,3,4,5\n')
    raw, _, _ = read(spark, folder)
    row = raw.first()
    assert row.extra == {"x": "1", 'say "hi"': "2", "x.1": "3", "": "4"}
    assert row.case_id == "5"


def test_short_rows_have_blank_cells(spark, write_csv):
    folder = write_csv("a.csv", A + "2026-01-01 00:00:00,1\n\n2026-01-01 00:00:01,1,,\n")
    raw, _, _ = read(spark, folder)
    assert [r.flow_rate_lpm for r in raw.orderBy("row_ordinal").collect()] == ["", ""]


def test_rows_wider_than_their_header_keep_their_cells(spark, write_csv, folder):
    wide = "".join(f"2026-01-01 00:00:0{k},1,2,{rest}\n" for k, rest in enumerate([",kept", ",", "", ",,,far"]))
    write_csv("wide.csv", A + wide)
    source = write_csv("other.csv", "Case Number,beyond header 3\n1,x,more\n1,y\n")
    store = Store(spark, f"{folder}/store")
    report = load_files(spark, source, store).report.where("code = 'WIDE_ROWS'").collect()
    assert sorted((r.filename, r.message.split()[0]) for r in report) == [("other.csv", "1"), ("wide.csv", "2")]
    of = {r.filename: r.session_id for r in store.sessions().collect()}
    rows = store.measurements(of["wide.csv"]).orderBy("row_ordinal").collect()
    assert [r.extra for r in rows] == [{"beyond header 5": "kept"}, None, None, {"beyond header 7": "far"}]
    others = store.measurements(of["other.csv"]).orderBy("row_ordinal").collect()
    assert [r.extra for r in others] == [{"beyond header 3": "x", "beyond header 3.1": "more"}, {"beyond header 3": "y"}]


def test_stored_rows_are_not_shuffled_by_load(spark, write_csv, folder):
    store = Store(spark, f"{folder}/store")
    load_files(spark, write_csv("a.csv", A + "2026-01-01 00:00:00,1,2,Alarm\n"), store)
    plan = store.measurements()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # With the rows of an unfinished load beside them, its folder is left out by a partition filter.
    store.measurements().write.parquet(f"{folder}/store/measurements/load_id=7")
    plan = store.measurements()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "load_id" in plan.split("PartitionFilters", 1)[1]


def test_row_order_follows_a_split_file(spark, write_csv):
    folder = write_csv("big.csv", "Case Number,Flow rate L/min\n" + "".join(f"{i},1\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        raw, _, _ = read(spark, folder)
        assert raw.select(F.spark_partition_id()).distinct().count() > 3
        cases = [int(r.case_id) for r in raw.orderBy("row_ordinal").select("case_id").collect()]
        ordinals = raw.select("row_ordinal").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert cases == list(range(5000))
    assert ordinals == 5000


def test_load_report(spark, write_csv, folder):
    write_csv("none.csv", "\n\n")
    write_csv("empty.csv", A)
    write_csv("plain.csv", A + "2026-01-01 00:00:00,1,2,\n")
    write_csv("clock.csv", A + "soon,1,2,\n5 Mar 2024,1,2,\n")
    source = write_csv("odd.csv", "Flow rate L/min,Note\n1,x\n")
    loaded = load_files(spark, source, Store(spark, f"{folder}/store"))
    codes = sorted((r.filename, r.code) for r in loaded.report.collect())
    assert codes == [
        ("clock.csv", "NO_TIME_FORMAT"),
        ("empty.csv", "EMPTY_FILE"),
        ("none.csv", "UNREADABLE"),
        ("odd.csv", "NO_CASE_ID"),
        ("odd.csv", "NO_TIMESTAMP"),
        ("odd.csv", "UNRECOGNISED_COLUMNS"),
    ]
    assert loaded.sessions == 3
    store = Store(spark, f"{folder}/store")
    sessions = {r.filename: r for r in store.sessions().collect()}
    assert set(sessions) == {"plain.csv", "odd.csv", "clock.csv"}
    assert sessions["odd.csv"].case_id == "unknown"
    assert sessions["odd.csv"].time_start is None
    assert '"duplicates_removed":0' in sessions["plain.csv"].provenance


def test_a_file_name_is_loaded_once(spark, write_csv, folder):
    store = Store(spark, f"{folder}/store")
    source = write_csv("a.csv", A + "2026-01-01 00:00:00,1,2,Alarm\n")
    write_csv("a.csv", A + "2026-01-01 00:00:00,9,9,\n", sub="in/again")
    first = load_files(spark, source, store)
    assert first.sessions == 1
    assert [(r.filename, r.code) for r in first.report.collect()] == [("a.csv", "NAME_KNOWN")]
    again = load_files(spark, source, store)
    assert (again.sessions, again.report.count()) == (0, 2)
    write_csv("b.csv", A + "2026-01-01 00:00:00,2,3,\n2026-01-01 00:00:01,2,3,\n")
    assert load_files(spark, source, store).sessions == 1
    ids = {r.filename: r.session_id for r in store.sessions().collect()}
    assert ids == {"a.csv": 1, "b.csv": 2}
    assert store.measurements().count() == 3
    assert store.measurements(2).count() == 2
    assert store.measurements([1, 2]).count() == 3
    assert store.measurements([]).count() == 0
    assert store.alarm_events().count() == 1
    assert store.sizes().longest == 2


def test_files_known_by_path_and_length(spark, write_csv, folder):
    store = Store(spark, f"{folder}/store")
    source = one_file(write_csv, "a.csv", 1, "in")
    one_file(write_csv, "a.csv", 2, "in/again")
    first = load_files(spark, source, store, identity="path")
    assert (first.sessions, first.report.count()) == (2, 0)
    again = load_files(spark, source, store, identity="path")
    assert again.sessions == 0 and {r.code for r in again.report.collect()} == {"FILE_KNOWN"}
    # A file that has grown is another one; by name it would be known.
    write_csv("a.csv", A + "2026-01-01 00:00:00,1,2.5,Alarm\n" * 9, sub="in")
    assert load_files(spark, source, store).sessions == 0
    assert load_files(spark, source, store, identity="path").sessions == 1
    assert store.files().count() == store.sessions().count() == 3


def test_an_unfinished_load_is_not_read(spark, write_csv, folder):
    store = Store(spark, f"{folder}/store")
    source = write_csv("a.csv", A + "2026-01-01 00:00:00,1,2,Alarm\n")
    load_files(spark, source, store)
    # Measurements of a load whose sessions were never written.
    store.measurements().write.parquet(f"{folder}/store/measurements/load_id=7")
    assert store.measurements().count() == 1


def test_empty_store(spark, folder):
    store = Store(spark, f"{folder}/nothing")
    assert store.sessions().count() == 0
    assert store.measurements().count() == 0
    assert store.last_session_id() == 0


def test_stream_loads_each_file_once(spark, write_csv, folder):
    source = write_csv("a.csv", A + "2026-01-01 00:00:00,1,2,\n")
    write_csv("b.csv", "Flow rate L/min,Case Number\n4,2\n5,2\n")

    def run():
        stream_ingest(spark, source, f"{folder}/store", f"{folder}/progress", files_per_batch=1).awaitTermination()
        return Store(spark, f"{folder}/store")

    store = run()
    assert store.sessions().count() == 2
    write_csv("c.csv", A + "31/12/2026 00:00:00,3,2,Alarm\n")
    store = run()
    assert sorted(r.session_id for r in store.sessions().collect()) == [1, 2, 3]
    assert store.measurements().count() == 4
    assert run().measurements().count() == 4


def one_file(write_csv, name, case, sub):
    return write_csv(name, A + f"2026-01-01 00:00:00,{case},2.5,Alarm\n2026-01-01 00:00:01,{case},2.6,\n", sub=sub)


def test_a_stream_leaves_earlier_loads_alone(spark, write_csv, folder):
    store = Store(spark, f"{folder}/store")
    load_files(spark, one_file(write_csv, "h.csv", 1, "one"), store)
    for name, sub in (("l.csv", "two"), ("m.csv", "three")):
        source = one_file(write_csv, name, name, sub)
        stream_ingest(spark, source, f"{folder}/store", f"{folder}/progress-{sub}").awaitTermination()
    load_files(spark, one_file(write_csv, "n.csv", 4, "four"), store)
    assert sorted(r.filename for r in store.sessions().collect()) == ["h.csv", "l.csv", "m.csv", "n.csv"]
    assert store.measurements().count() == 8


def test_a_batch_keeps_its_claim(spark, folder):
    store = Store(spark, f"{folder}/store")
    given = [store.claim_of_batch(s, b, n) for s, b, n in (("a", 0, 2), ("b", 0, 1), ("a", 1, 3))]
    assert [(c.load_id, c.first_session) for c in given] == [(0, 1), (1, 3), (2, 4)]
    assert store.claim_of_batch("a", 0, 2) == given[0] and Store(spark, store.folder).claim_of_batch("b", 0, 1) == given[1]
    assert (store.last_load_id(), store.last_session_id()) == (2, 6)
    assert store.claim_of_batch("a", 0, 5).load_id == 3


def test_a_taken_load_cannot_be_claimed(spark, folder):
    one, other = (Claims(spark, f"{folder}/claims") for _ in range(2))
    assert one.publish(Claim(0, 1, 2))
    assert not other.publish(Claim(0, 1, 7))
    assert other.all() == one.all() == [Claim(0, 1, 2)]
    # A writer that read the claims before the other took the number goes on to the next.
    late, publish = Claims(spark, f"{folder}/claims"), Claims.publish
    tried = []

    def slow(claim):
        if not tried:
            assert publish(one, Claim(1, 3, 4))
        tried.append(claim.load_id)
        return publish(late, claim)

    late.publish = slow
    assert late.take(5, 0, 1) == Claim(2, 7, 5) and tried == [1, 2]


def test_two_loads_at_once_keep_every_session(spark, write_csv, folder):
    """Each writer has read the store before the other writes anything."""
    first, second = Store(spark, f"{folder}/store"), Store(spark, f"{folder}/store")
    sources = [[one_file(write_csv, f"{w}{k}.csv", f"{w}{k}", w) for k in range(3)][0] for w in ("x", "y")]
    append, done = Store.append, []

    def between(*load):
        if not done:
            done.append(load_files(spark, sources[1], second))
        append(first, *load)

    first.append = between
    assert load_files(spark, sources[0], first).sessions == 3 and done[0].sessions == 3
    store = Store(spark, f"{folder}/store")
    sessions = {r.session_id: r.filename for r in store.sessions().collect()}
    assert sorted(sessions.values()) == ["x0.csv", "x1.csv", "x2.csv", "y0.csv", "y1.csv", "y2.csv"]
    assert len(sessions) == 6 and store.measurements().count() == 12
    for i, name in sessions.items():
        assert {r.case_id for r in store.measurements(i).collect()} == {name[:2]}


def test_loads_from_several_threads(spark, write_csv, folder):
    sources = [one_file(write_csv, f"t{k}.csv", f"t{k}", f"t{k}") for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda source: load_files(spark, source, Store(spark, f"{folder}/store")), sources))
    store = Store(spark, f"{folder}/store")
    assert sorted(r.session_id for r in store.sessions().collect()) == [1, 2, 3, 4]
    assert store.measurements().count() == 8


def test_a_session_is_read_from_its_load_alone(spark, write_csv, folder):
    store = Store(spark, f"{folder}/store")
    for k in range(3):
        load_files(spark, one_file(write_csv, f"p{k}.csv", k, f"p{k}"), store)
    ids = {r.case_id: r.session_id for r in store.sessions().collect()}

    def loads_read(rows):
        rows.collect()
        scans = rows._jdf.queryExecution().executedPlan().collectLeaves()
        names = [scans.apply(i).metrics() for i in range(scans.size())]
        return [m.apply("numPartitions").value() for m in names if m.contains("numPartitions")]

    assert loads_read(store.measurements(ids["1"])) == [1]
    assert loads_read(store.alarm_events([ids["0"], ids["2"]])) == [2]
    assert loads_read(store.measurements()) == [3]
    chosen = spark.createDataFrame([(ids["2"],)], "session_id LONG")
    assert {r.case_id for r in store.measurements(chosen).collect()} == {"2"}
    assert store.loads_of([ids["2"], 99]) == [2]


def test_reading_the_store_runs_no_job(spark, write_csv, folder):
    store = Store(spark, f"{folder}/store")
    load_files(spark, one_file(write_csv, "j.csv", 1, "j"), store)
    group = f"read-{folder}"
    spark.sparkContext.setJobGroup(group, "reads")
    try:
        store.measurements(), store.sessions(), store.alarm_events()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []


BREAKS = [
    ("2026-01-01 00:00:00,1,2.5,plain\n", "plain"),
    ('2026-01-01 00:00:01,1,2.6,"two\nlines"\n', "two\nlines"),
    ('2026-01-01 00:00:02,1,"2.7","a ""b"",\n\n , c"\n', 'a "b",\n\n , c'),
    ('2026-01-01 00:00:03,1,2.8,5" tube\n', '5" tube'),
    ('2026-01-01 00:00:04,1,2.9,"x""\n""y"\n', 'x"\n"y'),
    ('2026-01-01 00:00:05,1,3.0,"q" tail\n', "q tail"),
    ("\n", None),
    ('2026-01-01 00:00:06,1,3.1,"first,\n2026-01-01 00:00:09,9,9.9,""no row""\nlast"\n', 'first,\n2026-01-01 00:00:09,9,9.9,"no row"\nlast'),
]


def test_line_breaks_inside_cells(spark, write_csv, folder):
    header = 'Timestamp,Case Number,Flow rate L/min,"Note\nof it"\n'
    body = "".join(line for line, _ in BREAKS)
    write_csv("breaks.csv", header + body)
    write_csv("plain.csv", A + "2026-01-01 00:00:00,1,2.5,\n")
    source = write_csv("never.csv", A + '2026-01-01 00:00:00,1,2,"open\n2026-01-01 00:00:01,1,2,\n')
    raw, _, _ = read(spark, source)
    rows = raw.where("filename = 'breaks.csv'").orderBy("row_ordinal").collect()
    wanted = [note for _, note in BREAKS if note is not None]
    assert [r.extra["Note\nof it"] for r in rows] == wanted
    assert [r.timestamp for r in rows] == [f"2026-01-01 00:00:0{k}" for k in range(7)]
    assert [r.flow_rate_lpm for r in rows] == ["2.5", "2.6", "2.7", "2.8", "2.9", "3.0", "3.1"]
    loaded = load_files(spark, source, Store(spark, f"{folder}/store"))
    assert loaded.sessions == 2
    assert [(r.filename, r.code) for r in loaded.report.where("code <> 'UNRECOGNISED_COLUMNS'").collect()] == [("never.csv", "OPEN_QUOTE")]


def test_records_across_the_splits_of_a_file(spark, write_csv):
    """Cells that begin in one split and end in a later one, checked against Python's csv module."""
    rng = random.Random(7)
    bits = ["a", "b,", '""', "\n", "longer text ", "\n\n"]
    text, wanted = "Case Number,Note,Last\n", []
    for i in range(1500):
        cell = "".join(rng.choice(bits) for _ in range(rng.choice([1, 2, 30])))
        text += f'{i},"{cell}",{rng.choice(["", "z", chr(34) * 2])}\n'
    for fields in list(csv.reader(io.StringIO(text)))[1:]:
        wanted.append((fields[0], fields[1].strip(" \t\n")))
    folder = write_csv("big.csv", text)
    write_csv("other.csv", "Case Number,Note\n" + "".join(f"{i},n\n" for i in range(900)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        raw, _, _ = read(spark, folder)
        got = raw.where("filename = 'big.csv'").orderBy("row_ordinal").collect()
        plans = raw._jdf.queryExecution().toString()
        assert raw.where("filename = 'other.csv'").count() == 900
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.case_id, r.extra["Note"]) for r in got] == wanted
    assert "multiLine" not in plans


def test_text_is_read_once(spark, write_csv):
    """The lines written hold what the folder has, and headers and rows come from them."""
    source = write_csv("a.csv", A + "2026-01-01 00:00:00,1,2.5,Alarm\n" * 50)
    raw, _, headers, records = csv_files.read_sessions(spark, source)
    for frame in (raw, headers, records.rows):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan or "FileScan parquet" in plan
        assert "FileScan text" not in plan and "FileScan csv" not in plan


def test_names_with_blanks_brackets_and_capitals(spark, write_csv, folder):
    names = ["log (1).csv", "log[2].csv", "a 50%.csv", "{x},*.CSV"]
    for i, name in enumerate(names):
        source = one_file(write_csv, name, i, "in")
    store = Store(spark, f"{folder}/store")
    assert load_files(spark, source, store).sessions == 4
    assert store.measurements().count() == 8


def test_folders_are_listed_by_few_tasks(spark, write_csv):
    """Spark's default is a task for each of up to 10,000 folders or names; a session's own setting stays."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    source = write_csv("a.csv", A + "2026-01-01 00:00:00,1,2,\n")
    for given, used in (("10000", str(8 * spark.sparkContext.defaultParallelism)), ("7", "7")):
        spark.conf.set(key, given)
        assert csv_files.list_files(spark, source).count() == 1
        assert spark.conf.get(key) == used
    spark.conf.set(key, "10000")


def test_counts_of_wide_rows_make_no_maps(spark, write_csv):
    source = write_csv("a.csv", "Flow rate L/min,Note\n1,x\n2,y,\n3,z,,more\n")
    raw, files, _, _ = csv_files.read_sessions(spark, source)
    counts = csv_files.row_counts(raw, files)
    assert "transform(unmapped" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[1:] for r in counts.collect()] == [(3, 1)]


def test_headers_are_found_without_sorting_rows(spark, write_csv):
    source = write_csv("a.csv", '\n,\nNote,Flow rate L/min\n"x\n,y",2\n')
    write_csv("b.csv", "Flow rate L/min,Note\n1,x\n")
    headers = csv_files.read_headers(csv_files.read_records(spark, source))
    assert "SortAggregate" not in headers._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.source_file[-5:], list(r.names)) for r in headers.collect()) == [
        ("a.csv", ["", ".1"]),
        ("b.csv", ["Flow rate L/min", "Note"]),
    ]


def test_small_files_are_streamed_in_one_batch(spark, write_csv, folder):
    """Each batch has the fixed costs of a load."""
    for i in range(1001):
        source = write_csv(f"f{i}.csv", f"Flow rate L/min,Case Number\n{i},c{i}\n")
    stream_ingest(spark, source, f"{folder}/store", f"{folder}/progress").awaitTermination()
    store = Store(spark, f"{folder}/store")
    assert store.sessions().count() == 1001 and store.last_load_id() == 0
    assert sorted(r.flow_rate_lpm for r in store.measurements().collect()) == list(range(1001))
