"""Records of CSV files cut at every byte, against a reader of whole files; quarantined rows."""

import csv
import io

import pytest
from tremor import schemas
from tremor.sources import csv_records as C
from tremor.sources import loader

HOSTILE = (
    'a,b,c\n1,"two\nlines",x\n2,"a ""quoted"", word",\n3,plain with " inside,y\n4,"","z"\n5,"\n\n""\n",""\n\n6,"comma, here\r\nand there",é😀\n7,"",\n'
    '8,"""starts",1\n9,"ends""",2\n10,"a\n,\n""\n,""",3\n11,x"y"z,4\n12,"many\n\n\n\n\n\n\nbreaks",5\n13,last,"with\nbreak"'
)


def by_hand(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("tail, size", [("", 5), ("\n", 17), ("\n\n", 40), ("", 1000)])
def test_cuts_give_the_same_records(spark, tmp_path, tail, size):
    path = str(tmp_path / "h.csv")
    (tmp_path / "h.csv").write_bytes((HOSTILE + tail).encode())
    want = sorted(map(tuple, spark.read.csv(path, header=True, schema="a string, b string, c string", multiLine=True, escape='"').collect()), key=repr)
    assert len(want) == 13
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    usual = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, (str(size), "0"), strict=True):
            spark.conf.set(k, v)
        assert sorted(map(tuple, C.read_csv(spark, path, "a string, b string, c string").collect()), key=repr) == want
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def plain_records(text):
    """Physical lines joined while quotes are open, from the file's beginning."""
    out, state = [], C.START
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        out = [*out[:-1], f"{out[-1]}\n{line}"] if state == C.QUOTED else [*out, line]
        state = C._after(line, state)
    return out


@pytest.mark.parametrize("tail", ["", "\n", "\n\n"])
def test_every_cut_of_the_lines(tail):
    """The two passes over the splits of every size, without a session."""
    import pyarrow as pa

    text = HOSTILE + tail
    lines, at = [], 0
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        lines.append((at, line))
        at += len(line.encode()) + 1
    want = plain_records(text)
    for size in range(1, 80):
        rows = [("f", start // size * size, line) for start, line in lines]
        batch = lambda rows, *more: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)] + list(more), ["file", "block", "value", *["state"] * len(more)])
        ends = [tuple(r.values()) for b in C._reduce(iter([batch(rows[:7]), batch(rows[7:])])) for r in b.to_pylist()]
        state, states = C.START, {}
        for _, block, *outcome in ends:
            states[block] = state
            state = outcome[state]
        of = lambda rows: pa.array([states[r[1]] for r in rows], pa.int32())
        pieces = [r for b in C._assemble(iter([batch(rows[:9], of(rows[:9])), batch(rows[9:], of(rows[9:]))])) for r in b.to_pylist()]
        got: list[str] = []
        for r in pieces:
            got = [*got[:-1], f"{got[-1]}\n{r['text']}"] if r["piece"] == 0 else [*got, r["text"]]
        assert got == want and [r["first"] for r in pieces] == [True] + [False] * (len(pieces) - 1), size


def test_states_after_lines():
    assert [C._after(x, C.START) for x in ("", "a", '"', '"a"', '"a""', 'a"b', '"a",b"', '"a"b', ',"', '"",""', '"","')] == [0, 0, 1, 0, 1, 0, 0, 0, 1, 0, 1]
    assert [C._after(x, C.QUOTED) for x in ("", "a", '"', '""', '"""', 'a",', '","', '"a,"')] == [1, 1, 0, 1, 0, 0, 1, 1]


def test_many_files_and_an_empty_one(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f'{k},"x\n{i}"\n' for i in range(5)) if k else "a,b\n")
    got = C.read_csv(spark, str(tmp_path), "a int, b string").collect()
    assert sorted((r.a, r.b) for r in got) == [(k, f"x\n{i}") for k in (1, 2) for i in range(5)]


def test_quarantine_names_file_and_reason(spark, tmp_path):
    files = {
        "metrics": "case,dataset,fault,root_cause_service,time,a_cpu\nc1,d,cpu,a,1,0.5\nc1,d,cpu,a,two,x\nc2,d,cpu,a,3\nc2,d,cpu,a,4,,9\nc2,d,cpu,a,5,\n",
        "logs": 'case,dataset,fault,root_cause_service,timestamp,container_name,message\nc1,d,cpu,a,1,box,"two\nlines"\nc1,d,cpu,a,soon,box,"more\nlines"\n',
        "traces": ",".join(schemas.names(schemas.TRACE_SCHEMA)) + "\n",
        "ground_truth": "case,dataset,fault,root_cause_service,inject_time,time_start,time_end\nc1,d,cpu,a,2,1,3\n",
    }
    paths = {k: str(tmp_path / f"{k}.csv") for k in files}
    for k, text in files.items():
        (tmp_path / f"{k}.csv").write_text(text)
    data = loader.DatasetLoader(spark, loader.DatasetPaths(**paths))
    bad = {(r.case, r.reason, r.record) for r in data.quarantined("metrics").collect()}
    assert bad == {("c1", "time: no bigint; a_cpu: no double", "c1,d,cpu,a,two,x"), ("c2", "not 6 values", "c2,d,cpu,a,3"), ("c2", "not 6 values", "c2,d,cpu,a,4,,9")}
    assert {tuple(r) for r in data.quarantine_counts("metrics").collect()} == {("c1", "time: no bigint; a_cpu: no double", 1), ("c2", "not 6 values", 2)}
    (log,) = data.quarantined("logs").collect()
    assert (log.case, log.reason, log.record) == ("c1", "timestamp: no bigint", 'c1,d,cpu,a,soon,box,"more\nlines"') and log.file.endswith("logs.csv")
    assert data.quarantined("traces").count() == data.quarantined("ground_truth").count() == 0
    assert [r.message for r in data.load_logs().orderBy("timestamp").collect()] == ["more\nlines", "two\nlines"] and data.scan_metrics().count() == 5
