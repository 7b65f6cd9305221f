import csv
import io
import json
import math
import random
from pathlib import Path

import duckdb
import pytest
from golden import A, B, FIELDS, RESULTS_A, RESULTS_B, record, text_a, text_b
from pyspark.sql import functions as F

from matchlens import cli
from matchlens import operators as O
from matchlens import queries as core
from matchlens import schema as S
from matchlens.functions import labels
from matchlens.functions.text import decode, shown, strip, to_double, to_integer
from matchlens.plans import append_checkpoint, process, report
from matchlens.plans.ledger import find_verdict, ledger_frames, load
from matchlens.plans.report import console_summary, write_report
from matchlens.sources import ingest, list_inputs, read_blocks, shared
from matchlens.streaming import latest_snapshots, read_lines

GOOD = dict(zip(FIELDS, "DOW EQUITY_INDEX T42-H20 B_BAND_T01-05 8 .5 .2 .3 60 50 .8 .5 .3 -.4 -.5 .1".split(), strict=True))


def block(**changes):
    f = {k: v for k, v in (GOOD | changes).items() if v is not None}
    return "T44C" + "".join(f"|{k}={v}" for k, v in f.items())


def blocks(spark, texts):
    return spark.createDataFrame([(i, "t", x) for i, x in enumerate(texts)], S.BLOCKS)


def settled(spark, texts, **kw):
    return [r.asDict() for r in process(blocks(spark, texts), **kw).orderBy("record_index").collect()]


def test_numbers_and_text(spark):
    rows = ["5", "+1_000", "8.0", "8.5", "1e3", "inf", "nan", "x", "1d", "", "9" * 25, "-3", ".0", "5.", "1.5f", "-nan", "1e400"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string").select("i", to_integer(F.col("v")).alias("n"), to_double(F.col("v")).alias("d")).orderBy("i").collect()
    assert [r["n"] for r in got] == [5, 1000, 8, None, 1000, None, None, None, None, None, None, -3, 0, 5, None, None, None]
    for x, r in zip(rows, got, strict=True):
        try:
            want = float(x)
        except ValueError:
            want = None
        assert r["d"] == want or (want is not None and math.isnan(want) and math.isnan(r["d"])), x
    values = [150.0, -0.001, 1e-5, 123456789.25, 1e16, 1.5e300, 0.1, 1e7, float("inf"), -2.5e-7, 0.0, 1234567.0]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", shown(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [repr(v) for v in values]
    raw = [b"a\xff\xfeb", "é ".encode(), b"\xe2\x82"]
    got = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, b binary").select("i", decode(F.col("b")).alias("t"), strip(F.lit(" \x1c x  \n")).alias("s")).orderBy("i").collect()
    assert [r["t"] for r in got] == [x.decode("utf-8", "replace") for x in raw] and got[0]["s"] == "x"


def test_parse(spark):
    texts = [
        block(), block(ERET="na", PAIR="8.0"), block(SYM=None), block(CELL="B_BAND_XX"), block(DRET="abc"), block(PAIR="abc"), block(PAIR="-3"), block(CELL="S_DIV_T21-25"),
        block() + "\nnoise | not=a|field=either\n", block() + "|SYM=LAST", "T44C|SYM=\nfoo|CLASS=|cohort = c ", "T44C", block(PAIR="inf"),
    ]
    r = [x.asDict() for x in O.parse_records(blocks(spark, texts)).orderBy("record_index").collect()]
    assert r[0]["parse_ok"] and r[0]["pair"] == 8 and r[0]["side"] == "BUY" and r[0]["age_bucket"] == "T01-05" and r[0]["emae"] == -0.4
    assert r[1]["eret"] is None and r[1]["parse_ok"] and r[1]["field_present"]["ERET"] and r[1]["pair"] == 8
    assert r[2]["parse_errors"] == ["missing required field SYM"] and r[2]["warnings"] == r[2]["parse_errors"]
    assert r[3]["parse_errors"] == ["CELL 'B_BAND_XX' does not match an expected pattern (e.g. B_BAND_T01-05)"] and r[3]["cell"] == "B_BAND_XX"
    assert r[4]["parse_errors"] == ["DRET is not numeric or NA: 'abc'"] and r[5]["parse_errors"] == ["PAIR is not a valid integer: 'abc'"]
    assert r[6]["parse_errors"] == ["PAIR is negative: -3"] and r[6]["pair"] is None
    assert r[7]["parse_ok"] and r[7]["side"] == "SELL" and r[7]["age_bucket"] == "T21-25"
    assert r[8]["parse_ok"] and r[9]["sym"] == "LAST"
    assert r[10]["sym"] == "foo" and r[10]["cohort"] == "c" and r[10]["parse_errors"][0] == "missing required field CLASS"
    assert [e.split()[-1] for e in r[11]["parse_errors"]] == ["SYM", "CLASS", "COHORT", "CELL", "PAIR"]
    assert not r[12]["parse_ok"]


def test_dedupe_validate_derive(spark):
    texts = [
        block(PAIR="5"), block(PAIR="8"), block(SYM="A"), block(SYM="A"), block(SYM="B"), block(SYM="B", DRET=".31"), block(SYM="B", DRET="NA"),
        block(SYM="C", PAIR="9", EHIT="150"), block(SYM="C", PAIR="3"), block(SYM="D", ERET=None), block(SYM="E", PAIR="0", ERET=None), block(SYM="F", DRET="nan"), block(SYM="F", DRET="7"), "T44C|SYM=Z",
        block(SYM="G", DRET="0.30000000001"), block(SYM="H", DRET="0.25"),
    ]
    r = settled(spark, texts)
    assert r[0]["is_duplicate_dropped"] and not r[0]["retained"] and r[1]["retained"]
    assert r[0]["warnings"] == ["snapshot duplicate: PAIR=5 superseded by a later/larger snapshot with PAIR=8 for the same COHORT/SYM/CLASS/CELL"]
    assert r[2]["is_duplicate_dropped"] and not r[2]["warnings"] and r[3]["retained"] and not r[3]["is_snapshot_conflict"]
    assert all(x["is_snapshot_conflict"] for x in r[4:7]) and r[6]["retained"] and not r[5]["retained"]
    assert r[6]["warnings"] == ["snapshot conflict: 3 records share PAIR=8 for the same COHORT/SYM/CLASS/CELL with differing metrics; retained the last encountered (record_index=6)"]
    # An invalid largest snapshot wins and then takes its cell along.
    assert r[7]["retained"] and not r[7]["valid"] and not r[8]["retained"] and "EHIT=150.0 outside expected range [0,100]" in r[7]["warnings"]
    assert not r[9]["valid"] and r[9]["warnings"] == ["ERET missing for a PAIR>0 record"] and r[10]["valid"]
    # NaN equals any number between snapshots, has sign 0 and reconciles with nothing.
    assert not r[11]["is_snapshot_conflict"] and r[11]["dret_sign"] == 0 and r[11]["ret_delta_ok"] is False
    assert not r[13]["retained"] and not r[13]["valid"] and r[13]["delta_hit"] is None
    assert r[14]["ret_delta_ok"] and r[14]["dret_sign"] == 1 and r[14]["delta_hit"] == 10
    assert r[15]["ret_delta_ok"] is False and r[15]["valid"] and r[15]["warnings"][0].startswith("DRET does not reconcile with event-control within tolerance (0.001)")
    assert settled(spark, [block(DRET="0.3")], epsilon=0.5)[0]["dret_sign"] == 0


def check_groups(levels, results):
    for group, (pairs, markets, dret, hit, label) in results.items():
        r = levels[group]
        assert (r["PAIR_TOTAL"], r["N_MARKETS"], r["CLASSIFICATION"]) == (pairs, markets, label), group
        assert r["PAIR_WEIGHTED_DRET"] == pytest.approx(dret, abs=1e-6) and r["PAIR_WEIGHTED_DELTA_HIT"] == pytest.approx(hit, abs=1e-6)


def test_golden_levels(spark):
    for lines, results, discovered in ((A, RESULTS_A, 12), (B, RESULTS_B, 18)):
        records = process(blocks(spark, [record(x) for x in lines]))
        df = O.eligible(records).persist()
        found = {r["GROUP"]: r for r in O.summarize_all(df).collect()}
        check_groups(found, results)
        assert sum(r["GROUP_LEVEL"] == "CELL" for r in found.values()) == 16
        facts = O.integrity(records).first()
        assert facts["records_discovered"] == discovered
        if lines is A:
            assert (facts["records_retained"], facts["records_invalid"], facts["snapshot_duplicates"], facts["snapshot_conflicts"], len(facts["markets"]), len(facts["asset_classes"])) == (9, 1, 2, 2, 7, 5)
            assert found["EURUSD"]["MARKETS"] == 0 and found["EURUSD"]["MATURITY"] == "EMBRYONIC"
            dret, pair = O.market_cell_matrices(df)
            got = {r["MARKET"]: r for r in pair.collect()}
            assert got["EURUSD"]["B_BAND_T06-10"] == 0 and got["XAUUSD"]["S_BAND_T01-05"] == 9 and len(got) == 7
            assert {r["MARKET"]: r for r in dret.collect()}["EURUSD"]["B_BAND_T06-10"] is None
            own = O.summarize(df, "MARKET").collect()
            assert [r["SYM"] for r in own] == sorted(r["SYM"] for r in own) and tuple(own[0].__fields__) == (*S.SUMMARY_COLUMNS, "SYM", "ASSET_CLASS")
            assert {r["asset_class"]: r["sign"] for r in O.class_direction(df).collect()} == {"CRYPTO": 1, "ENERGY": -1, "EQUITY_INDEX": 1, "FX": 0, "METAL": -1}
        df.unpersist()
    empty = {r["GROUP"]: r for r in O.summarize_all(O.eligible(process(blocks(spark, [])))).collect()}
    assert empty[S.NO_COHORT]["PAIR_TOTAL"] == 0 and len(empty) == 25


def test_labels(spark):
    rows = [(4, 9, 1.0, 1.0, 0), (5, 1, 1.0, 1.0, 0), (20, 5, 1.0, 0.6, 0), (20, 5, -1.0, 0.0, 3), (19, 5, 1.0, 0.6, 0), (19, 5, 1.0, 0.61, 0), (50, 4, -1.0, 0.0, 3), (50, 9, None, None, 0)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p long, m long, w double, s double, n long").orderBy("i")
    got = got.select(labels.classification(F.col("p"), F.col("m"), F.col("w"), F.col("s"), F.col("n")).alias("c"), labels.maturity(F.col("p")).alias("mat"), labels.breadth(F.col("m")).alias("b")).collect()
    assert [r["c"] for r in got] == ["INSUFFICIENT", "INSUFFICIENT", "CROSS_MARKET_POS", "CROSS_MARKET_NEG", "EARLY_MIXED", "EARLY_CONSISTENT_POS", "EARLY_CONSISTENT_NEG", "EARLY_MIXED"]
    assert [got[i]["mat"] for i in (0, 1, 2, 4)] == ["EMBRYONIC", "EARLY", "MATURE", "DEVELOPING"] and [got[i]["b"] for i in (1, 6, 2)] == ["SINGLE_MARKET", "MULTI_MARKET", "BROAD"]
    verdicts = spark.createDataFrame([(k,) for k in [*S.VERDICTS, "?"]], "k string").select(labels.verdict(F.col("k")).alias("v")).collect()
    assert [r["v"] for r in verdicts] == [*S.VERDICTS.values(), "MIXED"]


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x T44C|SYM=1\r\nT44C|SYM=2")
    (tmp_path / ".h.log").write_text("T44C|SYM=3 T44C")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "skip.md").write_text("T44C")
    (tmp_path / "sub").mkdir()
    files = list_inputs([str(tmp_path)])
    assert [x.rsplit("/", 1)[1] for x in files] == [".h.log", "b.txt", "c.csv"]
    got = read_blocks(spark, [str(tmp_path), "-", str(tmp_path / "b.txt")], b"T44C|SYM=4\xff").orderBy("record_index").collect()
    assert [(r["record_index"], r["block"].strip()) for r in got] == [(0, "T44C|SYM=3"), (1, "T44C"), (2, "T44C|SYM=1"), (3, "T44C|SYM=2"), (4, "T44C|SYM=4�"), (5, "T44C|SYM=1"), (6, "T44C|SYM=2")]
    with pytest.raises(FileNotFoundError):
        list_inputs([str(tmp_path / "none")])


def test_report_and_ledger(spark, tmp_path):
    (tmp_path / "a.txt").write_text(text_a())
    (tmp_path / "b.txt").write_text(text_b())
    said: list[str] = []
    out = write_report(spark, [str(tmp_path / "a.txt")], tmp_path / "ra", say=said.append)
    assert out["verdict"] == "DESCRIPTIVE_POSITIVE" and out["pooled"]["MARKET_CONCENTRATED"] is False
    assert [x.split(" (")[0] for x in said] == ["WARNING: SNAPSHOT_CONFLICT"] * 2 + ["WARNING: malformed record"]
    names = sorted(x.name for x in (tmp_path / "ra").iterdir())
    assert len(names) == 11 and names[0] == "01_records.csv" and names[-1] == "11_manifest.json"
    whole = "".join((tmp_path / "ra" / n).read_text() for n in names) + console_summary(out, tmp_path)
    for word in ("VALIDATED", "PROVEN", "SIGNIFICANT", "TRADEABLE"):
        assert word not in whole.upper().replace("INSIGNIFICANT", "")
    head = (tmp_path / "ra" / "03_cell_summary.csv").read_text().split("\n")
    assert head[0].split(",") == [*S.SUMMARY_COLUMNS, *S.LEVEL_COLUMNS["CELL"]] and len(head) == 18
    assert ",8,True,True," in (tmp_path / "ra" / "02_audit.csv").read_text()
    manifest = json.loads((tmp_path / "ra" / "11_manifest.json").read_text())
    assert manifest["pair_total"] == 71 and manifest["records_discovered"] == 12 and len(next(iter(manifest["input_sha256"].values()))) == 64
    write_report(spark, [str(tmp_path / "b.txt")], tmp_path / "rb", say=said.append)
    store = tmp_path / "store"
    assert append_checkpoint(tmp_path / "ra", store, " 01 ") == {"status": "APPENDED", "checkpoint": "01", "count": 1}
    assert append_checkpoint(tmp_path / "ra", store, "01")["status"] == "UNCHANGED"
    before = {x.name: x.read_bytes() for x in store.iterdir()}
    with pytest.raises(ValueError, match="append-only"):
        append_checkpoint(tmp_path / "rb", store, "01")
    assert {x.name: x.read_bytes() for x in store.iterdir()} == before
    assert append_checkpoint(tmp_path / "rb", store, "NA")["count"] == 2
    rows = load(store / "01_checkpoints.csv", S.CHECKPOINTS)
    assert [r["checkpoint"] for r in rows] == ["01", "NA"] and rows[1]["dret"] == pytest.approx(-0.2071416667) and (rows[1]["pair_total"], rows[1]["markets"], rows[1]["asset_classes"], rows[0]["asset_classes"]) == (12, 6, 4, 5)
    assert rows[1]["research_verdict"] == "MIXED" and rows[0]["research_verdict"] == "DESCRIPTIVE_POSITIVE"
    checkpoints, groups = ledger_frames(spark, store)
    assert checkpoints.count() == 2 and groups.count() == 16
    assert "Latest checkpoint: **NA**" in (store / "03_history.md").read_text() and "| BUY |" not in (store / "03_history.md").read_text()
    (tmp_path / "rb" / "10_report.md").unlink()
    for path, label in ((tmp_path / "rb", "x"), (tmp_path / "ra", "  ")):
        with pytest.raises(ValueError):
            append_checkpoint(path, store, label)
    assert find_verdict("no heading") == "UNKNOWN"


def test_streaming_keeps_the_largest(spark, tmp_path):
    q = latest_snapshots(spark.readStream.schema(S.BLOCKS).json(str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("snapshots").option("checkpointLocation", str(tmp_path / "_c")).start()
    try:
        for i, (pair, dret) in enumerate((("5", ".1"), ("9", ".2"), ("7", ".3"))):
            (tmp_path / f"{i}.json").write_text(json.dumps({"record_index": i, "source_file": "s", "block": block(PAIR=pair, DRET=dret)}))
            q.processAllAvailable()
        assert [(r["pair"], r["dret"]) for r in spark.table("snapshots").collect()] == [(9, 0.2)]
    finally:
        q.stop()


def test_large_files_are_split(spark, tmp_path, monkeypatch):
    """Files that many tasks read give the blocks that one task gives, in the same order."""
    monkeypatch.setattr(ingest, "RANGE", 2)
    texts = ["noise before\r\n" + "".join(f"T44C|SYM=a{i}\r\n|PAIR={i}\n" + "x" * (i % 50) for i in range(300)), "T44C|SYM=first \u00e9 T44C", "T44C|SYM=b\r\nT44C|SYM=c", "no marker"]
    for i, t in enumerate(texts):
        (tmp_path / f"f {i}.txt").write_text(t, newline="")
    paths = [str(tmp_path), str(tmp_path / "f 0.txt")]
    want = [tuple(r) for r in read_blocks(spark, paths).orderBy("record_index").collect()]
    assert [r[0] for r in want] == list(range(300 + 2 + 2 + 300)) and want[301][2] == "T44C"
    monkeypatch.setattr(ingest, "LARGE_FILE", 20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert [tuple(r) for r in read_blocks(spark, paths).orderBy("record_index").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_tables_by_executors(spark, tmp_path, monkeypatch):
    """Directories of parts hold the rows of the files that the driver writes."""
    (tmp_path / "a.txt").write_text(text_a() + "\nT44C|SYM=Q\"uote, d|PAIR=x")
    for name in ("small", "large"):
        write_report(spark, [str(tmp_path / "a.txt")], tmp_path / name, say=lambda _: None)
        monkeypatch.setattr(report, "LARGE_ROWS", 1)
    for table in ("01_records.csv", "02_audit.csv"):
        with (tmp_path / "small" / table).open(newline="") as f:
            want = list(csv.reader(f))
        got = []
        for part in sorted((tmp_path / "large" / table).glob("part-*")):
            with part.open(newline="") as f:
                rows = list(csv.reader(f))
            assert not rows or rows[0] == want[0]
            got += rows[1:]
        assert got == want[1:], table


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "b.txt").write_text(text_b())
    out, store = str(tmp_path / "out"), str(tmp_path / "store")
    assert cli.run(["report", str(tmp_path / "b.txt"), "--out", out], spark) == 0
    said = capsys.readouterr().out
    assert "MIXED" in said and "matched pairs" in said and str(tmp_path / "out" / "10_report.md") in said
    assert cli.run(["report", str(tmp_path / "b.txt"), "--out", out, "--quiet", "--sign-epsilon", "0.5"], spark) == 0
    assert "MIXED" not in capsys.readouterr().out
    for status in ("APPENDED", "UNCHANGED"):
        assert cli.run(["ledger", out, "--label", "one", "--store", store]) == 0
        assert capsys.readouterr().out == f"{status}: one (1 checkpoint(s) in history)\n"
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text_b().encode())))
    assert cli.run(["report", "-", "--out", str(tmp_path / "in"), "--quiet"], spark) == 0
    assert json.loads((tmp_path / "in" / "11_manifest.json").read_text())["pair_total"] == 12
    with pytest.raises(SystemExit):
        cli.run(["report"])
    with pytest.raises(FileNotFoundError):
        cli.run(["report", str(tmp_path / "none")], spark)


def test_smaller_snapshots_and_order_change_nothing(spark):
    """Property: earlier, smaller exports of a cell leave every summary as it is, and so does the order of other cells."""
    r = random.Random(3)

    def summary(lines):
        found = O.summarize_all(O.eligible(process(blocks(spark, [record(x) for x in lines])))).drop("_order").collect()
        return sorted(str(x) for x in found)

    want = summary(A)
    smaller = []
    for line in A[:8]:
        f = line.split()
        smaller.append(" ".join([*f[:4], str(max(int(f[4]) - 1, 0)), *f[5:]]) if int(f[4]) > 1 else line)
    assert summary([*smaller, *A]) == want
    # Of one cell the order counts, as the last of equal snapshots stays; cells may change places.
    groups = {}
    for line in A:
        groups.setdefault(tuple(line.split()[:4]), []).append(line)
    shuffled = list(groups.values())
    r.shuffle(shuffled)
    assert summary([x for g in shuffled for x in g]) == want


def test_streamed_files(spark, tmp_path):
    """Records on several lines, several a file; of equal ones the last of the file stays."""
    (tmp_path / "in").mkdir()
    q = latest_snapshots(read_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "_c"))
    (tmp_path / "in" / "0.txt").write_text("noise\n" + block(DRET=".1").replace("|", "\r\n|") + "\n" + block(DRET=".2") + "\n" + block(PAIR="3", DRET=".9"), newline="")
    q = q.start()
    try:
        q.processAllAvailable()
        assert [(r["pair"], r["dret"]) for r in spark.table("streamed").collect()] == [(8, 0.2)]
    finally:
        q.stop()


def test_empty_groups_and_defaults_in_the_ledger(spark, tmp_path):
    (tmp_path / "a.txt").write_text(text_a())
    write_report(spark, [str(tmp_path / "a.txt")], tmp_path / "r", say=lambda _: None)
    at = tmp_path / "r" / "04_side_source_summary.csv"
    lines = at.read_text().split("\n")
    head = lines[0].split(",")
    blank = ",".join("" if c in ("GROUP", "MATURITY", "PAIR_TOTAL") else x for c, x in zip(head, lines[1].split(","), strict=True))
    bare = ",".join("" if c in ("MATURITY", "PAIR_TOTAL", "PAIR_WEIGHTED_DRET") else x for c, x in zip(head, lines[2].split(","), strict=True))
    at.write_text("\n".join([lines[0], blank, bare, *lines[3:]]))
    assert append_checkpoint(tmp_path / "r", tmp_path / "s", "1")["count"] == 1
    rows = load(tmp_path / "s" / "02_source_trend.csv", S.TREND)
    assert len(rows) == len([x for x in lines[1:] if x]) - 1 and (rows[0]["maturity"], rows[0]["pairs"], rows[0]["dret"]) == ("UNKNOWN", 0, None)
    two = (tmp_path / "r" / "07_overall_summary.csv").read_text().rstrip("\n").split("\n")
    (tmp_path / "r" / "07_overall_summary.csv").write_text("\n".join([*two, two[1]]) + "\n")
    with pytest.raises(ValueError, match="exactly one"):
        append_checkpoint(tmp_path / "r", tmp_path / "s", "2")


def test_queries_match_their_sql(spark):
    """Queries that stand for a path of the engine each have rows at the smallest size, and they are those of their SQL."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")

    def plain(v):
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    for name in ("path_scan", "parse_noise_multiline", "parse_identity_errors", "field_presence", "validate_missing", "audit_records", "ledger_append", "content_hash", "all_levels"):
        want, got = con.sql(core.oracle_sql()[name]), core.queries()[name](spark, sf)
        at = sorted(got.columns)
        assert at == sorted(want.columns), name
        rows = sorted([plain(r[want.columns.index(c)]) for c in at] for r in want.fetchall())
        assert rows and rows == sorted([plain(r[c]) for c in at] for r in got.collect()), name


def test_tables_are_cleared(spark):
    path = shared.shared_dir(spark)
    spark.range(3).write.parquet(path)
    assert Path(path.removeprefix("file:")).exists() and shared.clear_tables(spark) > 0 and not Path(path.removeprefix("file:")).exists()


def test_union_of_levels_is_one_small_plan(spark, blocks_dir="/root/testdata/sf0.001"):
    """The union equals the levels' own tables, in their order, without a plan for each of them."""
    from matchlens import queries as Q

    got = Q.queries()["side_source_union"](spark, blocks_dir)
    df = Q.eligible(spark, blocks_dir).persist()
    want = []
    for level in ("SIDE_SOURCE", "SOURCE", "SIDE"):
        for r in O.summarize(df, level).collect():
            r = r.asDict()
            want.append((r["GROUP"], r["PAIR_TOTAL"], r["MARKETS"], r["CLASSIFICATION"], r.get("SIDE"), r.get("SOURCE")))
    df.unpersist()
    assert [tuple(r) for r in got.collect()] == want and len(want) == 8
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") < 10
