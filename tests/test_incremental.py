from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeseek.operators.incremental import Manifest, replay_runs

RUN = "run_id long, collection string, run_no int, status string, note string"
SCAN = "scan_id long, run_id long, collection string, rel_path string, mtime double, size_bytes long, content_hash string, recorded_at timestamp, step int, island int"
T0 = datetime(2025, 1, 1)


def scan(i, run, path, digest, late=0):
    return (i, run, "c", path, 0.0, 1, digest, T0 + timedelta(days=run + late), 7, 8)


def brute(runs, scans):
    """The rules, one run after the other."""
    out, known = set(), {}
    for run_id, collection, _, status, _ in sorted(set(runs), key=lambda r: (r[1], r[2])):
        if status != "ok":
            continue
        held = {}
        for s in sorted(set(scans), key=lambda s: (s[7], s[0])):
            if s[1] == run_id and s[3] is not None:
                held[s[3]] = s[6]
        before = known.get(collection, {})
        out |= {(run_id, p) for p, h in held.items() if h is not None and before.get(p) != h}
        known[collection] = {p: h or before[p] for p, h in held.items() if h or p in before}
    return out


def test_replay_matches_brute_force(spark):
    runs = [(n, "c", n, "ok" if n != 3 else "failed", None) for n in range(1, 7)] + [(1, "c", 1, "ok", None)]
    scans, i = [], 0
    for run in range(1, 7):
        for p in range(8):
            i += 1
            if (run * p) % 5 != 3:
                digest = None if (run + p) % 7 == 0 else f"h{p}-{(run * (p % 3)) // 2}"
                scans.append(scan(i, run, f"p{p}", digest))
    scans += [scans[0], scan(900, 2, "p1", "late", late=30), scan(901, 99, "x", "h"), scan(902, 1, None, "h")]
    got = replay_runs(spark.createDataFrame(runs, RUN), spark.createDataFrame(scans, SCAN))
    assert {(r.run_id, r.rel_path) for r in got.collect()} == brute(runs, scans)
    assert got.count() == len(brute(runs, scans))


def test_replay_of_empty_tables(spark):
    assert replay_runs(spark.createDataFrame([], RUN), spark.createDataFrame([], SCAN)).count() == 0


def listing(spark, rows):
    return spark.createDataFrame([("c", p, 1, h) for p, h in rows], "collection string, rel_path string, size_bytes long, content_hash string")


def test_manifest_survives_failure_and_repeats_nothing(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.run("b1", listing(spark, [("a", "1"), ("b", "1"), ("n", None)]), lambda df: df)
    assert not m.run("b1", listing(spark, [("z", "9")]), lambda df: df)
    two = listing(spark, [("a", "1"), ("b", "2"), ("c", "1")])

    def fails(df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/m/batches/batch_id=b2")
        raise OSError("lost")
    with pytest.raises(OSError):
        m.run("b2", two, fails)
    assert {r.rel_path for r in m.pending(two).collect()} == {"b", "c"}
    assert m.run("b2", two, lambda df: df)
    done = m.output().groupBy("rel_path", "content_hash").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.rel_path, r.content_hash, r.n) for r in done} == {("a", "1", 1), ("b", "1", 1), ("b", "2", 1), ("c", "1", 1)}
    assert m.pending(two).count() == 0
