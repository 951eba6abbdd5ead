"""Queries of the core's own training-data operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeseek.operators.incremental import replay_runs
from lakeseek.session import read


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return replay_runs(read(spark, d, "index_runs"), read(spark, d, "file_scans")).select("run_id", "rel_path")


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
        with ok as (select run_id, collection, row_number() over (partition by collection order by run_no, run_id) step
                    from (select distinct run_id, collection, run_no from index_runs where status = 'ok')),
        held as (select run_id, rel_path, arg_max(struct_pack(h := content_hash), (recorded_at, scan_id)).h as h
                 from file_scans where rel_path is not null group by run_id, rel_path),
        l as (select o.run_id, o.collection, o.step, h.rel_path, h.h from held h join ok o using (run_id)),
        i as (select *, step - row_number() over (partition by collection, rel_path order by step) island from l),
        k as (select *, last_value(h ignore nulls) over (partition by collection, rel_path, island order by step
                        rows between unbounded preceding and 1 preceding) known from i)
        select run_id, rel_path from k where h is not null and h is distinct from known""",
}
