"""Skew evidence: one note holds about a third of the event log.

Runs the real-creators aggregate (O11, one partially aggregated groupBy), the
reference's window form (ROW_NUMBER over PARTITION BY note; Spark adds a map-side
group limit for ``rn = 1``) and, for contrast, a plain shuffle by note with no
map-side combine, on the same skewed log with Spark's event log written to a
scratch folder; prints the largest and the median shuffle-read records per
reduce task of each job.

Usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from presswork.operators import ownership as O  # noqa: E402
from presswork.session import configure  # noqa: E402
from presswork.operators import rankings as R  # noqa: E402
from presswork.plans.catalog import QueryParams  # noqa: E402
from presswork.sources.fixtures import derive_tables, editorial_activity  # noqa: E402
from presswork.sources.tables import Tables  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logs = tempfile.mkdtemp(prefix="presswork-eventlog-")
    spark = (
        SparkSession.builder.master("local[8]").appName("presswork-skew")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logs)
        .config("spark.eventLog.compress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.files.maxPartitionBytes", str(256 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    e = editorial_activity(spark, sf_dir)
    hot = F.abs(F.xxhash64("note_id", "event_timestamp")) % 3 == 0
    e = e.withColumn("note_id", F.when(hot, F.lit(-1).cast("bigint")).otherwise(F.col("note_id"))).repartition(16)

    spark.sparkContext.setJobGroup("aggregate", "O11 as one aggregate")
    O.real_creators(e).write.format("noop").mode("overwrite").save()

    spark.sparkContext.setJobGroup("window", "O11 in the window form")
    saves = e.filter("action_type = 'SAVE'")
    w = Window.partitionBy("note_id").orderBy("event_timestamp", "email_editor")
    ranked = saves.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    ranked.write.format("noop").mode("overwrite").save()

    spark.sparkContext.setJobGroup("plain", "shuffle by note without map-side combine")
    e.repartition(16, "note_id").write.format("noop").mode("overwrite").save()

    # hot editor: a third of all actions by one editor, through the top-publishers ranking
    qp = QueryParams()
    spark.sparkContext.setJobGroup("setup", "table derivation")
    t = derive_tables(spark, sf_dir)
    hot_ed = t.editorial.withColumn(
        "email_editor", F.when(F.abs(F.xxhash64("note_id", "event_timestamp")) % 3 == 0, F.lit(qp.author))
        .otherwise(F.col("email_editor"))).repartition(16)
    skewed = Tables(hot_ed, t.traffic_daily, t.traffic_clean, t.traffic_dimensions, t.authors)
    spark.sparkContext.setJobGroup("editor_rank", "top publishers with a hot editor")
    R.top_publishers(skewed, qp.period).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("editor_plain", "shuffle by editor without map-side combine")
    hot_ed.repartition(16, "email_editor").write.format("noop").mode("overwrite").save()
    spark.stop()

    job_group, stage_group, reads = {}, {}, {}
    for path in glob.glob(os.path.join(logs, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    n = m.get("Total Records Read", 0)
                    if n:
                        reads.setdefault(ev["Stage ID"], []).append(n)
    for group in ("aggregate", "window", "plain", "editor_rank", "editor_plain"):
        stages = [s for s, g in stage_group.items() if g == group and s in reads]
        for s in sorted(stages):
            r = reads[s]
            print(f"{group:9s} stage {s}: reduce tasks={len(r)} max records={max(r)} "
                  f"median={statistics.median(r):.0f} total={sum(r)}")


if __name__ == "__main__":
    main()
