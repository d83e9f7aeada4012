"""Skew check: one (hour, entity) key holds a third of all rows.

Runs the duplicate matrix, the selector, the merge, the balanced sample and the wide pivot on such a
table with Spark's event log in a fresh scratch folder, then reports per stage the largest and the
median task shuffle-read, so a hot key landing whole on one task shows up as a max ≫ median.

Usage: python tools/skew_check.py [rows]   (synthetic input: this is a plan check, not a query)
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    logdir = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp")
    from pyspark.sql import functions as F
    from wattframe.operators import profile, resolve, reshape, sampling
    from wattframe.session import get_session
    spark = get_session("local[8]", 32, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir, "spark.eventLog.compress": "false",
                                               "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    ents = ["a", "b", "c", "d", "e"]
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select(
        F.col("id").alias("rid"),
        F.when(hot, F.lit(0)).otherwise(F.col("id") % 20011).alias("hour"),
        F.when(hot, F.lit("a")).otherwise(F.element_at(F.array(*[F.lit(e) for e in ents]),
                                                        (F.col("id") % 5 + 1).cast("int"))).alias("city"),
        (F.col("id") * 7919 % 1000 / 10.0).alias("v"))
    df = df.withColumns({"cls": F.when(F.col("v") < 30, "low").when(F.col("v") < 70, "mid").otherwise("high"),
                         "wid": F.floor("v").cast("double"),
                         "pred": F.when(F.col("rid") % 4 == 0, "low").when(F.col("rid") % 4 == 1, "mid")
                         .when(F.col("rid") % 4 == 2, "high").otherwise("none")})
    idmap = {"low": 0, "mid": 30, "high": 70}
    jobs = {
        "duplicate_matrix": lambda: profile.duplicate_matrix(df, "hour", "city", ents),
        "select_predicted": lambda: resolve.select_predicted(df, "hour", "cls", "wid", "pred", idmap, "rid", entity="city"),
        "merge_resolved": lambda: resolve.merge_resolved(df, df.filter("rid % 1000 = 0"), "hour", "city"),
        "balanced_sample": lambda: sampling.balanced_sample(df, "cls", 150, ["rid"], by=["city"]),
        "to_wide": lambda: reshape.to_wide(df.select("hour", "city", "v"), "hour", "city", ents, ["v"]),
    }
    marks = {}
    for name, fn in jobs.items():
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.time()
        fn().write.format("noop").mode("overwrite").save()
        marks[name] = round(time.time() - t0, 2)
    spark.stop()
    log = glob.glob(os.path.join(logdir, "*"))[0]
    files = sorted(glob.glob(os.path.join(log, "events_*"))) if os.path.isdir(log) else [log]
    stage_job, tasks = {}, {}
    lines = (line for f in files for line in open(f))
    if True:
        for line in lines:
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                grp = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = grp
            elif kind == "SparkListenerTaskEnd":
                m = ev.get("Task Metrics") or {}
                sr = m.get("Shuffle Read Metrics") or {}
                read = sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
                tasks.setdefault(ev["Stage ID"], []).append((read, m.get("Executor Run Time", 0)))
    report = {}
    for sid, ts in sorted(tasks.items()):
        reads = [r for r, _ in ts]
        if sum(reads) == 0:
            continue
        grp = stage_job.get(sid)
        report.setdefault(grp, []).append({"stage": sid, "tasks": len(ts), "max_read_kb": round(max(reads) / 1024, 1),
                                           "median_read_kb": round(statistics.median(reads) / 1024, 1),
                                           "max_ms": max(t for _, t in ts)})
    print(json.dumps({"rows": n, "hot_key_share": "1/3", "seconds": marks, "shuffle_read_by_stage": report}, indent=1))


if __name__ == "__main__":
    main()
