"""Scaling check: the core weather operators on events ×1 and ×N (N shifted copies of the table).

Usage: python tools/scale_check.py <scratch_dir> [copies]
Writes <scratch_dir>/x<N>/events.parquet once (ids offset, time shifted 30 days per copy, so the
repeat structure is the same) and prints one JSON line of wall times per operator and size.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    scratch, n = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 50
    from pyspark.sql import functions as F
    from wattframe.operators import profile, resolve, reshape, sampling
    from wattframe.operators.joins import semi_join
    from wattframe.plans import standins as S
    from wattframe.session import get_session
    spark = get_session("local[8]", 64, extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    src = "/root/testdata/sf0.1"
    big = os.path.join(scratch, f"x{n}-files32")
    if not os.path.exists(os.path.join(big, "events.parquet")):
        ev = spark.read.parquet(f"{src}/events.parquet")
        n_ids = ev.select(F.max("event_id") + 1).first()[0]
        # N copies without a join: explode a literal sequence of copy numbers
        out = (ev.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
               .select((F.col("event_id") + F.col("k") * n_ids).alias("event_id"),
                       (F.col("ts") + F.make_interval(days=F.col("k").cast("int") * 30)).alias("ts"),
                       "user_id", "event_type", "value", "props"))
        # many files, as a real landing zone has: one file would make every scan a single task
        out.repartition(32).write.mode("errorifexists").parquet(os.path.join(big, "events.parquet"))
    E = S.EVENT_ENTITIES
    jobs = {
        "duplicate_matrix": lambda ev: profile.duplicate_matrix(ev, "hour", "entity", E),
        "quality_checks": lambda ev: profile.quality_checks(ev.select("event_id", "hour", "entity", "value", "user_id"),
                                                            "hour", "entity", E),
        "select_predicted": lambda ev: resolve.select_predicted(
            semi_join(ev, profile.duplicate_counts(ev, "slot", "entity"), ["slot", "entity"]),
            "slot", "cls", "cls_id", "pred_cls", S.BAND_MIN_ID, "event_id", entity="entity"),
        "merge_resolved": lambda ev: resolve.merge_resolved(ev.select("event_id", "slot", "entity", "cls", "value"),
                                                            ev.filter("event_id % 97 = 0").select("event_id", "slot", "entity", "cls", "value"),
                                                            "slot", "entity"),
        "balanced_sample": lambda ev: sampling.balanced_sample(ev.select("event_id", "entity", "cls"), "cls", 150,
                                                               ["event_id"], by=["entity"]),
        "to_wide": lambda ev: reshape.to_wide(ev.select("slot", "entity", "value"), "slot", "entity", E, ["value"]),
    }
    res = {}
    for label, d in (("x1", src), (f"x{n}", big)):
        ev = S.events_long(spark, d)
        rows = ev.count()
        res[label] = {"rows": rows}
        for name, fn in jobs.items():
            t0 = time.time()
            fn(ev).write.format("noop").mode("overwrite").save()
            res[label][name] = round(time.time() - t0, 2)
    print(json.dumps(res))


if __name__ == "__main__":
    main()
