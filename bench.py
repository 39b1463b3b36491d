"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "B01_minute_bars", "B05_five_minute_bars", "N09_trade_identity", "C04_stitched_series", "P05_parity_summary",
    "F07_feature_bundle", "F09_ema", "F12_leg_strength", "T04_pivots_v1", "T07_pivot_objects", "T08_pivot_events", "T11_legs",
    "T12_major_lower_highs", "T16_leg_events", "T21_structure_chain", "L01_states_as_of_bar", "L08_live_counts_per_bar",
    "O01_structure_overlays", "W03_structures_in_window", "W09_playback_steps", "W10_chart_window", "X03_live_pivot_events",
)


def chart_reads(spark, sf_dir: str) -> dict[str, float]:
    """The chart window over stored datasets, read parts and replay parts apart; storing them is not timed."""
    import uuid

    from barloom.operators.windows import WindowSpec
    from barloom.plans import chart, jobs
    from barloom.session import shared_folder
    from barloom.workbench import feed
    from barloom.workbench.queries import CENTER_BAR

    root = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    jobs.structure_job(feed.dense_bars(spark, sf_dir), root, "bench")
    minute = spark.read.parquet(f"{root}/bars/data").drop("year", "bar_index")
    window = WindowSpec(center_bar_id=CENTER_BAR, left_bars=60, right_bars=60, buffer_bars=5)
    took = {}
    for name, request, parts in (
        ("W10_stored_read", chart.ChartRequest(window), ("bars", "structures", "events", "overlays")),
        ("W10_stored_replay", chart.ChartRequest(window, include_replay=True), ("replay_base", "replay_deltas", "playback")),
    ):
        start = time.perf_counter()
        answer = chart.stored_chart_window(spark, root, minute, "1m", request, "bench", ["click"])
        for part in parts:
            answer[part].write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    return took


def main() -> None:
    from barloom.session import local_session
    from barloom.workbench.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # JVM warm-up
    took: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    if "BENCH_QUERIES" not in os.environ:
        took |= chart_reads(spark, sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
