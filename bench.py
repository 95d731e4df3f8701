"""Headline queries, timed warm; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Every query computes all its columns (written to Spark's ``noop`` sink); the
time is the best of three runs after one to warm up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from tidegauge import schemas  # noqa: E402
from tidegauge.plans import catalogue, report_queries, reports, state_queries, views  # noqa: E402
from tidegauge.plans.messages import encode_readings  # noqa: E402
from tidegauge.session import build_session, work_dir  # noqa: E402
from tidegauge.streaming import jobs  # noqa: E402

HEADLINES = (
    "e1_rollup_device_minute", "e1_rollup_device_hour", "e1_rollup_device_day",
    "e1_rollup_readings_minute", "e1_rollup_readings_day", "e12_sensor_metrics_minute",
    "b4_canonicalize_json_wide", "a2_avro_ingest", "d4_alert_rows", "f1_hourly_states", "f3_latest_status",
    "g1_single_day_temp", "g1_single_day_temp_parameters", "g2_single_day_humidity", "g3_single_day_cpu",
    "g4_single_day_load", "g5_device_current_status", "g6_host_current_status", "g7_newest_100",
    "g8_device_aggregation_wide", "g9_alert_detection_wide", "g10_customer_sites_wide", "g11_network_totals_wide",
    "g12_prefix_alerts_wide", "g16_temperature_series_wide", "g19_busiest_devices",
    "k1_rollup_reduction_minute", "k4_latency_summary_by_query",
)
RUNS = 3


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = views.events(spark, sf_dir).count()

    seconds: dict[str, float] = {}
    for name in HEADLINES:
        def run() -> None:
            catalogue.QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(min(timed(run) for _ in range(RUNS)), 4)

    def job(spark_rows, start_job, **options):
        def run() -> None:
            target = jobs.Run(work_dir(spark, "bench"), work_dir(spark, "bench-checkpoint"), every=None)
            start_job(spark_rows(), target, mode="deltas", **options).awaitTermination()
        return run

    # The stream from canonical rows, without decoding.
    rows_job = job(lambda: views.to_sensors(views.stream_events(spark, sf_dir)), jobs.start_rollup_stream)

    # The deployed pipeline: binary messages in, in a file per core, mergeable states in a table.
    messages = work_dir(spark, "bench-messages")
    encoded = encode_readings(views.avro_readings(views.sensors(spark, sf_dir)), schemas.AVRO_READING)
    encoded.repartition(cpus).write.parquet(messages)
    shape = spark.read.parquet(messages).schema
    messages_job = job(lambda: spark.readStream.schema(shape).parquet(messages), jobs.start_rollup_job, keep=("seq",))

    for name, run in (("h8_rollup_stream_deltas", rows_job), ("h8_rollup_job_messages", messages_job)):
        run()
        seconds[name] = round(timed(run), 4)

    # Single-day figures for a table of parameters from the hour states that a stream keeps; the table is made beforehand.
    states = state_queries.hour_table(spark, sf_dir, "temp")
    asked = work_dir(spark, "bench-parameters")
    report_queries._parameters(views.sensors(spark, sf_dir), "device_id").write.parquet(asked)

    def from_states() -> None:
        reports.single_day_from_states(states, "temp", spark.read.parquet(asked)).write.format("noop").mode("overwrite").save()

    from_states()
    seconds["g1_single_day_temp_from_states"] = round(min(timed(from_states) for _ in range(RUNS)), 4)

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_warm_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "rows": rows,
        "rollup_rows_per_second": round(rows / seconds["e1_rollup_readings_minute"]),
        "messages_per_second": round(rows / seconds["h8_rollup_job_messages"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
