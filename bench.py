"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from certflume.session import local_session
from certflume.plans import catalogue

QUERIES = ("host_from", "detect_findings", "best_per_certificate", "many_patterns", "drop_copies", "record_alerts", "alert_state",
           "insights_hour", "search", "plan_tiles")


def timed(df) -> float:
    begin = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def decoding(spark, folder: str, times: dict[str, float]) -> None:
    """Reading certificates from bytes; making the bytes, which costs more, is not timed."""
    from certflume.operators.certificates import parse_certificates
    from certflume.plans.certificate_queries import built
    from certflume.session import landed

    given = landed(built(spark, folder).select("index", "der").repartition(32), "bench-certificates")
    times["decode_certificates"] = timed(parse_certificates(given))


def long_words(spark, folder: str, times: dict[str, float]) -> None:
    """Detection with 500 brands of twenty long words each."""
    import random

    from certflume.operators.detect import detect
    from certflume.operators.watchlist import compile_watchlist, watchlist_frame
    from certflume.plans.views import names

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(("th", "er", "on", "an", "in", "ed", "st", "io", "ou")) for _ in range(rnd.randint(4, 12)))
    items = [{"id": f"b{i}", "kind": "brand", "name": "Brand", "keywords": [word() for _ in range(20)]} for i in range(500)]
    times["detect_500_brands"] = timed(detect(names(spark, folder), compile_watchlist(watchlist_frame(spark, items))))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    catalogue.load()
    # Start the JVM's and the Python workers' machinery before the clock runs.
    spark.range(1000).mapInArrow(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in QUERIES:
        begin = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    long_words(spark, folder, times)
    decoding(spark, folder, times)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
