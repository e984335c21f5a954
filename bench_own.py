"""The engine's ways against its own other ways, at $BENCH_SF_DIR: medians of 3 runs after one, in seconds, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CHECKS = 10

TREE = """WITH RECURSIVE g(u, f, depth) AS (
  SELECT subject_id, resource_id, 0 FROM tuples WHERE resource_type = 'docs/folder' AND relation = 'owner' AND CAST(subject_id AS BIGINT) % 10 = 0
  UNION ALL SELECT u, resource_id, depth + 1 FROM g JOIN tuples ON resource_type = 'docs/folder' AND relation = 'parent' AND subject_id = f WHERE depth < 8)
SELECT DISTINCT u, f FROM g"""


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.cteRecursionRowLimit", "-1").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from grantlake.catalog.world import World

    w = World(spark, SF_DIR)
    w.store.df.createOrReplaceTempView("tuples")
    documents = w.table("documents").select(F.lit("docs/document").alias("resource_type"), F.col("doc_id").cast("string").alias("resource_id")).where("doc_id < 10")
    some = documents.withColumns({"subject_type": F.lit("auth/user"), "subject_id": F.lit("7"), "subject_relation": F.lit(""), "action": F.lit("read")})
    save = lambda df: df.write.format("noop").mode("overwrite").save()
    owned = w.engine()._copy(schema=w.schema)
    ways = {
        f"{CHECKS} checks in bulk": lambda: save(w.engine().bulk_check(some)),
        f"{CHECKS} checks one at a time": lambda: [w.engine().check("auth/user:7", "read", f"docs/document:{i}") for i in range(CHECKS)],
        "folders of a tenth of the users": lambda: save(owned.accessible(w.users(10), "read", "docs/folder")),
        "folders of all users": lambda: save(owned.accessible(w.users(1), "read", "docs/folder")),
        "folder tree by recursive query": lambda: save(spark.sql(TREE)),
        "folder tree by fixpoint": lambda: save(w.engine().accessible(w.users(10), "read", "docs/folder")),
        "one user, four reads, kept": lambda: (lambda e: [save(e.accessible(["auth/user:7"], a, "docs/document")) for a in ("read", "write", "either", "read")])(w.engine()),
        "one user, four reads, each anew": lambda: [save(w.engine().accessible(["auth/user:7"], a, "docs/document")) for a in ("read", "write", "either", "read")],
    }
    out = {}
    for name, run in ways.items():
        times = []
        for _ in range(4):
            began = time.time()
            run()
            times.append(time.time() - began)
        out[name] = round(statistics.median(times[1:]), 2)
    print(json.dumps({"metric": "own_ways", "unit": "sec", "ways": out, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
