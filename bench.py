"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

HEADLINE = [
    "find_symbols", "callers", "callers_per_seed", "class_callers", "impact_direct", "impact_transitive", "class_impact", "search_ladder", "search_tokens", "bm25", "bm25_stored", "bm25_stored_top", "search_files_stored", "find_symbols_stored",
    "stats", "overview_modules", "key_classes", "module_deps", "imports_graph", "rule_dead", "rule_large", "rule_circular", "conventions", "diagnostics_sorted",
    "change_detect", "snapshot_added", "snapshot_modified", "calls_broken", "hot_files", "feature_history", "parse_python",
]


def build_tree(spark: SparkSession, files: int = 163) -> float:
    """Seconds to scan, parse, link and store a tree of so many generated files, with its text index, rules and snapshot."""
    from spindrift.operators.project import Project

    root, store = Path(tempfile.mkdtemp(prefix="tree-")), tempfile.mkdtemp(prefix="store-")
    for k in range(files):
        body = "".join(f"    def step_{i}(self, x):\n        \"\"\"Step {i} of part {k}.\"\"\"\n        if x > {i}:\n            return self.step_{(i + 1) % 12}(x - 1)\n        return helper_{(k + i) % files}(x)\n\n" for i in range(12))
        (root / f"part_{k}.py").write_text(f"import os\nfrom part_{(k + 1) % files} import helper_{(k + 1) % files}\n\n\nclass Part{k}:\n{body}\ndef helper_{k}(x):\n    return Part{k}().step_0(x)\n")
    began = time.perf_counter()
    Project(spark, str(root), f"file://{store}").rebuild()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from spindrift.plans.queries import QUERIES
    from spindrift.ship import ship

    ship(spark)

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    once(HEADLINE[1])  # starts the session's threads and compiles what all queries share
    times = {name: round(min(once(name), once(name)), 3) for name in HEADLINE}
    times["index_build_163_files"] = round(build_tree(spark), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
