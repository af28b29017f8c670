"""Shuffle bytes written by the two R1 strategies, read from Spark's event log (written to
a fresh scratch folder; no UI). Inputs: sf0.1 scored candidates replicated k times.

usage: python tools/shuffle_probe.py [k ...]
"""
import glob
import itertools
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from prefloom.operators.pairs import build_pairs  # noqa: E402
from prefloom.plans import fixtures as FX  # noqa: E402


def read_events(log_dir):
    for f in sorted(glob.glob(log_dir + "/events_*")):
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                r = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
                data = b"".join(iter(lambda: r.read(1 << 20), b""))
            else:
                data = fh.read()
        for line in data.decode("utf-8", "replace").splitlines():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def main():
    ks = [int(a) for a in sys.argv[1:]] or [16, 64]
    run = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", run).config("spark.sql.shuffle.partitions", "8").getOrCreate())
    sc = spark.sparkContext
    for k in ks:
        s = FX.scored(spark, "/root/testdata/sf0.1").withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
            .withColumn("cand_idx", F.col("cand_idx") * k + F.col("_c"))
        for strat in ("carry", "narrow"):
            sc.setJobGroup(f"{strat}-{k}", f"{strat}-{k}")
            build_pairs(s, 2.0, strategy=strat).write.format("noop").mode("overwrite").save()
    spark.stop()
    log_dir = sorted(glob.glob(run + "/eventlog_v2_*"))[-1]
    stage_group, written = {}, {}
    for e in itertools.chain(read_events(log_dir)):
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for st in e["Stage IDs"]:
                stage_group[st] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics", {})
            written[e["Stage ID"]] = written.get(e["Stage ID"], 0) + m.get("Shuffle Bytes Written", 0)
    total = {}
    for st, b in written.items():
        if stage_group.get(st):
            total[stage_group[st]] = total.get(stage_group[st], 0) + b
    print(json.dumps({g: round(b / 1e6, 3) for g, b in sorted(total.items())}))


if __name__ == "__main__":
    main()
