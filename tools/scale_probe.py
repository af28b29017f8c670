"""Scaling probe: replicate sf0.1 inputs k times inside Spark (every key / prompt group
grows k-fold, i.e. the hot-group case) and time dedup, pairs and the exact split.

usage: python tools/scale_probe.py [k ...]
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from prefloom.operators.pairs import build_pairs  # noqa: E402
from prefloom.operators.prep import deduplicate  # noqa: E402
from prefloom.operators.split import train_val_split  # noqa: E402
from prefloom.plans import fixtures as FX  # noqa: E402
from prefloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.1"


def rep(df, k):
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def timed(df):
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 2)


def main():
    ks = [int(a) for a in sys.argv[1:]] or [1, 4, 16]
    spark = local_session()
    out = {}
    for k in ks:
        docs = rep(FX.documents(spark, SF), k).withColumn("ord", F.col("ord") * k + F.col("_copy"))
        sc = rep(FX.scored(spark, SF), k).withColumn("cand_idx", F.col("cand_idx") * k + F.col("_copy"))
        out[k] = {
            "rows_docs": 10000 * k,
            "dedup": timed(deduplicate(docs, key="text")),              # k copies of every key
            "build_pairs": timed(build_pairs(sc, 2.0)),                  # every prompt group k times larger
            "build_pairs_narrow": timed(build_pairs(sc, 2.0, strategy="narrow")),
            "split_exact": timed(train_val_split(docs.select("ord", "doc_id"), 0.1, 42, "ord")),
        }
        print(json.dumps({k: out[k]}), flush=True)


if __name__ == "__main__":
    main()
