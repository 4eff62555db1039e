"""Headline timings: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS are read."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.catalog import corpus as C
from corpusveil.catalog import queries as K
from corpusveil.operators import graph as G
from corpusveil.operators import literals as L
from corpusveil.operators import rename as W
from corpusveil.operators import reverse as V
from corpusveil.operators import rules as R
from corpusveil.operators import sanitize as S
from corpusveil.plans import extract as X
from corpusveil.session import build_session, materialize

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df) -> None:
    """Compute every column of every row and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def documents(spark):
    return C.table(spark, SF_DIR, "documents").select("doc_id", "text")


def generated_pairs(spark, n: int):
    """n name pairs out of the documents' words: enough literals for the join path."""
    names = (
        documents(spark)
        .select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("w"))
        .groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "w").limit(n)
    )
    words = [r.w for r in names.collect()]
    return C.mapping_set(spark, [("variable", i, w, f"Zq{w}") for i, w in enumerate(words)], "bench")


def main() -> None:
    spark = build_session(
        "corpusveil-bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    ten = C.mapping_set(spark, C.TEXT_MAPPING + [("variable", 10 + i, w, f"Zq{w}") for i, w in enumerate(["tion", "und", "para", "with", "pour"])], "ten")
    few_rules = materialize(R.content_rules(ten), "bench")
    thousand = materialize(generated_pairs(spark, 1000), "bench")
    many_rules = materialize(R.content_rules(thousand), "bench")

    files = C.java_files(spark, SF_DIR)
    code = materialize(files, "bench")
    modules = materialize(G.module_table(code, v.SPRING), "bench")
    edges = materialize(X.edges_of(code, v.SPRING, "com.myco"), "bench")

    text_maps = C.mapping_set(spark, C.TEXT_MAPPING, "text")
    options = S.Options(mask_strings=True)
    clean, dictionary = S.sanitize_corpus(documents(spark), ["doc_id"], "text", text_maps, options, v.SPRING, ["doc_id"])
    clean, dictionary = materialize(clean, "bench"), materialize(dictionary, "bench")

    jobs = {
        "w1a_rename_10_rules": lambda: run(W.rename_text(documents(spark), ["doc_id"], "text", few_rules)),
        "w1b_rename_1000_rules": lambda: run(W.rename_text(documents(spark), ["doc_id"], "text", many_rules)),
        "l_dictionary_and_mask_pages": lambda: run(K.l3_mask_literals(spark, SF_DIR)),
        "g6_closure_20000_modules": lambda: run(G.trace_closure(C.java_entries(code), edges, modules)),
        "w10_sanitize_documents": lambda: run(
            S.sanitize_corpus(documents(spark), ["doc_id"], "text", text_maps, options, v.SPRING, ["doc_id"])[0]
        ),
        "v1_reverse_documents": lambda: run(V.reverse_text(clean, ["doc_id"], "text", text_maps, dictionary)),
        "l0_segments_pages_and_code": lambda: run(K.l0_segments(spark, SF_DIR)),
        "r5_rank_rules": lambda: run(K.r5_rank_rules(spark, SF_DIR)),
    }
    only = sys.argv[1:]
    jobs = {k: job for k, job in jobs.items() if not only or any(k.startswith(o) for o in only)}
    times = {}
    for name, job in jobs.items():
        seen = []
        for _ in range(RUNS):
            start = time.monotonic()
            job()
            seen.append(time.monotonic() - start)
        times[name] = round(statistics.median(seen), 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
