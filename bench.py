"""Headline timings: prints ONE JSON line.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]:
  build_index      encode the catalogue in both spaces + BM25 statistics (written tables)
  compress_index   train and store the IVF-PQ index of the catalogue (64 lists, 64 x 256 codes)
  recommend        the whole query table through the funnel to five cards each, exact retrieval
  recommend_ivfpq  the same, retrieving from the compressed index
  knn_exact        every stored vector against all others, top 10
  ivf_search       same queries, 3 of 10 lists probed
  ivfpq_build      16 lists, 32 x 256 codes trained on all stored vectors (written tables)
  pq_search        IVF-PQ look-up-table scoring, 6 of 16 lists, top 10
  recall_at_10     exact vs IVF-PQ overlap
  bm25_search      top 20 descriptions of every search by BM25 over the catalogue
Each timing forces the full result (``write`` to the noop sink, so nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tomescope.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="tomescope-bench")
    from tomescope.config import DEFAULT
    from tomescope.operators import ann, rank
    from tomescope.operators.knn import knn_join
    from tomescope.plans import ann_queries as AQ
    from tomescope.plans import recommend as R
    from tomescope.sources import tables

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    counts: dict[str, int] = {}

    t = time.time()
    idx = R.build_index(tables.books(spark, sf_dir))
    times["build_index"] = time.time() - t

    params = DEFAULT.with_(search="ivfpq", nlist=64, pq_m=64, pq_bits=8, kmeans_iter=4, nprobe=16)
    t = time.time()
    idx = R.compress(idx, params)
    times["compress_index"] = time.time() - t

    queries = tables.queries(spark, sf_dir)
    covers = tables.covers(spark, sf_dir)
    for name, p in (("recommend", DEFAULT), ("recommend_ivfpq", params)):
        t = time.time()
        counts[f"{name}_cards"] = R.recommend(queries, idx, covers, p).cards.count()
        times[name] = time.time() - t
    counts["queries"] = queries.count()

    v = AQ._vectors(spark, sf_dir)
    q = AQ._queries(v)
    t = time.time()
    run(knn_join(q, v.select("Id", "vec"), AQ.TOP_K, exclude_self=True))
    times["knn_exact"] = time.time() - t

    t = time.time()
    run(AQ.ivf_search(spark, sf_dir))
    times["ivf_search"] = time.time() - t

    t = time.time()
    pq = ann.compress_index(v, 16, 32, 8, 8, DEFAULT.seed)
    times["ivfpq_build"] = time.time() - t

    t = time.time()
    run(ann.pq_search(q, pq, AQ.NPROBE, AQ.TOP_K, exclude_self=True))
    times["pq_search"] = time.time() - t

    t = time.time()
    exact = knn_join(q, v.select("Id", "vec"), AQ.TOP_K, exclude_self=True)
    approx = ann.pq_search(q, pq, AQ.NPROBE, AQ.TOP_K, exclude_self=True)
    rec = ann.recall_at_k(exact, approx, AQ.TOP_K).first()
    times["recall_at_10"] = time.time() - t

    t = time.time()
    run(rank.bm25_search(R.prepare_queries(queries).where("valid").select("query_id", "query_text"), idx.bm25, 20))
    times["bm25_search"] = time.time() - t

    n_vec = v.count()
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(x, 3) for k, x in times.items()},
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "rows": counts,
        "queries_per_sec_recommend": round(counts["queries"] / times["recommend"], 2) if times["recommend"] else None,
        "knn_pairs_per_sec": round(n_vec * (n_vec - 1) / times["knn_exact"], 1),
        "recall_at_10": float(rec["recall_at_k"]),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
