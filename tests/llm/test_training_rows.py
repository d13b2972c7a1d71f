"""Operator 9: a doc_id that repeats is one row of the training sample."""

import zlib

import numpy as np
from llm_cases import documents, prose

from tomescope.llm import classifier


def test_repeated_ids_count_once(spark):
    rows = [(i, prose(30, i), "en", "s", 1) for i in range(40)]
    again = [(1, prose(30, 1), "en", "s", 1)] * 25 + [(2, "zz " + prose(30, 90), "en", "s", 1)] * 25 + [(3, None, "en", "s", 1)]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    sets, y = classifier.training_sample(documents(spark, rows), lab)
    more, y2 = classifier.training_sample(documents(spark, rows + again), lab)
    assert len(more) == len(sets) and np.array_equal(y, y2)
    texts = {r[0]: r[1] for r in rows}
    texts[2] = max(texts[2], again[25][1])
    want = sorted(classifier.features(texts[i]).tolist() for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert sorted(x.tolist() for x in more) == want
