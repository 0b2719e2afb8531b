"""The model of token vectors: a pair is counted, shuffled and joined once, an index vector is made once a term."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import embedder

RNG = random.Random(3)
TEXTS = [" ".join(RNG.choice(["a", "b", "Cé", "d", "e", "f_1", "ß"]) for _ in range(RNG.randint(0, 12))) for _ in range(40)] + [None, "", "solo", "twin twin", "z z z z y"]


def entries(term: str) -> list[tuple[int, float]]:
    h = hashlib.md5(term.encode()).hexdigest()
    return [(int(h[2 * m : 2 * m + 2], 16) % embedder.DIMS, 1.0 if h[8 + m] < "8" else -1.0) for m in range(embedder.NONZERO)]


def brute() -> dict[str, np.ndarray]:
    met = Counter()
    for t in TEXTS:
        w = (t or "").lower().split()
        for i, a in enumerate(w):
            met.update((a, w[j]) for j in range(max(0, i - 2), min(len(w), i + 3)) if j != i)
    total, out = Counter(), {}
    for (a, _), n in met.items():
        total[a] += n
    for (a, b), n in met.items():
        w = math.log(n * sum(total.values()) / (total[a] * total[b]))
        if w > 0:
            for d, s in entries(b):
                out.setdefault(a, np.zeros(embedder.DIMS))[d] += s * w
    return {a: v / np.linalg.norm(v) for a, v in out.items() if np.linalg.norm(v) > 1e-9}


def docs(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_vectors_by_brute_force_however_rows_are_cut_into_batches(spark, rows):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got, want = {r["term"]: r["vec"] for r in embedder.fit(docs(spark), "text").collect()}, brute()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], atol=1e-12) for t in want)


def test_a_pair_is_shuffled_once_and_an_index_vector_is_made_once_a_term(spark):
    plan = embedder.cooccurrences(docs(spark), "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    assert "md5" not in embedder.fit(docs(spark), "text")._jdf.queryExecution().optimizedPlan().toString()


def test_a_term_whose_rows_go_on_over_batches_holds_its_sums_alone():
    w = pa.array([0.5] * 5)
    batches = [pa.RecordBatch.from_arrays([pa.array(t), pa.array([7] * len(t), pa.int32()), w[: len(t)]], names=["term", "index", "w"]) for t in (["a", "a", "b"], [], ["b"], ["b", "b", "c"])]
    out = [r for b in embedder._summed(iter(batches)) for r in b.to_pylist()]
    assert [r["term"] for r in out] == ["a", "b", "c"] and len({tuple(r["vec"]) for r in out}) == 1
