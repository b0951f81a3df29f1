"""Searches over the whole set of queries: every 50th vector, against brute force and SQL."""

import numpy as np
import pytest
from oracle import differences

from phrasemill.plans import catalog

SF = "/root/testdata/sf0.01"


def brute_force(spark, k=10):
    """The ids of the ``k`` best codes for every vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    code = np.clip(np.rint(np.array([r.embedding for r in rows], float) * 200), -128, 127)
    return {int(i): [int(x) for x in ids[np.lexsort((ids, -(code @ q)))[:k]]] for i, q in zip(ids, code) if i % 50 == 0}


def test_queries_grow_with_the_table(spark):
    found = {}
    for r in catalog.QUERIES["mips_topk_int8"](spark, SF).orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.id)
    assert found == brute_force(spark)
    asked = {r.qid for r in catalog.QUERIES["span_complete_ends"](spark, SF).collect()}
    assert asked == set(found)


@pytest.mark.parametrize("name", ["mips_topk_exact", "phrase_search", "agg_opt4"])
def test_equals_sql(spark, name):
    sql = catalog.ORACLES[name]
    assert "% 50 = 0" in sql and "a.id <" not in sql
    assert not differences(spark, name, catalog.QUERIES[name], sql, SF)
