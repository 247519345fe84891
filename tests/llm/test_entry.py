"""The registered queries: named, whole, and equal to SQL where there is any."""

from __future__ import annotations

import os
import re

import pytest

from quern.llm import entry
from tests import oracle

needs_data = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")


def test_one_query_each():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in entry.queries()) == list(range(1, 11))
    import __spark_entry__

    assert set(entry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert oracle.same(spark, entry.queries()[name], entry.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", ["op2_pii_surrogates", "op5_quality_classifier", "op6_lm_scoring", "op7_language_id"])
def test_a_row_for_every_document(spark, name):
    docs = spark.read.parquet(f"{oracle.FOLDER}/documents.parquet")
    got = entry.queries()[name](spark, oracle.FOLDER)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
