"""Queries report what any part of their tables holds."""

import os

import pytest
from pyspark.sql import functions as F

from tallyworks.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_presence_of_any_user(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.filter("user_id % 10 <> 3").write.parquet(str(tmp_path / "events.parquet"))
    assert any(r.active for r in QUERIES["presence_strip"](spark, str(tmp_path)).collect())


def test_encoded_secrets_of_all_three_tables(spark, tmp_path):
    import base64

    hidden = base64.b64encode(b"-----BEGIN RSA " + b"PRIVATE KEY-----").decode()
    for name, schema, row in (("documents", "doc_id long, text string", (1, hidden)), ("pages", "page_id long, html string", (2, hidden)), ("conversations", "conv_id long, turn int, text string", (3, 4, hidden))):
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = QUERIES["secret_scan_encoded"](spark, str(tmp_path)).collect()
    assert {(r.kind, r.id, r.turn) for r in got if "key" in r.rules.lower()} == {("document", "1", -1), ("page", "2", -1), ("conversation", "3", 4)}
