import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TIDELINE_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["p6_ids", "p7_found", "p7_mix", "p7_report", "p8_found", "p8_labels"])
def test_query_runs(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    df = entry.queries()[name](spark, FOLDER)
    want = {"p6_ids": ["doc_id", "ids"], "p7_found": ["mix", "source"], "p8_found": ["doc_id", "segment", "lang"]}
    assert df.columns == want.get(name, df.columns) and df.count() > 0


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in entry.queries()["p6_ids"](spark, FOLDER).collect()}
    assert got == {k: t.encode(v, add_special_tokens=False).ids for k, v in text.items()}
