import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    for p in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p


def test_partitions_do_not_matter(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for n in (1, 7):
        docs.repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found.append([sorted(map(repr, entry.queries()[q](spark, f"{tmp_path}/{n}").collect())) for q in ("run_labels", "match_hits", "tokens_cased")])
    assert found[0] == found[1]
