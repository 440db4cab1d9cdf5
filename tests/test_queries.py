import zlib

import pytest

import __spark_entry__ as entry
from weftgraph.plans import forms, program  # noqa: F401  (they register their queries)
from weftgraph.plans import more  # noqa: F401
from weftgraph.plans import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_gives_what_its_sql_gives(spark, same, name):
    same(q.QUERIES[name](spark, DATA), q.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_block_checksums(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("turn").collect()
    lines: dict = {}
    for r in rows:
        lines.setdefault(r.conv_id, []).append(f"{r.role}\t{r.text}")
    want = {k: zlib.crc32("\n".join(v).encode()) for k, v in lines.items()}
    assert {r.block: r.crc for r in q.block_checksums(spark, DATA).collect()} == want
