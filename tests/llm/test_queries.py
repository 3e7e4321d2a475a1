"""Registered queries against their SQL, or against plain Python on the small tables."""

import os
from collections import Counter, defaultdict

import pytest

from strandlake.llm import queries
from strandlake.llm.tokens import encoder
from tests.parity import FOLDER, assert_same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.fixture(scope="module")
def sizes(spark):
    return {r.doc_id: len(encoder().encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def test_p6(spark, sizes):
    rows = queries.p6_containers(spark, FOLDER).collect()
    room, whole = Counter(), Counter()
    for r in rows:
        room[r.container_id] += r.piece_size
        whole[r.doc_id] += r.piece_size
    assert dict(whole) == sizes and max(room.values()) <= 4096
    assert {r.doc_id for r in queries.p6_found(spark, FOLDER).collect()} == {i for i, n in sizes.items() if n > 4096}


def test_p7(spark, sizes):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source").collect()
    goals = spark.read.parquet(f"{FOLDER}/mix_targets.parquet").collect()
    per = defaultdict(int)
    for r in docs:
        per[(r.source or "").strip().lower()] += sizes[r.doc_id]
    total = sum(per[g.source] for g in goals)
    assert {r.source for r in queries.p7_found(spark, FOLDER).collect()} == {g.source for g in goals if per[g.source] * g.max_uses < g.target_share * total}


def test_p2_and_p8_shapes(spark):
    assert queries.p2_pieces(spark, FOLDER).columns == ["contig_row", "piece_no", "piece_start", "piece_end", "stretch_starts", "bases"]
    levels = queries.p8_levels(spark, FOLDER).collect()
    assert len(levels) == spark.read.parquet(f"{FOLDER}/documents.parquet").count() and {r.reading_level for r in levels} <= {None, 1, 2, 3, 4, 5}
    assert {r.doc_id for r in queries.p8_found(spark, FOLDER).collect()} == {r.doc_id for r in levels if (r.reading_level or 0) >= 4}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_found_come_out_of_the_operators(spark):
    """The plan of p6_found numbers the items and looks containers up; that of p7_found counts the uses of each document."""
    packed = _plan(queries.p6_found(spark, FOLDER))
    assert "Window" in packed and "container" in packed and "ArrowEvalPython" in packed
    mixed = _plan(queries.p7_found(spark, FOLDER))
    assert "xxhash64" in mixed and "_cut_at" in mixed and "n_uses" in mixed


def test_p7_leaves_add_up(spark):
    leaves, shares = queries.p7_leaves(spark, FOLDER).collect(), queries.p7_shares(spark, FOLDER).collect()
    for r in shares:
        assert r["taken"] == sum(x["taken"] for x in leaves if x["source"] == r["source"])
    assert all(x["taken"] <= x["most"] for x in leaves)
