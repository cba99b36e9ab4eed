import pytest

from pointtide import catalog


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    """Records with a null opacity, a huge position and a position that is no number, the first in an unknown chunk."""
    d = str(tmp_path_factory.mktemp("dirty"))
    row = lambda i, chunk, o=0.5, x=0.0: (i, 1, chunk, i, 0, [x, 1.0, 2.0], [0.0, 0.0, 0.0, 1.0], [0.1] * 3, o, [0.5] * 3, 0, 4, True)
    rows = [row(1, 7), row(2, 99, o=None), row(3, 7, x=2e6), row(4, 7, x=float("nan")), row(5, 7), row(5, 7)]
    spark.createDataFrame(rows, "splat_id bigint, capture_id bigint, chunk_id bigint, record_id int, group_no int, positions array<float>, rotation array<float>, scales array<float>, opacity float, color_dc array<float>, life_start int, life_end int, is_active boolean").write.parquet(f"{d}/splats.parquet")
    spark.read.parquet("/root/testdata/sf0.001/chunks.parquet").limit(1).selectExpr("7L AS chunk_id", "* EXCEPT (chunk_id, intervals)", "8 AS intervals").write.parquet(f"{d}/chunks.parquet")
    return d


def test_records_count_whatever_else_they_lack(spark, dirty):
    q = lambda n: catalog.QUERIES[n](spark, dirty).collect()
    assert [r["splat_id"] for r in q("dead_reference_check")] == [2]
    assert {(r["chunk_id"], r["active"]) for r in q("active_counts") if r["active"]} == {(7, 4), (99, 1)}
    assert [(r["chunk_id"], r["start"], r["length"]) for r in q("run_length_pack")] == [(7, 1, 1), (7, 3, 3)]
    assert sum(r["copies"] for r in q("scatter_assign")) == 5 and len(q("erase_union")) == 5
    box = next(r for r in q("chunk_bounds") if r["chunk_id"] == 7)
    assert 2e6 in list(box)
