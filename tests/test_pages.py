import pytest

from recordloom.catalog import tables as B
from recordloom.operators import pages
from recordloom.operators import threads as T


@pytest.mark.parametrize(("by", "order"), [("updated_at", "DESC"), ("status", "ASC")])
def test_pages_and_cursors_are_those_of_a_full_sort(spark, sf, tmp_path, monkeypatch, by, order):
    monkeypatch.setattr(pages, "RANGE_ROWS", 200)
    threads = B.threads(spark, sf)
    whole = [r["thread_id"] for r in threads.orderBy(
        T.sort_key(by).desc() if order == "DESC" else T.sort_key(by).asc(), T.X.file_order(T.F.col("thread_id"))
    ).select("thread_id").collect()]
    index = pages.RankIndex.write(threads, f"{tmp_path}/ranks", by, order)
    assert index.size() == len(whole)
    for offset, limit in ((0, 5), (195, 30), (len(whole) - 10, 100), (len(whole), 5)):
        found = index.page(limit, offset).collect()
        assert [r["thread_id"] for r in found] == whole[offset : offset + limit]
        assert [r["rank"] for r in found] == list(range(offset, offset + len(found)))
    row = index.page(1, 700).first()
    assert [r["thread_id"] for r in index.after(row[by], row["thread_id"], 450).collect()] == whole[701:1151]


def test_a_page_reads_only_its_ranges(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "RANGE_ROWS", 100)
    threads = B.threads(spark, sf)
    index = pages.RankIndex.write(threads, f"{tmp_path}/ranks", "title", "ASC")
    ranges = index._ranges()
    assert len(ranges) > 10 and max(n for _, n in ranges) < 400
    # the filter on the folder is in the scan, so other files aren't opened
    read = index._rows([3, 4])
    assert {r[0] for r in read.select("range").distinct().collect()} == {3, 4}
    assert read.count() == sum(n for number, n in ranges if number in (3, 4))
    assert "PartitionFilters: [range#" in read._jdf.queryExecution().executedPlan().toString()
