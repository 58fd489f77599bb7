"""Queries over whole tables, on a few rows that the slices of other queries leave out."""

import datetime

import duckdb
import pytest

from encore.plans import catalog, incremental, windows

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    #: video, song, artist, position, seconds, niche flag, unknown flag
    lines = [(1, 900, 1, 1, 5.0, "R", "O"), (1, 901, 2, 2, 5.0, "N", "O"), (3, 900, 2, 3, 7.0, "R", "F"), (3, 900, 1, 4, 8.0, "R", "O"), (3, 900, 1, 5, 8.0, "R", "O")]
    spark.createDataFrame([(*x, DAY) for x in lines], LINE).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(900, "blue ring", "Brand#1", 3), (901, "red cup", "Brand#2", 3)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    return d


def result(spark, folder, name):
    return sorted(tuple(r) for r in catalog.queries()[name](spark, folder).collect())


def test_timeline_reads_every_video(spark, folder):
    assert sorted(r.video for r in incremental.timeline_texts(spark, folder).collect()) == [1, 3]
    assert result(spark, folder, "parse_timeline") == [(1, 301, "blue ring", "Brand#1"), (1, 302, "red cup", "Brand#2"), (3, 423, "blue ring", "Brand#1"), (3, 484, "blue ring", "Brand#1"), (3, 485, "blue ring", "Brand#1")]
    assert result(spark, folder, "rederive_idempotent") == [(5, 0)]


def test_accents_after_the_preview(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 300 + "é", "en"), (2, "à", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert result(spark, str(tmp_path), "strip_accents") == [(1, "x" * 300 + "e"), (2, "a")]


def test_songs_of_one_second_stay(spark, folder):
    assert result(spark, folder, "same_second_dedupe") == [(1, 5, 900, 1, 1), (1, 5, 901, 2, 2), (3, 7, 900, 2, 3), (3, 8, 900, 1, 4)]


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("fold_unknown", [(900, 1, 5), (901, 2, 1)]),
        ("search_totals", [(2, 6, 4)]),
        ("case_ordering", [(900, 0, 1), (901, 1, 2)]),
        ("shared_item_pairs", [(1, 2, 1)]),
        ("window_over_agg", [(1, 900, 1), (2, 901, 1), (2, 900, 2)]),
        ("nested_collect", [(1, "900:4"), (2, "900:1,901:1")]),
        ("singleton_stats", [(900, 5, 2, False), (901, 1, 1, True)]),
        ("bool_aggs", [(900, True, True), (901, False, False)]),
        ("conflicting_attributes", [(900, 2)]),
        ("cluster_pairs", [("blue ring", "Brand#1", "Brand#2", 0.45)]),
    ],
)
def test_whole_tables(spark, tmp_path, name, rows):
    lines = [(1, 900, 1, 1, 5.0, "R", "O"), (1, 901, 2, 2, 5.0, "N", "O"), (3, 900, 2, 3, 7.0, "R", "F"), (3, 900, 1, 4, 8.0, "R", "O"), (3, 900, 1, 5, 8.0, "R", "O"), (5, 900, 1, 5, 8.0, "R", "O")]
    spark.createDataFrame([(*x, DAY) for x in lines], LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(900, "blue ring", "Brand#1", 3), (901, "blue ring", "Brand#2", 4)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert result(spark, str(tmp_path), name) == sorted(rows)


def test_pages_of_all_songs(spark, tmp_path):
    spark.createDataFrame([(v, 900 + v, 1, 1, 5.0, "R", "O", DAY) for v in range(60)], LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert result(spark, str(tmp_path), "group_paging") == [(v, 900 + v, 1) for v in range(20, 40)]


@pytest.mark.parametrize("songs", [50_001, 50_050])
def test_clamped_page_is_the_last(spark, tmp_path, songs):
    rows = spark.range(songs).selectExpr("id AS l_orderkey", "nullif(id, 7) AS l_partkey", "1L AS l_suppkey", "1 AS l_linenumber", "5D AS l_quantity", "'R' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz'2024-01-01' AS l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.queries()["clamped_page"](spark, str(tmp_path)).collect()
    assert len(got) == (songs - 1) % 50 + 1 and {tuple(r) for r in got} == set(con.execute(catalog.oracle_sql()["clamped_page"]).fetchall())


@pytest.mark.parametrize("total", [0, 1, 7, 8])
def test_every_page(spark, total):
    ranked = spark.createDataFrame([(x, 5 - x % 3) for x in range(total)], "song long, n long")
    order = sorted(range(total), key=lambda x: (x % 3 - 5, x))
    for number in (-1, 0, 1, 2, 3, 99):
        first = (min(max(number, 1), max(1, -(-total // 4))) - 1) * 4
        got = windows.page(ranked, number, 4).collect()
        assert sorted((r["rank"], r.song) for r in got) == [(first + i + 1, x) for i, x in enumerate(order[first : first + 4])]


def test_every_document_has_a_flag(spark, tmp_path):
    docs = [(1, "benchmarks", "de", 10), (2, "something " * 400, "en", 4000), (3, "short", "en", 5), (4, None, "fr", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Benchmarks")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert result(spark, str(tmp_path), "membership_flag") == [(1, False), (2, True), (3, True), (4, True)]


def test_all_events_in_all_revisions(spark, tmp_path):
    points = [0, 1, 4, 5, 499, 500, 501, 2000, 2100, 90_000]
    revisions = [3, 4, 10, 600, 2000, 50_000]
    spark.createDataFrame([(x,) for x in points], "event_id long").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(x,) for x in revisions], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = {x: max((r for r in revisions if r <= x), default=None) for x in points}
    got = catalog.queries()["asof_lineage"](spark, str(tmp_path)).collect()
    assert len(got) == len(points) and {r.event_id: r.revision for r in got} == want
