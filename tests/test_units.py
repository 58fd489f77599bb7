import datetime
import random
import json

import pytest
from pyspark.sql import functions as F

import encore.session as session_
from encore.__main__ import main as probe
from encore.functions import kana, parsing
from encore.functions import text as tx
from encore.operators import artists, core, revisions, search
from encore.operators.cache import BoundedCache
from encore.operators.cluster import greedy_clusters
from encore.operators.rankings import rankings, search_rankings
from encore.session import materialized
from encore.sources import cursor, html, pages
from encore.sources.shards import packed


def test_query_groups():
    assert search.parse_query('a AND "b c" OR d | e') == [["a", "b c"], ["d"], ["e"]]
    assert search.parse_query("a or 'b c' + d 与 e || f") == [["a"], ["b c", "d", "e", "||", "f"]]
    assert search.parse_query("") == [] and search.parse_query("or | 或") == []
    assert search.parse_query(" OR ".join(f"w{i}" for i in range(15))) == [[f"w{i}"] for i in range(15)]
    assert len([t for g in search.parse_query(" ".join(f"w{i}" for i in range(20))) for t in g]) == search.MAX_TERMS


def test_query_validation():
    search.validate("ab")
    search.validate("界")
    with pytest.raises(ValueError):
        search.validate("a b")


def test_timeline():
    text = "1:02:03 1. Song One / Singer\n0:10\nTitle after\n1:00 A 2:00 B\nno time here"
    assert [(r["seconds"], r["title"], r["artist"]) for r in parsing.timeline(text)] == [(3723, "Song One", "Singer"), (10, "Title after", ""), (60, "A", ""), (120, "B", "")]


def test_parts_outside_brackets():
    assert parsing.parts_of("a (b, c) & d / e") == ["a (b, c)", "d", "e"]


@pytest.mark.parametrize(("name", "latin"), [("きょうと", "kyouto"), ("がっこう", "gakkou"), ("ラーメン", "raamen"), ("しょうじょ", "shoujo"), ("abc", "abc")])
def test_romanize(name, latin):
    assert kana.romanize(name) == latin


def test_balanced():
    assert html.balanced('x={"a": "}", b: [1]} tail', 0) == '{"a": "}", b: [1]}'
    assert html.balanced("{never", 0) is None


def test_times(spark):
    df = spark.createDataFrame([("1:02:03",), ("5:07",), ("x",), ("5:77",), (None,)], "x string")
    assert [r[0] for r in df.select(tx.hms_seconds(F.col("x"))).collect()] == [3723, 307, None, None, None]
    assert spark.range(1).select(tx.seconds_hms(F.lit(3723))).first()[0] == "1:02:03"


def test_title_keys(spark):
    df = spark.createDataFrame([("1. My Song (Live)",), ("M2 My song",), ("My-Song - Remix",)], "x string")
    assert {r[0] for r in df.select(tx.work_key(F.col("x"))).collect()} == {"mysong"}
    assert [r[0] for r in df.select(tx.variant_of(F.col("x"))).collect()] == ["live", "", "remix"]


def test_nfkc(spark):
    assert spark.createDataFrame([("Ａ１",)], "x string").select(tx.nfkc("x")).first()[0] == "A1"


def test_greedy_clusters(spark):
    df = spark.createDataFrame([(1, 0), (1, 30), (1, 31), (1, 62), (2, 5)], "k int, s bigint")
    assert sorted((r.k, r.s, r.leader) for r in greedy_clusters(df, ["k"], "s", 30).collect()) == [(1, 0, 0), (1, 30, 0), (1, 31, 31), (1, 62, 62), (2, 5, 5)]


def test_packed(spark):
    df = spark.createDataFrame([("a", i, 40) for i in range(5)] + [("b", 0, 100)], "b string, k int, n int")
    assert sorted((r.b, r.k, r.part) for r in packed(df, "b", "k", "n", 100).collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0)]
    with pytest.raises(Exception, match="larger than a part"):
        packed(df, "b", "k", "n", 99).collect()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a bigint, b bigint")
    got = {r.node: r.component for r in core.connected_components(edges, materialized).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_upsert_and_first_wins(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert sorted(map(tuple, core.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "b")]
    assert sorted(map(tuple, core.first_wins([a, b], ["k"]).collect())) == [(1, "a"), (2, "a"), (3, "b")]


def test_rankings_arguments(spark):
    df = spark.createDataFrame([(1, 1, 1, False, False)], "song int, artist int, video int, niche boolean, unknown boolean")
    assert rankings(df).first()["rank"] == 1
    for bad in ({"view": "x"}, {"page": 0}, {"page_size": 1000}):
        with pytest.raises(ValueError):
            rankings(df, **bad)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_ordinal_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = core.ordinal(df.repartition(5), [F.desc("k")]).collect()
    assert sorted((r.k, r["rank"]) for r in got) == [(k, 1000 - k) for k in range(1000)]
    assert core.ordinal(df.limit(0), [F.desc("k")]).count() == 0


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", i * 7 % 101, i) for i in range(101)] + [("b", 5, 0), ("b", 5, 1)], "k string, v int, t int")
    got = {(r.k, r.p): r.v for r in core.nearest_rank(df, ["k"], "v", "t", (0.0, 0.5, 0.9)).collect()}
    assert got == {("a", 0.0): 0, ("a", 0.5): 50, ("a", 0.9): 90, ("b", 0.0): 5, ("b", 0.5): 5, ("b", 0.9): 5}


def test_first_values(spark):
    df = spark.createDataFrame([(1, x) for x in "dacbba"] + [(2, "z")], "k int, v string")
    assert {r.k: r["values"] for r in core.first_values(df, ["k"], "v", 3).collect()} == {1: ["a", "b", "c"], 2: ["z"]}


def test_cursor_walks():
    row = [{"id": i} for i in range(9)]
    pages = {"a": {"rows": row[:3], "next": "b"}, "b": {"rows": row[3:6], "next": None}}
    assert cursor.follow(pages.get, "a").coverage == "complete"
    assert cursor.follow(pages.get, "a", expected=60).coverage == "count-mismatch"
    assert cursor.follow(pages.get, "x").coverage == "partial"
    assert cursor.follow({"a": {"rows": row[:1], "next": "b"}, "b": {"rows": row[1:2], "next": "a"}}.get, "a").coverage == "cursor-loop"
    assert cursor.follow({"a": {"rows": row[:1], "next": "b"}, "b": {"rows": row[:1], "next": "c"}}.get, "a").coverage == "no-progress"


def test_cursor_source(spark):
    spark.dataSource.register(cursor.CursorSource)
    pages = {"a": {"rows": [{"id": 1}], "next": "b"}, "b": {"rows": [{"id": 2}], "next": None}, "c": {"rows": [{"id": 3}], "next": "gone"}}
    got = spark.read.format("cursor_pages").option("starts", "a,c").option("pages", json.dumps(pages)).load()
    assert sorted(map(tuple, got.collect())) == [("a", '{"id": 1}', "complete"), ("a", '{"id": 2}', "complete"), ("c", '{"id": 3}', "partial")]


def test_activation(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", False), (2, "b", False)], "k int, v string, gone boolean")
    store = revisions.Store(spark, f"file://{tmp_path}/store")
    first = store.write("r1", None, rows)
    second = store.write("r2", "r1", spark.createDataFrame([(1, "new", False), (2, None, True)], rows.schema))
    third = store.write("r3", "r1", rows.limit(1))
    with pytest.raises(revisions.Conflict):
        store.resolved("k", "gone")
    store.activate("r1", None, first)
    store.activate("r2", "r1", second)
    for bad in (("r3", "r1", third), ("r3", "r2", first), ("draft", "r2", first)):
        with pytest.raises(revisions.Conflict):
            store.activate(*bad)
    assert store.active() == "r2" and store.lineage("r2") == ["r2", "r1"]
    assert [tuple(r) for r in store.resolved("k", "gone").collect()] == [(1, "new", 0)]
    with pytest.raises(revisions.Conflict):
        store._put("r2.json", {})
    store.activate("r1", "r2", first)  # a rollback
    assert sorted((r.k, r.v) for r in store.resolved("k", "gone").collect()) == [(1, "a"), (2, "b")]
    store._put("x.json", {"parent": "y", "digest": ""}), store._put("y.json", {"parent": "x", "digest": ""})
    with pytest.raises(revisions.Conflict):
        store.lineage("x")


def test_pages(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 3, "c"), (3, 4, "d")], "page bigint, k int, v string")
    folder = f"file://{tmp_path}/pages"
    first, _ = pages.published(folder, rows, "k")
    new = rows.where("page < 3").withColumn("v", F.when(F.col("k") == 3, "changed").otherwise(F.col("v")))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*.json")}
    second, done = pages.published(folder, new, "k", first)
    assert sorted(map(tuple, done.collect())) == [(1, "kept"), (2, "written"), (3, "pruned")]
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*.json")}
    assert len(after) == 2 and [p for p in after if "page=1/" in str(p)] == [p for p in after if after[p] == before.get(p)]
    read = pages.verified(folder, second, "k int, v string", "k")
    assert sorted((r.page, r.k, r.v) for r in read.collect()) == [(1, 1, "a"), (1, 2, None), (2, 3, "changed")]
    with pytest.raises(ValueError):
        pages.verified(folder, first, "k int, v string", "k")
    empty, _ = pages.published(f"{folder}-empty", rows.limit(0), "k")
    assert empty.count() == 0


def test_typo_targets(spark):
    rows = [("t", "Brand#12", 1), ("t", "Brand#13", 3), ("t", "Brand#99", 1), ("u", "Brand#12", 1), ("u", "Brand#13", 2), ("v", "Brand#12", 1), ("v", "Brand#13", 3), ("v", "Brand#1", 4), ("w", "abcde", 1), ("w", "abcdf", 9), ("x", "Brand12", 1), ("x", "Brand#12", 3), ("y", "Brand#12", 2), ("y", "Brand#13", 5)]
    df = spark.createDataFrame(rows, "title string, artist string, n bigint")
    assert sorted(map(tuple, artists.typo_targets(df).collect())) == [("t", "Brand#12", "Brand#13"), ("x", "Brand12", "Brand#12")]
    assert sorted(map(tuple, artists.merged(df, artists.typo_targets(df)).where("title = 't'").collect())) == [("t", "Brand#13", 4), ("t", "Brand#99", 1)]


def test_partial_pairs(spark):
    rows = [("t", "ring"), ("t", "small ring"), ("u", "ring"), ("u", "small ring"), ("u", "ring two"), ("v", "ri"), ("v", "small ri"), ("w", "ring"), ("w", "a very long name of a ring"), ("x", "mall ring"), ("x", "small ring"), ("y", "one two"), ("y", "one two three"), ("z", None), ("z", "")]
    df = spark.createDataFrame(rows, "title string, artist string")
    assert sorted(map(tuple, artists.partial_pairs(df).collect())) == [("t", "ring", "small ring"), ("u", "ring", "ring two"), ("u", "ring", "small ring"), ("y", "one two", "one two three")]


def test_winners_as_one_by_one():
    """The heap against a search from the start after every merge."""
    rng = random.Random(3)
    for _ in range(300):
        names = [chr(97 + i) for i in range(rng.randint(2, 9))]
        n = {k: rng.randint(1, 4) for k in names}
        near = {k: set() for k in names}
        for _ in range(rng.randint(1, 12)):
            a, b = rng.sample(names, 2)
            near[a].add(b)
            near[b].add(a)
        groups = {k: {k} for k in names}
        total = dict(n)
        order = lambda k: (-total[k], k)
        while True:
            links = {k: {o for o in groups if o != k and any(near[x] & groups[o] for x in groups[k])} for k in groups}
            single = [k for k in sorted(groups, key=order) if len(links[k]) == 1]
            if not single:
                break
            winner, loser = sorted((single[0], *links[single[0]]), key=order)
            groups[winner] |= groups.pop(loser)
            total[winner] += total.pop(loser)
        got = artists.winners(n, near)
        assert {k: got.get(k, k) for k in names} == {x: k for k, g in groups.items() for x in g}


def test_rankings_search(spark):
    t = datetime.datetime(1998, 11, 30)
    rows = [(1, 1, 1, t, False, False, "red ring", "X", "chan", "vid"), (2, 1, 2, t, True, False, "blue cup", "Y", "other", "ring video"), (1, 2, 3, t - datetime.timedelta(30), False, True, "red ring", "X", "chan", "vid")]
    df = spark.createDataFrame(rows, "song int, artist int, video int, played timestamp_ntz, niche boolean, unknown boolean, title string, artist_name string, channel string, video_title string")
    keys = lambda **x: [r.key for r in search_rankings(df, **x).records.collect()]
    assert keys(q="ring") == [1] and keys(q="blue or red") == [1, 2] and keys(q="chan") == [1] and keys(q="zzz") == []
    assert keys(q="ring", scope="video") == [2] and keys(q="ring", fields=["title", "video_title"]) == [1, 2]
    assert keys(niche_only=True) == [2] and keys(min_count=2) == [1] and keys(range_="7d", min_count=2) == []
    payload = search_rankings(df, q="ring", page_size=1, fields=["title", "video_title"]).payload()
    assert payload["total"] == 2 and payload["page_count"] == 2 and payload["occurrences"] == 3 and len(payload["records"]) == 1
    assert search_rankings(df, compact=True).records.columns == ["key", "n", "videos", "rank"]
    for bad in ({"scope": "x"}, {"range_": "1d"}, {"fields": ["x"]}, {"q": "a"}, {"min_count": 0}):
        with pytest.raises(ValueError):
            search_rankings(df, **bad)


def test_cli(spark, capsys):
    payload = probe(["/root/testdata/sf0.001", "--view", "artist", "--q", "ring", "--page-size", "3"])
    assert len(payload["records"]) == 3 and json.loads(capsys.readouterr().out)["total"] == payload["total"] > 3


def test_bounded_cache():
    cache, made = BoundedCache(entries=2, size=10), []
    get = lambda k, v: cache.get(k, lambda: made.append(k) or v)
    assert get("a", "xxx") == get("a", "never") == "xxx" and made == ["a"]
    get("b", "yyy"), get("a", ""), get("c", "zzz")  # b was used least recently
    assert list(cache.held) == ["a", "c"] and cache.bytes == 6
    get("big", "x" * 11), get("d", "x" * 8)
    assert list(cache.held) == ["d"] and cache.bytes == 8


def test_shared_folder(spark):
    folder = session_.new_folder(spark)
    assert folder.startswith(session_.shared_folder(spark)) and folder != session_.new_folder(spark)
    table = session_.materialized(spark.range(10), rows=10)
    assert table.count() == 10 and len(table.inputFiles()) == 1
