"""Pages, lists, searches, files at hand and synchronisation against plain versions; missing values and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.functions import text
from linkwright.plans import library
from linkwright.sources.store import dropped

FILES = "path string, tier int, readable boolean"
TRACKS = "id long, title string, artist string"
ITEMS = "list long, place long, id string, title string, artist string, local boolean"
SONGS = "song_id string, title string, artist string"


def plain_file(title, artist, files):
    """The first file by tier and path, looked for one by one."""
    title, artist = (title or "").strip().lower(), (artist or "").strip().lower()
    for path, tier, readable in sorted(files, key=lambda f: (f[1], f[0])):
        name = path.rsplit("/", 1)[-1].lower()
        if readable and title and title in name and (artist in name or (artist in path.lower() if tier == 0 else True)):
            return path
    return None


def test_files_at_hand(spark):
    r = random.Random(3)
    words = ["ab", "abc", "bca", "a", "zed", "中", "中文", "x y"]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 3)))
    files = [(f"/{r.choice(['m', 'ana', 'b/bo'])}/{r.choice(['', 'Ana - ', 'Bo '])}{name().upper()}.m4a", r.randint(0, 2), r.random() < 0.8) for _ in range(60)]
    asked = [(i, name(), r.choice(["Ana", "Bo", "", None])) for i in range(40)] + [(50, None, "Ana"), (51, "  ", None), (52, "no such", None), (53, "a", None)]
    got = library.files_at_hand(spark.createDataFrame(asked, TRACKS), spark.createDataFrame(files, FILES))
    assert {x.id: x.path for x in got.collect()} == {i: p for i, t, a in asked if (p := plain_file(t, a, files))}
    dropped(got)
    nothing = library.files_at_hand(spark.createDataFrame(asked, TRACKS), spark.createDataFrame([], FILES))
    assert nothing.count() == 0


def test_sync_asks_again_for_what_is_pending(spark):
    items = [(1, 1, "c1", "x", None, False), (1, 2, None, "Bright Morning", "Ana", True), (1, 3, "i.7", "y", None, True), (1, 4, "c1", "x", None, None), (1, 5, None, "Quiet Evening", None, True), (1, 6, None, "Unheard", "Bo", True), (2, 1, None, "Unheard", "Bo", True), (3, 1, "", "z", None, False)]
    asked = []

    def at(n):
        asked.append(n)
        return spark.createDataFrame([("i.1", "Bright Morning", "Ana"), ("i.0", "Other Thing", "Ana")][: 2 * (n >= 2)] + [("i.3", "Quiet Evening", "")][: n >= 1], SONGS)

    added, left, counts = library.synced(spark.createDataFrame(items, ITEMS), at)
    assert asked == [1, 2, 3]
    assert [(x.list, x.ord, x.song_id) for x in added.orderBy("list", "ord").collect()] == [(1, 1, "c1"), (1, 2, "i.7"), (1, 3, "i.3"), (1, 4, "i.1")]
    assert sorted((x.list, x.place) for x in left.collect()) == [(1, 6), (2, 1)]
    assert sorted(tuple(x) for x in counts.collect()) == [(1, 4, 3, 1), (2, 0, 0, 1), (3, 0, 0, 0)]
    dropped(added, left, counts)
    # nothing is asked where nothing is local
    del asked[:]
    tables = library.synced(spark.createDataFrame(items[:1], ITEMS), at)
    assert not asked and [x.song_id for x in tables[0].collect()] == ["c1"] and tables[1].count() == 0


def test_pages_and_searches(spark):
    rows = [(1, "b", "x", None, "2024-01-02"), (2, None, None, "Al", None), (3, "a", "x", None, "2024-01-02"), (4, "c", "y", "RAL", "2024-01-03")]
    songs = spark.createDataFrame(rows, "id long, title string, artist string, album string, date_added string")
    order = lambda *a, **k: [(x.id, x.rank) for x in library.page(songs, *a, **k).orderBy("rank").collect()]
    assert order() == [(4, 0), (1, 1), (3, 2), (2, 3)] and order("dateAdded", 1, 2) == [(3, 1), (4, 2)]
    assert [i for i, _ in order("name")] == [3, 1, 4, 2] and [i for i, _ in order("-name", everything=True)] == [4, 1, 3, 2] and order("name", 9) == []
    with pytest.raises(ValueError):
        library.page(songs, "size")
    assert [(x.id, x.title) for x in library.found(songs, " al ").orderBy("id").collect()] == [(2, library.SHOWN["title"]), (4, "c")]
    assert library.found(songs, " ").count() == library.found(songs, None).count() == 0
    assert [x.id for x in library.found(songs, "x", 1).collect()] == [1]


def test_links_and_tokens(spark):
    row = spark.range(1).select(
        text.artwork(F.lit("u/{w}/{h}/{w}")).alias("a"), text.artwork(F.lit(None).cast("string")).alias("b"), text.with_scheme(F.lit("//x")).alias("c"), text.with_scheme(F.lit("http://x")).alias("d"),
        *[text.token_expiry(F.lit(t).cast("string")).alias(f"t{i}") for i, t in enumerate((None, "", "a", "a.b", "a.eyJleHAiOjV9.c", "a.eyJleHAiOiJ4In0.c"))],
    ).first()
    assert tuple(row) == ("u/300/300/300", None, "https://x", "http://x", None, None, None, None, 5, None)
