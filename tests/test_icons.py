from foliograph.operators import icons


def test_suggestions(spark):
    labels = [("Release Notes 2024", "page", "scroll", "phrase"), ("2024", "tab", "calendar", "year"), ("notes on releases", "page", None, None), ("API keys", "page", "key", "phrase"), ("Key API keyed", "page", "key", "phrase"), ("User guide", "group", "book", "word"),
        ("guide user", "group", "book", "word"), ("nothing known", "group", "folder", "kind"), ("nothing known", "page", None, None), ("  !! ", "tab", None, None), (None, "tab", None, None), ("drawn by none", "tab", None, None), ("Ünïcode guide", "page", "book", "word"), ("go", "page", "play", "phrase")]
    rows = spark.createDataFrame([(i, lab, kind) for i, (lab, kind, _, _) in enumerate(labels)], "id int, label string, kind string")
    phrases = spark.createDataFrame([("notes 20", "ghost", 0), ("release notes", "scroll", 1), ("api key", "key", 2), ("release notes 2024", "later", 3), ("go", "play", 9)], icons.PHRASES)
    words = spark.createDataFrame([("user", "ghost"), ("guide", "book"), ("by", "ghost")], icons.WORDS)
    fallback = spark.createDataFrame([("group", "folder"), ("page", "folder"), ("tab", "ghost")], icons.FALLBACK)
    drawable = spark.createDataFrame([(n,) for n in ("scroll", "key", "later", "book", "folder", "calendar", "play")], "name string")
    got = {r["id"]: (r["icon"], r["icon_by"]) for r in icons.suggested(rows, phrases, words, fallback, drawable).collect()}
    for i, (label, _, icon, by) in enumerate(labels):
        assert got[i] == (icon, by), label
    assert icons.suggested(rows.limit(0), phrases, words, fallback, drawable).count() == 0


def test_lists_are_filled_whole_or_not_at_all(spark):
    pages = [("a", None, "x"), ("a", "", None), ("b", None, "x"), ("b", None, None), ("b", None, None), ("c", "own", "x"), ("c", None, "x"), (None, None, "x")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "id int, box string, stated string, icon string")
    assert [r["shown"] for r in icons.filled(rows, "box", "file").orderBy("id").collect()] == ["x", "file", None, None, None, "own", None, "x"]
