from collections import Counter

import duckdb

from tidelattice.llm import queries, url_filters

SF = "/root/testdata/sf0.01"


def run(spark, captures, changes):
    c = spark.createDataFrame([(i, u, d, 1, "e") for i, u, d in captures], "page_id long, url string, day long, n int, entry string")
    x = spark.createDataFrame(changes, "entry string, day long, action string")
    return [tuple(r) for r in url_filters.filter_captures(c, x).collect()]


def test_entries_hold_at_fetch_time(spark):
    changes = [("bad.example.com", 10, "add"), ("bad.example.com", 20, "remove"), ("bad.example.com", 30, "add"), ("bad.example.com", 31, "add")]
    changes += [("example.com", 25, "add"), ("bad.example.com/x", 12, "add"), ("once.org", 5, "add"), ("once.org", 5, "remove"), (None, 1, "add"), ("a.b", None, "add"), ("a.b", 1, "odd")]
    bad = "http://user@WWW.bad.example.com:80/x/y?q#f"
    captures = [(1, bad, 9), (2, bad, 10), (3, bad, 15), (4, bad, 20), (5, bad, 26), (6, bad, 40), (7, "https://sub.bad.example.com", 10), (7, "https://sub.bad.example.com", 10)]
    captures += [(8, None, 10), (9, "no url", 10), (10, bad, None), (None, "http://once.org/", 9), (11, "http://a.b/", 9)]
    want = Counter([
        (1, 9, False, 0, None, None), (2, 10, True, 1, "bad.example.com", 10), (3, 15, True, 2, "bad.example.com/x", 12), (4, 20, True, 1, "bad.example.com/x", 12),
        (5, 26, True, 2, "bad.example.com/x", 12), (6, 40, True, 3, "bad.example.com/x", 12), (7, 10, True, 1, "bad.example.com", 10), (7, 10, True, 1, "bad.example.com", 10),
        (8, 10, False, 0, None, None), (9, 10, False, 0, None, None), (10, None, False, 0, None, None), (None, 9, False, 0, None, None), (11, 9, False, 0, None, None),
    ])
    assert Counter(run(spark, captures, changes)) == want


def test_empty_sides(spark):
    assert run(spark, [], [("a.b", 1, "add")]) == []
    assert run(spark, [(1, "http://a.b/c", 3)], []) == [(1, 3, False, 0, None, None)]


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = db.execute(queries.C.sql["op9_url_filters"])
    names = [d[0] for d in want.description]
    got = queries.C.queries["op9_url_filters"](spark, SF).select(names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
