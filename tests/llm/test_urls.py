import pytest

from tidelog.llm import urls
from tidelog.llm.queries import RULES

URLS = [
    None, "", "nothing", "http://", "http://example.org", "http://example.org/", "http://EXAMPLE.org/es/x?q#f", "https://a.b.example.org/en/12", "http://badexample.org/es/",
    "ftp://x.com/fr/", "http://x.com/de/1", "http://com/de/", "http://x.com/fr/#://y.org/", "http://org", "x://é.org/a\nb", "http://x.org\n/es", "http://example.org:80/es/",
    "http://.org/", "http://a..org/", "http://x\x01org/", "http://example.org/ES/", "http://example.org?x=/es/", "://org/",
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h.count("."), len(h), len(p), v, h, p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[4] + best[5], best[3]


@pytest.mark.parametrize("range_rows", [200_000, 3])
def test_rules_equal_brute_force(spark, sf_dir, range_rows):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    rows = [(10_000 + i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, "http://x.com/fr/a", "h", "r")] * 2 + [(*p, "h", "r") for p in pages] + [(20_000 + i, "http://same.example.org/es/", "h", "r") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string"), range_rows=range_rows)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *plain(r[1], RULES)) for r in rows), key=repr)


def test_many_nested_rules_and_empty_tables(spark):
    rules = [("a.com", "/", "allow"), ("b.a.com", "/x", "block"), ("b.a.com", "", "allow"), ("c.b.a.com", "/x/y", "allow"), ("c.b.a.com", "/x/y", "block"), ("com", "", "block"), (None, "/", "block"), ("z.net", None, None)]
    names = ["a.com", "b.a.com", "c.b.a.com", "d.c.b.a.com", "com", "xa.com", "net"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in names for p in ("", "/", "/x", "/x/y", "/x/yz", "/q"))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(tuple(r) for r in urls.judge(pages, table, range_rows=2, default="block").collect())
    assert got == sorted((i, *plain(u, [r for r in rules if r[0] and r[2]], "block")) for i, u in rows)
    assert urls.judge(pages.filter("false"), table).collect() == []
    assert all(r.rule is None and r.verdict == "allow" for r in urls.judge(pages, table.filter("false")).collect())
