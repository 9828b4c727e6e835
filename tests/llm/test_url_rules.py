from kbflow.llm import url_rules as U


def slow(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


URLS = [None, "", "nothing", "http://", "HTTP://Example.COM/en/7x?y", "http://a.b.example.com/en/6#z", "x://org", "x://org/es/", "x://notorg/es/", "x://a..net/de/8", "x://example.net/de/81/../", "ftp://u:p@Ü.NET:80/de/?://", "x://com?/en/", "://com/en/", "x://com/en", "x://" + "a." * 3000 + "com/en/" + "y" * 50_000]


def test_against_brute_force(spark):
    rules = [*U.RULES, ("b.example.com", "", "block"), ("example.com", "/en/6", "block"), ("com", "/en/6#", "block"), ("a", "/", "allow"), ("", "/x", "block"), ("net", "/de/8", "allow"), ("net", "/de/8", "block")]
    rows = [(i, u, "x", 3) for i, u in enumerate(URLS)] + [(None, "x://org/es/", "y", 1), (2, "nothing", "z", 1), (7, "x://org/es/", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    for limit in (100, 1):
        got = sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in U.judge(pages, U.rules_table(spark, rules), broadcast_rules=limit).collect())
        assert got == sorted((i is None, i or 0, *((x or "") for x in slow(u, rules))) for i, u, *_ in rows)
    assert U.judge(pages.limit(0), U.rules_table(spark)).count() == 0
    none = U.judge(pages, U.rules_table(spark).limit(0)).collect()
    assert len(none) == len(rows) and all(r.rule is None and r.verdict == "allow" for r in none)


def test_as_sql(same):
    same(U.op8_url_rules, U.SQL, "/root/testdata/sf0.01", ["pages"])
