import random

from skein.llm import urls


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


RULES = [*urls.RULES, ("b.example.net", "/en/x", "block"), ("a.org", "", "block"), ("org", "/fr/a", "block"), ("localhost:80", "/", "block")]


def made():
    rng = random.Random(2)
    hosts = ["a.net", "net", "x.example.NET", "example.net", "b.example.net", "fakeexample.net", "example.com", "www.example.com", "a.org", "c.a.org", "org", "localhost:80", "", ".net", "user@a.net", "É.net", "a..net"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/en/xy?q=/de/", "/de/1#/", "/fr/", "/fr/abc", "//", "?a=/", "#x", "/fr/a/b/c"]
    out = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths]
    rng.shuffle(out)
    return [*out, None, "", "no scheme", "://", "a://b://c/", "http://" + "l." * 60 + "net/" + "p/" * 200, "http://a.net\n/x"]


def test_against_every_rule(spark):
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), RULES[0]], "host string, path string, verdict string")
    data = [(i, u, "old") for i, u in enumerate(made())] * 2
    got = urls.judge_urls(spark.createDataFrame(data, "page_id long, url string, rule string"), rules).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, RULES), r.url


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert urls.judge_urls(pages, rules.limit(0), default="block").first().verdict == "block"


def test_a_very_long_url(spark):
    import time

    long = "http://" + ".".join(f"l{i}" for i in range(200)) + ".example.net/" + "/".join(f"s{i}" for i in range(2000))
    longer = "http://" + "l." * 100_000 + "org/" + "p/" * 100_000
    rules = [("net", "/s0/s1/", "block"), ("org", "/p/", "block"), ("l199.example.net", "/s0/s1/s2", "allow"), ("a.b.c.d.e", "/x", "block")]
    began = time.time()
    pages = spark.createDataFrame([(1, long), (2, longer)], "page_id long, url string")
    got = {r.page_id: r.rule for r in urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {1: "l199.example.net/s0/s1/s2", 2: "org/p/"} and time.time() - began < 30
