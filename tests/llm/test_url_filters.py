import datetime as dt
import random

from tests.compare import compare, duck
from tracewell.llm import queries
from tracewell.llm import url_filters as U

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_sql(spark):
    assert compare(spark, duck(SF), queries.QUERIES["op10_url_filters"], queries.ORACLES["op10_url_filters"], SF) is None
    blocked = queries.QUERIES["op10_url_filters"](spark, SF).groupBy("blocked").count().collect()
    assert {r.blocked for r in blocked} == {True, False}


def test_keys(spark):
    urls = ["http://User@A.b.Example.COM:80/x//y?q=/z#f", "https://host/", "ftp://one.two.", "no url", None, "http:///x"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(U.keys_of(U.F.col("url"))).collect()]
    assert got[0] == ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x", "a.b.example.com/x/y"]
    assert got[1:] == [["host"], ["one.two"], None, None, None]


def test_against_brute_force(spark):
    rnd = random.Random(9)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    hosts = ["a.com", "x.a.com", "b.org", "y.b.org"]
    log = [(rnd.choice(["p", "q", None]), rnd.choice([*hosts, "A.com/in", "b.org/in/Deep"]), rnd.choice(["add", "remove"]), day(rnd.randint(0, 900))) for _ in range(120)]
    log += log[:5] + [("p", None, "add", day(1)), ("p", "a.com", None, day(1)), ("p", "b.org", "add", None)]
    caps = [(i, f"http://{rnd.choice(hosts)}/{rnd.choice(['in', 'in/Deep/er', 'out', ''])}", day(rnd.randint(0, 900)), "m") for i in range(150)]
    caps += [caps[0], (None, caps[1][1], caps[1][2], "m"), (900, None, day(5), "m"), (901, "http://a.com/", None, "m"), (902, "zzz", day(6), "m")]
    entries = spark.createDataFrame(log, "list string, pattern string, action string, at timestamp")
    captures = spark.createDataFrame(caps, "page_id long, url string, fetched timestamp, matched string")
    out = U.filter_urls(captures, entries)
    assert out.columns == ["page_id", "url", "fetched", "n_active", "matched", "blocked"]

    def brute(url, at):
        if url is None or at is None or "://" not in url:
            return 0, None
        host, _, path = url.split("://")[1].partition("/")
        labels, parts = host.split("."), [x for x in path.split("/") if x]
        keys = [".".join(labels[i:]) for i in range(len(labels) - 1)] + [host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))]
        hit = []
        for key in keys:
            for name in ("p", "q", None):
                own = sorted((t, a != "add") for n, p, a, t in log if n == name and p and t and a and p.partition("/")[0].lower() + "".join(p.partition("/")[1:]) == key and t <= at)
                if own and not own[-1][1]:
                    hit.append(key)
        return len(hit), min(hit, key=lambda k: (-len(k), k), default=None)

    got = sorted(((r.page_id, r.url, r.n_active, r.matched, r.blocked) for r in out.collect()), key=str)
    want = sorted(((i, u, *(b := brute(u, t)), b[1] is not None) for i, u, t, _ in caps), key=str)
    assert got == want
    none = U.filter_urls(captures, entries.limit(0))
    assert none.count() == len(caps) and none.where("blocked").count() == 0
    assert U.filter_urls(captures.limit(0), entries).count() == 0
