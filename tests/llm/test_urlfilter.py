import datetime as dt
import random

from foliomill.llm import urlfilter


def brute(captures, entries):
    history = {}
    for pattern, action, dated in entries:
        if pattern and dated and action in ("allow", "block", "remove"):
            domain, slash, tail = pattern.partition("/")
            key = history.setdefault(domain.lower() + slash + tail, {})
            key[dated] = max(action, key.get(dated, ""))
    out = []
    for page, url, day in captures:
        found, rest = [], (url or "").split("://", 1)
        host = path = ""
        if len(rest) == 2:
            body = rest[1].split("#")[0].split("?")[0]
            host, _, tail = body.partition("/")
            host, path = host.split("@")[-1].lower(), "/" + tail if "/" in body else ""
            host = host.split("]")[0] + "]" if host.startswith("[") else host.split(":")[0].rstrip(".")
        for pattern, dates in history.items():
            domain, slash, tail = pattern.partition("/")
            if host and day and (host == domain or host.endswith("." + domain)) and path.startswith(slash + tail):
                before = [d for d in dates if d <= day]
                if before and dates[max(before)] != "remove":
                    found.append((domain.count("."), len(slash + tail), pattern, dates[max(before)]))
        top = max(found, default=None)
        out.append((page, day, host, top[3] if top else "none", top[2] if top else None, len(found)))
    return sorted(out, key=str)


def test_verdicts_equal_brute_force(spark):
    r = random.Random(1)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(r.randrange(300))
    hosts = ["a.example.com", "example.com", "b.a.example.com", "other.org", "x.other.org", "xexample.com"]
    entries = [(r.choice([*hosts, "com", "Example.com/en", "other.org/a/b", "[::1]"]), r.choice(["allow", "block", "remove"]), day()) for _ in range(60)]
    entries += [(None, "block", day()), ("other.org", "block", None), ("other.org", "paint", day())] + entries[:3]
    captures = [(i, f"{r.choice(['http', 'https'])}://{r.choice(['', 'u:p@'])}{r.choice(hosts)}{r.choice(['', ':80', '.'])}{r.choice(['', '/', '/en/1', '/EN', '/a/b?q=1', '?x#y'])}", day()) for i in range(400)]
    captures += [(900, None, day()), (901, "no url", day()), (902, "http://a.example.com/", None), (903, "http://[::1]:80/x", dt.date(2024, 12, 1)), (None, "http://a.example.com/", day())] + captures[:5]
    caps = spark.createDataFrame([(*c, "v") for c in captures], "page_id long, url string, fetched_on date, verdict string")
    ents = spark.createDataFrame(entries, "pattern string, action string, dated date")
    got = urlfilter.verdicts(caps, ents)
    assert sorted(((x.page_id, x.fetched_on, x.host, x.verdict, x.pattern, x.n_active) for x in got.collect()), key=str) == brute(captures, entries)
    assert urlfilter.verdicts(caps.limit(0), ents).count() == 0
    assert {x.verdict for x in urlfilter.verdicts(caps, ents.limit(0)).collect()} == {"none"}


def test_a_long_list_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 1)
    days = [dt.date(2024, 1, d) for d in (1, 5, 9)]
    ents = spark.createDataFrame([("h.com", "block", days[1]), ("h.com", "remove", days[2]), ("i.com", "block", days[0])], "pattern string, action string, dated date")
    caps = spark.createDataFrame([(i, "http://w.h.com/x", d) for i, d in enumerate(days)], "page_id long, url string, fetched_on date")
    got = urlfilter.verdicts(caps, ents)
    assert {x.page_id: x.verdict for x in got.collect()} == {0: "none", 1: "block", 2: "none"}
