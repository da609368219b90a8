import random

from docassay.llm.q_url_filter import RULES
from docassay.llm.url_filter import host_rule, judge_urls, pattern_rule, token_counts, token_index

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, blocking):
    url = url or ""
    rest = url.partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(LOW), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = []
    for action, text in rules:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(text), action, text))
    if fit:
        return host, path, max(fit)[2], max(fit)[1]
    return host, path, None, "block" if blocking(url.translate(LOW)) else "allow"


def test_against_brute_force(spark):
    r = random.Random(4)
    rules = [*RULES, ("block", "net/a.b/c"), ("allow", "x-y.net/"), ("block", "ünï.net/é"), ("block", "y.net/q")]
    hosts = ["org", "example.org", "EXAMPLE.org", "a.example.org", "badexample.org", "com", "t.com", "x-y.net", "y.net", "ünï.net", "", "org:80", "spam-farm.net", "www.spam-farm.com", "notspam-farm.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x#y", "/en/2", "/fr/9", "/FR/9", "/de/", "/a.b/c", "/a.b/cc", "/é/x", "/q", "?q=/fr/", "#/de/", "/pagead/1", "/x/pagead", "\n/es/"]
    urls = [s + h + p for h in hosts for p in paths for s in ("http://", r.choice(["https://u@", "ftp://", "", "x://y://"]))]
    urls += [None, "", "://", "http:/org/", "http://" + "a." * 3000 + "org/" + "es/" * 3000]
    blocking = lambda u: any(pattern in u for pattern in ("/pagead/",)) or ("spam-farm." in u and __import__("re").match(r"[^:/?#]*://([^/?#]*\.)?spam-farm\.", u) is not None)
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = judge_urls(pages, rules, ("||spam-farm.", "/pagead/"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for x in got.collect():
        assert (x.host, x.path, x.rule, x.verdict) == brute(x.url, rules, blocking), x


def test_patterns():
    assert pattern_rule("||spam-farm.")["tokens"] == ["spam", "farm"]
    assert pattern_rule("ad*/track/x")["tokens"] == ["track"]
    assert host_rule("example.org/en/1", True)["tokens"] == ["example", "org", "en"]
    filed, loose = token_index([host_rule("org/", False), host_rule("a.org/es/", True), pattern_rule("*x*")])
    assert set(filed) == {"org", "es"} and len(loose) == 1


def test_wildcards_and_separators(spark):
    urls = ["http://a/x?affiliate_id=3&y&click=1", "http://a/track^", "http://a/track", "http://a/tracker", "http://h/q/ADX"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = judge_urls(pages, (), ("?affiliate_id=*&click=", "/track^", "adx")).orderBy("page_id").collect()
    assert [x.verdict for x in got] == ["block", "block", "block", "allow", "block"]


def test_many_rules(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rules = sorted({(f"{word()}.{r.choice(['com', 'org'])}/{r.choice(['', word(), word() + '/'])}") for _ in range(10_000)})
    rules = [("block" if k % 3 else "allow", text) for k, text in enumerate(rules)]
    urls = []
    for _ in range(300):
        host, _, path = r.choice(rules)[1].partition("/")
        urls.append(f"http://{r.choice(['', 'www.', 'x'])}{host}/{r.choice([path, path + 'zz', word()])}?{word()}")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for x in judge_urls(pages, rules, ()).collect():
        assert (x.host, x.path, x.rule, x.verdict) == brute(x.url, rules, lambda u: False), x


def test_rarest_token_is_that_of_the_fewest_urls(spark):
    pages = spark.createDataFrame([(k, f"http://www.example.org/es/{k}") for k in range(5)] + [(9, None)], "page_id long, url string")
    rules = [host_rule("example.org/es/", True), host_rule("com/es/", True)]
    counts = token_counts(pages, rules)
    assert counts == {"example": 5, "org": 5, "es": 5}
    assert set(token_index(rules, counts)[0]) == {"com", "example"}


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
