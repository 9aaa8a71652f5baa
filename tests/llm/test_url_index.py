"""The rule index fetches every rule whose expression fits."""

import random
import re

from quillspark.llm import url_filter
from quillspark.llm.queries import URL_RULES

WHERE = """ad.x.com/a ads.x.com/a ads2.x.com/a x.com/ad/ x.com/ads x.com/ad17/b x.com/AD/ ad ads9 bad.x.com/a x.com/ads-x/ doubleclick.org/ a.doubleclick.x/ x.com/login ad2 casino-win7.example.com
x.com/login/ x.com/login2 x.com/signup/a x.com/cart x.com/CART.html x.com/cart.php/ tracker.x.com/ a.tracker.b/c my_casino.x/ xcasino.x/ free-bets99.x:80/ a.net/x a.net example.net/en/x example.net/de/ example.com/de/a a.org/fr/
a.example/xyz a.example/x a.example/x/y example/x2 a.example/y -.- x.com/9 zzz""".split()


def rules_of():
    # The last two have no literal token.
    return [url_filter.suffix_rule(*r) for r in [*URL_RULES, ("block", "example/x")]] + url_filter.general_rules() + [url_filter.pattern_rule("block", [], "^[^a-z]+$"), url_filter.pattern_rule("block", [], "z{3}")]


def made_up(r):
    """Addresses of words that rules hold or nearly hold, parted in many ways."""
    words = [*url_filter.HOST_WORDS, *url_filter.PATH_WORDS, "x", "com", "net", "org", "example", "en", "fr", "de", "é", ""]
    part = lambda: r.choice(["", "", "", "a", "-", "."]) + r.choice(words) + r.choice(["", "", "", "7", "42", "s", "_", ".html", "x"])
    host = r.choice([".", "-"]).join(part() for _ in range(r.randint(1, 3))).lower()
    return host + "".join("/" + r.choice([str.lower, str.upper])(part()) for _ in range(r.randint(0, 2)))


def test_index_against_every_rule(spark):
    rules, r = rules_of(), random.Random(11)
    where = WHERE + [made_up(r) for _ in range(3000)]
    pages = spark.createDataFrame([(i, f"http://{w}") for i, w in enumerate(where)], "page_id long, url string")

    def fits(w):
        own = [(r["rank"], r["rule"] or "", r["verdict"]) for r in rules if re.search(r["pattern"], w)]
        return max(own, default=(0, "", "allow"))[1:]

    got = {r["page_id"]: (r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    want = {i: fits(w) for i, w in enumerate(where)}
    assert got == want
    assert sum(v == ("", "block") for v in want.values()) > 500


def test_long_address(spark):
    pages = spark.createDataFrame([(1, "http://x.com/" + "a1/" * 50_000 + "login"), (2, "http://" + "casino" * 9_999)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.general_rules()).collect()} == {1: "block", 2: "allow"}
