import fnmatch
import random
import re

from larder.llm.urlrules import RULES, Automaton, UrlRule, judge_urls
import numpy as np


def brute(url, rules, otherwise="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in rules:
        glob = lambda text, pattern: re.fullmatch(fnmatch.translate(pattern), text, re.DOTALL)
        if (glob(host, r.host) or glob(host, "*." + r.host)) and glob(path, r.path + "*"):
            fits.append(r)
    best = min(fits, key=lambda r: (-len(str(r)), r.verdict != "block", str(r)), default=None)
    return host, path, best and str(best), best.verdict if best else otherwise


def run(spark, urls, *args):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, source_url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, *args).collect()}


URLS = [
    "http://example.org/es/1", "https://www.EXAMPLE.org/en/12?x#y", "http://org/", "http://a.org", "http://xorg/fr/", "http://a.com/fr/x",
    "https://b.a.com/de/x", "http://example.org/en/2", None, "", "no address", "ftp://example.org?/es/", "http://É.org/É/ÀA", "x://y://z.org/a",
    "http://example.org:80/es/1", "http://.org/", "http://com.org/de/", "http://a.com/de/" + "x" * 5000, "http://a\nb.org/\n/es", "://org/x",
]


def test_given_rules(spark):
    assert run(spark, URLS) == {k: brute(u, RULES) for k, u in enumerate(URLS)}
    assert spark.createDataFrame([], "page_id long, source_url string, host int").transform(judge_urls).count() == 0


def test_many_random_globs_need_several_words(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("ab.", k=n))
    rules = [
        UrlRule(rng.choice(["allow", "block"]), rng.choice(["", "*", "?"]) + text(rng.randint(1, 4)), "/" + rng.choice(["", "*"]) + text(rng.randint(0, 4)))
        for _ in range(60)
    ]
    urls = [f"http://{text(rng.randint(0, 7))}/{text(rng.randint(0, 7))}" for _ in range(400)]
    assert len(Automaton(rules).first) > 4
    assert run(spark, urls, rules, "block") == {k: brute(u, rules, "block") for k, u in enumerate(urls)}
    assert run(spark, ["http://a/b"], []) == {0: ("a", "/b", None, "allow")}


def test_empty_batch():
    none = np.zeros(0, dtype=np.int64)
    assert Automaton(RULES).accepted(np.zeros(0, dtype=np.uint8), none, none).shape == (0, 2 * len(RULES))
