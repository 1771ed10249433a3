import random

import pytest

from docweave.llm import _common, queries, urlfilter


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, verdict))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "example.net/en/", "http://", "http://net", "http://net/", "HTTPS://A.Example.NET/en/x?y=/de/", "https://example.com/de", "https://example.com/de/",
    "https://notexample.com/de/1", "ftp://x.org/fr/a#b", "a://b://net/c", "https://EXAMPLE.net?x", "https://example.net#/en/", "https://x.net/\n/en/", "https://ÄB.net/en/ü",
    "https://.net/", "https://net./", "https://a..example.com/de/é", "https://example.net/en/" + "x" * 50_000, "https://example.net/en/",
]


def test_rules_of_the_query(spark):
    rows = [(i, u, "mine", i) for i, u in enumerate(URLS)] + [(None, URLS[5], "h", 0), (1, URLS[1], "h", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, k int")
    rules = queries.URL_RULES
    out = urlfilter.judge(pages, urlfilter.rule_table(spark, rules))
    assert out.columns == ["page_id", "url", "k", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all((r.host, r.path, r.rule, r.verdict) == brute(r.url, rules) for r in got)
    none = urlfilter.judge(pages, urlfilter.rule_table(spark, rules).limit(0)).collect()
    assert len(none) == len(rows) and all(r.verdict == "allow" and r.rule is None for r in none)
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, rules)).count() == 0


@pytest.mark.parametrize(("words", "lengths", "sent"), [(1 << 17, 4096, 400_000), (1, 2, 1)])
def test_many_rules(spark, words, lengths, sent, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_WORDS", words)
    monkeypatch.setattr(urlfilter, "MAX_LENGTHS", lengths)
    monkeypatch.setattr(urlfilter, "sent_if_few", lambda df: _common.sent_if_few(df, sent))
    rng = random.Random(2)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "net", "x.net", "y"]
    paths = ["", "/", "/a", "/a/", "/ab/c", "/é"]
    rules = sorted({(rng.choice(hosts) + rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)})
    rules = list({r: v for r, v in rules}.items()) + [(f"h{i}.org/{i}", "block") for i in range(300)]
    urls = [f"http://{rng.choice(['', 'w.', 'b.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '?q', '/z'])}" for _ in range(300)]
    urls += [f"http://h{i}.org/{j}" for i in range(0, 300, 7) for j in (i, i + 1, f"{i}1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls)
    assert all((r.host, r.path, r.rule, r.verdict) == brute(r.url, rules) for r in got)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    rules = urlfilter.rule_table(spark, [(f"h{i}.org/{i}/", "block") for i in range(2000)])
    words = urlfilter.build_filter(rules)
    word = urlfilter._lookup(words)
    other = urlfilter.rule_table(spark, [(f"h{i}.com/{i}/", "block") for i in range(2000)])
    share = []
    for t in (rules, other):
        block, mask = urlfilter._bits(t.rule_host, t.rule_path, len(words))
        share.append(t.filter(word(block).bitwiseAND(mask) == mask).count())
    assert share[0] == 2000 and share[1] < 100
