import math
import random
from collections import Counter

import numpy as np

from prose_audit.llm import url_filter as uf

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for kind, text in RULES:
        name, _, tail = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(text) > len(best[1])):
            best = kind, text
    return host, path, best and best[1], best and best[0]


def test_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x?y", "https://a.example.org/en/12#t", "https://a.example.org/en/2", "x://forg/", "x://org", "x://org/",
        "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/en", "http://b.com?x=/fr/", "a://b://c.org/", "http://É.org/é\nx", "http://b.com/fr/1",
    ]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in uf.judge(df, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert uf.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in uf.judge(df.filter("page_id < 3"), RULES).collect()} == {"allow"}


def test_model_against_plain_counts(spark):
    rng = random.Random(1)
    urls = [("http://" + "".join(rng.choices("abc/1é", k=rng.randrange(0, 12))), rng.randrange(2)) for _ in range(60)]
    rows = uf.count_grams(spark.createDataFrame(urls, "url string, label int")).collect()
    want = Counter()
    for url, label in urls:
        s = [0] * uf.ORDER + [int(uf.SYMBOL[b]) for b in url.encode()] + [0]
        for i in range(uf.ORDER, len(s)):
            want[label, sum(x * uf.SYMBOLS ** (uf.ORDER - k) for k, x in enumerate(s[i - uf.ORDER : i + 1]))] += 1
    assert {(r.label, r.code): r.n for r in rows} == want
    counts = np.zeros(uf.SYMBOLS ** (uf.ORDER + 1))
    for (label, code), n in want.items():
        counts[code] += n * label
    log = uf.smoothed(counts)
    assert np.allclose(np.exp(log.reshape(-1, uf.SYMBOLS)).sum(1), 1)

    def prob(context, x):
        if context is None:
            return 1 / uf.SYMBOLS
        own = Counter()
        for code in np.flatnonzero(counts):
            digits = [code // uf.SYMBOLS**k % uf.SYMBOLS for k in range(uf.ORDER, -1, -1)]
            if tuple(digits[uf.ORDER - len(context) : uf.ORDER]) == context:
                own[digits[-1]] += counts[code]
        shorter = prob(context[1:] if context else None, x)
        n = sum(own.values())
        return (own[x] + len(own) * shorter) / (n + len(own)) if n else shorter

    for code in [int(np.flatnonzero(counts)[3]), 12345]:
        digits = tuple(code // uf.SYMBOLS**k % uf.SYMBOLS for k in range(uf.ORDER, -1, -1))
        assert math.isclose(log[code], math.log(prob(digits[:-1], digits[-1])), rel_tol=1e-9)


def test_method_learns(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(3000):
        good = rng.random() < 0.5
        word = "".join(rng.choices("aeioulmnr" if good else "xzqwkjv", k=10))
        zone = rng.choice(["com/fr", "net/en"] if good else ["com/de", "net/en"])
        rows.append((i, f"http://{word}.{zone}/{word}"))
        want.append((zone == "net/en", "allow" if good else "block"))
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    right = [got[i].verdict == v for i, (free, v) in enumerate(want) if free]
    assert len(right) > 1000 and sum(right) / len(right) > 0.9
