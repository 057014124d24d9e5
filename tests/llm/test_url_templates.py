import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from prefspark.llm import url_templates as u

SCHEMA = "page_id bigint, url string, host string, template string, leaf string, n int, made string, verdict string, says int"


def pages(spark, urls):
    return spark.createDataFrame([(*row, "h", "t", "l", 1, "m", "v", 2) for row in urls], SCHEMA)


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fitting = [
        (len(text), text, says)
        for says, text in u.RULES
        for domain, prefix in [text.split("/", 1)]
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix)
    ]
    return max(fitting)[1:] if fitting else (None, None)


def typed(segment):
    if len(segment) > 40:
        return "{long}"
    if re.fullmatch(r"[0-9a-fA-F-]{16,}", segment):
        return "{hex}"
    if len(re.findall("[0-9]+", segment)) > 2:
        return "{mixed}"
    return re.sub("[0-9]+", "{n}", segment)


def segments_of(path):
    path = path[1:] if path.startswith("/") else path
    path = path[:-1] if path.endswith("/") else path
    return tuple(map(typed, path.split("/", 3))) if path else ()


def shape(segments, level):
    return "next_" + hashlib.md5(segments[level].encode()).hexdigest()[0] if len(segments) > level else "stop"


def expected(rows):
    urls = []
    for page, url in rows:
        host, path = split(url)
        rule, says = rule_of(host, path)
        urls.append((page, host, path, rule, says, segments_of(path)))
    made = {(host, s): "" for _, host, _, _, _, s in urls}
    for level in range(4):
        nodes = defaultdict(lambda: defaultdict(Counter))
        for _, host, _, _, says, s in urls:
            if len(s) > level:
                nodes[host, made[host, s]][s[level]].update(["n", says, shape(s, level + 1)])
        for host, s in list(made):
            if len(s) <= level:
                continue
            node = nodes[host, made[host, s]]
            own, rest = node[s[level]], Counter()
            for name, counts in node.items():
                if name != s[level]:
                    rest.update(counts)

            def far(a, n, b, m):
                return abs(a / n - b / m) > math.sqrt(0.5 * math.log(40)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

            literal = own["n"] >= 5
            if literal and rest["n"]:
                labelled, others = (c["block"] + c["allow"] for c in (own, rest))
                literal = any(far(own[c], own["n"], rest[c], rest["n"]) for c in u.CLASSES) or bool(
                    labelled and others and far(own["block"], labelled, rest["block"], others)
                )
            nodes["made", host, s]["_"]["literal"] = int(literal)
        for host, s in list(made):
            if len(s) > level:
                made[host, s] += "/" + (s[level] if nodes["made", host, s]["_"]["literal"] else "*")
    sums = defaultdict(Counter)
    for _, host, _, _, says, s in urls:
        sums[host, made[host, s]].update(["n", says])
    block = sum(c["block"] for c in sums.values())
    prior = (block + 1) / (block + sum(c["allow"] for c in sums.values()) + 2)
    out = []
    for page, host, path, rule, says, s in urls:
        c = sums[host, made[host, s]]
        weight = 4 + 0.1 * (c["n"] - c["block"] - c["allow"])
        purity = (c["block"] + weight * prior) / (c["block"] + c["allow"] + weight)
        out.append((page, host, path, rule, says or ("block" if purity >= 0.8 else "allow")))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge(df).collect()), key=str)


def corpus(seed, n=900):
    rng, urls = random.Random(seed), []
    for i in range(n):
        host = rng.choice(["a.example.com", "B.example.com", "c.example.org", "d.example.net", "shop.de:80"])
        lang = rng.choices(["en", "de", "fr", f"x{rng.random()}"], [3, 5 if host[0] in "aB" else 1, 2, 1])[0]
        page = f"{rng.randrange(999)}{rng.choice(['', '.html', '/'])}"
        if lang == "fr" and host.startswith("a"):
            page = f"list/{page}"
        deep = rng.choice(["", "", f"/{'ab0' * 8}", "/p/q/r/1", f"/{'y' * 50}"])
        urls.append((i, f"https://{host}/{lang}/{page}{deep}{rng.choice(['', '?a=/b', '#x'])}"))
    return urls


EDGE_URLS = [
    None, "", "no scheme", "http://", "http:///", "x://NET", "x://NET/", "x://Example.NET/en/1", "x://my.example.net/en", "://a.net//",
    "a://b://c.net/x", "http://é.com/É/1", "http://a.com/" + "x/" * 50_000, "http://a.com/" + "9" * 100_000, "http://notnet/", "http://a.com?/x",
    "http://a.com#://b", "http://a.com/*/1", "http://" + "h" * 10_000, "http://a.com/1\n2/3",
]


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_against_a_plain_version(spark, monkeypatch, heavy):
    monkeypatch.setattr(u, "HEAVY", heavy)
    rows = corpus(1)
    verdicts = expected(rows)
    assert {v[4] for v in verdicts if v[3] is None} == {"allow", "block"}
    assert found(pages(spark, rows)) == verdicts


def test_edges(spark):
    rows = list(enumerate(EDGE_URLS)) + [(None, "http://a.net/"), (None, None), (3, "http://a.net/"), (3, "http://a.net/")]
    assert found(pages(spark, rows)) == expected(rows)
    assert found(pages(spark, [])) == []


def test_the_longest_rule_wins():
    assert rule_of("a.example.net", "/en/1") == ("example.net/en/", "allow") and rule_of("a.example.net", "/e") == ("net/", "block")


def test_templates_generalise_and_merge(spark):
    rows = [(i, f"http://s.org/{l}/{i}.html") for i, l in enumerate(["en", "es", "it"] * 40)]
    rows += [(i, f"http://s.org/api/v1/{i}/item{i}") for i in range(40)]
    leaves, judged = u.templates(u.parsed(pages(spark, rows)))
    assert {r.made for r in leaves.collect()} == {"/*/{n}.html", "/api/v{n}/{n}/item{n}"}
    assert {r.made: r.n for r in judged.collect()} == {"/*/{n}.html": 120, "/api/v{n}/{n}/item{n}": 40}
