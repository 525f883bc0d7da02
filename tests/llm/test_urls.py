import re

from pyspark.sql import functions as F

from sluicegate.llm import urls

CASES = [
    None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "https://example.net/en", "HTTP://x.net", "http://x.net/",
    "http://badnet/", "a://b.example.com/de/x", "a://example.com/DE/x", "http://w.org/fr/?q", "http://h?x=http://z.net/",
    "://É.NET/p", "http://example.net#/en/", "x://\n.net/\na?b", "http://x.net/a://b",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, suffix, start in urls.RULES:
        if (host == suffix or host.endswith("." + suffix)) and path.startswith(start):
            if best is None or len(suffix + start) > len(best[0]):
                best = (suffix + start, verdict)
    return host, path, *(best or (None, None))


def pages(spark, rows):
    return spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")


def test_parts_and_rules_as_brute_force(spark):
    found = {row.page_id: row for row in urls.judge(pages(spark, CASES)).collect()}
    assert len(found) == len(CASES)
    for i, url in enumerate(CASES):
        host, path, rule, verdict = brute(url)
        row = found[i]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or "allow")


def test_mined_rules_generalise(spark):
    rows = [f"http://shop{i % 7}.net/pills/{i}" for i in range(40)]
    rows += [f"http://good{i % 7}.org/fr/news/{i}" for i in range(40)]
    rows += ["http://other.com/pills/9", "http://other.com/news/9", "http://other.com/else", "http://other.com/pills/9"]
    verdicts = {row.page_id: row.verdict for row in urls.judge(pages(spark, rows)).collect()}
    assert [verdicts[80 + i] for i in range(4)] == ["block", "allow", "allow", "block"]


def test_rules_as_brute_force(spark):
    rows = [f"http://{'abc'[i % 3]}.net/{'xyz'[i % 2]}/{i}" for i in range(60)]
    rows += [f"http://{'abc'[i % 3]}.org/fr/{'xyz'[i % 2]}/{i}" for i in range(60)]
    parsed = urls.parse(pages(spark, rows))
    labelled = parsed.select("tokens", F.col("fixed.verdict").alias("verdict"))
    baskets = [(set(row.tokens), row.verdict) for row in labelled.collect()]
    found = urls.mine(labelled, 0.05, 0.9).collect()
    assert found
    for rule in found:
        having = [verdict for tokens, verdict in baskets if tokens >= set(rule.antecedent)]
        both = having.count(rule.verdict)
        assert rule.confidence == both / len(having) >= 0.9
        assert abs(rule.support - both / len(baskets)) < 1e-9 and both >= urls.LEAST_ROWS
        assert rule.rarest in rule.antecedent
        for other in found:
            smaller = set(other.antecedent) < set(rule.antecedent) and other.verdict == rule.verdict
            assert not (smaller and other.confidence >= rule.confidence)


def test_repeated_rows_clashes_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "http://x.net/", "k")] * 2, "page_id long, url string, HOST string")
    assert [row.verdict for row in urls.judge(frame).collect()] == ["block", "block"]
    assert urls.judge(frame.limit(0)).count() == 0
