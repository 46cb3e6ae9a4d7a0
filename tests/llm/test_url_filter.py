import collections
import math

from pyspark.sql import functions as F

from preflens.llm import url_filter as u


def parts(spark, urls):
    rows = spark.createDataFrame([(x,) for x in urls], "url string")
    return [tuple(r) for r in rows.select(u.host_of(F.col("url")), u.path_of(F.col("url"))).collect()]


def test_host_and_path(spark):
    urls = ["HTTP://A.Example.ORG/es/X?q#f", "https://b.com", "x://c.com?d/e", "://h#/p", "no scheme/", "", None, "a://b/c://d/e"]
    assert parts(spark, urls) == [
        ("a.example.org", "/es/X"), ("b.com", ""), ("c.com", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("b", "/c://d/e"),
    ]


def test_longest_rule_wins_and_covers_subdomains(spark):
    cases = {
        ("example.org", "/es/1"): "example.org/es/", ("m.example.org", "/en/12"): "example.org/en/1",
        ("example.org", "/en/2"): "org/", ("org", "/"): "org/", ("org", ""): None, ("myexample.org", "/es/"): "org/",
        ("notorg", "/"): None, ("a.com", "/fr/"): "com/fr/", ("a.com", "/de/9"): "com/de/", ("a.com", "/de"): None,
    }
    rows = spark.createDataFrame(list(cases), "host string, path string")
    found = rows.select("host", "path", u.rule_of(F.col("host"), F.col("path"), u.RULES)["rule"].alias("rule")).collect()
    assert {(r.host, r.path): r.rule for r in found} == cases


def model_score(urls, labels, url):
    """The score by the definition, with plain dictionaries."""
    def counts(side):
        c = collections.defaultdict(collections.Counter)
        for x, l in zip(urls, labels):
            if l == side:
                t = u.START * u.ORDER + x + u.END
                for i in range(u.ORDER, len(t)):
                    for n in range(u.ORDER + 1):
                        c[t[i - n : i]][t[i]] += 1
        return c

    total, text = 0, u.START * u.ORDER + url + u.END
    models = [counts("allow"), counts("block")]
    for i in range(u.ORDER, len(text)):
        logs = []
        for c in models:
            p = 1 / u.ALPHABET
            for n in range(u.ORDER + 1):
                seen = c.get(text[i - n : i])
                if seen:
                    p = (seen[text[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
            logs.append(math.log(p))
        total += logs[0] - logs[1]
    return total / (len(text) - u.ORDER)


def test_scores_equal_the_definition_and_separate_held_out_urls(spark):
    urls, labels = [], []
    for i in range(40):
        urls += [f"http://news{i % 7}.example/fr/{i}", f"http://spam{i % 5}-bets.example/win{i}?x={i}"]
        labels += ["allow", "block"]
    test = ["http://news3.example/fr/99", "http://spam1-bets.example/win77", ""]
    rows = [(i, t, l) for i, (t, l) in enumerate(zip(urls, labels))] + [(1000 + i, t, None) for i, t in enumerate(test)]
    table = u.saved(spark.createDataFrame(rows, "row_id long, text string, verdict string"))
    found = {r.row_id: r.score for r in u._scores(table, F.col("verdict").isNotNull()).collect()}
    for i, t in enumerate(test):
        assert abs(found[1000 + i] - model_score(urls, labels, t)) < 1e-5
    assert found[1000] > 0 > found[1001]


def test_model_is_not_copied_and_frequent_strings_stay_where_they_lie(spark):
    rows = [(i, f"https://www.host{i}.example.org/{i * 7919}", "allow" if i % 2 else "block") for i in range(200)]
    table = u.saved(spark.createDataFrame(rows, "row_id long, text string, verdict string"))
    scores = u._scores(table, F.col("verdict").isNotNull())
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" not in plan and plan.count("strategy=broadcast") == 3 and "strategy=merge" in plan
    assert scores.count() == 200


def test_odd_rows_and_missing_classes(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "http://a.org/x"), (4, "nothing")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "'r' as rule", "0 as gram")
    out = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge(pages).collect() if r.rule is None)
    assert [o[0] for o in out] == [1, 1, 2, 4] and {o[4] for o in out} <= {"allow", "block"} and out[0] == out[1]
    assert u.judge(pages.where("page_id > 9")).count() == 0


def test_verdicts_depend_on_urls_alone(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    results = [u.judge(pages.repartition(n)).select("page_id", "verdict", "threshold").collect() for n in (1, 5)]
    assert sorted(map(tuple, results[0])) == sorted(map(tuple, results[1]))
