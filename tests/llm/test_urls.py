"""Url verdicts: parsing, rules, and trees with known templates."""

import duckdb
import pytest

from wellspring.llm import urls

SCHEMA = "page_id long, url string, host string, verdict int, n string"


def frame(spark, given):
    return spark.createDataFrame([(i, u, "h", 1, "n") for i, u in enumerate(given)], SCHEMA)


def verdicts(spark, given, **more):
    return {r["page_id"]: r for r in urls.judge_urls(frame(spark, given), **more).collect()}


CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme.com/x", "", "", None), ("://", "", "", None),
    ("HTTP://WWW.Example.COM/en/Ab?q=/en/#f", "www.example.com", "/en/Ab", "www.example.com/en/"),
    ("https://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
    ("https://m.example.com/en/1#x", "m.example.com", "/en/1", "example.com/en/"),
    ("https://badexample.com/en/1", "badexample.com", "/en/1", "com/"),
    ("https://example.com/en", "example.com", "/en", "com/"),
    ("https://example.com", "example.com", "", None), ("https://example.com?x", "example.com", "", None),
    ("https://com/", "com", "/", "com/"), ("ftp://a.net/es/", "a.net", "/es/", "net/es/"), ("x://a.net/ES/1", "a.net", "/ES/1", None),
    ("http://É.NET/fr/1://y.com/", "É.net", "/fr/1://y.com/", "net/fr/"), ("http://x.org/\n/a", "x.org", "/\n/a", None),
    ("http://x.org/" + "long/" * 5000, "x.org", "/" + "long/" * 5000, None),
]


def test_parts_and_rules(spark):
    got = verdicts(spark, [c[0] for c in CASES] * 2)
    assert len(got) == 2 * len(CASES)
    for i, (url, host, path, rule) in enumerate(CASES * 2):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        if rule:
            assert got[i]["verdict"] == dict((r, v) for v, r in urls.RULES)[rule]


def test_templates_follow_labels(spark):
    given = [f"http://a.net/es/story-{i}" for i in range(30)] + [f"http://a.net//es/other{i}" for i in range(5)]  # the last fit no rule
    given += [f"http://a.net/en/story-{i}" for i in range(30)] + ["http://b.net/es/1", "http://b.net/en/2", "http://b.net/de/3"]
    got = verdicts(spark, given)
    assert {got[i]["verdict"] for i in range(35)} == {"block"} and got[30]["rule"] is None
    assert {got[i]["verdict"] for i in range(35, 65)} == {"allow"}
    assert [got[i]["verdict"] for i in (65, 66, 67)] == ["block", "allow", "allow"]


def test_siblings_alike_share_a_branch(spark):
    rows = [("h", [a, "*"], "block" if a in ("es", "fr") else "allow") for a in ("es", "fr", "en") for _ in range(40)]
    rows += [("h", ["de", "*"], None)] * 40 + [("h", [f"slug{c}"], None) for c in "abcdefgh"]
    t = urls.path_templates(spark.createDataFrame(rows, "host string, forms array<string>, label string"))
    by = {tuple(r["forms"]): r["template"] for r in t.collect()}
    assert by["es", "*"] == by["fr", "*"] == "/es|fr/*" and by["en", "*"] == "/en/*" and by["de", "*"] == "/de/*"
    assert by[("sluga",)] == "/*"


def test_tree_equals_sql(spark, tmp_path):
    import random

    rng = random.Random(5)
    pick = lambda: "/".join(rng.choice(["en", "es", "fr", "a", "news", "x1", "42", "y" * 50, f"w{chr(97 + rng.randrange(26))}", ""]) for _ in range(rng.randrange(7)))
    given = [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example.com', 'a.net', 'b.net', 'c.org'])}/{pick()}" for _ in range(3000)] + [None, "x"]
    df = frame(spark, given)
    df.select("page_id", "url").toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = sorted(map(str, con.execute(f"select page_id, host, path, rule, verdict from ({urls.oracle_sql()})").fetchall()))
    got = sorted(str(tuple(r)) for r in urls.judge_urls(df).collect())
    assert got == want
    assert sum("None, 'block'" in r for r in got) > 0


def test_empty_table_and_no_rules(spark):
    assert verdicts(spark, []) == {}
    assert {r["verdict"] for r in verdicts(spark, ["http://a.net/es/1"], rules=()).values()} == {"allow"}


@pytest.mark.parametrize("word", ["Python", "Arrow", "Pandas"])
def test_plan_is_native(spark, word):
    plan = urls.judge_urls(frame(spark, ["http://a.net/es/1"]))._jdf.queryExecution().executedPlan().toString()
    assert word not in plan
