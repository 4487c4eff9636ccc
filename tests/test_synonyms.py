"""Synonym tables of any length against the mapping form."""

import random

from pyspark.sql import functions as F

from firmlens.operators.relevance import industry_term_rows, industry_terms, prefetch_relevance
from firmlens.operators.search import expand_queries
from firmlens.sources.rules import synonym_rows


def table(spark, mapping):
    rows = [(alias, list(terms), place) for place, (alias, terms) in enumerate(mapping.items())]
    return spark.createDataFrame(rows, "alias string, terms array<string>, place int")


def test_terms_match_the_mapping(spark):
    rnd = random.Random(2)
    words = ["美容", "美容室", "Hair", "hair salon", "salon", "", " ", "建設", "建設業", "業", "車", "自動車"]
    mapping = {}
    for _ in range(12):
        mapping[rnd.choice(words) + rnd.choice(["", "業", "x"])] = rnd.choices(words, k=rnd.randint(0, 4))
    industries = [(word,) for word in {*words, *mapping, "自動車整備業", "zzz", "HAIR"}]
    df = spark.createDataFrame(industries + industries[:3] + [(None,)], "industry string")
    got = {r.industry: r.terms for r in industry_term_rows(df, table(spark, mapping)).collect()}
    expected = {r.industry: r.terms for r in df.where("industry is not null").distinct().select("industry", industry_terms(F.col("industry"), mapping).alias("terms")).collect()}
    assert got == expected


def test_many_terms_stay_a_join(spark):
    groups = spark.range(3000).selectExpr("id AS position", "'name' || id AS display_name", "array('kw' || id, 'Term ' || id, 'kw0') AS keywords")
    synonyms = synonym_rows(groups)
    rows = [("https://a.jp/", "we sell term 17 things", "", "name17"), ("https://b.jp/", "nothing", "", "name17"), ("https://c.jp/", "x", "", None)]
    results = spark.createDataFrame(rows, "url string, title string, snippet string, industry string")
    judged = prefetch_relevance(results, synonyms, ["x.com"])
    assert {r.url: r.accepted for r in judged.collect()} == {"https://a.jp/": True, "https://b.jp/": False, "https://c.jp/": True}
    assert len(judged._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    conditions = spark.createDataFrame([("那覇市", " name17 "), ("那覇市", "none")], "municipality string, industry string")
    queries = {(r.industry.strip(), r.query_pos): r.query for r in expand_queries(conditions, synonyms).collect()}
    assert queries["name17", 2] == "那覇市 kw17" and queries["name17", 3] == "那覇 Term 17" and queries["none", 2] == "那覇 none"
