"""SQL functions against the column expressions and the join that they stand beside."""

import pytest
from pyspark.sql import functions as F

from hazardspark.functions import sql, text
from hazardspark.operators import gazetteer, models, scoring

TEXTS = [(1, "Rain at https://x.y/z #Flood #flood @Ann नमस्ते"), (2, ""), (3, None), (4, "  www.a.b   ABC  বাংলা "), (5, "#no_tag#two")]


def test_scalars_are_the_columns(spark):
    sql.register(spark)
    docs = spark.createDataFrame(TEXTS, "id int, t string")
    t = F.col("t")
    same = {"normalized_text(t)": text.normalized(t), "tags_of(t)": text.hashtags(t), "mentions_of(t)": text.mentions(t), "urls_of(t)": text.urls(t), "script_of(t)": text.script_language(t)}
    for said, column in same.items():
        assert docs.where(~F.expr(said).eqNullSafe(column)).collect() == [], said
    pairs = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, [1.0, 0.0], [0.6, 0.8]), (10.0, 179.9, 10.0, -179.9, [1.0], [1.0, 2.0])], "a double, b double, c double, d double, v array<double>, w array<double>")
    got = pairs.select(F.expr("metres_between(a, b, c, d)").alias("m"), scoring.metres(*map(F.col, "abcd")).alias("n"), F.expr("cosine(v, w)").alias("x"), models.cosine(F.col("v"), F.col("w")).alias("y")).collect()
    assert all(abs(r.m - r.n) < 1e-6 and r.x == r.y for r in got)


def test_features_beside_each_row(spark):
    sql.register(spark)
    docs = spark.createDataFrame(TEXTS, "id int, t string")
    got = spark.sql("SELECT d.id, f.* FROM {docs} d, LATERAL text_features(d.t) f", docs=docs)
    rows = {r.id: r for r in got.collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and rows[1].hashtags == ["flood"] and rows[1].language == "hi" and rows[3].normalized is None and rows[2].urls == [] and rows[5].hashtags == ["no_tag", "two"]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_places_in(spark):
    names = spark.createDataFrame([("agra", "district", False), ("agra fort", "town", False), ("than", "town", True), ("uri", "town", False), ("city", "town", False)], "name string, kind string, ambiguous boolean")
    docs = spark.createDataFrame([(1, "rain at Agra fort, agra"), (2, "more than rain in city"), (3, "rain in Than"), (4, None), (5, ""), (6, "uri " * 3)], "id int, t string")
    sql.register_places(spark, names)
    got = spark.sql("SELECT d.id, p.* FROM {docs} d, LATERAL places_in(d.t) p", docs=docs).collect()
    assert {(r.id, r.name, r.kind, r.words, r["at"]) for r in got} == {(1, "agra", "district", 1, 2), (1, "agra fort", "town", 2, 2), (1, "agra", "district", 1, 4), (3, "than", "town", 1, 2)}
    best = {r.id: r.name for r in gazetteer.named_places(docs, names, "id", "t").collect()}
    assert all(name in {r.name for r in got if r.id == i} for i, name in best.items()) and set(best) == {r.id for r in got}
    with pytest.raises(ValueError):
        sql.register_places(spark, names, most=2)
