"""Place names built from customers as places of nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.functions import sql
from hazardspark.operators import gazetteer as g
from hazardspark.plans.base import query


@query("customer", "nation", "region", sql="""WITH p AS (SELECT c.c_custkey AS line, lower(c.c_mktsegment || ' ' || n.n_name) AS name, 'town' AS kind, CAST(floor(c.c_acctbal * 10) AS BIGINT) population, r.r_name AS state, n.n_name AS district FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE c.c_acctbal * 10 >= 5000)
SELECT name, kind, state, district, population FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY population DESC, line) = 1""")
def gazetteer_build(c: DataFrame, n: DataFrame, r: DataFrame) -> DataFrame:
    """Customers' segments and nations as names of towns, balances as people."""
    places = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("line"), F.concat_ws(" ", "c_mktsegment", "n_name").alias("name"), F.lit(None).cast("string").alias("ascii"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"),
        F.lit("P").alias("class"), F.lit("PPL").alias("code"), F.col("n_regionkey").alias("admin1"), F.col("n_nationkey").alias("admin2"), F.floor(F.col("c_acctbal") * 10).alias("population"),
    )
    first = r.select(F.col("r_regionkey").alias("admin1"), F.col("r_name").alias("name"))
    second = n.select(F.col("n_regionkey").alias("admin1"), F.col("n_nationkey").alias("admin2"), F.col("n_name").alias("name"))
    return g.build(places, first, second, []).select("name", "kind", "state", "district", "population")


@query("documents", sql=r"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://\S+|www\.\S+)', ' ', 'g'), '[#@]([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g'))) AS normalized, unicode(regexp_extract(text, '[\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A80}-\x{0AFF}\x{0B80}-\x{0BFF}]')) AS c FROM documents)
SELECT doc_id, normalized, sha256(normalized) AS text_hash, CASE WHEN c BETWEEN 2304 AND 2431 THEN 'hi' WHEN c BETWEEN 2432 AND 2559 THEN 'bn' WHEN c BETWEEN 2688 AND 2815 THEN 'gu' WHEN c BETWEEN 2944 AND 3071 THEN 'ta' ELSE 'en' END AS language FROM t""")
def sql_text_features(d: DataFrame) -> DataFrame:
    """The table function of SQL users, beside each document."""
    sql.register(d.sparkSession)
    return d.sparkSession.sql("SELECT d.doc_id, f.normalized, f.text_hash, f.language FROM {docs} d, LATERAL text_features(d.text) f", docs=d)


@query("customer", "nation", "region", sql="""WITH s AS (SELECT c.c_custkey, lower(c.c_mktsegment) AS seg, lower(r.r_name) AS reg FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT c_custkey, seg AS name, 'town' AS kind, 1 AS words, 1 AS "at" FROM s UNION ALL SELECT c_custkey, reg, 'state', CAST(len(string_split(reg, ' ')) AS INTEGER), 2 FROM s""")
def sql_places(c: DataFrame, n: DataFrame, r: DataFrame) -> DataFrame:
    """The table function of places over sentences that name a customer's segment and region; segments stand for towns that need a capital."""
    towns = c.select(F.lower("c_mktsegment").alias("name"), F.lit("town").alias("kind"), F.lit(True).alias("ambiguous")).distinct()
    sql.register_places(c.sparkSession, towns.unionByName(r.select(F.lower("r_name").alias("name"), F.lit("state").alias("kind"), F.lit(False).alias("ambiguous"))))
    where = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    said = c.join(where, c.c_nationkey == where.n_nationkey).select("c_custkey", F.concat(F.lit("in "), F.initcap("c_mktsegment"), F.lit(", "), F.lower("r_name")).alias("said"))
    return c.sparkSession.sql("SELECT s.c_custkey, p.name, p.kind, p.words, p.at FROM {said} s, LATERAL places_in(s.said) p", said=said)
