"""Each stage of the corpus pipeline on odd rows, and the five in order."""

from pyspark.sql import functions as F

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node int"
EN, DE = "the cat sat on the mat and the dog ran off ", "der hund lief durch den wald und die katze schlief "


def docs(spark):
    rows = [(i, f"{EN * 3}w{i} x{i} y{i} z{i} " + EN * 2, "en", "s", 1, 1) for i in range(30)] + [(100 + i, f"{DE * 3}w{i} v{i}", "de", None, 1, 1) for i in range(30)]
    rows += [(200, None, None, None, None, None), (201, "", None, None, 0, 1), (202, "123 !", None, None, 5, 1), (203, EN * 4000, "en", "s", 1, 1), (204, EN * 4000, "en", "s", 1, 1), (0, rows[0][1], "en", "s", 1, 1), (None, EN * 5, "en", "s", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids(df):
    return sorted(r[0] if r[0] is not None else -1 for r in df.select("doc_id").collect())


def test_language(spark):
    got = p.known_language(spark, docs(spark), "")
    assert got.columns == docs(spark).columns and ids(got) == sorted([-1, 0, *range(30), *range(100, 130), 203, 204])


def test_toxicity(spark, tmp_path):
    rows = [(i, "vile words here" if i % 3 == 0 else "calm words there", "en", "s", 1, 1) for i in range(300)] + [(900, None, None, None, None, None), (901, "", None, None, 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = p.not_toxic(spark, df, str(tmp_path))
    assert got.columns == df.columns and {i for i in ids(got) if i < 300} == {i for i in range(300) if i % 3}


def test_near_copies(spark):
    df = docs(spark)
    got = p.one_of_each_group(spark, df, "")
    sets = {}
    for r in df.where("doc_id is not null").collect():
        w = [x.lower() for x in (r.text or "").split()]
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    assert got.columns == df.columns and set(ids(got)) == {i for i, x in root.items() if i == x} | {-1}


def test_passages_and_packing(spark):
    df = docs(spark)
    left = p.no_repeated_passages(spark, df, "")
    assert left.columns == df.columns and 204 not in ids(left) and {0, 200, 201, 202}.issubset(ids(left))
    assert left.where("doc_id = 1").first().n_chars == len(left.where("doc_id = 1").first().text)
    packed = p.packed(spark, left, "")
    assert packed.select("doc_id").distinct().count() == left.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in p.STAGES] == ["language_id", "toxicity", "ngram_jaccard", "substring_dedup", "packing"]
    assert all(stage(spark, none, str(tmp_path)).count() == 0 for _, stage in p.STAGES)
