"""The queries of the numbered operators and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm import common as c
from hazardspark.llm import chat_format, collocations, context_mixing, embedding_dedup, language_id, ngram_jaccard, packing, sentencepiece_lattice, substring_dedup, suffix_dedup, topk, toxicity, whitening


def crc_mod(n: int, id: str = "doc_id"):
    return F.crc32(F.col(id).cast("string")) % n


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(c.table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(c.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of the text decoded from them."""

    def digests(batches):
        table = sentencepiece_lattice.pieces(sentencepiece_lattice.default_model()).bytes
        for batch in batches:
            ids = batch.column("ids")
            off, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy().astype("<u4"))
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            sha = [hashlib.sha256(b"".join([table[i] for i in flat[a:b].tolist()])[1:]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(sha)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    found = sentencepiece_lattice.encode(c.table(spark, sf_dir, "documents"))
    return found.mapInArrow(c.lean(digests), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod(3) != 1))
    return language_id.identify(docs, model).select("doc_id", (crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(c.table(spark, sf_dir, "documents")))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    found = context_mixing.score(docs, crc_mod(5) != 1)
    return found.select("doc_id", (crc_mod(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(c.table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(c.table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, sf_dir: str, language: language_id.LanguageId, train) -> toxicity.Toxicity:
    labels = c.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(train)
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text").where(train)
    return toxicity.fit(docs, labels, language)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    train = crc_mod(4) != 2
    model = toxicity_model(spark, sf_dir, language_id.fit(docs.where(train)), train)
    return toxicity.score(docs, model).select("doc_id", (crc_mod(4) == 2).alias("held_out"), "score", "predicted")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.read_back(chat_format.examples(turns))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 largest components; a deviation beyond 64 bits is null here, and exact in the operator."""
    return whitening.whitened(c.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that start anywhere else, too."""
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(c.table(spark, sf_dir, "documents"), size=200))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language, of all documents."""
    return collocations.collocations(c.table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_topk": op2_topk,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_context_mixing": op7_context_mixing,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op12_suffix_dedup": r"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
sized as (select doc_id, h, length(h) // 2 n from docs),
starts as (select doc_id, unnest(range(0, n - 199)) s, h from sized where n >= 200),
win as (select doc_id, s, md5(substr(h, 2 * s + 1, 400)) w from starts),
again as (select doc_id, s from win where w in (select w from win group by w having count(*) > 1)),
marked as (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 200 then 0 else 1 end fresh from again),
runs as (select doc_id, g, min(s) a, max(s) + 200 b from (select *, sum(fresh) over (partition by doc_id order by s) g from marked) group by doc_id, g),
cuts as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) before from runs),
gone as (select doc_id, sum(b - a)::bigint removed, count(*) spans, max(b) last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) head from cuts join sized using (doc_id) group by doc_id)
select d.doc_id, d.n n_bytes, coalesce(removed, 0) n_removed, coalesce(spans, 0) n_spans,
  sha256(unhex(case when g.doc_id is null then h else head || substr(h, 2 * last + 1) end)) kept_sha256 from sized d left join gone g using (doc_id)""",
    "op13_collocations": r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
words as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
f as (select lang, k, phrase, count(*) f from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase
  from words, (values (1), (2), (3), (4), (5)) t(k) where len(w) >= k) group by all),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
cand as (select *, string_split(phrase, ' ') w from f where k > 1 and f >= 100),
inside as (select lang, phrase, max(f) longer from (select lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) phrase from cand where k > 2) group by all),
kept as (select cand.* from cand left join inside using (lang, phrase) where longer is null or longer < f),
cuts as (select lang, phrase, k, f, w, unnest(range(1, k)) head from kept),
scored as (select c.lang, c.phrase, c.f a, x.f l, y.f r, n.n, c.head, ((1000::hugeint * c.f * n.n) // (x.f::hugeint * y.f))::bigint score from cuts c join n on c.lang = n.lang
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.head], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.head + 1:c.k], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, head) = 1)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from best) where rank <= 2000""",
}
