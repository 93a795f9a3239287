"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hard_negatives, langid, line_dedup, maxscore, media, near_dedup, packing, suffix_dedup, token_files, toxicity, whitening
from .scratch import stored
from .session import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(folds: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows, _tokenizer("byte_bpe_50k.json")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs.select("doc_id", "text"), fit_toxicity(docs, labels)).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Machine:
    taught = labels.where(fold(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(toxicity.sample(docs.select("doc_id", "text"), taught))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, _tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = stored(media.text_images(table(spark, sf_dir, "documents")), "media")
    sized = images.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    out = stored(media.features(sized, extra=media.payload_digests, extra_schema=media.PAYLOAD), "tiles")  # NPY tiles are written and read back
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", "dhash", F.md5("tile")).alias("feature"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(fold(4) != 2).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), profiles).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text`` has the remaining bytes as a text, with a replacement character for what is left of a cut character."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), every=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), every=100, label=label)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long can hold is an error."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_toxicity,
        op3_benchmark_decontamination,
        op4_packing,
        op5_media_columns,
        op6_language_id,
        op7_line_dedup,
        op8_minhash_near_dedup,
        op9_suffix_array_dedup,
        op10_token_files,
        op11_maxscore_search,
        op12_hard_negatives,
        op13_embedding_whitening,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Rows of embeddings that take part, as whole numbers; rows are told apart by their place.
_VECTORS = """with whole as (
    select row_number() over () as place, vec_id, {label} as label, [floor(256 * x::double) for x in embedding] as v from embeddings
    where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
)"""

ORACLES = {
    "op11_maxscore_search": _VECTORS.format(label="0") + """, scored as (
    select a.place, a.vec_id as query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint as score from whole a join whole b on a.place <> b.place where a.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by place order by score desc, vec_id) as rank from scored) where rank <= 5""",
    "op12_hard_negatives": _VECTORS.format(label="case when vec_id % 7 = 0 then (label + 1) % 10 else label end") + """, scored as (
    select a.place, a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
    from whole a join whole b on a.place <> b.place where a.vec_id % 100 = 0 and a.label is not null and b.label is not null
),
positives as (select *, row_number() over (partition by place order by score desc, other) as i from scored where same),
negatives as (
    select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.place, p.i order by s.score desc, s.other) as rank
    from positives p join scored s on p.place = s.place and not s.same where p.i <= 5 and 80 * p.score <= 100 * s.score and s.score <= p.score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 5""",
    "op1_chat_formatting": r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), written as (
    select *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') as r, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') as t from rows
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length(r) + length(t) + length('<|turn|><|text|><|end|>'))::bigint as formatted_chars
from written group by conv_id""",
    "op3_benchmark_decontamination": f"""
with items as (select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null),
windows as (
    select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
    from items, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as g(i) where len(w) > 0
),
docs as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
sizes as (select distinct k from windows),
places as (
    select rid, i, k, array_to_string(w[i : i + k - 1], ' ') as win from docs, sizes, unnest(generate_series(1, len(w) - k + 1)) as g(i)
),
hits as (select p.rid, p.i, p.k, v.item_id from places p join windows v on p.k = v.k and p.win = v.win),
hit_words as (select rid, count(distinct j) as n_hit from hits, unnest(generate_series(i, i + k - 1)) as g(j) group by rid),
hit_items as (select rid, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as items_sha256 from (select distinct rid, item_id::varchar as s from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit_words using (rid) left join hit_items using (rid)""",
}
