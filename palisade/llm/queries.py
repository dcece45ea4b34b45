"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.llm import bpe_table, hnsw, language, lexical_search, license_join, ngram_join, packing, prefix_trie, surrogates, topk, toxicity, url_cascade, warc_bundles
from palisade.operators.urls import SUSPICIOUS_TLDS

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the query: host and path start.
ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]
PATH_LENGTHS = [1, 4, 5]


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda values: spark.createDataFrame([(v,) for v in values], "key string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    ruled = url_cascade.judge_urls(pages, keys(ALLOW), keys(BLOCK), PATH_LENGTHS).withColumnsRenamed({"rule": "own_rule", "rule_verdict": "own_verdict"})
    judged = url_cascade.judge_urls(ruled, keys([]), keys(SUSPICIOUS_TLDS), [0])
    verdict = F.coalesce("own_verdict", "rule_verdict", F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("own_rule").alias("rule"), verdict.alias("verdict"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), count_to="n_replaced")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.col("evidence.doc_id").alias("neighbours"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_table.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )



def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_bundles.write_bundles(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc_bundles.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    answers = language.identify(docs.select("doc_id", "text"), model)
    return answers.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _rows(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


def _url_sql() -> str:
    cut = lambda key, verdict: (key, key[: key.index("/")], key[key.index("/") :], verdict)
    rules = _rows([cut(k, "allow") for k in ALLOW] + [cut(k, "block") for k in BLOCK])
    return f"""
with rules(rule, rule_host, rule_path, verdict) as (values {rules}),
tlds(tld) as (values {_rows([(t,) for t in SUSPICIOUS_TLDS])}),
rest as (
  select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{license_join.LOWER[0]}', '{license_join.LOWER[1]}') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from rest
), best as (
  select *, (
    select arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) from rules
    where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  ) hit, (select count(*) from tlds where host = tld or ends_with(host, '.' || tld)) bad
  from parts
)
select page_id, host, path, hit.rule as rule, coalesce(hit.verdict, case when bad > 0 then 'block' else 'allow' end) as verdict from best
"""


def _license_sql() -> str:
    lower = lambda c: f"translate({c}, '{license_join.LOWER[0]}', '{license_join.LOWER[1]}')"
    places = []
    for phrase in license_join.PHRASES:
        words = phrase.split(" ")
        test = " and ".join(f"w[i + {k}] = '{v}'" for k, v in enumerate(words))
        places.append(f"list_filter(range(1, len(w) - {len(words)} + 2), lambda i: {test})")
    labels = " || ".join(f"case when len({p}) > 0 then ['{label}'] else [] end" for p, label in zip(places, license_join.PHRASES.values()))
    templates = ", ".join(f"('{label}', {sorted(set(t.split(' ')))})" for label, t in license_join.TEMPLATES.items())
    top, bottom = license_join.Fraction(license_join.THRESHOLD).as_integer_ratio()
    return f"""
with templates(label, t) as (values {templates}),
docs as (select row_number() over () r, doc_id, {lower("coalesce(text, '')")} lowered from documents),
words as (select r, doc_id, regexp_extract_all(lowered, '{license_join.WORD}') w from docs),
base as (
  select r, doc_id, len(w) n_words, {" || ".join(places)} spots, list_sort({labels}) own from words
), lines as (
  select r, list_distinct(regexp_extract_all(line, '{license_join.WORD}')) b from (select r, unnest(string_split(lowered, chr(10))) line from docs)
), met as (
  select r, label, max(len(list_intersect(t, b)) / len(t)) best from lines, templates
  where len(list_intersect(t, b)) * {bottom} >= {top} * len(t) group by r, label
), found as (select r, list(label) labels, max(best) best from met group by r)
select doc_id, cast(n_words as bigint) n_words, cast(len(spots) as bigint) n_base,
  cast(list_min(spots) - 1 as bigint) first_word, cast(list_max(spots) - 1 as bigint) last_word, array_to_string(own, ',') base_labels,
  array_to_string(list_sort(list_distinct(own || coalesce(labels, []))), ',') labels,
  case when len(spots) > 0 then 1.0::double else coalesce(best, 0.0)::double end score
from base left join found using (r)
"""


def _search_sql(k: int = 10) -> str:
    lower = lambda c: f"translate({c}, '{license_join.LOWER[0]}', '{license_join.LOWER[1]}')"
    return f"""
with docs as (
  select row_number() over () r, doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{license_join.WORD}') w from documents
), totals as (select count(*) nd, sum(len(w)) nt from docs where len(w) > 0),
wanted as (
  select distinct item_id, unnest(regexp_extract_all({lower("coalesce(text, '')")}, '{license_join.WORD}')) term from benchmark
), tf as (
  select r, term, count(*) tf from (select r, unnest(w) term from docs) where term in (select term from wanted) group by all
), weights as (
  select term, cast(floor(1000 * ln((2.0 * nd + 2) / (2.0 * count(*) + 1))) as bigint) weight from tf, totals group by term, nd
), scores as (
  select item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * nd) // nt)))) as bigint) score
  from wanted join tf using (term) join weights using (term) join docs using (r), totals group by item_id, r, doc_id
), ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) "rank", doc_id, score from scores where score > 0
)
select item_id, "rank", doc_id, score from ranked where "rank" <= {k}
"""


def _trie_sql() -> str:
    bits = "list_reduce(range(8), lambda y, b: case when y % 2 = 1 then xor(y >> 1, 3988292384) else y >> 1 end, xor({}, ascii(ch)::bigint))"
    crc = f"xor(list_reduce(string_split(cast(conv_id as varchar), ''), lambda x, ch: {bits.format('x')}, 4294967295::bigint), 4294967295::bigint)"
    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') "role", coalesce(text, '') "text" from conversations where conv_id is not null
), own as (
  select conv_id, list({{'r': "role", 't': "text"}} order by turn nulls first, "role", "text") own, {crc} % 9 h from turns group by conv_id
), rebuilt as (
  select o.conv_id, coalesce(b.own[1:o.h], []) || o.own[o.h + 1:] seq from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 5
), prefixes as (
  select conv_id, d, seq[1:d] pre, len(seq) = d ends from (select conv_id, seq, unnest(range(len(seq) + 1)) d from rebuilt)
), nodes as (
  select d, pre, min(conv_id) conv_id, count(*) n_convs, case when d = 0 then 0 else strlen(pre[d]['t']) end bytes,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) ends_sha256
  from prefixes group by d, pre
), kids as (
  select p.conv_id, p.d, any_value(u.conv_id) parent_conv_id, count(distinct k.conv_id) n_children
  from nodes p left join nodes k on k.d = p.d + 1 and k.pre[1:p.d] = p.pre left join nodes u on u.d = p.d - 1 and u.pre = p.pre[1:p.d - 1]
  group by p.conv_id, p.d
), subtrees as (
  select p.conv_id, p.d, count(*) filter (k.n_children = 0) n_leaves, sum((s.n_convs - 1) * s.bytes) saved
  from nodes p join nodes s on s.d >= p.d and s.pre[1:p.d] = p.pre join kids k on k.conv_id = s.conv_id and k.d = s.d group by p.conv_id, p.d
)
select n.conv_id, cast(n.d as bigint) "depth", parent_conv_id, n_convs, cast(n_children as bigint) n_children, cast(n_leaves as bigint) n_leaves,
  cast(saved as bigint) saved_tokens, ends_sha256
from nodes n join kids k on k.conv_id = n.conv_id and k.d = n.d join subtrees t on t.conv_id = n.conv_id and t.d = n.d
"""


_ALL = (
    op1_url_cascade,
    op2_surrogates,
    op3_best_fit_packing,
    op4_license_join,
    op5_ngram_jaccard_join,
    op6_toxicity_neighbours,
    op7_exact_top_k,
    op8_bpe_round_trip,
    op9_warc_bundles,
    op10_hnsw_near_duplicates,
    op11_prefix_trie,
    op12_ranked_search,
    op13_language,
)
QUERIES = {query.__name__: query for query in _ALL}
ORACLE: dict[str, str] = {
    "op1_url_cascade": _url_sql(),
    "op4_license_join": _license_sql(),
    "op11_prefix_trie": _trie_sql(),
    "op12_ranked_search": _search_sql(),
    "op7_exact_top_k": """
with good as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) score
  from good q join good c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank", vec_id, score from pairs
)
select query_id, "rank", vec_id, score from ranked where "rank" <= 5
""",
}
