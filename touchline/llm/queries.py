"""The registered queries: each operator over its whole table, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import alignment, decontaminate, jaccard, kneser_ney, licenses, line_templates, permutation_index, sentencepiece_bpe, substrings, topk, urls, warc, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")

# The rules of the url query.
RULES = """select * from values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    as t(host, path, verdict)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_templates.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", F.col("t_lines").alias("n_lines"), F.col("t_dropped").alias("n_dropped"), F.sha2(F.coalesce("t_text", F.lit("")), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link(table(spark, sf_dir, "documents"), size=4, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id", "n_members")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.sql(RULES))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(sentencepiece_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL, check=True))


def pieces(encoded: DataFrame) -> DataFrame:
    """Digests of the struct ``pieces``, and whether the sentencepiece library gave the same ids and text."""
    ids = F.array_join(F.col("pieces.ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("pieces.ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("pieces.decoded", 256).alias("decoded_sha256"),
                          F.col("pieces.agrees").alias("agrees"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_LEVEL, MODEL)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "aligned.*").withColumn("groups_sha256", digest).drop("groups")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_permutation_index, op2_decontamination, op3_license_scan, op4_line_dedup, op5_substring_dedup, op6_jaccard_join,
    op7_url_filter, op8_sentencepiece, op9_quality_classifier, op10_warc, op11_alignment, op12_exact_topk, op13_whitening)}

# Words as the contracts define them: a pattern over bytes that RE2 takes as code points.
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(column: str, pattern: str, fold: bool) -> str:
    text = f"translate({column}, {_FOLD})" if fold else column
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
        with d as (select row_number() over () as r, doc_id, {_words("text", _ALNUM, True)} as w from documents),
        b as (select item_id, {_words("text", _ALNUM, True)} as w from benchmark where item_id is not null),
        items as (select distinct item_id, case when len(w) < 10 then w else w[i:i + 9] end as g
            from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
        sizes as (select distinct len(g) as n from items),
        starts as (select r, i, n, w[i:i + n - 1] as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
        met as (select s.r, s.i, s.n, t.item_id from starts s join items t on s.g = t.g),
        hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from met) group by r),
        named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
            from (select distinct r, item_id::varchar as item_id from met) group by r)
        select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
            sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hits using (r) left join named using (r)""",
    "op5_substring_dedup": f"""
        with d as (select doc_id, {_words("text", _SPACED, False)} as w from documents),
        starts as (select doc_id, i, w[i:i + 19] as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
        again as (select doc_id, i from starts qualify row_number() over (partition by g order by doc_id, i) > 1),
        gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from again),
        each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select e.doc_id, count(g.p) as n_removed, string_agg(e.word, ' ' order by e.p) filter (where g.p is null) as text
            from each e left join gone g on e.doc_id = g.doc_id and e.p = g.p group by e.doc_id)
        select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
        from d left join kept using (doc_id)""",
    "op7_url_filter": f"""
        with p as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        s as (select row_number() over () as r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_FOLD}) as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
        rules(h, t, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
        select page_id, host, path, h || t as rule, coalesce(v, 'allow') as verdict
        from s left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, t)
        qualify row_number() over (partition by r order by length(h || t) desc, v desc, h || t) = 1""",
    "op10_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        s as (select page_id, octet_length(payload)::bigint as n, sha1(payload) as digest from p),
        t as (select *, max(page_id) over (partition by digest, n) as top from s)
        select page_id, n as payload_bytes, digest as payload_digest, case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
            case when n >= 1000 and page_id <> top then top end as refers_to from t""",
    "op6_jaccard_join": f"""
        with recursive d as (select row_number() over () as r, doc_id, {_words("text", _SPACED, True)} as w from documents),
        grams as (select distinct r, case when len(w) < 4 then w else w[i:i + 3] end as g
            from (select r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from d where len(w) > 0)),
        sizes as (select r, count(*) as n from grams group by r),
        meet as (select a.r as a, b.r as b, count(*) as n from grams a join grams b on a.g = b.g and a.r <> b.r group by a.r, b.r),
        links as (select a, b from meet join sizes x on x.r = a join sizes y on y.r = b where 100 * meet.n >= 85 * (x.n + y.n - meet.n)),
        reach(a, b) as (select r, r from d union select reach.a, links.b from reach join links on links.a = reach.b),
        least as (select a as r, min(doc_id) as component_id, count(*) as n_members from reach join d on d.r = reach.b group by a)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, n_members::bigint as n_members
        from d join least using (r) left join sizes using (r)""",
    "op12_exact_topk": """
        with v as (select vec_id::bigint as id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
        s as (select q.id as query_id, v.id as vec_id, list_dot_product(q.x, v.x)::bigint as score
            from v q join v on q.id <> v.id and len(q.x) = len(v.x) where q.id % 100 = 0)
        select query_id, (row_number() over best)::integer as rank, vec_id, score from s
        window best as (partition by query_id order by score desc, vec_id) qualify row_number() over best <= 10""",
}
