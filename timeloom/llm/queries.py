"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, pii
from .automaton import bpe_round_trip
from .codes import codebooks_sha256, vector_codes, with_group_error
from .common import load
from .embeddings import embedding_near_dups
from .licenses import scan_licenses
from .matroska import matroska_features, store_matroska
from .packing import pack_documents
from .resampling import importance_resample
from .simhash import simhash_near_dups
from .substrings import substring_dedup
from .token_counts import count_tokens
from .urls import judge_urls


def op1_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dups(load(spark, sf_dir, "documents"))


def op2_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dups(load(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_pii_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_*: how many spans of the patterns; n_added: how many more the field finds."""
    found = pii.find_pii(load(spark, sf_dir, "documents"), pii.train(pii.labelled_table(spark)))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    added = (F.size("spans") - F.size("base")).cast("bigint").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), added)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), cap=2048)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), limit=4096)


def op6_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska_features(store_matroska(load(spark, sf_dir, "documents")))


def op7_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_round_trip(load(spark, sf_dir, "documents"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = languages.train(docs.where(~languages.held_out()))
    return languages.identify(docs, model).select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(load(spark, sf_dir, "embeddings"), group_col="label")
    return with_group_error(coded).select("vec_id", "code", "error", F.col("group_error").alias("label_error"), F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dups, op2_embedding_near_dups, op3_pii_random_field, op4_best_fit_packing, op5_token_counts, op6_matroska_media, op7_url_language_models, op8_bpe_automaton, op9_substring_dedup, op10_language_filters, op11_vector_codes, op12_importance_resampling, op13_license_scans)}

def _codes_sql(rounds: int = 4) -> str:
    """The rounds one after the other: a<r> assigns every part to the nearest entry of c<r>, of which c<r+1> are the means."""
    first = """WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT r, (j - 1) // (len(e) // 4) AS part, (j - 1) % (len(e) // 4) AS i, CAST(floor(1024 * e[j]) AS BIGINT) AS x FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS j FROM kept)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, i, x AS c FROM x WHERE r <= 256)"""
    assign = """a{r} AS MATERIALIZED (SELECT r, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (SELECT x.r, x.part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{r} USING (part, i) GROUP BY ALL) GROUP BY 1, 2)"""
    update = """c{n} AS MATERIALIZED (SELECT part, entry, i, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM x JOIN a{r} USING (r, part) GROUP BY 1, 2, 3) USING (part, entry, i))"""
    steps = [first] + [t.format(r=r, n=r + 1) for r in range(rounds) for t in (assign, update)] + [assign.format(r=rounds)]
    return ",\n".join(steps) + f""",
codes AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
books AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry, i)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (r), books"""


#: CRC-32 over the bytes of each different feature, by a table that SQL makes itself.
_RESAMPLED = """WITH table_ AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT -row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
u AS MATERIALIZED (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM (SELECT r, w FROM d UNION ALL SELECT r, w FROM b)),
h AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)])), 4294967295) % 10000 AS k FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM u)), table_),
n AS (SELECT g.k, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM range(10000) AS g(k) LEFT JOIN (SELECT r, k FROM u JOIN h USING (f)) USING (k) GROUP BY 1),
a AS (SELECT sum(s)::DOUBLE AS sa, sum(t)::DOUBLE AS ta FROM n),
gain AS (SELECT k, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sa + 10000) / ((s + 1.0::DOUBLE) * (ta + 10000)))) AS BIGINT) AS g FROM n, a),
v AS (SELECT r, CAST(floor(sum(g) / count(*)) AS BIGINT) AS w FROM u JOIN h USING (f) JOIN gain USING (k) WHERE r > 0 GROUP BY 1),
z AS (SELECT r, doc_id, len(d.w) AS words, greatest(2 * len(d.w) - 1, 0) AS n_features, coalesce(v.w, 0) AS weight, coalesce(v.w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN v USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 25 // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (r)"""


#: The others need hashes, models and tokenizers that SQL lacks.
ORACLE: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_importance_resampling": _RESAMPLED,
    "op2_embedding_near_dups": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id WHERE r.root < l.b)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id""",
    "op9_substring_dedup": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM w),
k AS (SELECT *, CASE WHEN count(*) OVER x = 13 THEN string_agg(word, ' ') OVER x END AS win FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) AS f FROM k),
g AS (SELECT doc_id, i, word, bool_or(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id""",
}
