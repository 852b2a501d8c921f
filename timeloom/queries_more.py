"""Queries over whole tables that go through the finer points: every order of the library, all texts of the material, CJK terms, downloads, reports, table schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import extract_terms
from .operators import catalogue, material, quality
from .plans import reports
from .queries import ORACLE, STOP, VID, _evaluated_parts, _round, query
from .sources.adapters import segments, table, videos
from .sources.schemas import load_table
from .sources.tables import shared_path

_ORDERS = {"title": "title", "segment_count": "coalesce(segment_count, 0)", "cost_usd": "coalesce(cost_usd, 0)", "analyzed_at": "coalesce(analyzed_at, created_at)"}
_LIBRARY = VID.replace("o_orderkey % 100 AS segment_count, o_totalprice AS cost_usd", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 END AS segment_count, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS cost_usd")


@query(f"WITH {_LIBRARY} " + " UNION ALL ".join(f"SELECT '{c} {w}' AS sorted, id, row_number() OVER (ORDER BY {e} {w}, id) AS place FROM vi" for c, e in _ORDERS.items() for w in ("ASC", "DESC")))
def library_orders(spark, d):
    """Every video's place in the library by each key in both directions; some have no count and some no cost."""
    i = F.col("id")
    v = videos(spark, d).withColumns({"segment_count": F.when(i % 5 > 0, F.col("segment_count")), "cost_usd": F.when(i % 3 > 0, F.col("cost_usd"))})
    own = lambda c: v.select("id", c, *(["created_at"] if c == "analyzed_at" else []))
    each = [catalogue.library_places(own(c), c, w == "DESC").select(F.lit(f"{c} {w}").alias("sorted"), "id", "place") for c in _ORDERS for w in ("ASC", "DESC")]
    return reduce(DataFrame.unionByName, each)


@query(
    """WITH s AS (SELECT doc_id, CAST(substr(source, 4) AS INT) AS video_id, doc_id * 12 AS sec, text FROM documents),
c AS (SELECT video_id, sec, CASE WHEN doc_id % 3 = 0 THEN 'scene ' || doc_id WHEN doc_id % 3 = 1 THEN ' N/A ' END AS v0, CASE WHEN video_id % 4 = 1 AND doc_id % 7 > 1 THEN 'thanks for  watching' ELSE text END AS t0, CASE WHEN doc_id % 5 = 0 THEN ' LOGO' WHEN doc_id % 5 < 4 THEN 'sign ' || doc_id END AS o0 FROM s),
e AS (SELECT video_id, sec, trim(regexp_replace(coalesce(v0, ''), '\\s+', ' ', 'g')) AS v, trim(regexp_replace(coalesce(t0, ''), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(o0, ''), '\\s+', ' ', 'g')) AS o FROM c),
f AS (SELECT video_id, sec, CASE WHEN lower(v) = 'n/a' THEN '' ELSE v END AS v, t, o FROM e),
junk AS (SELECT video_id FROM (SELECT video_id, t, count(*) AS n FROM f WHERE t <> '' GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 8 AND max(n) / sum(n) > 0.4),
mark AS (SELECT video_id, o FROM (SELECT video_id, o, count(*) AS n, sum(count(*)) OVER (PARTITION BY video_id) AS total FROM f WHERE o <> '' GROUP BY 1, 2) WHERE total >= 8 AND n / total > 0.15),
p AS (SELECT f.video_id, sec, concat_ws('；', CASE WHEN v <> '' THEN '畫面：' || v END, CASE WHEN t <> '' AND junk.video_id IS NULL THEN '字幕：' || t END, CASE WHEN f.o <> '' AND mark.o IS NULL THEN '畫面文字：' || f.o END) AS x FROM f LEFT JOIN junk ON junk.video_id = f.video_id LEFT JOIN mark ON mark.video_id = f.video_id AND mark.o = f.o)
SELECT video_id, sec AS line_sec, md5('[' || lpad((sec // 60)::VARCHAR, greatest(2, length((sec // 60)::VARCHAR))::INT, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') || '｜' || sec || ' 秒] ' || x) AS line FROM p WHERE x <> ''"""
)
def material_of_all_texts(spark, d):
    """Lines of material with descriptions, transcripts and on-screen texts: placeholders, the transcripts of sources that mostly repeat one, and watermarks are left out."""
    i = F.col("id")
    s = segments(spark, d, wrap=False).withColumns({
        "visual_description": F.when(i % 3 == 0, F.concat(F.lit("scene "), i.cast("string"))).when(i % 3 == 1, " N/A "),
        "transcript": F.when((F.col("video_id") % 4 == 1) & (i % 7 > 1), "thanks for  watching").otherwise(F.col("transcript")),
        "ocr_text": F.when(i % 5 == 0, " LOGO").when(i % 5 < 4, F.concat(F.lit("sign "), i.cast("string"))),
    })
    lines = material.material_lines(material.build_material(s, include_ocr=True))
    return lines.select("video_id", "line_sec", F.md5("line").alias("line"))


@query(
    f"""WITH q AS (SELECT doc_id, lang || '機器人' || CASE doc_id % 4 WHEN 0 THEN '在工廠的焊接robot' || doc_id WHEN 1 THEN '，沒有作業員。FRAME 2' WHEN 2 THEN ' 組裝、檢查和包裝' ELSE '是x的y' END || substr(text, 1, length(text)) AS t FROM documents),
w AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(t, '[A-Za-z0-9]+'), string_split_regex(t, '{STOP}')), lambda x: length(x) >= 2))) AS l FROM q)
SELECT doc_id, len(l) AS n, md5(array_to_string(l, ' ')) AS terms FROM w"""
)
def cjk_terms(spark, d):
    """Terms of whole texts behind phrases in Chinese, with stop characters, clause marks and words of both scripts."""
    i = F.col("doc_id")
    more = F.when(i % 4 == 0, F.concat(F.lit("在工廠的焊接robot"), i.cast("string"))).when(i % 4 == 1, "，沒有作業員。FRAME 2").when(i % 4 == 2, " 組裝、檢查和包裝").otherwise("是x的y")
    terms = F.array_sort(extract_terms(F.concat("lang", F.lit("機器人"), more, "text")))
    q = table(spark, d, "documents").select("doc_id", F.explode(F.array(terms)).alias("l"))
    return q.select("doc_id", F.size("l").cast("bigint").alias("n"), F.md5(F.array_join("l", " ")).alias("terms"))


@query(
    """WITH r AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL), jobs AS (SELECT url, page_id % 3 = 0 AS active FROM pages)
SELECT url AS source_url FROM r WHERE url NOT IN (SELECT url FROM jobs WHERE active AND url IS NOT NULL) AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0 AND url IS NOT NULL)"""
)
def admitted_downloads(spark, d):
    """Requests to download every page's address: without those that a running job or a video has, each once."""
    p, i = table(spark, d, "pages"), F.col("page_id")
    none = F.lit(None).cast("int").alias("video_id")
    requests = p.where("url is not null").select(F.lit("download").alias("job_type"), none, F.col("url").alias("source_url"))
    jobs = p.select(F.lit("download").alias("job_type"), none, F.col("url").alias("source_url"), F.when(i % 3 == 0, "queued").otherwise("failed").alias("status"))
    return catalogue.admit_jobs(requests, jobs, p.where(i % 5 == 0).select(F.col("url").alias("source_url"))).select("source_url")


def _reported(spark, d):
    """conversations as videos with documents and segments, from which the report makes steps and lines itself."""
    c, n = table(spark, d, "conversations"), F.length("text")
    step = F.struct((n * 7 % 900).cast("double").alias("timestamp_sec"), F.col("role").alias("heading"), F.lit("x").alias("detail"))
    steps = c.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("s")).agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", step.alias("v"))))).alias("x"))
    section = F.struct(F.lit("h").alias("heading"), F.transform("x", lambda x: x["v"]).alias("steps"))
    docs = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", section.alias("v")))).alias("y"))
    missing = c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "system", "u")).alias("u"))
    whole = F.struct(F.lit("sop").alias("doc_type"), F.transform("y", lambda x: x["v"]).alias("sections"), F.col("u").alias("uncovered"))
    v = docs.join(missing, "conv_id").select(F.col("conv_id").alias("id"), F.lit(600).alias("duration_sec"), F.to_json(whole).alias("document_json"))
    none = F.lit(None).cast("string")
    s = c.select(F.col("conv_id").alias("video_id"), (n * 13 % 700).cast("double").alias("start_sec"), none.alias("visual_description"), F.concat(F.col("turn").cast("string"), F.md5("text")).alias("transcript"), none.alias("ocr_text"))
    return reports.coverage_report(v, s)


@query(ORACLE["document_coverage"])
def coverage_reported(spark, d):
    """The coverage report of whole documents and segments, as one call."""
    return _reported(spark, d)[0]


@query(f"WITH c AS ({ORACLE['document_coverage']}) SELECT count(*) AS videos, count(*) FILTER (material_coverage >= 0.9) AS well_covered, count(*) FILTER (gaps_over_limit = 0) AS without_gap, CAST(sum(over_length) AS BIGINT) AS over_length, CAST(sum(off_grid) AS BIGINT) AS off_grid, CAST(sum(steps) AS BIGINT) AS steps FROM c")
def coverage_report_summary(spark, d):
    return _reported(spark, d)[1]


_WORD = "list_element([" + ", ".join(f"'{w}'" for words in quality.RATES.values() for w in words[:2]) + f"], CAST(1 + doc_id % {sum(len(w[:2]) for w in quality.RATES.values())} AS INT))"
_RATED = {r: " OR ".join(f"contains(t, '{w}')" for w in words) for r, words in quality.RATES.items()}


@query(
    f"""WITH s AS (SELECT CAST(substr(source, 4) AS INT) AS video_id, CAST(doc_id % 3 AS INT) AS vlm_frame_count, text || CASE WHEN doc_id % 2 = 0 THEN {_WORD} ELSE '' END AS t FROM documents)
SELECT vlm_frame_count, video_id, CAST(grouping(vlm_frame_count, video_id) AS BIGINT) AS grouping_level, count(*) AS n, round(avg(length(t)), 1) AS avg_length, """
    + ", ".join(f"round(avg(({c})::INT), 4) AS {r}" for r, c in _RATED.items())
    + " FROM s WHERE coalesce(t, '') <> '' GROUP BY GROUPING SETS ((), (vlm_frame_count), (video_id))"
)
def quality_reported(spark, d):
    """The quality report, with words of its own lists behind every second text."""
    words = [w for ws in quality.RATES.values() for w in ws[:2]]
    i = F.col("id")
    more = F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(w) for w in words]), (1 + i % len(words)).cast("int"))).otherwise("")
    s = segments(spark, d).select("video_id", (i % 3).cast("int").alias("vlm_frame_count"), F.concat("transcript", more).alias("visual_description"))
    return reports.quality_report(s).withColumn("grouping_level", F.col("grouping_level").cast("bigint"))


@query(ORACLE["golden_eval"])
def golden_reported(spark, d):
    """The evaluation's report, as one call."""
    out = reports.golden_report(*_evaluated_parts(spark, d))[1]
    return _round(out, *out.columns)


@query(f"WITH {VID} SELECT CAST(id AS INT) AS id, title, CAST(duration_sec AS INT) AS duration_sec, CASE WHEN id % 2 = 0 THEN status END AS status, round(CASE WHEN id % 2 = 0 THEN cost_usd END, 2) AS cost_usd, NULL::VARCHAR AS document_json FROM vi")
def loaded_videos(spark, d):
    """The table of videos from files of which half were written before some columns were there."""
    path, v = shared_path(spark, "videos"), videos(spark, d)
    v.where("id % 2 = 0").select("id", "title", "duration_sec", "status", "cost_usd").write.parquet(path)
    v.where("id % 2 <> 0").select("id", "title", "duration_sec").write.mode("append").parquet(path)
    return _round(load_table(spark, path, "videos").select("id", "title", "duration_sec", "status", "cost_usd", "document_json"), "cost_usd", digits=2)
