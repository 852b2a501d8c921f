"""Terms, keyword scores, vectors and fusion."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.functions.scoring import hit_source_label
from timeloom.functions.text import bigrams, clean_text, extract_terms, negative_text, nfkc, positive_text, strip_generic_terms
from timeloom.operators import dense, fusion, sparse, trigrams
from timeloom.plans.hybrid import hybrid_search
from timeloom.sources.tables import stage


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "q string").select(column(F.col("q")).alias("x")).first().x


def test_query_strings(spark):
    assert one(spark, extract_terms, "FRAME 焊接robot arm 的機械手臂，a") == ["FRAME", "robot", "arm", "焊接", "機械手臂"]
    assert one(spark, extract_terms, "要真人的畫面") == ["真人", "畫面"]
    assert one(spark, extract_terms, "") == []
    assert one(spark, strip_generic_terms, " 找機器人的片段 ") == "找機器人的"
    assert one(spark, strip_generic_terms, "畫面") == "畫面"
    q = "工廠，不要機器人。沒有汽車"
    assert one(spark, negative_text, q) == "機器人 汽車"
    assert one(spark, positive_text, q) == "工廠，" + " " * 5 + "。" + " " * 4
    assert one(spark, positive_text, "工廠") == "工廠" and one(spark, negative_text, "工廠") == ""
    assert one(spark, bigrams, "人員作業") == ["人員", "員作", "作業"]
    assert one(spark, clean_text, " a \n b　c ") == "a b c" and one(spark, clean_text, " N/A ") == "" and one(spark, clean_text, None) == ""
    assert spark.createDataFrame([("ＡＢ　 c",)], "t string").select(nfkc("t")).first()[0] == "AB c"


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id int, video_id int, content string")


def terms(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, term string, scope array<int>")


def test_bm25_order_scope_and_limit(spark):
    s = corpus(spark, [(1, 1, "FRAME 畫面"), (2, 1, "FRAME"), (3, 1, "其他 100%")])
    got = sparse.bm25(terms(spark, (1, "FRAME", None), (1, "畫面", None)), s).orderBy("score").collect()
    assert [r.id for r in got] == [1, 2]
    many = corpus(spark, [(i, 1, "機器人機器人機器人") for i in range(10)] + [(99, 2, "一個機器人" + "很長" * 50)])
    t = terms(spark, (1, "機器人", None), (2, "機器人", [2]), (3, "機器人", []))
    got = [(r.query_id, r.id) for r in sparse.bm25(t, many, limit=3).collect()]
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 99)]
    idf = corpus(spark, [(i, 1, "無關") for i in range(20)] + [(50, 2, "有目標"), (51, 2, "無")])
    score = {r.query_id: r.score for r in sparse.bm25(terms(spark, (1, "目標", None), (2, "目標", [2])), idf).collect()}
    assert score[1] < score[2] < 0
    # every character of a term stands for itself
    assert [r.id for r in sparse.term_hits(terms(spark, (1, "0%", None), (2, "_", None)), s).collect()] == [3]


def test_term_routing_and_short_terms(spark):
    s = corpus(spark, [(i, 1, "人員 汽車") for i in range(2)] + [(10, 1, "汽車")] * 1 + [(i, 1, "汽車") for i in range(20, 30)])
    q = spark.createDataFrame([(1, "人員作業 汽車", None)], "query_id int, query string, scope array<int>")
    routed = {(r.term, r.channel) for r in sparse.route_terms(sparse.query_terms(q), s).collect()}
    assert routed == {("人員", "like"), ("員作", "like"), ("作業", "like"), ("汽車", "like")}
    cand = s.select(F.lit(1).alias("query_id"), "id")
    assert {(r.id, r.score) for r in sparse.sparse_channel(q, s, cand).collect()} == {(0, -1e6), (1, -1e6)}


def test_terms_of_long_texts(spark):
    """Long runs of one script don't exhaust the stack."""
    text = "word " * 60_000 + "焊接 " + "的" * 60_000
    assert one(spark, extract_terms, text) == ["word", "焊接"]


def test_negation(spark):
    s = corpus(spark, [(1, 1, "工廠裡的機器人"), (2, 1, "工廠"), *[(i, 1, "x") for i in range(3, 9)]])
    q = spark.createDataFrame([(1, "工廠，不要機器人", None), (2, "工廠", None)], "query_id int, query string, scope array<int>")
    cand = s.select("id").join(q.select("query_id"))
    left = {(r.query_id, r.id) for r in sparse.exclude_negated(q, s, cand).collect()}
    assert (1, 1) not in left and (2, 1) in left and len(left) == 15


def test_every_way_to_look_for_terms_finds_the_same(spark, monkeypatch):
    """Few terms, the automaton in one pass and in several, a stored index, and one with rows of several streams' batches; with terms that overlap, that other
    case lengthens, and an empty one."""
    r = random.Random(1)
    s = corpus(spark, [(i, i % 3, "".join(r.choice("abC 漢\U0001d4b3%İ") for _ in range(r.randint(0, 30)))) for i in range(120)] + [(200, 1, "aaaa aaa"), (201, 0, "")])
    words = ["".join(r.choice("abc漢\U0001d4b3%İ") for _ in range(r.randint(1, 4))) for _ in range(40)] + ["aa", "aaa", "aaaaaa", ""]
    t = terms(spark, *[(i, w, [None, [0, 2], []][i % 3]) for i, w in enumerate(words)])
    rows = lambda df: sorted((x.query_id, x.term, x.id, x.len, round(x.tf, 6)) for x in df.collect())
    scanned = rows(sparse.term_hits(t, s))
    assert scanned and {(x[1], x[2], x[4]) for x in scanned} >= {("aa", 200, 3.0)} or any(x[1] == "aa" for x in scanned)
    monkeypatch.setattr(sparse, "FEW_TERMS", 1)
    assert rows(sparse.term_hits(t, s)) == scanned
    monkeypatch.setattr(sparse, "PATTERN_CHARS", 20)
    assert rows(sparse.term_hits(t, s)) == scanned
    monkeypatch.setattr(trigrams, "ID_BLOCK", 32)
    monkeypatch.setattr(trigrams, "CHARS", 100)
    index = trigrams.build_trigram_index(s)
    assert rows(sparse.term_hits(t, s, index)) == scanned
    grown = trigrams.postings(s.repartition(4))
    assert grown.count() > index.count() == index.select("gram", "block").distinct().count()
    assert rows(sparse.term_hits(t, s, grown)) == scanned
    monkeypatch.setattr(trigrams, "MOST_NAMED", 2)
    assert rows(sparse.term_hits(t, s, index)) == scanned
    monkeypatch.setattr(trigrams, "MOST_PAIRS", 2)
    monkeypatch.setattr(trigrams, "MOST_FOUND", 2)
    assert rows(sparse.term_hits(t, s, index)) == scanned
    assert rows(sparse.term_hits(t.limit(0), s, index)) == []


def test_an_index_reads_the_wanted_grams_only(spark, tmp_path):
    s = corpus(spark, [(i, 0, f"text {i} about things") for i in range(500)])
    trigrams.write_index(trigrams.build_trigram_index(s), f"{tmp_path}/index")
    rows = trigrams._wanted_rows(trigrams.read_index(spark, f"{tmp_path}/index"), None, ["abo", "out"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,abo)" in plan and "EqualTo(gram,out)" in plan and "Join" not in plan
    assert {r.gram for r in rows.collect()} == {"abo", "out"} and rows.agg(F.sum(F.size("ids"))).first()[0] == 1000


def test_many_terms_take_one_pass(spark):
    """50,000 terms: one scan of the segments in the plan, and not many times the time of 200."""
    s = stage(corpus(spark, [(i, 0, " ".join(f"w{(i * 7 + k) % 90_000}" for k in range(60))) for i in range(400)]))
    took = {}
    for n in (200, 50_000):
        t = terms(spark, *[(1, f"w{i} ", None) for i in range(n)])
        hits = sparse.term_hits(t, s)
        assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        at = time.perf_counter()
        found = hits.count()
        took[n] = time.perf_counter() - at
        assert found == sum(1 for i in range(400) for k in range(59) if (i * 7 + k) % 90_000 < n)
    assert took[50_000] < 10 * took[200] + 3


def test_vector_scores(spark, monkeypatch):
    r = np.random.default_rng(2)
    v, q = r.normal(size=(60, 8)), r.normal(size=(9, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 8)], "id int, vector array<float>")
    queries = spark.createDataFrame([(i // 3, i % 3, x.tolist()) for i, x in enumerate(q)], "query_id int, variant int, vector array<float>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (unit(v) @ unit(q).T).reshape(60, 3, 3).max(2)
    monkeypatch.setattr(dense, "MAX_QUERIES", 4)
    got = {(x.query_id, x.id): x.score for x in dense.vector_scores(queries, rows).collect()}
    assert len(got) == 3 * 61 and got[0, 101] == 0
    assert all(abs(got[k, i] - want[i, k]) < 1e-6 for i in range(60) for k in range(3))
    top = dense.cosine_topk(queries, rows, 5).collect()
    assert [(x.rank, x.id) for x in sorted((x for x in top if x.query_id == 1), key=lambda x: x.rank)] == [(n + 1, i) for n, i in enumerate(np.argsort(-want[:, 1])[:5])]
    assert dense.vector_scores(queries.limit(0), rows).collect() == []


def test_the_best_rows_of_a_task(spark, monkeypatch):
    """However often a task sorts out what it holds, each query's best rows are there, and ties go by id."""
    r = np.random.default_rng(5)
    v = [r.choice([-1.0, 0.0, 1.0], 3).tolist() for _ in range(300)]
    rows = stage(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, vector array<double>").coalesce(1))
    queries = spark.createDataFrame([(i, 0, r.normal(size=3).tolist()) for i in range(5)], "query_id int, variant int, vector array<double>")
    want = sorted(map(tuple, dense.cosine_topk(queries, rows, 7).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(dense, "HELD", 10)
    monkeypatch.setattr(dense, "MOST_SCORES", 60)
    assert sorted(map(tuple, dense.cosine_topk(queries, rows, 7).select("query_id", "rank", "id").collect())) == want and len(want) == 35
    every = sorted(((x.query_id, -round(x.score, 9), x.id) for x in dense.vector_scores(queries, rows).collect()))
    best = [x for k in range(5) for x in [y for y in every if y[0] == k][:7]]
    assert [(q, i) for q, _, i in best] == [(q, i) for q, _, i in want]


def test_relevant_videos(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.35), (1, 3, 0.34), (2, 1, 0.05), (2, 2, 0.01), (3, 1, 0.9)], "query_id int, video_id int, score double")
    relevant = dense.relevant_videos(s)
    assert {tuple(r) for r in relevant.collect()} == {(1, 1), (1, 2)}
    assert dense.prefilter_videos(s, relevant).count() == 2 + 2 + 1


def test_relevant_videos_by_their_vectors(spark, monkeypatch):
    """The same as from all pairs, for batches of a few rows: videos without an id, repeated rows, a query with one video only."""
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 6)) * 2
    rows = [(i, i % 12 if i % 7 else None, (centre[i % 12] + r.normal(size=6)).tolist()) for i in range(90)]
    rows += [rows[3], (200, 5, None), (201, 6, [0.0] * 6), (None, 2, rows[2][2])]
    v = spark.createDataFrame(rows, "id int, video_id int, vector array<double>").repartition(3)
    q = v.where("id % 9 = 3").dropDuplicates(["id"]).selectExpr("id as query_id", "0 as variant", "vector")
    pairs = dense.vector_scores(q, v.select(F.struct("id", "video_id").alias("key"), "vector"), "key").where("not key.id <=> query_id")
    best = pairs.groupBy("query_id", F.col("key.video_id").alias("video_id")).agg(F.round(F.max("score"), 9).alias("score"))
    want = sorted(map(str, dense.relevant_videos(best, margin=0.3).collect()))
    assert want and sorted(map(str, dense.relevant_of_vectors(q, v, margin=0.3).collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    monkeypatch.setattr(dense, "MAX_QUERIES", 4)
    assert sorted(map(str, dense.relevant_of_vectors(q, v, margin=0.3).collect())) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = v.where("video_id = 3")
    assert dense.relevant_of_vectors(q, one).count() == 0 and dense.relevant_of_vectors(q.limit(0), v).count() == 0


def test_labels_and_floors(spark):
    rows = [(0.9, 0.88, 0.5, "字幕＋畫面"), (0.9, 0.87, None, "字幕"), (0.9, 0.89, 0.88, "綜合"), (None, None, 0.1, "OCR"), (None, None, None, "畫面")]
    df = spark.createDataFrame(rows, "transcript_score double, visual_score double, ocr_score double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", hit_source_label()).collect())
    f = spark.createDataFrame([(0.4, 0.1), (0.39, 0.1), (0.4, 0.09)], "similarity double, fusion_score double")
    assert fusion.quality_filter(f).count() == 1


def scored(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id int, video_id int, start_sec double, similarity double")


def test_equal_sparse_scores_share_their_rank(spark):
    d = scored(spark, [(1, i, 1, float(i), 1 - i / 100) for i in range(1, 21)])
    s = spark.createDataFrame([(1, i, -1e6) for i in (7, 8, 9)], "query_id int, id int, score double")
    got = {r.id: r.fusion_score for r in fusion.rrf(d, s).collect()}
    assert all(abs(got[i] - (1 / (5 + i) + (1 / 7 if i in (7, 8, 9) else 0))) < 1e-12 for i in range(1, 21))


@pytest.mark.parametrize("seed", range(4))
def test_pruned_ranks_equal_sorted_ones(spark, seed):
    r = random.Random(seed)
    rows, found = [], []
    for q in range(12):
        n = r.choice([1, 5, 40, 150])
        rows += [(q, i, r.randint(1, 3), float(r.randint(0, 5)), round(r.random(), r.choice([1, 2, 6]))) for i in range(n)]
        found += [(q, i, r.choice([-1e6, -float(r.randint(0, 3)), -r.random() * 9])) for i in range(n) if r.random() < r.choice([0.1, 0.9])]
    d, s = scored(spark, rows), spark.createDataFrame(found, "query_id int, id int, score double")
    keep = lambda x: sorted((y.query_id, y.id, y.dense_rank, y.sparse_rank, round(y.fusion_score, 12)) for y in x.where("fusion_score >= 0.1").collect())
    full, pruned = fusion.rrf(d, s), fusion.rrf_pruned(d, s)
    norm = lambda x: [tuple(-1 if v is None else v for v in t) for t in keep(x)]
    assert norm(full) == norm(pruned)
    conf = lambda x: sorted(map(tuple, fusion.is_confident(x).collect()))
    assert conf(full) == conf(pruned)
    assert fusion.rank_bound() == 15 and pruned.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 60


def test_hybrid_search(spark):
    """Four-dimensional vectors: cosines by hand."""
    none = None
    rows = [
        (1, 1, 0.0, 10.0, "機器人 焊接", "", "", [1.0, 0.0, 0.0, 0.0], none, none),
        (2, 1, 10.0, 20.0, none, "汽車", "", none, [1.0, 1.0, 0.0, 0.0], none),
        (3, 2, 0.0, 10.0, "", none, "", [1.0, 5.0, 0.0, 0.0], none, none),
        (4, 2, 10.0, 20.0, "沒有向量 機器人", none, none, none, none, none),
    ]
    s = spark.createDataFrame(rows, "id int, video_id int, start_sec double, end_sec double, transcript string, visual_description string, ocr_text string, transcript_embedding array<float>, visual_embedding array<float>, ocr_embedding array<float>")
    from timeloom.sources.schemas import with_content

    s = with_content(s)
    assert s.where("id = 3").first().content == "  "
    videos = spark.createDataFrame([(1, "第一")], "id int, title string")
    events = spark.createDataFrame([(3, [1.0, 0.1, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])], "segment_id int, embedding array<float>")
    q = spark.createDataFrame([(1, "機器人畫面", None), (2, "汽車", [1]), (3, "x", []), (4, "汽車，不要機器人", None)], "query_id int, query string, scope array<int>")
    vec = spark.createDataFrame([(i, 0, [1.0, 0.0, 0.0, 0.0]) for i in range(1, 5)], "query_id int, variant int, vector array<float>")
    results, summary = hybrid_search(q, vec, s, videos, events)
    got = {(r.query_id, r.segment_id): r for r in results.collect()}
    assert [got[1, i].rank for i in (1, 3, 2)] == [1, 2, 3]
    assert got[1, 3].hit_source == "OCR" and got[1, 3].video_title == "未知影片" and got[1, 1].video_title == "第一"
    assert got[1, 2].description == "汽車" and abs(got[1, 2].similarity - 0.5**0.5) < 1e-6
    assert {k[1] for k in got if k[0] == 2} == {1, 2} and not any(k[0] == 3 for k in got)
    assert (4, 1) not in got
    info = {r.query_id: (r.n_results, r.is_confident) for r in summary.collect()}
    assert info[1] == (3, True) and info[3] == (0, False)
    plain, _ = hybrid_search(q, vec, s, videos, events, prune=False)
    assert sorted((r.query_id, r.rank, r.segment_id) for r in plain.collect()) == sorted((k[0], v.rank, k[1]) for k, v in got.items())
    narrowed, _ = hybrid_search(q, vec, s, videos, events, video_vectors=spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])], "video_id int, vector array<float>"), sparse_scope="prefiltered")
    assert {r.video_id for r in narrowed.where("query_id = 1").collect()} == {2}


def test_search_without_all_pairs_gives_the_sorted_results(spark, monkeypatch):
    """Scopes, negations, short and unknown terms, events, missing vectors and equal scores: as from all pairs, sorted."""
    import random

    from timeloom.operators import pruned

    monkeypatch.setattr(pruned, "HELD", 10)
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "q7", "zz"]
    unit = [[1.0 if i == j else 0.0 for i in range(4)] for j in range(4)]
    vec = lambda: r.choice([None, r.choice(unit), [r.randint(-3, 3) / 1.0 for _ in range(4)]])
    rows = [(i, i % 5, float(i % 7), float(i % 7 + 5), " ".join(r.choice(words[:4]) for _ in range(4)) + (" q7" if i % 11 == 0 else ""), None, None, vec(), vec(), vec()) for i in range(240)]
    s = spark.createDataFrame(rows, "id int, video_id int, start_sec double, end_sec double, transcript string, visual_description string, ocr_text string, transcript_embedding array<float>, visual_embedding array<float>, ocr_embedding array<float>").repartition(3)
    from timeloom.sources.schemas import with_content

    s = with_content(s)
    events = spark.createDataFrame([(i % 260, r.choice(unit) if i % 9 else None) for i in range(80)], "segment_id int, embedding array<float>")
    asked = [(1, "alpha，不要beta", None), (2, "gamma q7", [0, 1, 2]), (3, "unknown zz", None), (4, "delta alpha", []), (5, "沒有delta", [3, 4])]
    q = spark.createDataFrame(asked, "query_id int, query string, scope array<int>")
    vectors = spark.createDataFrame([(k, v, r.choice(unit)) for k, *_ in asked for v in range(2)], "query_id int, variant int, vector array<float>")
    videos = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "id int, title string")
    columns = ("query_id", "rank", "segment_id", "video_title", "similarity", "hit_source", "transcript_score", "ocr_score", "fusion_score")
    for top in (None, spark.createDataFrame([(i, unit[i % 4]) for i in range(5)], "video_id int, vector array<float>")):
        a, sa = hybrid_search(q, vectors, s, videos, events, top, min_similarity=-1.0)
        b, sb = hybrid_search(q, vectors, s, videos, events, top, min_similarity=-1.0, prune=False)
        got, want = (sorted(map(tuple, x.select(*columns).collect()), key=repr) for x in (a, b))
        assert got == want and len(got) > 20
        assert sorted(map(tuple, sa.collect())) == sorted(map(tuple, sb.collect()))


def test_queries_of_one_text_and_scope_ask_the_keywords_once(spark, monkeypatch):
    from timeloom.plans import hybrid
    from timeloom.sources.schemas import with_content

    rows = [(i, i % 3, float(i), i + 1.0, ("alpha " if i % 2 else "") + ("beta" if i % 5 else ""), None, None, [1.0, i % 7 / 7], None, None) for i in range(80)]
    s = with_content(spark.createDataFrame(rows, "id int, video_id int, start_sec double, end_sec double, transcript string, visual_description string, ocr_text string, transcript_embedding array<float>, visual_embedding array<float>, ocr_embedding array<float>"))
    q = spark.createDataFrame([(i, "alpha，不要beta" if i % 4 == 0 else "alpha", [0, 1] if i % 2 else None) for i in range(24)], "query_id int, query string, scope array<int>")
    # query 0 asks for others, but has no vector itself
    vectors = spark.createDataFrame([(i, 0, [1.0, i % 6 / 6]) for i in range(1, 24)], "query_id int, variant int, vector array<float>")
    videos, asked, real = spark.createDataFrame([(1, "t")], "id int, title string"), [], hybrid.sparse_channel
    monkeypatch.setattr(hybrid, "sparse_channel", lambda q, *a, **b: asked.append(q.count()) or real(q, *a, **b))
    got, summary = hybrid_search(q, vectors, s, videos)
    want, summed = hybrid_search(q, vectors, s, videos, prune=False)
    assert asked == [3, 24]
    columns = ("query_id", "rank", "segment_id", "fusion_score")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) != []
    assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, summed.collect()))


@pytest.mark.parametrize("name", ["rrf_fusion", "rrf_pruned", "rrf_fusion_all"])
def test_fusion_asks_the_keywords_once_and_joins_no_pairs(spark, data, monkeypatch, name):
    from timeloom import queries
    from timeloom.operators import dense

    def none(*a, **b):
        raise AssertionError("all pairs")

    monkeypatch.setattr(dense, "vector_scores", none)
    assert queries.QUERIES[name](spark, data).count() > 0


def test_text_events_go_with_their_segment(spark, monkeypatch):
    """No pair of a query and a segment is joined, but for segments with very many events."""
    from timeloom.operators import dense

    none = F.lit(None).cast("array<double>")
    s = spark.createDataFrame([(i, [1.0, float(i)] if i != 3 else None) for i in range(5)], "id bigint, transcript_embedding array<double>").withColumns({"visual_embedding": none, "ocr_embedding": none})
    e = spark.createDataFrame([(i % 7, [float(i), 1.0]) for i in range(40)] + [(3, None), (None, [1.0, 1.0])], "segment_id int, embedding array<double>")
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "query_id int, variant int, vector array<double>")
    norm = lambda df: sorted((r.query_id, r.id, *[None if r[c] is None else round(r[c], 12) for c in ("transcript_score", "ocr_score", "similarity")]) for r in df.collect())
    alone, real = [], dense.event_scores
    monkeypatch.setattr(dense, "event_scores", lambda *a: alone.append(1) or real(*a))
    with_them = norm(dense.dense_channel(q, s, e))
    assert not alone and len(with_them) == 10
    monkeypatch.setattr(dense, "MOST_EVENTS", 5)
    assert norm(dense.dense_channel(q, s, e)) == with_them and alone


def test_scores_in_videos_spread_a_video_over_tasks(spark, monkeypatch):
    from timeloom.operators import dense

    monkeypatch.setattr(dense, "PART_ROWS", 10)
    rows = [(i, 0 if i % 10 else None, [float(i % 7), 1.0, 0.0] if i % 9 else [0.0, 0.0, 0.0]) for i in range(100)]
    v = spark.createDataFrame(rows, "id int, video_id int, vector array<float>")
    got = dense.scores_in_videos(v.where("id % 20 = 1").withColumnRenamed("id", "query_id"), v).withColumn("_p", F.spark_partition_id()).collect()
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))
    assert len(got) == 5 * 90 and len({r._p for r in got}) >= 4
    assert all(abs(r.score - cos(rows[r.query_id][2], rows[r.id][2])) < 1e-9 for r in got)
