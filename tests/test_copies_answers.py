"""Copies that are compared by digests, and model answers that a ledger keeps."""

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import models
from timeloom.sources import schemas, tables
from timeloom.sources.schemas import _differing, reconcile, reconcile_counts

KIND = "id int, x double, t string, v array<float>, b binary"


def copy(spark, change=None, n=400):
    r = random.Random(3)
    rows = [[i, r.choice([None, r.random(), float("nan"), 0.0]), r.choice([None, "", "a", "bc"]), [r.random()], bytes([r.randint(0, 3)])] for i in range(n)]
    for i, column, value in change or []:
        rows[i][column] = value
    return spark.createDataFrame([tuple(x) for x in rows], KIND).repartition(3)


def test_equal_copies_join_nothing(spark):
    a, b = copy(spark), copy(spark)
    assert _differing(a, b, "id", ["x", "t", "v", "b"], 12) == []
    assert reconcile(a, b, "id").collect() == []
    assert tuple(reconcile_counts(a, b, "id").first()) == (400, 400, 0, 0, 0)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_each_difference_is_found(spark, monkeypatch, levels):
    """With and without digests: a float's last digit, null for empty, a value in another column, bytes, and rows of one side."""
    monkeypatch.setattr(schemas, "LEVELS", levels)
    a = copy(spark, [(5, 1, 0.5), (6, 2, None), (7, 1, None), (7, 2, "a"), (8, 4, b"\x00"), (9, 1, 0.0)])
    b = copy(spark, [(5, 1, 0.5000000000000001), (6, 2, ""), (7, 1, None), (7, 2, "a"), (8, 4, b"\x00\x00"), (9, 1, -0.0)])
    found = {r.id: (r.difference, r.columns) for r in reconcile(a.where("id <> 20"), b.where("id not in (21, 22)"), "id").collect()}
    assert found == {5: ("values", ["x"]), 6: ("values", ["t"]), 8: ("values", ["b"]), 20: ("right", None), 21: ("left", None), 22: ("left", None)}
    if levels == 2:
        monkeypatch.setattr(schemas, "LEAF_BITS", 2)  # most ranges differ, so that all rows are joined
        assert {r.id for r in reconcile(a, b.where("id % 3 > 0"), "id").where("difference = 'left'").collect()} == {i for i in range(400) if i % 3 == 0}


def asker(tmp_path, fails=()):
    """A model that leaves a file for each text it is asked about, and may stop the whole job."""
    import uuid

    def fn(rows):
        out = []
        for r in rows:
            (tmp_path / f"{r['text']}-{uuid.uuid4().hex}").touch()
            if r["text"] in fails:
                raise KeyboardInterrupt
            out.append({"vector": [float(len(r["text"]))], "cost_usd": 1.0})
        return out

    return fn


def asked(tmp_path):
    return sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())


def test_a_stopped_job_asks_the_rest(spark, tmp_path):
    """Waves that were finished before the stop aren't asked again."""
    (tmp_path / "asked").mkdir()
    s = spark.createDataFrame([(i, "t" * (1 + i % 9), None if i % 2 else f"o{i % 5}") for i in range(60)], "id int, transcript string, ocr_text string").repartition(2)
    columns, ledger = {"transcript": "tv", "ocr_text": "ov"}, f"file://{tmp_path}/ledger"
    with pytest.raises(Exception, match="."):
        models.embed_columns(s, columns, asker(tmp_path / "asked", fails={"ttttt"}), ledger, wave=2, batch=1)
    before = asked(tmp_path / "asked")
    kept = {r.text for r in spark.read.parquet(ledger).collect()}
    assert 0 < len(kept) < 14 and kept <= set(before)
    out, answers = models.embed_columns(s, columns, asker(tmp_path / "asked"), ledger, wave=2)
    texts = {"t" * n for n in range(1, 10)} | {f"o{n}" for n in range(5)}
    again = asked(tmp_path / "asked")
    assert all(again.count(t) == before.count(t) for t in kept) and {r.text for r in answers.collect()} == texts
    for _ in range(2):  # a whole job run again asks nothing
        out, answers = models.embed_columns(s, columns, asker(tmp_path / "asked"), ledger)
        assert all(r.tv == [float(len(r.transcript))] and r.ov == (None if r.ocr_text is None else [2.0]) for r in out.collect()) and out.count() == 60
    assert asked(tmp_path / "asked") == again and answers.count() == len(texts) == 14


def test_failures_are_asked_again(spark, tmp_path):
    s, ledger, answers = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, t string"), f"file://{tmp_path}/ledger", {"bad": False}

    def fn(ok):
        def ask(rows):
            if not ok and any(r["text"] == "bad" for r in rows):
                raise ValueError("no")
            return [{"vector": [1.0], "cost_usd": 1.0} for _ in rows]

        return ask

    for ok, want in ((False, {1: [1.0], 2: None}), (True, {1: [1.0], 2: [1.0]}), (False, {1: [1.0], 2: [1.0]})):
        out, answers = models.embed_columns(s, {"t": "v"}, fn(ok), ledger)
        assert {r.id: r.v for r in out.collect()} == want
    assert answers.where("error is null").count() == 2


def test_a_text_of_many_rows_is_looked_up_by_weight(spark, monkeypatch):
    """A text that most rows have is broadcast to them; no row is lost or doubled."""
    s = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "same").when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("x"), (F.col("id") % 2000).cast("string"))).alias("t"))
    out, _ = models.embed_columns(s, {"t": "v"}, lambda rows: [{"vector": [float(len(r["text"]))], "cost_usd": 0.0} for r in rows])
    assert "Broadcast" in out._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    n = out.select(F.count("*"), F.count_if(F.col("v")[0] == F.length("t")), F.count_if(F.col("v").isNull() & (F.col("t") == ""))).first()
    assert n[0] == 30_000 and n[1] + n[2] == 30_000


def test_queries_and_documents_are_kept(spark, tmp_path):
    calls = []
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query string")
    give = lambda rows: [{"zh": None, "en": r["query"] + "e", "cost_usd": 1.0} for r in rows]
    vec = lambda rows: [{"vector": [1.0], "cost_usd": 0.5} for _ in rows]

    def never(rows):
        raise KeyboardInterrupt

    ledger = f"file://{tmp_path}/ledger"
    first = [sorted(map(tuple, df.collect())) for df in models.prepare_queries(q, give, vec, ledger)]
    again = [sorted(map(tuple, df.collect())) for df in models.prepare_queries(q, never, never, ledger)]
    assert first == again and len(first[0]) == 4 and not calls
    m = spark.createDataFrame([(1, "m"), (2, "n")], "video_id int, material string")
    made = models.write_documents(m, lambda rows: [{"document_json": '{"doc_type": "sop"}', "cost_usd": 1.0} for _ in rows], never, ledger).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, models.write_documents(m, never, never, ledger).collect())) and len(made) == 2
    assert tables.shared_path(spark, "x").startswith("file:")
