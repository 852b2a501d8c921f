import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from timeloom.llm import embeddings as E
from timeloom.llm import pii
from timeloom.llm.components import components
from timeloom.llm.queries import op2_embedding_near_dups, op3_pii_random_field

VEC = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) else None for _, v in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(n)]
    least = [r[0] for r in rows]
    while True:
        new = [min([least[i], *(least[j] for j in linked[i])]) for i in range(n)]
        if new == least:
            break
        least = new
    return sorted((rows[i][0], len(linked[i]), least[i], rows[i][0] == least[i]) for i in range(n))


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + r.normal(size=16) * (0.05 if i % 3 else 0.4)).tolist()) for i in range(150)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, []), (205, [1.0, 0.0]), (206, [2.0, 0.0]), (3, rows[3][1]), (207, [float("inf")] + [0.0] * 15), (208, [1e-30] * 16), (209, [1e30] * 16)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("tile", [4096, 20, 7])
def test_embeddings(spark, vectors, tile):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], VEC).withColumns({c: F.lit(1) for c in ("row", "root", "n", "tile", "u", "ok", "n_links")})
    assert sorted(map(tuple, E.embedding_near_dups(df, tile=tile).collect())) == brute(vectors)


def test_no_embeddings(spark):
    assert E.embedding_near_dups(spark.createDataFrame([], VEC)).collect() == []
    with pytest.raises(ValueError):
        E.embedding_near_dups(spark.createDataFrame([], VEC), threshold=0.0)


def test_error_bound_holds():
    r = np.random.default_rng(3)
    u = E._unit(r.normal(size=(400, 64)) * r.exponential(size=(400, 64)) ** 3)
    q, a, n, e = E.quantise(u)
    estimate = (q.astype(float) @ q.T.astype(float)) * a[:, None] * a
    bound = n[:, None] * e + e[:, None] * (n + e)
    assert (np.abs(estimate - u @ u.T) <= bound + 1e-12).all()
    full = (u @ u.T >= 0.3) & ~np.tri(400, dtype=bool)
    i, j, sure = (np.concatenate(x) for x in zip(*E._near((q, a, n, e), (q, a, n, e), 0.3, True)))
    linked = E._exact(u, u, i, j, 0.3)
    assert linked[sure].all() and not sure.all() and not linked.all() and sure.any()
    assert sorted(zip(i[linked].tolist(), j[linked].tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(full))))


def test_folded_links():
    r = np.random.default_rng(2)
    i, j = r.integers(0, 300, 200), r.integers(0, 300, 200)
    links = E._Links(300)
    for k in range(0, 200, 30):
        links.add(i[k : k + 30], j[k : k + 30])
    assert (links.root == E.local_roots(300, i, j)).all() and (links.n == np.bincount(np.r_[i, j], minlength=300)).all()


def test_vectors_near_the_threshold(spark):
    """Pairs at 0.9 and a little off it, which the bounds leave in doubt, in single and double precision."""
    r = np.random.default_rng(4)
    a = E._unit(r.normal(size=(60, 32)))
    b = E._unit(r.normal(size=(60, 32)))
    b = E._unit(b - (a * b).sum(1, keepdims=True) * a)
    cos = 0.9 + r.choice([0, 1e-7, -1e-7, 0.004, -0.004], 60)
    rows = [(k, x.tolist()) for k, x in enumerate(np.r_[a, cos[:, None] * a + np.sqrt(1 - cos**2)[:, None] * b])]
    for kind in ("float", "double"):
        exact = [(k, [float(np.float32(x)) for x in v] if kind == "float" else v) for k, v in rows]
        # a pair at exactly 0.9 may round to either side, but the same way in both
        got = {x[0]: x for x in map(tuple, E.embedding_near_dups(spark.createDataFrame(exact, f"vec_id bigint, embedding array<{kind}>"), tile=50).collect())}
        want = {x[0]: x for x in brute(exact)}
        clear = [k for k in range(60) if cos[k] != 0.9]
        assert all(got[k] == want[k] and got[k + 60] == want[k + 60] for k in clear)


def test_embeddings_query(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    u = E._unit(np.array(rows.embedding.tolist(), float))
    linked = u @ u.T >= 0.9
    n = dict(zip(rows.vec_id, linked.sum(1) - 1))
    assert {r.vec_id: r.n_links for r in op2_embedding_near_dups(spark, d).collect()} == n


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def by_patterns(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    r = random.Random(3)
    letters = "0123456789..  --+()@ab%_4111"
    for _ in range(20_000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == by_patterns(t), t
    assert pii.base_spans("1" * 200_000 + "@" * 1000 + "a" * 200_000) == []


@pytest.fixture(scope="module")
def field():
    return pii._trained(tuple((t, tuple(s)) for t, s in pii.labelled_examples()))


def test_field_on_unseen_examples(field):
    found = wrong = missed = 0
    for text, gold in pii.labelled_examples(300, seed=99):
        want = {s for s in gold if s[0] in ("phone", "email")}
        base = pii.base_spans(text)
        got = {s for s in [*base, *pii.added_spans(field, [text], [base])[0]] if s[0] in ("phone", "email")}
        found, wrong, missed = found + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert found / (found + wrong) > 0.95 and found / (found + missed) > 0.95


def test_viterbi_finds_the_best_path(field):
    from itertools import product

    shape, _, _, first = pii.tokens(["(212) 555"])
    s, begin = pii._padded(shape, first)
    e = field.emissions(s, begin[0] + np.arange(len(shape)))
    score = lambda p: field.begin[p[0]] + e[0, p[0]] + sum(field.moves[a, b] + e[t, b] for t, (a, b) in enumerate(zip(p, p[1:]), 1))
    best = max(product(range(len(pii.LABELS)), repeat=len(shape)), key=score)
    assert tuple(field.decode(shape, first)) == best


def plain_viterbi(field, text):
    """Step by step over the whole text, without sure tokens, stretches and cuts."""
    shape, _, _, first = pii.tokens([text])
    if not len(shape):
        return []
    s, begin = pii._padded(shape, first)
    e = field.emissions(s, begin[0] + np.arange(len(shape)))
    best, came = e[0] + field.begin, []
    for x in e[1:]:
        path = best[:, None] + field.moves
        came.append(path.argmax(0))
        best = path.max(0) + x
    out = [int(best.argmax())]
    for c in came[::-1]:
        out.append(int(c[out[-1]]))
    return out[::-1]


def test_sure_tokens_and_cuts_change_nothing(field, texts):
    r = random.Random(8)
    pieces = ["(212)", "555-1234", "tel.", "joe", "[at]", "mail", "[dot]", "com", "4532015112830366", "10.0.0.1", "und", "die", "+49", "0151/2345678", "-", "12", "id"]
    many = [" ".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(300)] + [t or "" for _, t in texts]
    many += [" ".join(r.choice(pieces) for _ in range(3000)), " ".join(str(r.randint(0, 99999)) for _ in range(4000))]
    shape, _, _, first = pii.tokens(many)
    got = field.decode(shape, first).tolist()
    assert [got[a:b] for a, b in zip(first, first[1:])] == [plain_viterbi(field, t) for t in many]


def test_tokens():
    text = "Tel. (212) 555\u00a0-x\u00e9y_9\u0663 \U0001f600"
    shape, start, end, first = pii.tokens(["", text, "a " * 5])
    assert [text[a:b] for a, b in zip(start[: first[2]], end[: first[2]])] == ["Tel", ".", "(", "212", ")", "555", "-", "x\u00e9y", "_", "9", "\u0663", "\U0001f600"]
    assert first.tolist() == [0, 0, 12, 17] and len(set(shape[12:].tolist())) == 1
    part, pii.PART = pii.PART, 7
    try:
        again = pii.tokens(["", text, "a " * 5])
    finally:
        pii.PART = part
    assert all((x == y).all() for x, y in zip(again, (shape, start, end, first)))


def test_long_runs_of_digits(spark, field):
    odd = ["0" * 5000 + ".1.1.1", "1." * 3000, "+" + "1 " * 5000, "9" * 100_000, "a@" * 5000 + "b.c"]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string"), field).collect()
    # the patterns by hand; Python reads no number of more than 4,300 digits at once
    assert {r.doc_id: [tuple(s) for s in r.base] for r in got} == {0: [("ip", 0, 5006)], 1: by_patterns(odd[1]), 2: [], 3: [], 4: by_patterns(odd[4])}


def test_spans_that_are_no_addresses(field):
    """What the field calls an address may be any text with three dots; its parts are numbers, or it is none."""
    assert pii._valid("ip", "0192.168.0.255") and pii._valid("ip", "0" * 5000 + ".1.1.1")
    assert not any(pii._valid("ip", s) for s in ("ip.1.2.3", "255.)..168", "1.2.3.", "1 .2.3.4", "-1.2.3.4", "1_0.2.3.4", "\u0661.2.3.4", "\u00b2.1.1.1", "1.2.3.256", "1.2.3", "1.2.3.4.5"))
    odd = ["-.\u00b2@ .192.+ dota1\u2013\xa0-0192%%/at\u2013dot", "\u2013-,\u00bd@ 255.)..168dot12. ", "+... version\u0663123v-123+.\u00b2@1..\u2013", "255. %x.12.comdot+2551234\u0663+dot168168"]
    assert [pii.added_spans(field, [t], [pii.base_spans(t)])[0] for t in odd] == [[]] * 4


def test_gain_on_other_notations(field):
    """A labelled set that the training's templates don't make: what the field adds to the patterns."""
    r = random.Random(12)
    names, places = ["maria", "tom", "li", "svenja"], ["posteo", "acme", "fizz"]
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    plain = [lambda: f"{r.choice(names)} at {r.choice(places)} dot {r.choice(['com', 'net'])}", lambda: f"{r.choice(names)} AT {r.choice(places)} DOT org"]
    phones = [lambda: f"({r.randint(201, 989)}) {n(3)}-{n(4)}", lambda: f"{r.randint(201, 989)}-{n(3)}-{n(4)}", lambda: f"0{n(3)}/{n(7)}"]
    mails = [lambda: f"{r.choice(names)} [at] {r.choice(places)} [dot] net", lambda: f"{r.choice(names)}.{r.choice(names)}(at){r.choice(places)}.org"]
    clean = ["Room 12 opens on 2024-03-05 at 14:30.", "Chapter 3, pages 120-145, costs 1,299.00 euros", "item 44 (of 90) at gate 7", "the years 1914-1918 and 1939-1945", "SELECT 1 FROM t WHERE id = 12345", "They met at noon near the red dot.", "Look at the dot on page 3."]
    lead = ["Write to ", "You may reach us under ", "Our number: ", "Questions? ", ""]
    cases = []
    for _ in range(300):
        kind, make = r.choice([("phone", phones), ("email", mails), ("email", plain)])
        before, s = r.choice(lead), r.choice(make)()
        cases.append((f"{before}{s} {r.choice(clean)}", (kind, len(before), len(before) + len(s))))
    hit = base_hit = wrong = 0
    for text, gold in cases:
        base = pii.base_spans(text)
        added = pii.added_spans(field, [text], [base])[0]
        base_hit, hit, wrong = base_hit + (gold in base), hit + (gold in base + added), wrong + len(set(added) - {gold})
    assert base_hit < 0.1 * len(cases) and hit > 0.85 * len(cases) and wrong < 0.05 * len(cases), (base_hit, hit, wrong)
    assert not any(pii.added_spans(field, [c], [[]])[0] for c in clean)


def test_bars(monkeypatch):
    """A bar stands between the spans that are right often enough and the first that would spoil it; without a wrong one it stays at its least."""
    m = pii.RandomField(*[None] * 4)
    texts = [(f"t{i}", [("phone", 0, 1)] if ok else []) for i, ok in enumerate((1, 1, 1, 0, 1, 0))]
    found = [[("phone", 0, 1, p)] for p in (0.95, 0.9, 0.8, 0.7, 0.65, 0.2)]
    monkeypatch.setattr(pii, "_decoded", lambda m, texts: [found[int(t[1:])] for t in texts])
    assert abs(pii.calibrated(m, texts, 0.9).bars["phone"] - 0.75) < 1e-9 and m.bars["email"] == pii.BAR
    assert pii.calibrated(m, texts[:3], 0.9).bars["phone"] == pii.BAR == pii.calibrated(m, texts[:5], 0.8).bars["phone"]
    assert pii.calibrated(m, texts[3:4], 0.9).bars["phone"] == 0.99 and pii.calibrated(m, []).bars["phone"] == pii.BAR


def test_probabilities_are_those_of_all_paths(field):
    """Of a short text, by going through all of its paths."""
    from itertools import product

    shape, _, _, first = pii.tokens(["(212) 555"])
    s, begin = pii._padded(shape, first)
    e = field.emissions(s, begin[0] + np.arange(len(shape)))
    weight = lambda p: field.begin[p[0]] + e[0, p[0]] + sum(field.moves[a, b] + e[t, b] for t, (a, b) in enumerate(zip(p, p[1:]), 1))
    paths = list(product(range(len(pii.LABELS)), repeat=len(shape)))
    z = np.exp([weight(p) for p in paths])
    b = pii.LABELS.index("B-phone")
    for i, n in ((0, 4), (0, 2), (1, 3), (2, 1)):
        path = np.array([b] + [b + 1] * (n - 1))
        want = sum(x for p, x in zip(paths, z) if p[i : i + n] == tuple(path) and (i + n == len(shape) or p[i + n] != b + 1)) / z.sum()
        assert abs(field.probability(s, begin[0] + i, i, len(shape) - i - n, path) - want) < 1e-9


def test_pii_table(docs, odd_docs, no_docs, texts, field):
    for frame in (docs, odd_docs):
        got = pii.find_pii(frame, field).collect()
        assert sorted((r.doc_id, [tuple(s) for s in r.base]) for r in got) == sorted((i, by_patterns(t)) for i, t in texts)
        assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    masked = {r.doc_id: r.masked for r in pii.find_pii(docs, field).collect()}
    assert masked[1] is None and masked[80] == "Mail <EMAIL> or <IP>, card <CARD>, call <PHONE> <|endoftext|> don't"
    assert pii.find_pii(no_docs, field).collect() == []
    assert pii.find_pii(odd_docs, field, keep=tuple(odd_docs.columns)).count() == len(texts)


def test_pii_query(spark, data):
    digest = lambda s: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        s = by_patterns(r.text)
        want.append((r.doc_id, *(sum(x[0] == k for x in s) for k in pii.KINDS), digest(s)))
    assert sorted(tuple(r)[:6] for r in op3_pii_random_field(spark, data).collect()) == sorted(want)


def test_stages(docs, no_docs, spark, texts):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup by shared shingles", "substring dedup", "PII", "best-fit packing"]
    for stage in list(stages.values())[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, no_docs, "").collect() == []
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in stages["language ID"](spark, docs, "").collect()} >= {1, 2, 3}
    kept = [r.doc_id for r in stages["near-dedup by shared shingles"](spark, docs, "").collect()]
    assert not set(range(50, 56)) & set(kept) and not {60, 61, 62} & set(kept) and set(range(11, 35)) <= set(kept) and kept.count(10) == 2
    cut = {r.doc_id: r.text for r in stages["substring dedup"](spark, docs, "").collect()}
    assert cut[70] == dict(texts)[70] and all(len(cut[i].split()) == 17 for i in range(71, 75)) and cut[1] is None
    assert "<EMAIL>" in {r.doc_id: r.text for r in stages["PII"](spark, docs, "").collect()}[80]
    assert stages["best-fit packing"](spark, docs, "").count() >= len(texts)


def test_personal_data_stage_on_texts_of_dots(spark, docs):
    """Texts of which the field takes parts for addresses that aren't numbers go through the stage as they are."""
    odd = [(1, "-.\u00b2@ .192.+ dota1\u2013\xa0-0192%%/at\u2013dot"), (2, "255. %x.12.comdot+2551234\u0663+dot168168"), (3, "at 10.0.0.255 now")]
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in odd], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    masked = stages["PII"](spark, rows, "")
    assert {r.doc_id: r.text for r in masked.collect()} == {1: odd[0][1], 2: odd[1][1], 3: "at <IP> now"}
    assert stages["best-fit packing"](spark, masked, "").count() == 3


CLASHING = ("score", "lang_pred", "n_words", "n_removed", "kept_text", "base", "spans", "masked", "_key", "_again", "k", "marks", "component_id", "block")


def test_stages_keep_columns_of_any_name(docs, spark):
    """Extra columns named like results or helpers come back with the values that they had."""
    from pyspark.sql import functions as F

    extra = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHING}).withColumn("a.b", F.col("doc_id"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, "")
        assert out.columns == extra.columns
        rows = out.collect()
        assert len(rows) > 20 and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHING) and all(r["a.b"] == r.doc_id for r in rows)


def test_pipeline(spark, data):
    out = corpus_pipeline.run(spark, data)
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert ids <= source.keys() and len(ids) >= len(set(source.values())) * 0.9
    first = {}
    for i in sorted(source):
        first.setdefault(source[i], i)
    assert all(first[source[i]] == i for i in ids)  # one of each group of exact copies
