"""Classifiers, language model, nearest neighbours, near duplicates and the pipeline against brute force and held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terrane.llm import ann, lm, near_dedup, quality, toxicity
from terrane.llm.common import prepared


@pytest.fixture(scope="module")
def tables(spark):
    prepared(spark)
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return {n: read(n) for n in ("documents", "labels", "embeddings")}


def held_out(rows, labels, target):
    truth = {r["doc_id"]: r[target] for r in labels.collect()}
    return [(r, truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]


def test_quality_on_held_out_rows(spark, tables):
    rows = quality.score_documents(tables["documents"], tables["labels"]).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    pairs = held_out(rows, tables["labels"], "quality")
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    assert sum(r["predicted"] == y for r, y in pairs) / len(pairs) > 0.93


def test_toxicity_on_held_out_rows(spark, tables):
    rows = toxicity.score_documents(tables["documents"], tables["labels"]).collect()
    pairs = held_out(rows, tables["labels"], "toxic")
    assert sum(r["predicted"] == y for r, y in pairs) / len(pairs) > 0.93
    assert not any(r["predicted"] for r, y in pairs if not y)
    assert sum(r["predicted"] for r, y in pairs if y) / sum(y for _, y in pairs) > 0.8
    text = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    hit = next(r for r in rows if r["predicted"])
    assert 0 < len(text[hit["doc_id"]][hit["spans"][0]["start"] : hit["spans"][0]["end"]]) < len(text[hit["doc_id"]]) + 1


def test_classifiers_on_odd_tables(spark, tables):
    docs = spark.createDataFrame([(1, None, "a"), (1, "x y", "b"), (None, "", "c")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, value in ((quality, 1.0), (toxicity, 0.0)):
        assert [r["score"] for r in module.score_documents(docs, none).collect()] == [value] * 3
        assert module.score_documents(docs.limit(0), none).count() == 0
        assert all(0 <= r["score"] <= 1 for r in module.score_documents(docs, tables["labels"]).collect())


def test_noisy_or():
    assert toxicity.noisy_or([]) == 0 and toxicity.noisy_or([0.5, 0.5]) == pytest.approx(0.75)


def words(text):
    return [*(text or "").encode().lower().split(), None]


def test_language_model_base_and_order(spark, tables):
    docs = tables["documents"].collect()
    rows = {r["doc_id"]: r for r in lm.score_documents(tables["documents"]).collect()}
    count: Counter = Counter()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 5 != 1:
            count.update(words(d["text"]))
    n, v = sum(count.values()), len(count)
    for d in docs:
        r, w = rows[d["doc_id"]], words(d["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-7)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (2, "a b", 3), (2, "a b", 4)], "doc_id long, text string, score int")
    rows = lm.score_documents(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 3, 3, 3] and all(r["score"] < 0 for r in rows)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_tables_follow_their_conditional():
    d, weight, n = 0.5, 0.7, 60_000
    keys = np.arange(n, dtype=np.uint64)
    t = lm.opened(np.full(n, 3), np.full(n, weight), d, lm.mix64(keys))
    want = np.array([(1 - d) * (2 - d) * weight, 3 * (1 - d) * weight**2, weight**3])  # S(3, t) weight**t
    assert np.allclose(np.bincount(t, minlength=4)[1:] / n, want / want.sum(), atol=0.01)
    s = lm.gamma(np.full(n, 2.5), lm.mix64(keys + np.uint64(7)))
    assert abs(s.mean() - 2.5) < 0.05 and abs(s.var() - 2.5) < 0.1


def test_many_customers_open_tables_as_the_conditional_has_it():
    u = lm.uniform(np.arange(4000, dtype=np.uint64), 5)
    for discount in (0.3, 0.5, 0.75, 0.9):
        for weight in (0.01, 0.3, 3.0, 30.0, 300.0):
            t = np.arange(1, lm.EXACT + 1)
            log = lm.log_stirling(discount)[lm.EXACT, 1:] + t * np.log(weight)
            p = np.exp(log - log.max())
            exact = float((t * p).sum() / p.sum())
            many = np.mean([lm.opened_by_many(lm.EXACT, weight, discount, x) for x in u])
            assert abs(many / exact - 1) < 0.03, (discount, weight, exact, many)


def test_probabilities_of_a_context_sum_to_one(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, n) if x < 40)
    docs = spark.createDataFrame([(i, text(60)) for i in range(200)], "doc_id long, text string")
    cut = lm.stored(lm.blocks(docs.select("doc_id", "text", lm.remainder(docs, 5, "doc_id") == 1)), "cut")
    dictionary = lm.stored(lm.numbered(cut), "dictionary")
    v = lm._sums(dictionary.where("block < 0"), "counts", 4)[1]
    for common in (lm.COMMON, 300):  # also with contexts that owners share
        sent = lm.stored(lm.entries(cut, dictionary, 1, common), "sent")
        back = lm.parents(lm.seated(sent.where("kind = 1"), 1, v, common), v, 0.5).toPandas()
        sums = tuple(int(x) for x in np.sum([lm.unpacked(x) for x in back[back["owner"] < 0]["customers"]], axis=0))
        told, dishes = back[back["owner"] >= 0], lm.Dishes(sent.where("kind = 2").toPandas(), common)
        p = lm.predictive(dishes, told, v, sums, (0.5, 0.75))
        customers, tables = (lm.looked_up(told, 0, k, dishes.words) for k in ("customers", "tables"))
        new = (lm.STRENGTH[0] + 0.5 * sums[1]) / (lm.STRENGTH[0] + sums[0]) / (v + 1)
        parent = np.maximum(customers - 0.5 * tables, 0) / (lm.STRENGTH[0] + sums[0]) + new
        assert parent.sum() + (v + 1 - len(parent)) * new == pytest.approx(1)
        assert (dishes.totals > 300).any()
        seatings, split = list(dishes.swept(parent, 0.75, 1 + lm.BURN_IN + lm.SAMPLES))[lm.BURN_IN :], dishes.split(v)
        for k in np.flatnonzero(dishes.totals > 0):
            here, kept = dishes.v == k, []
            assert dishes.c[here].sum() == dishes.totals[k]
            for t in seatings:
                t = split if dishes.common[k] else t
                kept.append((lm.STRENGTH[1] + 0.75 * t[here].sum()) / (lm.STRENGTH[1] + dishes.totals[k]))
            rest = 1 - parent[dishes.w[here]].sum()  # of words that were never seen here, and the unknown one
            assert p[here].sum() + np.mean(kept) * rest == pytest.approx(1)


def test_language_model_does_not_depend_on_partitions(spark, tables):
    docs = tables["documents"].where("doc_id < 300")
    want = {r["doc_id"]: r for r in lm.score_documents(docs, owner_tokens=20_000, common=2_000).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = {r["doc_id"]: r for r in lm.score_documents(docs.repartition(5), block_tokens=10_000, owner_tokens=20_000, common=2_000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.keys() == want.keys() and all(got[i]["score"] == pytest.approx(r["score"], rel=1e-9) and got[i]["n_known"] == r["n_known"] for i, r in want.items())


def test_language_model_does_not_depend_on_what_is_split(spark, tables):
    """Contexts held whole and contexts split among owners are seated by one rule."""
    docs = tables["documents"].where("doc_id < 200")
    want = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, owner_tokens=20_000).collect()}
    for common in (1_000, 50):
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, owner_tokens=20_000, common=common).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(w, rel=1e-9) for i, w in want.items())


def test_language_model_prefers_what_it_has_seen(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{int(x)}" for x in rng.integers(300, size=80))
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    texts = {i: text() for i in range(400)}
    copies = dict(zip(held[::2], learnt, strict=False))
    texts |= {i: texts[j] for i, j in copies.items()}
    rows = lm.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert min(score[i] for i in copies) > max(score[i] for i in held if i not in copies)


def test_words_that_defeat_polynomial_hashes(spark):
    one, two = thue_morse(1024)
    ids = [next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 5 == 1) == h) for h in (False, True)]
    rows = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame([(ids[0], one), (ids[1], two)], "doc_id long, text string")).collect()}
    assert rows[ids[0]]["n_known"] == 2 and rows[ids[1]]["n_known"] == 1 and rows[ids[1]]["train_tokens"] == 2


def test_long_texts_and_blanks_of_every_kind(spark):
    text = "A\tb\x0bC\x0c\r\n" + "word " * 300_000 + "\x1c\u00a0end"
    (r,) = lm.score_documents(spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()
    assert r["n_tokens"] == 3 + 300_000 + 1 + 1 and math.isfinite(r["score"])


def brute(x, ids, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return out


def test_nearest_neighbours_recall(spark, tables):
    table = tables["embeddings"].toPandas()
    want = brute(np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy(), 100, 10)
    got: dict = {}
    for r in ann.nearest(tables["embeddings"]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(abs(dict(w).get(i, s) - s) < 1e-12 for q, w in want.items() for i, s in got[q])


def test_nearest_neighbours_with_queries_split_among_tasks(spark, tables, monkeypatch):
    rows = lambda: sorted(map(tuple, ann.nearest(tables["embeddings"]).collect()))
    whole = rows()
    monkeypatch.setattr(ann, "QUERIES", 2)
    assert rows() == whole


def test_nearest_neighbours_recall_with_hundreds_of_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 16)
    x = np.random.default_rng(2).normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    want = brute(x, np.arange(len(x)), 100, 10)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(df).collect()}
    assert sum((q, i) in got for q, w in want.items() for i, _ in w) / 800 >= 0.9
    assert len(got) == 800 and all(abs(got[q, i] - s) < 1e-12 for q, w in want.items() for i, s in w if (q, i) in got)


def test_nearest_neighbours_of_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(1000, [0.0, 1.0]), (1001, None), (1002, [0.0, 0.0]), (1003, [float("nan"), 1.0]), (1004, [1.0]), (1005, [None, 1.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    out = ann.nearest(df).collect()
    by = lambda q: [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
    assert by(0) == list(range(1, 11)) and by(100) == list(range(10)) and by(1000) == list(range(10))
    assert {r["query_id"] for r in out} == {0, 100, 200, 1000}
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 1, 1.0)]
    assert ann.nearest(few.limit(0)).count() == 0


def plain_similarity(a, b):
    """Longest common subsequence over union, by the textbook programme; 0 if not even all common shingles in any order reach 0.8."""
    if sum((Counter(a) & Counter(b)).values()) < 0.8 * max(len(a), len(b)):
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = list(row)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1])


def brute_classes(texts):
    """Classes by plain words, shingles as tuples and the textbook programme, sharing no code with the operator."""
    words = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    shingles = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in words]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if words[i] == words[j] or shingles[i] and shingles[j] and plain_similarity(shingles[i], shingles[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [" ".join(rng.choice(vocabulary, int(rng.integers(3, 200)))) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:
        for _ in range(int(rng.integers(1, 15))):
            w = t.split()
            for _ in range(int(rng.integers(0, max(1, len(w) // 25) + 1))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
    texts += [None, "", "...", "one two", "One, two!", "alpha " * 900, "alpha " * 930]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, n int").repartition(4)
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    assert [rows[i]["class_id"] for i in range(len(texts))] == brute_classes(texts)
    assert sum(r["kept"] for r in rows.values()) == len({r["class_id"] for r in rows.values()})
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["kept"])


def test_near_duplicates_of_one_family_beyond_small_buckets(spark):
    """Edited copies of one source, most of them too far from each other: the source must hold them together."""
    rng = np.random.default_rng(5)
    source = [f"s{i}" for i in range(300)]
    texts = [" ".join(source)]
    for _ in range(60):
        w = list(source)
        for i in rng.choice(300, 6, replace=False):
            w[i] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts)
    assert [r["class_id"] for r in near_dedup.near_duplicates(df).orderBy("doc_id").collect()] == want


def test_near_duplicates_on_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "q")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["class_id"], r["class_size"]) for r in rows) == [("5", 5, 3), ("5", 5, 3), ("7", 7, 1), ("None", 5, 3)]
    assert sum(r["kept"] for r in rows) == 2
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def thue_morse(n):
    """A word of n letters and its complement, on which polynomial hashes modulo powers of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_near_duplicates_of_words_that_defeat_polynomial_hashes(spark):
    one, two = thue_morse(2048)
    spaced = [" ".join(x) for x in thue_morse(2048)]
    df = spark.createDataFrame(list(enumerate([one, two, *(f"{x} {x} end of all" for x in (one, two)), *spaced])), "doc_id long, text string")
    assert [r["class_id"] for r in near_dedup.near_duplicates(df).orderBy("doc_id").collect()] == [0, 1, 2, 3, *(4 + c for c in brute_classes(spaced))]


def test_alignment_needs_order():
    a = np.arange(100, dtype=np.uint64)
    assert near_dedup.aligned(a, a) == 1 and near_dedup.aligned(a, a[::-1]) < 0.1
    b = np.concatenate([a[:50], a[60:]])
    assert near_dedup.aligned(a, b) == pytest.approx(0.9)


def test_links_of_large_buckets_by_a_single_agreeing_sketch(spark):
    rng = np.random.default_rng(9)
    while True:
        words = [f"w{i}" for i in rng.integers(10**6, size=9)]
        texts = [" ".join(words), " ".join(words[:8])]  # four of five shingles in common
        shingles, begin, names = near_dedup.shingled(texts)
        one, two = (near_dedup.order_min_hash(near_dedup.labelled(shingles[a:b])).view(np.int64) for a, b in zip(begin, begin[1:], strict=False))
        agree = np.flatnonzero(one == two)
        if len(agree) == 1:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = near_dedup._sketched(prepared(spark) and df, "doc_id", "text").select("node", "n", "keys")
    large = docs.selectExpr("node", "n", "explode(keys) as bucket", "9L as c").where(f"bucket = {one[agree[0]]}")
    members = spark.createDataFrame([], "node binary, component binary")
    links = near_dedup._open_links(df, "text", large, members, docs).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in links] == [tuple(sorted(names))]


def test_alignment_equals_a_plain_dynamic_programme():
    rng = np.random.default_rng(7)
    line = [f"line{i}" for i in range(12)]
    whole = [w for k in range(20) for w in (*line, *(f"u{k}x{i}" for i in range(12)))]
    texts = [whole, [*whole[:5], "other", *whole[6:]], whole[12:]]
    for size, kinds in ((40, 3), (150, 8), (400, 30), (700, 5000)):
        base = rng.integers(kinds, size=size).astype(str).tolist()
        for edits in (1, 2, 6, 20):
            w = list(base)
            for _ in range(edits):
                at = int(rng.integers(len(w)))
                w[at : at + int(rng.integers(0, 3))] = rng.integers(kinds, size=int(rng.integers(0, 3))).astype(str).tolist()
            texts += [base, w]
    shingles, begin, _ = near_dedup.shingled([" ".join(t) for t in texts])
    rows = [shingles[x:y] for x, y in zip(begin, begin[1:], strict=False)]
    pairs = [(0, 1), (0, 2), *((k, k + 1) for k in range(3, len(rows), 2))]
    want = [plain_similarity(rows[x].tolist(), rows[y].tolist()) for x, y in pairs]
    assert min(want[:2]) > 0.95 and any(w < 0.8 for w in want)
    for (x, y), w in zip(pairs, want, strict=True):
        for got in (near_dedup.aligned(rows[x], rows[y]), near_dedup.aligned(rows[y], rows[x])):
            assert got == pytest.approx(w) if w >= 0.8 else got < 0.8


def test_pipeline(spark, tmp_path, sf):
    import corpus_pipeline
    from terrane.llm import exact_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, set()
    earlier = exact_dedup.exact_duplicates(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
        names.add(name)
        if k < 4:
            assert docs.columns == columns
    assert {"toxicity", "near_dedup"} <= names and docs.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 4096
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.select(*sorted(c for c in docs.columns if c not in ("sequence_id", "offset"))).collect())) == sorted(map(str, docs.select(*sorted(c for c in docs.columns if c not in ("sequence_id", "offset"))).collect()))
    assert earlier.count() == spark.read.parquet(f"{sf}/documents.parquet").count()  # a result of before the run can still be read


def test_pipeline_stages_on_odd_tables(spark, sf):
    import corpus_pipeline

    rows = [(None, "a b c d e f g", 1), (3, None, 2), (3, "", 3), (4, "a b c d e f g", 4), (5, "A b  c d e f g", 5), (5, "A b  c d e f g", 5), (6, "z " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _name long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {r["_name"] for r in out.collect()} <= {r[2] for r in rows}
        none = stage(spark, docs.limit(0), sf)
        assert none.columns == docs.columns and none.count() == 0, k
    kept = [r["_name"] for r in corpus_pipeline.one_of_each(spark, docs, sf).collect()]
    assert len(kept) == 4 and 6 in kept and sum(k in (2, 3) for k in kept) == 1
    alike = [r["_name"] for r in corpus_pipeline.one_of_alike(spark, docs, sf).collect()]
    assert len(alike) == 3 and 6 in alike
    assert corpus_pipeline.packed(spark, docs, sf).count() >= len(rows) and corpus_pipeline.packed(spark, docs.limit(0), sf).count() == 0
