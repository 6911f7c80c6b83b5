"""The pipeline from end to end against its stages by plain means, and on odd tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from test_models import brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from terrane.llm import quality, toxicity
from terrane.llm.common import prepared, tokenizer_file


def folder(tmp_path, rows, labels):
    """Documents (doc_id, text) with a column of their own that clashes with nothing the stages may add, and labels (doc_id, quality, toxic)."""
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "kept": pa.array(range(len(rows)), pa.int64()), "node": pa.array(["n"] * len(rows), pa.string())})
    known = pa.table({c: pa.array([r[k] for r in labels], t) for k, (c, t) in enumerate((("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())))})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(known, tmp_path / "labels.parquet")
    return str(tmp_path)


def plain_chain(spark, rows, labels):
    """{piece: number of its rows} that are left when models drop rows and copies are found by plain comparison."""
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, keep in ((toxicity, lambda s: s < 0.5), (quality, lambda s: s >= 0.7)):
        score = {r["doc_id"]: r["score"] for r in module.score_documents(frame(rows), known).collect()}
        rows = [r for r in rows if keep(score[r[0]])]
    same = defaultdict(list)
    for i, t in rows:
        same[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i, t))
    rows = [(i, t) for _, i, t in map(min, same.values())]
    return rows, brute_classes([t for _, t in rows])


def test_the_chain_equals_plain_stages(spark, tmp_path, sf):
    prepared(spark)
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    labels = [tuple(r[c] for c in ("doc_id", "quality", "toxic")) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()]
    rng, top = np.random.default_rng(8), max(i for i, _ in docs) + 1
    for k in range(40):  # copies that differ in blanks, and near copies
        i, t = docs[int(rng.integers(len(docs)))]
        w = (t or "").split(" ")
        w[int(rng.integers(len(w)))] += "" if k % 2 else " changed"
        docs.append((top + k, ("  " if k % 4 else " ").join(w)))
    rows, classes = plain_chain(spark, docs, labels)
    found = corpus_pipeline.run(spark, folder(tmp_path, docs, labels)).collect()
    by_class, text = defaultdict(set), dict(rows)
    for (i, _), c in zip(rows, classes, strict=True):
        by_class[c].add(i)
    kept = {r["doc_id"] for r in found}
    assert kept <= text.keys() and all(len(kept & members) == 1 for members in by_class.values())
    assert len(by_class) < len(rows) < len(docs)
    tokenizer, want = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), set()
    for i in kept:
        ids = [*tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want.add((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    filled = defaultdict(list)
    for r in found:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 4096


def test_the_chain_on_odd_tables(spark, tmp_path):
    prepared(spark)
    for name in ("none", "odd"):
        (tmp_path / name).mkdir()
    assert corpus_pipeline.run(spark, folder(tmp_path / "none", [], [])).count() == 0
    rows = [(None, None), (1, None), (2, ""), (3, " \t"), (4, "a b c d e f g"), (5, "A b  c d e f g"), (5, "A b  c d e f g"), (None, "z " * 60_000), (7, "a b c d e f g")]
    found = corpus_pipeline.run(spark, folder(tmp_path / "odd", rows, [])).collect()
    lengths = defaultdict(int)
    for r in found:
        lengths[r["doc_id"]] += r["length"]
    # without labels nothing is dropped by a model: one blank text, one of the seven words, the long one
    assert len(lengths) == 3 and len([r for r in found if r["doc_id"] is None and r["length"] > 1]) > 10
