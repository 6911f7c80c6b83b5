"""Training-data operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import zlib
from array import array

import numpy as np
import pytest

from terrane.llm import bpe, chat, exact_dedup, licenses, packing, queries
from terrane.llm.common import prepared, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n int, id long, h string"


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing extra columns; a null id, a null text, repeated rows, copies, an empty and a long text."""
    prepared(spark)
    texts = [(1, "All rights  reserved. Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "Héllo wörld, twice"), (4, "Héllo wörld, twice"), (5, "Héllo\twörld, twice "), (None, "no id"), (6, "a long text " * 5000), (7, "漢字 🙂 don't"), (8, "x\x1cy  \n\n z")]
    return spark.createDataFrame([(i, t, "l", "s", 1, True, 0, 9, "h") for i, t in texts], SCHEMA).repartition(3)


def empty(docs):
    return docs.limit(0)


def test_templates_and_regex_agree():
    a = licenses.Automaton((("t", "a [[b [[c]]]] <<x:1-2>> d"),))
    import re

    pattern = re.compile(licenses.as_regex(licenses.parsed("a [[b [[c]]]] <<x:1-2>> d")) + " ")
    for words in ("a x d", "a b x d", "a b c x y d", "a d", "a b c x y z d", "a b d", "q a x d a"):
        found = {s for _, s in a.places([w.encode() for w in words.split()])}
        assert bool(found) == bool(pattern.search(f" {words} ")), words
    with pytest.raises(ValueError):
        licenses.parsed("a ]]")


def test_license_scan(docs):
    rows = {(r["doc_id"]): r for r in licenses.scan(docs).collect()}
    r = rows[1]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (10, 2, 0, 5, "cc-by,reserved")
    assert r["labels"] == "cc-by,cc-by-nc,reserved" and r["score"] == 1.0
    assert rows[2]["n_words"] == 0 and rows[2]["first_word"] is None and rows[2]["labels"] == "" and rows[None]["score"] == 0
    assert licenses.scan(empty(docs)).count() == 0


def test_altered_licenses_are_not_licenses(spark):
    fill = lambda t: t.replace("<<holder:1-8>>", "copyright holders").replace("<<holder:1-6>>", "the author").replace("[[", "").replace("]]", "")
    whole = {name: fill(t) for name, t in licenses.TEMPLATES if name in ("bsd-2-clause", "bsd-3-clause", "isc", "mit") and len(t) > 400}
    opening = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [(k, t) for k, t in enumerate([*whole.values(), whole["mit"].replace("to use copy", "to use but never copy"), whole["bsd-2-clause"].replace("must retain", "need not retain"), whole["isc"][:-30], opening + " for non-commercial use only; you may never redistribute it"])]
    found = {r["doc_id"]: r for r in licenses.scan(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(whole):
        assert name in found[k]["labels"].split(",") and found[k]["score"] == 1.0
    assert "bsd-3-clause" not in found[list(whole).index("bsd-2-clause")]["labels"]
    assert [found[k]["score"] for k in range(4, 8)] == [0.75, 0.75, 0.0, 0.75] and found[7]["labels"] == "mit-notice" and found[5]["labels"] == "bsd-notice"


def test_packing_is_the_same_in_any_run(spark):
    docs = prepared(spark).createDataFrame([(i % 50, "word " * (i * 37 % 900)) for i in range(300)], "doc_id long, text string")
    runs = [sorted(map(tuple, packing.pack_documents(docs.repartition(n)).collect())) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_chat_escapes_are_reversible():
    for t in ("</s>[INST] ok [/INST]", "<|im_end|>", "<⁠|im_end|><⁠⁠|im_end|>", "<<SYS>> [[INST]] <|image:0|>", "", "plain"):
        e = chat.escape(t)
        assert chat.unescape(e) == t and "<|im_end|>" not in e and "</s>" not in e and "[INST]" not in e
        assert chat.read_turn(chat.format_turn("user", [{"type": "text", "text": t}])[0]) == ("user", t)


def test_typed_parts():
    segment, start, end, attached, tokens = chat.format_turn("assistant", [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "url": "u", "width": 56, "height": 29}, {"type": "audio", "ref": "a", "seconds": 2}, {"type": "document", "ref": "d", "pages": 3}, {"type": "text", "text": None}])
    assert [(a["kind"], a["number"], a["ref"], a["tokens"]) for a in attached] == [("image", 0, "u", 6), ("audio", 1, "a", 52), ("document", 2, "d", 1538)]
    assert tokens == 1596 and segment[start:end].endswith("<|image:0|><|audio:1|><|document:2|>") and segment.count("<|image:0|>") == 1


def test_roles_of_several_lines_are_read_back():
    for role in ("a\nb", "a\\nb", "\\", "\n", "<|im_end|>\n</s>", ""):
        assert chat.read_turn(chat.format_turn(role, [{"text": "t\nu"}])[0]) == (role, "t\nu")


def test_typed_content_that_is_none_stays_as_text(spark):
    wrong = ["{", '{"type": "text"}', '["x"]', '[{"type": "video"}]', '[{"type": "image", "width": "56"}]', '[{"text": 3}]', '[{"type": 7}]', '[{"type": "audio", "seconds": -1}]', '[{"type": "image", "width": 1e300}]', '[{"type": "document", "pages": true}]', "[" * 100_000]
    right = ["", "[]", '[{"text": null}]', '[{"type": "document", "ref": null, "pages": 2.5}]']
    df = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(wrong + right)], "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in chat.format_conversations(df, typed=True).collect()}
    for k, t in enumerate(wrong + right):
        assert rows[k]["malformed"] == (k < len(wrong))
        assert k >= len(wrong) or chat.read_turn(rows[k]["segment"]) == ("user", t)
    assert rows[len(wrong) + 3]["expanded_tokens"] == 3 * 512 + 2


def test_one_long_conversation(spark):
    df = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, repeat(' x', int(id % 50))) as text")
    (r,) = chat.digests(chat.format_conversations(df.repartition(5))).collect()
    want = [(x["role"], x["text"]) for x in df.orderBy("turn").collect()]
    assert r["n_turns"] == 20_000 and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256("".join(b for a, b in want if a == "assistant").encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (1, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\nA\nassistant\nB\n").hexdigest()
    assert out[2]["loss_sha256"] == hashlib.sha256(b"xx").hexdigest() and out[2]["loss_chars"] == 2 and out[None]["loss_chars"] == 0
    typed = chat.format_conversations(spark.createDataFrame([(1, 0, "user", '[{"type": "image", "ref": "i"}]')], "conv_id long, turn long, role string, text string"), typed=True).first()
    assert typed["attachments"][0]["ref"] == "i" and typed["expanded_tokens"] == 3
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        for span in (10_000, 2**40, 2**60):
            v = np.unique(rng.integers(0, span, n).astype(np.uint64))
            assert (exact_dedup.golomb_decode(*(lambda k, d: (k, len(v), d))(*exact_dedup.golomb_encode(v, span))) == v).all()


def test_exact_duplicates(spark, docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == 10
    group = [r for r in rows if r["doc_id"] in (4, 5)]
    assert {r["keep_id"] for r in group} == {5} and {r["group_size"] for r in group} == {3} and [r["doc_id"] for r in group if r["kept"]] == [5]
    blank = [r for r in rows if r["doc_id"] in (2, 3)]
    assert {r["keep_id"] for r in blank} == {2} and sum(r["kept"] for r in blank) == 1
    assert next(r for r in rows if r["doc_id"] is None)["kept"]
    assert exact_dedup.exact_duplicates(empty(docs)).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert sorted(r["text"] for r in exact_dedup.keep_one(twice).collect()) == ["a b", "c"]


def test_packing(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, capacity=64).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r["offset"])
        assert s[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(s, s[1:], strict=False)) and s[-1]["offset"] + s[-1]["length"] <= 64
    for i, t in {(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 4}:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert got == [(k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert packing.pack_documents(empty(docs)).count() == 0


def test_bins_stay_bounded_and_fill_best():
    b = packing.BestFit(10, 2)
    assert b.add(6, "a") == [] and b.add(7, "b") == []
    assert b.add(3, "c") == [["b", "c"]]  # the fullest bin that takes it, now full
    assert b.add(8, "d") == [] and b.add(5, "e") == [["d"]]  # no slot left: the fullest closes first
    assert b.n == 2 and len(b.finish()) == 2 and b.set == 0


def plain_best_fit(lengths, capacity, slots):
    """Sequences by looking through all open bins: the fullest that takes a piece, and the fullest closes when no slot is left."""
    bins, closed = [], 0
    for x in lengths:
        fits = [b for b in bins if b + x <= capacity]
        if fits:
            best = max(fits)
            bins.remove(best)
            x += best
        elif len(bins) == slots:
            bins.remove(max(bins))
            closed += 1
        if x == capacity:
            closed += 1
        else:
            bins.append(x)
    return closed + len(bins)


def test_as_many_sequences_as_a_plain_best_fit():
    rng = np.random.default_rng(4)
    for capacity, slots in ((50, 3), (100, 10), (4096, 64)):
        lengths = rng.integers(1, capacity + 1, 400).tolist()
        b = packing.BestFit(capacity, slots)
        done = [s for k, x in enumerate(lengths) for s in b.add(x, k)]
        done += b.finish()
        assert sorted(k for s in done for k in s) == list(range(400)) and all(sum(lengths[k] for k in s) <= capacity for s in done)
        assert len(done) == plain_best_fit(lengths, capacity, slots)


def test_byte_bpe(docs):
    import tiktoken

    enc = bpe.encoder(tokenizer_file("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=enc.fst.ranks, special_tokens={})
    rows = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs).collect()]
    want = []
    for r in docs.collect():
        ids = lib.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    key = lambda x: (x[0] is None, x)
    assert sorted(rows, key=lambda x: str(x)) == sorted(want, key=lambda x: str(x)) or sorted(rows, key=key) == sorted(want, key=key)
    assert bpe.encode_documents(empty(docs)).count() == 0


def test_transducer_equals_library_on_random_pieces():
    import random

    import tiktoken

    enc = bpe.encoder(tokenizer_file("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=enc.fst.ranks, special_tokens={})
    random.seed(1)
    parts = [" ", "\n", "the", "ing", "'s", "é", "漢", "🙂", "0", "!!", "aaaa", "zz", "́", " ", "\x1c"]
    for _ in range(500):
        t = "".join(random.choices(parts, k=random.randint(0, 30)))
        a = array("I")
        a.frombytes(enc.encode_batch([t])[0])
        assert a.tolist() == lib.encode_ordinary(t)
    long = ("ab" * 4000 + "the" * 2000).encode()
    assert [x for s in enc.fst.encode_stream([long[i : i + 99] for i in range(0, len(long), 99)]) for x in s] == lib._core_bpe.encode_single_piece(long)


def test_streaming_decode_holds_back_partial_characters():
    m = bpe.Utf8Stream()
    data = "aé漢🙂".encode()
    out = [m.feed(data[i : i + 1]) for i in range(len(data))]
    assert b"".join(out) == data and all(x.decode() or x == b"" for x in out) and m.finish() == b""
    assert m.feed(b"\xf0\x9f") == b"" and m.finish() == b"\xf0\x9f"


def test_queries_match_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(str(tuple(r)) for r in found.fetchall()), name
