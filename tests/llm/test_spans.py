"""Repeat intervals, periodic runs and fill-in-middle against plain versions, and on odd tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from terrane.llm import infill, periods, repeats
from terrane.llm.common import give_back, prepared

SCHEMA = "doc_id long, text string, t string, n long, uid long, digest binary, name string, form string"


def table(spark, rows, parts=3):
    prepared(spark)
    return spark.createDataFrame([(i, t, "t", 1, 2, b"d", "n", "f") for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def odd(spark):
    """Null key and text, repeated rows and keys, an empty and a long text, several kinds of characters, columns with the operators' own names."""
    passage = "Ein Absatz von mehr als fünfzig Bytes, der in vielen Texten wörtlich steht. "
    rows = [(1, None), (2, ""), (3, "short"), (4, passage), (4, passage), (5, f"x{passage}y"), (6, passage * 40), (7, "ab " * 30_000), (8, "ab " * 30_000), (None, f"{passage}null key"), (None, passage)]
    rows += [(9, "a <P> b\nc"), (10, "\n\n\n"), (11, "漢字 🙂 é\nline\r\nmore\x0b z"), (12, "one two three\n" * 9), (6, passage), (13, "z" * 700), (14, "z" * 60)]
    return rows


def removed_plainly(rows, length=repeats.LENGTH):
    rank = {i: (i is None, i or 0) for i, _ in rows}
    least, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            least[w] = min(least.get(w, rank[i]), rank[i])
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + length, np.int64)
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < rank[i]:
                gone[s : s + length] = 1
        gone = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[gone == 0].tobytes()
        out.append((i, len(b), int(gone.sum()), len(re.findall("1+", "".join(map(str, gone)))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [20_000, 0])
def test_repeats_on_odd_tables(spark, odd, hot):
    found = repeats.digests(repeats.remove_repeats(table(spark, odd), hot=hot)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == removed_plainly(odd)


def test_repeats_in_edited_copies(spark):
    draw = random.Random(3)
    base = ["".join(draw.choice("abcde ") for _ in range(draw.randrange(400, 900))) for _ in range(4)]
    rows = []
    for k in range(60):
        text = list(draw.choice(base))
        for _ in range(draw.randrange(0, 8)):
            text[draw.randrange(len(text))] = draw.choice("xyzé")
        rows.append((draw.randrange(40), "".join(text)[draw.randrange(100) :]))
    found = repeats.digests(repeats.remove_repeats(table(spark, rows))).collect()
    assert sorted((tuple(r) for r in found), key=repr) == removed_plainly(rows)


def test_repeat_groups_hold_all_occurrences(spark):
    a, b = "the quick brown fox jumps over the lazy dog and runs home again ", "0123456789" * 7
    rows = [(1, f"x{a}y"), (2, f"{a}{b}"), (3, f"q{b}"), (4, f"zz{a}"), (5, b[3:])]
    texts = {i: t.encode() for i, t in rows}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(table(spark, rows)).collect():
        groups[r["grp"]].add((r["doc_id"], r["start"], r["size"]))
    covered = defaultdict(set)
    for members in groups.values():
        strings = {texts[i][s : s + n] for i, s, n in members}
        assert len(strings) == 1 and len(members) > 1
        for i, s, n in members:
            covered[i] |= set(range(s, s + n))
    assert {i: len(c) for i, c in covered.items()} == {1: len(a), 2: len(a) + len(b), 3: len(b), 4: len(a), 5: len(b) - 3}
    whole = max(groups.values(), key=lambda m: len({i for i, _, _ in m}))
    assert {i for i, _, _ in whole} == {1, 2, 4}


def test_interval_tree_against_all_substrings():
    draw = random.Random(5)
    for _ in range(150):
        length = draw.choice([2, 3, 9])
        pieces = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(25))) for _ in range(draw.randrange(1, 5))]
        places = defaultdict(list)
        for p, s in enumerate(pieces):
            for i in range(len(s)):
                for j in range(i + length, len(s) + 1):
                    places[s[i:j]].append((p, i))
        expected = set()
        for w, at in places.items():
            left = {pieces[p][i - 1] if i else (p, i) for p, i in at}
            right = {pieces[p][i + len(w)] if i + len(w) < len(pieces[p]) else ("end", p) for p, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                expected.add((len(w), tuple(sorted(at))))
        piece, offset, groups = repeats.maximal_repeats(pieces, np.zeros(len(pieces), np.int64), np.arange(len(pieces)), length)
        assert {(n, tuple(sorted(zip(piece[a : b + 1].tolist(), offset[a : b + 1].tolist(), strict=True)))) for a, b, n, _ in groups} == expected


def test_equal_windows_have_equal_names():
    draw = random.Random(7)
    shared = bytes(draw.randrange(256) for _ in range(90))
    one, two = b"q" * 33 + shared + b"end", bytes(draw.randrange(256) for _ in range(77)) + shared
    names = []
    for text in (one, two):
        name, begin, end = repeats.stretches(text)
        assert begin[0] == 0 and (begin[1:] == end[:-1]).all() and end[-1] == len(text) - 49
        names.append(np.repeat(name, end - begin)[text.index(shared) :][:41].tolist())
    assert names[0] == names[1]


def runs_plainly(x, least=periods.LEAST):
    out = {}
    for q in range(1, len(x) // 2 + 1):
        j = 0
        while j + q < len(x):
            s = j
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - s >= max(least, 2 * q):
                out.setdefault((s, j + q), q)
            j += 1
    return sorted((s, e, q) for (s, e), q in out.items())


def test_runs_against_all_periods():
    draw = random.Random(1)
    for _ in range(300):
        n, k = draw.randrange(0, 260), draw.choice([1, 2, 3, 10])
        x = [draw.randrange(k) for _ in range(n)]
        for _ in range(draw.randrange(4)):
            if n > 5:
                a, p = draw.randrange(n), draw.randrange(1, n // 2 + 1)
                for i in range(a + p, min(n, a + draw.randrange(2, 6) * p)):
                    x[i] = x[i - p]
        assert periods.runs(np.array(x, np.int64)) == runs_plainly(x)
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert periods.runs(np.array(b)) == runs_plainly(b)


def test_transform_is_exact():
    draw = np.random.default_rng(0)
    a, b = draw.integers(0, periods.PRIME, (3, 16)).astype(np.uint64), draw.integers(0, periods.PRIME, (3, 16)).astype(np.uint64)
    assert (periods.inverse(periods.transform(a)) == a).all()
    got = periods.inverse(periods.transform(a) * periods.transform(b) % np.uint64(periods.PRIME))
    for r in range(3):
        plain = [sum(int(a[r, i]) * int(b[r, (k - i) % 16]) for i in range(16)) % periods.PRIME for k in range(16)]
        assert got[r].tolist() == plain
    x = draw.integers(0, 3, 400)  # a small alphabet, and one wider than the differences the sums allow
    for y, block in ((x, 4), (x, 16), (x + 10**9 * x, 8)):
        at = np.arange(0, 400 - block + 1, block)
        i, d = periods.matches(y, at, block, 1, 2 * block)
        plain = {(s, e) for s in at.tolist() for e in range(1, 2 * block + 1) if s + e + block <= 400 and (y[s : s + block] == y[s + e : s + e + block]).all()}
        assert plain <= set(zip(i.tolist(), d.tolist(), strict=True))


@pytest.mark.parametrize("rewrite", [None, periods.repeated_tail])
def test_periodic_runs_on_odd_tables(spark, odd, rewrite):
    extra = [(k, " ".join(f"w{(k * j) % 17}" for j in range(90))) for k in range(20, 60)]
    rows = odd[:7] + odd[9:] + extra
    expected = []
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        if rewrite:
            words = [w.decode() for w in rewrite(i, [w.encode() for w in words])]
        found = runs_plainly(words)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
        first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        expected.append((i, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    found = periods.digests(periods.periodic_runs(table(spark, rows), rewrite=rewrite)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(expected, key=repr)


def test_long_periodic_texts():
    for words, expected in ((np.zeros(100_000, np.int64), (0, 100_000, 1)), (np.arange(100_000) % 30_011, (0, 100_000, 30_011))):
        assert periods.runs(words) == [expected]


def test_tail_of_the_query():
    import zlib

    key = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    g, words = zlib.crc32(str(key).encode()) // 10, [str(k).encode() for k in range(50)]
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert periods.repeated_tail(key, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert periods.repeated_tail(key, []) == []


def test_sparse_index_converts_both_ways():
    for text in ("", "plain", "é", "a漢b🙂cé\n", "🙂" * 5):
        data, index = text.encode(), infill.SparseIndex(text.encode())
        at = [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert index.n_points == len(text)
        assert index.to_bytes(np.arange(len(text) + 1)).tolist() == at and index.to_points(np.array(at)).tolist() == list(range(len(text) + 1))
        assert len(index.at_byte) == sum(len(c.encode()) > 1 for c in text) and data.decode() == text


@pytest.mark.parametrize("unit", ["line", "character"])
def test_fill_in_middle_on_odd_tables(spark, odd, unit):
    layout = infill.Layout(unit=unit, rate=80, spm=30)
    rows = infill.restore(infill.fill_in_middle(table(spark, odd), layout=layout), layout=layout).collect()
    assert len(rows) == len(odd)
    texts = defaultdict(list)
    for i, t in odd:
        texts[i].append(t or "")
    forms = set()
    for r in rows:
        text = r["restored"]
        assert text in texts[r["doc_id"]]
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
        h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not text or "<P>" in text or h3 % 100 >= 80
        form = "plain" if plain else "spm" if h4 % 100 < 30 else "psm"
        output = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (r["n"], r["form"], r["output"]) == (len(units), form, output)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if plain else (len(pre), len(mid)))
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}


def test_layouts_that_could_not_be_undone():
    for wrong in ({"prefix": "<S>"}, {"middle": ""}, {"prefix": "<<"}, {"unit": "page"}):
        with pytest.raises(ValueError):
            infill.Layout(**wrong)
    other = infill.Layout(prefix="⟦pre⟧", suffix="⟦suf⟧", middle="⟦mid⟧", unit="character")
    for k in range(30):
        text = "⟦⟦pr⟦ sufe⟧é" * 3
        _, form, _, _, out = infill.transformed(text.encode(), str(k), other)
        assert form != "plain" and infill.rebuilt(out, form, other).decode() == text


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).limit(0)
    assert repeats.remove_repeats(none).count() == 0 and repeats.repeat_groups(none).count() == 0
    assert periods.periodic_runs(none).count() == 0 and infill.fill_in_middle(none).count() == 0


def test_workers_give_memory_back():
    """What lies between arrays that stay is free for the system again, not only for this process."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024
    arrays = [np.ones(6000) for _ in range(8000)]
    high = held()
    arrays = arrays[::50]
    give_back()
    assert held() < high - 250 and len(arrays) == 160


def test_owners_of_names_have_like_shares(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, rng.bytes(3000).hex()) for i in range(60)], "doc_id long, text string")
    sent = repeats._names(repeats._identity(docs, "doc_id", "text"), 8, 50, 16).where("owner is not null")
    shares = [r[1] for r in sent.groupBy("owner").sum("n").collect()]
    assert len(shares) == 8 and max(shares) < 1.2 * sum(shares) / 8


def test_rows_between_parts_and_shards_grow_with_the_input(spark, monkeypatch):
    """Chunks grow with the input in number, shards do not until they have many chunks: a part asks each of them in one row at most."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(60)]
    rows += [(100 + i, t[40:] + " " + rows[(i * 7) % 60][1][:300]) for i, (_, t) in enumerate(rows)] + [(None, rows[3][1]), (5, rows[9][1])]
    tables, asked = {}, []

    def stored(df, name):
        tables[name] = df = spark.createDataFrame(df.collect(), df.schema)
        if name == "stretches":
            asked.append(df.where("shard is not null").count() / df.where("shard is null").count())
        return df

    monkeypatch.setattr(repeats, "stored", stored)
    expected = removed_plainly(rows)
    for size, shards, most, opened in ((2_000_000, 256, 64, 16), (300, 4, 1000, 16), (300, 4, 1000, 3), (300, 2, 30, 1)):
        for name, value in (("CHUNK", size), ("SHARDS", shards), ("SHARD_CHUNKS", most), ("OPEN", opened), ("PART", 200)):
            monkeypatch.setattr(repeats, name, value)
        for hot in (20_000, 5):
            found = repeats.digests(repeats.remove_repeats(table(spark, rows), hot=hot)).collect()
            assert sorted((tuple(r) for r in found), key=repr) == expected
    assert asked[0] == 1 and max(asked[2:6]) <= 4 and 4 < asked[6]


def test_values_of_an_ordered_array():
    rng = np.random.default_rng(2)
    for values, ordered in ((rng.integers(0, 50, 30), np.unique(rng.integers(0, 50, 20))), (np.arange(3), np.zeros(0, np.int64)), (np.zeros(0, np.int64), np.arange(3))):
        assert repeats._among(values, ordered).tolist() == np.isin(values, ordered).tolist()


def test_repeats_whatever_hashes_are(monkeypatch):
    """Strings of one hash are told apart by their bytes and kinds."""
    pieces, kinds = [b"a passage of many words", b"b passage of many words", b"a passage of few", b"passage of many words x"], np.array([0, 0, 0, 1])
    groups = []
    for mixed in (repeats.mix64, lambda x: np.zeros_like(x)):
        monkeypatch.setattr(repeats, "mix64", mixed)
        piece, offset, found = repeats.maximal_repeats(pieces, kinds, np.arange(4), 9)
        groups.append(sorted((n, least, sorted(zip(piece[a : b + 1].tolist(), offset[a : b + 1].tolist(), strict=True))) for a, b, n, least in found))
    assert groups[0] == groups[1] == [(12, 0, [(0, 1), (1, 1), (2, 1)]), (13, 0, [(0, 0), (2, 0)]), (22, 0, [(0, 1), (1, 1)])]


def test_wide_grams_count_with_all_their_bytes(spark):
    """Larger tables have longer grams, all of whose bytes tell in a name; what is removed does not depend on them."""
    assert [repeats._wider(16, 50, size) for size in (0, 10**8, 10**9, 10**10, 10**14)] == [16, 16, 18, 20, 25] and repeats._wider(16, 20, 10**10) == 16
    draw = random.Random(4)
    text = bytes(draw.randrange(256) for _ in range(50))
    for gram in range(16, 26):
        one = repeats.stretches(text, gram, gram)[0][0]
        for k in range(gram):
            other = bytearray(text)
            other[k] ^= 1
            assert repeats.stretches(bytes(other), gram, gram)[0][0] != one
        assert repeats.stretches(text[:gram] + b"x", gram, gram)[0][0] == one
    rows = [(i, "".join(draw.choice("ab ") for _ in range(200)) * draw.randrange(1, 3)) for i in range(12)]
    rows += [(20 + i, t[draw.randrange(90) :]) for i, t in rows]
    for gram in (17, 20, 23, 25):
        found = repeats.digests(repeats.remove_repeats(table(spark, rows), gram=gram)).collect()
        assert sorted((tuple(r) for r in found), key=repr) == removed_plainly(rows)
