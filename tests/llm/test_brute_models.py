"""The trained models against plain loops: word vectors and forward pass, noisy-or and its optimum, and a customer-by-customer Gibbs sampler."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrane.llm import lm, quality, toxicity
from terrane.llm.common import WordNames, prepared

WORD, SYMBOL = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff\t\n\x0b\x0c\r ]+")


def held(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def good_and_bad(n):
    draw = random.Random(5)
    good = lambda: " ".join(draw.choice(["the river", "a theory of", "slow growth", "is measured by", "the result,"]) for _ in range(30)) + "."
    bad = lambda: " ".join(draw.choice(["CLICK", "win!!!", "free free", "$$$", "now >>"]) for _ in range(20))
    return [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]


def plain_vectors(texts):
    """Context vectors of all tokens by loops over positions."""
    around, kept = defaultdict(lambda: np.zeros(quality.DIMENSIONS)), {}
    for t in texts:
        for i, w in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    if t[j] not in kept:
                        kept[t[j]] = quality.index_vectors(np.array([WordNames()[t[j]]], np.uint64))[0]
                    around[w] += kept[t[j]]
            around[w] += 0
    return {w: v / max(np.linalg.norm(v), 1e-6) for w, v in around.items()}


def test_quality_scores_equal_a_plain_forward_pass(spark):
    prepared(spark)
    rows = good_and_bad(120)
    rows += [(200, "", 1), (201, None, 0), (202, "neverseen Unknown words ~~ here", 1), (203, "The RIVER the river", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200], "doc_id long, quality int")
    model = quality.trained(docs, labels)
    learnt = [t.encode() for i, t, _ in rows if i < 200 and held(i, 4) != 2]
    spaces = [plain_vectors([WORD.findall(t.lower()) for t in learnt]), plain_vectors([SYMBOL.findall(t) for t in learnt])]

    def features(text):
        raw = (text or "").encode()
        words, symbols, out = WORD.findall(raw.lower()), SYMBOL.findall(raw), []
        for tokens, space in zip((words, symbols), spaces, strict=True):
            total = np.zeros(quality.DIMENSIONS)
            for w in tokens:
                total += space.get(w, 0)
            out.append(total / max(1, len(tokens)))
        n, caps, small = max(1, len(words)), len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[a-z]", raw))
        again = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1) if len(words) > 1 else 0
        known = sum(w in spaces[0] for w in words) / len(words) if words else 0
        return np.concatenate([*out, [caps / max(1, caps + small), again, len(set(words)) / n**0.8, min(3.0, len(symbols) / n), known, math.log1p(len(words)) / 8, math.log1p(len(raw) / n) / 3]])

    found = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    for i, t, _ in rows:
        x = (features(t) - model.mean) / model.scale
        assert np.allclose(quality.pooled([t or ""], model.vocabulary)[0], features(t), atol=1e-5)
        hidden = [math.tanh(sum(a * b for a, b in zip(x, model.params[0][:, k], strict=True)) + model.params[1][k]) for k in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, model.params[2], strict=True)) + model.params[3][0]
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-logit / model.temperature)), abs=2e-4)
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.7) and found[i]["held_out"] == (held(i, 4) == 2)
    unseen = [(found[i]["predicted"], y) for i, _, y in rows if i < 200 and held(i, 4) == 2]
    assert len(unseen) > 20 and all(p == y for p, y in unseen)


def likelihood(bags, weight, bias):
    """Penalised log-likelihood of documents, by loops."""
    total = -toxicity.PENALTY * sum(weight) - 0.0005 * len(bags) * (bias + 3) ** 2
    for label, sentences in bags:
        clean = 1.0
        for s in sentences:
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(weight[k] for k in s))))
        total += math.log(max(1 - clean, 1e-12)) if label else math.log(max(clean, 1e-12))
    return total


def test_evidence_weights_are_where_the_likelihood_is_greatest():
    draw = random.Random(3)
    bags = []
    for _ in range(400):
        label = int(draw.random() < 0.3)
        sentences = [[k for k in range(5) if draw.random() < (0.15, 0.3, 0.05, 0.2, 0.1)[k]] for _ in range(draw.randint(1, 4))]
        if label and draw.random() < 0.9:
            sentences[draw.randrange(len(sentences))] += [draw.choice([0, 2])]
        bags.append((label, [sorted(set(s)) for s in sentences if s]))
    seen = [[y for y, s in bags if any(k in x for x in s)] for k in range(5)]
    weight, bias = toxicity.fit(bags, np.array([np.mean(s) for s in seen]))
    best, w, b = likelihood(bags, weight, bias), list(weight), bias
    for step in (0.5, 0.1, 0.02):  # plain coordinate ascent under the same bounds
        better = True
        while better:
            better = False
            for k in range(6):
                for sign in (step, -step):
                    trial, at = list(w), b
                    if k < 5:
                        trial[k] = max(0.0, w[k] + sign)
                    else:
                        at = min(-1.0, b + sign)
                    if likelihood(bags, trial, at) > likelihood(bags, w, b) + 1e-9:
                        w, b, better = trial, at, True
    plain = likelihood(bags, w, b)
    assert best > plain - 0.05 and best > likelihood(bags, [0.0] * 5, -3.0) + 10
    assert min(weight[0], weight[2]) > 2 * max(weight[1], weight[3], weight[4])


def test_toxicity_scores_equal_a_plain_noisy_or(spark):
    model = toxicity.Model({"vile": 5.0, "^insul": 4.0, "rude": 2.0}, -4.0)
    texts = ["Nothing here. Really!", "You vile thing. A rude reply? fine", "insults\nInsulting vile rude. ok", "", None, "VILE... vile! vile"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, none, model=model).collect()}
    for i, t in enumerate(texts):
        clean, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+[.!?]*", t or ""):
            words = set(re.findall(r"[^\W_]+", m[0].lower()))
            evidence = words | {"^" + w[:k] for w in words if len(w) >= 5 for k in (4, 5)}
            hits = sum(x for e, x in model.weights.items() if e in evidence)
            if hits:
                p = 1 / (1 + math.exp(-(model.bias + hits)))
                clean *= 1 - p
                spans += [(m.start(), m.end())] if p >= 0.5 else []
        assert found[i]["score"] == pytest.approx(1 - clean, abs=1e-9) and found[i]["predicted"] == int(1 - clean >= 0.5)
        assert [(s["start"], s["end"]) for s in found[i]["spans"]] == spans


class Restaurant:
    """Customers at tables, one by one; new tables send a customer to the parent."""

    def __init__(self, discount, strength, parent):
        self.discount, self.strength, self.parent = discount, strength, parent
        self.tables, self.n, self.t = defaultdict(list), 0, 0

    def probability(self, w):
        here = self.tables.get(w, ())
        new = self.strength + self.discount * self.t
        return (sum(here) - self.discount * len(here) + new * self.parent.probability(w)) / (self.strength + self.n)

    def enter(self, w, draw):
        here = self.tables[w]
        shares = [c - self.discount for c in here] + [(self.strength + self.discount * self.t) * self.parent.probability(w)]
        k = draw.choices(range(len(shares)), shares)[0]
        self.n += 1
        if k < len(here):
            here[k] += 1
        else:
            here.append(1)
            self.t += 1
            self.parent.enter(w, draw)

    def leave(self, w, draw):
        here = self.tables[w]
        k = draw.choices(range(len(here)), here)[0]
        here[k] -= 1
        self.n -= 1
        if not here[k]:
            del here[k]
            self.t -= 1
            self.parent.leave(w, draw)


class Uniform:
    def __init__(self, n):
        self.p = 1 / n

    def probability(self, w):
        return self.p

    def enter(self, w, draw):
        pass

    leave = enter


def test_language_model_against_a_sampler_of_single_customers(spark):
    """Sampling of the whole hierarchy, 400 sweeps, on some 500 tokens: log10 probabilities of a token differ by a hundredth or two on average."""
    prepared(spark)
    draw = random.Random(11)
    follow = {w: [draw.choice("abcdefghij") for _ in range(3)] for w in "abcdefghij"}

    def text(n):
        w, out = "a", []
        for _ in range(n):
            w = draw.choice(follow[w]) if draw.random() < 0.8 else draw.choice("abcdefghij")
            out.append(w)
        return " ".join(out)

    unseen = [i for i in range(60, 100) if held(i, 5) == 1]
    docs = [(i, text(draw.randint(3, 16))) for i in range(60)] + [(unseen[0], "a z b"), (unseen[1], "z z")]
    learnt = [[*t.split(), "</>"] for i, t in docs if held(i, 5) != 1]
    pairs = [(u, w) for t in learnt for u, w in zip(["</>", *t], t, strict=False)]
    one, two = (lambda c: (sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())))(Counter(pairs))
    d1 = lm.estimated(one, two, lm.DISCOUNT[1])
    counts = Counter(w for t in learnt for w in t)
    d0 = lm.estimated(sum(x == 1 for x in counts.values()), sum(x == 2 for x in counts.values()), lm.DISCOUNT[0])
    corpus = Restaurant(d0, lm.STRENGTH[0], Uniform(len(counts) + 1))
    contexts = defaultdict(lambda: Restaurant(d1, lm.STRENGTH[1], corpus))
    for u, w in pairs:
        contexts[u].enter(w, draw)
    wanted = {(u, w) for _, t in docs for u, w in zip(["</>", *t.split()], [*t.split(), "</>"], strict=True)}
    total = Counter()
    for sweep in range(440):
        for u, w in pairs:
            contexts[u].leave(w, draw)
            contexts[u].enter(w, draw)
        if sweep >= 40:
            for u, w in wanted:
                total[u, w] += (contexts[u] if u in counts else corpus).probability(w) / 400
    found = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    off = []
    for i, t in docs:
        want = sum(math.log10(total[u, w]) for u, w in zip(["</>", *t.split()], [*t.split(), "</>"], strict=True))
        off.append((found[i]["score"] - want) / found[i]["n_tokens"])
    print("difference of log10 a token", np.mean(off), np.abs(off).max(), d0, d1)
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.1
