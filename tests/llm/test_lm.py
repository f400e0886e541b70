"""op2: counts and base scores against brute force; the model against its own definition."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path as vocab
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrapatch.llm import bpe, lm, queries

from .conftest import SF, frame, passage

PATH = vocab("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, train):
    counts = Counter(w for t in train for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = words_of(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        out.setdefault(i, []).append((len(w), sum(counts[x] > 0 for x in w), n, base))
    return out


def holds(got, want):
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert set(found) == set(want)
    for i, rows in want.items():
        for a, b in zip(sorted(rows), sorted(found[i]), strict=True):
            assert a[:3] == b[:3] and b[3] == pytest.approx(a[3], rel=1e-9)


@pytest.fixture(scope="module")
def whole(spark):
    return queries.op2_lm(spark, SF).toPandas()


def test_whole_table(spark, documents, whole):
    rows = documents.select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    holds(whole.to_dict("records"), brute([tuple(r) for r in rows], [r["text"] for r in rows if not held[r["doc_id"]]]))
    assert all(held[i] == h for i, h in zip(whole["doc_id"], whole["held_out"], strict=True))


def chained(seed, n):
    """Words most of which follow from the word before."""
    import random

    r = random.Random(seed)
    names = passage(39, 40).split()
    at, out = r.randrange(40), []
    for _ in range(n):
        out.append(names[at])
        at = (7 * at + 3) % 40 if r.random() < 0.85 else r.randrange(40)
    return " ".join(out)


def test_the_model_predicts_better_than_the_base(spark):
    """On held-out texts in which words depend on each other."""
    docs = frame(spark, [chained(i, 150) for i in range(300)])
    got = lm.scored(docs, PATH, F.col("doc_id") < 270).where("doc_id >= 270").toPandas()
    assert got["score"].sum() / got["base_score"].sum() < 0.85


def test_odd_rows(odd):
    train = F.col("doc_id") % 2 == 0
    got = lm.scored(odd, PATH, train).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    holds([r.asDict() for r in got], brute(rows, [t for i, t in rows if i is not None and i % 2 == 0]))


def test_empty_tables(spark, empty):
    assert lm.scored(empty, PATH).collect() == []
    got = lm.scored(frame(spark, ["some words", None]), PATH, F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert all(math.isfinite(r["score"]) for r in got)


@pytest.fixture(scope="module")
def scorer():
    v = bpe.vocabulary(PATH)
    data = np.frombuffer(chained(0, 20_000).encode(), np.uint8)
    ids = np.concatenate([x for _, x in bpe.encode_rows(bpe.Encoder(v, None), data, np.array([0, len(data)]))])
    bounds = np.array([0, len(ids) // 2, len(ids)])
    return lm.trained(ids, bounds, v.size, np.bincount(ids, minlength=v.size), 50256), ids, v


def test_each_step_is_a_distribution(scorer):
    """The probabilities of all tokens after some context add up to one."""
    s, ids, v = scorer
    head = ids[:30]
    many = np.concatenate([np.append(head, t) for t in range(0, v.size)])
    logs = s.logs(many, np.arange(0, len(many) + 1, 31), 50256).reshape(-1, 31)[:, -1]
    assert np.exp(logs.astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_attention_is_causal_and_windows_overlap(scorer):
    """What follows does not change a token's score; every token has at least CONTEXT tokens before it in sight, and those further back do not matter."""
    s, ids, _ = scorer
    x = ids[:200].copy()
    a = s.logs(x, np.array([0, 200]), 50256)
    y = x.copy()
    y[150:] = x[:50][::-1]
    b = s.logs(y, np.array([0, 200]), 50256)
    assert np.allclose(a[:150], b[:150], atol=1e-5) and not np.allclose(a[150:], b[150:])
    z = x.copy()
    z[90] = next(int(i) for i in ids if i != x[90])
    c = s.logs(z, np.array([0, 200]), 50256)
    assert not np.isclose(a[91], c[91], atol=1e-6)
    assert np.allclose(a[90 + lm.CONTEXT + lm.SCORED + 1 :], c[90 + lm.CONTEXT + lm.SCORED + 1 :], atol=1e-5)


def test_batches_do_not_matter(scorer):
    """Sequences are scored alike alone and together."""
    s, ids, _ = scorer
    bounds = np.array([0, 1, 1, 50, 180, 300])
    together = s.logs(ids[:300], bounds, 50256)
    alone = np.concatenate([s.logs(ids[a:b], np.array([0, b - a]), 50256) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    assert np.allclose(together, alone, atol=1e-4)


def test_gradients():
    """Against finite differences."""
    r = np.random.default_rng(0)
    m = lm.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    n = lm.CONTEXT + lm.SCORED
    x, before, y = r.integers(0, 50, (3, n)), r.integers(0, 50, (3, n)), r.integers(0, lm.CLASSES, (3, n))
    _, grad = m.step(x, before, y)
    for k, g in grad.items():
        at = tuple(a[0] for a in np.nonzero(np.abs(g) == np.abs(g).max()))
        old = m.p[k][at]
        m.p[k][at] = old + 0.03
        up = m.step(x, before, y)[0]
        m.p[k][at] = old - 0.03
        down = m.step(x, before, y)[0]
        m.p[k][at] = old
        assert (up - down) / 0.06 == pytest.approx(float(g[at]), rel=0.05, abs=1e-6), k


def test_training_lowers_the_loss(scorer):
    s, ids, v = scorer
    fresh = lm.Scorer(lm.Model(), s.cls, s.inner, s.table)
    bounds = np.array([0, len(ids)])
    assert s.logs(ids, bounds, 50256).mean() > fresh.logs(ids, bounds, 50256).mean() + 0.2


def test_context_goes_over_borders_of_pieces(scorer):
    """A sequence in two parts: with the ids before it, the second is scored as within the whole; a name is seen over at least 32 ids."""
    s, ids, _ = scorer
    assert lm.CONTEXT >= 32
    cut = 4 * lm.SCORED
    x = ids[: 2 * cut]
    whole = s.logs(x, np.array([0, len(x)]), 50256)[cut:]
    part = s.logs(x[cut:], np.array([0, cut]), 50256, x[cut - lm.CONTEXT - lm.SCORED : cut])
    assert np.allclose(whole, part, atol=1e-4)
    assert not np.allclose(whole, s.logs(x[cut:], np.array([0, cut]), 50256), atol=1e-4)


def test_rare_words_have_their_counts_in_the_score(spark, monkeypatch):
    """Scores are the same whether a word's count is at hand or comes by the join."""
    docs = frame(spark, [f"{chained(i, 60)} {passage(2000 + i // 2, 3)}" for i in range(60)])
    one = {r["doc_id"]: r for r in lm.scored(docs, PATH, F.col("doc_id") < 54).collect()}
    monkeypatch.setattr(bpe, "SHARE", 0.5)  # no word is frequent
    other = {r["doc_id"]: r for r in lm.scored(docs, PATH, F.col("doc_id") < 54).collect()}
    assert all(one[i]["score"] == pytest.approx(other[i]["score"], rel=1e-5) and one[i]["n_known"] == other[i]["n_known"] for i in one)


def test_a_share_of_all_documents_trains_the_model(spark, monkeypatch):
    """Texts outside the sample count: with a sample of three documents, training texts beyond it make held-out ones more likely, and they grow with the corpus."""
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 3)
    monkeypatch.setattr(lm, "SHARE", 4)
    seen = []
    monkeypatch.setattr(lm, "passed", lambda train, *rest, real=lm.passed: (seen.append(train.count()), real(train, *rest)))
    docs = frame(spark, [chained(i, 1500) for i in range(300)])
    few = lm.scored(docs, PATH, F.col("doc_id") < 270).where("doc_id >= 270").toPandas()
    lm.scored(docs, PATH, F.col("doc_id") < 135)
    assert 0.5 * 270 / 4 < seen[0] < 1.5 * 270 / 4 and seen[1] < 0.7 * seen[0]
    monkeypatch.setattr(lm, "passed", lambda *rest: None)
    none = lm.scored(docs, PATH, F.col("doc_id") < 270).where("doc_id >= 270").toPandas()
    assert few["score"].sum() > none["score"].sum() + 1
    assert few["n_tokens"].sum() == none["n_tokens"].sum()


def test_held_out_texts_of_the_small_table_beat_the_base(spark):
    out = queries.op2_lm(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert len(out) > 100 and out["score"].sum() > out["base_score"].sum()


def test_scores_are_those_of_a_plain_loop(spark, monkeypatch):
    """Every word by the three shares of its probability, every subword by the attention over the ids that its window shows, one at a time."""
    names = []
    monkeypatch.setattr(lm, "learned", lambda *a, real=lm.learned: names.append(real(*a)) or names[-1])
    texts = [chained(i, 300) for i in range(40)] + ["", "One one word that Nobody wrote xqzzqx", " ".join(["again"] * 90)]
    out = {r["doc_id"]: r for r in lm.scored(frame(spark, texts), PATH, F.col("doc_id") < 38).collect()}
    lexicon, scorer, _, heads, ends, weights, last = lm._load(names[0])
    p, counts, spell = scorer.model.p, Counter(), Tokenizer.from_file(PATH)
    for t in texts[:38]:
        counts.update(t.lower().split())
    n = sum(counts.values()) + 38
    assert ends == 38
    for i in (38, 39, 40, 41, 42):
        spelt = [spell.encode(" " + w, add_special_tokens=False).ids for w in texts[i].lower().split()] + [[last]]
        ids = [x for w in spelt for x in w]
        shown = [scorer.table[x] for x in [last, *ids[:-1]]]
        logs = []
        for k, x in enumerate(ids):
            low = max(0, k // lm.SCORED * lm.SCORED - lm.CONTEXT)
            s = np.array([p["q"][shown[k]] @ p["k"][shown[a]] + p["d"][k - a] for a in range(low, k + 1)], np.float64)
            g = np.exp(s) @ np.array([p["v"][shown[a]] for a in range(low, k + 1)]) / np.exp(s).sum()
            h = np.concatenate([g, p["c"][shown[k]], p["l"][shown[max(k - 1, 0)]], [1]])
            group, member = divmod(int(scorer.cls[x]), lm.MEMBERS)
            a, b = h @ p["g"], h @ p["m"][group]
            logs.append(a[group] - np.log(np.exp(a).sum()) + b[member] - np.log(np.exp(b).sum()) + scorer.inner[x])
        total, at = 0.0, 0
        for w, pieces in zip([*texts[i].lower().split(), None], spelt, strict=True):
            c = 38 if w is None else counts[w]
            part = weights[0] * np.exp(sum(logs[at : at + len(pieces)]))
            if c:
                part += weights[1] * np.exp(logs[at]) * c / heads[pieces[0]] + weights[2] * c / n
            total += np.log10(part)
            at += len(pieces)
        assert out[i]["score"] == pytest.approx(total, rel=1e-4)


def test_a_pass_uses_every_id(scorer):
    import copy

    s, ids, _ = scorer
    mine = copy.deepcopy(s)
    n = 2 * lm.BATCH * (lm.CONTEXT + lm.SCORED) + 3 * (lm.CONTEXT + lm.SCORED) + 5
    streams = [lm.inputs(ids[a : a + 1000], np.array([0, len(ids[a : a + 1000])]), s.table, s.cls, 50256) for a in range(0, n, 1000)]
    streams[-1] = streams[-1][:, : n - 1000 * (len(streams) - 1)]
    assert lm.trained_on(mine, streams) == n
    assert any((mine.model.p[k] != s.model.p[k]).any() for k in s.model.p)


def test_all_training_texts_teach_the_model(spark, monkeypatch):
    """With a sample of three documents, the pass trains on all, the mixture is fitted on every word of those that the weights did not begin with, and the way a count is looked up does not matter."""
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 3)
    seen, cells = [], []
    monkeypatch.setattr(lm, "passed", lambda train, *rest, real=lm.passed: (seen.append((train.count(), train.where("fresh").count())), real(train, *rest), cells.append(rest[-1])))
    docs = frame(spark, [*(f"{chained(i, 80)} {passage(2000 + i // 2, 3)}" for i in range(60)), None, ""])
    lm.scored(docs, PATH, F.col("doc_id") < 54)
    assert seen == [(54, 54 - 3)]
    assert cells[0].sum() == (54 - 3) * (80 + 3 + 1)
    monkeypatch.setattr(bpe, "SHARE", 0.5)  # no word is frequent
    lm.scored(docs, PATH, F.col("doc_id") < 54)
    assert np.abs(cells[1] - cells[0]).sum() <= 0.02 * cells[0].sum()


def test_weights_are_fitted_on_counts_without_the_text_itself():
    """Cells against the ratios themselves, and their EM against one over the words."""
    r = np.random.default_rng(0)
    whole, first, c = r.normal(-9, 3, 4000), r.normal(-8, 2, 4000), r.integers(0, 50, 4000)
    cells = np.bincount(lm.cell_of(whole, first, c, 5000), minlength=lm.CELLS**2)
    p = np.stack([np.exp(whole), np.exp(first) * c, c / 5000], 1)
    w = np.array([0.5, 0.3, 0.2])
    for _ in range(40):
        share = p * w
        w = np.clip((share / share.sum(1, keepdims=True)).mean(0), 0.01, 1)
        w /= w.sum()
    assert lm.fitted(cells) == pytest.approx(w, abs=0.01)
    assert lm.fitted(np.zeros(lm.CELLS**2)).sum() == pytest.approx(1)


def test_neighbours_are_counted_over_all_texts(spark, monkeypatch):
    """Against a plain loop; texts begin after the last id, and a text in parts goes on."""
    found = []
    monkeypatch.setattr(lm, "neighbour_counts", lambda *a, real=lm.neighbour_counts: found.append((a[3], a[4], real(*a))) or found[-1][2])
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 3)
    texts = [*(chained(i, 60) for i in range(40)), None, "", chained(99, 330_000)]
    assert len(texts[-1]) > 2_000_000
    lm.scored(frame(spark, texts).repartition(3), PATH)
    rank, last, (key, n) = found[0]
    spell, held, want = Tokenizer.from_file(PATH), {}, Counter()
    for t in texts:
        ids = [last]
        for w in words_of(t)[:-1]:
            ids += held.get(w) or held.setdefault(w, spell.encode(" " + w, add_special_tokens=False).ids)
        ids.append(last)
        for (a, b), k in Counter(zip(ids[:-1], ids[1:], strict=True)).items():
            if rank[a] >= 0:
                want[b * 2 * lm.SINGLE + int(rank[a])] += k
            if rank[b] >= 0:
                want[a * 2 * lm.SINGLE + lm.SINGLE + int(rank[b])] += k
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == want


def test_a_step_moves_its_own_rows_only_and_none_is_lost():
    """Rows of the tables that a step's windows do not hold wait, and end where plain Adam takes them; half of the queries meet half of the keys only."""
    r = np.random.default_rng(5)
    model = lm.Model()
    plain, adam = {k: v.astype(np.float64) for k, v in model.p.items()}, lm.Adam(model)
    adam.t, rate = 5000, 0.004  # the rate stays the same
    means = {k: [np.zeros(v.shape), np.zeros(v.shape)] for k, v in plain.items()}
    for i in range(40):
        x, before, y = r.integers(0, 30, (3, 4, lm.CONTEXT + lm.SCORED))
        if i % 7:
            x, before = x // 2, before // 2  # every other row waits
        _, grad = model.step(x, before, y)
        old = model.p["q"].copy()
        adam.step(rate, x, before, y)
        assert set(np.flatnonzero((model.p["q"] != old).any(1))) <= set(x.ravel().tolist())
        for k, g in grad.items():
            m1, m2 = means[k]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g.astype(np.float64) ** 2 - m2)
            plain[k] -= rate * m1 / (np.sqrt(m2) + 1e-8)
    adam.settle()
    for k, v in plain.items():
        assert np.abs(model.p[k] - v).max() < 0.01 * max(np.abs(v - lm.Model().p[k]).max(), 1e-9), k
    halves = model.attend(x)[2]
    assert sum(s[0].size for _, _, s in halves) == 3 * (lm.CONTEXT + lm.SCORED) ** 2 // 4


def test_words_are_added_up_whenever_many_are_held(spark):
    """Against a plain loop, whether a partition hands on its counts once or many times."""
    texts = [*(f"{chained(i, 50)} {passage(i, 30)} LAST" for i in range(50)), None, "", "x" * 5000]
    want = Counter(w.encode() if w else b"" for t in texts for w in words_of(t))
    for keep in (10, 10**6):
        assert {bytes(r["word"]): r["n"] for r in lm.word_counts(frame(spark, texts).repartition(2), keep=keep).collect()} == want
