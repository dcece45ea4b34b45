"""Prefix tries, ranked search and language identification against brute force and held-out accuracy, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import language, lexical_search, prefix_trie
from palisade.llm.queries import held_out

TURNS = "conv_id long, turn long, role string, text string, depth string, d int, range string, rep long"
NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


# ---- 11


def trie_of(rows):
    """Nodes by whole sequences, the slow and plain way."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        has_child = {n[:-1] for n in members if n}
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(node)))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = sum(1 for n in below if len(n) == len(node) + 1)
        leaves = sum(1 for n in below if n not in has_child)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TURNS)


def some_turns(rng, convs, most, words="ab"):
    rows = []
    for c in convs:
        for turn in range(rng.randrange(most + 1)):
            rows.append((c, rng.choice([None, turn, turn, turn, 0]), rng.choice(["user", "bot", None, ""]), rng.choice([None, "", "é" * 3, *words])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rng = random.Random(seed)
    rows = some_turns(rng, [*range(-7, 30), 1000], 13) + [(None, 1, "user", "a")]
    rows += [(50 + i, t, "user", "same") for i in range(12) for t in range(11)]
    rows += rows[:9]
    got = sorted(tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(turns_of(spark, rows)).collect())
    assert got == trie_of(rows)


def test_trie_of_a_long_conversation_over_many_ranges(spark):
    rows = [(5, t, "user", "a" if t % 3 else f"{t % 50}") for t in range(3000)] + [(6, t, "user", f"{t}") for t in range(40)]
    rows += [(5, None, "user", "twin")] * 40 + [(c, 1, "user", "a") for c in range(100, 130)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(turns_of(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    h = zlib.crc32(b"6") % 9
    assert max(d for c, d in got if c == 5) == 3040 and sum(1 for c, _ in got if c == 6) == 40 - h
    assert got[5, 0].n_convs == 32 and got[5, 3040].ends_sha256 == hashlib.sha256(b"5").hexdigest()
    assert got[5, 0].n_leaves == sum(1 for r in got.values() if r.n_children == 0)
    chain = [got[5, d] for d in range(3041)]
    assert all(a.n_convs >= b.n_convs and a.saved_tokens >= b.saved_tokens for a, b in zip(chain, chain[1:]))


def test_trie_members_that_end_in_one_node_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 7)
    monkeypatch.setattr(prefix_trie, "HOT_CHILDREN", 3)
    rows = [(c, 0, "user", "hello") for c in range(0, 500, 5)] + [(c, 1, "bot", f"{c % 7}") for c in range(0, 500, 25)]
    got = sorted(tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(turns_of(spark, rows)).collect())
    assert got == trie_of(rows)


def test_trie_never_joins_different_turns_that_share_a_fingerprint(spark, monkeypatch):
    """With 13 residues fingerprints meet: each attempt notices, so the result is right or there is none."""
    monkeypatch.setattr(prefix_trie, "P", 13)
    monkeypatch.setattr(prefix_trie, "ATTEMPTS", 2)
    rows = [(c, t, "user", f"{c} {t}") for c in range(0, 400, 5) for t in range(6)]
    monkeypatch.setattr(prefix_trie.Residues, "__init__", lambda self, attempt: self.__dict__.update(attempt=attempt, bases=[2, 6, 7]))
    with pytest.raises(RuntimeError, match="fingerprints met"):
        prefix_trie.prefix_trie(turns_of(spark, rows))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(turns_of(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turns_of(spark, [(None, 1, "user", "a")])).count() == 0


# ---- 12


def ranking(docs, items, k):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    texts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in texts if c)
    total = sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc, c in texts:
            if c:
                m = 100 - 90 + (90 * sum(c.values()) * n) // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
                if s > 0:
                    scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int")
    items = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.ranked_search(docs, items, **options).collect()), key=repr)


@pytest.mark.parametrize("per_block", [500_000, 4])
def test_ranked_search(spark, monkeypatch, per_block):
    monkeypatch.setattr(lexical_search, "CELLS", 50)
    rng = random.Random(4)
    words = [*"abcdefghij", "Éa", "日本", "x1", "A_b", "İ"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "\0", ". "]) for _ in range(rng.randrange(n)))
    docs = [(i, text(40)) for i in range(150)] + [(None, "a b"), (None, "zz a"), (3, None), (4, ""), (5, "!?")]
    docs += docs[:20] + [(900, "a " * 30_000 + "rare")]
    items = [(i, text(8)) for i in range(12)] + [(5, "zz"), (None, "rare c"), (77, None), (78, ""), (79, "nowhere")]
    assert search(spark, docs, items, k=4, postings_per_block=per_block) == ranking(docs, items, 4)


def test_ranked_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, None)], [(1, "a")]) == []


def test_heaps_keep_the_smaller_ids_of_equal_scores():
    heaps = lexical_search.Heaps(2, 3)
    for ids in ([9, 8, 7], [1, 20], [0, 5]):
        heaps.add(np.array([[4, 0]] * len(ids)), np.array(ids), np.zeros(len(ids), bool))
    assert heaps.rows([10, None]).to_pydict() == {"item_id": [10] * 3, "doc_id": [0, 1, 5], "score": [4] * 3}


# ---- 13

ENGLISH = "the river was cold and the house stood under green light with old stone walls".split()
GERMAN = "der Fluß war kalt und das Haus stand unter grünem Licht mit alten Mauern aus Stein".split()
GREEK = "το ποτάμι ήταν κρύο και το σπίτι έστεκε κάτω από πράσινο φως με παλιούς τοίχους".split()


def some_texts(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(w) for _ in range(rng.randrange(4, 40))), lang) for i, (w, lang) in enumerate((rng.choice([(ENGLISH, "en"), (GERMAN, "de"), (GREEK, "el")]) for _ in range(n)))]


def language_rows(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", 1.5) for i, t, l in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_language_by_held_out_accuracy(spark):
    rows = some_texts(600)
    odd = [(10_001, None, "en"), (10_002, "", "de"), (10_003, "123 !? ²", "el"), (None, "the house stood", "en"), (10_005, "the river was cold", None), (10_006, "und das Haus stand " * 30_000, None)]
    docs = language_rows(spark, rows + odd + rows[:5])
    model = language.fit(docs, ~held_out(F.col("doc_id")), per_language=100)
    assert model.languages == ["de", "el", "en"] and model.temperature > 0
    assert 0 < (model.weights != 0).mean() < 0.2
    got = language.identify(docs, model).collect()
    assert docs.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and len(got) == 611 and set(got[0].asDict()) == set(docs.columns)
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [by_id[i] for i in (10_001, 10_002, 10_003)] == [("und", 0.0)] * 3
    assert by_id[None][0] == "en" and by_id[10_005][0] == "en" and by_id[10_006][0] == "de"
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    lang = {i: l for i, _, l in rows}
    assert len(held) > 80 and sum(by_id[i][0] == lang[i] for i in held) >= 0.98 * len(held)


def test_language_learns_from_its_fold_alone(spark):
    rows = some_texts(200)
    wrong = [(i, t if zlib.crc32(str(i).encode()) % 5 else "zzz qqq", l if zlib.crc32(str(i).encode()) % 5 else "xx") for i, t, l in rows]
    one, two = (language.fit(language_rows(spark, x), ~held_out(F.col("doc_id"))) for x in (rows, wrong))
    assert one.languages == two.languages and (one.weights == two.weights).all() and (one.idf == two.idf).all() and one.temperature == two.temperature


def test_language_without_rows_to_learn_from(spark):
    docs = language_rows(spark, [(1, "the house", None), (2, "12", "en")])
    for rows in (docs, docs.limit(0), docs.where("lang is not null")):
        model = language.fit(rows)
        assert [(r.lang_pred, r.score) for r in language.identify(docs, model).collect()] == [("und", 0.0)] * 2
    one = language.fit(language_rows(spark, [(1, "the house", "en")]))
    assert [(r.lang_pred, r.score) for r in language.identify(docs, one).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0)]
    assert language.identify(docs.limit(0), one).count() == 0


def test_counts_of_pieces_equal_those_of_the_whole(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé ß1,.  Zन्") for _ in range(rng.randrange(400))) for _ in range(30)]
    whole = [language.gram_counts(t) for t in texts]
    monkeypatch.setattr(language, "PIECE", 7)
    for (a, b), (x, y) in zip(whole, map(language.gram_counts, texts)):
        assert (a == x).all() and (b == y).all()


def test_temperature_restores_the_odds():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    p = language.softmax(logits)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language.fit_temperature(logits * 5, labels) - 5) < 0.5
    assert language.fit_temperature(np.empty((0, 3)), np.empty(0, int)) == 1.0
