"""Operators on documents, URLs and vectors against brute force, with nulls, ties, repeats and empty tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import (
    chosen_path,
    components,
    decontamination,
    langid,
    line_dedup,
    rp_forest,
    toxicity,
    url_lists,
)

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Lines


def lines_by_hand(rows, least_chars, least_docs):
    holders = defaultdict(set)
    key = lambda line: line.translate(LOWER).strip(" \t\n\x0b\x0c\r")
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        kept, dropped = [], 0
        for line in (text or "").split("\n"):
            found = holders[key(line)]
            if len(key(line)) >= least_chars and len(found) >= least_docs and doc != max(x for x in found if x is not None):
                dropped += 1
            else:
                kept.append(line)
        out.append((doc, len(kept) + dropped, dropped, "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_lines(spark, batches):
    rng = random.Random(batches)
    pool = ["short", "", " A long line of é text ", "a long line of é text", "another line that is long\t", "x" * 30]
    rows = [(n, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for n in range(40)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (7, "x" * 30 + "\nshort"), (None, "x" * 30), (None, None)]
    docs = frame(spark, [(d, t, 1) for d, t in rows], "doc_id long, text string, n_lines int").repartition(3)
    found = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3, batches=batches)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_text"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=repr)
    assert got == sorted(lines_by_hand(rows, 20, 3), key=repr)
    assert line_dedup.dedup_lines(docs.limit(0), batches=batches).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2)
    for n in range(5, 0, -1):
        docs = frame(spark, [(n, "one line that is long"), (n, f"line of {n} that is long")], "doc_id long, text string")
        runs.add(line_dedup.long_lines(docs, "doc_id", "text", 10))
    # Five runs: one merged from four, and the last.
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [(r.keeper,) for r in runs.frequent(5).collect()] == [(5,)]
    assert runs.seen().count() == runs.seen().distinct().count() == 6


# Near duplicates


def components_by_hand(rows, percent=75):
    sets = []
    for _, text in rows:
        w = BLANK.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = [d for k, (d, _) in enumerate(rows) if top(k) == top(i) and d is not None]
        least[i] = min(known, default=None)
    return [(d, len(sets[i]), least[i], least[i] is None or d == least[i]) for i, (d, _) in enumerate(rows)]


def changed(words, rng, share):
    return [w if rng.random() > share else f"w{rng.randint(0, 999)}" for w in words]


def near_rows(seed, groups, copies):
    rng = random.Random(seed)
    rows = []
    boiler = [f"b{n}" for n in range(30)]
    for _ in range(groups):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 80))]
        for _ in range(copies):
            own = changed(words, rng, rng.choice([0, 0.01, 0.03, 0.05]))
            rows.append(" ".join(boiler + own if rng.random() < 0.3 else own))
    rng.shuffle(rows)
    return [(n, t) for n, t in enumerate(rows)]


def test_near_duplicates(spark):
    rows = near_rows(4, 30, 8)
    rows += [(900, None), (901, " \n\t"), (902, "one Two"), (903, "ONE two"), (904, "one two three"), (905, "")]
    rows += [(5, rows[5][1]), (5, "other words " * 9), (None, rows[6][1]), (None, "only here " * 6), (-3, rows[0][1])]
    docs = frame(spark, [(d, t, 0) for d, t in rows], "doc_id long, text string, s1 int").repartition(4)
    found = chosen_path.near_duplicates(docs)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=repr)
    assert got == sorted(components_by_hand(rows), key=repr)
    kept = chosen_path.one_of_each(docs, found)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r[0]) for r in got if r[3])
    assert chosen_path.near_duplicates(docs.limit(0)).count() == 0


def test_large_nodes_branch_and_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 4)
    rows = near_rows(8, 3, 40)
    docs = frame(spark, rows, "doc_id long, text string")
    want = sorted(components_by_hand(rows))
    for levels in (0, 2):
        monkeypatch.setattr(chosen_path, "LEVELS", levels)
        found = chosen_path.near_duplicates(docs).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want


def test_recall_in_large_families(spark, monkeypatch):
    """A family just below the bound stays together for all levels; in it, each set has one partner just above."""
    monkeypatch.setattr(chosen_path, "LEAF", 4)
    # Stars would find the pairs of so small a family; trees have to.
    monkeypatch.setattr(chosen_path, "FIRSTS_LEVEL", -1)
    rows = []
    for n in range(120):
        own = [f"b{k}" for k in range(257)] + [f"w{n}-{k}" for k in range(43)]
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(own[:258] + [f"x{n}-{k}" for k in range(42)]))]
    found = chosen_path.near_duplicates(frame(spark, rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(r.component_id for r in found) == {2 * n: 2 for n in range(120)}


def test_a_pair_comes_from_one_node(spark, monkeypatch):
    """Sets that stay together in many nodes, small ones and blocks, are compared once; no pair is lost by it."""
    given, plain = [], chosen_path.in_one_leaf
    monkeypatch.setattr(chosen_path, "FIRSTS_LEVEL", -1)
    monkeypatch.setattr(chosen_path, "in_one_leaf", lambda *a: given.append(plain(*a)) or given[-1])
    rows = near_rows(8, 3, 20)
    docs = frame(spark, rows, "doc_id long, text string")
    for leaf, levels in ((256, 10), (4, 1)):
        monkeypatch.setattr(chosen_path, "LEAF", leaf)
        monkeypatch.setattr(chosen_path, "LEVELS", levels)
        found = chosen_path.near_duplicates(docs).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted(components_by_hand(rows))
    for pairs in given:
        got = pairs.collect()
        assert len(got) == len(set(got))
    assert given[0].count() > 0


def test_families_below_the_bound_make_no_pairs(spark, monkeypatch):
    """Sets that share a long passage are compared where they are: no rows come of pairs that are no links."""
    given, plain = [], chosen_path.written
    monkeypatch.setattr(chosen_path, "MET", 32)
    monkeypatch.setattr(chosen_path, "written", lambda s, d, label, *a: given.append((label, plain(s, d, label, *a))) or given[-1][1])
    rows = []
    for n in range(400):
        own = [f"b{k}" for k in range(170)] + [f"w{n}-{k}" for k in range(30)]
        rows.append((n, " ".join(own)))
    rows.append((400, rows[7][1] + " end"))
    found = chosen_path.near_duplicates(frame(spark, rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted(components_by_hand(rows))
    # Nodes are larger than a leaf, but comparing them is within what the table allows, and no forest follows.
    assert sum(label == "nodes" for label, _ in given) <= 2
    assert "pairs" not in dict(given) and dict(given)["links"].count() <= 1
    assert dict(given)["sets-met"].count() > 2


def test_blocks_of_one_node(spark):
    """Sets outside the largest component meet all others once; blocks behind ``own`` do not meet each other."""
    rows = [(1, n, 0, 0, 0, n // 10) for n in range(40)]
    blocks = chosen_path._in_blocks(
        frame(spark, rows, "node long, s1 long, s2 long, l1 long, l2 long, at int"), F.lit(2), F.col("at"), "blocks"
    )
    got = Counter()
    for r in blocks.collect():
        left = [m.s1 for m in r.members]
        pairs = itertools.combinations(left, 2) if r.block is None else itertools.product(left, [m.s1 for m in r.block])
        got.update(frozenset(p) for p in pairs)
    assert got == Counter(frozenset(p) for p in itertools.combinations(range(40), 2) if min(p) < 20)


def test_settled_edges(spark):
    kind = "u1 long, u2 long, v1 long, v2 long"
    assert components._settled(frame(spark, [(5, 0, 1, 0), (5, 1, 1, 0), (9, 0, 2, 0)], kind))
    assert not components._settled(frame(spark, [(5, 0, 1, 0), (6, 0, 5, 0)], kind))
    assert not components._settled(frame(spark, [(5, 0, 1, 0), (5, 0, 2, 0)], kind))
    assert components._settled(frame(spark, [(5, 0, 1, 0)], kind).limit(0))


def test_missed_pairs_by_simulation():
    rng = np.random.default_rng(3)
    assert chosen_path.missed(3, 75, 12) == pytest.approx(1.33e-4, rel=0.01)
    for levels, trees in ((4, 2), (8, 6)):
        lost, pairs = 0, 4000
        for agree in rng.random((pairs, chosen_path.BRANCH_PLACES)) < 0.75:
            place = iter(range(chosen_path.BRANCH_PLACES))
            nodes = sum(agree[next(place)] for t in range(trees) for _ in range(2 if t % 3 == 2 else 1))
            for _ in range(levels - 1):
                nodes = sum(agree[rng.choice(64, 1 + (rng.random() < 1 / 3), replace=False)].sum() for _ in range(nodes))
            lost += nodes == 0
        assert lost / pairs == pytest.approx(chosen_path.missed(levels, 75, trees), abs=0.03)


def test_components_of_a_long_chain(spark):
    links = [(n, 0, n + 1, 0) for n in range(40) if n % 13] + [(5, 1, 7, 0), (99, 0, 98, 0)]
    found = components.components(frame(spark, links, "u1 long, u2 long, v1 long, v2 long")).collect()
    top = {(r.u1, r.u2): (r.v1, r.v2) for r in found}
    assert len(found) == len(top)
    assert top[13, 0] == (1, 0) and top[26, 0] == (14, 0) and top[5, 1] == (1, 0) and top[99, 0] == (98, 0)


# Benchmark leaks


ITEMS = [
    (1, "Which river runs through the old town of Arden and its seven mills? The river Fenn runs there."),
    (2, "How many pillars hold the great hall of the northern library?\nForty two."),
    (3, "Name the keeper"),
    (4, None),
    (5, " ... "),
    (6, "How many pillars hold the great hall of the northern library?\nForty two."),
]


def leaks_by_hand(text, items):
    out = set()
    words = decontamination.words_in(text or "")
    for item, t in items:
        own = decontamination.words_in(t or "")
        if own and any(words[i : i + len(own)] == own for i in range(len(words))):
            out.add(item)
    return out


def test_leaks(spark):
    rng = random.Random(2)
    rows = []
    for n in range(40):
        words = [rng.choice("the of river hall old great many how mills library".split()) for _ in range(rng.randint(0, 400))]
        item = ITEMS[n % 6][1]
        if n % 3 == 0 and item:
            at = rng.randint(0, len(words))
            words[at:at] = [item.upper() if n % 2 else item]
        rows.append((n, " ".join(words)))
    rows += [(50, None), (51, ""), (52, ITEMS[1][1]), (52, ITEMS[1][1]), (None, ITEMS[0][1])]
    # A question without its answer is no leak, nor is an answer alone.
    rows += [(60, "How many pillars hold the great hall of the northern library?"), (61, "Forty two.")]
    docs = frame(spark, [(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    found = decontamination.find_leaks(docs, frame(spark, ITEMS, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id) for r in found.collect())
    assert got == Counter((d, i) for d, t in rows for i in leaks_by_hand(t, ITEMS))
    left = decontamination.without_leaks(docs, found, 10).collect()
    gone = {d for d, _ in got}
    assert sorted(repr(r.doc_id) for r in left) == sorted(repr(d) for d, _ in rows if d not in gone)
    assert decontamination.find_leaks(docs, frame(spark, ITEMS[3:5], "item_id long, text string")).count() == 0
    assert decontamination.find_leaks(docs.limit(0), frame(spark, ITEMS, "item_id long, text string")).count() == 0


def test_edited_and_cut_items_are_leaks(spark):
    """One changed word of a last sentence, or a missing last sentence of a longer item, hides nothing."""
    answers = ["Fenn.", "It is the Fenn river.", "The broad river Fenn runs there to this day."]
    items, rows = [], []
    for n, answer in enumerate(answers):
        question = " ".join(f"q{n}w{k}" for k in range(20)) + "?"
        items.append((n, f"{question} {answer}"))
        words = answer.split()
        rows += [(n, question)] + [(n, " ".join([question, *words[:k], "other", *words[k + 1 :]])) for k in range(len(words))]
    docs = frame(spark, rows, "doc_id long, text string")
    found = decontamination.find_leaks(docs, frame(spark, items, "item_id long, text string")).collect()
    assert Counter(r.doc_id for r in found if r.doc_id == r.item_id) == Counter(d for d, _ in rows)


def test_shards_of_the_index_find_the_same(spark, monkeypatch):
    items = frame(spark, ITEMS, "item_id long, text string")
    docs = frame(spark, [(n, t) for n, t in ITEMS], "doc_id long, text string")
    whole = sorted(decontamination.find_leaks(docs, items).collect())
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 1)
    assert sorted(decontamination.find_leaks(docs, items).collect()) == whole and len(whole) == 6


def test_block_max_wand_is_exhaustive_scoring():
    rng = random.Random(6)
    vocabulary = [f"t{n}" for n in range(60)]
    items = [(n, " ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randint(1, 12)))) for n in range(70)]
    seen = Counter(w for _, t in items for w in set(t.split()))
    about = decontamination.Statistics(len(items), sum(len(t.split()) for _, t in items) / len(items), seen)
    for threshold in (0.2, 0.5, 0.9):
        index = decontamination.ItemIndex(items, about, threshold)
        for _ in range(60):
            terms = sorted({index.terms[w] for w in rng.choices(sorted(index.terms), k=rng.randint(1, 25))})
            scores = defaultdict(float)
            for t in terms:
                for item, impact in zip(index.items[t], index.impacts[t]):
                    scores[item] += impact
            got = dict(index.search(np.array(terms)))
            assert got == pytest.approx({i: s for i, s in scores.items() if s >= threshold - 1e-9})


# Nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in rng.normal(size=6)]) for n in range(120)]
    rows += [(200 + n, rows[3][1]) for n in range(30)] + [(300, rows[3][1])]
    odd = [(400, None), (500, [0.0] * 6), (600, [1.0, None] + [0.0] * 4), (700, [float("nan")] + [1.0] * 5)]
    odd += [(800, [1.0]), (900, []), (None, rows[0][1]), (1000, [float("inf")] + [1.0] * 5)]
    table = frame(spark, [(*r, 1) for r in rows + odd + rows[:5]], "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in rp_forest.nearest(table, F.col("id") % 100 == 0, trees=4).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    for query, found in got.items():
        own = dict(rows)[query]
        want = sorted((math.dist(own, v), n) for n, v in rows if n != query)[:10]
        assert [n for n, _ in found] == [n for _, n in want]
        assert [s for _, s in found] == pytest.approx([s for s, _ in want], abs=1e-12)
    assert rp_forest.nearest(table.limit(0), F.col("id") >= 0).count() == 0
    few = rp_forest.nearest(frame(spark, rows[:3], "vec_id long, embedding array<double>"), F.col("id") == 1)
    assert few.count() == 2


def test_recall(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3000, 24)).astype(np.float32)
    table = frame(spark, [(n, v.tolist()) for n, v in enumerate(data)], "vec_id long, embedding array<float>")
    found = defaultdict(set)
    rows = rp_forest.nearest(table, F.col("id") % 100 == 0, sample_rows=500).collect()
    for r in rows:
        found[r.query_id].add(r.vec_id)
    hits = 0
    for query in range(0, 3000, 100):
        distances = np.linalg.norm(data.astype(float) - data[query].astype(float), axis=1)
        hits += len(found[query] & set(np.argsort(distances, kind="stable")[1:11].tolist()))
    assert hits >= 0.9 * 300


# Letters


def test_numerals_are_no_letters(spark):
    from tracelake.llm.hashing import runs_of_letters

    assert runs_of_letters("a²bc½,Ⅷd") == ["a", "bc", "d"] and runs_of_letters("²½Ⅷ³") == []
    texts = ["the cat sat on the mat " * 5, "der hund lief in das haus " * 5] * 30
    model = langid.train(texts, ["en", "de"] * 30)
    docs = spark.createDataFrame([(0, "² ½"), (1, "Ⅷ ③ 12"), (2, "the cat²"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert found[0] == found[1] == found[3] == ("und", 0.0) and found[2][0] == "en"


# URL lists


def test_url_patterns(spark):
    urls = [None, "", "no url", "http://", "HTTPS://u:p@A.B.Example.com:80/x//y/?q=/z#f", "http://h./a"]
    rows = frame(spark, list(enumerate(urls)), "id int, url string").select(
        "id", url_lists.url_patterns(F.col("url")).alias("p")
    )
    found = {r.id: [(p.kind, p.pattern, p.rank) for p in r.p] for r in rows.collect()}
    assert found[0] == [] and found[1] == [("url", "", 10**6)] and found[2] == [("url", "no url", 10**6)]
    assert found[3] == [("url", "http://", 10**6)]
    assert found[4][:4] == [
        ("domain", "com", 1),
        ("domain", "example.com", 2),
        ("domain", "b.example.com", 3),
        ("domain", "a.b.example.com", 4),
    ]
    assert found[4][4:6] == [("path", "a.b.example.com/x", 1001), ("path", "a.b.example.com/x/y", 1002)]
    assert found[5][:2] == [("domain", "h", 1), ("path", "h/a", 1001)]


def test_captures_meet_the_entries_of_their_time(spark):
    day = datetime(2024, 1, 1)
    rng = random.Random(3)
    hosts = ["a.example.com", "b.example.com", "example.org"]
    changes = [
        (name, "domain", rng.choice(hosts + ["example.com"]), rng.random() < 0.6, day + timedelta(days=rng.randint(0, 200)))
        for name in ("one", "two")
        for _ in range(60)
    ]
    changes += [changes[0], ("one", None, "example.com", True, day), ("one", "domain", "example.com", True, None)]
    captures = [
        (n, f"http://{rng.choice(hosts)}/p{n}", day + timedelta(days=rng.randint(-20, 230)), 1) for n in range(120)
    ]
    captures += [captures[0], (900, None, day, 1), (901, captures[1][1], None, 1), (902, "nothing", day, 1)]
    found = url_lists.filter_captures(
        frame(spark, captures, "id long, url string, at timestamp, pattern int"),
        frame(spark, changes, "list_name string, kind string, pattern string, listed boolean, at timestamp"),
        "id",
        "url",
        "at",
    )
    state = defaultdict(dict)
    for name, kind, pattern, listed, at in changes:
        if kind and at:
            old = state[name, pattern].get(at, True)
            state[name, pattern][at] = old and listed
    for r in found.collect():
        _, url, at, _ = next(c for c in captures if c[0] == r.id)
        active = []
        for (name, pattern), dated in state.items():
            before = [t for t in dated if at is not None and t <= at]
            host = (url or "").removeprefix("http://").partition("/")[0]
            if before and dated[max(before)] and url and ("." + host).endswith("." + pattern):
                active.append((-pattern.count("."), name, pattern, max(before)))
        assert r.n_active == len(active) and r.blocked == bool(active)
        if active:
            assert (r.list_name, r.pattern, r.since) == min(active)[1:]
    assert found.count() == len({c[0] for c in captures})
    none = frame(spark, [], "list_name string, kind string, pattern string, listed boolean, at timestamp")
    table = frame(spark, captures, "id long, url string, at timestamp, pattern int")
    assert url_lists.filter_captures(table, none, "id", "url", "at").where("blocked").count() == 0
    assert url_lists.filter_captures(table.limit(0), none, "id", "url", "at").count() == 0


# Classifiers


WORDS = {"en": "the of and with that this", "fr": "le la des une avec pour", "de": "der die und mit auf nicht"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "er", "en"]) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(n, prose(rng, lang := rng.choice(sorted(WORDS)), rng.randint(3, 40)), lang, 1) for n in range(300)]
    odd = [(900, None, "en", 1), (901, "", "fr", 1), (902, "12 34 !", None, 1), (903, "the of and", None, 1)]
    docs = frame(spark, rows + odd, "doc_id long, text string, lang string, score int")
    model = langid.fit(docs.where("doc_id % 4 <> 2"), "text", "lang", ["doc_id"], sample_rows=150)
    found = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text", "score"), model).collect()}
    right = [found[n].lang_pred == lang for n, _, lang, _ in rows if n % 4 == 2]
    assert sum(right) >= 0.95 * len(right)
    for n in (900, 901, 902):
        assert (found[n].lang_pred, found[n].score, found[n].rejected) == ("und", 0.0, True)
    assert found[903].lang_pred in WORDS and all(0 <= r.score <= 1 for r in found.values())
    nothing = langid.fit(docs.limit(0), "text", "lang", ["doc_id"])
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert langid.predict(docs.select("text").limit(0), model).count() == 0


def test_rejection_bounds_the_errors():
    rng = random.Random(4)
    texts = [prose(rng, lang, 12) for lang in sorted(WORDS) for _ in range(80)]
    labels = [lang for lang in sorted(WORDS) for _ in range(80)]
    order = rng.sample(range(240), 240)
    # Every tenth label is wrong, so that accepting everything has too many errors.
    noisy = ["en" if n % 10 == 0 else labels[i] for n, i in enumerate(order)]
    model = langid.train([texts[i] for i in order], noisy)
    assert 0 < model.reject_below <= 1


def test_toxicity(spark):
    rng = random.Random(5)
    bad = {"en": "vilething", "fr": "mauvaischose", "de": "schlimmding"}
    rows, labels, langs = [], [], {}
    for n in range(700):
        lang = rng.choice(sorted(WORDS))
        words = prose(rng, lang, rng.randint(4, 60)).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randint(0, len(words)), bad[lang] + rng.choice(["", "s", "er", "ly"]) + rng.choice(["", ",", "!"]))
        rows.append((n, " ".join(words), lang, "x"))
        labels.append((n, 1, toxic))
    odd = [(900, None, "en", "x"), (901, "", None, None), (902, "VileThings!", None, "x"), (None, "the of", "en", "x")]
    docs = frame(spark, rows + odd, "doc_id long, text string, lang string, score string")
    table = frame(spark, labels + labels[:9] + [(5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table.where("doc_id % 5 <> 0"), sample_rows=300)
    found = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text", "score"), model).collect()}
    wrong = [n for n, _, y in labels if n % 5 == 0 and (found[n] >= 0.5) != bool(y)]
    assert len(wrong) <= 3
    assert all(0 <= s <= 1 for s in found.values()) and found[900] == found[901] < 0.5 <= found[902]
    for empty in (table.limit(0), table.where("toxic = 0")):
        flat = toxicity.score(docs, toxicity.fit(docs, empty)).collect()
        assert all(r.score < 0.5 for r in flat)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    rng = random.Random(9)
    # Toxic texts are long ones only, of more than 20,000 characters.
    rows = [(n, prose(rng, "en", 30 if n % 6 else 5000) + ("" if n % 6 else " vilething the"), "en") for n in range(240)]
    assert all(len(text) > 20_000 for n, text, _ in rows if n % 6 == 0)
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    labels = frame(spark, [(n, int(n % 6 == 0)) for n, _, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "LEARNER_ROWS", 100)
    seen = []
    summed = toxicity._summed
    monkeypatch.setattr(toxicity, "_summed", lambda *a: seen.append(summed(*a)) or seen[-1])
    model = toxicity.fit(docs, labels)
    # Toxic rows and all when counting, and all rows in every round.
    assert seen[0][-2:].tolist() == [40, 240] and [s[-1] for s in seen[1:]] == [240] * toxicity.EPOCHS
    asked = frame(spark, [(0, "of the vilething and the"), (1, "the of and")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert found[0] >= 0.5 > found[1]


def test_toxicity_has_all_rounds_on_large_tables(spark, monkeypatch):
    rng = random.Random(10)
    docs = frame(spark, [(n, prose(rng, "en", 9) + " vilething" * (n % 2)) for n in range(60)], "doc_id long, text string")
    labels = spark.range(60_000).selectExpr("id AS doc_id", "cast(id % 2 as int) AS toxic")
    seen = []
    summed = toxicity._summed
    monkeypatch.setattr(toxicity, "_summed", lambda *a: seen.append(summed(*a)) or seen[-1])
    toxicity.fit(docs, labels)
    assert seen[0][-2:].tolist() == [30, 60] and [s[-1] for s in seen[1:]] == [60] * toxicity.EPOCHS


def test_words_of_many_tokens():
    from tracelake.llm.hashing import _marked_words, runs_of_letters

    rng = random.Random(5)
    odd = "aZß²½Ⅷ٣_-'.é\U00010400\ud800\u0345"
    for tokens in ([], [""], ["a", "b"], ["".join(rng.choices(odd, k=rng.randint(0, 6))) for _ in range(3000)]):
        codes, sizes, owner = _marked_words(tokens)
        found, at = [], 0
        for size, n in zip(sizes.tolist(), owner.tolist()):
            found.append((n, "".join(chr(c - 1) for c in codes[at : at + size].tolist())))
            at += size
        assert at == len(codes) and found == [(n, f"<{w}>") for n, t in enumerate(tokens) for w in runs_of_letters(t)]


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, "en", 50) + (" vilething" if n % 2 else "") for n in range(200)]
    model = toxicity.train(texts, [n % 2 for n in range(200)], ["en"] * 200)
    long = [prose(rng, "en", 900) + " vilething " + prose(rng, "en", 300), prose(rng, "en", 1200)]
    whole = model.scores(model.rows(), long)
    monkeypatch.setattr(toxicity, "TOKENS_AT_ONCE", 64)
    monkeypatch.setattr(langid, "TOKENS_AT_ONCE", 64)
    assert model.scores(model.rows(), long) == pytest.approx(whole, rel=1e-4)
