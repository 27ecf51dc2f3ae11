"""Quality cascade, spelling groups and clustering against plain versions, with odd rows, ties, repeats, clashing names and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from zealmark.llm import quality_rules as qr
from zealmark.llm import sharded_lloyd as sl
from zealmark.llm import spelling as sp

DOCS = "doc_id bigint, text string, lang string, words string, lines string, n_words string, kind string, n string"


def documents(frame, *texts):
    """Rows with columns whose names clash with those the operators use inside."""
    return frame([(i, text, "en", "x", "y", "z", "k", "n") for i, text in enumerate(texts)], DOCS)


# --- quality rules ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_figures(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    rng = random.Random(4)
    vocabulary = ["ab", "cde", "fghij", "é", "日本", "😀", "x*y", "#", "A&B"]
    texts = [None, "", " \n\t\x0b", "a", "ONE TWO", "a\x85b c d", "word " * 5000, "a b c d e f g h " * 2, "a a a a a a a a a", "l\n l\nl\n\n\nl\nm\r\nm\r"]
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 19, 20, 40, 200]))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            words[at:at] = words[: rng.randint(1, 12)]
        texts.append("".join(word + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for word in words))
    return texts


def test_base_figures(frame):
    texts = quality_texts()
    got = {r.doc_id: r for r in qr.judge_quality(documents(frame, *texts)).collect()}
    assert [tuple(got[i][name] for name in qr.BASE) for i in range(len(texts))] == [plain_figures(text) for text in texts]
    for i, text in enumerate(texts):
        n, *_, repeated = plain_figures(text)
        assert got[i].base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (got[i].base_failed and got[i].kept)


def test_verdict_is_that_of_all_rules_in_any_order(frame):
    docs = documents(frame, *quality_texts(), "Some words that a reader could well have written down, " * 1 + " ".join(f"word{i}" for i in range(60)))
    of = qr.figures(F.col("text"))
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rules = (*qr.BASE_RULES, *qr.RULES)
    ways = [qr.cascade([qr.Ordered(rule, 0.0, 0.0) for rule in order], of) for order in (rules, rules[::-1], random.Random(1).sample(rules, len(rules)))]
    any_hit = F.lit(False)
    for rule in rules:
        any_hit = any_hit | F.coalesce(rule.rejects(of), F.lit(False))
    rows = narrow.select("doc_id", *[way.alias(f"w{i}") for i, way in enumerate(ways)], (~any_hit).alias("plain")).collect()
    assert all(r.w0 == r.w1 == r.w2 == r.plain for r in rows) and any(r.plain for r in rows)
    judged = {r.doc_id: r.kept for r in qr.judge_quality(docs).collect()}
    assert judged == {r.doc_id: r.plain for r in rows}
    good = qr.keep_good(docs)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i, kept in judged.items() if kept)


def test_each_rule_rejects_what_it_names(frame):
    fine = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    bad = {
        "word length": " ".join("a" * 11 + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)),
        "symbols": fine + " #" * 20,
        "duplicate lines": "\n".join(f"line {chr(97 + i % 7)} here" for i in range(30)),
        "words without letter": fine + " 123,45" * 30,
        "capitals": fine.upper(),
        "stutter": " ".join(f"{w} {w}" for w in fine.split()),
        "trailing dots": "\n".join(f"{w} and more…  " for w in fine.split()[:30]),
        "bullets": "\n".join(f" - {w} and more" for w in fine.split()[:30]),
        "placeholder": fine + " Lorem IPSUM",
    }
    docs = documents(frame, fine, *bad.values())
    of = qr.figures(F.col("text"))
    hits = docs.select("doc_id", *[rule.rejects(of).alias(rule.name) for rule in qr.RULES]).orderBy("doc_id").collect()
    assert set(bad) == {rule.name for rule in qr.RULES} and not any(hits[0][rule.name] for rule in qr.RULES)
    assert all(hits[1 + i][name] for i, name in enumerate(bad))
    assert [r.kept for r in qr.judge_quality(docs).orderBy("doc_id").collect()] == [True] + [False] * len(bad)


def test_order_is_by_rejection_per_cost(frame, monkeypatch):
    sample = frame([(i, "") for i in range(100)], "doc_id bigint, text string")
    rules = [qr.Rule(str(n), lambda of, n=n: F.col("doc_id") < n) for n in (10, 50, 40)] + [qr.Rule("other", lambda of: F.col("doc_id") >= 70)]
    clock = iter([0, 1, 0, 1, 0, 2, 0, 2, 0, 11, 0, 11, 0, 2, 0, 2, 0, 2, 0, 2])  # idle 1; the rules 1, 10, 1 and 1 more
    monkeypatch.setattr(qr.time, "perf_counter", lambda: next(clock))
    order = qr.order_rules(sample, rules, {})
    # 40 of 100 for 1; 30 of the other 60 for 1; 10 more of 30 for 10; the first rejects none of what is left
    assert [(step.rule.name, round(step.rejected, 3)) for step in order] == [("40", 0.4), ("other", 0.5), ("50", 0.333), ("10", 0.0)]


def test_quality_of_no_rows_and_of_repeated_rows(frame):
    assert qr.judge_quality(documents(frame)).count() == 0 and qr.keep_good(documents(frame)).count() == 0
    twice = documents(frame, "a b").union(documents(frame, "a b")).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert [(r.doc_id, r.n_words, r.kept) for r in qr.judge_quality(twice).collect()] == [(None, 2, False)] * 2


# --- spelling --------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows, every=97):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: f if f is not None and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def as_groups(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def spelling_texts():
    rng = random.Random(6)
    texts = [None, "", "  ", "a b c", "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ", "x" * 3000 + " " + "x" * 3001, "x" * 3000, "x" * 3000 + " " + "x" * 3001, "x" * 3001, "×÷×÷× ×÷×÷× ×÷×÷×"]
    bases = ["colour", "color", "grey-green", "aaaaaa", "ababab", "straße", "naïveté", "wordplay"]
    for _ in range(260):
        words = []
        for _ in range(30):
            word = list(rng.choice(bases) if rng.random() < 0.8 else rng.choice(bases).title())
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
            words.append("".join(word))
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    return texts


@pytest.mark.parametrize("max_words", [5000, 12, 1])
def test_groups_against_all_pairs(frame, spelling_texts, max_words):
    """Also where states are cut again: from 12 words on, and wherever two words meet."""
    got = as_groups(sp.group_spellings(documents(frame, *spelling_texts), max_words=max_words))
    expected = plain_groups(list(enumerate(spelling_texts)))
    assert got == expected
    assert sum(g[4] for g in got) > 500 and any(g[2] not in (g[0], g[1]) for g in got if g[1])


def test_parts_that_are_cut_again_are_small(frame, spelling_texts):
    vocabulary = sp.count_words(documents(frame, *spelling_texts), "doc_id", "text")
    spread = sp.initial_states(vocabulary).select("word", "n", "kind", "size", "at", "start")
    cut = spread.mapInArrow(sp._cut_again, sp.PART).groupBy("kind", "size", "at", "start").count()
    assert cut.agg(F.max("count")).first()[0] <= 12  # the letters at one place, however many words there are


def test_pairs_of_one_part_come_once():
    rng = random.Random(2)
    for _ in range(150):
        words = list({"".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 6, 7]))) for _ in range(30)})
        found = []
        for size in (5, 6, 7):
            half, states = size // 2, {}
            for word in words:
                if len(word) in (size, size + 1):
                    states.setdefault((sp.BEGINNING, word[:half]), []).append(word)
                    states.setdefault((sp.ENDING, word[len(word) - (size - half) :]), []).append(word)
            for (kind, _), reached in states.items():
                found += [tuple(sorted(pair)) for pair in sp.near_pairs(kind, size, half, reached)]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_acceptors_are_minimal_and_accept_their_words():
    machines = sp.Machines()
    words = sorted(["tap", "taps", "top", "tops"])
    start = machines.acceptor(words)
    # t, then a or o to one state, then p, then an optional s: five states for four words
    assert len(machines.states) == 5 and sorted(machines.common(start, start)) == words
    assert machines.common(start, machines.acceptor(["taps", "tip"])) == ["taps"]


def test_spelling_of_odd_tables(frame):
    assert sp.group_spellings(documents(frame)).count() == 0
    assert sp.group_spellings(documents(frame, None, "", "abc ABC")).count() == 0
    rows = documents(frame, "wordy wordy Wordy words words words").withColumn("doc_id", F.lit(None).cast("bigint"))
    # a repeated row counts as often as it stands, a null id is an empty key
    assert as_groups(sp.group_spellings(rows.union(rows))) == plain_groups([(None, "wordy wordy Wordy words words words")] * 2)


# --- clustering ------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, tile int, cluster int, label int"


def plain_lloyd(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(column) // len(vs) for column in zip(*vs)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in out), key=str)


def vectors(frame, rows):
    return frame([(i, v, 0, 0, 1) for i, v in rows], VECTORS)


def as_clusters(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("dims, block, tile", [(6, 4, 7), (6, 1, 1000), (6, 6, 16), (5, 2, 3)])
def test_clusters_against_plain_rounds(frame, dims, block, tile):
    rng = random.Random(dims * block)
    rows = [(i, [round(rng.gauss(3 * (i % 5), 1), 3) for _ in range(dims)]) for i in range(150)]
    rows += [(7, [0.0] * dims)] * 40 + [(None, [-1.5] * dims), (None, [100000.0] * dims)]  # repeated rows, no id, far away
    rows += [(200, None), (201, []), (202, [1.0] * (dims + 1)), (203, [None] * dims), (204, [math.nan] * dims), (205, [math.inf] + [0.0] * (dims - 1))]
    # what a float column holds
    held = [(r.vec_id, r.embedding) for r in vectors(frame, rows).collect()]
    got = sl.cluster_vectors(vectors(frame, rows).repartition(3), k=8, rounds=4, dims=dims, tile=tile, block=block)
    assert as_clusters(got) == plain_lloyd(held, 8, 4, dims)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(frame):
    # equal vectors begin as several centroids: all go to the first, the others stay where they are
    rows = [(i, [1.0, 2.0]) for i in range(6)] + [(9, [1.0, 4.0])]
    got = as_clusters(sl.cluster_vectors(vectors(frame, rows), k=8, rounds=3, dims=2))
    assert got == plain_lloyd(rows, 8, 3, 2) and len({r[1] for r in got}) == 2


def test_no_vectors_and_settings_stay_as_they_were(spark, frame):
    before = spark.conf.get(sl.ARROW_ROWS)
    for rows in ([], [(1, None), (2, [1.0])]):
        assert sl.cluster_vectors(vectors(frame, rows), dims=2).count() == 0
    assert sl.cluster_vectors(vectors(frame, [(1, [1.0, 2.0])]), dims=2).count() == 1
    assert spark.conf.get(sl.ARROW_ROWS) == before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tiles_")]


def test_what_does_not_fit_a_long_is_an_error(frame):
    with pytest.raises(Exception, match="64 bits"):
        sl.cluster_vectors(vectors(frame, [(1, [3e9, 0.0])]), dims=2).count()
