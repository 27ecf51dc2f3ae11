"""Each corpus operator against a plain version, with nulls, empty and odd texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zealmark.llm import chat_format, decontaminate, fingerprint, jaccard_join, language, main_text, mixture, token_files, toxicity, warc
from zealmark.llm.common import words_of
from zealmark.session import scratch_path

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, node string, size string"


def documents(frame, *texts, source="s"):
    """Rows with columns whose names clash with those the operators use inside."""
    return frame([(i, text, "en", source, "x", "y") for i, text in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t", "a", "A b", "!!!", "é ß 日本 😀", "x " * 3000, "the same five words here", "The same five words here", "the same five words here"]


# --- main text -----------------------------------------------------------------------------

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href="/x">Menu</a></nav>'
    '<div class="cookie-notice">Accept all of our cookies now</div><article><h1>Head &amp; line</h1><p><b>One  two\n three.<br><p>Four&nbsp;five'
    '</p><aside>Buy this</aside><p>Six s<i>ev</i>en.</p></article><section id="comments"><p>First comment here by a reader!</p></section>'
    "<form>Search</form><footer>&copy; all rights</footer></body></html>"
)


def test_main_text(frame):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words only"), (5, "u", "<p>a < b &lt; c"), (5, "u", PAGE), (None, "u", "<<a<b 'x")]
    got = main_text.extract_main_text(frame(rows, "page_id bigint, url string, html string")).collect()
    text = "Head & line One two three. Four five Six seven."
    assert [r.text for r in got][:6] == [text, "", "", "plain words only", "a < b < c", text]
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text.extract_main_text(frame([], "page_id bigint, url string, html string")).count() == 0


def texts_of(frame, *pages):
    rows = [(i, "u", page) for i, page in enumerate(pages)]
    return [r.text for r in main_text.extract_main_text(frame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]


def test_articles_in_furniture_are_no_labels(frame):
    body = " ".join(f"word{i}" for i in range(40))
    comments = f'<p>{body}</p><div id="comments"><article class="comment-body"><p>a reader wrote this</p></article></div>'
    teaser = f"<p>{body}</p><aside><article>Read this too</article></aside>"
    assert texts_of(frame, comments, teaser, f"<p>{body}</p>", PAGE)[:3] == [body] * 3


def test_links_of_text_blocks_are_kept(frame):
    inside = "<div><p>See <a href=x>the report</a> for details</p></div>"
    edges = "<ul><li><a href=n>News</a></li></ul><p><a href=x>This report</a> has all the many details of it<br>and so has <a href=y>that one</a></p>"
    assert texts_of(frame, inside, edges, PAGE)[:2] == ["See the report for details", "This report has all the many details of it and so has that one"]


BODY = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize(
    "page",
    [
        f'<nav>Menu</nav><article class="post category-privacy"><p>{BODY}</p></article>',
        f'<main><article class="post category-privacy"><p>{BODY}</p></article></main>',
        f'<div class="layout has-sidebar"><article><p>{BODY}</p></article><div class="sidebar">Other things</div></div>',
        f'<div class="layout has-sidebar"><div><p>{BODY}</p></div><div class="sidebar">Other things</div></div>',
        f'<div id="search-results"><p>{BODY}</p></div>',
        f"<body><form><nav>Menu</nav><div><p>{BODY}</p></div><footer>All rights</footer></form></body>",
        f'<div class="overflow-hidden rounded"><p>{BODY}</p></div><p hidden>Not this</p>',
        f'<div aria-hidden="false"><p>{BODY}</p></div><div aria-hidden="true">Nor this</div><div style="color:red; display: none">or this</div>',
        f'<p>{BODY}</p><div id="comments"><article class="comment-body">a reader wrote this</article></div>',
        f'<article><p>{BODY}</p></article><article class="comment">a reader wrote this</article><div class="comments">and this</div>',
    ],
)
def test_names_of_furniture_are_no_veto(page):
    runs, _ = main_text.tokens(page)
    assert " ".join(r.text for r in runs if r.place < main_text.FURNISHED and r.words).split()[:40] == BODY.split()
    counts = {}
    for batch in main_text._label_counts(iter([pa.RecordBatch.from_pydict({"html": [page, PAGE]})])):
        counts = {t: (a, b) for t, a, b in zip(*batch.to_pydict().values(), strict=True)}
    assert main_text.main_text(page, main_text._weights(counts)) == BODY


def test_learned_names():
    """Where labelled pages show a name beside their article, words under it are no main text of other pages, be they the most."""
    short, long = "word " * 30, "reply " * 60
    pages = [f'<main>{short}</main><div class="comments">{long}</div>', f'<div>{short}</div><div class="comments"><p>{long}</p></div>']
    (batch,) = main_text._label_counts(iter([pa.RecordBatch.from_pydict({"html": pages})]))
    weights = main_text._weights({t: (a, b) for t, a, b in zip(*batch.to_pydict().values(), strict=True)})
    assert [main_text.main_text(page, weights) for page in pages] == [short.strip()] * 2


def test_best_region_against_all_regions():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        begin, end = main_text.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[begin:end]) == max(best, 0)


# --- toxicity ------------------------------------------------------------------------------


def test_nearest_is_exact():
    rng = random.Random(3)
    terms = {bytes([i]): i for i in range(40)}
    examples = [(i, i % 3 == 0, {rng.randrange(40): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}) for i in range(900)]
    index = toxicity.build_index(examples, terms)
    dense = np.zeros((len(index.ids), 40))
    for t in range(40):
        span = slice(index.starts[t], index.starts[t + 1])
        dense[index.examples[span], t] = index.weights[span]
    for _ in range(300):
        found, weights = toxicity._weighted({rng.randrange(40): rng.randint(1, 3) for _ in range(rng.randint(1, 8))}, index.idf)
        query = np.zeros(40)
        query[found] = weights
        full = dense @ query
        wanted = np.lexsort((np.arange(len(full)), -np.round(full, 9)))[: toxicity.NEIGHBOURS]
        places, cosines = toxicity.nearest(index, found, weights)
        assert places.tolist() == wanted[full[wanted] > 0].tolist() and np.allclose(cosines, full[places])


@pytest.mark.parametrize("per_class", [3000, 120])  # all examples of the rarer label fit the index, of the other not
def test_toxicity_learns_and_keeps_clean_rows(spark, frame, monkeypatch, per_class):
    monkeypatch.setattr(toxicity, "PER_CLASS", per_class)
    rng = random.Random(5)
    common = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(common, k=40) + (["vile"] * (i % 4 == 0))) for i in range(600)]
    docs = documents(frame, *texts, *ODD)
    labels = frame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn_toxicity(docs.where("doc_id < 400"), labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400, 600))
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in range(600, 600 + len(ODD)))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    nothing = toxicity.learn_toxicity(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs.limit(0), nothing).count() == 0


def test_rare_words_are_terms(frame):
    """Toxic words that few examples hold still lead to the examples that hold them."""
    rng = random.Random(9)
    common = [f"w{i}" for i in range(300)]
    toxic = lambda i: [f"foul{i // 8 % 20}"] * 2  # noqa: E731  # each in some five labelled texts
    texts = [" ".join(rng.choices(common, k=12) + (toxic(i) if i % 4 == 0 else [])) for i in range(800)]
    docs = documents(frame, *texts)
    labels = frame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    model = toxicity.learn_toxicity(docs.where("doc_id < 600"), labels)
    words = {word for i in range(600) for word in texts[i].encode().split()}
    index = {word for word in words if b"=" + word in model.index.terms}
    assert all(b"=" + word.encode() in model.index.terms for word in {t for i in range(0, 160, 4) for t in toxic(i)}) and len(index) > 300
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(600, 800)) >= 190
    assert all(got[i].evidence[0] % 4 == 0 for i in range(600, 800, 4))


def test_scorer_finds_the_terms_of_words_it_has_not_seen():
    """Counts are those of a plain look-up of every word's terms, and texts of new words leave nothing behind in the worker."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 8)))
    learner = toxicity.Learner()
    bags = learner.counts_of([" ".join(word() for _ in range(30)) for _ in range(40)])
    index = toxicity.build_index([(n, n % 2, bag) for n, bag in enumerate(bags)], learner.terms)
    assert index.terms == learner.terms
    scorer = toxicity.Scorer(index)
    held = [len(index.names.words), len(index.names.beginnings), len(index.names.terms)]
    for _ in range(20):
        texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(30)]
        for text, (terms, counts) in zip(texts, scorer.counts_of(texts), strict=True):
            plain = Counter(index.terms[t] for w in toxicity.tox_words(text) for t in toxicity.terms_of(w) if t in index.terms)
            assert dict(zip(terms.tolist(), counts.tolist())) == plain and sorted(plain) == terms.tolist()
    assert held == [len(index.names.words), len(index.names.beginnings), len(index.names.terms)]


@pytest.mark.parametrize("toxic", [20, 40, 120])  # of 4000: 0.5, 1 and 3 %
def test_rare_label_keeps_its_rate(toxic):
    rng = np.random.default_rng(2)
    labels = np.repeat([1.0, 0.0], [toxic, 4000 - toxic])
    votes = np.where(labels == 1, rng.uniform(0.7, 1, 4000), rng.uniform(0, 0.5, 4000) * (rng.random(4000) < 0.3))
    curve = toxicity.calibrate(votes, labels)
    scores = curve.score(np.array([0.0, 0.2, 0.49, 0.72, 0.85, 1.0]))
    assert (scores[:3] < 0.05).all() and (scores[3:] > 0.8).all() and (np.diff(scores) >= 0).all()


# --- language ------------------------------------------------------------------------------


def test_language(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    model = language.learn_languages(docs.where(~held))
    got = language.identify_language(docs.where(held), model).join(docs, "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    odd = {r.doc_id: r for r in language.identify_language(documents(frame, *ODD), model).collect()}
    assert [odd[i].lang_pred == "und" for i in range(7)] == [True, True, True, False, False, True, False]
    assert language.learn_languages(docs.limit(0)) is None
    assert language.identify_language(documents(frame, "abc"), None).first().lang_pred == "und"


# --- mixture -------------------------------------------------------------------------------


def test_mixture_meets_targets(spark, collected):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("target", F.lit("clash"))
    mixed = mixture.mix_sources(docs)
    rows = mixed.collect()
    total = Counter()
    for r in rows:
        total[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"]) and r["size"] == len([w for w in words_of(r.text.encode())])
    target = {r.source: r.target for r in rows}
    assert all(abs(total[s] - target[s]) <= max(50, 0.01 * target[s]) for s in target)
    assert collected(mixture.mix_sources(docs).select("doc_id", "taken")) == collected(mixed.select("doc_id", "taken"))


def test_mixture_edge_rows(frame):
    docs = frame([(i, t, "en", s, "x", "y") for i, (t, s) in enumerate(zip(ODD, [None, "b", "a"] * 4))] + [(None, "q q", "en", "a", "x", "y"), (3, "a", "en", "b", "x", "y")], DOCS)
    rows = mixture.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixture.mix_sources(docs.limit(0)).count() == 0


def test_quotas_and_flow():
    sizes = {"a": 100, "b": 100, "c": 100, None: 10}
    target = mixture.quotas(sizes)
    assert target["a"] == 200 and target[None] == 20 and sum(target.values()) == pytest.approx(465)
    flow = mixture.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b", "c"): 5}, {"a": 15.0, "b": 12.0, "c": 6.0})
    into = Counter()
    for p, copies in flow.items():
        size = {("a",): 10, ("a", "b"): 10, ("b", "c"): 5}[p]
        assert all(sum(c.values()) <= size + 1e-6 for c in copies)
        for c in copies:
            into.update(c)
    assert into == pytest.approx({"a": 15, "b": 12, "c": 6})
    assert sum(sum(f[0].values()) for f in flow.values()) == pytest.approx(25)  # nothing repeats before all is used


# --- fingerprints --------------------------------------------------------------------------


def test_fingerprints(frame):
    texts = [" ".join(random.Random(i).choices([f"w{k}" for k in range(80)], k=300)) for i in range(40)]
    docs = documents(frame, *texts, *ODD)
    got = sorted(fingerprint.fingerprint_documents(docs).collect(), key=lambda r: -r.doc_id)
    text = {i: t or "" for i, t in enumerate([*texts, *ODD])}
    errors = []
    for k, r in enumerate(got):
        own, following = text[r.doc_id], text[got[(k + 1) % len(got)].doc_id]
        changed = fingerprint.edited(own, following)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = Counter(words_of(own.encode())), Counter(words_of(changed.encode()))
        if a and b and r.doc_id < 40:
            errors.append(r.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[48] == same[49] == same[50] and same[40] == same[41] != same[43]
    one = fingerprint.fingerprint_documents(documents(frame, "a b c d")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.fingerprint_documents(docs.limit(0)).count() == 0


# --- chat ----------------------------------------------------------------------------------


def test_chat_round_trip(frame):
    rng = random.Random(2)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "[SEP]", "\\", "<", "[", "s>", " ok ", "\n", "<\\s>", "[\\/INST]", "é"]
    turns = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 9)):
            turns.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "".join(rng.choices(parts, k=6))])))
    df = frame(turns, "conv_id bigint, turn bigint, role string, text string")
    examples = chat_format.format_conversations(df)
    assert examples.where("target_turn is not null").count() == sum(t[2] == "assistant" for t in turns)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    by = defaultdict(list)
    for conv, _, role, text in turns:
        by[conv].append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, rows in by.items():
        loss = "".join(text for role, text in rows if role == "assistant")
        assert got[conv].n_turns == len(rows) and got[conv].loss_chars == len(loss)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


# --- benchmark -----------------------------------------------------------------------------


def test_benchmark_windows_against_all_places(frame, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["the", "of", "A1", "é", "x", "y"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for i in range(30)] + [(None, "x y"), (7, None), (8, "...")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)] + [items[3][1].upper(), *ODD]
    benchmark = frame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 700)  # several slices
    got = {r.doc_id: r for r in decontaminate.find_benchmark(documents(frame, *texts), benchmark).collect()}
    windows = defaultdict(set)
    for item, text in items:
        words = decontaminate.bench_words((text or "").encode())
        for at in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[at : at + 10])].add("" if item is None else str(item))
    for i, text in enumerate(texts):
        words, hit, found = decontaminate.bench_words((text or "").encode()), set(), set()
        for window, of in windows.items():
            for at in range(len(words) - len(window) + 1):
                if tuple(words[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    found |= of
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontaminate.find_benchmark(documents(frame, "x"), benchmark.limit(0)).first().contaminated is False


# --- token files ---------------------------------------------------------------------------


@pytest.mark.parametrize("cached", [token_files.CACHED_PIECES, 40])  # the second one starts anew with nearly every group
def test_new_runs_of_a_group_are_learned_together(monkeypatch, cached):
    monkeypatch.setattr(token_files, "CACHED_PIECES", cached)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder, calls = Tokenizer.from_file(path), token_files.Encoder(path, 2), []

    class Counted:
        def encode(self, text, **kw):
            calls.append(text)
            return plain.encode(text, **kw)

        def encode_batch(self, texts, **kw):
            calls.append(texts)
            return plain.encode_batch(texts, **kw)

    encoder.tokenizer = Counted()
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeéüßñ", k=rng.randint(3, 9))) + rng.choice(["", ".", ",", "!?"])
    for _ in range(4):
        texts = [" ".join(word() for _ in range(10)) for _ in range(60)] + ["", "  \n", texts[0] if calls else "12 b4-c <|endoftext|>"]
        found = encoder.encode_all([text.encode() for text in texts])
        assert [np.frombuffer(ids, "<u2").tolist() for ids in found] == [plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert len(calls) <= 8  # not some for each text


def test_a_run_is_looked_up_once_a_group_whatever_its_case_and_mark():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder, asked = Tokenizer.from_file(path), token_files.Encoder(path, 2), []

    class Known(dict):
        def get(self, run, default=None):
            asked.append(run)
            return super().get(run, default)

    encoder.known = Known()
    words = ["garden", "stone", "niño", "window"]
    text = " ".join(f"{w} {w.title()}, {w.upper()}. {w}?" for w in words)
    # case counts before a mark that combines and in control tokens; texts have their own ends
    groups = [[text, text, "Garden", "", "\t \r\n", "H̱ ẖ K. Garden."], ["<|ENDOFTEXT|> <|endoftext|>A.", text, "'S 's."], [], ["", " "], [text]]
    for texts in groups:
        asked.clear()
        found = encoder.encode_all([t.encode() for t in texts])
        assert [np.frombuffer(ids, "<u2").tolist() for ids in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(asked) == len(set(asked))
    assert len(asked) <= len(words) + 5  # the last text's words, the marks, and the word that ends in no ASCII capital


def test_token_files(spark, frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(6)
    parts = ["a", "B", "é", "É", "ü,", "Ñ", "ß", "µ", "H̱", "Σ", " ", "\n", "'s", "'", "<|endoftext|>", "<", "|", ".", "%%", "1", "́", "😀", "日", "\x1f", "İ"]
    encoder = token_files.Encoder(path, 4)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    docs = documents(frame, *ODD)
    manifest = token_files.write_tokens(docs.unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint"))), scratch_path(spark, "tokens"), path)
    start = 0
    rows = sorted(token_files.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(len(ODD))]
    for r in rows:
        ids = [*tokenizer.encode(ODD[6 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_tokens(spark, token_files.write_tokens(docs.limit(0), scratch_path(spark, "tokens"), path)).count() == 0


# --- near duplicates -----------------------------------------------------------------------


def classes(texts):
    """Least id of each text's class, by comparing all pairs."""
    sets = []
    for text in texts:
        words = words_of((text or "").encode())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [len(s) for s in sets], root


def test_near_duplicates_against_all_pairs(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_NODES", 4)  # frequent keys occur in a small table
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 12, 30, 90, 200]))]
        if group % 3 == 0:
            base += passage  # shared by several groups
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [*ODD, texts[0].upper()]
    sizes, root = classes(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(documents(frame, *texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == root
    kept = jaccard_join.keep_one_of_each(documents(frame, *texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == documents(frame).columns


def test_near_duplicates_in_many_blocks(frame, monkeypatch):
    """Variants of one text, many of which link with a few others only, and of one whose sketches have to be folded."""
    for name, value in (("HOT_NODES", 4), ("BLOCK_REPS", 3), ("BLOCK_NODES", 7)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(12)
    texts = []
    for length, copies, edits in ((60, 60, 4), (900, 8, 60)):
        base = [f"v{length}w{i}" for i in range(length)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sizes, root = classes(texts)
    assert len(set(root)) > 5  # some stay apart, so several nodes have to stand for a key
    dealt, blocks = [], jaccard_join._blocks
    monkeypatch.setattr(jaccard_join, "_blocks", lambda open_, standing, firsts: (dealt.append((open_.count(), standing.groupBy("key").count().agg({"count": "max"}).first()[0])), blocks(open_, standing, firsts))[1])
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(documents(frame, *texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == root
    assert dealt and max(n for _, n in dealt) > 7  # several chunks and parts


def test_bounds_of_the_sketches():
    rng = random.Random(9)
    for _ in range(300):
        both, a, b = rng.randint(1, 300), rng.randint(0, 40), rng.randint(0, 40)
        if 100 * both < 75 * (both + a + b):
            continue
        tokens = jaccard_join._mixed(np.array(rng.sample(range(10**9), both + a + b), np.uint64))
        one, two = np.sort(tokens[: both + a]), np.sort(np.concatenate([tokens[:both], tokens[both + a :]]))
        assert a + b <= min(jaccard_join.most_apart(len(one)), jaccard_join.most_apart(len(two)))
        shared = set(jaccard_join.bands_of(len(one))) & set(jaccard_join.bands_of(len(two)))
        assert shared
        met = 0
        for band in shared:
            (k1, s1), (k2, s2) = jaccard_join.band_keys(one, band), jaccard_join.band_keys(two, band)
            common = len(np.intersect1d(k1, k2))
            met += common
            assert common >= max(s1, s2)
        assert met


# --- archives ------------------------------------------------------------------------------


def test_archive(spark, frame):
    big = "é<p>" * 70_000
    pages = [(1, "u\r\nx", "a"), (2, None, "a"), (3, "u", big), (9, "u", big), (4, "u", None), (5, "u", ""), (6, "u%0A", "b"), (6, "u", "c"), (7, "u", "d"), (7, "u", "d"), (None, "u", "d")]
    df = frame(pages, "page_id bigint, url string, html string").withColumn("sha1", F.lit("clash"))
    got = warc.archive_pages(spark, df).collect()
    largest: dict = {}
    for page, _, html in pages:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    wanted = Counter()
    for page, _, html in pages:
        payload = (html or "").encode()
        last = largest[html or ""]
        kept = page == last
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        wanted[page, len(payload), digest, "response" if kept else "revisit", None if kept else last] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted
    chunks = warc.read_warc(spark, warc.write_warc(df.where("page_id in (1, 9)"), scratch_path(spark, "warc")))
    data = {p: b"".join(bytes(r.data) for r in sorted(chunks.where(F.col("page_id") == p).collect(), key=lambda r: r.chunk_no)) for p in (1, 9)}
    assert data == {1: b"a", 9: big.encode()} and {r.url for r in chunks.where("page_id = 1").collect()} == {"u\r\nx"}
    assert chunks.where("page_id = 9").count() == -(-len(big.encode()) // warc.CHUNK_BYTES)
    # small payloads are never revisits
    small = warc.records_of(warc.read_warc(spark, warc.write_warc(df, scratch_path(spark, "warc"), min_bytes=5), with_data=False))
    assert {r.record_type for r in small.where("payload_bytes < 5").collect()} == {"response"}
    assert warc.archive_pages(spark, df.limit(0)).count() == 0
