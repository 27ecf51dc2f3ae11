"""Pipeline stages on rows with repeated and missing ids and columns named as the operators name theirs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from zealmark.llm import decontaminate, jaccard_join, language, toxicity, warc
from zealmark.session import scratch_path, stage

NAMES = ("size", "copies", "taken", "target", "source_size", "__copy", "__size", "__key", "__id", "__hit", "row", "key", "id", "class", "score")
DOCS = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{name} string" for name in NAMES)


def documents(frame, *rows):
    return frame([(i, text, "en", source, *[f"{name} of {k}" for name in NAMES]) for k, (i, text, source) in enumerate(rows)], DOCS)


def numbers(df):
    """Which rows these are, each told by one of its further columns, which must be whole."""
    rows = df.collect()
    out = sorted(int(r["size"].split()[-1]) for r in rows)
    assert all(r[name] == f"{name} of {r['size'].split()[-1]}" for r in rows for name in NAMES)
    return out


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_duplicates_keep_one_row_of_each_class(frame):
    base, other = words(1, 60), words(2, 60)
    near = " ".join([*base[:-1], "changed"])
    docs = documents(
        frame,
        (7, " ".join(base), "a"),
        (7, near, "a"),  # the same id, linked with the row before
        (5, " ".join(base), "b"),
        (None, near, "b"),
        (7, " ".join(other), "c"),  # the same id, another class
        (None, " ".join(words(3, 60)), "c"),
        (None, None, "c"),
        (None, None, "c"),
        (9, " ", "d"),
    )
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    found = numbers(kept)
    assert found[:4] == [2, 4, 5, 6] or found[:4] == [2, 4, 5, 7]
    assert found[-1] == 8 and len(found) == 5


def test_decontamination_decides_row_by_row(frame):
    item = " ".join(words(4, 14))
    docs = documents(frame, (1, f"before {item} after", "a"), (1, "a clean text of the same id", "a"), (None, item, "b"), (None, "clean", "b"), (2, None, "b"))
    benchmark = frame([("x", item)], "item_id string, text string")
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and numbers(kept) == [1, 3, 4]


def test_mix_leaves_columns_alone(spark, frame):
    rows = [(i % 50 if i % 7 else None, " ".join(words(i, 5 + i % 30)), "abc"[i % 3] if i % 11 else None) for i in range(300)]
    docs = documents(frame, *rows)
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    found = numbers(mixed)
    assert set(found) <= set(range(300)) and all(found.count(n) <= 2 for n in set(found)) and len(found) > 200


def test_toxicity_stage_leaves_columns_alone(spark, frame):
    rows = [(i, " ".join(words(i, 30) + ["vile"] * (i % 4 == 0)), "a") for i in range(200)]
    docs = documents(frame, *rows, (None, None, "a"), (None, " ".join(words(999, 30)), "a"))
    labels = frame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    kept = toxicity.drop_toxic(docs, toxicity.learn_toxicity(docs, labels))
    assert kept.columns == docs.columns and numbers(kept) == [n for n in range(202) if n >= 200 or n % 4]


def test_an_example_is_no_neighbour_of_itself(frame):
    """Two rows of each label cannot be split into index and calibration: they calibrate each other, not themselves."""
    docs = documents(frame, *[(i, " ".join(words(i, 20)), "a") for i in range(4)])
    model = toxicity.learn_toxicity(docs, frame([(i, i % 2) for i in range(4)], "doc_id bigint, toxic int"))
    assert all(0.05 < r.score < 0.95 for r in toxicity.score_toxicity(docs, model).collect())


def test_a_repeated_id_counts_its_least_text_in_any_order(frame):
    rows = [(i % 40, f"{'vile' if i % 40 % 2 else 'kind'} " + " ".join(words(i, 12)), "a") for i in range(80)]
    labels = frame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    found = [toxicity.learn_toxicity(documents(frame, *order).repartition(n), labels).index for order, n in ((rows, 1), (rows[::-1], 5))]
    assert found[0].ids == found[1].ids and (found[0].own_weights == found[1].own_weights).all()


def test_languages_whose_rows_share_an_id_are_learned(frame):
    spoken = {"en": "the quick brown fox jumps over the lazy dog and the cat", "de": "der schnelle braune Fuchs springt über den faulen Hund und die Katze"}
    rows = [(None, f"{text} {i}", lang) for i in range(400) for lang, text in spoken.items()]
    docs = frame(rows, "doc_id bigint, text string, lang string")
    model = language.learn_languages(docs)
    got = language.identify_language(docs, model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred for r in got} == set(spoken)


def test_rows_without_id_are_not_held_out(spark, frame, tmp_path):
    from zealmark.llm.queries import op2_toxicity, op3_language

    rows = [(None if i % 5 == 0 else i, " ".join(words(i % 9, 12)), "en" if i % 2 else "de") for i in range(60)]
    frame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    frame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (op2_toxicity, op3_language):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 60 and all(r.held_out is False for r in got if r.doc_id is None) and any(r.held_out for r in got)


def test_every_record_has_its_date(spark, frame):
    folder = scratch_path(spark, "warc")
    pages = frame([(1, "u", "<p>a"), (2, "u", "<p>a")], "page_id bigint, url string, html string")
    import gzip

    paths = warc.write_warc(pages, folder, date="2024-05-06T07:08:09Z")
    raw = b"".join(gzip.open(path.removeprefix("file:")).read() for path in paths)
    assert raw.count(b"WARC-Date: 2024-05-06T07:08:09Z\r\n") == raw.count(b"WARC/1.1\r\n") == 2
    assert raw.count(b"Content-Type: text/html; charset=utf-8\r\n") == 2


@pytest.mark.parametrize("name, apply", corpus_pipeline.STAGES)
def test_a_stage_of_no_rows(spark, frame, name, apply):
    docs = documents(frame).drop(*NAMES)
    root = scratch_path(spark, "empty")
    frame([], "doc_id bigint, toxic int").write.parquet(f"{root}/labels.parquet")
    frame([], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    assert stage(apply(spark, docs, root), "none").count() == 0


def test_the_pipeline_clears_what_it_staged(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.agg(F.sum("n_tokens")).first()[0] > 0


def test_a_pair_is_left_to_the_least_key_it_shares():
    rng = random.Random(3)
    full = jaccard_join.NO_KEY
    lists = []
    for _ in range(400):
        keys = sorted(rng.sample(range(30), rng.randint(1, 24)))[: jaccard_join.LEAST_KEYS]
        lists.append(keys + [full] * (jaccard_join.LEAST_KEYS - len(keys)))
    u, v = np.array(lists[:200]), np.array(lists[200:])
    for key in range(30):
        elsewhere = jaccard_join._met_elsewhere(key, u, v)
        for a, b, other in zip(u.tolist(), v.tolist(), elsewhere.tolist()):
            shared = (set(a) & set(b)) - {full}
            assert other == (bool(shared) and min(shared) != key)
