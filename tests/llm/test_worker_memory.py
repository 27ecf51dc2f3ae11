"""What a worker still holds when a stage of the pipeline has ended."""

from __future__ import annotations

import pyarrow as pa

from zealmark.llm import common, decontaminate, jaccard_join, token_files, toxicity


class _Docs:
    """Takes the function that the stage would run in the workers."""

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, "doc_id bigint, text string"

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_the_index_is_given_up_when_a_task_has_filtered_its_texts(spark, frame):
    rows = [(n, ("vile filthy rotten scum " if n % 2 else "kind gentle sunny garden ") + f"word{n % 7}") for n in range(60)]
    docs = frame(rows, "doc_id bigint, text string")
    model = toxicity.learn_toxicity(docs, frame([(n, n % 2) for n in range(60)], "doc_id bigint, toxic int"))
    keep = toxicity.drop_toxic(_Docs(spark), model)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["vile filthy rotten scum", "kind gentle sunny garden", None]})
    for _ in range(2):  # a second task of the worker loads it again
        kept = [row for part in keep(iter([batch])) for row in part.to_pylist()]
        assert {row["doc_id"] for row in kept} >= {2} and 1 not in {row["doc_id"] for row in kept}
        assert toxicity._loaded.cache_info().currsize == 0


def _examples():
    """Bags of six terms of which the first is in every example, and the numbers of the terms."""
    bags = [(n, n % 2, {0: 1, 1 + n % 5: 1 + n % 3}) for n in range(70)]
    return bags, {b"=t%d" % t: t for t in range(6)}


def test_postings_take_six_bytes_each():
    index = toxicity.build_index(*_examples())
    assert len(index.rare_examples) == len(index.rare_weights)
    assert index.rare_examples.itemsize + index.rare_weights.itemsize <= 6
    # the narrowest type that holds every place, also beyond its border
    many = toxicity.build_index([(n, n % 2, {n: 1}) for n in range(40_000)], {b"=t%d" % t: t for t in range(40_000)})
    assert sorted(many.rare_examples.tolist()) == list(range(40_000))


def test_a_worker_never_holds_two_indexes(tmp_path, monkeypatch):
    rows = pa.RecordBatch.from_pydict({"id": [1, 2], "label": [0, 1], "text": ["kind gentle", "vile filthy"]})
    paths = [next(toxicity._builder(str(tmp_path / name))(iter([rows]))).column("path")[0].as_py() for name in ("a", "b")]
    held, load = [], toxicity.pickle.load
    monkeypatch.setattr(toxicity.pickle, "load", lambda file: held.append(toxicity._loaded.cache_info().currsize) or load(file))
    toxicity.release()
    assert [toxicity._loaded(path).ids for path in paths] == [[1, 2], [1, 2]]
    assert held == [0, 0] and toxicity._loaded.cache_info().currsize == 1
    toxicity.release()


def test_few_texts_at_once_beside_the_index(spark, frame):
    docs = frame([(n, f"word{n % 7}") for n in range(20)], "doc_id bigint, text string")
    model = toxicity.learn_toxicity(docs, frame([(n, n % 2) for n in range(20)], "doc_id bigint, toxic int"))
    for run in (toxicity.drop_toxic, toxicity.score_toxicity):
        run(docs, model)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024


def test_the_encoder_is_given_up_when_the_files_are_written(monkeypatch):
    monkeypatch.setattr(token_files, "_ENCODERS", {("path", 2): object()})
    assert not list(token_files._reader(iter([])))
    assert not token_files._ENCODERS


def test_a_task_gives_back_memory_when_it_has_dropped_its_texts(spark, frame, monkeypatch):
    given, items = [], frame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "_finder", lambda *_: lambda: lambda texts: ([0] * len(texts), [([(0, 1)] if b"ten" in t else [], set()) for t in texts]))
    monkeypatch.setattr(common, "give_back_memory", lambda: given.append(True))

    class Docs(_Docs):
        def select(self, *columns):
            return self

    keep = decontaminate.drop_contaminated(Docs(spark), items)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a ten", "kind", None]})
    assert [row["doc_id"] for part in keep(iter([batch, batch])) for row in part.to_pylist()] == [2, 3, 2, 3]
    assert given == [True]  # once a task
    assert not list(keep(iter([]))) and len(given) == 2


def test_the_steps_of_the_join_give_back_memory(spark, frame, monkeypatch):
    steps = []
    monkeypatch.setattr(jaccard_join, "giving_back", lambda run: steps.append(run) or common.giving_back(run), raising=False)
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = frame([(1, text), (2, text + " more"), (3, "kind gentle"), (4, None)], "doc_id bigint, text string")
    assert [row.doc_id for row in jaccard_join.keep_one_of_each(docs).orderBy("doc_id").collect()] == [1, 3, 4]
    assert {jaccard_join._profile, jaccard_join._keys, jaccard_join._verify} <= set(steps)
