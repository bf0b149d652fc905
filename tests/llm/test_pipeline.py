import corpus_pipeline
from locweave.llm import quality

from .test_decontamination import brute as brute_hits
from .test_jaccard_join import brute as brute_groups

FOLDER = "/root/testdata/sf0.001"


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_duplicates", "decontamination", "packing"]

    kept = stages["quality"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in quality.scored(docs, model).collect() if r.score >= quality.THRESHOLD}
    assert set(texts(kept)) == want

    before = texts(docs)
    groups = {}
    for i, t in before.items():
        groups.setdefault("".join(t.split(" ")).translate({c: None for c in range(9, 14)}), []).append((-len(t), i))
    assert set(texts(stages["exact_dedup"](spark, docs, FOLDER))) == {min(g)[1] for g in groups.values()}

    found = brute_groups(list(before.items()))
    assert set(texts(stages["near_duplicates"](spark, docs, FOLDER))) == {i for i, (_, c) in found.items() if c == i}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = brute_hits(list(before.items()), items)
    assert set(texts(stages["decontamination"](spark, docs, FOLDER))) == {h[0] for h in hits if not h[4]}


def test_ids_shared_or_missing_go_together(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    gone = spark.createDataFrame([(1,), (None,)], "doc_id long")
    assert [r.text for r in corpus_pipeline.without(docs, gone).collect()] == ["d"]


def test_many_ids_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    test_ids_shared_or_missing_go_together(spark)


def test_rows_of_one_id_or_none_are_dropped_each_alone(spark):
    stages = dict(corpus_pipeline.STAGES)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda name, rows: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in stages[name](spark, frame(rows), FOLDER).collect())
    assert left("exact_dedup", [(1, "a b c"), (1, "other"), (None, "abc"), (None, "alone"), (5, "same"), (5, "same"), (None, "no id"), (None, "no id")]) == [(-1, "alone"), (-1, "no id"), (1, "a b c"), (1, "other"), (5, "same")]
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(7, words), (3, words + " more"), (None, words + " end"), (None, "something else that stands alone here"), (3, "yet another text of its own there")]
    lone = [(None, " ".join(f"v{k}" for k in range(60)) + tail) for tail in ("", " x")]
    got = left("near_duplicates", rows + lone)
    assert [g for g in got if g[0] != -1] == sorted([rows[1], rows[4]])
    assert len(got) == 4 and sum(t.startswith("v0") for _, t in got) == 1
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    assert left("decontamination", [(None, item), (None, "clean text"), (2, item), (2, "clean too")]) == [(-1, "clean text"), (2, "clean too")]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == 0, name


def test_whole_run(spark):
    pieces = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert len(pieces) and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_clashing_columns_are_carried_along(spark):
    names = ["a.b", "score", "component_id", "kept", "words", "row", "id", "body", "hashes", "n", "set_key", "features", "gone"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d e f g", "a b c d e f g", None, "x y z u v w", "x y z u v w"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert all(tuple(r)[2:] == tuple(f"{n}{r.doc_id}" for n in names) for r in out.collect()), name
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["packing"](spark, docs, FOLDER).collect()} == set(range(5))
