"""The pipeline against a plain version of its stages, and its contract."""

import hashlib
import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lodestrata.llm import bpe, common, ngram_join, secrets, toxicity
from lodestrata.llm.components import components
from tests.llm.test_operators import plain_components, plain_hits

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(documents, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in documents.collect() if model.score(r.text or "") < 0.7]
    part = plain_components(rows, 5, 80, 100)
    rows = [(i, t) for i, t in rows if part[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(i, t) for (i, t), (n, hit, *_) in zip(rows, plain_hits([t for _, t in rows], items), strict=True) if not (hit and 20 * hit >= n)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        clean = secrets.redacted(text or "", [(a, b, k) for k, a, b in secrets.all_spans(text or "", 0.5)])
        assert got[i].ids == library.encode_ordinary(clean)
        assert got[i].decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 50_000, None, None, 100_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, DATA)
            assert now.columns == docs.columns, name
            assert now.count() == table.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).count() == table.count()


def test_stages_with_repeated_rows_ties_and_clashing_names(spark):
    """Rows of one id, equal texts of other ids, null ids, and columns named like the stages' own."""
    plain = " ".join(f"word{k}" for k in range(40))
    rows = [(5, plain), (5, plain), (6, plain), (7, plain + " more"), (None, plain), (None, None), (8, "apart " * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, 0.5, 9, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, score double, component_id int, spans string")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns
    assert sorted([r.doc_id or 0 for r in now.collect()]) == [0, 0, 5, 5, 8]
    assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).count() == 5


def test_near_copies_shuffle_in_parts(spark, monkeypatch):
    """No write of near copies has all entries in its shuffle, and the tables of entries are gone when their use is over."""
    documents = spark.createDataFrame([(i, " ".join(f"w{i // 2 * 1000 + k}" for k in range(200 + i % 2))) for i in range(60)], "doc_id long, text string")
    seen, saved = [], common._saved

    def watched(df, path, compression):
        saved(df, path, compression)
        name = os.path.basename(path).rsplit("-", 1)[0]
        folder = path.removeprefix("file:").rsplit("/", 1)[0]
        seen.append((name, spark.read.parquet(path).count() if name == "counts" else 0, [x for x in os.listdir(folder) if x.startswith("indexed-")]))

    monkeypatch.setattr(common, "_saved", watched)
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    assert sorted(r.doc_id for r in ngram_join.keep_one(documents).collect()) == list(range(0, 60, 2))
    counts = [n for name, n, _ in seen if name == "counts"]
    assert len(counts) == ngram_join.PARTS and all(0 < n < sum(counts) / 2 for n in counts)
    assert not [x for name, _, there in seen if name == "texts" for x in set(there) - before]


def test_components_need_few_tasks_and_leave_one_table(spark):
    """Tasks take disk as well (logs of events and executors); with many shuffle partitions and few rows they took most of it."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 12)] + [(100, k) for k in range(101, 110)], "a long, b long")
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    folder = common.shared_dir(spark).removeprefix("file:")
    there, context = set(os.listdir(folder)), spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("components", "components")
        reach = components(edges)
        got = {r.node: r.component for r in reach.collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(13)} | {k: 100 for k in range(100, 110)}
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - there] == ["reach"]
    tracker = context.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup("components") for i in tracker.getJobInfo(job).stageIds}
    assert sum(x.numCompletedTasks for i in stages if (x := tracker.getStageInfo(i))) < 1500
    common.drop(reach)
