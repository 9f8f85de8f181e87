"""The pipeline: each stage on what its predecessor kept, against brute force."""

import corpus_pipeline
import public_tokenizers
import tiktoken
from conftest_llm import rows_by_id
from test_dedup import brute_components, brute_lines
from test_rules_search import brute_contaminated

from tools.check import duck
from voxelframe.llm import bpe
from voxelframe.llm.queries import QUALITY_SQL

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs.cache()
        docs = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before[name].columns, name
    pairs = {n: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()] for n, df in before.items()}
    assert pairs["quality_rules"] == rows_by_id(spark, FOLDER)
    con = duck(FOLDER)
    good = {d for (d,) in con.execute(f"select doc_id from ({QUALITY_SQL}) where kept").fetchall()}
    assert pairs["line_dedup"] == [(d, t) for d, t in pairs["quality_rules"] if d in good]
    done = brute_lines(pairs["line_dedup"])
    want = [(d, done[d, t][0].decode()) for d, t in pairs["line_dedup"] if not 0 < done[d, t][1] == done[d, t][2]]
    assert pairs["near_duplicates"] == want
    lows = {int(d) for d, _, c in brute_components(want, 80, 5) if d == c}
    assert pairs["decontamination"] == [(d, t) for d, t in want if d in lows]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = brute_contaminated(pairs["decontamination"], items)
    assert bad and pairs["token_ids"] == [(d, t) for d, t in pairs["decontamination"] if d not in bad]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    assert sorted((r.doc_id, list(r.ids)) for r in docs.collect()) == [(d, library.encode_ordinary(t)) for d, t in pairs["token_ids"]]


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(rows) > 100 and len({r.doc_id for r in rows}) == len(rows)


def test_awkward_rows_pass_all_stages(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(1, "some item of the benchmark with a few words in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward, nothing):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.count() <= n, name
            n = docs.count()
