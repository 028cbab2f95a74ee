"""Each query of this subpackage that has SQL, on the smallest tables; the pipeline against its parts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inventa.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, same, name):
    same(registry.queries()[name](spark, small), duck.sql(registry.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pipeline"}))
def test_query_without_sql_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_pipeline(spark, small):
    """Stage by stage: what a stage drops or changes is what its operator says, and all else stays as it was."""
    from inventa.llm import op2_substrings, op6_toxicity, op7_tiling, op9_simhash

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = {r.doc_id: r for r in docs.collect()}, stage(spark, docs, small)
        after = {r.doc_id: r for r in out.collect()}
        assert out.columns == columns and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "near copies":
            classes = {r.id: r.class_id for r in op9_simhash.near_duplicates(docs).collect()}
            assert gone == {i for i, c in classes.items() if i != c}
        elif name == "benchmark leaks":
            bench = spark.read.parquet(f"{small}/benchmark.parquet")
            assert gone == {r.doc_id for r in op7_tiling.tilings(docs, bench).collect()}
        elif name == "repeats":
            cut = {r.doc_id: r for r in op2_substrings.remove_repeats(docs).collect()}
            assert gone == {i for i, r in cut.items() if r.n_words and r.n_removed == r.n_words}
            assert all(after[i].text == (cut[i].kept if cut[i].n_removed else before[i].text) and after[i].n_chars == len(after[i].text or "") for i in after)
        if name != "repeats":
            assert all(after[i] == before[i] for i in after)
        seen.append(len(gone))
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    assert sum(seen) > 0
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert len(ids) == docs.count() and all(len(r.ids) == 4 * r.n_tokens for r in ids)
    assert len(corpus_pipeline.STAGES) == 5 and op6_toxicity.BITS
    run = corpus_pipeline.run(spark, small)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in run.select("doc_id", "n_tokens", "decoded_sha256").collect()) == sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in ids)


def test_pipeline_on_odd_rows(spark, small, tmp_path):
    names = ["score", "n_words", "n_removed", "kept", "ids", "offsets", "decoded", "class_id", "id", "t", "item_id", "tiles", "times", "features", "label", "s0", "key", "root", "__bucket", "__part", "__kept", "__toxicity"]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5), (3, "x y z", None, "s", None), (3, "x y z", None, "s", None), (4, "w " * 20_000, "en", "s", 40_000)]
    rows += [(7, " ".join(f"p{k}" for k in range(40)) + " a b", "en", "s", 1), (8, "c d " + " ".join(f"p{k}" for k in range(40)) + " e f" * 20, "en", "s", 2)]  # the second loses words
    df = spark.createDataFrame([(*r, *(-(100 * i + k) for k in range(len(names)))) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    extra = lambda d: sorted(tuple(r[n] for n in names) for r in d.collect())
    for n in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{n}.parquet").write.parquet(str(tmp_path / f"{n}.parquet"))
    for d, count in ((df, 8), (df.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path)).cache()
            assert d.columns == df.columns
        assert extra(d) == (extra(df) if count else [])
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).where(F.col("ids").isNotNull()).count() == count


def test_pipeline_drops_short_near_copies(spark, small):
    """Copies with two shingles more than the eight of their texts; the search by fingerprints alone loses one in twelve."""
    text = lambda i, k: " ".join(f"s{i}x{j}" for j in range(k))
    rows = [(2 * i, text(i, 12)) for i in range(300)] + [(2 * i + 1, text(i, 14)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2 * i for i in range(300)]
