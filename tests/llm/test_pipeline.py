"""Every stage of the pipeline against brute force on its own input."""

import zlib
from array import array

import corpus_pipeline
from calibrium.llm.tokens import WordEncoder, tokenizer_path
from tests_support import line_sql, near_duplicate_rows


def test_stages_and_run(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs.collect(), after.collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        docs = after
    assert [n for n, _, _ in seen] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]

    from test_quality import brute as statistics

    _, before, after = seen[0]
    kept = {r.doc_id for r in after}
    assert kept <= {r.doc_id for r in before if not statistics(r.text)[5]} and len(kept) > 0.6 * len(before)

    _, before, after = seen[1]
    want = {d: (removed, text) for d, _, removed, text in line_sql([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == {d: t for d, (removed, t) in want.items() if not removed or t.strip()}
    assert all(r.n_chars == len(r.text) for r in after if want[r.doc_id][0])

    _, before, after = seen[2]
    assert {r.doc_id for r in after} == {d for d, _, _, keep in near_duplicate_rows([(r.doc_id, r.text) for r in before]) if keep}

    _, before, after = seen[3]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in after}
    assert left <= {r.doc_id for r in before}
    assert not [r.doc_id for r in after if any(x in r.text for x in items)]
    assert {r.doc_id for r in before} - left == {r.doc_id for r in before if any(x in r.text for x in items)}

    _, before, after = seen[4]
    words, pieces = WordEncoder(tokenizer_path()), []
    for r in before:
        ids = [*memoryview(words.library(r.text)).cast("I"), 1]
        pieces += [(r.doc_id, a // 4096, zlib.crc32(array("I", ids[a : a + 4096]).tobytes())) for a in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in after) == sorted(pieces)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted(pieces)


def test_odd_rows(spark, sf):
    text = lambda k: " ".join(f"plain{k}{i} prose{i}{k}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (None, text("c")), (2, None), (3, ""), (4, text("a")), (5, " \n "), (1, text("b")), (6, "too short")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, rule string, first string"
    docs = spark.createDataFrame([(d, t, "en", None, None, "x", None, "y") for d, t in rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, sf)
        assert docs.columns == columns, name
    left = sorted(((r.doc_id, r.text, r.kept, r.first) for r in docs.collect()), key=str)
    assert left == sorted([(1, text("a"), "x", "y"), (1, text("b"), "x", "y"), (None, text("c"), "x", "y")], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted(str(r.doc_id) for r in packed.collect()) == ["1", "1", "None"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
