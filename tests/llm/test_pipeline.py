"""Each stage of the pipeline on its own input, against plain versions."""

import brute
import corpus_pipeline
import public_tokenizers
import duckdb
import pytest

from panelforge.llm import quality


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{sf}/documents.parquet"), *out]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(kept):
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns


def test_quality(spark, sf, kept):
    scored = quality.score(kept[0], quality.train(kept[0], spark.read.parquet(f"{sf}/labels.parquet")))
    good = {r.doc_id for r in scored.where(f"score >= {quality.CoTrainSpec().threshold}").collect()}
    assert {i for i, _ in pairs(kept[1])} == good
    assert 0 < len(good) < kept[0].count()


def test_near_duplicates(kept):
    found = brute.components(pairs(kept[1]), 5, 80)
    assert sorted(i for i, _ in pairs(kept[2])) == sorted(i for i, (_, c) in found.items() if i == c)


def test_decontamination(sf, kept):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    assert sorted(i for i, _ in pairs(kept[3])) == sorted(i for i, _, hit, _ in brute.leaks(pairs(kept[2]), items) if not hit)


def test_mixing(duck, kept):
    from panelforge.llm.oracles import OP3

    duck.execute("CREATE SCHEMA IF NOT EXISTS stage")
    files = kept[3].inputFiles()
    duck.execute(f"CREATE OR REPLACE TABLE stage.documents AS SELECT * FROM read_parquet({[f.removeprefix('file://') for f in files]})")
    taken = duck.execute(OP3.replace("FROM documents", "FROM stage.documents")).fetchall()
    assert sorted(i for i, _ in pairs(kept[4])) == sorted(r[0] for r in taken)


def test_packing(kept):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in kept[5].collect())
    assert got == brute.packed(pairs(kept[4]), public_tokenizers.path("word_bpe_49k.json"), 2)


def test_rows_with_a_null_or_repeated_id(spark, make_docs, tmp_path):
    """Each row comes out of the mix as often as it was taken; near-dedup leaves one of several rows with one id and text."""
    import corpus_pipeline

    rows = [(None, "a null id here"), (None, "another null id"), (5, "one two three"), (5, "one two three"), (5, "quite other words"), (6, "six of one")]
    make_docs(rows).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()]
    assert sorted(mixed, key=repr) == sorted(rows, key=repr)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    assert sorted(left, key=repr) == sorted([*rows[:3], *rows[4:]], key=repr)


#: Columns whose names the stages use inside, and one with a dot.
CLASHING = "7 AS _file, 8 AS _row, 77 AS _copy, 9 AS _n, 'm' AS _metadata, 5 AS _drop_key, 1 AS count, 'x' AS kept, 'd' AS `a.b`, 3 AS component_id, 0 AS tokens, 1 AS at"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, docs):
    """Null, empty, long, tied and repeated rows among real documents, with clashing columns; labels and items beside them."""
    long = " ".join(f"w{k}" for k in range(60_000))
    item = "zero one two three four five six seven eight nine ten"
    rows = [*docs[:60], (None, None), (None, "a null id here"), (1000, None), (1001, ""), (1002, "  "), (1003, long), (1004, long), (1005, f"says {item} here"), (1006, "one two"), (1006, "one two"), (1006, "quite other words"), (1007, "one two")]
    at = tmp_path_factory.mktemp("odd")
    frame = spark.createDataFrame([(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.selectExpr("*", *CLASHING.split(", ")).coalesce(2).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame([(i, int(k % 4 > 0)) for k, (i, _) in enumerate(docs[:40])] + [(None, 1), (5, None)], "doc_id long, quality int").write.parquet(str(at / "labels.parquet"))
    return str(at), rows


def test_stages_with_odd_rows_and_clashing_columns(spark, odd):
    at, rows = odd
    table = spark.read.parquet(f"{at}/documents.parquet")
    extra = tuple(table.first())[5:]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, at)
        assert out.columns == table.columns, name
        got = [tuple(r) for r in out.collect()]
        assert all(r[5:] == extra for r in got), name
        left = sorted(((r[0], r[1]) for r in got), key=repr)
        assert set(left) <= set(rows)
        if name == "MinHash near-dedup":
            gone = brute.components([r for r in dict.fromkeys(rows) if r[0] is not None and r[0] != 1006], 5, 80)
            assert (1004, rows[65][1]) not in left and (1007, "one two") not in left and left.count((1006, "one two")) == 1
            assert {i for i, _ in left if i is not None} - {1006} == {i for i, (_, c) in gone.items() if i == c} - {1007}
        if name == "benchmark decontamination":
            assert 1005 not in {i for i, _ in left} and {1000, 1001, 1002, 1003, 1006, None} <= {i for i, _ in left}
        if name == "mixing sources to target weights":
            assert {i for i, _ in left}.isdisjoint({1000, 1001}) and (None, "a null id here") in left
    assert corpus_pipeline.packing_stage(spark, table, at).count() == len(rows)


def test_stages_with_empty_tables(spark, odd, tmp_path):
    at, _ = odd
    spark.read.parquet(f"{at}/documents.parquet").where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns), name
