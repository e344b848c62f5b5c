"""The queries of the ten operators over whole tables, against plain versions."""

import hashlib

import brute
import duckdb
import numpy as np
import pytest
from helpers import rows, same

from panelforge.llm import queries


def collect(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_mixing"])
def test_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cursor = duck.execute(queries.ORACLES[name])
    assert same(rows(df.columns, [tuple(r) for r in df.collect()]), rows([d[0] for d in cursor.description], cursor.fetchall()))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_nearest(spark, size):
    sf = f"/root/testdata/{size}"
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    got = {}
    for r in sorted(collect(spark, sf, "op2_collision_search"), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [len(found), [r[0] for r in found]] == [min(20, len(ids) - 1), [i for i, _ in sorted(found, key=lambda r: (-r[1], r[0]))]]
        hit, total = hit + len({ids[i] for i in order} & {i for i, _ in found}), total + len(order)
        assert all(abs(s - score[ids == i][0]) < 1e-12 for i, s in found)
    assert hit / total >= 0.9


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op4_crf_secrets", brute.secrets, ("assign", "access", "hex")), ("op6_contextual_pii", brute.personal, ("email", "ip", "card", "phone"))])
def test_spans(spark, sf, docs, name, plain, kinds):
    texts = dict(docs)
    got = collect(spark, sf, name)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.digest(base)
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[2] == k for b in base) for k in kinds]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {(k, s, e) for s, _, k, e in base} <= {(k, int(s), int(e)) for k, s, e in spans}
        assert [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans)


def test_field_on_held_out_documents():
    """Tags of documents that the field wasn't fitted on, against the fixed patterns' values."""
    from panelforge.llm import secret_scan as scan

    texts = [t for _, t in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) > 0 ORDER BY doc_id").fetchall()]
    with_secret, without = ([t for t in texts[1::2] if bool(scan.base_spans(t)) == want and len(t) < 20_000] for want in (True, False))
    field = scan.fit(with_secret[:200] + without[:150], scan.CrfSpec())
    right = wrong = missed = 0
    for text in texts[::2]:
        words, want = scan._tags(text)
        if words:
            size = np.array([len(words)])
            tags = scan.decode(field, scan.emissions(field, field.codes(words), size, np.array([scan.file_bucket(text)])), size)
            right, wrong, missed = right + ((tags > 0) & (want > 0)).sum(), wrong + ((tags > 0) & (want == 0)).sum(), missed + ((tags == 0) & (want > 0)).sum()
    assert right / (right + missed) > 0.8 and right / (right + wrong) > 0.8


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_language_model(spark, size):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{size}/documents.parquet'").fetchall()
    want = brute.unigram_scores(docs)
    got = collect(spark, f"/root/testdata/{size}", "op5_maxent_lm")
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_packing(spark, sf, docs):
    import public_tokenizers

    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in collect(spark, sf, "op7_packing"))
    assert got == brute.packed(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


def test_quality(spark, sf, docs):
    got = {r["doc_id"]: r for r in collect(spark, sf, "op8_cotraining")}
    assert sorted(got) == sorted(i for i, _ in docs)
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet' WHERE quality IS NOT NULL").fetchall()
    assert np.mean([got[i]["keep"] == bool(q) for i, q in labels]) > 0.85


def test_quality_held_out(spark):
    from panelforge.llm import quality

    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels.where("doc_id % 3 != 0"))).join(labels.where("doc_id % 3 = 0 and quality is not null"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in scored]) > 0.9


def test_decontamination(spark, sf, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in collect(spark, sf, "op9_decontamination"))
    sha = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert got == sorted((i, n, h, len(f), sha(f), h > 0) for i, n, h, f in brute.leaks(docs, items))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_duplicates(spark, size):
    at = f"/root/testdata/{size}"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{at}/documents.parquet'").fetchall()
    want = brute.components(docs, 3, 85)
    got = {r["doc_id"]: r for r in collect(spark, at, "op10_lsh_forest")}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
