"""The pipeline against plain Python over one small table with awkward rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near import components, shingles

import corpus_pipeline
from lumenflow.llm import pii_boost, subword_classifier

SF = "/root/testdata/sf0.001"


def plain(docs, labels, spark):
    """What each of the first four stages leaves, as {row number: (doc_id, text)}, and the pieces."""
    weights, bias = subword_classifier.fit(spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string"), labels)
    rows = {}
    for k, (i, t) in enumerate(docs):
        f = subword_classifier.features(t)
        z = bias + (float(weights[f].mean(dtype=np.float64)) if len(f) else 0.0)
        if 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= subword_classifier.THRESHOLD:
            rows[k] = (i, t)
    best = {}
    for k, (i, t) in rows.items():
        key = (float("-inf") if i is None else i, -k)
        best[t or ""] = max(best.get(t or "", (key, k)), (key, k))
    exact = {k: rows[k] for _, k in best.values()}
    of = components({k: shingles((t or "").translate({c: c + 32 for c in range(65, 91)}), 5) for k, (_, t) in exact.items()})
    near = {}
    for k, c in of.items():
        key = (exact[k][0] is None, exact[k][0])
        if c not in near or key < near[c][0]:
            near[c] = (key, k)
    model = pii_boost.model()
    clean = [(exact[k][0], pii_boost.redact(exact[k][1], *model)) for _, k in near.values()]
    from tokenizers import Tokenizer

    tok, pieces = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), []
    for i, t in clean:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        start, end = 0, len(ids) % 2048 or 2048
        n = 0
        while start < len(ids):
            pieces.append((i or -1, n, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, n = end, end + 2048, n + 1
    return {"quality": rows, "exact_copies": exact, "near_copies": near}, clean, pieces


def test_stages_and_chain_against_plain_python(spark, tmp_path):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = max((t for _, t in given), key=lambda t: (len(t) < 3000, len(t)))
    more = [(900_001, good), (900_001, good), (None, good), (900_002, good + " and a tail"), (900_003, good + " write to jane.doe@example.org or +1 (348) 555-6390"), (900_003, "one unrelated short text"), (900_004, None), (900_005, ""), (None, None)]
    docs = [*given, *more]
    spark.createDataFrame([(i, t, None, "s", None, "mine", 1, True) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, mark string, id int, kept boolean").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept, clean, pieces = plain(docs, labels, spark)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = corpus_pipeline.common.settle(stage(spark, now, str(tmp_path)), "test-stage")
        if k < 4:
            assert now.columns == columns
        if name in ("quality", "exact_copies"):
            assert sorted((r.doc_id or -1, r.text or "") for r in now.collect()) == sorted((i or -1, t or "") for i, t in kept[name].values())
        elif name == "near_copies":
            assert now.count() == len(kept[name])
        elif name == "personal_data":
            got = now.collect()
            assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in clean)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) and r["mark"] == "mine" for r in got)
    got = now.collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    assert len({r.sequence_id for r in got}) <= -(-sum(p[3] for p in pieces) // 2048) + 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_does_not_broadcast_table_keys(spark, monkeypatch):
    """Each text has a row for each of 64 tables, of which Spark sees the size of two columns of a file."""
    settle = corpus_pipeline.common.settle
    conf = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c, None) for c in conf}

    class Seen(Exception):
        pass

    def until_members(df, tag):
        if tag == "near-members":
            raise Seen(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, tag)

    monkeypatch.setattr(corpus_pipeline.common, "settle", until_members)
    word = F.concat(F.lit("w"), F.floor(F.col("id") / 2))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.array_repeat(word, 3), " "), F.repeat(F.concat(F.lit(" "), word), 30), F.when(F.col("id") % 2 == 1, " end").otherwise("")).alias("text"))
    try:
        spark.conf.set(conf[0], "10m")
        spark.conf.unset(conf[1])
        with pytest.raises(Seen) as plan:
            corpus_pipeline.near_copies(spark, docs, SF)
        assert "BroadcastHashJoin" not in str(plan.value)
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
