"""Near copies: links that residuals decide, rows that stay, against brute force."""

import random

import helpers
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import common, components as labelling, residuals, tensor_minhash


def tight_group(n, seed, edits=(3, 7), length=150):
    """Texts with a few words changed at random from one original: many pairs lie close to 0.8."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.sample(range(length), rng.randint(*edits)):
            t[at] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def shingles(text, words):
    w = text.split()
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def components(sets):
    """id -> least id reachable, by all pairs."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture
def counts(monkeypatch):
    """Rows of the settled tables by tag."""
    seen, settle = {}, common.settle

    def counting(df, tag):
        out = settle(df, tag)
        seen[tag] = seen.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(common, "settle", counting)
    return seen


def test_tight_groups_equal_brute_force_with_few_candidates(spark, counts):
    pairs = {}
    for n in (200, 400):
        texts = tight_group(n, 1) + tight_group(n // 4, 2, (0, 16))
        counts.clear()
        got = tensor_minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=5).collect()
        assert {r.doc_id: r.component_id for r in got} == components({i: shingles(t, 5) for i, t in enumerate(texts)})
        pairs[n] = counts.get("near-stars", 0) + counts.get("near-starred", 0) + counts.get("near-joined", 0)
    assert pairs[400] < 3 * pairs[200] and pairs[400] < 0.25 * 500 * 499 / 2


@pytest.mark.parametrize("edits", [(0, 12), (4, 4), (6, 9)])
def test_residual_links_join_what_brute_force_links(spark, edits):
    texts = tight_group(90, 5, edits, 80) + tight_group(30, 6, edits, 60)
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    number = {}
    items = {i: [number.setdefault(x, len(number)) for x in s] for i, s in sets.items()}
    met = common.settle(spark.createDataFrame([(i, 0, i, len(s)) for i, s in items.items()], "id long, g long, component long, n long"), "t")
    held = common.settle(spark.createDataFrame(list(items.items()), "id long, items array<long>"), "t")
    links = {(r.a, r.b) for r in residuals.component_links(met, held, 80).collect()}
    linked = {(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    assert links <= linked
    assert groups(sets, links) == groups(sets, linked)


def groups(ids, pairs):
    part = {i: {i} for i in ids}
    for a, b in pairs:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[b]:
                part[x] = part[a]
    return sorted({id(p): p for p in part.values()}.values(), key=min)


def test_drop_near_copies_keeps_unrelated_rows(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(5, "alpha beta gamma delta epsilon zeta"), (3, same), (5, same), (None, same), (None, same + " x"), (None, None), (8, ""), (8, "")]
    docs = helpers.documents(spark, rows)
    kept = tensor_minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(5, rows[0][1]), (3, same), (-1, ""), (8, ""), (8, "")])


def test_drop_near_copies_of_rows_equal_in_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, text + " y", "c"), (1, "other words that stand alone here", "d")], "doc_id long, text string, mark string")
    kept = tensor_minhash.drop_near_copies(docs).collect()
    assert sorted(r.text for r in kept) == sorted([text, "other words that stand alone here"])
    assert tensor_minhash.drop_near_copies(docs.limit(0)).count() == 0


def test_columns_named_as_inside(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 7, "x"), (2, text, 8, "y")], "doc_id long, text string, held int, `a.b` string")
    assert [tuple(r) for r in tensor_minhash.drop_near_copies(docs).collect()] == [(1, text, 7, "x")]


def test_long_references_are_not_broadcast(spark, monkeypatch):
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    rows = spark.range(200).select("id", (F.col("id") % 40).alias("g"), F.col("id").alias("component"), F.lit(30_001).cast("long").alias("n"))
    held = spark.range(200).select("id", F.concat(F.sequence((F.col("id") % 40) * 10**6, (F.col("id") % 40) * 10**6 + 29_999), F.array(-F.col("id") - 1)).alias("items"))
    got = residuals.differences(common.settle(rows, "t"), common.settle(held, "t"), 80).collect()
    assert sorted((r.id, r.g, r.component, r.excess, r.d) for r in got) == [(i, i % 40, i, 180 - 20 * 30_001, [-i - 1]) for i in range(200)]
    for df in sent:
        lists = [c for c, kind in df.dtypes if kind.startswith("array")]
        assert sum(8 * len(r[c]) for r in df.select(*lists).collect() for c in lists) <= 8 << 20


@pytest.mark.parametrize("copy_rows", [1, 3, 1000])
def test_long_lookup_equals_plain_lookup(spark, monkeypatch, copy_rows):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "COPY_ROWS", copy_rows)
    rows = common.settle(spark.range(300).select("id", F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 30).alias("g")), "t")
    groups = common.settle(rows.filter("g <> 3").groupBy("g").agg(F.count("*").alias("size"), F.array(F.min("id"), F.max("id")).alias("long")), "t")
    got = common.lookup_long_by_group(rows, groups, ["g"], "size", F.lit(16), F.xxhash64("id")).select("id", "g", "size", "long").collect()
    want = rows.join(groups, "g", "left").select("id", "g", "size", "long").collect()
    assert len(got) == 300 and sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("at_once", [0, labelling.AT_ONCE])
def test_components_of_a_chain_by_either_way(spark, counts, monkeypatch, at_once):
    monkeypatch.setattr(labelling, "AT_ONCE", at_once)
    rng = random.Random(3)
    names = rng.sample(range(-(10**12), 10**12), 300)
    links = [(names[k], names[k + 1]) for k in range(299) if k % 100 != 99] + [(names[5], names[5]), (names[7], names[3])]
    got = {r.id: r.component for r in labelling.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(names[k // 100 * 100 : k // 100 * 100 + 100]) for k, x in enumerate(names)}
    assert labelling.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    if at_once:
        assert set(counts) == {"links"}


def test_few_pairs_need_no_rounds(spark, counts, monkeypatch):
    texts = tight_group(60, 9, (3, 9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components({i: shingles(t, 5) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in tensor_minhash.near_groups(docs, words=5).collect()} == want
    assert "near-joined" in counts and "near-starred" not in counts
    monkeypatch.setattr(residuals, "FEW_PAIRS", 0)
    monkeypatch.setattr(labelling, "AT_ONCE", 0)
    assert {r.doc_id: r.component_id for r in tensor_minhash.near_groups(docs, words=5).collect()} == want
    assert "near-starred" in counts


def test_exploded_files_are_not_broadcast(spark, tmp_path):
    """A join with a few columns of a file, exploded: Spark takes it for as small as they are."""
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        common.ship(spark)
        spark.range(4000).select("id", F.array(*(F.xxhash64("id", F.lit(i)) for i in range(32))).alias("keys")).write.parquet(f"{tmp_path}/a")
        rows = spark.read.parquet(f"{tmp_path}/a").select("id", F.explode("keys").alias("key"))
        joined = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
        assert joined.count() == 4000 * 32
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        joined.write.format("noop").mode("overwrite").save()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        common.ship(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_many_ids_and_hashes_are_not_broadcast(spark, monkeypatch):
    """Rows of an id and a hash take about 150 bytes each in the hash table that the driver builds."""
    sent, broadcast, n = [], F.broadcast, 60_000
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    docs = common.settle(tensor_minhash._marked(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e w"), "id").alias("text")), "doc_id", "text"), "t")
    classes = common.settle(docs.select((F.col("doc_id") + n).alias("id"), "doc_id", "mark"), "t")
    sets = tensor_minhash._sets_of(classes.select("id"), classes, docs, 5)
    assert sets.count() == sets.select("id").distinct().count() == sets.filter("size(items) = 2").count() == n

    own = F.struct("doc_id", "mark")
    told = docs.filter(f"doc_id < {n - 10}").select("doc_id", "mark", F.lit(2).alias("n_shingles"), F.struct((F.col("doc_id") - 1).alias("doc_id"), "mark").alias("stays"))
    kept = docs.filter(f"doc_id >= {n - 10}").select("doc_id", "mark", F.lit(2).alias("n_shingles"), own.alias("stays"))
    monkeypatch.setattr(tensor_minhash, "_decided", lambda *_: told.unionByName(kept))
    left = tensor_minhash.drop_near_copies(docs.select("doc_id", "text"))
    assert sorted(r.doc_id for r in left.collect()) == list(range(n - 10, n))
    assert all(150 * df.count() <= common.BROADCAST_BYTES for df in sent)
