import hashlib
import random
import time

import helpers

from lumenflow.llm import extendible_dedup, tensor_minhash
from lumenflow.llm.components import connected_components


def test_exact_groups(spark):
    got = extendible_dedup.exact_groups(helpers.documents(spark)).collect()
    assert len(got) == len(helpers.TEXTS)
    same = hashlib.sha256(b"one two three four five six seven").hexdigest()
    group = [r for r in got if r.text_sha256 == same]
    assert sorted((r.doc_id or -1, r.kept) for r in group) == [(-1, False), (3, False), (5, False), (5, True)]
    assert {(r.keep_id, r.group_size) for r in group} == {(5, 4)}
    empty = {r.doc_id: r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()}
    assert set(empty) == {7, 1} and empty[7].kept and not empty[1].kept
    assert extendible_dedup.exact_groups(helpers.documents(spark, [])).count() == 0


def test_exact_groups_with_many_buckets(spark):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randint(0, 300)}" * 20) for i in range(3000)]
    got = extendible_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bucket_bytes=2000).collect()
    best, size = {}, {}
    for i, t in rows:
        best[t], size[t] = max(i, best.get(t, -1)), size.get(t, 0) + 1
    texts = dict(rows)
    assert all((r.keep_id, r.group_size, r.kept) == (best[texts[r.doc_id]], size[texts[r.doc_id]], r.doc_id == best[texts[r.doc_id]]) for r in got) and len(got) == 3000


def test_directory_doubles():
    d = extendible_dedup.Directory({i << 8: 10 for i in range(1024)}, 100)
    assert len(d.slots) == 1 << d.depth and set(d.slots) == set(range(d.buckets))
    hot = extendible_dedup.Directory({7: 1000}, 10)  # one key can't split
    assert hot.depth == extendible_dedup.MAX_DEPTH


def test_drop_copies(spark):
    docs = helpers.documents(spark)
    kept = extendible_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert len({r.text or "" for r in kept.collect()}) == kept.count() == len({t or "" for _, t in helpers.TEXTS})


def test_drop_copies_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "t", "mine", "a", 4), (2, "t", "yours", "b", 5), (None, "t", None, None, 6), (None, None, "x", "y", 7)], "doc_id long, text string, _id string, sha string, `a.b` int")
    kept = extendible_dedup.drop_copies(docs)
    assert kept.schema == docs.schema and sorted((r.doc_id or -1, r.text, r._id, r.sha, r["a.b"]) for r in kept.collect()) == [(-1, None, "x", "y", 7), (2, "t", "yours", "b", 5)]


def test_large_directories_are_quick():
    began = time.process_time()
    d = extendible_dedup.Directory({i << 2: 10 for i in range(1 << 16)}, 10)
    assert d.buckets == 1 << 16 and time.process_time() - began < 10
    sizes = {}
    for slot in d.slots:
        sizes[slot] = sizes.get(slot, 0) + 1
    assert len(sizes) == d.buckets and d.slots[0] == 0


def test_near_groups_cases(spark):
    got = tensor_minhash.near_groups(helpers.documents(spark), words=4).collect()
    assert len(got) == len(helpers.TEXTS)
    by = {r.doc_id: r for r in got}
    assert by[3].component_id == by[5].component_id == by[9].component_id == by[None].component_id == 3
    assert [by[i].n_shingles for i in (7, 1, 2, 4, 3)] == [0, 0, 0, 1, 4]
    assert all(by[i].component_id == i and by[i].kept for i in (7, 1, 2, 4))
    assert by[8].component_id == by[6].component_id == 6 and not by[8].kept
    assert tensor_minhash.near_groups(helpers.documents(spark, [])).count() == 0


def test_near_groups_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = tensor_minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
