"""Cases that the operators once missed: near copies beyond a few bits, shifted leaks, whole walks."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import line_dedup, simhash


def brute_similar(texts, similarity=0.8, width=5):
    """Index pairs of at least this Jaccard similarity of words' shingles, from an index of whole sets."""
    sets, index, pairs = [], {}, set()
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
        common = {}
        for x in s:
            for j in index.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            index[x].append(i)
        pairs |= {(j, i) for j, n in common.items() if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9}
        sets.append(s)
    return pairs


def changed(rng, words, n):
    out = list(words)
    for p in rng.choice(len(out), n, replace=False):
        out[p] = f"new{rng.integers(1 << 30)}"
    return out


def test_near_dedup_links_similar_texts(spark, make_docs):
    rng = np.random.default_rng(5)
    texts = []
    for n in (40, 120, 400) * 20:
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts += [" ".join(base), *(" ".join(changed(rng, base, max(1, n // 55))) for _ in range(3))]
    rows = list(enumerate(texts))
    pairs = brute_similar(texts)
    fp = [simhash.fingerprint(t) for t in texts]
    assert sum((fp[a] ^ fp[b]).bit_count() > simhash.RADIUS for a, b in pairs) > 0.5 * len(pairs) > 20
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make_docs(rows), similarity=0.8).collect()}
    assert len(got) == len(rows) and all(got[a] == got[b] for a, b in pairs)
    joined = {(a, b) for a in got for b in got if a < b and got[a] == got[b]}
    root = list(range(len(texts)))
    for a, b in sorted(pairs | {(a, b) for a in got for b in range(a + 1, len(texts)) if (fp[a] ^ fp[b]).bit_count() <= simhash.RADIUS}):
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    assert joined == {(a, b) for a in got for b in got if a < b and root[a] == root[b]}


def test_similar_forest_connects_what_similarity_connects():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 100)
    sets = []
    for _ in range(120):
        own = base.copy()
        own[rng.choice(100, int(rng.integers(0, 30)), replace=False)] = rng.integers(0, 1 << 62, 1)
        sets.append(np.unique(own).astype(np.uint64))
    root, want = list(range(120)), list(range(120))
    for a, b in simhash.similar_forest(sets, 0.8):
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    for a in range(120):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    assert root == want and len(set(want)) > 1


def test_near_dedup_edge_cases(spark, make_docs, odd_rows):
    got = simhash.keep_one(make_docs(odd_rows), similarity=0.8).collect()
    kept = simhash.keep_one(make_docs(odd_rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, kept))
    assert simhash.keep_one(make_docs([]), similarity=0.8).count() == 0


def test_pipeline_stage_links_similar_documents(spark, sf_dir):
    import corpus_pipeline

    sf = sf_dir.replace("sf0.001", "sf0.01")
    kept = {r.doc_id for r in corpus_pipeline.dedupe(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    pairs = [(a, b) for a, b in brute_similar([r["text"] for r in rows]) if rows[a]["text"] != rows[b]["text"]]
    assert pairs and not any(rows[a]["doc_id"] in kept and rows[b]["doc_id"] in kept for a, b in pairs)


def test_leaks_without_their_first_or_last_words_at_the_ends_of_texts():
    import random

    from quillgraph.llm import decontaminate

    rng, items, texts = random.Random(4), [], []
    for i in range(100):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(20, 59))]
        items.append((i, " ".join(words)))
        lost = rng.randint(1, int(0.2 * len(words) + 1e-9))
        texts.append(" ".join(words[lost:] + ["y"] * 30) if i % 3 else " ".join(["x"] * 30 + words[:-lost]))
    matcher = decontaminate.Matcher(items)
    together = {r for r, i, *_ in matcher.search(texts) if r == i}
    alone = {r for r in range(100) if any(i == r for _, i, *_ in matcher.search([texts[r]]))}
    assert together == alone and len(together) >= decontaminate.RECALL * 100


@pytest.mark.parametrize("size", [101, 250, 600, 1000])
def test_long_items_are_found_wherever_their_edits_lie(size):
    import random

    from quillgraph.llm import decontaminate

    rng, items, texts = random.Random(size), [], []
    for i in range(30):
        words = [f"v{rng.randrange(4000)}" for _ in range(size)]
        items.append((i, " ".join(words)))
        k, new = int(0.2 * size + 1e-9), lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
        front = (new(k) + words[k:], new(k) + words, words[k:])[i % 3]  # all edits at the front: replaced, inserted, deleted
        texts.append(" ".join(["x"] * 30 + (front if i % 2 else list(reversed(front))) + ["y"] * 30))
        if not i % 2:
            items[-1] = (i, " ".join(reversed(words)))
    matcher = decontaminate.Matcher(items)
    found = {r: e for r, i, e, *_ in matcher.search(texts) if r == i}
    assert len(found) >= decontaminate.RECALL * 30 and max(found.values()) <= 0.2 * size


def test_pipeline_stages_use_the_ends_of_long_texts(spark, make_docs, tmp_path):
    import corpus_pipeline
    from quillgraph.llm import decontaminate, mixing, quality, sharding

    rng = np.random.default_rng(12)
    body = [f"w{x}" for x in rng.integers(0, 50000, 300_000)]
    item = " ".join(f"leak{x}" for x in range(40))
    other = [f"u{x}" for x in rng.integers(0, 50000, 150_000)]
    # 0 as it is, 1 ends in a passage, 2 has another second half, 3 has another first half and the same second one as 4
    texts = [" ".join(body), " ".join([*body, item]), " ".join(body[:150_000] + other), " ".join(other + body[150_000:]), " ".join(other[::-1] + body[150_000:])]
    fps = [simhash.fingerprint(t) for t in texts]
    assert len(set(fps[1:])) == 4 and quality.statistics(texts[0]) != quality.statistics(texts[0] + " !!! $$$")
    assert set(simhash.band_keys(simhash.shingle_set(texts[0]))) - set(simhash.band_keys(simhash.shingle_set(texts[2])))
    assert {r.doc_id for r in simhash.keep_one(make_docs(list(enumerate(texts))), similarity=0.8).collect()} == {0, 2, 3, 4}
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs(list(enumerate(texts)))
    assert {r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()} == {0, 2, 3, 4}
    assert len(decontaminate.words_of(texts[1])) == 300_040
    sizes = {r.doc_id: (r.n, r.size) for r in docs.select("doc_id", mixing.word_count(F.col("text")).alias("n"), sharding.measures()["size"].alias("size")).collect()}
    assert sizes == {i: (len(t.split()), len(t) + 1) for i, t in enumerate(texts)}


def test_line_pairs_make_shingles_once(spark):
    lines = [(1, "a line of some shingles", 16), (2, "a line of some shinglez", 16), (3, "another that is as long", 16)]
    texts = spark.createDataFrame(lines, "h long, line string, shingles int")
    found = line_dedup.verified(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), texts)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2


def test_line_signatures_are_small_and_meet(spark):
    rng, letters, pairs = random.Random(5), "abcdefghijklmnopqrstuvwxyz", []
    for _ in range(500):
        # one letter of 79 is another: 64 shingles are common, 80 in all
        a = "".join(rng.choices(letters, k=79))
        pairs.append((a, a[:40] + "#" + a[41:]))
    pairs = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"), "a", "b").cache()
    lines = pairs.select(F.col("ha").alias("h"), F.col("a").alias("line")).union(pairs.select("hb", "b"))
    signed = line_dedup.signatures(lines)
    assert [t for c, t in signed.dtypes if c != "h"] == ["int"] * 16
    keys = line_dedup.bucket_keys(signed)
    assert keys.count() == 20 * 1000
    left, right = keys.toDF("ha", "key"), keys.toDF("hb", "key_b")
    met = pairs.join(left, "ha").join(right, "hb").filter("key = key_b").select("ha").distinct().count()
    assert met >= 0.985 * 500
