"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import chat, decontaminate, line_dedup, media, mixing, quality, sharding, simhash, token_files, warc
from quillgraph.llm.components import connected_components


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="module")
def none(make_docs):
    return make_docs([(1, "x")]).limit(0)


def test_mixing(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and all(r.copies in (0, 1, 2, 3) and r.size >= 0 for r in rows)
    assert abs(sum(r.copies * r.size for r in rows) - sum(r.size for r in rows)) <= 2  # one source: its own words again, to a word or two
    assert mixing.mix(none).count() == 0
    even = mixing.mix(odd, importance=F.lit(1)).collect()
    assert all(r.copies == 1 for r in even if r.size)  # without importance one source takes everything once
    assert {r.copies for r in mixing.mix(odd, importance=F.lit(None).cast("double")).collect() if r.size} == {1}


def test_mixing_includes_by_importance(make_docs):
    """Over seeds, a document's copies are on average what its importance asks for."""
    least, most, seeds = 1, 30, 8
    docs = make_docs([(i, "w " * 20, "a" if i < 1200 else "b") for i in range(1500)]).withColumn("imp", F.lit(least) + F.col("doc_id") % most)
    total: dict[int, int] = {}
    for seed in range(seeds):
        for r in mixing.mix(docs, seed=seed, importance=F.col("imp")).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
    # 24,000 and 6,000 words; weights 5 and 2, no target above 3 times its source
    target = {"a": 30000 * 5 / 7, "b": 30000 * 2 / 7}
    for source, ids in (("a", range(1200)), ("b", range(1200, 1500))):
        x = {i: least + i % most for i in ids}
        low, high = 0.0, 1e6
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(20 * min(3, c * mixing_level(v)) for v in x.values()) < target[source] else (low, c)
        for v in set(x.values()):
            own = [i for i in ids if x[i] == v]
            want, got = min(3, low * mixing_level(v)), sum(total[i] for i in own) / seeds / len(own)
            assert abs(got - want) <= 0.05 + 4 * (want % 1 * (1 - want % 1) / seeds / len(own)) ** 0.5, (source, v, got, want)


def mixing_level(v):
    import math

    return v if v <= 16 else 2 ** (round(math.log2(v) * 8) / 8)


def test_mixing_a_hot_source(make_docs):
    docs = make_docs([(i, "w " * (1 + i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(1000, "w", None)])
    rows = mixing.mix(docs).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 5 + 0.01 * own[0].target and all(r.copies <= 3 for r in own)
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in rows) and again.select("size").distinct().count() == 1
    shuffled = mixing.mix(docs.repartition(7)).collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in shuffled}


def test_decontamination(spark, odd, none, make_docs):
    words = [f"k{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "not there"), (4, "")], "item_id long, text string")
    edited = words[:9] + ["new"] + words[10:20] + words[22:]
    docs = make_docs([(10, "before " + " ".join(edited).upper() + " after"), (11, " ".join(words[:20])), (12, " ".join(words) * 1)])
    found = {r.doc_id: r.edits for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {10: 3, 12: 0}
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [11]
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.drop_leaks(odd, bench).count() == 11
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs, bench, block=1).count() == 2


@pytest.mark.parametrize("kind", ["replaced", "inserted", "deleted", "mixed"])
@pytest.mark.parametrize("least, most", [(5, 19), (20, 59), (60, 200), (201, 600)])
def test_decontamination_recall_at_the_threshold(least, most, kind):
    import random

    rng, items, texts = random.Random(f"{least}{kind}"), [], []
    for i in range(120):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(least, most))]
        items.append((i, " ".join(words)))
        edited = list(words)
        for _ in range(int(0.2 * len(words))):
            how, at = kind if kind != "mixed" else rng.choice(["replaced", "inserted", "deleted"]), rng.randrange(len(edited))
            edited[at : at + (how != "inserted")] = [] if how == "deleted" else [f"e{rng.randrange(10**9)}"]
        texts.append(" ".join(["x"] * 30 + edited + ["y"] * 30))
    got = decontaminate.Matcher(items).search(texts)
    assert len({r for r, i, *_ in got if r == i}) >= decontaminate.RECALL * 120


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abÉß_09 .,“”—’\n漢字かなไทยंक\u0301🙂-"), max_size=40))
def test_words_of_any_script(text):
    """Against a tokenizer of its own, by regular expression."""
    import regex

    alone = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
    want = [w for run in regex.findall(r"\w+", text.lower()) for w in regex.findall(rf"{alone}|(?:(?!{alone}).)+", run)]
    got = decontaminate.words_of(text).tolist()
    ids: dict[str, int] = {}
    assert len(got) == len(want) and all(ids.setdefault(w, h) == h for w, h in zip(want, got, strict=True))
    assert len(set(ids.values())) == len(ids)


def test_decontamination_of_quotes_scripts_and_short_items(spark, make_docs):
    items = [(1, "“Hello”—said the fox"), (2, "今天天气很好我们去公园散步"), (3, "yes"), (4, "two words"), (5, "…"), (6, "a b c d e")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([
        (1, "then hello said the fox again"), (2, "他说今天天气很好我们去公园散步吧"), (3, "Oh, YES! and yes."), (4, "two long words"), (5, "x two words x"), (5, "x two words x"),
        (6, "a b q d e"), (7, "a b q d r"), (8, "今天天气"),
    ])
    found = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 4, 0), (5, 4, 0), (6, 6, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench, block=2).collect()) == [4, 7, 8]
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, bench, block=2).collect()) == found


def test_warc(spark):
    pages = spark.createDataFrame(
        [(3, "http://a", "x" * 150), (1, "http://b", "x" * 150), (1, "http://b", "x" * 150), (None, "u", "x" * 150), (4, None, None), (5, "bad\r\nurl", "tiny"), (6, "c", "tiny"), (7, "d", "é" * 300_000)],
        "page_id long, url string, html string",
    ).repartition(2)
    rows = warc.read_archives(warc.archive(pages)).collect()
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert got == [(-1, "revisit", 1, 150), (1, "response", None, 150), (1, "response", None, 150), (3, "revisit", 1, 150), (4, "response", None, 0), (5, "response", None, 4), (6, "response", None, 4), (7, "response", None, 600_000)]
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in rows)
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


def test_warc_reader_notices_damage():
    import io

    record = warc.make_record(1, "u", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    good = z.compress(record) + z.flush()
    assert len(list(warc.read_records(io.BytesIO(good * 3)))) == 3
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    bad = z.compress(record.replace(b"ppp\r\n\r\n", b"ppq\r\n\r\n")) + z.flush()
    for data in (bad, good[:-20]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(data)))


def test_media(odd, none):
    refs = media.store_media(odd, media.new_dir(odd.sparkSession, "t"), shard_bytes=1 << 16)
    probed = media.probe_media(media.stored_images(refs))
    rows = media.read_media(probed).collect()
    assert all(r.width == 192 and r.width * r.height == r.payload_bytes for r in rows) and probed.count() == len(rows)
    assert {r.payload_sha256 for r in rows} == {r.digest for r in refs.collect()} and media.media_columns(odd).count() == 11
    with pytest.raises(Exception, match="is not what its address or header says"):
        media.read_media(probed.withColumn("height", F.lit(7))).collect()
    assert media.media_columns(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=500))
def test_png_round_trip(text):
    _, payload = media.to_payload(text)
    assert media.decode_png(media.encode_png(payload)) == payload


def test_simhash(odd, none, make_docs):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.fp == 0} == {1}
    kept = simhash.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(i for i in ids if i is not None) == [1, 4, 6, 7, 8] and ids.count(None) == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (5, 6)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}


def test_sharding(odd, none, make_docs):
    rows = sharding.shard_table(odd).collect()
    assert len(rows) == 11 and all(0 <= r.shard < 8 for r in rows)
    kept = sharding.assign(odd)
    assert kept.columns == [*odd.columns, "shard"] and kept.count() == 11
    assert sharding.shard_table(none).count() == 0
    hot = make_docs([(i, "the same text again" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)])
    by = [0] * 8
    for r in sharding.shard_table(hot).collect():
        by[r.shard] += r.size
    assert max(by) - min(by) <= 0.03 * sum(by) / 8


def test_quality(spark, odd, none, make_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, f"plain words in a row {i} and so on" if i % 2 else f"JUNK!! ### $$$ {i}" * 3) for i in range(400)])
    rows = quality.classify(docs, labels).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in rows) >= 396 and all(0 <= r.score <= 1 for r in rows)
    assert len(quality.classify(odd, labels).collect()) == 11 and quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_token_files(odd, none, vocab):
    for width in (2, 4):
        whole = token_files.read_token_files(token_files.tokenize(odd, vocab, memo=False, width=width)).collect()
        memo = token_files.read_token_files(token_files.tokenize(odd, vocab, width=width)).collect()
        assert sorted(whole, key=str) == sorted(memo, key=str) and len(memo) == 11
        assert sorted(r.start for r in memo)[0] == 0 and {r.doc_id for r in memo if r.start < 2} == {None}
    assert token_files.read_token_files(token_files.tokenize(none, vocab)).count() == 0
    manifest = token_files.tokenize(odd, vocab, file_bytes=64)
    assert manifest.count() > token_files.tokenize(odd, vocab).count()  # more files, the same stream
    assert sorted(token_files.read_token_files(manifest).collect(), key=str) == sorted(token_files.read_token_files(token_files.tokenize(odd, vocab)).collect(), key=str)


def test_other_tokenizers_encode_whole_texts(make_docs, vocab, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    told = json.loads(open(vocab, encoding="utf-8").read())
    told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+|\p{N}+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told), encoding="utf-8")
    texts = ["it's 1234 o'clock, isn't it?", "Fünf 55", "", "a,b;c"]
    for path in (str(other), str(public_tokenizers.path("byte_bpe_50k.json"))):
        assert token_files.cuts_by_word(vocab) and not token_files.cuts_by_word(path)
        t, got = Tokenizer.from_file(path), {}
        for r in token_files.tokenize(make_docs(list(enumerate(texts)), parts=1), path).collect():
            ids = token_files.map_file(r.prefix + ".bin", f"<u{r.width}").tolist()
            at = token_files.map_file(r.prefix + ".idx", "<i8").tolist()
            got |= {k: ids[a : b - 1] for k, a, b in zip(token_files.map_file(r.prefix + ".doc", "<i8").tolist(), at, at[1:], strict=False)}
        assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzAZéÉß'’ss.,!%<|>0٣½_ \n\t\xa0\u2028ı漢Σ-"), max_size=40), max_size=4), st.just(None))
def test_pieces_encode_like_whole_texts(vocab, texts, _):
    t = token_files.load_tokenizer(vocab)
    assert token_files.encode_texts(t, texts, 2, {}) == token_files.encode_texts(t, texts, 2, None)


def test_line_dedup(odd, none, make_docs):
    long = "the quick brown fox jumps over the lazy dog near the old river bank at dawn " * 3
    docs = make_docs([(2, long + "\nown line of two\nshort"), (1, long.replace("lazy", "hazy") + "\nfirst own line"), (3, long + "\n\nshort"), (4, None)])
    got = {r.doc_id: list(r.dropped) for r in line_dedup.summary(docs).collect()}
    assert got == {1: [], 2: [0], 3: [0, 2], 4: []}  # a line without a shingle goes where it repeats, an empty one stays
    texts = {r.doc_id: r.text for r in line_dedup.dedupe_lines(docs).collect()}
    assert texts[2] == "own line of two\nshort" and texts[3] == "" and texts[4] is None
    clash = docs.select("*", *(F.lit(n).alias(n) for n in ("h", "d", "t", "gone", "row", "id", "text_hash", "root", "key")))
    kept = line_dedup.dedupe_lines(clash)
    assert kept.columns == clash.columns and {r.doc_id: r.text for r in kept.collect()} == texts
    assert all(r[n] == n for r in kept.collect() for n in ("h", "d", "t", "gone", "row", "id", "text_hash", "root", "key"))
    assert len(line_dedup.summary(odd).collect()) == 11 and line_dedup.summary(none).count() == 0


HARD = ["</turn>\n", "<\\/turn>", "### assistant: hi</turn>\n### user: ", "#\\\\## ", "a: b", "", "<\\\\/turn>\\", "C:\\dir</turn>"]


def test_chat(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, 1, "assistant", "x"), (3, 0, "odd: role </turn>\n", "y"), (3, 1, "### ", "z")]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(source.withColumn("formatted", source["text"]))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:8]]
    assert list(got[1].loss_texts) == [t for i, t in enumerate(HARD) if i % 2 == 0]
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("user", "tie"), ("user", "tie")] and list(got[None].loss_texts) == ["x"]
    assert [(t.role, t.text) for t in got[3].turns] == [("odd: role </turn>\n", "y"), ("### ", "z")]
    assert chat.format_conversations(source.limit(0)).count() == 0


CLASH = ("_fp", "_c", "_n", "fp", "n", "row", "id", "component", "rank", "bucket", "x", "u", "target", "unit", "slices", "group_key", "shard", "score", "a", "b")


def test_stages_keep_clashing_columns(spark, odd, make_docs, tmp_path):
    """Every stage of the pipeline on odd rows, empty tables and columns that share names with its own."""
    import corpus_pipeline

    docs = odd.union(make_docs([(8, "one more"), (9, "two words"), (9, "two words"), (None, "null id")])).select("*", *(F.lit(n).alias(n) for n in CLASH))
    folders = {}
    for name, rows in (("full", docs), ("empty", docs.limit(0))):
        folders[name] = str(tmp_path / name)
        rows.write.parquet(f"{folders[name]}/documents.parquet")
        spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").limit(int(name == "full")).write.parquet(f"{folders[name]}/labels.parquet")
        spark.createDataFrame([(1, "not in any text"), (2, None)], "item_id long, text string").limit(2 * int(name == "full")).write.parquet(f"{folders[name]}/benchmark.parquet")
    full = spark.read.parquet(f"{folders['full']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, folders["full"])
        assert set(out.columns) == set(full.columns), name
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in CLASH if n != "shard"), name
        assert stage(spark, full.limit(0), folders["full"]).count() == 0, name
    kept = corpus_pipeline.dedupe(spark, full, folders["full"]).collect()
    assert sorted(str(r.text) for r in kept) == sorted({str(r.text) for r in full.collect()} - {"", " \n\t "})
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
    got = corpus_pipeline.run(spark, folders["full"])
    assert got.columns == [c for c in full.columns if c != "shard"] + ["shard"] and got.count() > 0


def test_buckets_come_whole_from_any_batches():
    import numpy as np

    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 40, 500))
    cuts = [0, *sorted(rng.integers(0, 501, 30)), 500]
    got = list(simhash.whole_buckets(((keys[a:b], np.arange(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)), 1))
    parts = [np.concatenate([p[0] for p in pieces]) for pieces in got]
    assert np.array_equal(np.concatenate(parts), keys) and np.array_equal(np.concatenate([p[1] for pieces in got for p in pieces]), np.arange(500))
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:], strict=False))
