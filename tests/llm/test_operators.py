import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import components, decontaminate, embedding_dedup, html_text, near_dup, packing, quality, toxicity, warc
from cairn.llm import token_store as ts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(1, "Hello World, it's 12 o'clock"), (2, None), (3, ""), (4, "éà ß " * 50), (5, "same words again and again"), (5, "same words again and again"), (None, "no id"), (7, "x" * 5000)]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")


def test_tokens_equal_the_library_and_lookup_finds_all(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    store = ts.build_index(ts.write_store(frame(spark), VOCAB))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.start) for r in ts.read_digests(ts.lookup(store, store.entries)).collect()))
    want, at = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), at))
        at += len(ids)
    assert got == sorted(want)
    foreign = spark.range(1000, 1100).select(F.col("id").alias("key"), F.lit(0).alias("occurrence"), F.xxhash64("id").alias("hash"))
    assert ts.lookup(store, foreign.withColumn("occurrence", F.col("occurrence").cast("long"))).count() == 0


def test_rows_of_one_key_fill_many_shards(spark):
    rows = [(k, f"text {k} {j}") for k in range(5) for j in range(3)] + [(9, f"hot {j % 200}") for j in range(3000)] + [(None, "void")] * 1500 + [(2**60 + 1, "end")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = ts.build_index(ts.write_store(frame(spark, rows), VOCAB))
        entries = store.entries.withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("none"))).toPandas()
        digests = ts.read_digests(ts.lookup(store, store.entries)).withColumn("doc_id", F.col("doc_id").cast("string")).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert entries[entries["key"] == "9"]["shard"].nunique() > 1 and entries[entries["key"] == "none"]["shard"].nunique() > 1
    for _, group in entries.groupby("key"):
        assert sorted(group["occurrence"]) == list(range(len(group)))
    assert len(digests) == len(rows)
    digests = digests.sort_values("start")
    assert (digests["start"].to_numpy() == np.cumsum(digests["n_tokens"].to_numpy()) - digests["n_tokens"].to_numpy()).all()
    assert digests["doc_id"].isna().to_numpy()[:1500].all()
    assert [int(i) for i in digests["doc_id"][digests["doc_id"].notna()]] == sorted(i for i, _ in rows if i is not None)


def test_perfect_hash_is_minimal():
    keys = ts.mix64(np.arange(5000, dtype=np.uint64))
    order, _ = ts.perfect_hash(keys)
    assert sorted(order.tolist()) == list(range(5000))


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert ts.build_index(ts.write_store(empty, VOCAB)).shards == []
    assert packing.pack_documents(empty, VOCAB).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_packing_is_gapless_and_whole(spark):
    rows = packing.pack_documents(frame(spark, [(k, "word " * (k * 37 % 900)) for k in range(300)]), VOCAB, capacity=256).toPandas()
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 256
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 256) + 2


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([20, 13, 5, 1, 0, 40])] + [(9, None)]
    docs = [(k, " ".join(rng.choice(vocab, 30)) + " " + (items[k % 6][1] or "").upper() + " é") for k in range(40)] + [(99, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    patterns = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(low))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k : k + n])].add(str(i))
    want = {}
    for i, t in docs:
        w, found = word.findall((t or "").translate(low)), set()
        hit = [0] * len(w)
        for p, names in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit[k : k + len(p)] = [1] * len(p)
                    found |= names
        want[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    for size in (1 << 20, 100):
        got = decontaminate.digest(decontaminate.decontaminate(frame(spark, docs), benchmark, part_bytes=size)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_warc_revisits(spark, tmp_path):
    rows = [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, None, None), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (None, "http://a/6", "y")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.warc_query(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got[1] == (1200, "revisit", 2, sha("x" * 1200)) and got[2] == (1200, "response", None, sha("x" * 1200))
    assert got[3] == (0, "response", None, sha("")) and got[4][1] == got[5][1] == "response" and got[None][0] == 1


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [[f"t{x}" for x in rng.integers(0, 500, 120)] for _ in range(12)]
    docs = []
    for k in range(150):
        w = list(base[k % 12])
        for at in rng.integers(0, 120, k % 5):
            w[at] = "changed"
        docs.append((k, " ".join(w)))
    docs += [(900, "only three words"), (901, "Only THREE  words"), (902, None), (903, " \n"), (904, "only three")]
    sets = {i: set(zip(*[w[j:] for j in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} - {()} for i, t in docs for w in [(t or "").lower().split()]}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = near_dup.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: r.component_id for r in got} == root and {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_near_duplicates_in_large_nodes_are_found(spark, monkeypatch):
    """Distinct copies of one text, of which only the planted pairs (116 of 136 shingles in common) reach the threshold."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    docs = []
    for k in range(150):
        w, at = [f"b{x}b" for x in range(130)], 5 + k % 25
        to = at + 60 + k // 25 * 5
        w[at], w[to] = f"x{k}", f"y{k}"
        other = list(w)
        other[at + 30 - k // 25], other[to + 10] = f"p{k}", f"q{k}"
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_estimates_follow_the_threshold():
    assert near_dup.trees_for(85, near_dup.DEPTH) == 6 < near_dup.trees_for(80, near_dup.DEPTH)
    assert near_dup.least_agreeing(85) == 92 and near_dup.least_agreeing(80) == 84


def test_pipeline_drops_copies_from_similarity_080(spark):
    """113 of 139 shingles in common."""
    words = [f"b{x}" for x in range(130)]
    copy = list(words)
    copy[10], copy[70] = "x", "y"
    other = list(words)
    other[2] = "z"
    docs = frame(spark, [(1, " ".join(copy)), (2, " ".join(other)), (3, "something else")])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_near_copies_without_id_are_linked(spark):
    """The second text is linked with the first and the third, which are not alike enough."""
    words = [f"b{x}" for x in range(130)]
    a, c = list(words), list(words)
    a[10], a[20], c[90], c[110] = "p", "q", "r", "s"
    got = near_dup.near_duplicates(frame(spark, [(1, " ".join(a)), (None, " ".join(words)), (3, " ".join(c))])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (None, 1, False), (3, 1, False)}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 24))
    x = [base[k % 20] + rng.normal(size=24) * rng.uniform(0, 0.5) for k in range(400)]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, []), (1004, [1.0, None])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    m = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = (m @ m.T) >= 0.9
    found = sum(n for n, _ in got.values())
    assert found >= 0.99 * (near.sum() - len(x)) and found <= near.sum() - len(x)
    assert all(got[k] == (0, k) for k in range(1000, 1005))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_grammar_contexts():
    s = toxicity.Scorer({"fool": 2.0})
    plain, targeted, negated, reported, _ = np.eye(5, 10, dtype=bool)
    for text, where in (("a fool here", plain), ("you fool", targeted), ("not a fool", negated), ("he said fool", reported)):
        assert (s.features(text) > 0)[:5].tolist() == where[:5].tolist()
    assert not s.features(None).any() and not s.features("clean text").any()


def test_copies_count_once_and_other_texts_each(spark):
    """Different toxic texts with the same insults are evidence each; the filler of a copied text isn't."""
    insults = "idiot moron trash"
    rows = [(f"{insults} " + " ".join(f"t{chr(97 + k)}{chr(97 + j)}" for j in range(8)), 1) for k in range(25)]
    rows += [(f"{insults} said " + " ".join(f"c{chr(97 + k)}{chr(97 + j)}" for j in range(8)), 0) for k in range(5)]
    rows += [("filler " + " ".join(f"f{chr(97 + j)}" for j in range(20)), 1)] * 20
    rows += [(" ".join(f"{x}{chr(97 + k)}{chr(97 + j)}" for j in range(8)), 0) for k in range(20) for x in "uvw"]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    assert set(toxicity.learn_lexicon(labelled)) == set(insults.split())
    assert toxicity.without_copies(labelled).count() == 25 + 5 + 1 + 60


def test_labelled_ids_pass_and_few_others(spark):
    ids = [-(2**63), -7, 0, 2**63 - 1, *range(10, 20_000, 3)]
    passes = toxicity.among(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    asked = spark.createDataFrame([(i,) for i in ids], "doc_id long").unionByName(spark.range(10**6, 10**6 + 20_000).withColumnRenamed("id", "doc_id"))
    got = [r.doc_id for r in asked.filter(passes("doc_id")).collect()]
    assert set(ids) <= set(got) and len(got) - len(ids) < 1500
    assert not asked.filter(toxicity.among(asked.limit(0))("doc_id")).count()


def test_toxicity_shuffles_texts_only_for_labelled_ids(spark):
    """The texts of all documents met the labels; at size they were the largest part of the disk."""
    sc, text = spark.sparkContext, lambda k: "".join(random.Random(k).choices(string.ascii_letters, k=20_000))
    docs = spark.createDataFrame([(k, text(k)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 40 == 0)) for k in range(0, 400, 20)], "doc_id long, toxic int")
    sc.setJobGroup("shuffled", "toxicity")
    toxicity.learned(docs, labels)
    sc.setJobGroup("", "")
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {k for job in sc.statusTracker().getJobIdsForGroup("shuffled") for k in sc.statusTracker().getJobInfo(job).stageIds}
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteBytes() for k in stages)
    assert 100_000 < written < 2_000_000


def test_blocks_of_markup():
    page = "<head><title>T</title></head><header>Site</header><div class='cookie-notice'>c</div><main><h1>Head</h1><p>One &amp; two<br>three<p>Four <b>bold</b>x</main><footer>F"
    assert [t for z, t in html_text.blocks(page) if z == "body"] == ["Head", "One & two three", "Four boldx"]
    assert html_text.blocks(None) == []


def test_repeated_open_text_goes_and_unique_text_stays(spark):
    same = "<div>Same boiler text that is repeated on all pages here now</div>"
    rows = [(1, "http://h/a", same + "<div>unique one</div>"), (2, "http://h/b", same + "<div>other words</div>"), (3, "http://x/b", same), (4, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "unique one", 2: "other words", 3: "Same boiler text that is repeated on all pages here now", 4: ""}


def test_estimated_accuracies_follow_the_votes():
    patterns = np.array([[1, 1, 1], [0, 0, 0], [1, 1, 0], [0, 0, 1], [-1, -1, -1]])
    p, accuracy, _ = quality.estimate(patterns, np.array([500, 300, 60, 40, 5.0]))
    assert p[0] > 0.9 > 0.1 > p[1] and accuracy[0, 0] > accuracy[0, 2]
