"""Brute force, held-out accuracy and the defined results for nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, embedding_dedup, html_text, language, near_dup, packing, quality, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("word_bpe_49k.json")
#: Null and repeated ids, equal rows, null, empty and long texts.
ODD = [(None, None), (None, "a b c d e f g"), (1, ""), (1, "other words"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "long " * 60_000), (4, "1 2 3 !?"), (5, " \n\t ")]


def documents(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    clash = "row string, lang string, key string, v string, score string, marks string, component_id string, toxic string, length string"
    made = [(i, t, *["x"] * 9) for i, t in rows]
    return spark.createDataFrame(made, f"doc_id long, text string, {clash}")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_composed_machines_equal_their_parts():
    rng = random.Random(4)
    for parts in (toxicity.FORWARD, toxicity.BACKWARD):
        machine, single = toxicity.composed(parts), [p() for p in parts]
        for _ in range(400):
            symbols = "".join(rng.choices("IHWTNRO", k=rng.randrange(12)))
            want = symbols
            for t in single:
                want = t.run(want)
            assert machine.run(symbols) == want


def test_grammar_reads_both_sides_and_threats():
    s = toxicity.Scorer({"fool": 2.0, "stem*": 1.0})
    of = lambda text: dict(zip(toxicity.CONTEXTS, s.features(text)[:5].round(3).tolist(), strict=True))
    assert of("fool, you")["targeted"] == of("you fool")["targeted"] == of("you stemming")["targeted"] * 2 == 2.0
    assert of("'fool', he said")["reported"] == 2.0 and of("not such a big fool")["negated"] == 0 and of("no fool")["negated"] == 2.0
    assert of("they will hurt you")["threat"] == 2.0 and of("hurt you")["threat"] == 1.0 and of("kill time")["threat"] == 0
    assert of("you. fool")["plain"] == 2.0 and s.features("word " * 50_000).sum() == 0


def test_toxicity_of_held_out_documents_and_odd_rows(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        words = ["".join(rng.choices("aeioulmnrst", k=6)) for _ in range(40)]
        if k % 5 == 0:
            for at in rng.sample(range(40), 4):
                words[at] = rng.choice(["moron", "idiot", "grub" + rng.choice("aeiou") + rng.choice("lmnrst")])
        rows.append((100 + k, " ".join(words)))
    marks = labels(spark, [(i, 1, int((i - 100) % 5 == 0)) for i, _ in rows])
    got = toxicity.score(documents(spark, rows + ODD), marks).collect()
    assert len(got) == 300 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 100]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert all(r.predicted == ((r.doc_id - 100) % 5 == 0) for r in held)
    odd = [r for r in got if r.doc_id is None or r.doc_id < 100]
    assert not any(r.predicted for r in odd) and not any(r.held_out for r in odd if r.doc_id is None)
    assert toxicity.score(documents(spark, []), marks).count() == 0
    assert {r.score for r in toxicity.score(documents(spark, ODD), labels(spark, [])).collect()} == {0.0}


def test_language_of_held_out_documents_and_odd_rows(spark):
    rng = random.Random(6)
    words = {"xx": ["the", "with", "house", "thing", "which"], "yy": ["der", "und", "schlecht", "ueber", "zwischen"], "zz": ["que", "para", "mucho", "cuando", "nosotros"]}
    rows = [(k, " ".join(rng.choices(words[x], k=20)), x, None) for k in range(240) for x in [list(words)[k % 3]]]
    odd = [(i, t, None, "clash") for i, t in ODD]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, found string")
    got = language.identify(docs).collect()
    held = [r for r in got if r.held_out and (r.doc_id or 0) > 5]
    assert len(got) == 240 + len(odd) and held and all(r.lang_pred == list(words)[r.doc_id % 3] and r.score > 0.5 for r in held)
    assert sorted(r.doc_id is None for r in got if r.lang_pred == "und") == [False] * 3 + [True]
    assert language.identify(docs.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_votes_equal_their_definition(spark):
    rng = random.Random(7)
    texts = [t for _, t in ODD] + ["".join(rng.choices("ab cd.\n1#é the", k=rng.randrange(400))) for _ in range(150)]
    for text, votes in zip(texts, quality.votes(texts).tolist(), strict=True):
        t = text or ""
        w, lines, n = t.lower().split(), [x for x in t.split("\n") if x.strip()], max(1, len(t))
        share = lambda f: sum(map(f, t)) / n  # noqa: B023, E731
        kinds, ends = len(set(w)) / max(1, len(w)), sum(c in ".!?" for c in t) / max(1, len(w))
        letters, marks, digits = share(str.isalpha), share(lambda c: c in quality.MARKS), share(lambda c: c in "0123456789")
        repeated, common, long = 1 - len(set(lines)) / max(1, len(lines)), len(set(w) & set(quality.COMMON.split())), len(w) >= 30
        want = [
            (len(w) >= 50, len(w) < 15), (letters > 0.75, letters < 0.6), (marks < 0.005, marks > 0.03), (digits < 0.02, digits > 0.15), (long and kinds > 0.35, long and kinds < 0.15),
            (len(lines) >= 3 and repeated == 0, repeated > 0.2), (common >= 5, long and common <= 1), (len(w) >= 20 and 0.02 < ends < 0.3, len(w) >= 20 and (ends < 0.004 or ends > 0.5)),
        ]
        assert votes == [0 if bad else 1 if good else -1 for good, bad in want]
    docs = documents(spark, ODD)
    counted = {r.pattern: r.n for r in quality.patterns_of(docs).collect()}
    codes = quality.codes([t for _, t in ODD]).tolist()
    assert counted == {c: codes.count(c) for c in codes}
    got = quality.assess(docs).collect()
    assert len(got) == len(ODD) and all(r.keep == (r.posterior + r.score >= 1) for r in got) and sum(r.doc_id is None for r in got) == 2
    assert quality.assess(documents(spark, [])).count() == 0


def hard(copies, capacity=256, e=1):
    """Sizes whose best packing fills nine bins a copy, and best fit in decreasing order needs eleven."""
    half, quarter = capacity // 2, capacity // 4
    return ([half + e, quarter + e, quarter - 2 * e] * 6 + ([quarter + 2 * e] * 2 + [quarter - 2 * e] * 2) * 3) * copies


def test_genetic_search_beats_best_fit_and_reaches_the_optimum():
    for copies in (1, 2):
        sizes = np.array(hard(copies))
        first = packing.decreasing(sizes, 256)
        assert len(first.bins) == 11 * copies
        elite = packing.assigned_bins(first)
        for epoch in range(4):
            elite = packing.evolve(sizes, 256, epoch, [elite])
        assert len(set(elite.tolist())) == 9 * copies and np.bincount(elite, weights=sizes).max() <= 256


def test_packed_pieces_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok, rows = Tokenizer.from_file(VOCAB), ODD + [(100 + k, "w " * (n - 1)) for k, n in enumerate(hard(1))]
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(str(i), k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    got = packing.pack_documents(documents(spark, rows), VOCAB, capacity=256).toPandas()
    assert sorted(zip(got.doc_id.map(lambda x: "None" if np.isnan(x) else str(int(x))), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(want)
    filled = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert filled.sum().max() <= 256 and (filled.cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all()
    full = sum(n == 256 for *_, n, _ in want)
    rest = sum(n for *_, n, _ in want if n < 256)
    assert got.sequence_id.nunique() <= full + -(-rest // 256)


def test_links_of_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 20))
    x = [base[k % 12] + rng.normal(size=20) * 0.25 for k in range(240)]
    rows = [(k if k != 7 else None, v.tolist()) for k, v in enumerate(x)] + [(300, x[0].tolist()), (300, (2 * x[1]).tolist()), (301, None), (302, [0.0] * 20), (303, [1.0])]
    docs = spark.createDataFrame([(i, v, "c", "c") for i, v in rows], "vec_id long, embedding array<double>, v string, ball string")
    m = np.array(x + [x[0], 2 * x[1]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    root = np.arange(len(m))
    for _ in range(len(m)):
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    ids = [*[None if k == 7 else k for k in range(240)], 300, 300]
    least = {r: min(i for i, q in zip(ids, root, strict=True) if q == r and i is not None) for r in set(root.tolist())}
    want = sorted((str(i), int(n.sum()) - 1, least[r]) for i, n, r in zip(ids, near, root.tolist(), strict=True)) + [("301", 0, 301), ("302", 0, 302), ("303", 0, 303)]
    got = embedding_dedup.near_vectors(docs).collect()
    assert sum(n for _, n, _ in want) > 500 and sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == sorted(want)


def test_quantiser_ends_at_its_recall_for_any_number_of_vectors():
    x = np.random.default_rng(9).normal(size=(1024, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embedding_dedup.Quantiser(x, 10**9)
    other = np.random.default_rng(10).normal(size=(2000, 16))
    other /= np.linalg.norm(other, axis=1)[:, None]
    a, b = q.codes(other)[0], q.codes(q._at(other, 0.9, np.random.default_rng(11)))[0]
    assert (a == b).any(axis=1).mean() > 0.985


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, text string, host string")


def test_repeats_equal_brute_force(spark):
    """Pages whose markup says nothing: runs of four words that another page of the host has go, unless nothing is left."""
    rng, rows, blocks = random.Random(12), [], {}
    boiler = [[f"b{x}" for x in rng.choices(range(9), k=6)] for _ in range(4)]
    for k in range(30):
        own = [rng.choice(boiler) + [f"u{k}x{j}" for j in range(rng.randrange(6))] if rng.random() < 0.7 else [f"w{rng.randrange(5)}" for _ in range(3)] for _ in range(5)]
        host = f"h{k % 3}"
        blocks[k] = host, own
        rows.append((k, f"http://{host}/{k}", "".join(f"<div>{' '.join(b)}</div>" for b in own)))
    runs = {}
    for k, (host, own) in blocks.items():
        for b in own:
            for at in range(len(b)):
                if len(b) - at >= 4 or at == 0:
                    runs.setdefault((host, tuple(b[at : at + 4]), min(4, len(b) - at)), set()).add(k)
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows), run=4).collect()}
    for k, (host, own) in blocks.items():
        out = []
        for b in own:
            gone = {j for at in range(len(b)) if (len(b) - at >= 4 or at == 0) and len(runs[host, tuple(b[at : at + 4]), min(4, len(b) - at)]) > 1 for j in range(at, min(at + 4, len(b)))}
            out.append(" ".join(w for j, w in enumerate(b) if j not in gone))
        assert got[k] == ("\n".join(x for x in out if x) or "\n".join(" ".join(b) for b in own))


def test_markup_of_comments_and_odd_pages(spark):
    script = "<script>if (a <!-- b) x();</script><article><p>kept</p><article class='comment'>reader</article><section id=related>no</section></article>"
    whole = "<div>one two three four five six seven eight nine</div><p>ten</p>"
    rows = [(1, "http://a/1", script), (None, None, None), (2, "http://b/1", whole), (3, "http://b/2", whole), (3, "http://b/2", whole), (4, "http://c/", "<article>" + "<p>x y</p>" * 20_000 + "</article>"), (5, "no url", "<!-- <script> --><p>after</p>")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages(spark, rows)).collect()]
    copy = "one two three four five six seven eight nine\nten"
    want = [(1, "kept", 4), (None, "", 0), (2, copy, len(copy)), (3, copy, len(copy)), (3, copy, len(copy)), (4, "\n".join(["x y"] * 20_000), 79_999), (5, "after", 5)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_of_odd_pages(spark, tmp_path):
    same = "x" * 1500
    rows = [(1, "u", same), (9, "u", same), (9, "v", same), (None, None, None), (3, "", "é" * 500_000)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.warc_query(spark, str(tmp_path)).collect()
    assert len(got) == 5 and sorted(r.payload_bytes for r in got) == [0, 1500, 1500, 1500, 1_000_000]
    assert [r.refers_to for r in got if r.page_id == 1] == [9] and sum(r.record_type == "response" and r.payload_bytes == 1500 for r in got) >= 1
    pages(spark, []).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.warc_query(spark, str(tmp_path / "none")).count() == 0


PASSAGE = " ".join(f"q{k}" for k in range(20))


def test_filtering_stages_judge_rows_by_their_own_text(spark):
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string")
    rows = [*ODD, (1, PASSAGE), (None, PASSAGE + " more"), (8, " ".join(f"c{k}" for k in range(900)) + " " + PASSAGE)]
    docs = documents(spark, rows)
    for size in (1 << 20, 10):
        kept = decontaminate.clean_rows(docs, benchmark, part_bytes=size)
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in rows if not (t or "").startswith(PASSAGE))
    found = decontaminate.decontaminate(docs, benchmark).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in found if r.n_hit) == [("1", 20), ("8", 20), ("None", 20)] and sum(r.contaminated for r in found) == 2
    one = near_dup.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:20]) for r in one.collect()) == sorted((str(i), (t or "")[:20]) for i, t in [*ODD[:1], *ODD[2:5], *ODD[6:], (1, PASSAGE), rows[-1]])  # 16 of 17 shingles of the passage are in both
    for stage in (decontaminate.clean_rows(documents(spark, []), benchmark), near_dup.one_of_each(documents(spark, []))):
        assert stage.count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The learned stages are asked; what they keep is deduplicated, cleaned and packed again by plain code."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = spark.createDataFrame([(None, PASSAGE + " alone"), (1, "a repeated id with a text of its own"), (None, None)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    toxic = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_unidentified(spark, toxic, str(tmp_path)).collect()]
    assert 0 < len(left) < docs.count() and all(t and any(c.isalpha() for c in t) for _, t in left)

    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in left:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[a] if x == root[b] else x for x in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(left[k])
    left = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    patterns = decontaminate.Patterns([(str(r.item_id), r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()])
    clean = []
    for i, t in left:
        w = decontaminate.words(t)
        n = sum(patterns.search(w)[0])
        if not (n and 20 * n >= len(w)):
            clean.append(i)
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(map(str, clean))
