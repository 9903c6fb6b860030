"""The ten operators and the pipeline: edge cases on small tables, and whole tables against plain versions."""

from __future__ import annotations

import hashlib
import zlib

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formline.llm import common, decontaminate, exact_dedup, html_text, language, minhash, mixing, queries, repeats, tokens, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, row long, rk long, n long, mid long"
LONG = " ".join(f"w{i}" for i in range(3000))


def docs_of(spark, texts):
    """A table of documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3, 4) for i, t in texts], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, LONG + " end"), (7, LONG), (None, LONG), (None, None), (9, "é Ü ß words here are few"), (9, "é Ü ß words here are few"), (10, "a  b\tc d"), (11, "a b c d")]


@pytest.fixture(scope="module")
def small():
    return pd.read_parquet(f"{SF}/documents.parquet")


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1
def test_decontamination_matches_brute_force(spark, small):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = brute.contamination(list(zip(small.doc_id, small.text)), list(zip(bench.item_id, bench.text)))
    got = table(queries.op1_decontamination(spark, SF))
    assert len(got) == len(want)
    for d, (n, hit, items) in want.items():
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, "!!"), (None, "w5 w6"), (4, " ".join(f"w{i}" for i in range(20, 40))), (5, "FEW are here"), (6, "words here are few")], "item_id long, text string")
    docs = docs_of(spark, ODD)
    got = decontaminate.contamination(docs, bench).collect()
    want = brute.contamination([(i, t) for i, t in enumerate(t for _, t in ODD)], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted((r.n_words, r.n_hit) for r in got) == sorted((n, h) for n, h, _ in want.values())
    assert {r.doc_id: r.n_items for r in got}[9] == 1
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_decontamination_by_a_large_benchmark(spark, monkeypatch):
    """Where the benchmark isn't broadcast: the same rows, and no shuffle of a document's words for each of its words."""
    texts = [t for _, t in ODD] + [" ".join(f"v{i}" for i in range(2000))]
    bench = [(1, "one"), (2, None), (3, "w5 w6"), (4, " ".join(f"w{i}" for i in range(20, 40))), (5, "FEW are here"), (6, " ".join(f"v{i}" for i in range(1990, 2010)))]
    want = brute.contamination(list(enumerate(texts)), bench)
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = decontaminate.contamination(docs_of(spark, list(enumerate(texts))), spark.createDataFrame(bench, "item_id long, text string")).collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == {d: (n, hit, len(items)) for d, (n, hit, items) in want.items()}
    assert moved < 200 * sum(r.n_words for r in got)


# 2
def test_near_groups_match_brute_force(spark, small):
    want = brute.near_groups(list(zip(small.doc_id, small.text)))
    got = table(queries.op2_minhash_dedup(spark, SF))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_groups_of_drifting_copies(spark):
    """Copies with independent and with accumulating edits, and copies of a far copy, against all pairs."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for c in range(40):
        w = list(base)
        for at in rng.choice(120, rng.integers(1, 9), replace=False):
            w[at] = f"e{c}x{at}"
        texts.append(" ".join(w))
    w = list(base)
    for c in range(25):
        w[int(rng.integers(0, 120))] = f"d{c}"
        texts.append(" ".join(w))
    far = list(w)
    for c in range(20):
        v = list(far)
        v[int(rng.integers(0, 120))] = f"f{c}"
        texts.append(" ".join(v))
    rows = list(enumerate(texts))
    want = brute.near_groups(rows)
    for levels in (1, 3):
        got = table(minhash.near_duplicates(docs_of(spark, rows), k=4, levels=levels))
        assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want


def test_near_groups_edges(spark):
    got = minhash.near_duplicates(docs_of(spark, ODD), k=4).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 2997]
    assert by[6].component_id == by[7].component_id == 5
    assert not by[6].kept
    assert (by[11].component_id, by[10].kept) == (10, True)
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles} == {5}
    assert minhash.near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    sig = minhash.signature(minhash.mix(np.r_[a, b]), np.array([1000, 1000]), 256)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.1


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 61))
    assert got[101] == 100
    assert common.components(df.limit(0)).count() == 0


# 3
def test_token_counts_match_the_library(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["it's THE end<|endoftext|>x", "ΣΑΣ İ é", "a\x1cb　c", "!!!'s're'd12 3½", "aaaaaaaaaaaaaaaaaaaa", "naïve café ☃😀", "'", "x" * 500]
    rows = ODD + [(100 + i, s) for i, s in enumerate(odd)]
    got = tokens.token_counts(docs_of(spark, rows), path, limit=5).collect()
    want = sorted(len(t.encode(s or "", add_special_tokens=False).ids) for _, s in rows)
    assert sorted(r.n_tokens for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    got = table(queries.op3_token_counts(spark, SF))
    for d, s, e in zip(small.doc_id, small.text, t.encode_batch(small.text.tolist(), add_special_tokens=False), strict=True):
        assert (got[d].n_tokens, got[d].n_bytes) == (len(e.ids), len(s.encode()))
    assert tokens.token_counts(docs_of(spark, ODD).limit(0), path).count() == 0


# 4
def test_url_rules(spark):
    urls = ["https://NET/a", "http://x.net/", "http://a.example.net/en/1", "http://example.com/de/", "http://notexample.com/de/", "http://x.org/fr/?q=1", "http://x.org/fr", "x.net/", None, "http://x.net", "ftp://b.net?x#y"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://z.org/fr/", None)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["net/", "net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert (got[0].host, got[0].path, got[8].host, got[10].host, got[10].path) == ("net", "/a", "", "b.net", "")
    assert got[2].verdict == "allow"
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert url_filter.judge_urls(df.where("page_id = 8")).first().verdict == "allow"
    whole = queries.op4_url_filter(spark, SF)
    assert whole.count() == pd.read_parquet(f"{SF}/pages.parquet").shape[0]


# 5
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    got = queries.op5_toxicity(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    m = got.merge(labels, on="doc_id").query("held_out")
    hits = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert hits / m.toxic.sum() > 0.8
    assert ((m.predicted == 1) & (m.toxic == 0)).sum() / (m.toxic == 0).sum() < 0.02


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 0, None), (None, 0, 1), (7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.judge_toxicity(docs_of(spark, ODD), labels).collect()
    assert len(got) == len(ODD)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.judge_toxicity(docs_of(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert toxicity.judge_toxicity(docs_of(spark, ODD).limit(0), labels).count() == 0


# 6
def test_language_of_held_out_documents(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("true_lang", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    got = language.identify(hidden, spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    m = got.join(hidden.where("lang is null").select("doc_id", "true_lang"), "doc_id").toPandas()
    assert (m.lang == m.true_lang).mean() > 0.95


def test_language_evidence_and_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "a"), (2, "der hund und die katze", "de", "b"), (3, None, "en", None), (None, "", None, "a")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://x.com/de/1", '<html lang="de"><p>und der die</p>'), (2, "http://x.com/de/2", '<html lang="de"><p></p>'), (3, None, None), (None, "", "<p>the and</p>")], "page_id long, url string, html string")
    got = language.identify(docs, pages)
    by = {r.page_id: r for r in got.where("page_id is not null").collect()}
    assert by[1].lang == "de"
    assert (by[2].lang, by[2].text_lang) == ("de", None)
    assert got.count() == 8
    assert all(0 < r.probability <= 1 for r in got.collect())
    assert language.identify(docs.limit(0), pages).where("lang is not null").count() == 0
    assert language.identify(docs, pages.limit(0)).count() == 4


# 7
def test_mixing_meets_its_targets(spark, small):
    got = queries.op7_mixing(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    m = got.merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert (m["size"] == [len(t.encode().split()) for t in m.text]).all()
    per = m.groupby("source").agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"), big=("size", "max"))
    assert (per.t <= 2 * per.s + 1e-6).all()
    assert per.t.sum() == pytest.approx(1.5 * per.s.sum())
    assert ((per.k - per.t).abs() <= 2 * per.big).all()
    assert (m.taken <= 2 * m["size"]).all()
    assert m.taken.sum() <= 1.5 * per.s.sum()
    again = queries.op7_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mixing_edges(spark):
    rows = [(1, "a b c", None), (2, None, "s"), (3, "x y", "s"), (None, "z", "t"), (3, "x y", "s"), (5, "", "u")]
    docs = spark.createDataFrame([(i, t, s, 1, 2.0) for i, t, s in rows], "doc_id long, text string, source string, rank long, target double")
    got = mixing.fair_queue(docs).collect()
    assert len(got) == 6
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (2, 5)} == {0}
    assert mixing.fair_queue(docs.limit(0)).count() == 0
    assert mixing.fair_queue(docs.where("doc_id = 2")).first().taken == 0


# 8
def test_repeats_match_brute_force(spark, small):
    want = brute.repeats(list(zip(small.doc_id, small.text)))
    got = table(queries.op8_repeated_strings(spark, SF))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want


def test_repeats_edges(spark):
    rng = np.random.default_rng(5)
    part = "".join(rng.choice(list("abcdef "), 900))
    rows = [(1, None), (2, ""), (3, "x" * 1000), (4, part), (5, "head|" + part[100:700] + "|tail"), (6, part[:399]), (7, "é" * 500), (8, part + part), (None, "lone"), (9, "y" * 400), (9, "y" * 400)]
    docs = docs_of(spark, rows)
    got = repeats.remove_repeats(docs, keep_first=False, step_bytes=700).collect()
    want = brute.repeats([(i, t) for i, (_, t) in enumerate(rows)])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want.values())
    first = {r.doc_id: r for r in repeats.remove_repeats(docs.where("doc_id in (4, 5, 8)"), keep_first=True).collect()}
    assert first[4].n_removed == 0
    assert first[5].n_removed == 600
    assert first[8].n_removed == 1800
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_anchors_with_very_many_runs_are_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    part = "".join(rng.choice(list("abcdef "), 600))
    rows = [(i, "".join(rng.choice(list("abc"), i * 7)) + part[: 500 + 9 * i] + "".join(rng.choice(list("abc"), 30))) for i in range(12)]
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    for first in (False, True):
        got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs_of(spark, rows), keep_first=first).collect()}
        want = brute.repeats(rows)
        if first:
            assert sum(got.values()) < sum(v[1] for v in want.values())
        else:
            assert got == {d: v[1] for d, v in want.items()}


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order_and_longest_previous_factors(seed):
    """Order, shared lengths and longest previous and next factors against all pairs of starts."""
    rng = np.random.default_rng(seed)
    length = int(rng.integers(1, 30))
    text = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(length, 150))).astype(np.uint8)
    text = np.r_[text, text[: len(text) // 2]] if seed % 3 == 0 else text
    starts = np.sort(rng.choice(len(text) - length + 1, max(1, (len(text) - length) // (1 + seed % 2)), replace=False))
    data = text.tobytes()

    def shared(i, j):
        return next((c for c in range(length) if data[i + c] != data[j + c]), length)

    order, with_last = repeats.suffix_order(text, starts, length)
    want = sorted(starts.tolist(), key=lambda i: (data[i : i + length], i))
    assert order.tolist() == want
    assert with_last.tolist() == [0] + [shared(i, j) for i, j in zip(want, want[1:])]
    assert repeats.longest_previous(order, with_last).tolist() == [max((shared(i, j) for j in want if j < i), default=0) for i in want]
    assert repeats.longest_previous(-order, with_last).tolist() == [max((shared(i, j) for j in want if j > i), default=0) for i in want]


def test_a_null_id_is_no_real_id(spark):
    """A null id and an id of -1 with one text are two documents, each with its own removals."""
    text = " ".join(f"word{i}" for i in range(100))
    got = repeats.remove_repeats(docs_of(spark, [(None, text), (-1, text), (3, "short")]), keep_first=True).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(text)]


# 9
def test_exact_groups_match_brute_force(spark, small):
    got = table(queries.op9_exact_dedup(spark, SF))
    assert {d: (r.keep_id, r.group_size, r.text_sha256) for d, r in got.items()} == brute.exact(list(zip(small.doc_id, small.text)))


def test_exact_groups_edges(spark):
    got = exact_dedup.exact_groups(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].text_sha256 == by[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].text_sha256 == hashlib.sha256(b" ").hexdigest()
    assert (by[7].keep_id, by[7].group_size, by[11].keep_id) == (5, 3, 10)
    assert exact_dedup.exact_groups(docs_of(spark, ODD).limit(0)).count() == 0


def test_index_keeps_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", 4)
    index.add(spark.createDataFrame([(5, "a"), (6, "b"), (7, "a")], "doc_id long, digest string"))
    index.add(spark.createDataFrame([(1, "a"), (8, "c")], "doc_id long, digest string"))
    assert {(r.digest, r.keep_id) for r in index.read().collect()} == {("a", 5), ("b", 6), ("c", 8)}
    spark.sql("DROP TABLE digest_index_test")


# 10
def test_html_extraction_is_the_article(spark):
    import html
    import re

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, SF).collect()}
    for p in pages.itertuples():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


def test_html_extraction_without_main_elements():
    page = """<html><head><title>T</title></head><body><div class="menu"><a href=1>Home</a></div><div id=cookie-notice>We use cookies</div>
    <div><h2>News &eacute;</h2><p>Here is <b>a</b>   paragraph of text that is long enough.</p><p>Short.</p><p>And &lt;one&gt; more paragraph of text.</p></div>
    <form><p>Your mail</p></form><div class="comments"><p>First!</p></div><footer>c</footer><script>if (a < b) { x("</p>") }</script>"""
    assert html_text.main_text(page) == "News é Here is a paragraph of text that is long enough. Short. And <one> more paragraph of text."
    assert [html_text.main_text(x) for x in (None, "", "<p", "<script>x", "plain  text")] == ["", "", "", "", "plain text"]


def test_html_extraction_without_end_tags_and_in_wrappers():
    long = "word " * 25 + "end."
    cases = {
        f"<head><meta charset=x><title>T</title><body class='right-sidebar'><div class='page sidebar-left'><article><p>{long}</p><svg/><p>ab</p><iframe src=x/><p>end</p></article></div>": f"{long} ab end",
        f"<body><p class=ad>advert<p>{long}<p>two</body>": f"{long} two",
        f"<body><ul><li class=ad>advert<ul><li>x</ul><li>{long}<li>two</ul></body>": f"{long} two",
        f"<body><p>{long}</p><div class=ad>buy now</div><p>Short end.</p><div class=comments><article><p>{long}</p></article></div>": f"{long} Short end.",
        f"<form id=all><main><h1>Head</h1><p>{long}</p></main><p>{long}</p></form>": f"Head {long}",
    }
    for page, want in cases.items():
        assert html_text.main_text(page) == want


def test_html_extraction_follows_the_distribution(monkeypatch):
    """Short text far from the surge goes; with sums over single lines, gaps of one line part the text as well."""
    long = "word " * 25 + "end."
    links = "<ul>" + "<li><a href=x>more</a></li>" * 5 + "</ul>"
    page = f"<p>Our shop</p>{links}<h2>Head</h2><p>{long}</p><p><a href=y>a link</a></p><p>Tail.</p>{links}<p>Imprint</p>"
    assert html_text.main_text(page) == f"Head {long} a link Tail."
    assert html_text.main_text(page, window=1) != html_text.main_text(page)
    monkeypatch.setattr(html_text.np, "convolve", lambda w, ones: np.zeros(len(w) + len(ones) - 1, np.int64))
    assert html_text.main_text(page) == ""


def test_html_extraction_of_articles_by_line_lengths_alone():
    """The article elements of the pages made plain: the text stays the same, so lengths and not elements find it."""
    for page in pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html:
        plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(plain) == html_text.main_text(page) != ""


def test_html_extraction_edges(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a</p>", "y"), (1, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("a", 1), ("a", 1)]
    assert html_text.extract_pages(df.limit(0)).count() == 0


# pipeline
def test_pipeline_equals_its_stages_by_hand(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    tox = queries.op5_toxicity(spark, sf).toPandas()
    left = docs[docs.doc_id.isin(tox[tox.predicted == 0].doc_id)]
    groups = brute.exact(list(zip(left.doc_id, left.text)))
    left = left[[groups[d][0] == d for d in left.doc_id]]
    near = brute.near_groups(list(zip(left.doc_id, left.text)), k=5)
    left = left[[near[d][1] == d for d in left.doc_id]]
    bench = pd.read_parquet(f"{sf}/benchmark.parquet")
    hit = brute.contamination(list(zip(left.doc_id, left.text)), list(zip(bench.item_id, bench.text)))
    left = left[[hit[d][1] == 0 for d in left.doc_id]]
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got.doc_id) == set(left.doc_id)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_judge_rows_and_not_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    leak = " ".join(f"leak{i}" for i in range(12))
    rows = [(None, words[0]), (None, words[0]), (None, leak), (7, words[1]), (7, leak + " more"), (8, words[2]), (8, words[2]), (9, words[3] + " x"), (9, words[3]), (None, words[3]), (9, words[4]), (None, None), (None, "")]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.materialise(docs_of(spark, rows), "test")

    def after(stage, docs):
        out = common.materialise(stage(spark, docs, str(tmp_path)), "test")
        return out, sorted(((r.doc_id or 0, r.text or "") for r in out.collect()))

    docs, got = after(corpus_pipeline.drop_copies, docs)
    assert got == sorted([(0, words[0]), (0, leak), (7, words[1]), (7, leak + " more"), (8, words[2]), (9, words[3] + " x"), (9, words[3]), (9, words[4]), (0, "")])
    docs, got = after(corpus_pipeline.drop_near_copies, docs)
    assert [t for _, t in got].count(words[3]) + [t for _, t in got].count(words[3] + " x") == 1
    assert [d for d, t in got if t in (leak, leak + " more")] == [7]
    docs, got = after(corpus_pipeline.drop_contaminated, docs)
    assert [(d, t) for d, t in got if not t.startswith("d0 ")] == sorted([(0, words[0]), (7, words[1]), (8, words[2]), (9, words[4]), (0, "")])
    assert len(got) == 6


def test_arrow_words_of_slices():
    from formline.llm.arrow_words import pieces, split_words

    batch = pa.record_batch([pa.array(["a B", None, "é  x\x0by", "", "Z"])], ["t"])
    got = []
    for part in pieces(batch, 0, 1):
        words, count = split_words(part.column(0))
        got.append((words.dictionary.take(words.indices).to_pylist(), count.tolist()))
    assert [w for ws, _ in got for w in ws] == ["a", "b", "é", "x", "y", "z"]
    assert sum(sum(c) for _, c in got) == 6
