"""Very long texts, hot keys, clashing columns and whole tables that the first test module leaves out."""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm import SF, docs_of

from formline.llm import common, decontaminate, exact_dedup, html_text, language, minhash, mixing, queries, repeats, tokens, toxicity, url_filter

ONE = "x" * 1_500_000  # no white space at all
WORDS = " ".join(f"w{i % 5000}" for i in range(200_000))


@pytest.fixture(scope="module")
def long_docs(spark):
    return common.materialise(docs_of(spark, [(1, ONE), (2, WORDS), (3, WORDS + " end"), (4, "short")]), "long")


def test_long_texts_are_judged_whole(spark, long_docs):
    bench = spark.createDataFrame([(1, WORDS[-60:]), (2, "absent words")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(long_docs, bench).collect()}
    assert [got[i].n_words for i in (1, 2, 3, 4)] == [1, 200_000, 200_001, 1]
    assert got[2].contaminated and got[3].contaminated and not got[1].contaminated
    near = {r.doc_id: r for r in minhash.near_duplicates(long_docs).collect()}
    assert [near[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 2, 4]
    assert {r.doc_id: r["size"] for r in mixing.fair_queue(long_docs).collect()} == {1: 1, 2: 200_000, 3: 200_001, 4: 1}
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_groups(long_docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    gone = {r.doc_id: r.n_removed for r in repeats.remove_repeats(long_docs, keep_first=False).collect()}
    assert (gone[1], gone[2], gone[4]) == (len(ONE), len(WORDS), 0)
    scored = toxicity.score_toxicity(long_docs, toxicity.Network(), ["doc_id"]).collect()
    assert len(scored) == 4


def test_long_texts_have_the_librarys_tokens(spark, long_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {i: len(t.encode(s, add_special_tokens=False).ids) for i, s in ((1, ONE), (2, WORDS), (4, "short"))}
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(long_docs, path).collect()}
    assert {i: got[i] for i in want} == want


def test_a_long_page_is_extracted_whole(spark):
    page = "<html><body><nav><a href=1>a</a></nav>" + "".join(f"<p>{WORDS[i * 1000 : i * 1000 + 900]}</p>" for i in range(900)) + "<footer>f</footer></body></html>"
    want = " ".join(" ".join(WORDS[i * 1000 : i * 1000 + 900].split()) for i in range(900))
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_text.extract_pages(df).first().text == want
    docs = spark.createDataFrame([(1, WORDS[:1000], "en", "a", "z", 1.0), (2, "der und die", "de", "b", "z", 2.0)], "doc_id long, text string, lang string, source string, host string, ll double")
    got = language.identify(docs, df.withColumn("lang", F.lit("zz")).withColumn("rows", F.lit(1)).withColumn("domain", F.lit("q"))).collect()
    assert sorted((r.doc_id or 0, r.lang) for r in got)[1:] == [(1, "en"), (2, "de")]


# hot keys
def test_a_hot_key_is_joined_whole(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    rows = rows.unionByName(spark.range(5).select("id", F.lit(None).cast("long").alias("k")))
    groups = rows.where("k is not null and k < 2900").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    inner = common.join_groups(rows, groups, "k", "n")
    assert (inner.count(), inner.where("k = 0 and n = 2000").count()) == (2900, 2000)
    for limit in (0, 10**6):
        monkeypatch.setattr(common, "SMALL_ROWS", limit)
        got = common.look_up(rows, groups, "k", "n")
        assert (got.count(), got.where("n is null").count()) == (3005, 105)


def test_running_totals_in_two_levels(spark):
    rng = np.random.default_rng(0)
    rows = [(None if k == 2 else f"k{k}", int(c), int(v)) for k in range(3) for c, v in zip(rng.choice(5000, 300, replace=False), rng.integers(0, 50, 300))]
    got = common.running_totals(spark.createDataFrame(rows, "key string, cell long, v long"), ["key"], "cell", "v", step=64).toPandas()
    want = pd.DataFrame(rows, columns=["key", "cell", "v"]).sort_values("cell")
    want["ahead"] = want.groupby("key", dropna=False).v.cumsum() - want.v
    both = got.fillna({"key": "-"}).merge(want.fillna({"key": "-"}), on=["key", "cell"])
    assert len(both) == 900
    assert (both.ahead_x == both.ahead_y).all()


def test_components_of_a_star_by_either_join(spark, monkeypatch):
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 560)] + [(None, 3)], "a long, b long")
    for limit in (0, 10**6):
        monkeypatch.setattr(common, "SMALL_ROWS", limit)
        got = {r.node: r.component for r in common.components(edges).collect()}
        assert got == {i: 0 for i in range(1, 400)} | {i: 500 for i in range(501, 561)}


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


# 2
def test_near_groups_of_a_larger_table_match_brute_force(spark):
    """Recall at the tables' own mix of copies: every link of 1,000 documents is found."""
    import brute

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.near_groups(list(zip(docs.doc_id, docs.text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_minhash_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


# 4
def test_url_rules_on_the_whole_table(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in queries.op4_url_filter(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for p in pages.itertuples():
        m = re.search(r"://([^/?#]*)([^?#]*)", p.url or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = max(((len(h + q), h + q, v) for h, q, v in rules if (host == h or host.endswith("." + h)) and path.startswith(q)), default=None)
        assert (got[p.page_id].host, got[p.page_id].path, got[p.page_id].rule) == (host, path, fit and fit[1])
        assert got[p.page_id].verdict == fit[2] if fit else got[p.page_id].verdict in ("allow", "block")


def test_the_trees_learn_what_rules_share(spark):
    """Hosts of a suffix whose ruled URLs are all blocked are blocked without a rule, those of one allowed are allowed."""
    rules = (url_filter.Rule("block", "bad.com", "/x/"), url_filter.Rule("allow", "good.org", "/x/"))
    urls = [f"http://h{i}.bad.com/x/{i}?a={i}&b=2" for i in range(200)] + [f"https://h{i}.good.org/x/page" for i in range(200)]
    more = [f"http://k{i}.bad.com/y/{i}?a={i}&b=2" for i in range(20)] + [f"https://k{i}.good.org/y/page" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(urls + more)), "page_id long, url string").withColumn("seen", F.lit(1)).withColumn("label", F.lit(0.5))
    got = {r.page_id: r for r in url_filter.judge_urls(df, rules=rules).collect()}
    assert all(got[400 + i].rule is None for i in range(40))
    assert [got[400 + i].verdict for i in range(40)] == ["block"] * 20 + ["allow"] * 20


# 5
def test_languages_are_told_by_words_learnt(spark):
    rng = np.random.default_rng(1)
    words = {x: [f"{x}{i}" for i in range(30)] for x in ("aa", "bb")}
    import pyarrow as pa

    texts = [" ".join(rng.choice(words[x], 40)) + " common word" for x in ("aa", "bb") for _ in range(30)] + ["other text here", ""]
    langs = np.array(["aa"] * 30 + ["bb"] * 30 + ["", ""], object)
    _, h, count = toxicity.word_rows(pa.array(texts), 1 << 20)
    told = toxicity.telling_words(h, count, langs)
    assert set(told) == {"aa", "bb"}
    assert toxicity.guess_language(h, count, told).tolist() == langs.tolist()
    net = toxicity.Network()
    net.told = told
    again = toxicity.Network.load(net.dump()).told
    assert all((again[x] == told[x]).all() for x in told)


def test_labels_without_a_document_do_not_shrink_the_sample(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i}" + (" vile" if i % 2 else ""), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(10_000 + i, 0) for i in range(5000)], "doc_id long, toxic int")
    got = toxicity.judge_toxicity(docs, labels, train_rows=120).where("held_out").collect()
    assert [r.predicted for r in got] == [r.doc_id % 2 for r in got]


# 9
def test_later_batches_count(spark):
    docs = docs_of(spark, [(5, "a b"), (6, "c"), (7, "a  b")])
    spark.sql("DROP TABLE IF EXISTS lasting")
    try:
        first = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, table="lasting", batches=3).collect()}
        assert first == {5: (5, 2), 6: (6, 1), 7: (5, 2)}
        later = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs_of(spark, [(1, "a b"), (9, "d")]), table="lasting").collect()}
        assert later == {1: (1, 3), 9: (9, 1)}
        assert {(r.keep_id, r.group_size) for r in exact_dedup.DigestIndex(spark, "lasting").totals().collect()} == {(1, 3), (6, 1), (9, 1)}
    finally:
        exact_dedup.DigestIndex(spark, "lasting").drop()
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_groups(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_known_digests_are_told_by_a_sort_merge_anti_join(spark):
    index = exact_dedup.DigestIndex(spark, "planned", 4)
    try:
        index.add(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, digest string"))
        known = index.read().select("digest").hint("merge")
        plan = spark.createDataFrame([("a",), ("c",)], "digest string").join(known, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin.*LeftAnti", plan)
        assert "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning") == 1  # the batch alone moves
    finally:
        index.drop()


# 7
def test_the_cut_off_is_found_in_narrow_ranges(spark, monkeypatch):
    """With few cells and rows a range, so that ranges are narrowed several times, the mix is the same."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 17), "abc"[i % 7 % 3]) for i in range(1500)], "doc_id long, text string, source string")
    want = {r.doc_id: r.taken for r in mixing.fair_queue(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    monkeypatch.setattr(mixing, "CELLS", 4)
    assert {r.doc_id: r.taken for r in mixing.fair_queue(docs).collect()} == want
    assert sum(want.values()) > 0


# 10
def test_whole_pages_equal_plain_parsing(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for p in pages.itertuples():
        body = re.sub(r"(?s)<nav>.*?</nav>|<footer>.*?</footer>|<head>.*?</head>|<!--.*?-->|<div class=\"ad\">.*?</div>|<script.*?</script>", " ", p.html)
        assert got[p.page_id] == " ".join(markup.unescape(re.sub(r"<[^>]*>", " ", body)).split())
