"""Pages with misleading names and broken markup, whitening, joins by several orders and collocations, against plain forms."""

import math
import random
import time
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from formline.llm import collocations, html_text, jaccard_join, queries, whitening

SF = "/root/testdata/sf0.001"
PARAGRAPH = "<p>" + "word " * 60 + "</p>"


# 10
@pytest.mark.parametrize(
    ("piece", "kept"),
    [
        ('<section class="side-effects"><h2>Side effects</h2>' + PARAGRAPH + "</section>", "Side effects"),
        ('<section id="social-impact"><h2>Impact</h2>' + PARAGRAPH + "</section>", "Impact"),
        ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<div class="ad">one</div><div class="ad">two</div><div class="ad">three</div><div class="ad">four</div><p>The End.</p>', "The End."),
        ('<p class="ad">Buy now</p><p>So.</p>', "So."),
    ],
)
def test_article_text_with_misleading_names_stays(piece, kept):
    page = f"<body><nav><a href=x>m</a></nav><article>{PARAGRAPH}{piece}{PARAGRAPH}</article><footer>f</footer></body>"
    text = html_text.main_text(page)
    assert kept in text and not any(x in text for x in ("Buy", "one", "four", " f"))
    assert text.count("word") == 120 + 60 * piece.count("<p>word")


def test_what_is_named_as_an_advert_in_a_compound_goes_by_its_lengths():
    page = lambda x: f"<body><article>{PARAGRAPH}<div class='ad-slot'>{x}</div>{PARAGRAPH}</article></body>"
    assert "Buy" not in html_text.main_text(page("Buy it now."))
    assert "Buy" in html_text.main_text(page("<p>Buy " + "word " * 60 + "</p>"))


def test_a_short_end_without_a_main_element_stays():
    page = f"<body>{PARAGRAPH * 4}" + "<div class='ad'>advert text here</div>" * 4 + "<p>A last paragraph of about forty letters.</p></body>"
    assert html_text.main_text(page).endswith("A last paragraph of about forty letters.") and "advert" not in html_text.main_text(page)


@pytest.mark.parametrize("piece", ["<svg>", "<svg ", "<a x='", "<a \"'", "<!--", "<script>", "<template>", "<head>", "<", "</", "<div>", "<p class='a-b'>", "<aside>", "<button>x"])
def test_a_megabyte_of_broken_markup_takes_a_moment(piece):
    start = time.time()
    html_text.main_text("<p>text</p>" + piece * (1_000_000 // len(piece)))
    assert time.time() - start < 5


# 11
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_whitening_equals_eigenvectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = df.toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.stack([np.asarray(v, float) for v in pdf.embedding])) + 100_000
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    got = queries.op11_whitening(spark, SF).toPandas()
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    exact = {int(i): sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for i, r in zip(pdf.vec_id, x, strict=True)}
    assert all(exact[i] == d for i, d in zip(got.vec_id, got.deviation, strict=True))
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ u[:, :8] / np.sqrt(e[:8])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, e[:8] / e.sum(), rtol=1e-9)


def test_whitening_of_nearly_singular_rows(spark):
    """A condition number of ten million in the rows: the shifted first factor and the passes after it still give the components."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) @ np.diag([1e6, 1e4, 1e2, 1.0, 0.3, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    whole = np.floor(1024 * x)
    y = whole - whole.mean(0)
    want = np.linalg.svd(y, full_matrices=False)[1] ** 2 / 400
    learnt = whitening.fit(df)
    assert np.allclose(learnt.values, want, rtol=1e-6) and whitening.identity_error(df, learnt) < 1e-4


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.5, 3.0], 0), (None, [2.0, 2.0, 9.0], 0), (4, [1.0, nan, 0.0], 0), (5, [1.0, None, 0.0], 0), (6, None, 0), (7, [inf, 0.0, 0.0], 0), (8, [1.0], 0), (9, [], 0), (10, [2.0**60, 0.0, 0.0], 0)]
    got = whitening.whitened(vectors(spark, rows)).orderBy("vec_id", "component").collect()
    assert sorted({(r.vec_id, r.n) for r in got}, key=str) == [(1, 3), (None, 3)] and len(got) == 9
    assert all((r.whitened is None) == (r.component == 3) for r in got) and all(r.identity_error < 1e-12 for r in got)
    one = whitening.whitened(vectors(spark, rows[:1])).collect()
    assert len(one) == 3 and all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in one)
    assert whitening.whitened(vectors(spark, rows[3:7])).count() == 0 and whitening.whitened(vectors(spark, [])).count() == 0


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [(i, [1e12 * i, (-1.0) ** i * 2.0**49, 0.25 * i], 0) for i in range(9)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(vectors(spark, rows)).where("component = 1").collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((9 * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}


# 12
def plain_groups(rows, k, percent):
    """(doc_id, n, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, s in sets.items()}


def groups_of(df, **how):
    return {tuple(r) for r in jaccard_join.jaccard_groups(df, **how).select("doc_id", "n_shingles", "component_id").collect()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90)])
def test_no_link_is_lost_to_the_orders(spark, k, percent):
    """Families of copies at all distances about the threshold, chains among them, and texts that share passages."""
    rng = random.Random(percent)
    word = lambda: f"w{rng.randrange(400)}"
    passage, rows = [word() for _ in range(30)], []
    for _ in range(12):
        text = [word() for _ in range(rng.choice([3, 12, 40, 90]))]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text + (passage if rng.random() < 0.2 else []))))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "one two"), (906, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, tok string, mid string").repartition(5)
    assert groups_of(df, k=k, percent=percent) == plain_groups(rows, k, percent)


def test_members_of_a_bucket_that_miss_its_pivot_still_meet(spark):
    """Texts that share rare words with one another and with a pivot far from them, over all levels."""
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(40)]
        for _ in range(25):
            text = list(base)
            for at in rng.sample(range(40), rng.choice([1, 2, 3, 5])):
                text[at] = f"x{rng.randrange(60)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups_of(df, k=1, percent=90) == plain_groups(rows, 1, 90)


def test_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "x"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, 3, 90).collect()), key=str)
    assert got == sorted([(None, 2, 3), (None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 1, None), (4, 0, 4)], key=str)
    assert jaccard_join.jaccard_groups(df.limit(0), 3, 90).count() == 0


def test_prefixes_of_linked_sets_share_a_kept_token():
    """By numbers alone: heads of two sets at the threshold share more tokens than either leaves out."""
    for percent in (60, 80, 90, 95):
        for n in range(1, 400):
            must = n - jaccard_join.least_shared(n, percent) + 1
            head, keep = must + jaccard_join.spare(n, percent), must + jaccard_join.spare(n, percent) - jaccard_join.spare(jaccard_join.least_shared(n, percent), percent)
            assert 1 <= keep <= head <= n
            for m in range(jaccard_join.least_shared(n, percent), n + 1):
                shared = min(jaccard_join.spare(n, percent), jaccard_join.spare(m, percent)) + 1
                assert head - keep < shared


def test_join_equals_sql(spark):
    assert oracle.compare(queries.op12_jaccard_join(spark, SF), oracle.connect(SF), queries.ORACLE["op12_jaccard_join"]) == ""


# 13
def plain_collocations(rows, longest, least, top, percent):
    import re

    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cands = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in cands.items():
        within = [b for (x, q), b in cands.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in within):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(ranked)


def phrases_of(df, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(8)
    words = ["a", "b", "The", "the", "é", "ü", "x-y", "I", "　z", "10"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(rng.randrange(60)))) for _ in range(120)] + [("en", None), ("en", ""), ("fr", " .,\n"), ("en", "word " * 3000)]


@pytest.mark.parametrize("bits", [64, 6])
def test_phrases_equal_plain_counting(spark, chatter, bits):
    """With six bits most fingerprints collide; counts don't mix."""
    df = spark.createDataFrame([(i, t, x, "c", 1) for i, (x, t) in enumerate(chatter)], "doc_id long, text string, lang string, phrase string, f int").repartition(4)
    for longest, least, top in ((4, 8, 40), (2, 3, 7), (3, 20, 2000)):
        assert phrases_of(df, longest=longest, least=least, top=top, bits=bits) == plain_collocations(chatter, longest, least, top, 80)


def test_phrases_over_many_flushes(spark, chatter, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "PIECE_BYTES", 200)
    df = spark.createDataFrame([(None, t, x) for x, t in chatter], "doc_id long, text string, lang string").coalesce(1)
    assert phrases_of(df, least=8) == plain_collocations(chatter, 4, 8, 2000, 80)


def test_phrase_edges(spark):
    df = spark.createDataFrame([(1, "a b", "en")] * 40 + [(None, "a b", None)] * 35, "doc_id long, text string, lang string")
    assert phrases_of(df) == [("en", 1, "a b", 40, 40, 40, 80, 1_000_000), ("und", 1, "a b", 35, 35, 35, 70, 1_000_000)]
    assert phrases_of(df.limit(0)) == [] and phrases_of(df.limit(3)) == []


def test_fingerprints_by_prefix_sums_are_polynomials():
    import pyarrow as pa
    import xxhash

    words, doc, left = collocations.piece_words(pa.array(["To be, or NOT to be", None, "to be"]))
    assert words.to_pylist() == ["to", "be", "or", "not", "to", "be", "to", "be"] and left.tolist() == [2, 1, 4, 3, 2, 1, 2, 1] and doc.tolist() == [0] * 6 + [2, 2]
    poly = collocations.Polynomials(words, doc, left, np.zeros(3, np.uint64), 64)
    whole = sum(int.from_bytes(xxhash.xxh3_128_digest(w)[:8], "little") * collocations.BASES[0] ** j for j, w in enumerate((b"to", b"be"))) % 2**64
    got = (poly.sums[0][[2, 6, 8]] - poly.sums[0][[0, 4, 6]]) * poly.powers[1][0][[0, 4, 6]]
    assert got.tolist() == [whole] * 3 and len(set(poly.prints(np.array([0, 4, 6]), 2)[0].tolist())) == 1


def test_phrases_equal_sql(spark):
    assert oracle.compare(queries.op13_collocations(spark, "/root/testdata/sf0.01"), oracle.connect("/root/testdata/sf0.01"), queries.ORACLE["op13_collocations"]) == ""


def test_totals_beyond_64_bits_divide_exactly(spark):
    big = 6_000_000_000_000_000
    rows = [("en", "a", ["a"], big + 1), ("en", "b", ["b"], big + 2), ("en", "a b", ["a", "b"], big)]
    got = collocations.ranked(spark.createDataFrame(rows, "lang string, phrase string, words array<string>, f long"), spark.createDataFrame([("en", 9)], "lang string, n long"), 10, 80)
    assert got.first().score == 2_000_000 * big // (2 * big + 3)
    assert got.select(F.count("*")).first()[0] == 1


# 6
def test_posteriors_equal_plain_fusion(spark):
    """Evidence of every row fused in numpy, from the same text likelihoods."""
    import re

    from formline.llm import language

    docs, pages = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "pages"))
    langs, table = language.text_model(docs)
    page = spark.createDataFrame(pages.select(F.lit("page").alias("kind"), "page_id", F.col("html").alias("text")).collect(), "kind string, page_id long, text string")
    text = {("p", r.page_id): (np.array(r.ll), r.text_lang) for r in language.text_evidence(page, langs, table).collect()}
    text |= {("d", r.doc_id): (np.array(r.ll), r.text_lang) for r in language.text_evidence(docs.select(F.lit("document").alias("kind"), "doc_id", "text"), langs, table).collect()}
    facts = {("d", r.doc_id): {"host": None if r.source is None else f"source:{r.source}"} for r in docs.collect()}
    for r in pages.collect():
        after = r.url.split("://", 1)[1] if "://" in r.url else ""
        host, path = re.split("[/?#]", after, maxsplit=1)[0].lower(), re.sub("[?#].*", "", after[len(re.split("[/?#]", after, maxsplit=1)[0]) :])
        first, last, said = re.match(r"/([A-Za-z]{2})(?:/|$)", path), re.search(r"\.([a-z]{2})$", host), re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", r.html)
        facts["p", r.page_id] = {"host": host or None, "domain": re.search(r"([^.]*\.?[^.]*)$", host)[1] or None, "code": (first or last)[1].lower() if first or last else None, "declared": said[1].lower() if said else None}
    one = lambda lang: np.array([float(lang == x) for x in langs])
    counts: dict = {}
    for k, f in facts.items():
        for key, v in f.items():
            if v is not None and text[k][1] is not None:
                counts[key, v] = counts.get((key, v), 0) + one(text[k][1])
    whole = sum(one(text[k][1]) for k in facts)
    base = (whole + 1) / (whole + 1).sum()
    for r in language.identify(docs, pages).collect():
        k = ("p", r.page_id) if r.doc_id is None else ("d", r.doc_id)
        ll, told = text[k]
        n = {key: counts[key, facts[k][key]] - one(told) if facts[k].get(key) is not None and (key, facts[k][key]) in counts else np.zeros(len(langs)) for key in ("host", "domain", "declared", "code")}
        domain = (n["domain"] + language.DOMAIN_PULL * base) / (n["domain"].sum() + language.DOMAIN_PULL)
        log = ll + np.log((n["host"] + language.HOST_PULL * domain) / (n["host"].sum() + language.HOST_PULL))
        for key in ("declared", "code"):
            if facts[k].get(key) is not None:
                log = log + np.log((n[key] + 1) / (whole + 2))
        p = np.exp(log - log.max())
        assert r.lang == langs[int(log.argmax())] and abs(r.probability - 1 / p.sum()) < 1e-9


def test_two_hundred_languages_plan_like_four(spark):
    from formline.llm import language

    def plan(n):
        langs = [f"l{i:03}" for i in range(n)]
        zeros = F.array_repeat(F.lit(1.0), n)
        rows = spark.range(20).select(F.lit("l001").alias("text_lang"), zeros.alias("ll"), F.lit("x").alias("declared"), F.lit(None).cast("string").alias("code"), *(zeros.alias(f"n_{k}") for k in ("host", "domain", "declared", "code")))
        start = time.time()
        got = language.posterior(rows, langs, np.ones(n)).select("logs").collect()
        assert len(got) == 20 and len(got[0].logs) == n
        return time.time() - start

    plan(4)
    assert plan(200) < 5 * plan(4) + 2


# 9
def test_index_lies_in_the_shared_folder_and_goes_with_the_call(spark, monkeypatch):
    import os

    from formline.llm import common, exact_dedup

    folder = common.shared_dir(spark).removeprefix("file://")
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string")
    tables = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]
    left = lambda: [x for x in os.listdir(folder) if x.startswith("digest_index")]
    before = (tables(), left())
    assert exact_dedup.exact_groups(df).where("kept").count() == 7 and (tables(), left()) == before
    index = exact_dedup.DigestIndex(spark, "digest_index_here")
    index.add(df.select("doc_id", F.col("text").alias("digest")))
    assert "digest_index_here" in left()
    index.drop()
    assert (tables(), left()) == before
    monkeypatch.setattr(exact_dedup.DigestIndex, "totals", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exact_dedup.exact_groups(df)
    assert (tables(), left()) == before
