"""The operators against plain versions, on inputs with nulls, ties, repeats, empty and long texts, and odd columns."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, exact_dedup, language_model, packing, pages, quality, simhash, substrings, urls, warc
from tidemark.llm.components import components
from tidemark.llm.queries import ORACLES

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _corpus() -> dict:
    dice = random.Random(3)
    words = ["".join(dice.choice("abcdeé") for _ in range(dice.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(dice.choice(words) for _ in range(n))
    shared, line = prose(40), prose(14)
    docs = {0: None, 1: "", 2: "Short.", 3: shared, 4: prose(90) + " " + shared, 5: shared + " " + prose(9), 6: shared, 7: "aé" * 700, 8: "aé" * 300}
    docs |= {9: prose(5000), 10: "It's <|endoftext|> NOW!!!   x\ty\x1fz, é, İstanbul ΣΣ a..b"}
    docs |= {20 + i: f"{prose(3)} {i} {line} {prose(3)}" for i in range(90)}
    return docs


DOCS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "x", True, 1, 2.0) for i, t in DOCS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, KEPT string, kept_ boolean, _key int, score double").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def _by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


CUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [(64, 5_000), (2, 3), (2, 5_000)])
def test_repeated_substrings(docs, nothing, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_IN_CHUNK", hot[0])
    monkeypatch.setattr(substrings, "HOT_IN_BUCKET", hot[1])
    monkeypatch.setattr(substrings, "BUCKET_NAMES", 500)
    found = substrings.cut_repeats(docs)
    want = brute.repeated_bytes(DOCS)
    assert _by_id(found, *CUT) == want
    assert want[6][1] == want[6][0] and want[1] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert substrings.cut_repeats(nothing).count() == 0


def test_missing_and_repeated_ids_are_not_cut_against_each_other(spark):
    rows = [(None, DOCS[3]), (None, DOCS[3]), (1, DOCS[3]), (1, DOCS[3])]
    found = substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in found) == [(False, False)] * 2 + [(True, True)] * 2


def test_packing(docs, nothing):
    assert brute.check_packing(DOCS, [r.asDict() for r in packing.pack_documents(docs, TOKENIZER).collect()]) == 0
    assert brute.check_packing(DOCS, [r.asDict() for r in packing.pack_documents(docs, TOKENIZER, 64).collect()], 64) == 0
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0
    one = [r.asDict() for r in packing.pack_documents(docs.coalesce(1), TOKENIZER, 256).collect()]
    assert brute.check_packing(DOCS, one, 256) == 0
    # Uncut, a document of n tokens takes n / 256 pieces, rounded up; beyond that a bin cuts one document at most.
    uncut = sum({r["doc_id"]: -(-r["doc_tokens"] // 256) for r in one}.values())
    assert len(one) <= uncut + len({r["sequence_id"] for r in one})
    with pytest.raises(ValueError):
        packing.pack_documents(docs, TOKENIZER, 100)


def test_a_bin_holds_the_number_of_its_class():
    ids = lambda n: bytes(4 * n)
    bins = packing.Bins(0, 64)
    for i, n in enumerate([20, 21, 17, 19, 64, 32, 32]):
        bins.add((i, 0, ids(n), n))
    # Three of class 3 leave six tokens, which the next of the class gives; its rest is of class 4.
    assert [(p[0], p[2], p[5], p[6]) for p in bins.done] == [
        (0, 20, 0, 0), (1, 21, 0, 20), (2, 17, 0, 41), (3, 6, 0, 58), (4, 64, 1, 0), (5, 32, 2, 0), (6, 32, 2, 32),
    ]
    bins.rest()
    assert [p[:3] + p[5:] for p in bins.done[7:]] == [(3, 6, 8, 3, 0), (3, 14, 4, 4, 0), (3, 18, 1, 5, 0)]


#: Special tokens in any case, the mark between words, capitals that become two characters, composed and lone marks.
ODD_TEXTS = [
    "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "a|b | || A|B|", "\u0130. s\u0130... \u0130", "don't I'LL 'S x'",
    "\u03a3\u0391\u03a3 \u1e9e \u212a \ufb01", "\u0301x A\u0301 =\u0338 e\u0301.", "\x1c\x85\u3000 12ab ab12 \u2460", "plain words, only. Plain Words!",
]


def test_packing_with_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "MAX_PARTS", 5)
    monkeypatch.setattr(packing, "MAX_WORDS", 5)
    encode, coder = packing.encoder(TOKENIZER), brute.tokenizer()
    for text in [*DOCS.values(), *ODD_TEXTS]:
        want = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(next(encode([text or ""])), "<u4").tolist() == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, docs, nothing, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_DOCS", 0)
    items = [(1, DOCS[3].upper()), (2, DOCS[3]), (3, "now"), (4, None), (5, "..."), (10, "A..B"), (None, "zzz"), (2, DOCS[3])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = decontaminate.hits(docs, benchmark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", benchmark.where("item_id is not null").dropDuplicates().toPandas())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op3_decontamination']})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want)
    left = decontaminate.remove_contaminated(docs, benchmark)
    assert left.columns == [c for c in docs.columns if c != "_key"] or left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in want if not r[5]}
    assert decontaminate.hits(nothing, benchmark).count() == 0
    assert decontaminate.hits(docs, benchmark.where("false")).where("n_hit > 0").count() == 0


def test_exact_copies(spark, docs, nothing):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op4_exact_dedup']})").fetchall()
    assert sorted(map(tuple, exact_dedup.repeats(docs).select(*columns).collect())) == sorted(want)
    kept = exact_dedup.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[3]}
    assert exact_dedup.repeats(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in exact_dedup.repeats(rows).collect()) == [(0, 2, True), (0, 3, False), (1, 3, True)]
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep_one(rows).collect()) == [(0, "b"), (1, "a")]


def test_near_copies(docs, nothing):
    want = brute.linked(DOCS)
    assert _by_id(simhash.near_duplicates(docs), "fingerprint", "component_id") == want
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {i for i, (_, c) in want.items() if c == i}
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_anchors_lose_no_pair(monkeypatch):
    dice = np.random.default_rng(5)
    base = dice.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base.copy()
    for _ in range(2):
        near ^= np.uint64(1) << dice.integers(0, 64, 400, dtype=np.uint64)
    (a, x), (b, y) = simhash.anchors(base), simhash.anchors(near)
    for p, q in zip(base, near, strict=True):
        assert set(a[x == p].tolist()) & set(b[y == q].tolist())
    group = np.unique(np.concatenate([base, near]))
    plain = {tuple(sorted(p)) for p in zip(*simhash._near(group), strict=True)}
    monkeypatch.setattr(simhash, "DENSE", 10)
    assert {tuple(sorted(p)) for p in zip(*simhash._near(group), strict=True)} == plain


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (5, 5), (None, 3), (100, 200)]
    found = components(spark.createDataFrame(chain, "a long, b long"))
    want = {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}
    assert {r.node: r.root for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_verdicts(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.org/x", link.format("https://b.example.net/es/1")),
        (2, "HTTP://B.Example.net/es/1/?utm_source=a#f", None),
        (3, "http://c.org/p", '<meta http-equiv="refresh" content="0; url=/q">'),
        (4, "http://c.org/q", link.format("http://a.example.org/x.html")),
        (5, "http://d.org/", link.format("http://www.example.com/en/z")),
        (6, "http://www.example.com/en/z", ""), (7, None, None), (8, "nonsense", link.format("http://net/es/")), (9, "http://net", ""),
        (10, "http://example.com/en/", ""), (10, "http://example.com/en/", ""),
    ]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1)).drop("rule"))
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in found.collect() if r.rule) + sorted((r.page_id, r.verdict) for r in found.collect() if not r.rule)
    assert got == [
        (2, "b.example.net", "net/es/", "block"), (6, "www.example.com", "www.example.com/en/", "allow"),
        (10, "example.com", "example.com/en/", "block"), (10, "example.com", "example.com/en/", "block"),
        (1, "block"), (3, "block"), (4, "block"), (5, "allow"), (7, "allow"), (8, "allow"), (9, "allow"),
    ]


BLOCKED = "http://b.example.net/es/1"


#: (url, html, verdict); "a.org" is another host in each.
LINKING = [
    ("http://a.org/x", f"<META content=\"0; url='{BLOCKED}'\" http-equiv=Refresh>", "block"),
    ("http://a.org/x", f"<meta http-equiv='refresh' content='5;URL=\"{BLOCKED}\"'>", "block"),
    ("http://a.org/x", f"<meta http-equiv=refresh content='0, {BLOCKED}'>", "block"),
    ("http://a.org/x", f"<!-- <link rel=canonical href={BLOCKED}> -->", "allow"),
    ("http://a.org/x", f"<!-- never closed <link rel=canonical href={BLOCKED}>", "allow"),
    ("http://a.org/x", f"<script>'<link rel=canonical href={BLOCKED}>'</script>", "allow"),
    ("http://a.org/x", f"<link rel=next href=/y><link rel='shortlink CANONICAL' title='a > b href=/z' href={BLOCKED}>", "block"),
    ("http://a.org/x", f"<link rel=canonical href=/y><link rel=canonical href={BLOCKED}>", "block"),
    ("http://a.org/x", f"<link rel=alternate href={BLOCKED}><a rel=canonical href={BLOCKED}>", "allow"),
    ("http://a.org/x", "<link rel=canonical href=mailto:b.example.net/es/1><link rel=canonical><link rel=canonical href=''>", "allow"),
    ("http://a.org/x?next=http://b.net/es/", "<link rel=canonical href='/login?next=http://b.net/es/'>", "allow"),
    ("http://b.example.net/de/x/y", "<link rel=canonical href='../../es/1'>", "block"),
    ("http://b.example.net/de/x/y", "<link rel=canonical href='/a/./../../es/1/.'>", "block"),
    ("http://a.org/x", "<link rel=canonical href='//b.example.net/a/../es/1'>", "block"),
    ("http://a.org/x", "<link rel=canonical href='&#104;ttp&#x3a;//b.example.net/es/&#49;?a=1&amp;b=2'>", "block"),
    ("http://a.org/x?p=1&b=2", "<link rel=canonical href='?p=2&amp;b=2'>", "block"),
    ("http://a.org/x", "<link rel=canonical href='?p=2&b=2'>", "block"),
    ("http://a.org/x", "<link rel=canonical href='&#9999999;&bogus;&#xd800;'>", "allow"),
    ("http://a.org/x", "<link rel=canonical " + "x" * 300_000 + "='" + "y" * 300_000 + f"' href={BLOCKED}>" + "<p>z" * 100_000, "block"),
    ("http://a.org/x", "", "allow"), (None, f"<link rel=canonical href={BLOCKED}>", "allow"),
]


def test_links_between_pages(spark):
    rows = [(-1, BLOCKED, None), (-2, "http://b.example.net/es/1?a=1&b=2", None)]
    for i, (url, html, _) in enumerate(LINKING):
        url = url and url.replace("a.org", f"a{i}.org").replace("/de/", f"/de{i}/")
        rows += [(i, url, html), (-3, f"http://a{i}.org/x?p=2&b=2", f"<link rel=canonical href={BLOCKED}>")]
    table = spark.createDataFrame([(*r, "r", "h", "v") for r in rows], "page_id long, url string, html string, Rule string, host string, verdict string")
    found = urls.judge(table)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    verdicts = {r.page_id: r.verdict for r in found.collect()}
    assert [verdicts[i] for i in range(len(LINKING))] == [v for _, _, v in LINKING]
    assert urls.judge(table.where("false")).count() == 0


def test_revisits(spark):
    h = {"date": "1", "content-length": "9"}
    rows = [
        (1, "response", "http://a/x", 10, "e1", None, h, "one"), (2, "response", "https://A/x/", 20, "e2", None, {}, "two"),
        (3, "revisit", "http://a/x?q#f", 20, "e1", None, {"date": "7", "content-length": "0"}, None), (4, "revisit", "http://a/x", 9_999_999, "e2", None, None, None),
        (5, "revisit", "http://a/x", 30, "e9", None, {}, None), (6, "revisit", "http://a/x", 5, "e1", None, {}, None), (7, "revisit", None, 50, None, None, {}, None),
        (8, "response", "http://a/x", 20, "e3", 5, {}, "three"), (9, "revisit", "http://a/x", 21, None, 5, {}, None), (9, "revisit", "http://a/x", 21, None, 5, {}, None),
    ]
    schema = "record_id long, kind string, url string, date long, etag string, modified long, headers map<string,string>, payload string"
    found = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r.status, r.response_id, r.payload) for i, r in found.items() if r.kind == "revisit"} == {
        3: ("resolved", 1, "one"), 4: ("stale", 8, None), 5: ("stale", 8, None), 6: ("missing", None, None), 7: ("missing", None, None), 9: ("resolved", 8, "three"),
    }
    assert found[3].headers == {"date": "7", "content-length": "9"}


def test_main_text(spark):
    page = (
        "<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body class=x><nav><ul><li>menu</ul></nav>"
        "<div class='ad'>buy</div><!-- <p>gone --><article><h1>Head &amp; more</h1><p><b>First\n  line<br>two<p>Third &#233;<div class='comments'><p>me too</div>"
        "<form><p>mail</form><p>Last</article><aside><p>side</aside><footer>&copy;</footer>"
    )
    assert pages.main_text(page) == "Head & more\n\nFirst line two\n\nThird é\n\nLast"
    assert pages.main_text(None) == "" and pages.main_text("<p>a < b</p> tail &lt;") == "a < b\n\ntail <"
    rows = [(i, f"http://h/{i}", f"<div class=k>all the same</div><div class=body><p>text {i}</div>") for i in range(12)] + [(20, None, None), (21, "http://other/", page)]
    found = {r.page_id: (r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == ("text 3", 6) and found[20] == ("", 0) and found[21][0].endswith("Last")
    few = pages.extract(spark.createDataFrame(rows[:3], "page_id long, url string, html string")).collect()
    assert few[0].text == "all the same\n\ntext 0"


def test_main_text_of_a_host_full_of_copies(spark):
    page = "<div class=body><p>{}</div><div class=k>{}</div>"
    copies = [(i, f"http://h/{i}", page.format("one text", "a notice")) for i in range(80)]
    near = [(100 + i, f"http://h/{i}", page.format("another text", f"seen {i}")) for i in range(80)]
    unlike = [(200 + i, f"http://h/{i}", page.format(f"text {i}", "a notice")) for i in range(20)]
    find = lambda rows: {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    found = find(copies + unlike)
    assert found[0] == "one text" and found[203] == "text 3"
    assert find(copies)[0] == "one text\n\na notice"
    assert find(near + unlike)[203].startswith("text 3")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>A<div class=social-history><p>B</div><div class='search-and-rescue'><p>C</div><section id=related-work><p>D</section></article>", "A B C D"),
        ("<article><p>A<div class=social-links>x</div><div class=commentsArea><p>y</div><p id=ad-3>z</p><div class='skip-link'>w</div></article>", "A"),
        ("<article><div class=entry-header><h1>A</h1></div><div class=post-header><p>B</div></article><div class=header>x</div>", "A B"),
        ("<nav><ul><li>menu<article><p>A</p></article>", "A"),
        ("<form><main><p>A</main></form>", "A"),
        ("<article><p>A</article><section class=discussion><article><p>me</article></section>", "A"),
        ("<article><p>A<section class=discussion><p>B</section></article>", "A B"),
        ("<article><h1>A</h1><p>B<article><p>me</article></article>", "A B"),
        ("<article><h1>A</h1><article><p>B</article></article>", "A B"),
        ("<main><p>A<article class='comment odd'><p>me</article></main>", "A"),
        ("<div hidden><article><p>x</article></div><p>A", "A"),
        ("<div>" * 50_000 + "A", "A"),
        ("<p>A" * 50_000, " ".join("A" * 50_000)),
        ("<p>" + "A&amp;" * 300_000, "A&" * 300_000),
        ("", ""),
    ],
)
def test_what_is_main_text(page, text):
    assert pages.main_text(page).replace("\n\n", " ") == text


def _site(dice):
    """Twelve pages whose menu has other links on each page, and a list of facts of a fixed form."""
    for i in range(12):
        menu = "".join(f"<li><a href=/{dice.random()}>go {dice.random()}</a>" for _ in range(5))
        facts = "".join(f"<li>fact {dice.random()}, see <a href=/>here</a>" for _ in range(5))
        yield i, f"http://h/{i}", f"<div class=x1><ul class=l>{menu}</ul></div><div class=x2>same<p>said {i}</p><ul>{facts}</ul></div><nav>menu {i}</nav>"


def test_style_tree(spark):
    rows = [*_site(random.Random(1)), (50, None, "<p>alone"), (51, "http://h/", None)]
    rows += [(100 + i, url, page) for i, url, page in rows[:5]]  # copies
    table = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "page_id long, url string, html string, CUT string, Importance double")
    read = {(url and "h" or "", page): pages.Page(page or "").branches() for _, url, page in rows}
    want = brute.style_tree([(host, [(p, *r[:5]) for p, r in found.items()]) for (host, _), found in read.items()])
    tree = pages.style_tree(table).collect()
    found = {(r.host, r.path): (r.pages, r.importance) for r in tree}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    assert any(r.named for r in tree) and all(r.n <= r.pages for r in tree)
    texts = {r.page_id: r.text for r in pages.extract(table).collect()}
    assert len(texts) == len(rows) and texts[50] == "alone" and texts[51] == ""
    assert all("go" not in texts[i] and "menu" not in texts[i] and "same" not in texts[i] for i in range(12))
    assert all(texts[i].startswith(f"said {i}") and texts[i].count("fact") == 5 for i in range(12))
    alone = pages.extract(table.where("page_id = 3")).first().text
    assert "go" in alone and "same" in alone and "menu" not in alone
    assert pages.extract(table.where("false")).count() == 0 and pages.style_tree(table.where("false")).count() == 0


def test_quality(spark, docs, nothing):
    good = [(1000 + i, " ".join(f"w{(i * 7 + k * k) % 50}x" for k in range(60)), 1) for i in range(60)]
    bad = [(2000 + i, "BUY NOW!!! " * 30, 0) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (1000, None)], "doc_id long, quality int"))
    found = quality.quality(table, labels).join(table.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.predicted == r.quality and 0 <= r.score <= 1 for r in found) and any(r.held_out for r in found)
    assert quality.keep_good(table, labels).count() == 60
    ranking = quality.learn(table, labels)
    repeated = quality.learn(table.unionByName(table).repartition(5), labels)
    assert (ranking.weights == repeated.weights).all() and ranking.cut == repeated.cut
    first = quality.learn(table.unionByName(table.withColumn("text", F.lit("other"))), labels, 10)
    assert first.weights.shape == ranking.weights.shape
    unlabelled = quality.quality(docs, labels.where("false")).collect()
    assert len(unlabelled) == len(DOCS) and {(r.score, r.predicted) for r in unlabelled} == {(0.5, 1)}
    assert quality.quality(nothing, labels).count() == 0


def test_language_model(docs, nothing):
    import math
    import re
    import zlib
    from collections import Counter

    found = {r.doc_id: r for r in language_model.score(docs).collect()}
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(brute.ASCII_LOWER)) if w] + [None] for i, t in DOCS.items()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert math.isfinite(r.score) and r.score < 0
    assert language_model.score(nothing).count() == 0


def test_gradients_and_probabilities():
    dice = np.random.default_rng(1)
    network = language_model.Network.fresh(dice.integers(1, 50, language_model.HEAD + 1).astype(float))
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    h = dice.standard_normal((1, language_model.HIDDEN))
    each = [np.exp(network.output(h, np.array([y]))[0][0]) for y in range(language_model.HEAD + 1)]
    assert sum(each) == pytest.approx(1.0)
    docs = [dice.integers(0, language_model.HEAD + 1, n) for n in (70, 9, 1, 200)]
    whole = language_model.log_likelihoods(network, docs)
    alone = [language_model.log_likelihoods(network, [d])[0] for d in docs]
    assert whole == pytest.approx(alone, rel=1e-4)


def test_every_training_document_teaches_the_network_once(spark):
    import zlib

    ids = np.array([*range(300), language_model.C.MISSING], np.int64)
    taken = sum(language_model._in_round(ids, turn).astype(int) for turn in range(language_model.ROUNDS))
    assert taken.tolist() == [int(i == language_model.C.MISSING or zlib.crc32(str(i).encode()) % 5 != 1) for i in ids.tolist()]
    only = spark.createDataFrame([(4, "this or that " * 2000)], "doc_id long, text string")
    learned = language_model.score(only).first()
    assert not learned.held_out and learned.score > 0.5 * learned.base_score  # start weights score about as the base


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SMALL)
        assert kept.columns == documents.columns
        rows = {r.doc_id: r.text for r in kept.collect()}
        had = {r.doc_id: r.text for r in before.collect()}
        assert rows and set(rows) <= set(had)
        if stage is corpus_pipeline.good_quality:
            known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            fitted = [i for i in sorted(had) if known.get(i) is not None and zlib.crc32(str(i).encode()) % 3 != 1]
            ranking = quality.fit(np.array([quality.features(had[i]) for i in fitted]), np.array([known[i] for i in fitted]))
            assert set(rows) == {i for i, t in had.items() if ranking.scores(np.array([quality.features(t)]))[0] >= 0.5}
        if stage is corpus_pipeline.benchmark_free:
            con = duckdb.connect()
            con.register("documents", before.select("doc_id", "text").toPandas())
            con.register("benchmark", spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas())
            hit = con.execute(f"SELECT doc_id FROM ({ORACLES['op3_decontamination']}) WHERE contaminated").fetchall()
            assert set(rows) == set(had) - {i for (i,) in hit}
        if stage is corpus_pipeline.exact_copies:
            last = {t: i for i, t in sorted(had.items())}
            assert set(rows) == set(last.values())
        if stage is corpus_pipeline.near_copies:
            assert set(rows) == {i for i, (_, c) in brute.linked(had).items() if i == c}
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    packed = [r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert brute.check_packing(rows, packed) == 0


def test_pipeline_over_no_documents(spark):
    kept = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL)
        assert kept.count() == 0


def test_the_network_knows_the_words_most_frequent_over_all_chunks(spark, monkeypatch):
    import zlib

    width = 2 * language_model.HEAD
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1][:8]
    rows = [(i, " ".join([f"w{i}x{k}" for k in range(width)] * 3) + " common common") for i in ids]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")  # a chunk each
    seen, fresh = [], language_model.Network.fresh
    monkeypatch.setattr(language_model.Network, "fresh", staticmethod(lambda f: seen.append(f) or fresh(f)))
    assert language_model.score(docs).count() == len(rows)
    # In every chunk more words than the head has places come before the common one and the end.
    assert seen[0][:3].tolist() == [16, 8, 3] and seen[0].sum() == 8 * (3 * width + 3)


def test_lanes_stay_full_until_the_last_group():
    dice = np.random.default_rng(3)
    sizes = [[5], [300, *dice.integers(1, 30, 40)], [7], [*dice.integers(1, 30, 60)], [90, 2]]
    groups = [[dice.integers(0, language_model.HEAD, n) for n in own] for own in sizes]
    docs = [doc for group in groups for doc in group]
    read, before, at_lane, short = [[] for _ in docs], [], {}, 0
    for who, previous, token, begins, came in language_model.lanes(groups, 4, 8):
        for lane, old in enumerate(came.tolist()):
            live = who[:, lane] >= 0
            short += not live.all() or len(came) < 4
            first = int(who[0, lane])
            # A document that doesn't begin here goes on in the lane that had it before.
            assert begins[0, lane] or before[old] == first
            for i, x, y, new in zip(*(a[live, lane].tolist() for a in (who, previous, token, begins)), strict=True):
                assert new == (not read[i]) and x == (read[i][-1] if read[i] else language_model.HEAD)
                read[i].append(y)
        before = who[-1].tolist()
    assert [*map(list, docs)] == read
    assert short <= 4 * -(-300 // 8)  # a tail once, not with every group
    full = sum(map(len, docs)) // 32
    windows = sum(1 for _ in language_model.lanes(groups, 4, 8))
    apart = sum(1 for group in groups for _ in language_model.lanes([group], 4, 8))
    assert windows < apart and windows <= full + -(-300 // 8)


def test_scoring_goes_on_over_chunks():
    """Lanes are filled over all chunks of a task, whatever their documents: one tail, and the same probabilities."""
    dice = np.random.default_rng(5)
    network = language_model.Network.fresh(dice.integers(1, 50, language_model.HEAD + 1).astype(float))
    sizes = [[700, 3, *dice.integers(1, 90, 600)], [1], [900, *dice.integers(1, 90, 700)], [2, 650]]
    groups = [[dice.integers(0, language_model.HEAD + 1, n) for n in own] for own in sizes]
    docs = [doc for group in groups for doc in group]
    found, tokens, windows = np.zeros(len(docs)), np.zeros(len(docs), int), 0
    for who, log in language_model._told(network, groups):
        np.add.at(found, who, log)
        np.add.at(tokens, who, 1)
        windows += 1
    assert tokens.tolist() == [*map(len, docs)]
    assert found == pytest.approx(language_model.log_likelihoods(network, docs), rel=1e-5)
    assert windows < sum(1 for group in groups for _ in language_model._told(network, [group]))


def test_words_of_a_chunk_as_numbers():
    texts = ["A\u00a0b  c", "", "C", "d\x1fe\x00 \t\n\v\f\r\u00c4 a\x85", " ", "C c", "\u2003"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    distinct, words, per_doc = language_model._split(at, data)
    split = [t.lower().split() for t in raw]  # bytes: only A-Z changes, and only ASCII spaces part words
    assert per_doc.tolist() == [*map(len, split)]
    assert [distinct[i] for i in words] == [w for own in split for w in own] and len(distinct) == len({*distinct})
    ids = np.arange(len(texts))
    whole = language_model.Words(ids, at, data, 1)
    known = dict(zip(whole.keys.tolist(), range(len(whole.keys)), strict=True))
    keys = [language_model._keys([*own, language_model.END]).tolist() for own in split]
    assert whole.lengths.tolist() == [*map(len, keys)] and whole.tokens.tolist() == [known[k] for own in keys for k in own]
    learned = [k for own, learns in zip(keys, language_model._learns(ids), strict=True) if learns for k in own]
    assert whole.counts.tolist() == [learned.count(k) for k in whole.keys.tolist()]
    empty = language_model.Words(np.arange(2), np.zeros(3, np.int64), data[:0], 1)
    assert empty.lengths.tolist() == [1, 1] and empty.tokens.tolist() == [0, 0]


def test_gradients_against_finite_differences(monkeypatch):
    dice = np.random.default_rng(4)
    weights = language_model.Network.fresh(dice.integers(1, 50, language_model.HEAD + 1).astype(float)).w
    weights = {k: v + (0.3 * dice.standard_normal(v.shape)).astype(np.float32) for k, v in weights.items()}
    docs = [dice.integers(0, language_model.HEAD + 1, n) for n in (16, 9, 12, 3, 1)]
    found = {}
    monkeypatch.setattr(language_model.Learner, "_move", lambda self, rows, grads: found.update(rows=rows, E=grads))
    learner = language_model.Learner(weights)
    language_model.train(learner, [docs])  # one window, so nothing is truncated
    grads = {**learner.g, "E": np.zeros_like(weights["E"])}
    grads["E"][found["rows"]] = found["E"]
    loss = lambda w: -language_model.log_likelihoods(language_model.Network(w), docs).sum() / len(docs)
    for name, weight in weights.items():
        way = grads[name] / np.linalg.norm(grads[name])
        up, down = (loss({**weights, name: (weight + e * way).astype(np.float32)}) for e in (0.01, -0.01))
        assert (up - down) / 0.02 == pytest.approx(np.linalg.norm(grads[name]), rel=0.02), name
