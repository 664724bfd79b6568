"""Source divergence, main text and vector codes against plain versions."""

import collections
import hashlib
import html
import re

import numpy as np
import pyarrow as pa
import pytest

from demandara.llm import divergence, main_text, vector_codes
from demandara.llm.queries import QUERIES, table

# 11 source divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_divergence(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, n = collections.defaultdict(set), collections.Counter()
    for k, (text, lang, source) in enumerate(rows):
        for t in TERM.findall(text):
            t = t.translate(LOWER)
            docs[lang, t].add(k)
            n[lang, source, t] += 1
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for (l, t), found in docs.items() if l == lang and len(found) >= min_docs]
        v = len(kept)

        def shares(counts):
            total = sum(counts.values())
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        sources = {r[2] for r in rows if r[1] == lang}
        of = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: shares(of[s]) for s in sources}
        q = shares({t: sum(of[s][t] for s in sources) for t in kept})
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            term = [(t, p[s][t] - q[t]) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, f, k + 1) for k, (t, f) in enumerate(items[:last])]
    return sorted(out)


def divergence_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ODD_DOCS = [(1, "The the THE a-b a_b don't", "en", "x"), (1, "The the THE a-b a_b don't", "en", "x"),
            (2, None, "en", "y"), (3, "", None, None), (None, "ÄÖ äö äÖ the the, (the)", "en", None),
            (4, "é É the\tThe\nthe\x0bz", "de", "x"), (5, "123 !! --", "de", "y"),
            (6, "q" * 50_000 + " the", "en", "z"), (7, "the end", "", "z"), (8, "\x00the\x7fend", None, "y")]
ODD_NAMES = "doc_id long, text string, lang string, source string, l long, g int, term string, value int, _text int"


@pytest.mark.parametrize("min_docs, top", [(1, 50), (2, 1), (5, 3)])
def test_divergence_on_odd_rows(spark, min_docs, top):
    docs = spark.createDataFrame([(*r, 1, 2, "t", 3, 4) for r in ODD_DOCS], ODD_NAMES)
    got = divergence_rows(divergence.divergence(docs, min_docs, top))
    assert got == plain_divergence([r[1:] for r in ODD_DOCS], min_docs, top)


def test_divergence_of_no_and_of_null_rows(spark):
    none = spark.createDataFrame([], ODD_NAMES)
    assert divergence.divergence(none).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.divergence(none).count() == 0
    nulls = spark.createDataFrame([(None, None, None, s, *[None] * 5) for s in (None, "a")], ODD_NAMES)
    assert divergence_rows(divergence.divergence(nulls)) == [
        ("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_divergence_of_documents(spark, sf):
    rows = [(r["text"], r["lang"], r["source"]) for r in table(spark, sf, "documents").collect()]
    assert divergence_rows(QUERIES["op11_source_divergence"].run(spark, sf)) == plain_divergence(rows, 30, 50)


def test_blocks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 10)
    texts = ["", "a" * 3, "b" * 30, "c" * 7, "d" * 7, "", "e" * 9, "f" * 21]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["_text"])
               for x in (texts[:3], [], texts[3:4], texts[4:])]
    found = [b["_text"].to_pylist() for b in divergence.blocks(iter(batches))]
    assert sum(found, []) == texts and len(found) > 4
    assert all(sum(map(len, b[:-1])) <= 30 for b in found)
    assert not list(divergence.blocks(iter([])))


def test_packed_counts_come_back():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 3, 0, 5, 1, 0])
    codes = np.concatenate([np.sort(rng.choice(1000, s, replace=False)) for s in sizes])
    times = rng.integers(1, 100_000, len(codes))
    l, g = rng.integers(0, 1 << 60, (2, len(sizes)))
    back = divergence.unpacked(divergence.packed(l, g, sizes, codes, times))
    for a, b in zip(back, (l, g, np.repeat(np.arange(6), sizes), codes, times)):
        assert a.tolist() == b.tolist()
    assert [len(x) for x in divergence.unpacked(divergence.packed(*[np.empty(0, np.int64)] * 5))] == [0] * 5


# 12 main text

def plain_article(text):
    """What stands in the article element, for pages without marked parts inside it."""
    inside = re.search(r"<article>(.*)</article>", text, re.S).group(1)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())
             for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(x for x in lines if x)


def test_text_of_pages(spark, sf):
    pages = {r["page_id"]: r for r in table(spark, sf, "pages").collect()}
    got = QUERIES["op12_html_extraction"].run(spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        page = pages[r["page_id"]]
        assert (r["url"], r["text"]) == (page["url"], plain_article(page["html"]))
        assert r["n_chars"] == len(r["text"])


LONG = "A sentence of the article that is long enough to be counted as body text."
NOISE = ["<nav><ul><li><a href=/>Home</a></ul></nav>", "<div class='cookie-notice'><p>We use cookies.</p></div>",
         "<aside>Aside text.</aside>", "<div id=sidebar><p>Side text</p></div>", "<form><p>Sign up</p></form>",
         "<div class='ad-slot'>Buy now</div>", "<script>var a='<p>no</p>'</script>", "<style>p{}</style>",
         "<section class='comments'><article class='comment'><p>" + "Reader text. " * 90 + "</p></article></section>",
         "<footer>&copy; Footer</footer>", "<div role=navigation>Go</div>", "<div hidden>Not shown</div>",
         "<!-- a comment <p>x</p> -->", "<noscript><p>Turn it on</p></noscript>", "<button>Press</button>"]
BODY = f"<h1>Title</h1><p>{LONG}</p><ul><li>one<li>two</ul><p>{LONG} &amp; <b>more</b>\n <i>of</i>&nbsp;it.<br>End</p>"
TEXT = f"Title\n{LONG}\none\ntwo\n{LONG} & more of it. End"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='post-content'>{}</div>", "<main>{}</main>",
                                  "<div><div class=x><article>{}</article></div></div>",
                                  "<table><tr><td>{}</td></tr></table>", "<div>{}</div>"])
def test_text_without_what_stands_around(wrap):
    for noise in NOISE:
        for page in (noise + wrap.format(BODY), wrap.format(BODY) + noise,
                     wrap.format(BODY.replace("<ul>", noise + "<ul>"))):
            page = f"<!doctype html><html><head><title>T</title></head><body class='has-sidebar'>{page}</body></html>"
            assert main_text.Page(page).text() == TEXT, page


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain text", "plain text"), ("a < b && c > d &lt;p&gt;", "a < b && c > d <p>"),
    ("<p>one<p>two</div>three", "one\ntwo\nthree"), ("<article>Hi.</article><div class=ad>" + "Buy it. " * 50, "Hi."),
    ("<div><p title='a > b'>x</p><p don't>y</p></div>", "x\ny"), ("<p>cut <a href='", "cut"),
    ("<script>never closed <p>x</p>", ""), ("<p>a<!-- open", "a"), ("</p></div></b>a", "a"),
    ("<nav>only a menu</nav>", ""), ("<P CLASS=X>a</P>&#x41;&#66;&unknown;", "a\nAB&unknown;"),
    ("<article><header><h1>T</h1></header><p>b</p><footer>f</footer></article>", "T\nb")])
def test_text_of_odd_markup(page, text):
    assert main_text.Page(page).text() == text


def test_long_and_deep_pages_take_linear_time():
    import time
    for make in (lambda n: "<div>" * n + "<p>x", lambda n: "<a \"" * n, lambda n: "<p>a<b>" * n,
                 lambda n: "<a b='" * n, lambda n: "<!--" * n, lambda n: "&am" * n, lambda n: "</td>" * n,
                 lambda n: "<span>" * n + "<p>" + "</div>" * n, lambda n: "<script " * n):
        spent = []
        for n in (4_000, 32_000):
            start = time.process_time()
            p = main_text.Page(make(n))
            p.votes(), p.text("div/div")
            spent.append(time.process_time() - start)
        assert spent[1] < 40 * max(spent[0], 0.02)
    assert main_text.Page("<div>" * 5_000 + "<p>deep</p>" + "</div>" * 5_000 + "<p>after").text() == "deep\nafter"


def test_a_host_decides_for_its_pages(spark):
    """Pages whose teaser outweighs the text still give the text, as other pages of the host do."""
    usual = f"<div class=lead><p>{LONG}</p></div><div class=c17><p>{LONG} {LONG} {LONG}</p><p>{LONG}</p></div>"
    odd = f"<div class=lead><p>{LONG} {LONG} {LONG}</p></div><div class=c99><p>{LONG} {LONG}</p></div>"
    rows = [(k, f"http://u@A.example:80/{k}", usual) for k in range(5)]
    rows += [(9, "https://a.example/9", odd), (10, "https://b.example/", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r["host"]: r["path"] for r in main_text.host_paths(pages).collect()}
    assert set(paths) == {"a.example", "b.example"}
    got = {r["page_id"]: r["text"] for r in main_text.extract(pages).collect()}
    page = main_text.Page(odd)
    assert got[9] == page.text(paths["a.example"]) and got[10] == page.text(paths["b.example"])
    chosen = spark.createDataFrame([("a.example", "div.c#")], "host string, path string")
    got = {r["page_id"]: r["text"] for r in main_text.extract(pages, chosen).collect()}
    assert got[9] == f"{LONG} {LONG}" and got[0] == f"{LONG} {LONG} {LONG}\n{LONG}"


def test_text_of_odd_rows(spark):
    shape = "page_id long, url string, html string, host string, path string, text int, _text int, n_chars int"
    rows = [(1, None, None), (1, None, None), (None, "", "<p>a"), (2, "no url", "<p>b</p>"), (3, "http://h/", ""),
            (4, "http://h/", "<article>" + "word " * 100_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "h", "p", 1, 2, 3) for r in rows], shape)
    got = main_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got.collect()) == [
        ("1", 0), ("1", 0), ("2", 1), ("3", 0), ("4", 499_999), ("None", 1)]
    assert main_text.extract(spark.createDataFrame([], shape)).count() == 0


# 13 vector codes

def plain_codes(x, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks of whole-number vectors in id order."""
    cells = x.reshape(len(x), parts, -1)
    books = cells[:entries].transpose(1, 0, 2).copy()
    for left in range(rounds, -1, -1):
        away = np.array([((cells[:, p, None] - books[p]) ** 2).sum(-1) for p in range(parts)])
        codes = away.argmin(axis=2)
        if left:
            for p in range(parts):
                for e in set(codes[p].tolist()):
                    some = cells[codes[p] == e, p]
                    books[p, e] = some.sum(axis=0) // len(some)
    return codes.T, away.min(axis=2).sum(axis=0), books


def check_codes(got, rows, books=None):
    """rows: (id, vector of whole numbers, label) in id order, ids distinct."""
    codes, errors, plain = plain_codes(np.array([r[1] for r in rows]))
    sums = collections.Counter()
    for r, e in zip(rows, errors.tolist()):
        sums[r[2]] += e
    sha = hashlib.sha256(",".join(map(str, plain.ravel().tolist())).encode()).hexdigest()
    want = [(r[0], bytes(c).hex(), e, sums[r[2]], sha)
            for r, c, e in zip(rows, codes.astype(np.uint8).tolist(), errors.tolist())]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_codes_of_embeddings(spark, sf):
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64), r["label"])
            for r in table(spark, sf, "embeddings").orderBy("vec_id").collect()]
    check_codes(QUERIES["op13_vector_codes"].run(spark, sf), rows)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(1, [0.5] * 16, 1), (2, [0.5] * 16, 1), (3, [-0.001] * 16, None), (4, [1.0] * 15 + [-2.0], None),
            (5, [], 2), (6, [0.25], 2), (7, [3.0] * 17, 3), (None, [1e30] + [0.0] * 15, 3)]
    gone = [(8, None, 1), (9, [None] * 16, 1), (10, [nan] + [0.0] * 15, 1), (0, [inf] + [0.0] * 15, None),
            (-1, [1.0, None], 2)]
    shape = "vec_id long, embedding array<double>, label int, _id int, _v int, error int, n int, part int"
    vectors = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in kept + gone], shape)

    def whole(v):
        return [int(np.clip(np.floor(256 * x), -vector_codes.LARGEST, vector_codes.LARGEST))
                for x in v + [0.0] * (32 - len(v))]

    got = vector_codes.digest(*vector_codes.compress(vectors))
    codes, errors, books = plain_codes(np.array([whole(r[1]) for r in kept]))
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got.collect()} == {
        r[0]: (bytes(c).hex(), e) for r, c, e in zip(kept, codes.astype(np.uint8).tolist(), errors.tolist())}
    sums = {r["vec_id"]: r["label_error"] for r in got.collect()}
    assert sums[3] == sums[4] == errors[2] + errors[3] and sums[7] == sums[None]
    twice = vectors.filter("vec_id = 4").union(vectors.filter("vec_id = 4"))
    assert vector_codes.digest(*vector_codes.compress(twice)).count() == 2
    for nothing in (vectors.limit(0), vectors.filter("vec_id > 7")):
        assert vector_codes.digest(*vector_codes.compress(nothing)).count() == 0


def test_dual_tree_gives_the_plain_assignment():
    rng = np.random.default_rng(3)
    for n, d, entries, spread in ((1, 4, 1, 9), (40, 1, 3, 2), (3000, 4, 64, 60), (5000, 3, 37, 5),
                                  (2000, 2, 200, 500), (700, 8, 64, 1), (4097, 4, 64, 0)):
        x = rng.integers(-spread, spread + 1, (n, d)) + rng.integers(0, 3, (n, 1)) * 20 * spread
        book = x[rng.integers(0, n, entries)]
        tree = vector_codes.Tree(x, vector_codes.LEAF)
        stored = vector_codes.Nodes(x[tree.order], *(np.concatenate(a) for a in (tree.low, tree.high, tree.sums)))
        assert all(a.tolist() == b.tolist() for a, b in zip(tree.bounds, stored.bounds))
        assert len(tree.bounds) == len(stored.bounds)
        code, sums, counts = vector_codes.assign(stored, stored.cells, vector_codes.Codebook(book))
        want = ((stored.cells[:, None] - book) ** 2).sum(-1).argmin(axis=1)
        assert code.tolist() == want.tolist()
        assert counts.tolist() == np.bincount(want, minlength=entries).tolist()
        for e in range(entries):
            assert sums[e].tolist() == stored.cells[want == e].sum(axis=0).tolist()


def test_far_groups_are_assigned_whole(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-5, 6, (512, 4)) + 1000 * k for k in range(4)])
    tree = vector_codes.Tree(x, vector_codes.LEAF)
    monkeypatch.setattr(vector_codes, "_compare", None)  # no leaf is uncertain
    code, _, counts = vector_codes.assign(tree, x[tree.order], vector_codes.Codebook(x[::512]))
    assert counts.tolist() == [512] * 4 and len(set(code.tolist())) == 4
