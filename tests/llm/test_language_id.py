from collections import defaultdict

import numpy as np

from bitext.llm import language_id as li

TEXT = {"de": "der die und nicht eine schön straße", "en": "the and with from reading house", "fr": "les une dans être voilà très"}


def _docs(spark):
    rows = [(i, lang, TEXT[lang] * 3) for i, lang in enumerate(["de", "en", "fr"] * 10)] + [(99, None, "x"), (98, "en", None)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def _page(lang, body):
    return f'<html{f" lang={lang!r}" if lang else ""}><style>p {{}}</style><script>the the</script><p>{body}</p></html>'


def _pages():
    rows = []
    for i in range(40):
        lang = ["de", "en", "fr"][i % 3]
        host = ["a.example.de", "b.example.de", "c.other.org"][i % 3] if i % 5 else "hot.example.com"
        rows.append((i, f"https://{host}/x/{i}", _page(lang if i % 4 else "xx", TEXT[lang] if i % 7 else "7 7")))
    return rows + [(100, None, None), (100, "http://a.example.de", ""), (None, "notaurl", _page("", "")), (101, "https://u:p@C.OTHER.org:80/?q", _page("de-AT", "voilà"))]


def test_posteriors_equal_the_formula(spark):
    model = li.fit(_docs(spark))
    assert model.languages == ["de", "en", "fr"]
    rows = _pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((str(r.page_id), r.host, r.declared, r.text_lang, r.lang, round(r.confidence, 9)) for r in li.identify(df, model).collect())

    logs, first, host_of, said_of = [], [], [], []
    for _, url, page in rows:
        x = model.log_likelihoods(li.visible_text(page or ""))
        e = np.exp(x - x.max())
        logs.append(x)
        first.append(e / e.sum())
        rest = (url or "").split("://")[1] if "://" in (url or "") else ""
        host_of.append(rest.split("/")[0].split("@")[-1].split(":")[0].lower())
        said = li.declared_language(page or "")
        said_of.append(said if said in model.languages or not said else "other")
    cut = lambda h, k: ".".join(h.split(".")[-k:])
    sums = {k: defaultdict(lambda: [np.zeros(3), 0]) for k in (1, 2, 9)}
    said = defaultdict(lambda: np.ones(3))
    for h, p, s in zip(host_of, first, said_of):
        said[s] = said[s] + p
        for k in (1, 2, 9):
            sums[k][cut(h, k)][0] = sums[k][cut(h, k)][0] + p
            sums[k][cut(h, k)][1] += 1
    keys = sorted({*model.languages, "other", ""})
    table = np.array([said[k] for k in keys])
    table = dict(zip(keys, table / table.sum(axis=0)))
    base = sum(first) + 1
    base = base / base.sum()
    s = li.STRENGTH
    exp = []
    for (page_id, _, _), h, p, x, d in zip(rows, host_of, first, logs, said_of):
        suffix = (sums[1][cut(h, 1)][0] + s * base) / (sums[1][cut(h, 1)][1] + s)
        domain = (sums[2][cut(h, 2)][0] + s * suffix) / (sums[2][cut(h, 2)][1] + s)
        host = (np.maximum(sums[9][h][0] - p, 0) + s * domain) / (sums[9][h][1] - 1 + s)
        post = np.exp(x) * host * table[d]
        post = post / post.sum()
        exp.append((str(page_id), h, d, model.languages[int(p.argmax())], model.languages[int(post.argmax())], round(float(post.max()), 9)))
    assert [g[:5] for g in got] == [e[:5] for e in sorted(exp)]
    assert np.allclose([g[5] for g in got], [e[5] for e in sorted(exp)], atol=1e-7)


def test_evidence_beside_the_text_decides_textless_pages(spark):
    model = li.fit(_docs(spark))
    rows = [(i, f"https://a.example.de/{i}", _page("", TEXT["de"])) for i in range(30)] + [(99, "https://a.example.de/9", _page("", "1 2"))]
    rows += [(200 + i, f"https://b.example.com/{i}", _page("fr", TEXT["fr"])) for i in range(30)] + [(300, "https://new.test/", _page("fr", ""))]
    got = {r.page_id: r.lang for r in li.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[99] == "de" and got[300] == "fr"


def test_text_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1").select("lang", "text").collect()
    right = [model.languages[int(model.log_likelihoods(r.text or "").argmax())] == r.lang for r in rest]
    assert np.mean(right) > 0.95


def test_empty(spark):
    model = li.fit(_docs(spark))
    assert li.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_markup_is_read_in_linear_time():
    import time

    for piece in ("<", "<script>", "<html ", "<!--", "<meta content-language ", "</script ", "<style", " lang="):
        page, times = piece * 300_000, []
        t = time.process_time()
        li.visible_text(page)
        li.declared_language(page)
        times.append(time.process_time() - t)
        assert times[0] < 3, piece


def test_markup():
    page = "<HTML data-x='1' lang = 'fr'><Script>a<b</SCRIPT >x<!-- y -->z &amp; <b>w</b><style>unclosed < c"
    assert li.declared_language(page) == "fr"
    assert li.visible_text(page).split() == ["x", "z", "&", "w", "unclosed", "<", "c"]
    assert li.declared_language("<html><meta http-equiv=content-language content='de'>") == "de"
    assert li.declared_language("<html><html lang=en>") == "en" and li.declared_language("<htmlx lang=en>") == ""


def test_no_documents(spark):
    model = li.fit(spark.createDataFrame([], "doc_id long, lang string, text string"))
    pages = spark.createDataFrame([(1, "http://a.b/", _page("en", "the")), (2, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.host, r.declared, r.text_lang, r.lang, r.confidence) for r in li.identify(pages, model).collect())
    assert got == [(1, "a.b", "other", "", "", 0.0), (2, "", "", "", "", 0.0)]
