import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from blockvault.llm import html_text as H
from blockvault.llm import license_scan as S
from blockvault.llm import metric_search as M

from .cases import both, documents, frame


def vectors(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None] + [0.0] * 6), (n + 2, [float("nan")] * 8), (n + 3, [float("inf")] * 8), (None, [1.0] * 8), (n + 4, [0.5, 0.5]), (n + 5, [])]
    rows += [(n + 10 + i, rows[0][1]) for i in range(40)] + [rows[7]]
    return rows


def brute_top(rows, k, every, kind=np.float32):
    good = [(i, [int(np.floor(1024 * x)) for x in np.array(v, kind).astype(float)]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    out = set()
    for q, u in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for i, v in good if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_top(rows, 10, 20)
    monkeypatch.setattr(M, "LEAF", 16)
    monkeypatch.setattr(M, "FAN", 4)
    for tree_rows, block_rows in ((100, 7), (10_000, 1000)):
        monkeypatch.setattr(M, "TREE_ROWS", tree_rows)
        monkeypatch.setattr(M, "BLOCK_ROWS", block_rows)
        for d in (df, df.withColumns({c: F.lit("clash") for c in ("id", "v", "rank", "score", "tree", "_query")})):
            got = M.top_k(d, F.col("vec_id") % 20 == 0).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert M.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert M.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_tree_prunes_on_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 1000
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * 5000).astype(np.int64)
    tree = M.MTree(np.arange(4000), x)
    tree.prepare()
    for q in range(0, 4000, 397):
        s = (x @ x[q]).astype(object)
        want = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:10]
        assert tree.search(q, x[q], 10) == [(-v, i) for v, i in want]
    assert tree.computed < 2000


def test_tree_with_large_numbers_is_exact():
    rng = random.Random(5)
    x = np.array([[rng.randrange(-(1 << 45), 1 << 45) for _ in range(4)] for _ in range(300)], np.int64)
    tree = M.MTree(np.arange(300), x)
    tree.prepare()
    q = x[3] // (1 << 20)
    want = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), i) for i, v in enumerate(x) if i != 3)[:5]
    assert tree.search(3, q, 5) == [(-s, i) for s, i in want]


def test_components_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e300, 2e15, -3e15, 1.5, -0.25, 0.0]) for _ in range(4)]) for i in range(120)]
    limit = lambda x: min(max(x, M.LEAST), M.MOST)
    whole = [(i, [limit(int(np.floor(1024 * x))) for x in v]) for i, v in rows]
    want = set()
    for q, u in whole[::20]:
        scored = sorted((-limit(sum(a * b for a, b in zip(u, v, strict=True))), i) for i, v in whole if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])}
    got = M.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_queries_go_to_few_cells_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 12)), 50, axis=0) + rng.normal(size=(2000, 12)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    rows += [(5000 + i, rows[0][1]) for i in range(1000)]  # a third of all rows are alike
    monkeypatch.setattr(M, "TREE_ROWS", 50)
    got = M.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 10, 20, float)
    # What the bounds allow: the tenth score of each query within its own cell.
    v = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    top = M.TopPage(v[::50].tolist(), float((v * v).sum(axis=1).max()))
    cell, distance = top.nearest(v.tolist())
    radii = np.array([distance[cell == c].max(initial=0) for c in range(len(top.x))])
    asked = range(0, 2000, 20)
    limits = [int(np.sort(v[cell == cell[q]] @ v[q])[-11:][0]) for q in asked]
    assert top.reach(v[::20][:100].tolist(), limits, radii).mean() < 0.2


LICENSED = [
    (200, "Intro.\nReleased under the MIT License.\nEnd", "en"),
    (201, "mit license mit license MIT-LICENSE apache  license", "en"),
    (202, "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in\nthe software", "en"),
    (203, "x\n\n" + S.TEMPLATES["mit"].upper() + "\n\nmore", "en"),
    (204, "general public licenses; general public license", "en"),
    (205, "Licensed under CC BY-NC 4.0.", "en"),
    (206, "word " * 30 + S.TEMPLATES["bsd"] + " tail" * 10, "en"),
    (207, S.TEMPLATES["apache"].replace("compliance", "agreement"), "en"),
    (208, "The LICENSE of MIT is mit licensé", "en"),
]


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_scan(text):
    w = words(text)
    places, base = [], set()
    for phrase, label in S.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    blocks = re.split(r"\n[ \t\r]*\n", text or "") if re.search(r"\n[ \t\r]*\n", text or "") else (text or "").split("\n")
    labels, best = set(base), 0.0
    for block in blocks:
        held = set(words(block))
        shares = {}
        for name, t in S.TEMPLATES.items():
            t = set(words(t))
            if len(t & held) / len(t) >= S.THRESHOLD - 1e-12:
                shares[name] = len(t & held) / len(t)
        top = max(shares.values(), default=0)
        labels |= {S.SAME.get(n, n) for n, x in shares.items() if x == top}
        best = max(best, top)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best


def test_license_scan(spark):
    rows = documents() + LICENSED + [(None, "mit license", "en")]
    want = sorted(map(repr, ((i, *brute_scan(t)) for i, t, _ in rows)))
    for df in both(spark, rows):
        got = S.license_scan(df)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert sorted(map(repr, (tuple(r) for r in got.drop("matches").collect()))) == want
    assert S.license_scan(frame(spark, [])).count() == 0


def test_license_matches_name_the_block(spark):
    got = S.license_scan(frame(spark, LICENSED)).filter("doc_id = 203").first()["matches"]
    assert [(m["block"], m["template"]) for m in got] == [(1, "mit")]


def test_wrapped_notices_without_blank_lines(spark):
    import textwrap

    names = ["mit", "apache", "bsd", "isc", "mpl", "lgpl"]
    rows = [(i, "\n".join(["Intro of it.", "word " * 200, *textwrap.wrap(" ".join(S.TEMPLATES[n].split()), width), "The end"]), "en") for i, (n, width) in enumerate((n, w) for n in names for w in (30, 72))]
    # The notice begins at the end of a long line; its words alone, strewn over a text, are none.
    rows.append((100, "word " * 300 + S.TEMPLATES["bsd"].replace(" with or", "\nwith or") + "\nThe end", "en"))
    rows.append((101, "\n".join(f"{w} " + "word " * 60 for w in words(S.TEMPLATES["bsd"])), "en"))
    got = {r["doc_id"]: (set(filter(None, r["labels"].split(","))), r["score"]) for r in S.license_scan(frame(spark, rows)).collect()}
    for i, n in enumerate(names):
        assert n in got[2 * i][0] and got[2 * i] == got[2 * i + 1] and got[2 * i][1] == 1.0
    assert got[100] == ({"bsd"}, 1.0) and got[101] == (set(), 0.0)


def test_notices_in_comments_and_over_blank_lines(spark):
    import textwrap

    rows, names = [], ["mit", "apache", "bsd", "isc", "mpl", "lgpl"]
    for n in names:
        lines = textwrap.wrap(" ".join(S.TEMPLATES[n].split()), 60)
        half = len(lines) // 2
        rows.append((len(rows), "\n".join(["#!/bin/sh", *(f"# {x}" for x in lines), "echo"]), "en"))
        rows.append((len(rows), "\n".join([*lines[:half], "", *lines[half:], "", "The end"]), "en"))
        rows.append((len(rows), "\n".join(["/*", *(f" * {x}" for x in lines[:half]), " *", *(f" * {x}" for x in lines[half:]), " */", "", "int x;"]), "en"))
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in S.license_scan(frame(spark, rows)).collect()}
    assert all(names[i // 3] in labels and score == 1.0 for i, (labels, score) in got.items())


def test_text_of_many_blocks(spark):
    lines = [f"word{i % 50} of line {i}" for i in range(20_000)]
    lines.insert(15_000, " ".join(S.TEMPLATES["bsd"].split()))
    got = S.license_scan(frame(spark, [(1, "\n".join(lines), "en"), (2, "\n\n".join(lines), "en")])).collect()
    assert {(r["labels"], r["score"], r["n_words"]) for r in got} == {("bsd", 1.0, 80_000 + len(words(S.TEMPLATES["bsd"])))}


def test_two_notices_in_one_block(spark):
    cut = " ".join(S.TEMPLATES["isc"].split()).replace("without fee ", "without ").replace("any purpose", "any")
    rows = [(1, " ".join(S.TEMPLATES["mit"].split()) + " " + cut, "en")]
    got = {r["doc_id"]: r for r in S.license_scan(frame(spark, rows)).collect()}
    assert got[1]["labels"] == "isc,mit" and sorted(m["containment"] < 1 for m in got[1]["matches"]) == [False, True]


PAGE = """<!DOCTYPE html><html><head><title>The title</title><style>p{}</style><script>if (a<b) document.write("<p>the of and</p>")</script></head>
<body><div id="cookie-notice">We use the cookies of this site for all that is in it and that was there for you to see.</div>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>The first</a></li><li><a href=/b>And the second</a></li></ul></nav>
<article><header><h1>Of &lt;cats&gt; &amp; dogs</h1></header><p>It was the best of the times and it was the worst of the times, as they say in the book that was on the table for all to read.
<p>Short one.<br>Same&nbsp;block.</p><div class="ad">Buy the best of all that there is for you and for the others that are in this house.</div>
<ul><li>The item of a list that is in the text<li>xyzzy</ul>
<form>Your name: <input><button>Send the form to us</button></form><p>The last one of them, which was in the text and is the end of it for now and for the time that is to be.</p></article>
<section class="comments"><article><p>I think that this is the best of all the articles that I have read on this site, and I will be back for more of it.</p></article></section>
<aside>More of the same for you and the others</aside><footer>&copy; the owners of the site</footer></body></html>"""


def test_page():
    assert H.extract(PAGE).split("\n") == [
        "Of <cats> & dogs",
        "It was the best of the times and it was the worst of the times, as they say in the book that was on the table for all to read.",
        "Short one. Same block.",
        "The item of a list that is in the text",
        "xyzzy",
        "The last one of them, which was in the text and is the end of it for now and for the time that is to be.",
    ]


def test_second_pass_without_an_article():
    prose = "This is the text of the page, and it has what all of the others have in it: words that are there for the sake of the others, as they were."
    page = f"<body><p>Menu</p><p><a href=x>link one</a> <a href=y>link two</a></p><h2>Heading</h2><p>{prose}</p><p>short</p><p>{prose}</p><p><a href=z>next page of the site</a></p><p>tiny</p>"
    assert H.extract(page).split("\n") == ["Heading", prose, "short", prose]


PROSE = "This is the text of the page, and it has what all of the others have in it: words that are there for the sake of the others, as they were."


def test_names_that_only_seem_to_exclude():
    for name in ("content has-sidebar", "main-content no-sidebar", "post with-share", "hidden-print content", "story social-post", "share-post", "nav"):
        assert H.extract(f'<body><div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div></body>').split("\n") == [PROSE, PROSE]
    for name in ("cookie-notice", "sidebar", "sidebar-left", "ad-slot", "sidebarRight", "related-posts", "site-footer", "post-comments", "share-buttons"):
        assert H.extract(f'<body><p>{PROSE}</p><div class="{name}"><p>{PROSE}</p></div><p>{PROSE}</p></body>').split("\n") == [PROSE, PROSE]


def test_inline_parts_that_are_left_out():
    page = f'<article><p>{PROSE} <span class="ad">Buy <b class=x>now</b></span>And then more.</p><p><em hidden>secret</em>Last.</p></article>'
    assert H.extract(page).split("\n") == [f"{PROSE} And then more.", "Last."]


def test_other_languages():
    text = "Сегодня утром мы пошли в лес, чтобы собрать грибы и ягоды. На опушке стоял старый дом, в котором давно никто не жил."
    page = f"<body><ul><li><a href=a>Главная</a></li><li><a href=b>Новости</a></li></ul><p>{text}</p><p>{text}</p><p><a href=c>Все новости этого сайта и другие страницы того же раздела</a></p></body>"
    assert H.extract(page).split("\n") == [text, text]


def test_deep_pages_take_linear_time():
    began = time.process_time()
    assert H.extract("<article>" + "<div><b class=x>" * 100_000 + "deep" + "</b></p></div></i>" * 100_000) == "deep"
    assert time.process_time() - began < 10


def test_broken_pages():
    assert H.extract(None) == H.extract("") == H.extract("<") == H.extract("<script>the of and") == ""
    assert H.extract("<article><p>cut off in the mid") == "cut off in the mid"
    assert H.extract("<nav><ul><li>the menu<article><p>text") == "text"
    assert H.extract("<article>" + "<div>" * 3000 + "deep" + "</p>" * 3000) == "deep"
    assert H.extract('<article><p title="a > b" x=\'>\'>quoted</p>') == "quoted"


def test_pages_of_a_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for d in (df, df.withColumns({c: F.lit("clash") for c in ("text", "n_chars", "_id", "_html")})):
        got = H.extract_text(d).collect()
        assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
        assert sorted(bool(r["text"]) for r in got) == [False, False, True, True]
    assert H.extract_text(df.limit(0)).count() == 0


def test_pages_match_their_articles(spark):
    """The article's blocks of real pages of the small table, by a plain reading of their simple markup."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for (page,) in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert H.extract(page) == "\n".join(x for x in parts if x)
