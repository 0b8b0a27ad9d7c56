"""HTML text, URL filter, licences, quality, BPE, toxicity and mixing: edge cases and brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import bpe, html_text, licences, mixing, quality, toxicity, url_filter
from tablewright.llm.store import table

from .helpers import SMALL, edge_documents, empty_documents, sha

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="menu-open">
<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a><li>Two</ul></nav><!-- ad --><div class="cookie-notice">We use cookies on
this site, and we say so here in a rather long sentence that weighs much.</div><%s><h1>Head &amp; line</h1><p>First <b>bold
text</b> of the&nbsp;article, which is quite long and says many things.<br>After a break.<p>Second paragraph, unclosed &lt;b&gt;.
<aside>Side</aside><div class="ad-box">Buy now, buy more, buy all the things that we sell here today.</div><p>Short.</%s>
<section id="comments"><h3>Comments</h3><p>I liked this very much, and I say so in a long comment that goes on and on and on.</section>
<form><label>Mail</label><input></form><footer>&copy; me</footer><script>var x = "</p>";</script></body></html>"""


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_main_text(element):
    text = html_text.main_text(PAGE % (element, element))
    assert text == ("Head & line\nFirst bold text of the article, which is quite long and says many things. After a break.\n"
                    "Second paragraph, unclosed <b>.\nShort.")


def test_teasers_and_comment_articles_are_not_the_text():
    body = "<p>" + "A long paragraph of the main text with many words in it. " * 6 + "</p><p>End.</p>"
    page = f"<body><div id=content>{body}<article class='comment'><p>{'A comment that is long enough to be seen. ' * 5}</p></article></div>"
    want = " ".join(["A long paragraph of the main text with many words in it."] * 6) + "\nEnd."
    assert html_text.main_text(page) == want
    teasers = "".join(f"<article><h3>Teaser {i}</h3></article>" for i in range(4))
    assert html_text.main_text(f"<body><div>{teasers}</div><div class=text>{body}<p class=ad>Buy.</p></div>") == want


def test_only_whole_names_silence_an_element():
    body = "<p>" + "A long paragraph of the main text with many words in it. " * 6 + "</p>"
    want = " ".join(["A long paragraph of the main text with many words in it."] * 6)
    for mark in ("class='layout with-sidebar'", "class='content no-sidebar'", "id='how-to-share-files'", "class='sidebar'"):
        assert html_text.main_text(f"<body><div {mark}><article>{body}</article></div></body>") == want, mark
    for mark in ("id='how-to-share-files'", "id='related-work'", "id='search'"):
        assert html_text.main_text(f"<article><h2 {mark}>Head</h2>{body}</article>") == "Head\n" + want, mark
    inline = "<p>Before <button>Press</button><span class='ad'>Buy</span><label>Mail</label> after.</p>"
    assert html_text.main_text(f"<article>{body}{inline}<div class='site-footer'>Foot</div></article>") == want + "\nBefore after."
    comments = f"<section id='comments'><article class='comment'>{body * 3}</article></section>"
    assert html_text.main_text(f"<article>{body}</article>{comments}") == want


LONG = "A long paragraph of the main text with many words in it, long enough for a surge of its own."
MENU = "<ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>"


@pytest.mark.parametrize("page, want", [
    (f"<body><div class=lead><p>Lead. {LONG}</p></div><div class=text>{f'<p>{LONG}</p>' * 6}</div>", [f"Lead. {LONG}"] + [LONG] * 6),
    (f"<body><article><p>1. {LONG}</p></article><article>{f'<p>{LONG}</p>' * 4}</article>", [f"1. {LONG}"] + [LONG] * 4),
    (f"<body><article class=teaser><p>1. {LONG}</p></article><article>{f'<p>{LONG}</p>' * 4}</article>", [LONG] * 4),
    (f"<p>{LONG}</p><nav>{MENU}</nav>{f'<p>{LONG}</p>' * 6}", [LONG] * 7),
    (f"<body><div>{MENU}</div><h1>Head</h1><p>By Me</p><div class=text>{f'<p>{LONG}</p>' * 3}</div>", ["Head", "By Me"] + [LONG] * 3),
    (f"<body><div class=logo><h1>Site</h1></div><div class=text>{f'<p>{LONG}</p>' * 3}</div>", [LONG] * 3),
    (f"<body><h1>Head</h1><article>{f'<p>{LONG}</p>' * 3}</article>", ["Head"] + [LONG] * 3),
    (f"<body><nav>{MENU}<div class=text>{f'<p>{LONG}</p>' * 3}</div><footer>{LONG}</body>", [LONG] * 3),
    (f"<body><label>Mail<div class=text>{f'<p>{LONG}</p>' * 3}</div>", [LONG] * 3),
    (f"<body><div><div class=text>{f'<p>{LONG}</p>' * 6}</div></div><div><div><p>End. {LONG}</p></div></div>", [LONG] * 6 + [f"End. {LONG}"]),
    (f"<body><div class=text>{f'<p>{LONG}</p>' * 6}</div><div>Me, 2020</div>", [LONG] * 6),
    (f"<body><div>{MENU}</div><div class=text>{f'<p>{LONG}</p>' * 6}</div><div>{MENU}</div>", [LONG] * 6)])
def test_pages_without_one_marked_article(page, want):
    assert html_text.main_text(page) == "\n".join(want)


@pytest.mark.parametrize("mark", ["commentlist", "user-comment", "comment-42", "readerComments", "comment_form", "comments-area", "note"])
def test_comments_by_compound_names(mark):
    page = f"<body><div class=post><div class=text>{f'<p>{LONG}</p>' * 3}</div><div class='{mark}'><p>{LONG}</p></div></div>"
    assert html_text.main_text(page) == "\n".join([LONG] * 3)
    assert html_text.main_text(page.replace(mark, "commentary")) == "\n".join([LONG] * 4)


def test_generated_pages_without_articles():
    """Brute force: every block of the page is listed with whether it is main text when the page is put together."""
    import random

    rng = random.Random(11)
    for _ in range(300):
        want, parts = [], []
        for k in range(rng.randrange(1, 5)):
            texts = [f"{k}.{i} {LONG}" for i in range(rng.randrange(1, 6))]
            want += texts
            parts.append(rng.choice(["<div>{}</div>", "<section><div>{}</div></section>", "<div><div class=inner>{}</div></div>"])
                         .format("".join(f"<p>{t}" + rng.choice(["", "</p>"]) for t in texts)))
            parts.append(rng.choice(["", f"<nav>{MENU}</nav>", f"<div class=sidebar><p>{LONG}</p></div>", "<div class='ad-box'>Buy.</div>",
                                     f"<aside><p>{LONG}</p></aside>", f"<ul class=commentlist><li>{LONG}</ul>"]))
        page = f"<html><body><header>{LONG}</header>{''.join(parts)}<footer>{LONG}</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(want), page


def test_main_text_matches_the_articles(spark):
    """The pages mark their articles: brute force cuts them out and strips the tags."""
    from html import unescape

    for r in html_text.op2_html_text(spark, SMALL).join(table(spark, SMALL, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "plain < text & more"), (3, "u", "plain < text & more"),
                                   (4, "u", "<div " * 50), (5, "u", "<p>" + "long words " * 100_000)], "page_id bigint, url string, html string")
    got = [(r.page_id, r.text[:30], r.n_chars) for r in html_text.extract_text(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()]
    assert (1, "", 0) in got and (2, "", 0) in got and (None, "x", 1) in got and got.count((3, "plain < text & more", 19)) == 2
    assert any(g[0] == 5 and g[2] == 1_099_999 for g in got)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_url_filter_cases(spark):
    urls = {"https://a.com": ("a.com", "", None, "allow"), "https://A.Com/": ("a.com", "/", "com/", "allow"),
            "http://www.example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
            "http://blog.example.com/en/1#t": ("blog.example.com", "/en/1", "example.com/en/", "block"),
            "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
            "http://x.net/ES/": ("x.net", "/ES/", None, "allow"), "http://ads-track.example.org/fr/": ("ads-track.example.org", "/fr/", None, "block"),
            "http://loads.example.org/": ("loads.example.org", "/", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
            "": ("", "", None, "allow"), "http://x.net/fr/" + "y" * 50_000: ("x.net", "/fr/" + "y" * 50_000, "net/fr/", "block")}
    rows = [(i, u) for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'z' AS host", "'z' AS rule", "'z' AS token")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(urls.values())[r.page_id]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_index_takes_the_rarest_literal(spark):
    rules = [url_filter.listed_rule("rare.example.com/en/", "block"), url_filter.Rule("any", "block", "q{9}", (), False)]
    targets = spark.createDataFrame([("u1", "a.example.com/en/", ["a", "example", "com", "en", ""]),
                                     ("u2", "rare.example.com/en", ["rare", "example", "com", "en", ""])], "url string, target string, tokens array<string>")
    assert {(r.name, r.token) for r in url_filter.rarest_token_index(targets, rules).collect()} == {("rare.example.com/en/", "rare"), ("any", "")}
    pages = spark.createDataFrame([(1, "x://z/qqqqqqqqq")], "page_id bigint, url string")
    assert url_filter.filter_urls(pages, rules).first().verdict == "block"


def test_licences(spark):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 Me\n\n" + mit.upper().replace(" ", "  ")), (2, "Text.\nReleased under the MIT Licence!\nMore."),
                                  (3, None), (4, ""), (5, "Head\n\n" + mit.split("\n\n")[0] + "\n\n" + "tail"), (6, "..."), (2, "Text.\nReleased under the MIT Licence!\nMore.")],
                                 "doc_id bigint, text string").selectExpr("*", "'z' AS licence", "'z' AS digest")
    got = licences.scan_licences(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].whole == ["MIT"] and by[2].lines == ["MIT"] and by[2].whole == []
    assert by[3].licences == by[4].licences == by[5].licences == by[6].licences == []
    assert licences.scan_licences(docs.limit(0)).count() == 0
    assert licences.scan_licences(edge_documents(spark)).count() == 11


def test_whole_licence_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
             "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0-Perl", "GFDL-1.3": "GFDL-1.3"}
    rows = [(k, Path(f"/usr/share/common-licenses/{k}").read_text()) for k in names]
    apache = dict(rows)["Apache-2.0"]
    rows += [("bare", apache[:apache.index("APPENDIX")])]
    bsd = next(t for n, t in licences.KNOWN if n == "BSD-2-Clause" and "1. Redist" in t)
    rows += [("bsd", "Copyright (c) 2020, Me\n\n" + bsd.replace("1. ", "- ").replace("2. ", "- ")), ("cut", apache[:5000])]
    want = names | {"bare": "Apache-2.0", "bsd": "BSD-2-Clause", "cut": None}
    for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert r.whole == ([want[r.doc_id]] if want[r.doc_id] else []), r.doc_id


def test_headed_and_wrapped_licences(spark):
    import textwrap

    whole = {n: next(t for m, t in licences.KNOWN if m == n) for n in ("MIT", "ISC")}
    apache = max((t for n, t in licences.KNOWN if n == "Apache-2.0"), key=len)
    apache = whole["Apache-2.0"] = apache[:apache.index("APPENDIX")]
    wrap = lambda t, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n) for p in re.split(r"\n\s*\n", t))
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Me\n\n" + whole["MIT"]), ("MIT", "# The MIT License (MIT)\n\nCopyright 2020 Me\n\n" + wrap(whole["MIT"], 60)),
            ("MIT", whole["MIT"].replace("OR COPYRIGHT", "OR\nCOPYRIGHT")), ("MIT", "Copyright The Authors\nCopyright: Others\n\n" + whole["MIT"]),
            ("ISC", "ISC License\n\n(c) 1999, Me\n\n" + whole["ISC"].replace("above copyright", "above\ncopyright")),
            ("ISC", "Copyright \u00a9 Me\n\n" + whole["ISC"].replace("and/or", "and")), ("Apache-2.0", " ".join(apache.split()))]
    rows += [(n, wrap(whole[n], width)) for n in ("MIT", "ISC") for width in range(30, 100)]
    rows += [("Apache-2.0", wrap(apache, width)) for width in range(30, 100, 3)]
    got = licences.scan_licences(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, name string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.whole == [rows[r.doc_id][0]], rows[r.doc_id][1]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(wins)
    rep = {i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep),
            len(words) < 10 or 100 * len(rep) > 20 * len(words))


def test_quality_base_brute_force(spark):
    texts = ["a b c d e a b c d e f g h", "x " * 500, "a b c d e f g h i j k l m n o p q r s t\n" * 3, None, "", "é 中\u00a0文 # $ | <b>\n\nx\r\nx\r\n",
             "w " * 3 + "| a | b | c | d", "one two three four five six seven eight nine ten eleven", "p q r s t u " * 2 + " ".join(map(str, range(60)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS words", "2 AS lines", "3 AS kept")
    for r in quality.judge_quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality.judge_quality(edge_documents(spark)).count() == 11
    assert quality.judge_quality(empty_documents(spark)).count() == 0


def test_quality_lines(spark):
    good = "This is a sentence with enough words to stand alone in a text."
    other = "Another line of the same text says something else, and ends well too."
    texts = [good + "\n" + other, good + "\n" + "Home | News | Sports | Weather | Contact and many more entries to be read here",
             "%%% *** $$$ a### b&&& c%%% d*** e$$$ f### g&&& h%%% i***", good + "\nWe use cookies. Read our cookie policy."]
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0].kept and got[0].n_lines_removed == 0 and got[0].clean_text == texts[0]
    assert not got[1].kept and got[1].clean_text == good
    assert not got[2].kept and got[3].kept and got[3].clean_text == good


def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.default_vocabulary())
    made.no_truncation()
    made.no_padding()
    return made


def test_bpe_equals_the_library(spark):
    made = library()
    extra = ["", " ", "'S it's I'LL", "ΑΣ Σ İx ſ ß", "a\u0301 é ½²³", "中文テスト👍🏽", "<|startoftext|>a<|endoftext|> <|end", "x" * 5000, "\x1c\x85\u00a0\u2003z", "naïve—“q”"]
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_texts(docs, outputs=tuple(bpe.TYPES)).collect():
        ids = made.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == made.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == sha(np.array(ids, dtype="<u4").tobytes()) and r.decoded_sha256 == sha(r.decoded.encode())


def test_bpe_edges(spark):
    got = bpe.encode_texts(edge_documents(spark)).collect()
    assert len(got) == 11 and all(len(r.ids) == r.n_tokens for r in got)
    assert [(r.n_tokens, r.decoded) for r in got if r.doc_id in (2, 3, 7)] == [(0, "")] * 3
    assert bpe.encode_texts(empty_documents(spark)).count() == 0


def test_held_out_is_crc32(spark):
    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op6_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in scored)
    assert hit >= 0.75 * sum(r.toxic for r in scored) and hit >= 0.8 * sum(r.predicted for r in scored)


def test_toxicity_without_labels_and_edges(spark):
    docs = edge_documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == 11 and all(r.score < 1e-6 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (3, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score_texts(docs, toxicity.train(docs, some)).count() == 11
    assert toxicity.score_texts(empty_documents(spark), toxicity.train(empty_documents(spark), none)).count() == 0


def test_nnpu_recovers_the_toxic_word():
    rng = np.random.default_rng(1)
    rows = [[0] + [int(x) for x in rng.integers(1, 20, 3)] for _ in range(200)]  # word 0 marks the positives
    unl = [([0] if rng.random() < 0.1 else []) + [int(x) for x in rng.integers(1, 20, 3)] for _ in range(2000)]
    w, b = toxicity.fit_nnpu(rows + unl, np.array([True] * 200 + [False] * 2000), 0.1, 20)
    assert w[0] > 3 * np.abs(w[1:]).max() and 1 / (1 + np.exp(-(w[0] + b))) > 0.5 > 0.3 > 1 / (1 + np.exp(-b))


def brute_schedule(share: dict[str, int], slots: int) -> list[tuple[str, int]]:
    """Earliest deadline first, a slot at a time; ties go to the source with the smallest md5 of its key."""
    p, done, out = sum(share.values()), dict.fromkeys(share, 0), []
    tie = {k: hashlib.md5(k.encode()).hexdigest() for k in share}
    for t in range(slots):
        k = min((-(-(d + 1) * p // share[k]), tie[k], k) for k, d in done.items() if d * p // share[k] <= t)[2]
        out.append((k, done[k]))
        done[k] += 1
    return out


def worst_deviation(rows, weight: dict[str, Fraction]) -> Fraction:
    """The largest distance of any source from its target weight, after any slot of the mix (blocks of one row)."""
    taken = dict.fromkeys(weight, 0)
    worst = Fraction(0)
    for t, r in enumerate(sorted((r for r in rows if r.in_mix), key=lambda r: r.slot)):
        assert r.slot == t
        taken[r.source] += 1
        worst = max(worst, *(abs(taken[k] - weight[k] * (t + 1)) for k in weight))
    return worst


def test_mixing_deviation_and_brute_force(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = mixing.mix_sources(docs, alpha=0.5, block_rows=1).collect()
    assert len(got) == 3000
    share = {r.source: r.share for r in got}
    period = sum(share.values())
    count = Counter(r.source for r in got)
    roots = {k: n ** 0.5 for k, n in count.items()}
    assert all(abs(share[k] / period - roots[k] / sum(roots.values())) < 2e-9 for k in share)
    assert all(r.release <= r.slot < r.deadline and r.period == period for r in got)
    plan = {(k[1:], turn + 1): t for t, (k, turn) in enumerate(brute_schedule({"=" + k: v for k, v in share.items()}, 3000))}
    end = min(plan[k, n + 1] for k, n in count.items() if (k, n + 1) in plan)
    assert {(r.source, r.block): r.slot for r in got if r.in_mix} == {b: t for b, t in plan.items() if t < end}
    assert all(r.slot == r.deadline - 1 >= end for r in got if not r.in_mix)
    assert worst_deviation(got, {k: Fraction(v, period) for k, v in share.items()}) < 1


@pytest.mark.parametrize("weights, rows, slots", [({"a": 1, "b": 2, "c": 4}, 20000, 10000), ({"a": 0.0001, "b": 0.9999}, 30000, 10000),
                                                  ({"a": 1e-7, "b": 0.3, "c": 0.7}, 6000, 2500)])
def test_mixing_keeps_to_the_exact_target(spark, weights, rows, slots):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % len(weights) + 1).cast("int")).alias("source"))
    got = mixing.mix_sources(docs, weights=weights, block_rows=1).select("source", "slot", "in_mix").filter("in_mix").collect()
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    total = sum(exact.values())
    assert len(got) > slots * 0.85 and worst_deviation(got, {k: v / total for k, v in exact.items()}) < 1


def test_wrong_guesses_run_again(spark, monkeypatch):
    """Short stretches start in the middle of everything; the result is still that of one run."""
    monkeypatch.setattr(mixing, "STRETCH", 3)
    weight = {"a": 50, "b": 31, "c": 11, "d": 5, "e": 2, "f": 1}
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, weight)), (F.col("id") % 6 + 1).cast("int")).alias("source"))
    got = mixing.mix_sources(docs, weights=weight, block_rows=1).filter("in_mix").collect()
    plan = brute_schedule({"=" + k: v for k, v in weight.items()}, len(got))
    assert len(got) > 150 and {r.slot: (r.source, r.block) for r in got} == {t: (k[1:], turn + 1) for t, (k, turn) in enumerate(plan)}


def test_mixing_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("IF(id < 1000, 's0', concat('s', id % 50))").alias("source"))
    got = mixing.mix_sources(docs, alpha=0.5, block_rows=1).collect()
    share = {r.source: r.share for r in got}
    assert len(got) == 3000 and len({(r.source, r.block) for r in got}) == 3000 and len(share) == 50
    assert worst_deviation(got, {k: Fraction(v, sum(share.values())) for k, v in share.items()}) < 2


def test_mixing_given_weights_and_edges(spark):
    docs = edge_documents(spark)
    got = mixing.mix_sources(docs, weights={"a": 2, "b": 1, None: 1}, block_rows=1)
    assert got.count() == 11 and got.columns.count("share") == 1
    rows = got.collect()
    assert {(r.source, r.share, r.period) for r in rows} == {("a", 2, 4), ("b", 1, 4), (None, 1, 4), ("c", None, None)}
    assert all(r.slot is None and not r.in_mix for r in rows if r.source == "c")
    assert mixing.mix_sources(empty_documents(spark)).count() == 0
    assert mixing.mix_sources(docs, weights={"absent": 1}).filter("slot IS NULL AND NOT in_mix").count() == 11
    for wrong in ({"weights": {"a": 0}}, {"alpha": -1.0}):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, **wrong)
