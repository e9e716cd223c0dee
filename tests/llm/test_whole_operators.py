"""The training-data operators over the whole job: what was cut before."""

import random
import string
import time

import numpy as np
import public_tokenizers
import pytest

from loomwright.llm import html_text, jaccard_join, secret_scan
from tests.llm.test_llm import brute_components

LONG = "A sentence, of some length; with marks, more marks, and an end. " * 8


def test_html_keeps_all_of_the_article():
    title = "A title of about forty characters, yes it"
    flat = f"{title}\n\n{LONG.strip()}\n\n{LONG.strip()}"
    body = f"<h1>{title}</h1><div><p>{LONG}</p><p>{LONG}</p></div>"
    menu, foot = "<nav><a href=x>Home</a></nav>", "<footer>End of it.</footer>"
    assert html_text.main_text(f"<body>{menu}<article>{body}</article>{foot}</body>") == flat
    assert html_text.main_text(f"<body>{menu}<main><h1>{title}</h1><article><p>{LONG}</p><p>{LONG}</p></article></main></body>") == flat
    assert html_text.main_text(f"<body>{menu}<div id=a>{body}</div>{foot}</body>") == flat
    listed = f"<p>Short.</p><ul><li>{LONG}</li><li>{LONG}</li></ul>"
    for tag in ("article", "div"):
        assert html_text.main_text(f"<body><{tag}>{listed}</{tag}></body>") == f"Short.\n\n{LONG.strip()}\n\n{LONG.strip()}"
    assert "Other" not in html_text.main_text(f"<body><p>Other</p><article>{body}</article></body>")


def test_html_class_words_do_not_remove_the_article():
    one = f"<p>{LONG}</p>"
    for page in (
        f"<div class='content-with-sidebar'><article>{one}</article></div>",
        f"<div class='page-sidebar-right'><div class='site-header-fixed'>{one}</div><div class=sidebar>Links.</div></div>",
        f"<article class='post comments-open'>{one}</article>",
        f"<p>Intro.</p><div class='layout-sidebar'><main>{one}</main></div>",
    ):
        assert html_text.main_text(f"<body>{page}</body>") == LONG.strip(), page
    comments = f"<div class=post><p>Short.</p></div><div class=comments><article>{one}</article></div>"
    assert html_text.main_text(f"<body>{comments}</body>") == "Short."
    assert html_text.main_text(f"<body><div class=comments>{one}</div></body>") == ""
    assert html_text.main_text(f"<body><div class='sidebar' hidden>{one}</div></body>") == ""
    assert isinstance(html_text.main_text("<div class=sidebar>" * 3000 + LONG), str)


def test_html_class_words_inside_the_article():
    head = '<div class="article-header"><h1>Head</h1></div>'
    body = f'{head}<p>{LONG}</p><p class="related-work">Related work.</p><div class="comments"><p>{LONG}</p></div><div class="ad">Buy.</div>'
    assert html_text.main_text(f"<body><div class=header><h2>Site</h2></div><article>{body}</article></body>") == f"Head\n\n{LONG.strip()}\n\nRelated work."
    assert html_text.main_text(f"<article><div class=header>By the staff</div><p>{LONG}</p></article>") == LONG.strip()


def test_html_in_linear_time():
    for piece in ("<h1>", "<h1>x", "<div>x", "<span>x", "<ul><li>x", "<p>x", "</div>", "<div class=ad>x", "<article><h1>x"):
        began = time.process_time()
        assert isinstance(html_text.main_text(piece * (1_000_000 // len(piece))), str)
        assert time.process_time() - began < 6, piece


def test_html_frame_with_odd_rows(spark):
    rows = [(1, "<p>One.</p>", "t", 5), (1, "<p>One.</p>", "t", 5), (2, "", "t", 5), (3, "<article>" + f"<p>{LONG}</p>" * 2000, "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, html string, block string, path int")
    got = html_text.extract(df)
    assert got.columns == [*df.columns, "text"] and got.where("text = 'One.'").count() == 2 and html_text.extract(df.limit(0)).count() == 0
    assert got.where("page_id = 3").first().text.count("\n\n") == 1999


def test_secret_candidates_are_whole():
    r = random.Random(6)
    pick = lambda n, extra="": "".join(r.choice(string.ascii_letters + string.digits + extra) for _ in range(n))
    span = lambda text: [(text[s:e], k) for s, e, k in secret_scan.candidates(text)]
    for n in (20, 198, 201, 360, 5000):
        key = pick(n - 2, "+/") + "a1"
        assert span(f"see {key} there") == [(key, "opaque")]
        assert span(f'token="{key}" there') == [(key, "assigned")]
    late = "a" * 300 + "1"
    assert span(f"see {late} there") == [(late, "opaque")]
    for lead, kind in (("xoxb-", "slack_token"), ("sk_live_", "stripe_key")):
        key = lead + pick(300)
        assert span(f"see {key} there") == [(key, kind)]
    body = "\n".join(pick(64, "+/") for _ in range(25)) + "\nQ1=="
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    assert span(f"see {pem} there") == [(pem, "private_key")]
    cut = pem[: pem.index("\nQ1")]
    assert span(f"{cut} {cut}") == [(cut, "private_key")] * 2
    assert span("see -----BEGIN PRIVATE KEY----- there") == [("-----BEGIN PRIVATE KEY-----", "private_key")]
    words = secret_scan.dictionary(public_tokenizers.path("word_bpe_49k.json"))
    forest = secret_scan.fit_forest(secret_scan.sample_findings(), words)
    texts = [pem, f'token="{pick(900)}"', "sha256 " + "".join(r.choice("0123456789abcdef") for _ in range(400))]
    assert [f[0][4] >= secret_scan.THRESHOLD for f in secret_scan.judge(forest, words, [""] * 3, texts)] == [True, True, False]


def test_secret_candidates_in_linear_time():
    for piece in ("a", "-----BEGIN PRIVATE KEY-----\n", "a1", "-", "token", "eyJ"):
        began = time.process_time()
        secret_scan.candidates(piece * (400_000 // len(piece)))
        assert time.process_time() - began < 3, piece


def just_under(percent, rows, k):
    """Copies of one text of which most pairs lie around the threshold, and a few repeats."""
    r = random.Random(percent)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(rows):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice([1, 1, 2, 2, 3]) if percent == 90 else r.choice([1, 2, 3, 4])):
            w[at] = f"x{i}n{at}"
        texts.append(" ".join(w))
    return texts + texts[:20] + [" ".join(base[:60])]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join_of_a_family_around_the_threshold(spark, k, percent):
    texts = just_under(percent, 500, k)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(jaccard_join.similar_classes(rows, k, percent).collect(), key=lambda x: x.doc_id)
    sizes, found = brute_components(texts, k, percent)
    assert [x.n_shingles for x in got] == sizes
    assert [x.component_id for x in got] == found
    assert 2 < len(set(found)) < 500  # neither one component nor none


def test_jaccard_frequencies_order_the_shingles(spark):
    texts = ["a b c d e f", "a b c d e g", "a b c x y z", "a b c"] * 3 + ["u v w x y"]
    rows = spark.createDataFrame([(i, t, i % 4) for i, t in enumerate(texts)], "doc_id long, text string, chunk int")
    table = jaccard_join._profile(rows, jaccard_join._frequencies(rows, 3, 4), 3, 90, 4)
    posted = {r.doc_id: len(r.tokens) for r in table.where("tokens IS NOT NULL").collect()}
    assert 12 not in posted and set(posted) == {0, 1, 2, 3}  # one of equal sets, none without a shared shingle
    s = jaccard_join.shingles("a b c d e f", 3)
    l, where = jaccard_join.prefix(s, np.array([3, 0, 2, 1]), 90)
    assert where.tolist() == [1, 3, 2, 0][:l]
    assert np.bitwise_count((jaccard_join.parity(s) ^ jaccard_join.parity(s[:2])).view(np.uint64)).sum() <= 2
