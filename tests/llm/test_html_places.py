"""Templates are judged by the place of a text, not by the text alone."""

import random

import pytest

from lexiloom.llm import html_wrappers


def texts(spark, rows):
    return {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_shared_headlines_and_sentences_stay(spark):
    page = "<body><nav>menu</nav><article><h1>{h}</h1><p><b>{h}</b></p><p>Body {n} says something of its own</p><p>{last}</p></article><div>All rights kept</div></body>"
    heads, lasts = ["Same head", "Same head", "Other head"], ["We thank the reviewers.", "We thank the reviewers.", "The end."]
    got = texts(spark, [(i, "http://a.org/x", page.format(h=heads[i], n=i, last=lasts[i])) for i in range(3)])
    assert got == {i: f"{heads[i]}\n\n{heads[i]}\n\nBody {i} says something of its own\n\n{lasts[i]}" for i in range(3)}


def test_pages_that_are_versions_of_one_text_keep_it(spark):
    page = "<body><div class=box>Read our paper</div><article><h1>Head</h1><p>The first long paragraph of all versions</p><p>The second long paragraph of all versions</p><p>Version {n}</p></article></body>"
    got = texts(spark, [(i, "http://a.org/x", page.format(n=i)) for i in range(5)])
    assert got == {i: f"Head\n\nThe first long paragraph of all versions\n\nThe second long paragraph of all versions\n\nVersion {i}" for i in range(5)}


def test_class_words_in_articles_count_as_whole_elements():
    inside = '<article><h1>T</h1><div class="side effects">nausea</div><table class="menu"><tr><td>soup</td></tr></table><section class="social history">smoker</section><div class="share-box">share</div><div class="ad top">buy</div><div class="comments">nice</div><div id="related">more</div></article>'
    assert html_wrappers.main_text(inside) == "T\n\nnausea\n\nsoup\n\nsmoker\n\nbuy"
    assert html_wrappers.main_text('<body><div class="sidebar left">x</div><p>y</p></body>') == "y"


@pytest.mark.parametrize("seed", range(3))
def test_classless_pages_are_cleaned_by_alignment(spark, seed):
    rand, rows, want = random.Random(seed), [], {}
    words = lambda n: " ".join("".join(rand.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    menu, advert, foot = words(4), words(9), words(6)
    for i in range(8):
        body = [words(rand.randrange(8, 30)) for _ in range(rand.randrange(2, 6))]
        aside = f"<div>{advert}</div>" if rand.random() < 0.9 else ""
        html = f"<html><body><div><div>{menu}</div><div><div>{''.join(f'<p>{p}</p>' for p in body)}</div>{aside}</div><div>{foot}</div></div></body></html>"
        rows.append((i, "https://b.org/p", html))
        want[i] = "\n\n".join(body)
    assert texts(spark, rows) == want


def test_places_are_the_keys_down_to_a_block():
    root = html_wrappers.parse("<body><div class=a1><p>x</p></div><div class=a2><p>x</p></div><section><p>x</p></section></body>")
    found = list(html_wrappers.blocks([root]))
    assert [b.text for b in found] == ["x"] * 3 and found[0].known == found[1].known != found[2].known
    assert all(b.prose and not b.stays for b in found)
