"""Operator 2: its ratios against brute force, and pages on which a word or an element must not decide alone."""

import math
import random

import pytest

from millrace.llm.html_extract import content_blocks, path_ratios

FIRST = "This is the first paragraph, with commas, and it is long enough to be content of the page."
BODY = f"<p>{FIRST}</p><p>A second one follows; it has its own marks, and a good many words besides these.</p><p>Sh is.</p><p>The third goes on, as thirds do, and then it ends with a full stop.</p>"
NAV = "<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav>"


def test_path_ratios_match_brute_force():
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(1, 30)
        lengths, marks, path = [r.randint(1, 400) for _ in range(n)], [r.randint(0, 9) for _ in range(n)], [r.randrange(5) for _ in range(n)]
        rough = [[sum(x[k] for k in range(n) if path[k] == path[i]) / path.count(path[i]) for i in range(n)] for x in (lengths, marks)]
        kernel = {-1: math.exp(-0.5), 0: 1.0, 1: math.exp(-0.5)}
        smooth = [[sum(w * x[i + d] for d, w in kernel.items() if 0 <= i + d < n) / sum(w for d, w in kernel.items() if 0 <= i + d < n) for i in range(n)] for x in rough]
        want = [a * b for a, b in zip(*smooth)]
        want = want if any(want) else smooth[0]
        mean = sum(want) / n
        fused, bound = path_ratios(lengths, marks, path)
        assert fused == pytest.approx(want) and bound == pytest.approx(min(math.sqrt(sum((x - mean) ** 2 for x in want) / n), max(want)))


@pytest.mark.parametrize("around", ["<form id='aspnetForm'><div>{}</div></form>", "<div class='main-side'>{}</div>", "<div class='layout has-sidebar'>{}</div>", "<div title='the hidden truth'>{}</div>", "<fieldset>{}</fieldset>"])
def test_an_element_around_everything_is_kept(around):
    got = content_blocks(f"<body>{NAV}{around.format(BODY)}</body>")
    assert got[0] == FIRST and len(got) == 4


def test_small_print_beside_the_article_goes():
    assert len(content_blocks(f"<body>{NAV}<div>{BODY}</div><div><a>x</a><p>Copyright 2024.</p></div></body>")) == 4
    assert len(content_blocks(f"<body>{NAV}<div>{BODY}</div><form><label>Mail</label><p>Sign up, please.</p></form></body>")) == 4


def test_a_title_beside_the_body_and_an_introduction_stay():
    assert content_blocks(f"<body>{NAV}<div><h1>The title</h1><div>{BODY}</div></div></body>")[0] == "The title"
    intro = "An introduction that is long, and has commas, dots. And more of it, too."
    assert content_blocks(f"<body><article><section><p>{intro}</p></section><section>{BODY}</section></article></body>")[0] == intro


def test_an_advert_longer_than_a_short_article_goes():
    assert content_blocks(f"<body><div class='ad'><p>{FIRST}</p></div><article><h1>Short.</h1><p>So short.</p></article></body>") == ["Short.", "So short."]


def test_a_very_long_page():
    page = f"<body>{NAV}<article>" + f"<p>{FIRST}</p>" * 20_000 + "</article></body>"
    assert content_blocks(page) == [FIRST] * 20_000


def test_text_outside_every_element():
    assert content_blocks("Just text, without markup.") == ["Just text, without markup."]
    assert content_blocks("Before <b>bold</b><h1>Head.</h1>")[-1] == "Head."


PARAGRAPHS = [f"Paragraph {k} of the article says this, then that, and it goes on for a good while, as they do." for k in range(10)]


def page_with(attributes, tag="div"):
    part = lambda lo, hi: "".join(f"<p>{x}</p>" for x in PARAGRAPHS[lo:hi])
    return f"<body>{NAV}<article><h1>Title</h1>{part(0, 4)}<{tag} {attributes}>{part(4, 7)}</{tag}>{part(7, 10)}</article><footer>Foot, note.</footer></body>"


@pytest.mark.parametrize("name", ["side-effects", "related-work", "search-methods", "notice-period", "banner-history", "promo-code-analysis", "effects", "sideEffects"])
def test_a_part_of_a_name_takes_nothing_from_the_article(name):
    for attribute in (f"class='{name}'", f"id={name}", f'class="x {name} y"'):
        assert content_blocks(page_with(attribute)) == ["Title", *PARAGRAPHS]


def test_no_word_of_the_list_decides_alone():
    from millrace.llm.html_extract import _WORDS

    for word in sorted(_WORDS):
        assert content_blocks(page_with(f"class='{word}'")) == ["Title", *PARAGRAPHS], word
        assert content_blocks(page_with(f"class='{word}'", "section")) == ["Title", *PARAGRAPHS], word


def test_a_name_with_a_second_sign_goes():
    links = "".join(f"<li><a href={k}>Another story, with a comma, number {k}.</a></li>" for k in range(4))
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    assert content_blocks(f"<body><article>{body}<div class='related'><ul>{links}</ul></div><p>{FIRST}</p></article></body>") == [*PARAGRAPHS, FIRST]
    assert content_blocks(f"<body><article>{body}</article><div class='comments'><p>{FIRST}</p></div></body>") == PARAGRAPHS
    assert content_blocks(f"<body><article>{body}<div class='comment-list'><p>{FIRST}</p></div></article></body>") == PARAGRAPHS
    assert content_blocks(f"<body><article><p>{FIRST}</p><div role='complementary'><p>{FIRST}</p></div>{body}</article></body>") == [FIRST, *PARAGRAPHS]


def test_a_title_and_a_short_last_line_beside_the_body_stay():
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    assert content_blocks(f"<div><h1>Title</h1></div><div>{body}</div><div><p>Short end.</p></div>") == ["Title", *PARAGRAPHS, "Short end."]


def test_comments_of_unknown_class_go_by_their_shape_and_sections_stay():
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    said = "".join(f"<div class='r'><div><b>Reader {k}</b></div><p>I think this, and also that; who knows.</p></div>" for k in range(4))
    assert content_blocks(f"<body><article>{body}</article><section class='responses'>{said}</section></body>") == PARAGRAPHS
    assert content_blocks(f"<body><div>{body}<div class='responses'>{said}</div></div></body>") == PARAGRAPHS
    parts = "".join(f"<section class='part'><h2>Part {k}</h2><p>{PARAGRAPHS[k]}</p></section>" for k in range(4))
    assert len(content_blocks(f"<body><article>{body}{parts}</article></body>")) == 18


def test_a_slash_closes_no_element_that_has_content():
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    assert content_blocks(f"<body>{NAV}<div id=main/>{body}</div><footer>Foot.</footer></body>") == PARAGRAPHS


def test_selection_of_made_pages_matches_what_was_put_in():
    r = random.Random(9)
    for _ in range(40):
        texts = [f"Text {k}: " + ", ".join(r.choice(["some", "more", "other", "last"]) + " words here" for _ in range(r.randint(4, 14))) + "." for k in range(r.randint(4, 12))]
        parts, k = [], 0
        while k < len(texts):
            n = r.randint(1, 3)
            tag, name = r.choice([("div", "row"), ("section", "related-work"), ("div", "notice-period"), (None, "")])
            inner = "".join(f"<p>{x}</p>" for x in texts[k : k + n])
            parts.append(inner if tag is None else f"<{tag} class='{name}'>{inner}</{tag}>")
            k += n
        junk = r.choice(["", "<div class='ad'>Buy now.</div>", "<aside><p>Aside, this is.</p></aside>", "<form><input><p>Mail me.</p></form>"])
        assert content_blocks(f"<html><body>{NAV}{junk}<main><h1>Head</h1>{''.join(parts)}</main>{junk}<footer>f</footer></body></html>") == ["Head", *texts]
