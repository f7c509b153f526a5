"""Main text of layouts written by hand, none of them drawn from the training pages' generator."""

import random
import re

import pytest

from complaintflow.llm import html_text

RIVER = ["The river rose again on Monday, and the town, which had hardly dried out, moved its pumps back to the old bridge.",
         "Nobody was hurt, the mayor said, although two families had to leave their houses in the night.",
         "Engineers had warned in spring that the dam, built in 1931, would not hold a second flood, and asked for money to mend it.",
         "The council meets on Thursday. It has to decide whether the lower road is given up, as many have asked for years."]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in RIVER)
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/c>Culture</a></li></ul>"
COOKIE = "We use cookies to make this site better. By going on you agree to our terms."
FOOT = "&copy; 2024 The Valley Post. All rights reserved. <a href=/imprint>Imprint</a> <a href=/privacy>Privacy</a>"
TITLE = "Second flood in a year"

LAYOUTS = {
    "listed words on the article": f"<body><nav>{MENU}</nav><article class='post social-side-story'><h1>{TITLE}</h1>{PARAGRAPHS}</article><footer>{FOOT}</footer></body>",
    "names never met": f"<body><div class='gl-hd'>{MENU}</div><div class='zz3'><h1>{TITLE}</h1>{PARAGRAPHS}</div><div class='qx'>{FOOT}</div></body>",
    "no attributes at all": f"<body><div>{MENU}</div><div><h1>{TITLE}</h1>{PARAGRAPHS}</div><div>{FOOT}</div></body>",
    "deep wrappers": f"<body><div><div><div class=a1>{MENU}</div><div class=a2><div><div class=a3><h1>{TITLE}</h1>{PARAGRAPHS}</div></div></div></div></div><footer>{FOOT}</footer></body>",
    "main element": f"<body><header><a href=/>The Valley Post</a></header><main><h1>{TITLE}</h1>{PARAGRAPHS}</main><footer>{FOOT}</footer></body>",
    "sections": f"<body><nav>{MENU}</nav><main><section><h1>{TITLE}</h1>{PARAGRAPHS[:len(PARAGRAPHS) // 1]}</section></main><footer>{FOOT}</footer></body>",
    "cookie notice first": f"<body><div class=cookie-consent><p>{COOKIE}</p></div><nav>{MENU}</nav><article><h1>{TITLE}</h1>{PARAGRAPHS}</article></body>",
    "notice in a dialog": f"<body><dialog class=consent-layer><p>{COOKIE}</p></dialog><article class=news-text><h1>{TITLE}</h1>{PARAGRAPHS}</article><footer>{FOOT}</footer></body>",
    "aside beside it": f"<body><nav>{MENU}</nav><article><h1>{TITLE}</h1>{PARAGRAPHS}</article><aside><h3>Read on</h3>{MENU}</aside></body>",
    "form in it": f"<body><article><h1>{TITLE}</h1>{PARAGRAPHS}<form class=newsletter><p>Get our letter every day.</p><input name=m></form></article><footer>{FOOT}</footer></body>",
    "advert in it": f"<body><nav>{MENU}</nav><article><h1>{TITLE}</h1>{PARAGRAPHS}<div class=advert>Buy two boats and pay one.</div></article></body>",
    "comments below": f"<body><article><h1>{TITLE}</h1>{PARAGRAPHS}</article><section class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>I was there, too.</p></div><div class=comment><b>Bob</b><p>Never again.</p></div></section></body>",
    "opinions in it": f"<body><article><h1>{TITLE}</h1>{PARAGRAPHS}<section id=reader-opinions><h3>What readers say</h3><div><b>Ann</b><p>I was there, too.</p></div><div><b>Bob</b><p>Never again.</p></div></section></article></body>",
    "comment list in it": f"<body><article><h1>{TITLE}</h1>{PARAGRAPHS}<ol class=comment-list><li>I was there, too.</li><li>Never again.</li></ol></article></body>",
    "upper case tags": f"<BODY><NAV>{MENU}</NAV><ARTICLE><H1>{TITLE}</H1>{PARAGRAPHS}</ARTICLE><FOOTER>{FOOT}</FOOTER></BODY>",
    "unclosed paragraphs": f"<body><nav>{MENU}</nav><article><h1>{TITLE}</h1>{PARAGRAPHS.replace('</p>', '')}</article><footer>{FOOT}</footer></body>",
    "identifiers": f"<body><div id=navigation>{MENU}</div><div id=story><h1>{TITLE}</h1>{PARAGRAPHS}</div><div id=copyright>{FOOT}</div></body>",
    "camel case": f"<body><div class=topMenu>{MENU}</div><div class=articleBody><h1>{TITLE}</h1>{PARAGRAPHS}</div><div class=pageFooter>{FOOT}</div></body>",
    "roles": f"<body><div role=navigation>{MENU}</div><div role=main><h1>{TITLE}</h1>{PARAGRAPHS}</div><div role=contentinfo>{FOOT}</div></body>",
    "scripts between": f"<body><nav>{MENU}</nav><article><h1>{TITLE}</h1><script>var p = '<p>no</p>';</script>{PARAGRAPHS}<style>p {{}}</style></article><footer>{FOOT}</footer></body>",
    "nested columns": f"<body><div class=row><div class=col-3>{MENU}</div><div class=col-9><h1>{TITLE}</h1>{PARAGRAPHS}</div></div><div class=bottom>{FOOT}</div></body>",
    "unknown names in shell tags": f"<body><header class=k1><a href=/>Post</a></header><nav class=k2>{MENU}</nav><section class=k3><h1>{TITLE}</h1>{PARAGRAPHS}</section><footer class=k4>{FOOT}</footer></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    assert html_text.main_texts([LAYOUTS[name]], html_text.model()) == ["\n\n".join([TITLE, *RIVER])]


def test_pages_without_tags_and_without_an_article():
    plain, empty = html_text.main_texts([" ".join(RIVER) + " &amp; more", f"<body><nav>{MENU}</nav><footer>{FOOT}</footer></body>"], html_text.model())
    assert plain == " ".join(RIVER) + " & more" and empty == ""


def share(generator, change):
    trees, right, wrong = html_text.model(), 0, 0
    for _ in range(150):
        source = change(generator.page())
        page = html_text.Page(source)
        want = {t for i, t in page.segments if page.main[i]}
        got = set(html_text.main_texts([source.replace(' data-main="1"', "")], trees)[0].split("\n\n")) - {""}
        right, wrong = right + len(want & got), wrong + len(want ^ got)
    return right / (right + wrong)


def test_generated_layouts_with_names_never_met():
    rng = random.Random(99)
    named = lambda m: f'{m[1]}="zz{rng.randrange(9)}"'
    assert share(html_text.Generator(99), lambda s: re.sub(r"""(class|id)=(?:"[^"]*"|'[^']*')""", named, s)) > 0.85


def test_the_trees_use_what_tokens_mean():
    trees = html_text.model()
    told = [html_text.crc32(t) % html_text.TOKENS for t in (b"comment", b"nav", b"cookie", b"content", b"story")]
    assert (trees.meaning[told[:3]] < -2).all() and (trees.meaning[told[3:]] > 1).all()
    body = f"<p>{RIVER[0]}</p><p>{RIVER[1]}</p>"
    texts = html_text.main_texts([f"<div class={c}>{body}</div><div class=story><h1>{TITLE}</h1>{PARAGRAPHS}{PARAGRAPHS}</div>" for c in ("cookie", "content")], trees)
    assert texts[1].count(RIVER[0]) == 3 and texts[0].count(RIVER[0]) == 2
