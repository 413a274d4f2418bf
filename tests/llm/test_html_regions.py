"""Pages marked by hand: what the ratios choose, with and without an article, and how much of it is right."""

import time

import pytest

html_extract = pytest.importorskip("cellgauge.llm.html_extract")

P = [
    "The harbour was rebuilt in three years, and the town paid for it with a tax on salt that nobody had asked for.",
    "When the first ships came in, the old pilots stood on the wall and counted them, as they had counted every ship since they were boys.",
    "It took another ten years until the railway reached the quay, and by then half of the warehouses stood empty again.",
]
STORY = "".join(f"<p>{p}</p>" for p in P)
TEXT = "\n\n".join(P)
LINKS = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "Sport", "Contact"))
BLURB = "A much longer blurb of another story, which goes on and on so that the reader will want to follow the link and read about it, and then some more words to make it longer than the story that it stands beside."
# (name, html, text)
MARKED = [
    ("article", f"<body><nav><ul>{LINKS}</ul></nav><article><h1>Harbour</h1>{STORY}</article><footer><p>Imprint</p></footer></body>", f"Harbour\n\n{TEXT}"),
    ("div", f"<body><nav><ul>{LINKS}</ul></nav><div><h1>Harbour</h1>{STORY}</div><footer><p>Imprint</p></footer></body>", f"Harbour\n\n{TEXT}"),
    ("nested divs", f"<body><div id=w><div><ul>{LINKS}</ul></div><div id=c><div class=entry>{STORY}</div></div><div><a href=/>Imprint</a></div></div></body>", TEXT),
    ("table layout", f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>{STORY}</td></tr></table></body>", TEXT),
    ("title beside the body", f"<body><div class=post><h1>Harbour</h1><div class=meta>May</div><div class=body>{STORY}</div></div></body>", f"Harbour\n\n{TEXT}"),
    ("no-sidebar", f"<body class='no-sidebar'><article>{STORY}</article></body>", TEXT),
    ("right-sidebar", f"<body class='right-sidebar'><div class='right-sidebar'><div>{STORY}</div></div></body>", TEXT),
    ("ad-free", f"<body><article class='post ad-free'>{STORY}</article></body>", TEXT),
    ("share-holder", f"<body><div class='share-holder'>{STORY}</div></body>", TEXT),
    ("story and teaser", f"<body><article><h1>Harbour</h1><p>{P[0]}</p></article><article><h2>More</h2><p><a href=/x>read</a></p></article></body>", f"Harbour\n\n{P[0]}"),
    ("short story, long teaser", f"<body><article><h1>Harbour</h1><p>{P[0]}</p></article><aside class=related><article><h3>Other</h3><p>{BLURB}</p></article></aside></body>", f"Harbour\n\n{P[0]}"),
    ("comments", f"<body><article>{STORY}</article><section id=comments><h2>Comments</h2><article class=comment-body><p>{BLURB}</p></article></section></body>", TEXT),
    ("long comments", f"<body><div class=post><h1>T</h1><p>{P[0]}</p></div><div class=comments>{('<p>' + BLURB + '</p>') * 9}</div></body>", f"T\n\n{P[0]}"),
    ("cookie notice", f"<body><div class=cookie-banner><p>{BLURB}</p></div><main>{STORY}</main></body>", TEXT),
    ("short lines", f"<body><article><p>{P[0]}</p><p>No.</p><p>{P[1]}</p><ul><li>one</li><li>two</li></ul><blockquote>So.</blockquote></article></body>", f"{P[0]}\n\nNo.\n\n{P[1]}\n\none\n\ntwo\n\nSo."),
    ("sections", f"<body><div><section><h2>A</h2><p>{P[0]}</p></section><section><h2>B</h2><p>{P[1]}</p></section></div></body>", f"A\n\n{P[0]}\n\nB\n\n{P[1]}"),
    ("menu without nav", f"<body><ul>{LINKS}</ul>{STORY}<p><a href=/>Imprint</a></p></body>", TEXT),
    ("empty article", f"<body><article></article><div>{STORY}</div></body>", TEXT),
    ("main with sidebar", f"<body><main><div>{STORY}</div><div class=sidebar><p>{BLURB}</p></div></main></body>", TEXT),
    ("hidden", f"<body><div hidden><p>{BLURB}</p></div><div>{STORY}</div></body>", TEXT),
    ("form", f"<body><article>{STORY}<form><p>{BLURB}</p><input></form></article></body>", TEXT),
    ("links within", f"<body><div><p>{P[0]} <a href=/x>more of it</a></p><p>{P[1]}</p></div></body>", f"{P[0]} more of it\n\n{P[1]}"),
    ("long text", f"<body><div>{'<p>' + BLURB + '</p><p>So.</p>'}{('<p>' + BLURB + '</p>') * 3000}</div></body>", "\n\n".join([BLURB, "So."] + [BLURB] * 3000)),
    ("junk in divs", f"<body><div><a href=/>a</a> | <a href=/>b</a></div><div>Log in</div><div>{STORY}</div><div>Follow us</div><div>All rights reserved</div></body>", TEXT),
    ("junk in sections", f"<body><section><ul>{LINKS}</ul></section><section><p>Today</p><p>12 C</p><p>Rain</p></section><section>{STORY}</section><section><ul>{LINKS}</ul></section></body>", TEXT),
    ("junk in cells", f"<body><table><tr><td><p>1</p><p>2</p><p>3</p><td>{STORY}<td><a href=/>x</a><p>4</p><p>5</p></table></body>", TEXT),
    ("nothing", "<body><nav><a href=/>Home</a></nav></body>", ""),
]


@pytest.mark.parametrize("name, html, text", MARKED, ids=[m[0] for m in MARKED])
def test_marked(name, html, text):
    assert html_extract.main_text(html_extract.Lines(), html) == text


def overlap(got, want):
    got, want = got.split("\n\n") if got else [], want.split("\n\n") if want else []
    return sum(min(got.count(x), want.count(x)) for x in set(want)), len(got), len(want)


def scores():
    parser = html_extract.Lines()
    same, got, want = map(sum, zip(*(overlap(html_extract.main_text(parser, h), t) for _, h, t in MARKED if _ != "long text")))
    return same / got, same / want


def test_precision_and_recall():
    assert scores() == (1.0, 1.0)


@pytest.mark.parametrize("flag", [2, 0])
def test_clustering_decides(monkeypatch, flag):
    monkeypatch.setattr(html_extract, "content_lines", lambda ratios: [flag] * len(ratios))
    precision, recall = scores()
    assert precision < 0.9 or recall < 0.9


def test_article_or_not():
    """The same text comes out whether the region is called an article or not."""
    parser = html_extract.Lines()
    for name, html, text in MARKED:
        if html.count("<article>") == 1 and "teaser" not in name and "empty" not in name:
            plain = html.replace("<article>", "<div>").replace("</article>", "</div>")
            assert html_extract.main_text(parser, plain) == text, name


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 50_000 + "<p>text</p>" + "</div>" * 50_000, "<p>x" * 50_000, "<table>" + "<td>x" * 50_000, "<div>" * 50_000 + "<td>x" * 50_000, "<div>" * 50_000 + "</p></section></b>x" * 50_000,
        "<article>x" * 50_000, "<nav><p>x</p>" * 50_000, "<a>x" * 50_000, "<" * 500_000, "<div class='" + "a " * 200_000 + "'>x</div>", "<section><article><p>" + P[0] + "</p></article>" * 20_000,
    ],
    ids=range(11),
)
def test_linear(html):
    start = time.perf_counter()
    html_extract.main_text(html_extract.Lines(), html)
    assert time.perf_counter() - start < 5
