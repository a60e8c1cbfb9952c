"""Pages shaped like those that blog software, news sites, shops' help pages and form-based sites make, and broken markup; each with its main text."""

import pytest

from wordvane.llm import html_extract

SAID = [
    "The harbour was quiet when the first boats came back, and nobody on the quay said much about the storm.",
    "Prices had gone up twice that year. Most of the crews had sold their second nets; some had sold the boats as well.",
    "In the evening the council met in the old school, where the heating had failed again, and voted to wait.",
    "It was the third time in a row that a vote to wait had passed by a single voice, the mayor's.",
    "What comes next depends on the ferry, on the price of diesel and on whether the cannery opens in spring.",
]
TEXT = " ".join(SAID)
PARAS = "".join(f"<p>{s}</p>\n" for s in SAID)
NAV = '<nav class="main-nav"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = '<footer class="site-footer"><p>&copy; 2024 Harbour Post. All rights reserved.</p><ul><li><a href="/terms">Terms</a></li></ul></footer>'
SIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ferry late again</a></li><li><a href="/2">Cannery for sale</a></li></ul></aside>'
COMMENTS = '<div id="comments" class="comments-area"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><p>Well said, I was there and it was just like that.</p></li><li class="comment"><p>The mayor ought to go at last.</p></li></ol></div>'
COOKIE = '<div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>'
HEAD = '<header class="site-header"><a href="/">Harbour Post</a><p>News from the coast</p></header>'
SEARCH = '<form class="search" action="/s"><label>Search</label><input name="q"><button>Go</button></form>'
AD = '<div class="advert"><p>Buy two nets and get one for free, only this week!</p></div>'


def page(body, attributes="", head="<title>Harbour</title><meta charset=utf-8>"):
    return f"<!DOCTYPE html><html lang=en><head>{head}</head><body{attributes}>{body}</body></html>"


TITLE = "<h1>A vote to wait</h1>"
WITH_TITLE = f"A vote to wait {TEXT}"
ARTICLE = f"<article>{TITLE}{PARAS}</article>"
SHAPES = {
    "plain": (page(HEAD + NAV + ARTICLE + SIDE + FOOT), WITH_TITLE),
    "body of a theme with sidebar": (page(HEAD + NAV + ARTICLE + SIDE + COMMENTS + FOOT, ' class="single single-post has-sidebar comments-open"'), WITH_TITLE),
    "body with fixed header": (page(HEAD + NAV + ARTICLE + FOOT, ' id="top" class="header-fixed nav-open"'), WITH_TITLE),
    "html with names": (page(NAV + ARTICLE + FOOT).replace("<html lang=en>", '<html class="no-ads with-sidebar">'), WITH_TITLE),
    "main with sidebar": (page(f'{NAV}<main class="has-sidebar">{ARTICLE}</main>{SIDE}{FOOT}'), WITH_TITLE),
    "one form around all": (page(f'<form method="post" action="/page.aspx" id="aspnetForm">{HEAD}{NAV}<div id="content">{TITLE}{PARAS}</div>{SIDE}{FOOT}</form>'), WITH_TITLE),
    "form around the article": (page(f"{NAV}<form>{ARTICLE}</form>{FOOT}"), WITH_TITLE),
    "page div with sidebar": (page(f'<div id="page" class="site with-sidebar">{HEAD}{NAV}<div class="entry-content">{PARAS}</div>{SIDE}</div>{FOOT}'), TEXT),
    "article-more": (page(f'{NAV}<div class="article-more">{PARAS}</div>{FOOT}'), TEXT),
    "message in the article": (page(f'{NAV}<article>{TITLE}{PARAS}<section class="message"><p>{SAID[0]}</p></section></article>{FOOT}'), f"{WITH_TITLE} {SAID[0]}"),
    "cookies first": (page(COOKIE + HEAD + NAV + ARTICLE + FOOT), WITH_TITLE),
    "search in the header": (page(HEAD + SEARCH + NAV + ARTICLE + FOOT), WITH_TITLE),
    "advert in the text": (page(f"{NAV}<article>{TITLE}<p>{SAID[0]}</p>{AD}" + "".join(f"<p>{s}</p>" for s in SAID[1:]) + f"</article>{FOOT}"), WITH_TITLE),
    "many comments": (page(HEAD + NAV + f"<article>{TITLE}<p>{SAID[0]}</p></article>" + COMMENTS * 4 + FOOT), f"A vote to wait {SAID[0]}"),
    "main and article": (page(f'{HEAD}{NAV}<main id="main">{ARTICLE}</main>{FOOT}'), WITH_TITLE),
    "section story": (page(f'{NAV}<section class="story">{TITLE}{PARAS}</section>{SIDE}{FOOT}'), WITH_TITLE),
    "post and entry": (page(f'{NAV}<div class="post hentry"><div class="entry-content">{TITLE}{PARAS}</div></div>{COMMENTS}{FOOT}'), WITH_TITLE),
    "quote and list": (page(f"{NAV}<article>{TITLE}{PARAS}<blockquote>{SAID[2]}</blockquote><ul><li>{SAID[3]}</li><li>{SAID[4]}</li></ul></article>{FOOT}"), f"{WITH_TITLE} {SAID[2]} {SAID[3]} {SAID[4]}"),
    "sub-headings": (page(f"{NAV}<article>{TITLE}<h2>Before</h2><p>{SAID[0]}</p><h2>After</h2><p>{SAID[1]}</p></article>{FOOT}"), f"A vote to wait Before {SAID[0]} After {SAID[1]}"),
    "links in the text": (page(f'{NAV}<article>{TITLE}<p>The <a href="/c">council</a> met in the old <b>school</b>, and voted to wait.</p>{PARAS}</article>{FOOT}'), f"A vote to wait The council met in the old school, and voted to wait. {TEXT}"),
    "unclosed paragraphs": (page(f"{NAV}<article>{TITLE}" + "".join(f"<p>{s}" for s in SAID) + f"</article>{FOOT}"), WITH_TITLE),
    "head left open": (f"<!DOCTYPE html><html><head><title>x</title><body>{NAV}{ARTICLE}{FOOT}", WITH_TITLE),
    "no body tag": (f"<title>x</title>{NAV}{ARTICLE}{FOOT}", WITH_TITLE),
    "upper case": (page(NAV + ARTICLE + FOOT).replace("article", "ARTICLE").replace("<p>", "<P>").replace("</p>", "</P>"), WITH_TITLE),
    "closed svg": (page(f"{NAV}<article>{TITLE}<svg viewBox='0 0 1 1'/>{PARAS}</article>{FOOT}"), WITH_TITLE),
    "open svg": (page(f"{NAV}<article>{TITLE}<svg><title>icon</title><path d='M0'/></svg>{PARAS}</article>{FOOT}"), WITH_TITLE),
    "short comments": (page(f"{NAV}<article>{TITLE}<!--><!---><!-- x --!>{PARAS}</article>{FOOT}"), WITH_TITLE),
    "script closed oddly": (page(f"{NAV}<script>if (a < b) '</p>'</script foo>{ARTICLE}<style>p > a {{}}</style\n>{FOOT}"), WITH_TITLE),
    "apostrophes in tags": (page(f"{NAV}<article>{TITLE}<p><a title=it's>The harbour</a> wasn't <b>quiet</b> at all, said the mayor's clerk.</p>{PARAS}</article>{FOOT}"), f"A vote to wait The harbour wasn't quiet at all, said the mayor's clerk. {TEXT}"),
    "angle in a value": (page(f'{NAV}<article data-x="a > b" data-y=\'"\'>{TITLE}{PARAS}</article>{FOOT}'), WITH_TITLE),
    "address with slash": (page(f"{NAV}<article>{TITLE}<p>See <a href=http://x.example/y/>the minutes</a> of the meeting, which are long.</p>{PARAS}</article>{FOOT}"), f"A vote to wait See the minutes of the meeting, which are long. {TEXT}"),
    "references": (page(f"{NAV}<article>{TITLE}<p>Fish &amp; chips cost &pound;9&nbsp;now, &#8220;too much&#8221;, they said.</p>{PARAS}</article>{FOOT}"), f"A vote to wait Fish & chips cost £9 now, “too much”, they said. {TEXT}"),
    "text alone": (TEXT, TEXT),
    "nothing": (page(""), ""),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    html, want = SHAPES[name]
    assert html_extract.main_text(html, html_extract.trained()) == want


def test_wrappers_leave_the_rest_out():
    """The text around a wrapped article stays out."""
    for name in ("body of a theme with sidebar", "one form around all", "main with sidebar"):
        found = html_extract.main_text(SHAPES[name][0], html_extract.trained())
        assert not any(x in found for x in ("Most read", "Harbour Post", "About us", "mayor ought"))
