"""Page text against pages written by hand, and odd or hostile markup."""

import time

import pytest

from sparkloom.llm import html_text


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def runs(source):
    forest = html_text.Forest()
    forest.read(0, source)
    return [t for t in forest.text if t]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p title=it's>Hello <b>you</b></p><p>more 'q'</p>", ["Hello you", "more 'q'"]),
        ("<p a=\"x>y\" b='>'>in</p><!-- c > --><p>2<!-->3<!---->4</p></>5<?x?>", ["in", "234", "5"]),
        ("a < b <<i>c</i> & d&lt;e", ["a < b <c & d<e"]),
        ("<p>one<p>two<div>three<p>four</div>five", ["one", "two", "three", "four", "five"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<p>x<a href=q>y<a href=r>z</a></p>tail", ["xyz", "tail"]),
        ("<script>if (a < b) { '</p>' }</script>x<style>p{}</style>", ["x"]),
        ("<p class=a/>text<br/>more<img src='a'/>!", ["text more !"]),
        ("text<p unfinished='", ["text"]),
        ("<body =\"'>x</body>", ["x"]),
        ("<textarea><p>no</textarea>yes", ["yes"]),
        ("<option>a<select><option>b</select>c", ["ac"]),
        ("\x00<p>  nb sp \U0001f600</p>", ["\x00", "nb sp \U0001f600"]),
    ],
)
def test_markup(source, want):
    assert runs(source) == want


@pytest.mark.parametrize(
    "source",
    [
        "<a " * 330_000, "<!--" * 250_000, "<p x='" * 160_000, "</" * 500_000, "<" * 1_000_000, "<div>" * 100_000 + "</p>" * 100_000,
        "<p><td>" + "<b>" * 100_000 + "<h1></h1>" * 50_000, "<svg>" * 100_000 + "<h1></h1>" * 50_000, '<a b="' * 150_000, "<a =\"'>" * 100_000, "<a class" + " " * 900_000 + "x",
    ],
)
def test_time_follows_the_length(source):
    begin = time.process_time()
    runs(source)
    assert time.process_time() - begin < 4


TEXT = (
    "The river rises every spring, and the villages along it have learned to build on stilts.",
    "In the old market, traders still weigh grain by hand, as their grandparents did before the war.",
    "Nobody expected the bridge to last a century, yet engineers found its piers sound last year.",
    "A new road would bring tourists, the mayor says, but many fear that it would also bring noise.",
)

#: Pages in layouts that no generator here makes, and their main text.
PAGES = [
    (
        f"""<!doctype html><html lang=en><head><title>River towns</title><meta name=viewport content="width=device-width">
        <body class="post-template"><div id="masthead"><a href="/">Daily Ledger</a> <span>Est. 1902</span></div>
        <div class="navbar"><ul><li><a href=/w>World</a><li><a href=/s>Sport</a><li><a href=/c>Culture</a></ul></div>
        <div class="post-content"><h1>River towns</h1><p>{TEXT[0]}<p>{TEXT[1]}<blockquote>{TEXT[2]}</blockquote><p>{TEXT[3]}</div>
        <div class="sidebar"><h3>Most read</h3><ul><li><a href=1>Ten soups</a><li><a href=2>Rain again</a></ul></div>
        <div id="footer">&copy; 2020 Daily Ledger. <a href=/p>Privacy</a></div></body></html>""",
        ["River towns", TEXT[0], TEXT[1], TEXT[2], TEXT[3]],
    ),
    (
        f"""<html><body><header role="banner"><h2><a href="/">Notes</a></h2><nav><a href="/a">About</a> | <a href="/b">Archive</a></nav></header>
        <main id="main"><article class="hentry"><header><h1 class="entry-title">On bridges</h1></header><div class="entry-content"><p>{TEXT[2]}</p>
        <ul><li>piers of stone</li><li>decks of oak</li></ul><p>{TEXT[3]} See <a href="/x">the plans</a> for more, if you like.</p></div></article>
        <section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p>Great read, thanks!</p></div><div class="comment"><p>I disagree with all of it, sorry.</p></div></section></main>
        <aside class="widget"><p>Subscribe to our newsletter for updates.</p><form><input name=e><button>Sign up</button></form></aside>
        <footer><p>All rights reserved.</p></footer></body></html>""",
        ["On bridges", TEXT[2], "piers of stone", "decks of oak", f"{TEXT[3]} See the plans for more, if you like."],
    ),
    (
        f"""<body><div class="cookie-banner"><p>We use cookies. <button>Accept</button></p></div><div class=page><div class="breadcrumbs"><a href=/>Home</a> &rsaquo; <a href=/t>Travel</a></div>
        <div class="story-body"><h1>Stilts &amp; grain</h1><p>{TEXT[0]}</p><div class="ad">Advertisement: buy now!</div><p>{TEXT[1]}</p><h2>What next?</h2><p>{TEXT[3]}</p></div>
        <div class="related"><h4>Related</h4><a href=3>A tale of two mills</a><a href=4>Winter ferries</a></div></div><script>var x = "<p>not text</p>"</script>""",
        ["Stilts & grain", TEXT[0], TEXT[1], "What next?", TEXT[3]],
    ),
]


@pytest.mark.parametrize(("source", "want"), PAGES)
def test_pages_written_by_hand(model, source, want):
    got = html_text.main_texts(model, [source])[0].split("\n")
    both = set(got) & set(want)
    assert len(both) >= len(want) - 1 and len(both) >= len(got) - 1
    assert [t for t in got if t in both] == [t for t in want if t in both]
