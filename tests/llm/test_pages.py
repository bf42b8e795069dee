"""Main text of pages written by hand, which the training pages' generator knows nothing of: lists, tables, captions, open elements."""

from minutewise.llm import html_main

PAGES = [
("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Harbour works delayed | Daily Ledger</title><link rel=stylesheet href=/s.css>
<body class="single post-template"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><a href="/" class="logo">Daily Ledger</a><nav class="main-navigation"><ul><li><a href="/news">News</a><li><a href="/sport">Sport</a><li><a href="/weather">Weather</a></ul></nav></header>
<div id="content" class="site-content"><main><article class="post"><h1 class="entry-title">Harbour works delayed until spring</h1>
<div class="entry-content"><p>The rebuilding of the outer harbour will not begin before <strong>April</strong>, the port authority said on Tuesday.
<p>Divers found cracks in two of the old piers; &ldquo;we have to look at all twelve now,&rdquo; its director said.</p>
<h2>What it costs</h2><p>The council had set aside 14&nbsp;million for the first stage.</p><ul><li>Nine million for the piers<li>Three million for dredging<li>Two million for the road</ul>
<table><tr><th>Stage<th>Year<tr><td>First<td>2025<tr><td>Second<td>2027</table>
<figure><img src=a.jpg><figcaption>The outer harbour in winter.</figcaption></figure><p>A public meeting takes place next week in the town hall.</p></div></article></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Most read</h2><ol><li><a href=/1>Ferry runs again</a><li><a href=/2>Storm warning for the coast</a></ol></section></aside></div>
<section id="comments" class="comments-area"><h2>2 comments</h2><ol class="comment-list"><li><p>They should have seen this years ago.</p><li><p>What about the fishing boats?</p></ol><form><label>Your comment <textarea></textarea></label><button>Post</button></form></section>
<footer id="colophon" class="site-footer"><p>&copy; 2024 Daily Ledger. All rights reserved.</p><ul><li><a href=/imprint>Imprint</a><li><a href=/privacy>Privacy</a></ul></footer></body></html>""",
["Harbour works delayed until spring","The rebuilding of the outer harbour will not begin before April, the port authority said on Tuesday.","Divers found cracks in two of the old piers; “we have to look at all twelve now,” its director said.","What it costs","The council had set aside 14 million for the first stage.","Nine million for the piers","Three million for dredging","Two million for the road","Stage","Year","First","2025","Second","2027","The outer harbour in winter.","A public meeting takes place next week in the town hall."]),
("""<html><head><title>How to prune an apple tree</title></head><body>
<div class="topbar"><div class="nav"><a href="/">Home</a> | <a href="/garden">Garden</a> | <a href="/tools">Tools</a></div></div>
<div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<div class="wrapper"><div class="story-body"><h1>How to prune an apple tree</h1><div class="ad-slot"><p>Great saws at half the price!</p></div>
<p>Prune in late winter, when the tree is at rest.</p><p>Take out dead wood first, then branches that cross.<br>Cut just above a bud that looks outwards.</p>
<blockquote>A tree forgives many cuts, but not a torn branch.</blockquote><ol><li>Clean the saw.</li><li>Cut from below first.</li><li>Finish from above.</li></ol>
<div class="newsletter"><h3>Get our newsletter</h3><form><input name=mail><button>Subscribe</button></form></div><p>Young trees need a light hand: leave three or four main branches.</p></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href="/p">Planting pears</a></li><li><a href="/c">When to cut cherries</a></li></ul></div></div>
<div class="footer">Copyright Garden Pages</div></body></html>""",
["How to prune an apple tree","Prune in late winter, when the tree is at rest.","Take out dead wood first, then branches that cross. Cut just above a bud that looks outwards.","A tree forgives many cuts, but not a torn branch.","Clean the saw.","Cut from below first.","Finish from above.","Young trees need a light hand: leave three or four main branches."]),
("""<html><body><nav><ul><li><a href="#">Start</a></li><li><a href="#">Archive</a></li><li><a href="#">About</a></li></ul></nav>
<article><header><h1>Notes on a small compiler</h1></header><p>The parser is written by hand and reads one token ahead.</p><pre>let x = 1;
let y = x + 2;</pre><p>Each node keeps the line it came from, so that errors can name it.<p>Types are checked in one pass; <code>let</code> without a type takes that of its value.</p>
<h3>Speed</h3><p>A file of ten thousand lines takes a fifth of a second.</p><footer>Posted in <a href=/t>languages</a></footer></article>
<aside><p>Read my other notes about parsers.</p></aside><footer><p>Made by hand.</p></footer></body></html>""",
["Notes on a small compiler","The parser is written by hand and reads one token ahead.","let x = 1; let y = x + 2;","Each node keeps the line it came from, so that errors can name it.","Types are checked in one pass; let without a type takes that of its value.","Speed","A file of ten thousand lines takes a fifth of a second."]),
("""<html><head><title>x</title></head><body><div><a href="/">Front page</a> <a href="/a">Politics</a> <a href="/b">Culture</a></div><div><h1>Museum opens new wing</h1><p>The new wing holds four hundred paintings of the last century.</p>
<p>It was built in three years, and visitors can enter free of charge on Sundays.</p><p>The first show is about light in northern landscapes, and runs until the end of June.</p></div>
<div><a href="/x">Opera season begins</a> <a href="/y">Book fair moves</a> <a href="/z">Film prize goes to newcomer</a></div><div>&copy; 2023 The Gazette, all rights reserved</div></body></html>""",
["Museum opens new wing","The new wing holds four hundred paintings of the last century.","It was built in three years, and visitors can enter free of charge on Sundays.","The first show is about light in northern landscapes, and runs until the end of June."]),
]


def test_main_text_of_hand_written_pages():
    field = html_main.trained_field()
    right = extra = lost = 0
    for page, want in PAGES:
        got, want = set(html_main.main_text(page, field).split("\n")), set(want)
        right, extra, lost = right + len(got & want), extra + len(got - want), lost + len(want - got)
    assert 2 * right / (2 * right + extra + lost) > 0.97
