"""Web pages written by hand, with their main text: layout -> (html, text)."""

P1 = "The harbour was rebuilt after the storm of 1911, when two piers and most of the warehouses were lost."
P2 = "Work took nine years. The council paid for it with a tax on coal, which was lifted only in 1934."
P3 = "Today the southern pier carries a tram line, and the old customs house is a museum with a small library."
P4 = "Visitors reach it by the coast road or by the ferry that calls twice a day from May to October."
SHORT = ["It rained.", "Nobody came.", "We left early.", "The road was wet."]
TEXT = f"{P1} {P2} {P3}"

MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'
FOOT = "&copy; 2019 Harbour Herald. All rights reserved. <a href='/terms'>Terms</a> <a href='/privacy'>Privacy</a>"


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>\n" for t in texts)


def page(body, head="<title>Harbour Herald</title>"):
    return f"<!DOCTYPE html>\n<html lang='en'><head><meta charset='utf-8'>{head}</head>\n<body>\n{body}\n</body></html>"


PAGES = {
    "article with nav and footer": (
        page(f"<header><a href='/'>Harbour Herald</a></header><nav>{MENU}</nav><article><h1>The new harbour</h1>{paragraphs(P1, P2, P3)}</article><footer>{FOOT}</footer>"),
        f"The new harbour {TEXT}",
    ),
    "layout table": (
        page(
            f"<table width='100%'><tr><td colspan='3'><a href='/'>Harbour Herald</a></td></tr><tr><td width='160'>{MENU}</td><td><h2>The new harbour</h2>{paragraphs(P1, P2, P3)}</td>"
            f"<td width='160'><a href='/ads'>Buy a boat</a><br><a href='/ads2'>Sell a boat</a></td></tr><tr><td colspan='3'>{FOOT}</td></tr></table>"
        ),
        f"The new harbour {TEXT}",
    ),
    "layout table without a menu": (
        page(f"<center><table border=0><tr><td><h1>The new harbour</h1>{paragraphs(P1, P2)}{paragraphs(P3, P4)}</td></tr></table></center>"),
        f"The new harbour {TEXT} {P4}",
    ),
    "aside inside the article": (
        page(f"<nav>{MENU}</nav><article><h1>The new harbour</h1>{paragraphs(P1)}<aside><p>Read also: how the old lighthouse was sold to a baker.</p></aside>{paragraphs(P2, P3)}</article><footer>{FOOT}</footer>"),
        f"The new harbour {TEXT}",
    ),
    "disqus box, no nav or footer": (
        page(f"<article><h1>The new harbour</h1>{paragraphs(P1, P2, P3)}<div id='disqus_thread'><p>Great read, thank you!</p><p>My grandfather worked on the second pier.</p></div></article>"),
        f"The new harbour {TEXT}",
    ),
    "disqus box after the article": (
        page(f"<article>{paragraphs(P1, P2, P3)}</article><div id='disqus_thread'><p>Great read, thank you!</p><p>My grandfather worked on the second pier.</p></div>"),
        TEXT,
    ),
    "div only, short paragraphs": (page(f"<div><div>{paragraphs(*SHORT)}</div></div>"), " ".join(SHORT)),
    "div only, with a menu": (page(f"<div id='top'>{MENU}</div><div><h1>A wet day</h1>{paragraphs(*SHORT)}{paragraphs(P4)}</div><div id='bottom'>{FOOT}</div>"), f"A wet day {' '.join(SHORT)} {P4}"),
    "paragraphs right in the body": (page(f"<h1>The new harbour</h1>{paragraphs(P1, P2, P3)}<hr><address>Written by the editors, <a href='mailto:e@x'>mail us</a></address>"), f"The new harbour {TEXT}"),
    "named divs": (
        page(
            f"<div id='header'><div class='logo'>Harbour Herald</div><div class='menu'>{MENU}</div></div><div id='content'><div class='post'><h2>The new harbour</h2>{paragraphs(P1, P2)}"
            f"<blockquote><p>{P3}</p></blockquote></div></div><div id='sidebar'><h3>Recent posts</h3><ul><li><a href='/1'>A wet day</a></li><li><a href='/2'>Ferry times</a></li></ul><p>Join our newsletter for more.</p></div><div id='footer'>{FOOT}</div>"
        ),
        f"The new harbour {TEXT}",
    ),
    "comments as a list": (
        page(
            f"<nav>{MENU}</nav><main><h1>The new harbour</h1>{paragraphs(P1, P2, P3)}<section class='comments'><h2>3 comments</h2><ol><li><p>anna</p><p>I remember the old warehouses well, they smelled of tar.</p></li>"
            f"<li><p>ben</p><p>So do I.</p></li><li><p>carl</p><p>The tram line closed in the end, did it not?</p></li></ol></section></main><footer><p>{FOOT}</p></footer>"
        ),
        f"The new harbour {TEXT}",
    ),
    "cookie notice, form and share box": (
        page(
            f"<div class='cookie-banner'><p>We use cookies to make this site better. By going on you agree to them.</p></div><nav>{MENU}</nav><article><h1>The new harbour</h1><div class='share'><a href='#'>Tweet</a> <a href='#'>Post</a></div>"
            f"{paragraphs(P1, P2)}<form action='/s'><p>Subscribe to our letter</p><label>Mail</label><input></form>{paragraphs(P3)}</article><footer>{FOOT}</footer>"
        ),
        f"The new harbour {TEXT}",
    ),
    "lists, code and a data table": (
        page(
            f"<nav>{MENU}</nav><article><h1>How to moor</h1><p>{P4}</p><ol><li>Slow down before the buoy.</li><li>Throw the line to the man on the pier.</li></ol><pre>tide = 4.2\nwind = 3</pre>"
            f"<table><tr><th>Pier</th><th>Depth</th></tr><tr><td>North</td><td>6 m</td></tr><tr><td>South</td><td>4 m</td></tr></table></article><footer>{FOOT}</footer>"
        ),
        f"How to moor {P4} Slow down before the buoy. Throw the line to the man on the pier. tide = 4.2 wind = 3 Pier Depth North 6 m South 4 m",
    ),
    "advert between paragraphs": (
        page(f"<nav>{MENU}</nav><div class='article-body'>{paragraphs(P1)}<div class='advert'>Advertisement: boats at half price, this week only!</div>{paragraphs(P2, P3)}</div><div class='related'><h4>More stories</h4><ul><li><a href='/a'>Tax on coal</a></li><li><a href='/b'>Tram</a></li></ul></div><footer>{FOOT}</footer>"),
        TEXT,
    ),
    "no article": (page(f"<nav>{MENU}</nav><form><input name='q'><button>Search</button></form><footer>{FOOT}</footer>"), ""),
    "section of sections": (
        page(f"<div class='topbar'><a href='/login'>Log in</a></div><section><section><h2>The new harbour</h2>{paragraphs(P1, P2)}</section><section><h3>Getting there</h3>{paragraphs(P4)}</section></section><div class='footer'><p>{FOOT}</p></div>"),
        f"The new harbour {P1} {P2} Getting there {P4}",
    ),
}

#: Written after the labelled pages were laid out for good, and not used to change them.
FRESH = {
    "blog with tags and byline": (
        page(
            f"<div class='site-header'><h1><a href='/'>Harbour Herald</a></h1><p>News since 1890</p></div><div class='navbar'>{MENU}</div><div class='entry'><h2>The new harbour</h2><div class='byline'>By Ann Lee, 3 May</div>"
            f"{paragraphs(P1, P2, P3)}<div class='tags'><a href='/t/1'>harbour</a>, <a href='/t/2'>history</a></div></div><div id='comments'><h3>Comments</h3><div class='comment'><b>anna</b><p>They smelled of tar.</p></div></div><div id='footer'>{FOOT}</div>"
        ),
        f"The new harbour {TEXT}",
    ),
    "nested layout tables": (
        page(f"<table><tr><td><table><tr><td>{MENU}</td></tr></table></td><td><table><tr><td><h1>The new harbour</h1>{paragraphs(P1, P2, P3, P4)}</td></tr></table></td></tr></table><p>{FOOT}</p>"),
        f"The new harbour {TEXT} {P4}",
    ),
    "long list article": (
        page(f"<nav>{MENU}</nav><main><article><h1>Ten piers</h1><p>{P1}</p><ul>{''.join(f'<li>Pier {k} was built in {1880 + k} and is open to all.</li>' for k in range(10))}</ul></article></main><footer>{FOOT}</footer>"),
        f"Ten piers {P1} " + " ".join(f"Pier {k} was built in {1880 + k} and is open to all." for k in range(10)),
    ),
    "text with line breaks": (page(f"<div id='nav'>{MENU}</div><div id='main'><h1>The new harbour</h1>{P1}<br><br>{P2}<br><br>{P3}</div><div id='foot'>{FOOT}</div>"), f"The new harbour {TEXT}"),
    "notice at the end, figure": (
        page(f"<header>{MENU}</header><article><h1>The new harbour</h1><figure><img src='a.jpg'><figcaption>The pier in 1911</figcaption></figure>{paragraphs(P1, P2)}</article><div class='newsletter'><h3>Stay in touch</h3><p>Get a letter a week.</p></div><footer>{FOOT}</footer>"),
        f"The new harbour The pier in 1911 {P1} {P2}",
    ),
    "replies in divs without names": (
        page(f"<article><h1>The new harbour</h1>{paragraphs(P1, P2, P3)}</article><section id='replies'><div><p>anna</p><p>They smelled of tar.</p></div><div><p>ben</p><p>So they did, all summer long.</p></div></section>"),
        f"The new harbour {TEXT}",
    ),
    "question and definition list": (
        page(f"<nav>{MENU}</nav><section class='content'><h1>Terms of the sea</h1><dl><dt>Pier</dt><dd>{P3}</dd><dt>Buoy</dt><dd>{P4}</dd></dl></section><aside><a href='/1'>A wet day</a></aside><footer>{FOOT}</footer>"),
        f"Terms of the sea Pier {P3} Buoy {P4}",
    ),
}
