"""Pages written by hand in the manner of different sites, with the text that a reader would keep."""

A = "The council met on Tuesday evening, and after two hours of debate it voted for the plan."
B = "Nobody expected the vote to be so close; four members changed their minds, as they said, at the last moment."
C = "Work on the bridge will start in spring, if the weather allows it, and should end within two years."
D = "Costs are shared by the town and the region, which pay a third and two thirds of the sum."


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


GOLD = [
    # a plain article whose class has an unlucky word
    (f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
     f"<article class='post comment-count'><h1>Bridge approved</h1>{p(A, B)}</article></body></html>",
     ["Bridge approved", A, B]),
    # a linked list inside the article
    (f"<article><h1>Three things to know</h1>{p(A)}<ul><li><a href=a>The vote was close</a></li>"
     f"<li><a href=b>Work starts in spring</a></li></ul>{p(B)}</article>",
     ["Three things to know", A, "The vote was close", "Work starts in spring", B]),
    # a weblog of nested divs
    (f"<body class=home><div id=page><div id=masthead><a href=/>My weblog</a></div><div id=content class=has-sidebar>"
     f"<div class='entry hentry'><h2>A new bridge</h2>{p(A, B, C)}</div></div><div id=sidebar><h3>Archive</h3><ul>"
     f"<li><a href=1>May</a></li><li><a href=2>June</a></li></ul></div><div id=footer>Copyright me, all rights kept.</div></div>",
     ["A new bridge", A, B, C]),
    # comments below and a form
    (f"<main><article><h1>Council news</h1>{p(A, C)}</article><section class=comments><h3>2 comments</h3>"
     f"<div class=comment><b>Ann</b><p>I never liked the old bridge, so this is good news for all of us here.</p></div>"
     f"<div class=comment><b>Bo</b><p>And who is going to pay for all of that, I wonder, if not we ourselves?</p></div>"
     f"</section><form><label>Your name</label><input><button>Send</button></form></main>",
     ["Council news", A, C]),
    # adverts and a notice between paragraphs
    (f"<div class=cookie-banner><p>We use cookies to give you the best experience on our site.</p><button>OK</button></div>"
     f"<div class=article-body><h1>Spring start</h1>{p(C)}<div class='ad adsense'><p>Buy two shoes and pay for one, only today!</p></div>"
     f"{p(D)}<aside class=related><a href=x>Also read this</a></aside>{p(A)}</div>",
     ["Spring start", C, D, A]),
    # headings, quotations, a table
    (f"<header class=site-header><a href=/><img src=l.png>Gazette</a></header><article><h1>Who pays</h1>{p(D)}<h2>The shares</h2>"
     f"<table><tr><th>Town</th><td>one third</td></tr><tr><th>Region</th><td>two thirds</td></tr></table>"
     f"<blockquote><p>{B}</p></blockquote></article><footer><p>Gazette, Main Street 1</p></footer>",
     ["Who pays", D, "The shares", "Town one third", "Region two thirds", B]),
    # unclosed paragraphs and upper-case tags
    (f"<HTML><BODY><DIV CLASS=nav><A HREF=a>One</A> <A HREF=b>Two</A></DIV><ARTICLE><H1>Old style</H1><P>{A}<P>{B}"
     f"</ARTICLE></BODY></HTML>", ["Old style", A, B]),
    # references, line breaks, inline marks
    (f"<article><h1>Caf&eacute; &amp; bar</h1><p>It <i>opened</i> in&nbsp;May,<br>and it <b>closed</b> in June, as &lt;expected&gt;.</p>"
     f"{p(C)}</article><script>var a = '<p>no</p>';</script>",
     ["Café & bar", "It opened in May, and it closed in June, as <expected>.", C]),
    # share buttons and a newsletter box inside the article
    (f"<article class='story share-enabled'><h1>Close vote</h1><div class=social-share><a href=t>Tweet</a> <a href=f>Share</a></div>"
     f"{p(B, C)}<div class='newsletter signup'><form><label>Subscribe to our letter</label><input type=email></form></div></article>",
     ["Close vote", B, C]),
    # sections of a long read
    (f"<body><div class=topbar>Today: rain</div><main id=main><section><h2>Before</h2>{p(A)}</section><section><h2>After</h2>"
     f"{p(B, D)}</section></main><div class=pagination><a href=1>1</a> <a href=2>2</a></div></body>",
     ["Before", A, "After", B, D]),
    # class words of a theme on the body and the wrappers
    (f"<body class='nav-open no-sidebar'><div class='site header-fixed'><div class='content-area'><article class='post'>"
     f"<h1>Theme</h1>{p(A, D)}</article></div></div></body>", ["Theme", A, D]),
    # breadcrumbs, tags and related links
    (f"<ul class=breadcrumb><li><a href=/>Home</a></li><li><a href=/c>City</a></li></ul><article><h1>City</h1>{p(A, B)}</article>"
     f"<div class='tags widget'><a href=1>bridge</a> <a href=2>council</a></div><div class=related-posts><h3>More</h3><ul><li>"
     f"<a href=z>Old bridge falls</a></li></ul></div>", ["City", A, B]),
    # one paragraph only
    (f"<nav><a href=/>Start</a></nav><article><p>{D}</p></article>", [D]),
    # a definition list and a figure
    (f"<article><h1>Terms</h1>{p(C)}<dl><dt>Town</dt><dd>The place that pays a third of the sum.</dd></dl>"
     f"<figure><img src=b.jpg><figcaption>The old bridge in winter.</figcaption></figure></article>",
     ["Terms", C, "Town", "The place that pays a third of the sum.", "The old bridge in winter."]),
    # nothing to keep
    ("<nav><a href=/>Home</a><a href=/a>About</a></nav><footer>Copyright</footer>", []),
    # a linked paragraph and a linked heading
    (f"<article><h1><a href=/self>Bridge, at last</a></h1><p><a href=v>{A}</a></p>{p(B, C)}</article><aside><p>Weather: rain.</p></aside>",
     ["Bridge, at last", A, B, C]),
    # text straight inside the article
    (f"<div id=nav><a href=x>x</a></div><article>{A}<br><br>{B}</article>", [f"{A} {B}"]),
    # comment area as articles
    (f"<article class=post><h1>Vote</h1>{p(A, B)}</article><div id=comments><article class=comment><p>A fine vote, I would say, and "
     f"about time.</p></article><article class=comment><p>Not at all, it is a shame, if you ask me.</p></article></div>",
     ["Vote", A, B]),
    # a numbered list with text around
    (f"<main class=with-header><h1>Steps</h1>{p(C)}<ol><li>Close the road in March.</li><li>Remove the old deck.</li></ol>{p(D)}</main>"
     f"<div class='popup modal'><p>Become a member today, and read all of it!</p></div>",
     ["Steps", C, "Close the road in March.", "Remove the old deck.", D]),
    # a preformatted block
    (f"<article><h1>Numbers</h1>{p(D)}<pre>town    1\nregion  2</pre></article><footer class=colophon>Printed here</footer>",
     ["Numbers", D, "town 1 region 2"]),
]
