"""Pages labelled by hand, of layouts unlike the generated ones: (html, main text)."""

_N = "<nav><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></nav>"
_F = "<footer>Copyright 2023 Harbour Press. All rights reserved.</footer>"
_A = "The council met on Tuesday to vote on the new bridge. Members spoke for two hours before the count."
_B = "Work will begin in spring, the mayor said, and should take about three years to finish."
_C = "Nearby shops expect less trade while the road is closed."
_P = f"<p>{_A}</p><p>{_B}</p>"
_T = f"{_A} {_B}"

PAGES = [
    (f"<p>{_A}</p>", _A),
    (_A, _A),
    (f"{_A}\n\n{_B}", _T),
    (f"<h1>Bridge vote</h1>{_P}", f"Bridge vote {_T}"),
    (f"<body>{_N}<h1>Bridge vote</h1>{_P}{_F}</body>", f"Bridge vote {_T}"),
    (f"{_N}<main><h1>Bridge vote</h1>{_P}</main>{_F}", f"Bridge vote {_T}"),
    (f"{_N}<div id=content><h2>Bridge vote</h2>{_P}</div>{_F}", f"Bridge vote {_T}"),
    (f"{_N}<div class=story-body__inner><p>{_A}<p>{_B}</div>{_F}", _T),
    (f"<table><tr><td width=150><a href=/>Home</a><br><a href=/n>News</a></td><td><p>{_A}</p><p>{_B}</p></td></tr></table>", _T),
    (f"<center><font size=6>Bridge vote</font></center><p>{_A}<p>{_B}<hr>", f"Bridge vote {_T}"),
    (f"<article>{_P}<ul><li>{_C}</li><li>Buses will stop at the old mill.</li></ul></article>{_F}", f"{_T} {_C} Buses will stop at the old mill."),
    (f"<article>{_P}<blockquote>{_C}</blockquote></article>", f"{_T} {_C}"),
    (f"<article><header><h1>Bridge vote</h1></header>{_P}</article>{_F}", f"Bridge vote {_T}"),
    (f"<div class=cookie-bar>We use cookies to improve this site. <button>Accept</button></div><article>{_P}</article>", _T),
    (f"<div id=onetrust-banner>This site uses cookies. Read our privacy policy.</div>{_N}<div class=post>{_P}</div>", _T),
    (f"<article>{_P}</article><aside><h3>Related</h3><ul><li><a href=/1>Ferry fares rise</a><li><a href=/2>School reopens</a></ul></aside>", _T),
    (f"<article>{_P}</article><section id=comments><h3>2 comments</h3><div class=comment><b>ann</b><p>I walk there daily, it is about time.</p></div></section>", _T),
    (f"<article>{_P}</article><div id=disqus_thread><p>bob: What will it cost us all in the end?</p></div>{_F}", _T),
    (f"<article><p>{_A}</p><div class=ad-slot>Buy a new car today at Miller's.</div><p>{_B}</p></article>", _T),
    (f"<article><p>{_A}</p><aside class=pullquote>More on bridges</aside><p>{_B}</p></article>", _T),
    (f"<article><p>{_A}</p><form><label>Your mail</label><input><button>Subscribe</button></form><p>{_B}</p></article>", _T),
    (f"<article>{_P}<div class=share-links><a href=#>Share</a> <a href=#>Tweet</a></div></article>", _T),
    (f"<ul class=breadcrumb><li><a href=/>Home</a><li><a href=/n>News</a></ul><article>{_P}</article>", _T),
    (f"<div class=top-nav><a href=/>Home</a><a href=/n>News</a></div><div class=article><h1>Bridge vote</h1>{_P}</div><div class=bottom>Copyright 2023</div>", f"Bridge vote {_T}"),
    (f"<article class=comments-policy><h1>Bridge vote</h1>{_P}</article>", f"Bridge vote {_T}"),
    (f"<article class='ad-free-edition'>{_P}</article>{_F}", _T),
    (f"<main id=main-content role=main><section><h2>Bridge vote</h2>{_P}</section></main>{_F}", f"Bridge vote {_T}"),
    (f"<p class=x don't>{_A}</p><p>{_B}</p>", _T),
    (f"<p title='a > b'>{_A}</p><p title=\"x > y\">{_B}</p>", _T),
    (f"<div><div><div><div>{_A}</div></div><div>{_B}</div></div></div>", _T),
    (f"<article><p>{_A}<br>{_B}</p></article>", _T),
    (f"<article><p>{_A}</p><pre>cost = 3 * years</pre></article>", f"{_A} cost = 3 * years"),
    (f"<article><p>{_A}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2024</td><td>3 million</td></tr></table></article>", f"{_A} Year Cost 2024 3 million"),
    (f"<article><p>{_A}</p><figure><img src=a.png><figcaption>The old bridge in winter.</figcaption></figure><p>{_B}</p></article>", f"{_A} The old bridge in winter. {_B}"),
    (f"<article><h1>Fish &amp; chips</h1><p>Caf&eacute; prices rose by 5&#37; &ndash; again.</p></article>{_F}", "Fish & chips Café prices rose by 5% – again."),
    (f"<script>if (a<b) document.write('<p>no</p>')</script><style>p{{}}</style><article>{_P}</article><noscript>Turn on scripts.</noscript>", _T),
    (f"<article>{_P}<svg><text>icon</text></svg></article>", _T),
    (f"<article><my-card>{_A}</my-card><my-card>{_B}</my-card></article>", _T),
    (f"<article>{_P}</article><div class=newsletter-signup><h3>Get our newsletter</h3><p>Subscribe for weekly news from town.</p></div>{_F}", _T),
    (f"<div class=paywall-notice>You have read 3 of 5 free stories.</div><article>{_P}</article>", _T),
    (f"<div class=layout><div class=sidebar><h4>Popular</h4><p>Ferry fares rise</p></div><div class=content>{_P}</div></div>", _T),
    (f"<header><h1>Harbour Press</h1><p>News of the coast</p></header><article><h2>Bridge vote</h2>{_P}</article>", f"Bridge vote {_T}"),
    (f"{_N}<article><p>Short note.</p></article>{_F}", "Short note."),
    (f"{_N}{_F}", ""),
    ("<form><label>Name</label><input></form>", ""),
    ("", ""),
    (f"<dl><dt>Bridge</dt><dd>{_A}</dd><dt>Road</dt><dd>{_C}</dd></dl>", f"Bridge {_A} Road {_C}"),
    (f"<body><div class=page><div class=masthead>Harbour Press</div><div class=entry><h1>Bridge vote</h1><div class=byline>By Ann Lee</div>{_P}</div><div class=colophon>Printed in town</div></div>", f"Bridge vote {_T}"),
    (f"<article>{_P}</article><div hidden><p>Hidden words for later use.</p></div>", _T),
    (f"<article>{_P}<p style='display:none'>Hidden words for later use.</p></article>", _T),
    (f"<section class=hero-banner><a href=/sale>Summer sale</a></section><section class=text>{_P}</section>", _T),
    (f"<div class=sponsored>Sponsored: fly to the islands for less.</div><p>{_A}</p><p>{_B}</p>", _T),
    (f"<article><h1>{_C}</h1></article>{_N}", _C),
    (f"<article><section><h2>One</h2><p>{_A}</p></section><section><h2>Two</h2><p>{_B}</p></section></article>{_F}", f"One {_A} Two {_B}"),
]

#: Layouts that name their state or what else they hold, and parts inside the article.
_LONG = "Some readers think that the bridge is far too dear for a town of this size, and they say so at great length here. " * 12
LAYOUTS = [
    (f"<html><body><div class='content-with-sidebar'><h1>Bridge vote</h1>{_P}</div>{_F}</body></html>", f"Bridge vote {_T}"),
    (f"<html><body>{_N}<div class='content-with-sidebar'><h1>Bridge vote</h1>{_P}<p>{_C}</p></div><div class='sidebar'><p>Ferry fares rise</p></div>{_F}</body></html>", f"Bridge vote {_T} {_C}"),
    (f"<html><body class='no-banner page-popup-open'><div class='post'><h1>Bridge vote</h1>{_P}</div></body></html>", f"Bridge vote {_T}"),
    (f"<html class='js no-search'><body class='has-sidebar menu-closed'>{_N}<div class='entry'>{_P}</div>{_F}</body></html>", _T),
    (f"<article><p>{_A}</p><div class='ad'>Buy our shoes now and save a lot of money today.</div><p>{_B}</p></article>", _T),
    (f"<article><h1>Bridge vote</h1><p>{_A}</p><div class='ad'>Buy our shoes now</div><p>{_B}</p></article>", f"Bridge vote {_T}"),
    (f"<article>{_P}<div class='comments'><p>Nice post, I will walk there with my dog on Sunday.</p></div></article>", _T),
    (f"<article>{_P}<div class='comments'><div class='comment'><div class='content'><p>{_LONG}</p></div></div></div></article>", _T),
    (f"<article>{_P}</article><div class='comments'><div class='comment'><div class='content'><p>{_LONG}</p><p>{_LONG}</p></div></div></div>", _T),
    (f"<div class='layout-sidebar-left'><div class='post'>{_P}</div><div class='sidebar'><h3>Popular</h3><p>Ferry fares rise</p></div></div>", _T),
    (f"<div id='page-with-comments'><h1>Bridge vote</h1>{_P}</div>", f"Bridge vote {_T}"),
    (f"<div class='site header-fixed'><header><a href=/>Harbour Press</a></header><div class='content'>{_P}</div></div>", _T),
]
