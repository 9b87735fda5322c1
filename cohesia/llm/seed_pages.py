"""Small labelled pages for the page model: elements marked data-main hold main text, all other text does not.

They show common page layouts and naming habits; L, M and S stand for a long, a middling and a short text.
"""

_LONG = "The committee met again in the spring, and after some discussion it agreed that the older records should be kept. Nobody had read them for years, yet they turned out to matter a great deal, as the following pages will show. Each of them was copied by hand, compared with its source and put back where it had been found."
_MIDDLING = "It was late when the last visitors left, and the rain had not stopped."
_SHORT = "Later that year"
_MENU = "".join(f'<li><a href="/{w.lower()}">{w}</a></li>' for w in ("Home", "News", "Sports", "Contact", "About us", "Archive"))

_SHAPES = [
    '<html><head><title>S</title></head><body><nav><ul>U</ul></nav><div class="ad">M</div><article data-main><h1>S</h1><p>L</p><p>M</p><p>S</p><p>L</p></article><footer>&copy; site &middot; M</footer></body></html>',
    '<html><body><header><a href="/">S</a><div class="menu"><ul>U</ul></div></header><main><div class="cookie-notice">M <a href="/ok">S</a></div><article data-main><h1>S</h1><p>L</p><h2>S</h2><p>M</p><ul><li>S</li><li>M</li></ul><blockquote>M</blockquote></article><aside><h3>S</h3><ul>U</ul><p>M</p></aside></main><footer><p>M</p></footer></body></html>',
    '<html><body><div id="header"><h2>S</h2><ul class="nav">U</ul></div><div id="content"><div class="post" data-main><h1>S</h1><div class="entry"><p>L</p><p>S</p><p>L</p></div></div><div class="comments"><h3>S</h3><div class="comment"><p>M</p></div><div class="comment"><p>L</p></div></div></div><div id="sidebar"><div class="widget"><h3>S</h3><p>M</p></div></div><div id="footer">M</div></body></html>',
    '<html><body><div class="top-banner">M</div><div class="wrapper"><div class="breadcrumb"><a href="/">S</a></div><section class="article-body" data-main><h1>S</h1><p>L</p><pre>M</pre><table><tr><th>S</th><td>S</td></tr><tr><th>S</th><td>M</td></tr></table><p>M</p></section><section class="comments"><p>L</p><p>M</p></section><div class="related-links"><h4>S</h4><ul>U</ul></div></div><footer><div class="copyright">S</div></footer></body></html>',
    '<html><body><nav>S <a href="/a">S</a></nav><main data-main><h1>S</h1><p>M</p><p>S</p></main><div class="newsletter-signup"><p>M</p></div><div class="share">S</div><footer>S</footer></body></html>',
    '<html><body><header><h1>S</h1></header><article data-main><h2>S</h2><p>M</p><div>L</div><div>S</div><p>L</p></article><div class="sponsored"><p>M</p></div><aside class="sidebar"><p>L</p></aside><section id="reader-comments"><h2>S</h2><article class="comment"><p>L</p></article><article class="comment"><p>M</p></article></section><footer><p>M</p></footer></body></html>',
    '<html><body><div class="notice">L</div><div class="page"><div class="story" data-main><h1>S</h1><p>S</p><p>L</p><p>L</p></div><div class="promo">L</div></div><div class="legal">L</div></body></html>',
    '<html><body data-main><h1>S</h1><p>L</p><p>M</p><p>L</p></body></html>',
    '<html><body><ul>U</ul><div data-main><p>L</p><p>M</p><p>L</p></div><p><a href="/x">S</a> <a href="/y">S</a></p></body></html>',
    '<html><body><div class="popup">M</div><div class="modal"><p>S</p></div><div class="alert">M</div><div role="main" data-main><h1>S</h1><ol><li>M</li><li>L</li></ol><dl><dt>S</dt><dd>M</dd></dl><figure><figcaption>S</figcaption></figure></div><div role="navigation">U</div><div role="complementary"><p>M</p></div><div role="contentinfo">M</div></body></html>',
]
# Notices and adverts inside an article are no main text: data-off ends a data-main element's reach.
_SHAPES += [
    '<html><body><nav><ul>U</ul></nav><article data-main><h1>S</h1><p>L</p><div class="ad" data-off>M</div><p>M</p><div class="advert" data-off><p>L</p></div><p>L</p><aside data-off><p>M</p></aside><div class="share-buttons" data-off>S</div><section class="comments" data-off><h3>S</h3><p>L</p><p>M</p></section></article><footer>M</footer></body></html>',
    '<html><body><article data-main><header><h1>S</h1></header><section><h2>S</h2><p>L</p></section><section><p>M</p></section><nav data-off><ul>U</ul></nav><footer data-off>M</footer></article><div class="ads"><p>L</p></div></body></html>',
]

_SHAPES += [
    '<html><body><header class="site-header"><h1>S</h1><p>M</p></header><main><article class="post" data-main><header class="entry-header"><h1>S</h1></header><div class="entry-content"><p>L</p><p>M</p></div><footer class="entry-footer" data-off>M</footer></article><section class="comments"><article><p>L</p></article><article><p>M</p><div>M</div></article></section></main><footer class="site-footer">M</footer></body></html>',
    '<html><body><nav class="main-nav"><ul>U</ul></nav><main data-main><header class="article-header"><h1>S</h1></header><p>L</p><section><p>M</p></section><section class="comments" data-off><article><p>L</p></article><div><p>L</p></div></section></main><aside class="sidebar"><section><h3>S</h3><p>M</p></section><article><p>M</p></article></aside></body></html>',
]
# Pages of nothing but text.
_SHAPES += [f"<html data-main><body data-main>{b}</body></html>" for b in ("<p>L</p>", "<p>L</p><p>M</p><p>L</p>", "<h1>S</h1><p>L</p><p>M</p>", "<div>L</div><div>M</div>", "<h2>S</h2><p>M</p><p>S</p>", "<p>S</p>", "<p>M</p><p>M</p>")]
# The same layouts under many names: what is called so goes before, inside or after the main text.
_NAMED = "ad ads adv advert advertisement banner sponsored sponsor promo nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead topbar footer bottom legal cookie consent gdpr notice notices alert warning popup modal overlay comments comment disqus reply replies respond reviews share sharing social follow related recommended trending newsletter subscribe signup login search form widget widgets toolbar pager pagination tags copyright complementary contentinfo skip links".split()
_MAIN = ['article', 'div class="content"', 'main', 'div id="story"', 'section class="post"', 'article class="entry"', 'div class="text"', 'div', 'div class="article-body"', 'section', 'div id="main"', 'div class="page-content"', 'article class="hentry post"', 'div class="prose markdown"', 'div role="main"', 'div class="doc document"']
# Names that say little: elements around main text, parts of it and other elements bear them alike.
_VAGUE = "top more side page wrapper container layout row col site outer inner body block section left right center box item list first last column grid".split()
_BODIES = ["<h1>S</h1><p>L</p>IN<p>L</p>", "<p>L</p>IN<p>L</p>", "<h1>S</h1><p>M</p>IN<p>L</p><h2>S</h2><p>L</p><p>S</p>", "<p>L</p><p>M</p>IN<ul><li>S</li><li>M</li></ul>", "<h2>S</h2><p>L</p>IN<p>M</p><p>L</p>", "<p>M</p>IN<p>L</p><blockquote>M</blockquote>", "<section><h2>S</h2><p>L</p></section>IN<section><p>M</p></section>", "<div><p>L</p></div>IN<section><p>M</p><p>L</p></section>"]
for _i, _name in enumerate(_NAMED):
    _tag = ("div", "section", "aside", "div")[_i % 4]
    _off = f'<{_tag} class="{_name}" DATA>{("<h3>S</h3><p>L</p><p>M</p>M", "M", "<p>M</p>", "<ul>U</ul>", "<p>L</p><p>L</p>")[_i % 5]}</{_tag}>'
    _other = f'<{("aside", "nav", "footer", "header")[_i % 4]}>{("<p>L</p>", "<h2>S</h2>", "<p>S</p>", "<h1>S</h1><p>M</p>")[_i % 4]}<div>M</div></{("aside", "nav", "footer", "header")[_i % 4]}>'
    _open, _vague, _next = _MAIN[_i % len(_MAIN)], _VAGUE[_i % len(_VAGUE)], _VAGUE[(_i + 7) % len(_VAGUE)]
    _inside = _off.replace("DATA", "data-off") + f'<p class="{_vague}">M</p>' if _i % 2 else f'<p>S</p><div class="{_next}"><p>M</p></div>'
    _body = f'<{_open} data-main>{_BODIES[_i % len(_BODIES)].replace("IN", _inside)}</{_open.split()[0]}>'
    _after = f'<div class="{_name}-list"><p>L</p><p>S</p></div>' if _i % 3 else f'<p class="{_name}">M</p><button>S</button><dialog>M</dialog>'
    _SHAPES.append(f'<html><body>{_other}<div class="{_vague}">{_off.replace("DATA", "")}{_body}{_after}</div><aside class="{_next}"><p>L</p></aside><footer>M</footer></body></html>')
# Parts named after the whole: what the last word says counts.
for _i, _whole in enumerate("post entry article story content page main text".split()):
    for _part in "footer share comments related tags nav sidebar ad".split():
        _SHAPES.append(f'<html><body><div class="{_whole}" data-main><div class="{_whole}-body"><p>L</p><p>M</p></div><div class="{_whole}-{_part}" data-off>{("M", "<p>M</p>", "<ul>U</ul>")[_i % 3]}</div></div><div class="{_part}-{("body", "content", "text", "list")[_i % 4]}"><p>L</p></div></body></html>')
# Main text without a heading, alone, in a wrapper or a wrapper's name.
for _i, _vague in enumerate(_VAGUE):
    _open = _MAIN[_i % len(_MAIN)]
    _body = f'<{_open} data-main>{_BODIES[_i % len(_BODIES)].replace("IN", ("", "<div class=ad data-off>M</div>", "<div class=related data-off><p>M</p></div>")[_i % 3])}</{_open.split()[0]}>'
    _SHAPES += [f'<html><body><div id="{_vague}">{_body}</div></body></html>', f'<html><body>{_body}<footer>M</footer></body></html>', f'<html><body><div class="{_vague}" data-main><p>L</p><p class="{_vague}">M</p><p>L</p></div></body></html>', f'<html data-main><body data-main><p>L</p><p>{"LM"[_i % 2]}</p></body></html>']

PAGES = [s.replace(">L", ">" + _LONG).replace(">M", ">" + _MIDDLING).replace(">S", ">" + _SHORT).replace(">U", ">" + _MENU).replace("; M<", f"; {_MIDDLING}<") for s in _SHAPES]
