"""Labelled pages, from which the tag and class weights of html_extract are learned.

Each is a page as one kind of site writes it: markup and words around the article, the article, and what stands inside it
without belonging to it. {+} begins a part that belongs to the article and {-} one that does not; {p} stands for a paragraph,
{s} for a sentence, {w} for a word or two, and {links} for the items of a list of links.
"""

from __future__ import annotations

import random
import re

SITES = {
    "blog": """<html><head><title>{w}</title><style>.a{}</style></head><body class="home blog"><div id="page" class="site"><a class="skip-link" href="#content">{w}</a><header id="masthead" class="site-header"><h1 class="site-title">{w}</h1><p class="site-description">{s}</p></header><nav id="site-navigation" class="main-navigation"><ul class="menu">{links}</ul></nav><div id="content" class="site-content"><main id="main">{+}<article class="post entry"><header class="entry-header"><h1 class="entry-title">{w}</h1></header><div class="entry-content">{p}{p}<h2>{w}</h2>{p}<ul><li>{s}</li><li>{s}</li></ul>{-}<div class="sharedaddy share"><span>{w}</span></div>{+}{p}</div>{-}<div class="related posts"><h3>{w}</h3><ul>{links}</ul></div></article><section id="comments" class="comments-area"><h2 class="comments-title">{w}</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><div class="comment-author">{w}</div><p>{s}</p><a class="reply">{w}</a></article></li><li class="comment"><p>{s}</p></li></ol><form class="comment-form"><label>{w}</label><textarea>{w}</textarea><button>{w}</button></form></section></main></div><aside id="secondary" class="widget-area sidebar"><section class="widget recent"><h2 class="widget-title">{w}</h2><ul>{links}</ul></section></aside><footer id="colophon" class="site-footer"><p>{s}</p></footer></div></body></html>""",
    "news": """<html><head><title>{w}</title></head><body><div class="cookie-banner notice"><p>{s}</p><button>{w}</button></div><div class="topbar"><ul>{links}</ul></div><header class="masthead"><div class="logo">{w}</div></header><nav class="navbar"><ul>{links}</ul></nav><div class="breadcrumbs"><a>{w}</a><a>{w}</a></div><div class="ad advert"><p>{s}</p></div><div class="wrapper"><main>{+}<article class="story"><h1>{w}</h1><p class="lead">{s}</p>{p}{-}<div class="advertisement"><span>{s}</span></div>{+}{p}<blockquote><p>{s}</p></blockquote>{p}<figure><figcaption>{s}</figcaption></figure>{p}</article>{-}</main><aside><h3>{w}</h3><ul>{links}</ul><div class="sponsored promo"><p>{s}</p></div></aside></div><div class="newsletter signup"><p>{s}</p><form><input><button>{w}</button></form></div><footer><div class="legal">{s}</div><ul>{links}</ul></footer></body></html>""",
    "paper": """<html><body><div id="header"><h2>{w}</h2><div class="search"><form><input><button>{w}</button></form></div></div><div id="menu"><ul>{links}</ul></div><div id="container"><div id="main">{+}<div id="article" class="article-body"><h1>{w}</h1>{p}{p}{-}<div class="social share-buttons"><ul>{links}</ul></div>{+}<h3>{w}</h3>{p}{p}<ol><li>{s}</li><li>{s}</li></ol></div>{-}<div class="related"><p>{s}</p></div><div id="disqus" class="discussion"><p>{s}</p><p>{s}</p></div></div><div id="sidebar"><div class="popular"><h4>{w}</h4><ul>{links}</ul></div><div class="ads"><p>{s}</p></div></div></div><div id="footer"><p class="copyright">{s}</p></div></body></html>""",
    "handbook": """<html><body><div class="related" role="navigation"><ul>{links}</ul></div><div class="document"><div class="bodywrapper"><div class="body" role="main">{+}<section id="intro"><h1>{w}</h1>{p}<pre>{s}</pre>{p}<section><h2>{w}</h2>{p}<table><tr><th>{w}</th><td>{w}</td></tr><tr><td>{s}</td><td>{w}</td></tr></table><dl><dt>{w}</dt><dd>{s}</dd></dl></section></section>{-}</div></div><div class="sphinxsidebar" role="navigation"><h3>{w}</h3><ul>{links}</ul><div id="searchbox" role="search"><form><input></form></div></div></div><div class="footer" role="contentinfo">{s}</div></body></html>""",
    "encyclopedia": """<html><body><div id="mw-page-base"></div><div id="siteNotice" class="notice"><p>{s}</p></div><main id="content" class="mw-body">{+}<h1 id="firstHeading">{w}</h1><div id="bodyContent"><div class="mw-parser-output">{p}{-}<div id="toc" class="toc"><ul>{links}</ul></div>{+}<h2>{w}</h2>{p}{p}<ul><li>{s}</li></ul>{-}<div class="navbox" role="navigation"><ul>{links}</ul></div>{+}</div></div>{-}</main><div id="mw-panel"><nav class="portal"><ul>{links}</ul></nav></div><div id="mw-navigation"><ul>{links}</ul></div><footer id="footer"><ul><li>{s}</li></ul></footer></body></html>""",
    "forum": """<html><body><div class="header"><a class="logo">{w}</a><div class="login"><form><input><input></form></div></div><div class="navigation"><ul>{links}</ul></div><div class="topic">{+}<div class="post first"><h1>{w}</h1><div class="post-content text">{p}{p}{p}</div></div>{-}<div class="replies"><div class="reply"><p>{s}</p></div><div class="reply"><p>{s}</p></div></div></div><div class="pagination"><ul>{links}</ul></div><div class="footer"><p>{s}</p></div></body></html>""",
    "magazine": """<html><body><div class="modal popup overlay"><p>{s}</p></div><div class="banner"><p>{s}</p></div><header><nav><ul>{links}</ul></nav></header>{+}<article><header><h1>{w}</h1><p>{s}</p></header><section>{p}{p}</section>{-}<aside class="pullout"><p>{s}</p></aside>{+}<section><h2>{w}</h2>{p}{p}</section>{-}<footer><p>{s}</p></footer></article><section class="recommended trending"><h3>{w}</h3><ul>{links}</ul></section><div class="subscribe"><p>{s}</p></div><footer><p>{s}</p></footer></body></html>""",
    "shop": """<html><body><div class="consent gdpr"><p>{s}</p></div><menu>{links}</menu><div class="toolbar"><ul>{links}</ul></div><div class="row"><div class="content product-description">{+}<h1>{w}</h1>{p}{p}<ul><li>{s}</li><li>{s}</li></ul>{p}{-}</div><div class="sidebar filters"><form><select><option>{w}</option><option>{w}</option></select></form></div></div><div class="sponsor promoted"><p>{s}</p></div><div class="copyright"><p>{s}</p></div></body></html>""",
    "journal": """<html><body><div class="alert"><p>{s}</p></div><div class="site-nav navigation"><ul>{links}</ul></div><div class="main"><div class="story-body">{+}<h1>{w}</h1>{p}{p}<h2>{w}</h2>{p}{-}<div class="widget"><h4>{w}</h4><p>{s}</p></div>{+}{p}{-}</div></div><div class="print hidden"><p>{s}</p></div><ol class="commentlist"><li><p>{s}</p></li><li><p>{s}</p></li></ol><div class="respond"><form><textarea>{w}</textarea></form></div><div class="pager"><a>{w}</a></div><div class="footer"><ul>{links}</ul></div></body></html>""",
    "diary": """<html><body><div class="header"><h1>{w}</h1></div><div class="columns"><div class="column left menu"><ul>{links}</ul></div><div class="column"><div class="post-body entry">{+}<h3 class="post-title">{w}</h3><p>{s}<br>{s}</p>{p}{p}{-}</div><div class="post-footer"><span>{w}</span></div><div class="comments"><h4>{w}</h4><div class="comment"><p>{s}</p></div></div></div><div class="column right sidebar"><div class="widget archive"><ul>{links}</ul></div></div></div></body></html>""",
    "campus": """<html><body><div id="skip"><a>{w}</a></div><div id="banner" class="header"><p>{s}</p></div><div id="nav"><ul>{links}</ul></div><div id="content">{+}<h1>{w}</h1>{p}<table><tr><td>{s}</td><td>{s}</td></tr></table>{p}{p}{-}</div><div id="news" class="aside"><h3>{w}</h3><p>{s}</p></div><div id="footer" class="legal"><p>{s}</p></div></body></html>""",
    "agency": """<html><body><dialog><p>{s}</p></dialog><div class="notification alert"><p>{s}</p></div><div class="breadcrumb"><ul>{links}</ul></div><main class="main">{+}<h1>{w}</h1><div class="text">{p}{p}</div>{-}<aside><p>{s}</p></aside>{+}<div class="text">{p}<blockquote>{s}</blockquote>{p}</div>{-}</main><div class="sharing"><ul>{links}</ul></div><form><fieldset><legend>{w}</legend><label>{w}</label><input></fieldset></form><footer class="footer"><p>{s}</p></footer></body></html>""",
    "plain": """<html><head><title>{w}</title></head><body>{+}<h1>{w}</h1>{p}<p>{s} <a href="x">{w}</a> {s}</p>{p}<h2>{w}</h2>{p}{-}<hr><div class="navbar"><a>{w}</a><a>{w}</a></div></body></html>""",
    "stream": """<html><body><div class="cookies notice"><p>{s}</p></div><nav class="menu"><ul>{links}</ul></nav><div class="container"><div class="advert"><p>{s}</p></div>{+}<article><h1>{w}</h1><p>{s} <b>{w}</b> {s}</p>{p}{p}{-}<div class="ad"><p>{s}</p></div>{+}{p}</article>{-}<div class="sidebar"><div class="related"><ul>{links}</ul></div></div><section class="comments"><p>{s}</p><p>{s}</p></section></div><footer class="copyright"><p>{s}</p></footer></body></html>""",
}


def labelled_pages(seed: int = 1) -> dict[str, list[tuple[str, int]]]:
    """Pages by site, each a list of (markup, 1 if it belongs to the article), with invented words."""
    r = random.Random(seed)

    def words(least: int, most: int) -> str:
        return " ".join("".join(r.choices("aeionrstlmdc", k=r.randint(2, 9))) for _ in range(r.randint(least, most)))

    def filled(m: re.Match) -> str:
        kind = m[1]
        if kind == "w":
            return words(1, 3)
        if kind == "s":
            return words(6, 14) + "."
        if kind == "p":
            tag = r.choice(("a", "b", "em", "span", "i", "strong", "code"))
            inner = f" <{tag}>{words(1, 3)}</{tag}> " if r.random() < 0.7 else " "
            tail = r.choice(("", "", f"<ul><li>{words(4, 12)}</li><li>{words(4, 12)}</li></ul>", f"<h3>{words(1, 4)}</h3>", f"<h4>{words(1, 4)}</h4>"))
            return f"<p>{words(15, 40)}{inner}{words(10, 20)}. {words(10, 30)}.</p>{tail}"
        return "".join(f"<li><a href='{i}'>{words(1, 3)}</a></li>" for i in range(r.randint(3, 7)))

    pages = {}
    for name, site in SITES.items():
        parts, label = [], 0
        for part in re.split(r"(\{[+-]\})", site):
            if part in ("{+}", "{-}"):
                label = int(part == "{+}")
            elif part:
                parts.append((re.sub(r"\{(w|s|p|links)\}", filled, part), label))
        pages[name] = parts
    return pages
