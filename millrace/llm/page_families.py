"""Labelled web pages of many families, from which the extractor's weights come.

A family is the skeleton of a site's pages as sites of that kind are built; the text in it is drawn by a seeded rule.
Elements marked ``data-main`` are content, unless inside one marked ``data-off``.

Slots: T a headline, P a paragraph, S a short sentence, W a few words, L list items of links, A links in a row.
"""

from __future__ import annotations

import random
import re

FAMILIES = {
    "news": """<header class="site-header"><a class="logo" href="/">{W}</a><nav class="main-nav"><ul>{L}</ul></nav></header><div class="breaking-news"><a>{T}</a></div>
        <main><article data-main class="story"><h1>{T}</h1><p class="lead">{S}</p><p>{P}</p><p>{P} <a>{W}</a> {S}</p><div data-off class="related-stories"><h4>{W}</h4><ul>{L}</ul></div><p>{P}</p><blockquote>{S}</blockquote><p>{S}</p></article></main>
        <aside class="sidebar"><h3>{W}</h3><ul>{L}</ul></aside><section id="comments"><h3>{W}</h3><div class="comment"><span>{W}</span><p>{S}</p></div><div class="comment"><span>{W}</span><p>{P}</p></div></section><footer class="site-footer"><ul>{L}</ul><p>{S}</p></footer>""",
    "blog": """<div id="page"><div id="masthead"><h2><a>{W}</a></h2><p>{S}</p></div><div class="menu"><ul>{L}</ul></div><div id="content"><div data-main class="entry post"><h2>{T}</h2><p>{P}</p><ul><li>{S}</li><li>{W}</li><li>{S}</li></ul><p>{P}</p><p><i>{S}</i></p></div>
        <div class="post-meta">{W} <a>{W}</a></div><div class="navigation">{A}</div><div id="respond"><form><label>{W}</label><input><button>{W}</button></form></div></div><div id="sidebar" class="widget-area"><div class="widget"><h3>{W}</h3><ul>{L}</ul></div></div><div id="footer">{S}</div></div>""",
    "plain": """<h1>{W}</h1><hr><div>{A}</div><div data-main><h2>{T}</h2><p>{P}<p>{P}<p>{S}<p>{P}</div><hr><p><small>{W} <a>{W}</a></small></p>""",
    "wiki": """<div class="mw-page"><div class="siteNotice">{S} <a>{W}</a></div><div data-main class="mw-body-content"><h1>{T}</h1><p>{P}</p><div data-off class="toc" id="toc"><h2>{W}</h2><ul>{L}</ul></div><h2>{W}</h2><p>{P} <a>{W}</a> {P}</p><table><tr><th>{W}</th><td>{W}</td></tr><tr><th>{W}</th><td>{S}</td></tr></table><h2>{W}</h2><p>{P}</p></div>
        <div id="mw-panel" role="navigation"><h3>{W}</h3><ul>{L}</ul></div><div class="catlinks">{A}</div><div id="footer" role="contentinfo"><ul>{L}</ul></div></div>""",
    "docs": """<div class="topbar"><a>{W}</a><form role="search"><input><button>{W}</button></form></div><div class="wrapper"><nav class="docs-sidebar"><h4>{W}</h4><ul>{L}</ul><ul>{L}</ul></nav><div data-main class="markdown-body"><h1>{T}</h1><p>{P}</p><pre><code>{W}
        {W}</code></pre><p>{S} <code>{W}</code> {S}</p><h2>{W}</h2><ol><li>{S}</li><li>{S}</li></ol><p>{P}</p></div><div class="pagination-nav">{A}</div></div><footer>{A} {S}</footer>""",
    "shop": """<header><div class="promo-bar">{S}</div><nav><ul>{L}</ul></nav></header><div class="breadcrumbs">{A}</div><div class="container"><div data-main class="guide"><h1>{T}</h1><p>{P}</p><h3>{W}</h3><p>{P}</p><p>{P}</p></div><div class="product-grid"><div class="card"><a>{W}</a><span>{W}</span><button>{W}</button></div><div class="card"><a>{W}</a><span>{W}</span><button>{W}</button></div></div></div>
        <div class="newsletter-signup"><p>{S}</p><form><input><button>{W}</button></form></div><footer><div class="payment-icons">{W}</div><p>{S}</p></footer>""",
    "recipe": """<div class="ad-slot">{S}</div><nav class="navbar"><ul>{L}</ul></nav><article data-main itemprop="articleBody"><h1>{T}</h1><p>{P}</p><div data-off class="share-buttons">{A}</div><h2>{W}</h2><ul><li>{W}</li><li>{W}</li><li>{W}</li></ul><h2>{W}</h2><ol><li>{S}</li><li>{P}</li></ol></article>
        <section class="you-may-also-like"><h3>{W}</h3>{A}</section><section class="reviews"><h3>{W}</h3><p>{S}</p><p>{P}</p></section><footer><p>{S}</p></footer>""",
    "table": """<table width="100%"><tr><td colspan="2" bgcolor="#eee"><font>{W}</font> {A}</td></tr><tr><td width="150" valign="top">{A}<br>{A}</td><td data-main><font><b>{T}</b></font><br><br>{P}<br><br>{P}<br><br>{S}<br>{P}</td></tr><tr><td colspan="2"><center>{A}<br>{S}</center></td></tr></table>""",
    "forum-help": """<div id="header">{A}</div><div class="notice-banner">{S} <a>{W}</a></div><div class="question-page"><div data-main class="answer-body"><h1>{T}</h1><p>{P}</p><p>{S}</p><pre>{W}</pre><p>{P}</p></div><div class="vote">{W}</div><div class="user-card"><a>{W}</a> {W}</div></div>
        <div class="replies"><div class="reply"><a>{W}</a><p>{S}</p></div><div class="reply"><a>{W}</a><p>{P}</p></div></div><div id="hot-questions"><ul>{L}</ul></div>""",
    "divs": """<div class="h1w">{A}</div><div class="x2"><div class="x3">{A}</div><div class="x4"><div data-main class="x5"><div class="x6">{T}</div><div class="x7">{P}</div><div class="x7">{P}</div><div class="x7">{S}</div><div class="x7">{P}</div></div><div class="x9">{A}{A}</div></div></div><div class="x0">{A}</div>""",
    "government": """<div class="skiplinks"><a>{W}</a></div><div class="cookie-banner" role="region"><p>{S}</p><button>{W}</button><button>{W}</button></div><header role="banner"><a>{W}</a></header><div class="breadcrumb"><ol>{L}</ol></div><main><div data-main class="govspeak"><h1>{T}</h1><p>{P}</p><h2>{W}</h2><p>{P}</p><ul><li>{S}</li><li>{S}</li></ul><p>{S}</p></div><div class="feedback-prompt"><p>{W}</p><button>{W}</button></div></main><footer role="contentinfo"><ul>{L}</ul></footer>""",
    "academic": """<nav class="journal-nav">{S} {A}</nav><div class="layout"><div data-main class="abstract-and-body"><h1>{T}</h1><h2>{W}</h2><p>{P}</p><section><h2>{W}</h2><p>{P}</p><p>{P}</p><figure><figcaption>{S}</figcaption></figure></section><section><h2>{W}</h2><p>{P}</p></section></div><aside class="article-tools"><ul>{L}</ul></aside></div><footer class="publisher-footer"><p>{S}</p>{A}</footer>""",
    "magazine": """<div class="overlay modal"><p>{S}</p><button>{W}</button></div><header class="top"><nav>{A}</nav></header><div class="hero"><div class="kicker">{W}</div></div><section data-main class="article-body"><h1>{T}</h1><p>{P}</p><aside data-off class="pullout promo"><a>{T}</a></aside><p>{P}</p><h2>{W}</h2><p>{P}</p><figure><figcaption>{S}</figcaption></figure><p>{P}</p></section>
        <div class="author-bio"><p>{S}</p></div><div class="sponsored-content"><h4>{W}</h4>{A}</div><div class="subscribe-box"><p>{S}</p><form><input><button>{W}</button></form></div><footer>{A}</footer>""",
    "app": """<div id="root"><div class="AppHeader">{A}<button>{W}</button></div><div class="Layout"><div class="SideNav">{A}</div><main class="Main"><div data-main class="RichText"><h1>{T}</h1><p>{P}</p><p>{S}</p><h3>{W}</h3><p>{P}</p></div></main></div><div class="Toast" role="alert">{S}</div><div class="AppFooter">{A}<span>{S}</span></div></div>""",
    "press": """<nav role="navigation"><ul>{L}</ul></nav><div class="press-release"><div data-main class="release-text"><h1>{T}</h1><p><b>{W}</b> {P}</p><p>{P}</p><p>{P}</p><p>{S}</p></div><div class="social-media">{A}</div><div class="tag-list">{A}</div></div><div class="legal"><p>{S}</p></div><footer>{A}</footer>""",
    "local": """<div id="top"><ul class="mainmenu">{L}</ul></div><div class="advert">{S}</div><div id="inhalt"><div data-main class="artikel"><h1>{T}</h1><h2>{S}</h2><p>{P}</p><p>{P}</p><p>{P}</p></div><div class="werbung anzeige">{S}</div><div id="kommentare"><p>{S}</p><p>{P}</p></div></div><div id="impressum">{A} {S}</div>""",
    "journal-fr": """<div class="entete"><ul>{L}</ul></div><div class="bandeau-cookies">{S} <button>{W}</button></div><div data-main class="contenu texte"><h1>{T}</h1><p class="chapo">{S}</p><p>{P}</p><p>{P}</p><p>{S}</p></div><div class="publicite">{S}</div><div class="commentaires"><p>{S}</p><p>{P}</p></div><div class="pied"><p>{S}</p>{A}</div>""",
    "amp": """<header><a>{W}</a><button>{W}</button></header><article data-main><h1>{T}</h1><p>{P}</p><div data-off class="ad-container">{W}</div><p>{P}</p><p>{P}</p><div data-off class="ad-container"><a>{S}</a></div><p>{S}</p></article><div class="recommendations"><h2>{W}</h2><a>{T}</a><a>{T}</a></div><footer>{S}</footer>""",
    "mailing": """<div class="head">{A}</div><div data-main><h1>{T}</h1><pre>{P}

{P}

{S}</pre></div><hr><div class="thread-nav"><ul>{L}</ul></div><address>{W}</address>""",
    "faq": """<nav>{S}<ul>{L}</ul></nav><main><div data-main><h1>{T}</h1><dl><dt>{S}</dt><dd>{P}</dd><dt>{S}</dt><dd>{P}</dd><dt>{S}</dt><dd>{S}</dd></dl></div></main><div class="contact-us"><p>{W}</p><a>{W}</a></div><footer><p>{S}</p></footer>""",
    "portal": """<div class="portal-menu"><ul>{L}</ul><ul>{L}</ul></div><div class="box login"><form><label>{W}</label><input><label>{W}</label><input><button>{W}</button></form></div><div class="news-item" data-main><h3>{T}</h3><p>{P}</p><p>{P}</p></div><div class="box teaser"><h4>{W}</h4><p>{S}</p><a>{W}</a></div><div class="box teaser"><h4>{W}</h4><p>{S}</p><a>{W}</a></div><div class="copyright">{S}</div>""",
    "review": """<header><nav>{A}</nav></header><article data-main><header><h1>{T}</h1><p>{S}</p></header><p>{P}</p><table><tr><td>{W}</td><td>{W}</td></tr><tr><td>{W}</td><td>{W}</td></tr></table><p>{P}</p><h2>{W}</h2><p>{S}</p></article><div class="affiliate-disclosure">{S}</div><div class="discussion"><ol><li><b>{W}</b><p>{P}</p></li><li><b>{W}</b><p>{S}</p></li></ol></div><footer>{S}</footer>""",
    "minimal": """<nav><b>{W}</b> {S} {A}</nav><article data-main><h1>{T}</h1><p>{S}</p><p>{P}</p><p>{W}</p></article><footer>{S}</footer>""",
    "tags": """<ul id="nav">{L}</ul><div class="story-text" data-main><h1>{T}</h1><p>{P} <em>{W}</em> {S}</p><p>{P}</p><div>{S}</div></div><p class="tags">{A}</p><p class="share">{A}</p><div class="pager">{A}</div><div class="ads">{S}</div><div class="comments-area"><div class="comment-body"><p>{P}</p></div><div class="comment-body"><p>{S}</p></div></div>""",
    "consent": """<div id="consent" class="gdpr-notice"><p>{P}</p><button>{W}</button><a>{W}</a></div><header class="masthead">{W}</header><nav class="nav"><span>{W}</span> {A}</nav><main><section data-main><h1>{T}</h1><p>{P}</p><h2>{W}</h2><p>{P}</p><p>{S}</p></section></main><div class="popup"><p>{S}</p><button>{W}</button></div><footer class="footer"><p>{S}</p></footer>""",
    "alert": """<div class="alert" role="alert"><strong>{W}</strong> {S}</div><div class="navbar">{A}</div><div class="col-md-8"><div class="blog-post" data-main><h2>{T}</h2><p>{P}</p><blockquote><p>{P}</p></blockquote><p>{P}</p><ul><li>{W}</li><li>{S}</li></ul></div></div><div class="col-md-4"><div class="sidebar-module">{S}</div><div class="sidebar-module"><h4>{W}</h4><ol>{L}</ol></div></div>""",
    "hotel": """<header class="header"><nav class="navigation">{A}</nav></header><div class="cookie-consent">{P} <button>{W}</button></div><div class="details"><div data-main><h1>{T}</h1><p>{P}</p><p>{P}</p><h3>{W}</h3><ul><li>{W}</li><li>{W}</li></ul></div></div><div id="reviews"><div class="review"><b>{W}</b><p>{P}</p></div><div class="review"><b>{W}</b><p>{S}</p></div></div><div class="footer"><p>{S}</p>{A}</div>""",
    "zeitung": """<nav class="hauptmenue"><p>{W}</p><ul>{L}</ul></nav><div class="hinweis consent-layer"><p>{P}</p><button>{W}</button></div><main><article data-main><h1>{T}</h1><p>{P}</p><div data-off class="anzeige">{S}</div><p>{P}</p><p>{S}</p></article></main><section class="kommentare"><div class="kommentar"><p>{P}</p></div><div class="kommentar"><p>{S}</p></div></section><footer class="impressum">{A}</footer>""",
    "quotidien": """<header class="entete"><nav>{A}</nav></header><div class="publicite">{S}</div><div class="page"><div data-main><h1>{T}</h1><p>{P}</p><p>{P}</p><h2>{W}</h2><p>{P}</p></div><div class="partage">{A}</div><div id="commentaires"><p>{P}</p><p>{S}</p></div></div><footer class="pied"><p>{S}</p></footer>""",
    "diario": """<div class="cabecera"><ul class="menu">{L}</ul></div><div class="aviso-cookies">{P} <a>{W}</a></div><div class="noticia"><div data-main><h1>{T}</h1><p>{P}</p><p>{P}</p><p>{S}</p></div><div class="publicidad">{S}</div><div class="comentarios"><p>{P}</p><p>{S}</p></div></div><div class="pie">{A} {S}</div>""",
    "boletin": """<div class="menu">{A}</div><div class="publicidad">{S}</div><div data-main class="cuerpo"><h2>{T}</h2><p>{P}</p><p>{P}</p></div><div id="comentarios"><div class="comentario">{P}</div><div class="comentario">{S}</div></div><div class="aviso">{S}</div>""",
    "board": """<div class="top-links">{A}</div><div class="topic"><div data-main class="first-post"><h1>{T}</h1><p>{P}</p><p>{P}</p><p>{S}</p></div><div class="discussion replies"><div class="reply"><b>{W}</b><p>{P}</p></div><div class="reply"><b>{W}</b><p>{P}</p></div></div></div><div class="related-topics"><ul>{L}</ul></div><div class="footer-notice">{S}</div>""",
    "notes": """<nav class="crumbs">{W} {A}</nav><div data-main><h1>{T}</h1><p>{P}</p><p>{S}</p><p>{P}</p><p>{W}</p></div><div class="discussion" id="disqus_thread"><p>{P}</p><p>{S}</p></div><div class="respond"><form><label>{W}</label><button>{W}</button></form></div><footer>{S}</footer>""",
    "app-reviews": """<div class="banner">{S}</div><header>{A}</header><main><section data-main class="description"><h2>{T}</h2><p>{P}</p><p>{P}</p></section><section class="user-reviews"><article class="review"><p>{P}</p></article><article class="review"><p>{S}</p></article></section></main><div class="cookies">{S}<button>{W}</button></div><footer>{A}</footer>""",
    "novel": """<div class="c1"><a>{W}</a> <a>{W}</a></div><div class="c2" data-main><div>{T}</div><br>{P}<br><br>{P}<br><br>{S}<br><br>{P}<br><br>{P}</div><div class="c3">{A}</div>""",
    "cms": """<div id="nav1">{A}</div><div id="main2"><div data-main class="block4"><div>{T}</div><div>{P}</div><div>{P}</div><div>{P}</div><div>{S}</div></div></div><div id="foot3">{A}</div>""",
    "memo": """<div>{A}</div><div data-main><div><b>{T}</b></div><div>{P}</div><div>{S}</div><div>{P}</div><div>{P}</div></div><div>{A}</div><div>{W}</div>""",
    "linked": """<nav><ul>{L}</ul></nav><article data-main><h1>{T}</h1><p>{P}</p><p><a>{P}</a></p><p>{P}</p><p><a>{P}</a></p></article><div class="more-stories"><a><h4>{W}</h4><p>{S}</p></a><a><h4>{W}</h4><p>{S}</p></a></div><footer>{A}</footer>""",
    "curated": """<div class="head">{A}</div><div data-main><h1>{W}</h1><p><a>{P}</a></p><p><a>{P}</a></p><p><a>{P}</a></p><p><a>{P}</a></p></div><div class="tags">{A}</div><div class="foot"><ul>{L}</ul></div>""",
    "cards": """<header>{A}</header><main data-main><h2>{T}</h2><p>{P}</p><a><div>{P}</div></a><p>{S}</p></main><div class="teasers"><a><b>{W}</b><span>{S}</span></a><a><b>{W}</b><span>{S}</span></a><a>{S}</a></div>""",
    "centred": """<center>{A}</center><center data-main><h1>{T}</h1><p>{P}</p><p>{P}</p><p>{S}</p></center><center><hr>{A}<p>{S}</p></center>""",
    "within": """<nav>{A}</nav><article data-main><h1>{T}</h1><p>{P}</p><p>{P}</p><section data-off class="comments"><h3>{W}</h3><div class="comment"><p>{P}</p></div><div class="comment"><p>{P}</p></div></section></article><footer>{S}</footer>""",
}

_SYLLABLES = "ka lo mi ren sta tor ve un der sol pri ma nel qua est bri do fen gar hol is jo lan".split()


def _words(rng: random.Random, least: int, most: int) -> list[str]:
    return ["".join(rng.choices(_SYLLABLES, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(rng.randint(least, most))]


def _sentence(rng: random.Random, least: int, most: int) -> str:
    words = _words(rng, least, most)
    if len(words) > 8:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + rng.choice((".", ".", ".", "!", "?"))


def _link(rng: random.Random) -> str:
    return f'<a href="/{rng.randint(1, 999)}">{" ".join(_words(rng, 1, 3))}</a>'


def _fill(slot: str, rng: random.Random) -> str:
    if slot == "P":
        return " ".join(_sentence(rng, 6, 18) for _ in range(rng.randint(2, 6)))
    if slot == "S":
        return _sentence(rng, 2, 9)
    if slot == "T":
        return " ".join(_words(rng, 4, 9)).capitalize()
    if slot == "W":
        return " ".join(_words(rng, 1, 3))
    links = [_link(rng) for _ in range(rng.randint(3, 7))]
    return "".join(f"<li>{x}</li>" for x in links) if slot == "L" else " ".join(links)


def pages(names: list[str] | None = None, each: int = 4, seed: int = 11) -> list[str]:
    """``each`` pages of every family, always the same for a seed."""
    out = []
    for name in FAMILIES if names is None else names:
        for k in range(each):
            rng = random.Random(f"{seed} {name} {k}")
            body = re.sub(r"\{([TPSWLA])\}", lambda m: _fill(m[1], rng), FAMILIES[name])  # noqa: B023
            out.append(f"<!DOCTYPE html><html><head><title>{_fill('T', rng)}</title></head><body>{body}</body></html>")
    return out
