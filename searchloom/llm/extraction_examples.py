"""The small labelled table of the block classifier: short pages whose blocks carry their label.

A block that starts with ``+`` is main text, one that starts with ``-`` is not. Pages are (what it shows, HTML).

Most pages carry no marks and are written as layouts: one item a block, its label, its kind (``a`` all of it is one link, ``l`` half of
it is, ``h`` a heading, nothing for plain text) and its number of words; ``[name`` to ``]`` is an element with a mark. In layouts without marks a block's own words and links often
do not tell: a line of eight words is main text between paragraphs and none between links, a comment as long as a paragraph
stands between the links of its author and its reply. So its neighbours have to.
"""

from __future__ import annotations

LAYOUTS: list[tuple[str, str]] = [
    ("menu, line of advert, title, paragraphs, foot line", "-a1 -a2 -a1 -a1 -8 +h9 +60 +22 +45 +70 -9"),
    ("the same with short paragraphs", "-a1 -a1 -a1 -10 +h6 +4 +18 +7 +33 +3 +50 -11"),
    ("menu of one, long foot", "-a2 +h8 +40 +9 +35 +28 -16"),
    ("title of one word", "-a1 -a1 -6 +h1 +25 +14 +2 +31 +12 -8"),
    ("no menu, foot of links", "+h7 +55 +38 +6 +47 -a1 -a2 -a1"),
    ("teasers below the text", "-a1 -a1 +h5 +48 +64 +11 +39 -a7 -a9 -a6 -a8 -10"),
    ("teasers with a line each", "-a1 +h6 +52 +44 +30 -a6 -14 -a7 -12 -a5 -15 -a6 -9"),
    ("comments between the links of author and reply", "-a1 -a1 +h8 +61 +27 +49 -a2 -35 -a1 -a2 -28 -a1 -a2 -41 -a1 -9"),
    ("short comments", "-a1 -a1 +h4 +36 +58 +5 +42 -a2 -12 -a1 -a2 -7 -a1 -a2 -18 -a1 -8"),
    ("by-line with a link", "-a1 -a1 -a1 +h9 -l4 +57 +33 +8 +45 -12"),
    ("tags after the text", "-a1 -a1 +h7 +46 +19 +38 -a1 -a1 -a1 -13"),
    ("links inside paragraphs", "-a1 -a1 -7 +h6 +l40 +31 +l26 +52 -10"),
    ("advert between links", "-a1 -a1 -12 -a1 -a1 +h8 +44 +29 +37 -a2 -15 -a2"),
    ("long advert between links", "-a1 -30 -a1 -a1 +h5 +51 +47 +6 +32 -a2 -26 -a1"),
    ("a list within the text", "-a1 -a1 +h6 +39 +5 +4 +6 +5 +43 +24 -11"),
    ("sections with headings", "-a2 -a1 -9 +h7 +41 +h3 +36 +28 +h2 +53 +8 +47 -10"),
    ("text to the end", "-a1 -a1 +h8 +34 +62 +27 +45"),
    ("text only", "+50 +42 +37 +58"),
    ("title and text only", "+h5 +44 +31 +26 +40"),
    ("one paragraph", "-a1 -a1 -a1 -5 +h7 +66 -8"),
    ("one short paragraph", "-a1 -a1 -a2 -9 +h6 +21 -10"),
    ("menu words without links", "-1 -1 -2 -1 +h8 +48 +36 +55 -1 -2 -9"),
    ("crumbs of half-linked lines", "-l4 -l6 +h6 +43 +29 +51 -l5 -l8"),
    ("quotes of one line", "-a1 -a1 -6 +h9 +38 +2 +1 +3 +45 +2 +30 -12"),
    ("dialogue", "-a1 -a1 +h4 +6 +9 +5 +12 +8 +7 +10 +35 +6 +11 -9"),
    ("side column of links in the middle", "-a1 -a1 +h7 +56 +33 -a3 -a4 -a3 -11 -a2"),
    ("notice above the menu", "-13 -a1 -a1 -a1 +h6 +47 +22 +39 -9"),
    ("sign-up line below the text", "-a1 -a1 +h8 +54 +41 +29 -10 -a1 -a1"),
    ("marks: article of blocks of any length", "[nav -a1 -a1 -a2 ] [ad -8 ] [article +h9 +33 +1 +1 +18 +1 +2 +40 +3 +1 ] [footer -9 ]"),
    ("marks: article that ends with short lines", "[nav -a1 -a1 ] [article +h1 +22 +3 +2 +1 +31 +1 ] [ad -11 ] [footer -12 ]"),
    ("marks: article of short lines", "[nav -a1 -a1 ] [ad -7 ] [article +h2 +1 +2 +1 +4 +1 +1 ] [footer -8 ]"),
    ("marks: article to the end", "[nav -a1 ] [ad -12 ] [article +h4 +1 +25 +16 +1 +1 ]"),
    ("marks: article alone", "[article +h1 +1 +14 +2 ]"),
    ("marks: article without title", "[nav -a1 -a3 ] [article +2 +41 +1 +9 +1 ] [footer -1 ]"),
    ("marks: linked lines in the article", "[nav -a1 -a1 ] [main +h6 +a2 +30 +a8 +l6 +1 +a1 +12 ] [footer -a1 -l4 -9 ]"),
    ("marks: comments as long as the text", "[nav -a1 -a1 ] [article +h7 +36 +1 +28 ] [comments -40 -2 -33 -1 -25 ] [footer -10 ]"),
    ("marks: column as long as the text", "[header -2 -18 ] [sidebar -38 -45 -1 -30 ] [main +h3 +29 +2 +1 +44 ] [footer -32 ]"),
    ("marks: notices among the paragraphs", "[notice -26 ] [article +h5 +27 [ad -31 ] +1 +38 [promo -20 ] +2 +1 ] [footer -9 ]"),
    ("page of links", "-a3 -a5 -a4 -a6 -a3 -a2 -9"),
    ("page of links with lines", "-a4 -11 -a5 -13 -a3 -9 -a6 -12"),
]


def page_of(layout: str) -> str:
    """A layout as a page; a mark is an element of that name, or else a class."""
    parts, ends = [], []
    for item in layout.split():
        if item == "]":
            parts.append(ends.pop())
        elif item[0] == "[":
            tag = item[1:] if item[1:] in ("nav", "article", "main", "header", "footer") else "div"
            parts.append(f"<{tag} class='{item[1:]}'>" if tag == "div" else f"<{tag}>")
            ends.append(f"</{tag}>")
        else:
            parts.append(block_of(item[0], item[1:].rstrip("0123456789"), int(item.lstrip("+-ahl"))))
    return f"<body>{''.join(parts)}</body>"


def block_of(label: str, kind: str, count: int) -> str:
    words = [label + "word", *["word"] * (count - 1)]
    linked = {"a": count, "l": max(1, count // 2)}.get(kind, 0)
    link = f"<a href='x'>{' '.join(words[:linked])}</a> " if linked else ""
    tag = "h1" if kind == "h" else "div"
    return f"<{tag}>{link}{' '.join(words[linked:])}</{tag}>"


_W = "word " * 40
_S = "a few words here "

EXAMPLES: list[tuple[str, str]] = [
    ("plain article between navigation and footer", f"""
<body><nav><ul><li><a href="/1">-home</a></li><li><a href="/2">-about us</a></li></ul></nav>
<article><h1>+Title of it</h1><p>+{_W}</p><p>+Yes.</p><p>+{_W}<br>+{_S}</p><p>+{_W}</p></article>
<footer>-&copy; host &middot; {_S}</footer></body>"""),
    ("advert before the article, short paragraphs inside", f"""
<body><div class="ad">-{_S} {_S}</div><article><h1>+Title {_S}</h1><p>+Is.</p><p>+{_S}</p><p>+{_W}</p><p>+No more.</p></article>
<footer>-{_S}</footer></body>"""),
    ("long advert and notice, links inside the article", f"""
<body><div class="cookie-notice">-{_W}</div><div class="ad">-{_W}</div><main><h1>+{_S}</h1><p>+{_W} <a href="x">some {_S}</a></p>
<p>+<a href="y">a whole linked line</a></p><ul><li>+{_S}</li><li>+one</li></ul></main><aside>-{_W}</aside><footer>-{_W}</footer></body>"""),
    ("reader comments after the article", f"""
<body><header>-Site name <a href="/">home</a></header><article><h1>+Head</h1><p>+{_W}</p><p>+{_S}</p></article>
<section id="comments"><p>-{_W}</p><p>-{_S}</p><div class="comment">-{_W}</div></section></body>"""),
    ("comments, adverts and forms inside the article element", f"""
<body><article><h2>+{_S}</h2><p>+{_W}</p><div class="ad">-{_S}</div><p>+{_W}</p><aside>-{_W}</aside><p>+Short.</p>
<form>-Mail <label>-{_S}</label><button>-Send</button></form><div class="comments"><p>-{_W}</p><p>-{_S}</p></div></article></body>"""),
    ("sidebar with long text, article in a div", f"""
<body><div class="header">-{_S}</div><div class="sidebar">-{_W}<p>-{_W}</p><p>-{_S}</p></div><div class="content"><h1>+{_S}</h1>
<p>+{_W}</p><p>+{_S}</p><p>+No.</p></div><div class="footer">-{_S}</div></body>"""),
    ("no marks at all: text length and links decide", f"""
<body><div><a href="1">-home</a></div><div><a href="2">-news and more</a></div><div>-menu</div><h1>+The long title {_S}</h1><p>+{_W}</p><p>+{_W}</p>
<p>+{_W}</p><div>-Imprint</div><div><a href="3">-contact page</a></div></body>"""),
    ("no marks: linked lists around text", f"""
<body><ul><li><a href="1">-one link here</a></li><li><a href="2">-another link</a></li><li><a href="3">-third</a></li></ul><p>+{_W}</p><p>+{_W}</p>
<p>+{_W} {_W}</p><p><a href="4">-linked {_W}</a></p><div>-All rights</div></body>"""),
    ("no marks: a page of paragraphs", f"<body><p>+{_W}</p><p>+{_W}</p><p>+{_W}</p><p>-Top</p></body>"),
    ("text without markup", f"+{_W}"),
    ("header inside the article keeps its title", f"""
<body><header>-{_W}</header><article><header><h1>+{_S}</h1></header><p>+{_W}</p><footer>-{_S}</footer></article><nav>-{_W}</nav></body>"""),
]
EXAMPLES += [(shows, page_of(layout)) for shows, layout in LAYOUTS]
