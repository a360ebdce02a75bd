"""Main-text extraction from web pages by tree scoring.

A page is read into a tree of elements. Subtrees that are never article text
(navigation, footers, asides, forms, scripts, and elements whose class, id or
role names an advert, a notice, a sidebar, reader comments and the like) give no
text. Every block with text then passes points, for its length and its commas
and less its share of link text, to its ancestors: all to the parent, half to
the next, a falling share further up. The container with the most points,
discounted by its own link density, is the article; where the page itself names a
container around it as the article, that one is. Siblings with a fair part of
its points, and headings before it, are kept with it. All the text of those
containers is returned.

A class name drops by itself only where it names nothing but a part around the
article (site-footer), or reader comments. Where such a word stands beside one that
tells of a topic (share-price), or has a plain meaning as well (discussion), the
element is kept if it reads like the article: little of it links, commas, and most
of it in blocks of a sentence and more. Outside a named article it then competes by
its points but joins no other container. If all this leaves no text, words with a
plain meaning are doubted too.

Edge cases: null or empty html gives an empty text, markup without text too;
unclosed and misnested tags close as browsers close them; attributes and nesting
of any size are read as such; a page whose blocks hold no points falls back on
its first article, main or body element; repeated rows are read each; own columns
named text or n_chars give way to the new ones; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read

#: A comment, a declaration (CDATA among them, which browsers read as a comment), or the start of a tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)", re.S)
#: What ends a tag or begins a quoted value in it.
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")
#: Names that only say what a page around has or lacks, as in has-sidebar.
ABOUT = re.compile(r"^(?:has|with|no|without|is|hide|show)[-_]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag of theirs, or of a block for ``p``, closes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: What keeps those closings inside a list or table of their own.
SCOPE = frozenset("ul ol dl table select html body article section div".split())

#: Elements that do not hold another of their kind.
SELF_CLOSING = frozenset("a h1 h2 h3 h4 h5 h6".split())

#: Elements that hold no article text.
DROP = frozenset("nav footer aside form button select head script style noscript iframe template svg math textarea title dialog menu object canvas audio video".split())
#: Words of a class, id or role that name parts around an article.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbygoogle adsense adslot adunit banner breadcrumb breadcrumbs byline cookie cookies consent disclaimer gdpr "
    "footer header masthead login menu modal nav navbar navigation navigationbar newsletter notice notices alert notification overlay pager pagination popup "
    "promo promoted promotion recommended related search share sharing shares sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription toolbar toc widget widgets contentinfo complementary".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: Words that may name reader comments or a section of the article.
TALK_WORDS = frozenset("discussion replies reply respond response responses".split())
#: Words of DROP_WORDS with a plain meaning as well.
PLAIN_WORDS = frozenset("alert banner notice notices promotion recommended related search share shares sharing social subscription".split())
#: Words in a name that tell nothing of what the element is about.
FRAME_WORDS = frozenset(
    "area articles bar bottom button buttons center col column container fixed global group holder icon icons inner items layout left link links lists module nav outer page panel "
    "placeholder posts primary region right row secondary section site slot stories sub tertiary title top wrap wrapper zone".split()
)
#: Words that say the element holds the article after all.
KEEP_WORDS = frozenset("article articlebody content entry main post story".split())
#: Of those, the ones that name the article alone.
ARTICLE_WORDS = KEEP_WORDS - {"content", "main"}
#: What may follow a word for a part in the name of an article element, as in comment-body.
ITEM_WORDS = frozenset("body box card item list thread unit".split())
#: Words for a part around the article that say nothing inside it.
IN_ARTICLE = frozenset("header byline search toc skip".split())
#: Characters of a block that holds a sentence.
SENTENCE = 80
#: Points of an element for what it is.
TAG_POINTS = {"article": 10.0, "main": 10.0, "section": 2.0, "div": 2.0, "td": 1.0, "blockquote": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
CONTAINERS = frozenset("article main section div td body blockquote center".split())
SIBLING_SHARE = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def part_of_page(tag: str, attrs: str, in_article: bool, doubt: bool = False) -> str:
    """``drop`` for a part around the article, ``article`` or ``keep`` for what is named as the article or its frame, ``maybe`` if its text must tell.

    With ``doubt`` no name decides that has a plain meaning.
    """
    if tag in DROP or tag == "header" and not in_article:
        return "drop"
    plain = "article" if tag == "article" else "keep" if tag == "main" else ""
    if tag in ("html", "body") or not attrs or attrs.isspace():
        return plain
    names: set[str] = set()
    words: set[str] = set()
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "drop"
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "drop"
        else:
            names.update(n for n in value.split() if not ABOUT.match(n))
    if tag in ("article", "main"):
        for n in names:  # an article's class often names its topics, so a name must mean nothing else
            parts = set(PART.findall(n))
            if parts & (COMMENT_WORDS | DROP_WORDS) and not any(w not in COMMENT_WORDS | DROP_WORDS | ITEM_WORDS and w.isalpha() for w in parts):
                return "drop"
        return plain
    for n in names:
        words.update(PART.findall(n))
    if words & COMMENT_WORDS:
        return "drop"
    if words & KEEP_WORDS:
        # A part of the article named after it, as story-share, is what its last word says.
        if in_article and any(p[-1] in DROP_WORDS - IN_ARTICLE and set(p) & KEEP_WORDS for n in names if (p := [w for w in PART.findall(n) if w not in FRAME_WORDS])):
            return "maybe"
        return "article" if words & ARTICLE_WORDS else "keep"
    around = DROP_WORDS - IN_ARTICLE if in_article else DROP_WORDS
    if not words & (around | TALK_WORDS):
        return ""
    # A name drops if it holds nothing but such words and words of the frame; otherwise, as in related-work, the text tells.
    sure = DROP_WORDS - PLAIN_WORDS if doubt else DROP_WORDS
    for n in names:
        parts = {w for w in PART.findall(n) if w.isalpha()}
        if parts & sure & around and not parts - DROP_WORDS - ITEM_WORDS - FRAME_WORDS:
            return "drop"
    return "maybe"


class TagEnds:
    """Where the tags of a page end: at the first ``>`` outside quoted values, of any length and number.

    A quote that is never closed is none. Once a tag would run to the end of the
    page, quotes are passed over from there on, so that the work stays linear.
    """

    def __init__(self, html: str):
        self.html, self.quotes = html, True

    def after(self, start: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``start``; -1 if there is none."""
        at = start
        while self.quotes and (m := STOP.search(self.html, at)):
            if m[0] == ">":
                return m.start()
            close = self.html.find(m[0], m.end())
            at = close + 1 if close >= 0 else m.end()
        self.quotes = False
        return self.html.find(">", start)


def main_text(html: str | None) -> str:
    """The article's text; blocks in page order, joined by one space."""
    if not html:
        return ""
    return read_page(html) or read_page(html, doubt=True)


def read_page(html: str, doubt: bool = False) -> str:
    """The text of the best container; with ``doubt`` names with a plain meaning do not decide."""
    ends, opened = TagEnds(html), Counter()  # elements open by name
    tags, parents, drops, in_article, blocks, parts = ["html"], [0], [False], [False], [0], [""]
    texts: list[tuple[int, bool, str]] = []  # node, in a link, text; a space where a block or line ends
    stack, links = [0], 0
    at, size = 0, len(html)

    def close_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            node = stack.pop()
            links -= tags[node] == "a"
            opened[tags[node]] -= 1
            if tags[node] in BLOCK:
                texts.append((node, False, " "))

    last = html.rfind(">")
    begin = html.find("<")
    while 0 <= begin:
        m = TOKEN.match(html, begin) if begin < last or html.startswith("<!", begin) else None
        end = ends.after(m.end()) if m is not None and m["tag"] else -1
        if m is None or m["tag"] and end < 0:
            if begin > last:
                break
            begin = html.find("<", begin + 1)
            continue
        if m.start() > at and not drops[stack[-1]]:
            texts.append((stack[-1], links > 0, unescape(html[at : m.start()])))
        at = end + 1 if m["tag"] else m.end()
        begin = html.find("<", at)
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "br":
                texts.append((stack[-1], False, " "))
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if tags[stack[depth]] == tag:
                    close_to(depth)
                    break
                if tag not in BLOCK and tags[stack[depth]] in BLOCK and tags[stack[depth]] != "p":
                    break  # an inline end tag does not close the block around it
            continue
        if tag in ("html", "body") and len(stack) > 1 and tag in (tags[s] for s in stack):
            continue
        if tag == "html":
            continue
        shut = CLOSED_BY.get(tag, ())
        may = any(opened[t] for t in shut) or tag in BLOCK and opened["p"] or tag == "body" and opened["head"] or tag in SELF_CLOSING and opened[tag]
        for depth in range(len(stack) - 1, 0, -1) if may else ():
            above = tags[stack[depth]]
            if above in shut or above == "p" and tag in BLOCK or above == "head" and tag == "body" or above == tag and tag in SELF_CLOSING:
                close_to(depth)
                if not shut:
                    break
            elif above in SCOPE:
                break
        top = stack[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                texts.append((top, False, " "))
            continue
        if tag in BLOCK:
            texts.append((top, False, " "))
        node = len(tags)
        tags.append(tag)
        parents.append(top)
        attrs = html[m.end() : end]
        part = part_of_page(tag, attrs, in_article[top], doubt)
        in_article.append(in_article[top] or part == "article" or tag == "main")
        drops.append(drops[top] or part == "drop")
        parts.append(part)
        blocks.append(node if tag in BLOCK else blocks[top])
        if attrs.endswith("/") and tag in ("svg", "math", "iframe"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else size
            begin = html.find("<", at)
            continue
        stack.append(node)
        opened[tag] += 1
        links += tag == "a"
    if at < size and not drops[stack[-1]]:
        texts.append((stack[-1], links > 0, unescape(html[at:])))

    n = len(tags)
    if "maybe" in parts:
        set_aside(drops, parts, parents, blocks, texts)
        texts = [t for t in texts if t[2] == " " or not drops[t[0]]]
    chars, linked, commas = [0] * n, [0] * n, [0] * n
    for node, in_link, text in texts:
        if text != " " and (k := len(text.strip())):
            block = blocks[node]
            chars[block] += k
            linked[block] += k * in_link
            commas[block] += text.count(",") + text.count("،") + text.count("、") + text.count("，")
    points = [TAG_POINTS.get(t, 0.0) for t in tags]
    scored = [False] * n
    for block in range(n):
        k = chars[block]
        if not k:
            continue
        given = (min(k / 25, 1) + commas[block] + min(k / 100, 3)) * (1 - linked[block] / k)
        node = block if tags[block] in CONTAINERS else parents[block]
        level = 0
        while True:
            points[node] += given if level == 0 else given / 2 if level == 1 else given / (3 * level)
            scored[node] = scored[node] or given > 0
            if node == 0 or level == 6:
                break
            node, level = parents[node], level + 1
    for node in range(n - 1, 0, -1):
        chars[parents[node]] += chars[node]
        linked[parents[node]] += linked[node]
    found = [i for i in range(n) if scored[i] and not drops[i] and tags[i] not in ("html", "ul", "ol", "dl", "table", "tbody", "tr")]
    for i in found:
        points[i] *= 1 - linked[i] / max(chars[i], 1)
    if found:
        best = max(found, key=lambda i: (points[i], -i))
    else:
        best = next((i for want in ("article", "main", "body") for i in range(n) if tags[i] == want and not drops[i]), 0)
    best = article_around(best, tags, parents, parts, chars, linked)
    chosen = {best}
    if best and tags[best] not in ("body", "main"):
        least = max(10.0, SIBLING_SHARE * points[best])
        for i in range(1, n):
            if parents[i] == parents[best] and i != best and not drops[i] and chars[i]:
                density = linked[i] / chars[i]
                if i < best and tags[i] in HEADINGS and density < 0.25:
                    chosen.add(i)
                if points[i] >= least and tags[i] in CONTAINERS and (parts[i] != "maybe" or in_article[i]) or tags[i] == "p" and density < 0.25 and chars[i] > 80:
                    chosen.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in chosen or (i > 0 and inside[parents[i]])
    return " ".join("".join(t if inside[node] or t == " " else " " for node, _, t in texts).split())


def set_aside(drops: list[bool], parts: list[str], parents: list[int], blocks: list[int], texts: list[tuple[int, bool, str]]) -> None:
    """Drop the elements with a doubtful name, and all in them, unless they read like the article: sentences, with commas, and few links."""
    n = len(parts)
    chars, linked, commas, long = [0] * n, [0] * n, [0] * n, [0] * n
    own = [0] * n
    for node, in_link, text in texts:
        k = len(text.strip())
        chars[node] += k
        own[blocks[node]] += k
        linked[node] += k * in_link
        commas[node] += text.count(",") + text.count("،") + text.count("、") + text.count("，")
    for node in range(n):
        long[node] = own[node] if own[node] >= SENTENCE else 0
    for node in range(n - 1, 0, -1):
        for sums in (chars, linked, commas, long):
            sums[parents[node]] += sums[node]
    for node in range(1, n):
        prose = long[node] >= 0.5 * chars[node] > 0 and commas[node] >= chars[node] / 400 and linked[node] < 0.1 * chars[node]
        drops[node] = drops[node] or drops[parents[node]] or parts[node] == "maybe" and not prose


def article_around(best: int, tags: list[str], parents: list[int], parts: list[str], chars: list[int], linked: list[int]) -> int:
    """The outermost container that the page names as the article around ``best``; ``best`` if there is none.

    An article element counts as it is; a container known by its class only if
    half of its text is the article and little of the rest is links.
    """
    found, node = best, best
    named = ""
    while node:
        node_chars = max(chars[node], 1)
        near = chars[best] >= 0.5 * node_chars and linked[node] < 0.3 * node_chars
        if tags[node] == "article" or tags[node] == "main" and named != "article" or parts[node] and named not in ("article", "main") and near:
            found, named = node, tags[node]
        node = parents[node]
    return found


def extract_main_text(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` (main text of the whole html) and ``n_chars`` (its code points)."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]

    def work(pages):
        texts = [main_text(h) for h in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(df, html, keep, "text string, n_chars long", lambda: work)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
