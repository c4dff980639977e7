"""Main text of web pages: flat text blocks, classified by a decision tree over the word counts and link densities of neighbours."""

from __future__ import annotations

import html as entities
import random
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.llm.common import bounded_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^<>"'])*)>""", re.DOTALL)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.IGNORECASE)
LABEL = re.compile(r'data-label="([01])"')
NEXT_TAG = re.compile(r"<[/!a-zA-Z]")

# Elements of HTML by what they mean for blocks.
SKIPPED = frozenset("script style noscript template title svg math iframe object canvas audio video select textarea".split())
RAW = frozenset("script style title textarea".split())  # without an end tag they reach to the end of the page; of the others only the tag goes
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article main section div nav header footer aside form menu dialog fieldset ul ol table figure details body".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd label button pre blockquote figcaption summary caption legend".split())
BAD_ELEMENTS = frozenset("nav footer aside form menu dialog fieldset".split())

# Parts of class names, ids and roles. A strong part marks boilerplate wherever it stands in a name; a weak one only as the
# last part or before parts that name a layout box ("menu-item", but not "header-image" or "notice-board").
STRONG = re.compile(
    r"ads?|advert\w*|adbox|cookies?|consent|gdpr|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|sidebar|nav\w*|promo\w*|newsletter|subscri\w*|popup|modal|"
    r"breadcrumbs?|sponsor\w*|pagination|pager|complementary|contentinfo"
)
WEAK = frozenset("banner menu widget widgets footer header masthead toolbar tags notice notices notification alert disclaimer login search dialog".split())
GOOD = frozenset("article content post entry story main body text".split())
BOXES = frozenset("area bar block box button buttons container form group inner item items left links list message outer overlay panel region right section text title top wrap wrapper".split())
FRAMES = frozenset("container inner layout outer wrap wrapper".split())
MODIFIERS = frozenset("has is no not with without".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_bad_element", "bad_name", "good_name", "heading", "item", "outside_article",
    "in_header", "level",
)


def judged_names(attributes: str) -> tuple[int, bool, bool]:
    """(0 no boilerplate name, 1 weak, 2 strong; whether a whole name is a strong part; whether there is a content name) of a start tag."""
    bad, whole, good = 0, False, False
    for value in NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [p for p in CAMEL.sub("-", name).replace("_", "-").lower().replace("side-bar", "sidebar").split("-") if p]
            if not parts or parts[0] in MODIFIERS:
                continue
            good = good or any(p in GOOD for p in parts)
            if parts[0] in GOOD and (parts[-1] in FRAMES or parts[-1] == "header"):
                continue
            if any(STRONG.fullmatch(p) for p in parts):
                bad, whole = 2, whole or len(parts) == 1
            elif bad == 0 and any(p in WEAK and all(q in BOXES or q in WEAK for q in parts[k + 1 :]) for k, p in enumerate(parts)):
                bad = 1
    return bad, whole, good


OUTERMOST = ("", False, False, 0, False, False)


def nested(outer: tuple, name: str, attributes: str) -> tuple:
    """State below a container: (element, in article, in boilerplate element, boilerplate name, content name, in header).

    Names of `body` and `main` say what else the page has, so they are not passed down; of an `article` only a whole strong name
    counts (a comment, a teaser). A content name or an article inside a weakly named box starts afresh; `main` always does.
    """
    _, article, bad_element, bad_name, good_name, in_header = outer
    bad, whole, good = judged_names(attributes) if attributes else (0, False, False)
    if name == "body":
        bad, good = 0, False
    elif name == "main":
        bad, bad_name = 0, 0
    elif name == "article":
        bad = 2 if whole else 0
    if bad_name == 1 and (good or name == "article"):
        bad_name = 0
    return (
        name, article or name in ("article", "main"), bad_element or name in BAD_ELEMENTS, max(bad_name, bad), good_name or good, in_header or name == "header",
    )


def flat_blocks(source: str) -> list[dict]:
    """Text blocks in page order with their features; markup of any brokenness is read in one pass whose time is linear in the page."""
    blocks: list[dict] = []
    parts: list[str] = []
    linked = 0
    in_link = False
    stack = [OUTERMOST]
    opened: dict[str, int] = {}
    endless: set[str] = set()  # skipped elements that have no end tag from here on
    leaf, label, has_article = "", None, False

    def close_block() -> None:
        nonlocal parts, linked, label
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                _, article, bad_element, bad_name, good_name, in_header = stack[-1]
                level = int(leaf[1]) if leaf[:1] == "h" else 0
                blocks.append({
                    "text": " ".join(words), "words": len(words), "links": min(1.0, linked / len(words)), "in_article": article, "in_bad_element": bad_element, "bad_name": bad_name > 0,
                    "good_name": good_name, "heading": level > 0, "level": level, "item": leaf == "li", "in_header": in_header, "label": label,
                })
        parts, linked, label = [], 0, None

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.split())

    at = 0
    while (m := TAG.search(source, at)) is not None:
        add(source[at : m.start()])
        at = m.end()
        if (name := m[2]) is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1]), m[3] or ""
        if name in SKIPPED:
            if not closing and not attributes.endswith("/") and name not in endless:
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(source)
                else:
                    endless.add(name)
            continue
        if name == "option":
            # Its end tag is optional and it holds text only, so it ends at the next tag.
            if not closing:
                end = NEXT_TAG.search(source, at)
                at = end.start() if end else len(source)
            continue
        if name == "a":
            in_link = not closing
            continue
        if name not in BLOCKS:
            continue
        close_block()
        if name in CONTAINERS:
            in_link = False
            if not closing:
                has_article = has_article or name in ("article", "main")
                stack.append(nested(stack[-1], name, attributes))
                opened[name] = opened.get(name, 0) + 1
            elif opened.get(name):
                last = ""
                while last != name:
                    last = stack.pop()[0]
                    opened[last] -= 1
        if name in LEAVES:
            leaf = "" if closing else name
            if not closing and attributes and judged_names(attributes)[0]:
                # A lone element with such a name: its text is a block under it.
                end = re.compile(rf"</{name}\b[^>]*>|<(?:p|div|h[1-6]|li|article|section)\b", re.IGNORECASE).search(source, at)
                stop = end.start() if end else len(source)
                stack.append(stack[-1][:3] + (2,) + stack[-1][4:])
                add(TAG.sub("", source[at:stop]))
                close_block()
                stack.pop()
                at = stop
        elif name in ("br", "hr"):
            pass
        else:
            leaf = ""
        if not closing and (found := LABEL.search(attributes)):
            label = int(found[1])
    add(source[at:])
    close_block()
    for k, block in enumerate(blocks):
        before, after = blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < len(blocks) else None
        block["words_before"], block["links_before"] = (before["words"], before["links"]) if before else (0, 0.0)
        block["words_after"], block["links_after"] = (after["words"], after["links"]) if after else (0, 0.0)
        block["outside_article"] = has_article and not block["in_article"]
    return blocks


def labelled_pages(pages: int = 400, seed: int = 5) -> list[str]:
    """The labelled table: pages of varied layout, made by rule, whose blocks carry data-label 1 (article) or 0."""
    rng = random.Random(seed)
    words = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all we can her has there".split()
    text = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
    no, yes = 'data-label="0"', 'data-label="1"'

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li {no}><a href="/{i}">{text(1, 3)}</a></li>' for i in range(rng.randint(low, high))) + "</ul>"

    def clutter(kind: str) -> str:
        title = rng.choice(["", "", f"<h2 {no}>{text(1, 4)}</h2>", f"<h3 {no}>{text(1, 6)}</h3>", f"<h4 {no}>{text(1, 3)}</h4>"])
        body = title + "".join(f"<p {no}>{text(2, 40)}</p>" for _ in range(rng.randint(1, 3)))
        return {
            "nav": f"<nav>{links(3, 8)}</nav>", "header": f"<header><div {no}>{text(1, 8)}</div>{links(0, 3)}</header>", "aside": f"<aside>{body}{links(0, 5)}</aside>",
            "ad": f'<div class="{rng.choice(["ad", "advert", "banner-ad", "sponsored"])}" {no}>{text(3, 30)}</div>', "cookie": f'<div id="{rng.choice(["cookie-notice", "consent", "notice"])}">{body}</div>',
            "form": f"<form {no}>{text(1, 8)}{title}<label {no}>{text(1, 4)}</label><button {no}>{text(1, 2)}</button></form>",
            "comments": f'<{(t := rng.choice(["section", "div"]))} class="{rng.choice(["comments", "comment-list", "comments-area"])}">{body}</{t}>', "related": f'<div class="related">{title}{links(2, 6)}</div>',
            "share": f'<div class="share">{links(2, 4)}</div>', "menu": f'<div class="menu">{links(3, 8)}</div>', "lone": f'<p class="advert" {no}>{text(4, 20)}</p>',
            "plain": f"<div>{title}{links(3, 9)}</div>",
        }[kind]

    def article() -> str:
        parts = [f"<h1 {yes}>{text(1, 14)}</h1>"]
        for _ in range(rng.randint(1, 9)):
            parts.append(rng.choice([f"<p {yes}>{text(1, 120)}</p>"] * 5 + [f"<p {yes}>{text(1, 6)}</p>"] * 3 + [f"<h2 {yes}>{text(1, 8)}</h2>", f"<ul><li {yes}>{text(2, 20)}</li><li {yes}>{text(2, 20)}</li></ul>", f"<blockquote {yes}>{text(3, 40)}</blockquote>",
                                     f'<p {yes}>{text(10, 40)} <a href="/x">{text(1, 3)}</a> {text(5, 40)}</p>']))
            if rng.random() < 0.15:
                parts.append(clutter(rng.choice(["ad", "aside", "share", "form", "lone"])))
        if rng.random() < 0.2:
            parts.append(clutter("comments"))
        return "".join(parts)

    made = []
    kinds = ["nav", "header", "aside", "ad", "cookie", "form", "related", "share", "menu", "plain", "comments"]
    shells = ["<article>{}</article>"] * 3 + [
        "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="content">{}</div>', '<div id="article-body">{}</div>', "<div>{}</div>", "{}",
        '<main class="content with-sidebar">{}</main>', '<article class="post tags header-image">{}</article>', '<div class="has-header"><div class="entry">{}</div></div>',
        '<div class="header-image"><div>{}</div></div>', "table", "table",
    ]
    for _ in range(pages):
        shell = rng.choice(shells)
        if shell == "table":  # a page laid out by a table, with a column of links
            shell = f"<table><tr><td>{links(3, 8)}</td><td>{{}}</td></tr></table>"
        before = "".join(clutter(rng.choice(kinds)) for _ in range(rng.randint(0, 4)))
        after = "".join(clutter(rng.choice(kinds)) for _ in range(rng.randint(0, 3)))
        made.append(f"<html><body>{before}{shell.format(article())}{after}<footer><p {no}>{text(3, 25)}</p></footer></body></html>")
    return made


def feature_vector(block: dict) -> list[float]:
    return [float(block[name]) for name in FEATURES]


def train_tree(spark: SparkSession, pages: list[str] | None = None, depth: int = 9) -> str:
    """Fit a decision tree on labelled pages and return it as a SQL condition over a block `b` with the fields FEATURES."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = [(float(b["label"]), Vectors.dense(feature_vector(b))) for page in (labelled_pages() if pages is None else pages) for b in flat_blocks(page) if b["label"] is not None]
    table = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(table)

    def condition(node) -> str:
        if node.subtreeDepth() == 0:
            return "true" if node.prediction() == 1.0 else "false"
        split = node.split()
        return f"IF(b.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {condition(node.leftChild())}, {condition(node.rightChild())})"

    return condition(model._java_obj.rootNode())


def page_blocks(source: Column | str) -> Column:
    """Array of blocks (text and FEATURES as doubles) of an HTML column, row-local."""
    fields = [("text", pa.string()), *((name, pa.float64()) for name in FEATURES)]

    def parsed(pages: pa.Array) -> pa.Array:
        rows = [[{"text": b["text"], **{n: float(b[n]) for n in FEATURES}} for b in flat_blocks(page.as_py() or "")] for page in pages]
        return pa.array(rows, pa.list_(pa.struct(fields)))

    return F.arrow_udf(parsed, "array<struct<text:string," + ",".join(f"{n}:double" for n in FEATURES) + ">>")(source)


def main_text(pages: DataFrame, html: str = "html", tree: str | None = None, name: str = "main_text") -> DataFrame:
    """`pages` with the column `name`: the blocks that the tree takes for the article, joined by one space.

    Null and empty pages, and pages without an article, have an empty text. Pages are read whole; no row is moved. A column
    that is already called `name` is replaced.
    """
    bounded_batches()
    condition = tree or train_tree(pages.sparkSession)
    blocks = pages.withColumn("_page_blocks", page_blocks(html))
    taken = F.expr(f"array_join(transform(filter(_page_blocks, b -> {condition}), b -> b.text), ' ')")
    return blocks.withColumn(name, F.coalesce(taken, F.lit(""))).drop("_page_blocks")
