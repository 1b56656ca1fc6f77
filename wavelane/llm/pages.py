"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut at block-level tags into flat text blocks. A block's features are its words and link
density, those of the blocks before and after it, and where it stands (inside navigation, footers,
forms or the like, inside an element whose class or id says advert, sidebar, notice or comments,
inside an article). A decision tree, trained by Spark on the small labelled table that
``labelled_blocks`` makes from the marked pages below, says which blocks belong to the article;
their texts joined by one space are the page's text. Scripts, styles, markup, comments in the
source and the head are no blocks. Pages are judged one by one where they lie: no shuffle.

Defined cases: null or empty html gives an empty text; html that ends inside a tag, a comment or a
script loses only that; unclosed tags close with the element around them; repeated rows are
extracted each; extra columns can be carried along.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches

TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg math title textarea select option iframe object canvas audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = frozenset("address article aside body blockquote button center dd details dialog div dl fieldset figure footer form header html li main menu nav ol p section span table td tr ul".split())
SIDE_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())
SIDE_WORDS = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|comments?|commentlist|respond|repl(?:y|ies)|disqus|cookies?|consent|gdpr|notices?|notification\w*|alerts?|newsletter|subscri\w*|signup|login|shar(?:e|ing)|social|related|recommend\w*|menu\w*|nav\w*|breadcrumbs?|footer|header|masthead|toolbar|pag(?:ination|er)|popup|modal|overlay|widgets?|copyright|legal|disclaimer|search\w*|outbrain|taboola|teaser|trending|hidden"
)
MAIN_WORDS = re.compile(r"article\w*|entry|post|story|content|main|body|text|prose")
UNLESS = frozenset(("has", "with", "no", "without", "show", "hide", "is"))
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "side_tag", "side_word", "article", "heading")


def _side(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(side element, side word, main word) of an opening tag."""
    values = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(attributes)}
    names = f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}"
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names)) if w]
    main = tag in ("article", "main") or any(MAIN_WORDS.fullmatch(w) for w in words)
    # A name such as "has-sidebar" tells of something else, "entry-header" of the article's own.
    told = [w for i, w in enumerate(words) if SIDE_WORDS.fullmatch(w) and not (i and words[i - 1] in UNLESS)]
    if main:
        told = [w for w in told if w not in ("header", "text", "body")]
    unseen = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
    return tag in SIDE_TAGS, tag not in ("html", "body", "main") and (bool(told) or unseen), main


def blocks(page: str | None) -> list[dict]:
    """The page's flat text blocks in order, with features; ``keep`` is the mark of a labelled page."""
    found: list[dict] = []
    stack: list[tuple[str, bool, bool, bool, str | None]] = []
    parts: list[str] = []
    linked: list[bool] = []
    in_link, heading = 0, False

    def flush() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            links = sum(len(references.unescape(p).split()) for p, a in zip(parts, linked) if a)
            words = len(text.split())
            inside = any(s[3] for s in stack)
            side = any(s[1] and not (s[0] == "header" and inside) for s in stack)
            keep = next((s[4] for s in reversed(stack) if s[4] is not None), None)
            found.append({"text": text, "words": words, "links": min(1.0, links / words), "side_tag": float(side), "side_word": float(any(s[2] for s in stack)), "article": float(inside), "heading": float(heading), "keep": keep})
        parts.clear()
        linked.clear()

    text, at = page or "", 0
    while at < len(text):
        m = TAG.search(text, at)
        stop = m.start() if m else len(text)
        if stop > at:
            parts.append(text[at:stop])
            linked.append(in_link > 0)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6]) if m[5] else ("", None, "")
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>|<body[\s>]" if tag == "head" else rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = len(text) if end is None and tag in ("script", "style") else at if end is None else end.start() if end[0].lower().startswith("<body") else end.end()
            if tag not in ("title", "svg", "math", "canvas"):
                parts.append(" ")
                linked.append(False)
            continue
        if tag in BLOCKS:
            flush()
            heading = not closing and re.fullmatch("h[1-6]", tag) is not None
            in_link = 0 if tag not in ("li", "td") else in_link
        elif tag == "br":
            parts.append(" ")
            linked.append(False)
        elif tag == "a":
            in_link = 0 if closing else 1
        if tag in HOLDERS:
            if not closing:
                if tag in ("p", "li") and any(s[0] == tag for s in stack[-1:]):
                    stack.pop()
                side, word, main = _side(tag, attributes)
                header = tag == "header"
                label = re.search(r"data-keep=.([01])", attributes)
                stack.append((tag, side or header, word, main and not word, label[1] if label else None))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
    flush()
    for i, b in enumerate(found):
        before, after = (found[i - 1] if i else None), (found[i + 1] if i + 1 < len(found) else None)
        b |= {"words_before": before["words"] if before else 0, "links_before": before["links"] if before else 0.0, "words_after": after["words"] if after else 0, "links_after": after["links"] if after else 0.0}
    return found


#: Marked pages: the blocks inside data-keep="1" are the article's, all others are not.
_LONG = "A river town keeps its market open through winter, and people come from the hills to trade wool, bread and news before the roads close."
_SHORT = "It was late."
MARKED = (
    f"""<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li><li>More</li></ul></nav><div class="ad">Buy our new shoes today and save ten percent on every pair you order.</div>
<article data-keep="1"><h1>Winter market</h1><p>{_LONG}<p>{_SHORT}</p><p>{_LONG} {_LONG}</p></article><footer>&copy; Town Press. All texts belong to their authors.</footer></body>""",
    f"""<body><header><h1>Town Press</h1><p>The paper for the whole valley since long ago.</p></header><div id=sidebar><h3>Most read</h3><p>{_LONG}</p></div>
<div class="content" data-keep="1"><h2>Roads close</h2><p>{_LONG}</p><blockquote>{_SHORT}</blockquote><p>{_LONG} See <a href=/x>the map</a> for more.</p><ul><li>Bread</li><li>Wool from the hills</li></ul></div>
<div class="comments"><h3>Comments</h3><p>I was there and {_LONG}</p><p>Me too.</p></div><form><p>Write a comment and send it to us.</p><button>Send</button></form></body>""",
    f"""<body><div class="cookie-notice"><p>We use cookies to make this site work. {_LONG}</p><button>Fine</button></div><main data-keep="1"><header><h1>Letters</h1></header><p>{_LONG}</p><p>{_SHORT}</p>
<div class="related" data-keep="0"><p><a href=/1>{_LONG}</a></p><p><a href=/2>Another story</a></p></div><p>{_LONG}</p></main><aside><p>{_LONG}</p><p>Short note.</p></aside><footer><p>{_LONG}</p><ul><li><a href=/i>Imprint</a></li></ul></footer></body>""",
    f"""<body><table><tr><td><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></td></tr></table><p><a href=/c>Contact</a> | <a href=/h>Help</a> | <a href=/l>Log in</a></p><div data-keep="1"><p>{_LONG}</p><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p></div><p><a href=/t>Terms of use</a></p><p><a href=/p>Privacy</a></p></body>""",
    f"""<body><div class="menu"><p>Start</p><p>Archive of all the years</p></div><section class="post-body" data-keep="1"><h1>A long way</h1><p>{_LONG}</p><h2>Second part</h2><p>{_LONG}</p><p>{_SHORT}</p></section><section class="newsletter"><p>{_LONG}</p></section><section id="comments"><article class="comment"><p>{_LONG}</p></article><article class="comment"><p>Yes.</p></article></section></body>""",
    f"""<body><div class="banner promo">{_LONG} {_LONG}</div><article data-keep="1"><h1>Snow</h1>{_SHORT}<p>{_LONG}</p><div class="share" data-keep="0">Tell your friends about this page</div><p>Only one more word.</p><p>{_SHORT}</p></article><div class="popup"><p>Join {_LONG}</p></div></body>""",
    f"""<body><nav>{_LONG}</nav><article data-keep="1"><p>{_SHORT}</p></article><footer>{_SHORT}</footer></body>""",
    f"""<body><p data-keep="1">{_LONG}</p><p data-keep="1">{_LONG}</p><p data-keep="1">{_LONG} {_LONG}</p></body>""",
    f"""<body><p data-keep="1">{_SHORT}</p><p data-keep="1">Nothing more to say.</p></body>""",
    f"""<body><div data-keep="1">{_SHORT} All went home.</div></body>""",
    f"""<body><article data-keep="1"><p>{_LONG}</p><aside data-keep="0">{_LONG}</aside><p>{_SHORT}</p><nav data-keep="0"><a href=/1>Next</a> part</nav><form data-keep="0"><p>Your mail</p><p>{_LONG}</p></form><p>{_LONG}</p><footer data-keep="0"><p>{_LONG}</p><p>{_SHORT}</p></footer></article></body>""",
    f"""<body><main data-keep="1"><h1>Bread</h1><p>{_LONG}</p><aside data-keep="0"><h3>{_SHORT}</h3><p>{_LONG}</p></aside><ul><li><a href=/w>Wool</a></li><li>Bread and news</li></ul><p><a href=/m>The map of all roads</a></p><p><a href=/n>A list of towns</a></p><p>{_SHORT}</p><form data-keep="0">Mail <button>Go</button></form></main><p><a href=/i>Imprint</a></p></body>""",
)


def labelled_blocks(spark: SparkSession, marked: Sequence[str] = MARKED) -> DataFrame:
    """The labelled table: one row a block, ``label`` 1.0 for the article's."""
    rows = [[float(b[f]) for f in FEATURES] + [1.0 if b["keep"] == "1" else 0.0] for page in marked for b in blocks(page)]
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in (*FEATURES, "label")))


def train(labelled: DataFrame, depth: int = 6) -> tuple:
    """The decision tree as nested tuples: ``(feature, threshold, left, right)`` or a label."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, seed=7).fit(rows)

    def nested(node) -> tuple | float:
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return (int(split.featureIndex()), float(split.threshold()), nested(node.leftChild()), nested(node.rightChild()))

    return nested(model._java_obj.rootNode())


def judge(tree, values: Sequence[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if values[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str | None, tree) -> str:
    return " ".join(b["text"] for b in blocks(page) if judge(tree, [b[f] for f in FEATURES]))


def extract(pages: DataFrame, tree=None, carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``carry`` columns, ``text`` and ``n_chars``: one row for each row of ``pages`` (``html``)."""
    bounded_batches(pages.sparkSession)
    tree = train(labelled_blocks(pages.sparkSession)) if tree is None else tree

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(p, tree) for p in frame["html"]]
            yield frame[list(carry)].assign(text=texts, n_chars=np.array([len(t) for t in texts], dtype=np.int64))

    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)
    return pages.select(*carry, F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInPandas(run, f"{kept}, text string, n_chars bigint")
