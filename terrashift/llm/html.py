"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of text between block-level tags. Each block has features of its ancestors' tags,
classes and ids and of its text; a linear-chain CRF, trained on labelled pages, labels the chain of blocks as main text
or not, and Viterbi decoding picks the labels. The labelled pages are written here from layout rules (articles with and
without telling tags, menus, notices, adverts, forms, comments, sidebars in many arrangements); their number is
``TRAINING_PAGES``.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do roughly (unclosed tags
close with their parents, stray end tags are ignored, a quote that is never closed ends with its tag); scripts, styles
and comments never reach a block. Time and memory are linear in the length of a page, however its tags nest, whatever
quotes it leaves open: blocks share the chain of their ancestors, and no character is looked at again and again.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, with_row

BUCKETS = 4096
TRAINING_PAGES = 360
EPOCHS = 40

# Fixed values of HTML: tags that start and end a block, tags without content, tags whose content isn't text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table"
    " tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title select option textarea".split())
CLOSES = {"p": BLOCK - {"button", "label"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}

#: Elements that an end tag of an inline element doesn't reach beyond.
WALLS = ("article", "body", "table", "main")
CLOSED_BY = {tag: [inner for inner, tags in CLOSES.items() if tag in tags] for tag in BLOCK}

NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")
# A reference by a number of thousands of digits is one to no character.
ZEROS = re.compile("&#0+(?=[0-9])")
NO_CHARACTER = re.compile("&#[0-9]{8,};?")


class Chain:
    """An element with its ancestors: ``parent`` is shared by all that stand within it, ``names`` are the tokens that no
    ancestor has, ``tags`` the last two tags, ``depth`` how many there are."""

    __slots__ = ("parent", "names", "tags", "depth", "article", "score")

    def __init__(self, parent: Chain | None, names: list[str], tag: str):
        self.parent, self.names = parent, names
        tags, depth, article = (parent.tags, parent.depth, parent.article) if parent else ((), 0, False)
        plain = tag in ("html", "body")
        self.tags, self.depth = (tags, depth) if plain else ((*tags[-1:], "<" + tag), depth + 1)
        self.article = article or tag in ("article", "main")
        self.score = None

    def tokens(self) -> list[str]:
        """Tokens of the element and its ancestors, each once."""
        out, at = [], self
        while at:
            out += at.names
            at = at.parent
        return out


ROOT = Chain(None, [], "html")
Block = tuple[Chain, str, int]


class Tags:
    """Finds the tags of a page in one pass. A scan for the end of a tag that fails leaves behind which quotes it tried to
    open, so that a later scan that comes to one of them fails at once."""

    def __init__(self, page: str):
        self.page, self.last, self.failed = page, page.rfind(">"), set()
        self.sections = True

    def end(self, at: int) -> int:
        """Where the tag whose attributes start at ``at`` ends. There is a ``>`` behind it."""
        tried = []
        p, page = at, self.page
        while m := SPECIAL.search(page, p):
            q = m.start()
            if page[q] == ">":
                return q + 1
            if q in self.failed:
                break
            tried.append(q)
            close = page.find(page[q], q + 1)
            if close < 0:
                break
            p = close + 1
        self.failed.update(tried)
        return page.find(">", at) + 1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """Start, end, slash, name and attributes; a comment or declaration has no name. ``resume`` moves on."""
        page, self.at = self.page, 0
        while (start := page.find("<", self.at)) >= 0:
            slash = name = attributes = ""
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                end = close + 3 if close >= 0 else len(page)
            elif start > self.last:
                return
            elif page.startswith(("<!", "<?"), start):
                end = 0
                if self.sections and page.startswith("<![CDATA[", start):
                    end = page.find("]]>", start) + 3
                    if end == 2:
                        self.sections, end = False, 0
                end = end or page.find(">", start) + 1
            elif m := NAME_OF_TAG.match(page, start + 1):
                end = self.end(m.end())
                slash, name, attributes = m[1], m[2].lower(), page[m.end() : end - 1]
            else:
                self.at = start + 1
                continue
            self.at = end
            yield start, end, slash, name, attributes

    def resume(self, at: int) -> None:
        self.at = at


def _decoded(raw: str) -> str:
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = NO_CHARACTER.sub("\ufffd", ZEROS.sub("&#", raw))
    return entities.unescape(raw)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: the chain of ancestors, text, characters of it within links."""
    if not page:
        return []
    found: list[Block] = []
    stack: list[tuple[str, Chain]] = []
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    solid: list[int] = []  # places of blocks that only their own end tags close
    open_names: set[str] = set()
    text: list[str] = []
    linked = hidden = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                found.append((stack[-1][1] if stack else ROOT, joined, linked))
            text.clear()
        linked = 0

    def leave(k: int) -> None:
        """Close the element at ``k`` of the stack and all within."""
        nonlocal hidden, in_link
        while len(stack) > k:
            tag, chain = stack.pop()
            places[tag].pop()
            if solid and solid[-1] == len(stack):
                solid.pop()
            for name in chain.names:
                open_names.discard(name)
            hidden -= tag in HIDDEN
            in_link -= tag == "a"

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    def put(start: int, end: int) -> None:
        nonlocal linked
        if end > start and not hidden:
            text.append(_decoded(page[start:end]))
            if in_link:
                linked += end - start

    tags = Tags(page)
    for start, end, slash, tag, attributes in tags:
        put(at, start)
        at = end
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if slash:
            k = last(tag)
            if k >= 0 and (tag in BLOCK or k >= max(map(last, WALLS))):
                if tag in BLOCK or any(t in BLOCK for t, _ in stack[k:]):
                    flush()
                leave(k)
            continue
        if tag in BLOCK:
            flush()
            k = max(map(last, CLOSED_BY[tag]), default=-1)
            if k > (solid[-1] if solid else -1):
                leave(k)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in ("script", "style"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            tags.resume(at)
            continue
        names = {"<" + tag: None}
        for _, a, b, c in ATTRIBUTE.findall(attributes):
            names |= {"." + w: None for w in NAME.findall((a or b or c).lower())}
        new = [name for name in names if name not in open_names]
        open_names.update(new)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK and tag not in CLOSES:
            solid.append(len(stack))
        stack.append((tag, Chain(stack[-1][1] if stack else None, new, tag)))
        hidden += tag in HIDDEN
        in_link += tag == "a"
    put(at, len(page))
    flush()
    return found


@lru_cache(1 << 16)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def _own_features(chain: list[Block]) -> Iterator[list[int]]:
    """Of each block the features that aren't its ancestors' names."""
    n, headed, before = len(chain), False, None
    share = [int(4 * min(1, linked / len(text))) for _, text, linked in chain]
    for i, (path, text, _) in enumerate(chain):
        size = len(text)
        words = text.count(" ") + 1
        tags = path.tags
        names = {"bias", f"size{int(math.log2(size + 1))}", f"words{min(words, 20) if words < 5 else 5 + int(math.log2(words))}", f"link{share[i]}"}
        names.add("last" + (tags[-1] if tags else ""))
        names.add("two" + "".join(tags))
        end = text[-1] if text[-1] in ".!?:;,|" else "x"
        names.add("end" + end)
        names.add(f"depth{min(path.depth, 6)}")
        headed = headed or "<h1" in tags
        side = "within" if path.article else "outside"
        names |= {side, f"{side} headed{headed}", f"headed{headed} link{share[i]}", f"{side} size{int(math.log2(size + 1))} end{end}", f"{side} link{share[i]}"}
        names.add(f"{side} headed{headed} sentence{end in '.!?'}{min(words // 8, 3)}")
        names.add(f"after {before == path} link{share[i - 1] if i else 'x'}")
        names.add(f"before link{share[i + 1] if i < n - 1 else 'x'}")
        if i == 0:
            names.add("first")
        if i == n - 1:
            names |= {"final", f"{side} final"}
        if "\xa9" in text:
            names.add("copyright")
        before = path
        yield [_bucket(x) for x in names]


def _features(chain: list[Block]) -> list[list[int]]:
    return [own + [_bucket("in" + t) for t in path.tokens()] for (path, _, _), own in zip(chain, _own_features(chain), strict=True)]


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """Best chain of labels 0 and 1."""
    a, b = scores[0]
    back = []
    m00, m01, m10, m11 = move[0, 0], move[0, 1], move[1, 0], move[1, 1]
    for x, y in scores[1:]:
        back.append((a + m00 < b + m10, a + m01 < b + m11))
        a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
    label = int(b > a)
    out = [label]
    for pair in reversed(back):
        label = int(pair[label])
        out.append(label)
    return out[::-1]


class Crf:
    """Two labels; a weight for each feature bucket and label, and one for each move between labels."""

    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move = weights, move

    def _above(self, path: Chain) -> np.ndarray:
        """Sum over the names of an element and its ancestors; each element of a page is summed once."""
        way = []
        while path is not None and path.score is None:
            way.append(path)
            path = path.parent
        total = np.zeros(2) if path is None else path.score
        for step in reversed(way):
            total = total + self.weights[[_bucket("in" + t) for t in step.names]].sum(0) if step.names else total
            step.score = total
        return total

    def label(self, chain: list[Block]) -> list[int]:
        """The best labels of a page's blocks, by Viterbi. Sums are kept in the chains, so a page belongs to one model."""
        if not chain:
            return []
        return viterbi(np.array([self.weights[own].sum(0) + self._above(path) for (path, _, _), own in zip(chain, _own_features(chain), strict=True)]), self.move)

    @classmethod
    def train(cls, pages: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4) -> Crf:
        """Gradient ascent on the conditional log-likelihood, each weight at a rate of its own."""
        w, move = np.zeros((BUCKETS, 2)), np.zeros((2, 2))
        gw, gm = np.full((BUCKETS, 2), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(epochs):
            dw, dm = gradient(w, move, pages)
            dw -= l2 * w
            dm -= l2 * move
            gw += dw * dw
            gm += dm * dm
            w += rate * dw / np.sqrt(gw)
            move += rate * dm / np.sqrt(gm)
        return cls(w, move)


def gradient(w: np.ndarray, move: np.ndarray, pages: list[tuple[list[list[int]], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean log-probability of the pages' labels, by forward and backward sums."""
    dw, dm = np.zeros_like(w), np.zeros_like(move)
    for feats, gold in pages:
        s = np.array([w[f].sum(0) for f in feats])
        n = len(s)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        fwd[0] = s[0]
        for i in range(1, n):
            fwd[i] = s[i] + np.logaddexp(fwd[i - 1, 0] + move[0], fwd[i - 1, 1] + move[1])
        for i in range(n - 2, -1, -1):
            t = s[i + 1] + bwd[i + 1]
            bwd[i] = np.logaddexp(move[:, 0] + t[0], move[:, 1] + t[1])
        z = np.logaddexp(fwd[-1, 0], fwd[-1, 1])
        marginal = np.exp(fwd + bwd - z)
        for i, f in enumerate(feats):
            # Two names may share a bucket, which then counts twice, as it does in the score.
            np.subtract.at(dw, f, marginal[i])
            np.add.at(dw[:, gold[i]], f, 1)
            if i:
                dm -= np.exp(fwd[i - 1][:, None] + move + (s[i] + bwd[i])[None, :] - z)
                dm[gold[i - 1], gold[i]] += 1
    return dw / len(pages), dm / len(pages)


# --- labelled pages -------------------------------------------------------------------------------------------------


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page and its main blocks, laid out by chance: what stands around an article varies in tag, class and place. One
    page in three is plain: its parts are bare elements or have names that tell nothing."""
    r = random.Random(seed)
    plain = r.random() < 0.33
    letters = "abcdefghijklmnopqrstuvwxyzéü"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(1, 9)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + r.choice("....!?")

    def prose() -> str:
        return " ".join(sentence(1, 20) for _ in range(r.choice((1, 1, 2, 4, 8, 16))))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    main: list[str] = []

    def mute() -> str:
        """Attributes that tell nothing."""
        return r.choice(("", "", f' class="{word()}"', f' id="{word()}"', f' class="row {word()}"'))

    def put(tag: str, text: str) -> str:
        main.append(text)
        bold = r.random() < 0.2
        close = "" if tag == "p" and r.random() < 0.3 else f"</{tag}>"
        return f"<{tag}>{'<b>' if bold else ''}{text}{'<br>' if bold else ''}{close}"

    def cls(*names: str) -> str:
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'

    def bare_links() -> str:
        """Links without a telling tag or class."""
        inner = r.choice((f"<ul>{links(r.randint(1, 6))}</ul>", " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(r.randint(1, 6))), "".join(f'<span><a href="{word()}">{word()} {word()}</a></span> ' for _ in range(r.randint(1, 6)))))
        return f"<div{mute()}>{inner}</div>"

    def bare_foot() -> str:
        lead = r.choice(("&copy; ", "\xa9 ", "Copyright ", "Copyright &copy; 2020 ", "All rights reserved ", ""))
        return f"<div{mute()}>{'<p>' * r.randint(0, 1)}{lead}{' '.join(word() for _ in range(r.randint(0 if lead else 1, 5)))}</div>"

    nav = lambda: f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>" if r.random() < 0.7 else f"<div{cls('menu', 'navbar', 'breadcrumbs', 'nav', 'toc')}><ul>{links(4)}</ul></div>"
    advert = lambda: f"<div{cls('ad', 'ads', 'advert', 'sponsor', 'promo', 'banner', 'ad-slot')}>{prose()}</div>"
    notice = lambda: r.choice((f"<div{cls('cookie', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'newsletter')}><p>{prose()}</p><button>{word()}</button></div>", f"<dialog>{prose()}</dialog>"))
    side = lambda: r.choice((f"<aside{mute()}>{r.choice((sentence(1, 12), prose(), ' '.join(word() for _ in range(r.randint(1, 4)))))}</aside>", f"<aside><h3>{word()}</h3><p>{prose()}</p></aside>", f"<div{cls('sidebar', 'related', 'widget', 'share', 'social', 'recommended', 'tags', 'author-bio')}><h3>{word()}</h3><ul>{links(4)}</ul><p>{prose()}</p></div>"))
    form = lambda: f"<form><label>{word()}</label><input><textarea>{prose()}</textarea><p>{prose()}</p><button>{word()}</button></form>"
    comment = lambda: f"<{(t := r.choice(('section', 'div', 'ol')))}{cls('comments', 'comment-list', 'responses', 'discussion', 'replies')}>" + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(r.randint(1, 3))) + f"</{t}>"
    header = lambda: f"<header{r.choice(('', ' class="site-header"'))}><p>{sentence(1, 6)}</p></header>"
    around = lambda k: "".join(r.choice((nav, advert, advert, notice, side, form, header))() for _ in range(k))

    head = f"<head><title>{sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    if plain:
        kinds = (bare_links, bare_links, nav, header, advert)
        before = "".join(r.choice(kinds)() for _ in range(r.choice((0, 1, 1, 2, 3))))
    else:
        before = (header() if r.random() < 0.3 else "") + (nav() if r.random() < 0.8 else "") + around(r.choice((0, 1, 1, 2)))
    title = sentence(1, 9) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 8))).capitalize()
    body = put("h1", title) if r.random() < (0.95 if plain else 0.85) else ""
    para = r.choice(("p", "p", "p", "div")) if plain else "p"
    for _ in range(r.choice((1, 1, 2, 4, 8, 14))):
        kind = r.random()
        if kind < 0.75:
            body += put(para, prose())
        elif kind < 0.82:
            body += put("h2", sentence(1, 6))
        elif kind < 0.87:
            body += "<ul>" + "".join(put("li", sentence(1, 9)) for _ in range(3)) + "</ul>"
        elif kind < 0.91:
            body += "<blockquote>" + put("p", prose()) + "</blockquote>"
        elif kind < 0.94:
            body += "<table><tr>" + put("td", word()) + put("td", word()) + "</tr></table>"
        else:
            body += r.choice((advert, side, notice, form))()
    wrap = r.choice(("article", "article", "article", "article", "main", 'div class="content"', 'div class="post"', 'div id="article-body"'))
    if plain:
        wrap = r.choice((f"div{mute()}", f"div{mute()}", f"section{mute()}", f"center{mute()}", ""))
    page = f"<{wrap}>{body}</{wrap.split()[0]}>" if wrap else body
    if plain and r.random() < 0.2:
        page = f"<div{mute()}>{page}</div>"
    if plain and r.random() < 0.15:
        page = f"<table><tr><td{mute()}>{bare_links()}</td><td{mute()}>{page}</td></tr></table>"
    if not plain and r.random() < 0.2:
        page = f"<main>{page}</main>"
    after = (comment() if r.random() < 0.3 else "") + around(r.choice((0, 0, 1))) + (f"<footer>{'<p>' * r.randint(0, 1)}&copy; {word()} &middot; {prose()}</footer>" if r.random() < 0.9 else "")
    if plain:
        after = "".join(r.choice((bare_links, comment, advert))() for _ in range(r.choice((0, 0, 1, 2)))) + (bare_foot() if r.random() < 0.85 else "")
    return f"<!DOCTYPE html><html>{head}<body>{before}{page}{after}</body></html>", main


def labelled_chain(seed: int) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page with label 1 for those of the article, matched in order."""
    page, main = labelled_page(seed)
    chain, gold, k = blocks(page), [], 0
    for _, text, _ in chain:
        hit = k < len(main) and text == main[k]
        gold.append(int(hit))
        k += hit
    return chain, gold


@lru_cache(1)
def model() -> Crf:
    pages = []
    for seed in range(TRAINING_PAGES):
        chain, gold = labelled_chain(seed)
        if chain:
            pages.append((_features(chain), gold))
    return Crf.train(pages)


def main_text(crf: Crf, page: str | None) -> str:
    chain = blocks(page)
    return "\n\n".join(text for (_, text, _), keep in zip(chain, crf.label(chain), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text", crf: Crf | None = None) -> DataFrame:
    """``pages`` with the main text in ``out`` in place of ``html``; other columns stay."""
    crf = crf or model()
    keep = [c for c in pages.columns if c not in (html, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(crf, x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    source = with_row(pages, html=F.col(f"`{html}`").cast("string"))
    found = source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("text", T.StringType())]))
    return found.select(*(F.col(f"row.`{c}`") for c in keep), F.col("text").alias(out))


def op10_html(spark, sf_dir) -> DataFrame:
    """Main text of every page."""
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
