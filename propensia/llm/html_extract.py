"""HTML extraction by the maximum-scoring subsequence.

A page becomes one sequence of tokens: words score by the container that they
stand in, tags score negative by their name, both with weights learned from
labelled pages.  One linear scan finds the contiguous run with the largest sum:
the content region.  Its words, without the boilerplate elements inside it,
are the main text.

Labelled pages are pages whose markup names the content itself (an ``article``
or ``main`` element); at most ``MAX_LABELLED`` of them, picked by a hash of
page_id, are used (the documented bound).  ``SEEDS`` are pseudo-counts for the
names that HTML defines, so the weights exist without any labelled page and
pages without such elements are scored by what the labelled ones taught: words
are also counted by the container that they stand in when ``article`` and
``main`` are read as any other element, so a labelled page's own text teaches
what words in unnamed elements are worth.  Unnamed words beside the named
content have a weight of their own (``beside``).

Blocks: text between block tags is one block; white space inside it becomes one
space, blocks are trimmed, empty ones left out, the rest joined by a line feed.
A ``br`` is white space.  Character references are decoded.

Names (class, id, role) make an element boilerplate for its words' scores until
an element names content inside it; names of comments, and elements that HTML
defines as boilerplate, do so for good.  A page that would be left without any
text is scored again without the name that took most of its words.

Defined cases: null html counts as empty and gives an empty text; a page
without words gives an empty text; unclosed elements end with the element
around them or the page; markup inside scripts, styles and comments is not
read; a very long page is one linear scan; an svg that closes itself ends there;
repeated rows are extracted one by one; ties go to the first region; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import q, slices, texts_of

MAX_LABELLED = 2_000
MIN_TAG_COST = 0.2

# FIXED VALUES: element names of the HTML standard, by their role here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg iframe object textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form head button select menu dialog fieldset label datalist".split())
CONTENT = frozenset("article main".split())
CONTAINERS = BOILERPLATE | CONTENT | frozenset("body section div ul ol table figure details address".split())
ENDS_P = frozenset("p div ul ol dl table section article main nav header footer aside form h1 h2 h3 h4 h5 h6 pre "
                   "blockquote hr figure".split())

# FIXED VALUES: parts of class and id names that announce boilerplate, by how sure they are
COMMENT_PARTS = frozenset("comment comments disqus respond replies".split())
JUNK_PARTS = re.compile(r"(?:ads?|advert\w*|banner|breadcrumbs?|cookies?|consent|disclaimer|footer|header|masthead|menu|modal|"
                        r"nav\w*|newsletter|pagination|pager|popup|promo\w*|recommend\w*|sidebar|signup|sponsor\w*|subscribe|"
                        r"toolbar|widget)\d*")
TOPIC_PARTS = frozenset("notice related reply share sharing social tags".split())     # ordinary words, too
STATE_PREFIX = re.compile(r"(?:has|have|no|not|with|without|is|show|hide)[-_]")       # what a page has, not what an element is
# FIXED VALUES: parts of class and id names that announce content
POSITIVE_NAMES = re.compile(r"(?:^|[-_ ])(?:article|body|content|entry|main|post|story|text)(?:$|[-_ \d])", re.I)

# Quotes count behind an equals sign only: an unquoted value may hold an apostrophe.
_ATTRS = r"(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*+"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<svg\b" + _ATTRS + r"(?<=/)>"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b" + _ATTRS + r">(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']\S*))", re.I)
CLEAR, LIKELY, SURE = 0, 1, 2     # how junk a name makes an element: not, until an element names content, for good


@lru_cache(maxsize=65_536)
def name_kind(names: str) -> int:
    """What the class, id and role names of an element say about it.

    Names of a state (``has-sidebar``) say nothing.  An ordinary word such as
    ``social`` counts inside a longer name (``social-links``) or where no other
    name stands beside it.
    """
    kind, topics, others = CLEAR, 0, 0
    for name in names.lower().split():
        if STATE_PREFIX.match(name):
            others += 1
            continue
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if any(p in COMMENT_PARTS for p in parts):
            kind = SURE
        elif any(JUNK_PARTS.fullmatch(p) for p in parts) or (len(parts) > 1 and any(p in TOPIC_PARTS for p in parts)):
            kind = max(kind, LIKELY)
        elif name in TOPIC_PARTS:
            topics += 1
        else:
            others += 1
    return kind or (LIKELY if topics and not others else CLEAR)


# Pseudo-counts (inside the content, outside it) of words by container and of tags by name.
SEEDS = {("word", "content"): (200, 1), ("word", "boilerplate"): (1, 200), ("word", "plain"): (4, 1),
         ("word", "beside"): (4, 1),
         ("tag", "p"): (50, 5), ("tag", "h1"): (5, 3), ("tag", "h2"): (10, 5), ("tag", "h3"): (10, 5),
         ("tag", "br"): (20, 10), ("tag", "b"): (20, 10), ("tag", "i"): (20, 10), ("tag", "em"): (20, 10),
         ("tag", "a"): (10, 30), ("tag", "li"): (10, 30), ("tag", "ul"): (5, 10), ("tag", "div"): (5, 10), ("tag", "nav"): (0, 20),
         ("tag", "footer"): (0, 20), ("tag", "aside"): (0, 20), ("tag", "form"): (0, 20), ("tag", "article"): (0, 40),
         ("tag", "main"): (0, 40), ("tag", "body"): (0, 40), ("tag", "head"): (0, 40), ("tag", "header"): (0, 20)}


class Token:
    """One token: its score key, word count, text, and whether its text is boilerplate."""

    __slots__ = ("key", "words", "text", "junk", "block", "named", "bare", "owner")

    def __init__(self, key, words=0, text="", junk=False, block=False, named=False, bare=None, owner=-1):
        self.key, self.words, self.text, self.junk, self.block, self.named = key, words, text, junk, block, named
        self.bare = bare                               # container of a word if article and main named nothing
        self.owner = owner                             # the element whose mere name makes a word boilerplate


def _names(attrs: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if "=" in attrs else ""


def tokens(page: str, pardoned: int = -1) -> list[Token]:
    """The token sequence of a page; an open-element stack gives each word its container.

    The name of the element number ``pardoned`` (by its tag's place) makes it no boilerplate.
    """
    out: list[Token] = []
    # stack entries: (name, container key, junk, inside article or main, container key without article and main,
    # place of the outermost element that a mere name made boilerplate)
    stack: list[tuple[str, str, int, bool, str, int]] = [("", "plain", CLEAR, False, "plain", -1)]
    for m in _TOKEN.finditer(page):
        if m.lastgroup == "text":
            text = entities.unescape(m["text"]) if "&" in m["text"] else m["text"]
            _, container, junk, inside, bare, owner = stack[-1]
            out.append(Token(("word", container), len(text.split()), text, bool(junk), False, inside and not junk, bare, owner))
            continue
        name = m["name"]
        if name is None:                               # comment, raw element or declaration
            if m["raw"]:
                out.append(Token(("tag", m["raw"].lower()), junk=True))
            continue
        name = name.lower()
        _, container, junk, inside, bare, owner = stack[-1]
        block = name not in INLINE
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):     # the nearest open element of that name, if there is one
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in CONTAINERS and name not in CONTAINERS:
                    break
            out.append(Token(("tag", name), block=block, junk=bool(junk), named=stack[-1][3]))
            continue
        if name in ENDS_P:                             # an open p ends before a block
            while len(stack) > 1 and stack[-1][0] not in CONTAINERS and any(
                    x[0] == "p" for x in stack[-8:]) and stack[-1][0] not in ("td", "th", "li", "blockquote"):
                stack.pop()
            _, container, junk, inside, bare, owner = stack[-1]
        names = _names(m["attrs"])
        kind = name_kind(names) if names and block and name not in ("body", "html") else CLEAR
        if kind == LIKELY and m.start() == pardoned:
            kind = CLEAR
        if name in CONTENT and kind == CLEAR and junk != SURE:
            # an element that names content ends the junk of a mere name around it
            container, junk, inside, owner = "content", CLEAR, True, -1
            bare = "content" if POSITIVE_NAMES.search(names) else bare
        elif name == "header" and inside and kind == CLEAR:
            pass                                       # an article's own head: its title belongs to it
        elif name in BOILERPLATE or kind:
            owner = -1 if name in BOILERPLATE or max(junk, kind) == SURE else owner if junk else m.start()
            container, junk, bare = "boilerplate", SURE if name in BOILERPLATE else max(junk, kind), "boilerplate"
        elif names and block and not junk and "plain" in (container, bare) and POSITIVE_NAMES.search(names):
            container = bare = "content"
        out.append(Token(("tag", name), block=block, junk=bool(junk), named=inside and not junk))
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append((name, container, junk, inside, bare, owner))
    if any(t.named and t.words for t in out):
        for t in out:
            if t.key == ("word", "plain"):
                t.key = ("word", "beside")
    return out


def count_labelled(page: str) -> Counter:
    """(key, inside) -> count over one labelled page; empty if the page names no words as content."""
    seen = tokens(page)
    counts: Counter = Counter()
    if any(t.named and t.words for t in seen):
        for t in seen:
            if t.key[0] == "word":
                counts[t.key, t.named] += t.words
                if t.key[1] != t.bare:
                    counts[("word", t.bare), t.named] += t.words
            elif not t.junk:             # tags inside boilerplate say nothing about the same tags in a text
                counts[t.key, t.named] += 1
    return counts


def weights_of(counts: dict) -> dict[tuple[str, str], float]:
    """Score of each key: log odds of content, positive words as they are, tags never above -MIN_TAG_COST."""
    total = {k: list(v) for k, v in SEEDS.items()}
    for (key, inside), n in counts.items():
        cell = total.setdefault(key, [0, 0])
        cell[0 if inside else 1] += n
    out = {}
    for key, (a, b) in total.items():
        odds = math.log((a + 0.5) / (b + 0.5))
        out[key] = max(-6.0, min(3.0, odds)) if key[0] == "word" else max(-8.0, min(-MIN_TAG_COST, odds))
    return out


def region(seen: list[Token], weights: dict) -> tuple[int, int]:
    """[first, last) of the run with the largest sum; (0, 0) if no run is positive."""
    best, now, start, span, penalised = 0.0, 0.0, 0, (0, 0), False
    for i, t in enumerate(seen):
        if t.junk:
            # boilerplate costs once per run of it, or a long notice would split the article around it
            if penalised:
                continue
            score, penalised = weights[("word", "boilerplate")], True
        else:
            penalised = False
            if t.key[0] == "word":
                score = t.words * weights[t.key]
            else:
                score = weights.get(t.key, -1.0)
        if now <= 0:
            now, start = 0.0, i
        now += score
        if now > best:
            best, span = now, (start, i + 1)
    return span


def extract(page: str, weights: dict) -> str:
    """Main text of one page; where names leave nothing, the one that took most words is not believed."""
    seen = tokens(page)
    text = _text(seen, weights)
    if not text:
        taken: Counter = Counter()
        for t in seen:
            if t.owner >= 0:
                taken[t.owner] += t.words
        if taken:
            text = _text(tokens(page, taken.most_common(1)[0][0]), weights)
    return text


def _text(seen: list[Token], weights: dict) -> str:
    first, last = region(seen, weights)
    blocks, parts = [], []
    for t in seen[first:last]:
        if t.block or (t.junk and t.key[0] == "tag"):
            blocks.append("".join(parts))
            parts = []
        elif t.key == ("tag", "br"):
            parts.append(" ")
        elif t.text and not t.junk:
            parts.append(t.text)
    blocks.append("".join(parts))
    trimmed = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in trimmed if b)


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = MAX_LABELLED) -> dict:
    """Weights from at most ``limit`` labelled pages; only summed counts per name reach the driver."""
    at = F.xxhash64(q(id_col))
    last = pages.select(at.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if last is None:
        return weights_of({})
    sample = pages.where(at <= F.lit(last)).select(q(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for page in texts_of(b.column(0)):
                counts.update(count_labelled(page))
        rows = [(*key, inside, n) for (key, inside), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.bool_(), pa.int64()))],
            names=["kind", "name", "inside", "n"])

    sums = sample.mapInArrow(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(
        F.sum("n").alias("n")).collect()
    return weights_of({((r["kind"], r["name"]), r["inside"]): r["n"] for r in sums})


def extract_pages(pages: DataFrame, weights: dict | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text), n_chars (its code points) of every page."""
    weights = weights or learn_weights(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(page, weights) for page in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(q(id_col).cast("long").alias("page_id"), q(url_col).cast("string").alias("url"),
                        q(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
