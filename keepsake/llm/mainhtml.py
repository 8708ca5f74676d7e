"""Main-text extraction by the maximum-scoring subsequence of words and tags.

A page is a sequence of blocks: words, and the tags before and among them. Words
score positive, tags negative; one linear scan finds the contiguous region with
the largest sum. The scores are shares counted on labelled pages (those that mark
their content with ``article`` or ``main``): of words by the block's tag, its
length and whether it is links, of tags by their name. Names that say a container
holds something else (menus, adverts, forms, ...) are one more counted feature,
with a low first guess; a page without any such name is parted by shapes and tags.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled pages counted at most (the ones with the smallest hash of their key).
LABELLED_PAGES = 2_000

# Names of HTML elements, by how they are read.
CONTENT = frozenset("article main".split())
RAW = frozenset("script style textarea noscript template svg iframe object canvas select".split())
BOILERPLATE = frozenset("head nav header footer aside form button dialog menu annotation annotation-xml".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics annotation annotation-xml mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first set is closed by a start tag of its own kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
# Words of a class, id or role that name another purpose than content.
PURPOSES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted "
    "promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola teaser toolbar widget widgets".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|noscript|template|svg|iframe|object|canvas|select)\b"
    r"(?:(?<=<svg)(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|[^>]*>.*?(?:</\1\s*>|$))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<!\[CDATA\[.*?\]\]>|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Tags whose words are text by themselves, short or long.
TEXT_TAGS = frozenset("p pre blockquote dt dd li tr td th figcaption br h1 h2 h3 h4 h5 h6".split())
#: Words and tags that the guesses count for beside the labelled pages' own counts.
PRIOR_WORDS, PRIOR_TAGS = 50.0, 10.0
#: The guessed share in content of words below a listed name, and the share below which they are left out of the region.
LISTED, KEPT = 0.02, 0.25
LEAST_WORD, LEAST_TAG = 0.02, 0.05


def purposes(name: str, attributes: str, inside: bool) -> frozenset[str]:
    """The listed names that say an element holds something else than content. A header inside an article is the article's own."""
    found = {name} if name in BOILERPLATE and not (name == "header" and inside) else set()
    if name not in CONTENT and name not in ("html", "body") and "=" in attributes:
        for m in _NAMED.finditer(attributes):
            named, value = m.group(1).lower(), next(g for g in m.groups()[1:] if g is not None).lower()
            if named == "id" and (name in HEADINGS or inside and name == "section"):
                continue  # made from the heading's words
            # inside content only a whole name counts: "related-work" is a subject, "related" is a list of links
            found |= PURPOSES & set(value.split() if inside else re.split(r"[^a-z]+", value))
        if name in ("h1", "h2", "h3", "p"):
            found.discard("header")
    return frozenset(found)


@dataclass
class Block:
    """Words between two breaks, and the tags since the block before (each with whether it lies in labelled content)."""

    tag: str
    text: str
    words: int
    linked: bool
    purposes: frozenset[str]
    labelled: bool
    tags: list[tuple[str, bool]]

    def shape(self) -> str:
        """What the words' score is counted by: the tag before them, how many they are, whether most are links."""
        size = "short" if self.words <= 3 else "middle" if self.words <= 25 else "long"
        return f"{self.tag} {size}{' linked' * self.linked}"

    def tag_name(self, name: str) -> str:
        return f"{name} linked" if self.linked else name


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; the tags after the last are left out, as no region ends with tags."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    inside = links = linked = words = 0
    tag, pieces, tags = "html", [], []

    held: Counter = Counter()  # purposes of the open elements

    def end_block() -> None:
        nonlocal words, linked, pieces, tags
        if words:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            out.append(Block(tag, text, words, 2 * linked > words, frozenset(held), inside > 0, tags))
            tags = []
        words, linked, pieces = 0, 0, []

    def close(upto: int) -> None:
        nonlocal inside, links
        while len(stack) > upto:
            name, named = stack.pop()
            for c in named:
                held[c] -= 1
                if not held[c]:
                    del held[c]
            inside -= name in CONTENT
            links -= name == "a"

    for m in _TOKEN.finditer(page):
        raw, end, name, attributes = m.groups()
        token = m.group()
        if token[0] != "<" or token == "<":
            n = len(token.split())
            pieces.append(token)
            words += n
            linked += n * (links > 0)
            continue
        if name is None:
            if raw:
                tags.append((raw.lower(), inside > 0))
            continue
        name = name.lower()
        if name not in INLINE:
            end_block()
        if end:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            tags.append((name, inside > 0 and name not in CONTENT))
            if at is not None:
                close(at)
        else:
            if name in SELF_CLOSING and stack and stack[-1][0] == name:
                close(len(stack) - 1)
            elif name not in INLINE and name not in VOID:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
                if at is not None and stack[at][0] == "p":  # a block closes an open paragraph
                    close(at)
            tags.append((name, inside > 0))
            if name not in VOID and not attributes.endswith("/"):
                stack.append((name, purposes(name, attributes, inside > 0)))
                held.update(stack[-1][1])
                inside += name in CONTENT
                links += name == "a"
        if name not in INLINE:
            tag = name
    end_block()
    return out


def guess(shape: str) -> float:
    """The share of such words that lie in content, as far as none are counted."""
    tag, size, *linked = shape.split(" ")
    if linked:
        return 0.05
    return 0.8 if tag in TEXT_TAGS or size == "long" else 0.05


def guess_tag(name: str) -> float:
    """The share of such tags that lie in content, as far as none are counted."""
    tag, *linked = name.split(" ")
    return 0.2 if linked else 0.8 if tag in TEXT_TAGS or tag in INLINE else 0.4


@dataclass
class Weights:
    """(inside, outside) counts of words by ``w:`` shape and ``c:`` purpose, and of ``t:`` tags."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def share(self, name: str, prior: float, strength: float) -> float:
        i, o = self.counts.get(name, (0, 0))
        return (i + strength * prior) / (i + o + strength)

    def kept(self, purposes: frozenset[str]) -> float:
        """How far the listed names speak for content: 1 without any; counted pages can speak up for a name."""
        out = 1.0
        for c in sorted(purposes):
            out *= self.share(f"c:{c}", LISTED, PRIOR_WORDS)
        return out

    def word(self, block: Block) -> float:
        """Positive; nearly 1 for words like those in labelled content."""
        shape = block.shape()
        return max(LEAST_WORD, self.share(f"w:{shape}", guess(shape), PRIOR_WORDS) * self.kept(block.purposes))

    def tag(self, name: str) -> float:
        """Negative; nearly -1 for tags that are seldom in labelled content."""
        return -max(LEAST_TAG, 1.0 - self.share(f"t:{name}", guess_tag(name), PRIOR_TAGS))

    def gains(self, block: Block) -> tuple[float, float]:
        """What the block's words add, and what the tags before them and among them take off."""
        return block.words * self.word(block), sum(self.tag(block.tag_name(n)) for n, _ in block.tags)


def features(page: str) -> tuple[Counter, Counter]:
    """How often each feature occurs inside and outside the labelled content."""
    found = (Counter(), Counter())
    for b in blocks(page):
        here = found[not b.labelled]
        here[f"w:{b.shape()}"] += b.words
        for c in b.purposes:
            here[f"c:{c}"] += b.words
        for name, labelled in b.tags:
            found[not labelled][f"t:{b.tag_name(name)}"] += 1
    return found


def learn(inside: dict[str, int], outside: dict[str, int]) -> Weights:
    return Weights({name: (inside.get(name, 0), outside.get(name, 0)) for name in {*inside, *outside}})


def fit(pages: DataFrame, html: str = "html", key: str = "page_id") -> Weights:
    """Counts features on at most LABELLED_PAGES pages that mark their content."""
    marked = pages.where(F.col(html).rlike("(?i)<(article|main)[\\s>]")).select(F.col(key).alias("_key"))
    some = marked.orderBy(F.xxhash64("_key"), "_key").limit(LABELLED_PAGES)
    rows = pages.join(F.broadcast(some.distinct()), pages[key].eqNullSafe(some["_key"]), "left_semi").select(F.col(html).alias("_html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (Counter(), Counter())
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for t, c in zip(total, features(page or "")):
                    t.update(c)
        names = sorted({*total[0], *total[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([t[n] for n in names], pa.int64()) for t in total]], ["name", "inside", "outside"])

    # one row per kind of tag or block that the sample holds
    found = rows.mapInArrow(count, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return learn({r["name"]: r["inside"] for r in found}, {r["name"]: r["outside"] for r in found})


def best_region(gains: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last (excluded) index of the contiguous run with the largest sum; of equal ones the earliest and longest.

    Each entry is what its words add and what the tags before them take off; a
    run's first tags lie outside of it. Without entries the run is empty.
    """
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (words, tags) in enumerate(gains):
        if total + tags < 0 or i == start == 0:
            total, start = 0.0, i  # what is before costs more than it brings
        else:
            total += tags
        total += words
        if total > best or total == best and start == at[0]:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best region: blocks joined by line feeds, white space inside them as one space.

    ``br`` ends a line as a block does. Blocks inside the region whose containers
    are named for another purpose (an advert between paragraphs) are left out.
    """
    if not page:
        return ""
    found = blocks(page)
    first, last = best_region([weights.gains(b) for b in found])
    return "\n".join(b.text for b in found[first:last] if b.text and weights.kept(b.purposes) >= KEPT)


def extract_all(pages: DataFrame, weights: Weights, html: str = "html", keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns (all but the page by default), ``text`` and ``n_chars`` for every row.

    Null and empty pages, and pages without words, give an empty text; repeated
    rows are read alike; an empty table gives no rows; input columns whose names
    clash with the two added are left out. Pages are read whole.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c != html and c.lower() not in (text.lower(), "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(p, weights) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema.names)

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, schema)
