"""HTML extraction by line-block distribution.

Markup is stripped to lines: one for the text of each block, with an empty line wherever
boilerplate stood (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments of readers; told by element, role, class and id) or, on pages without an
article container, where most of a line is link text. Text lengths are summed over
sliding windows of lines. The sum surges where text sets in after empty lines, and dives
where it goes back to nothing; the text between is kept. Inside an article container
every such stretch is kept; elsewhere those whose windows reach a quarter of the page's
fullest window or that hold a sentence (a line that ends like one).

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by an empty line. Nothing is dropped or cut for its
length.

Cases: null or empty html gives an empty text; so does a page without main text. Broken
markup is read as far as it goes: unclosed elements end with the one around them, a tag
cut off at the end is dropped. Repeated rows give the same text. An empty table gives no
rows. Other columns may have any name but that of the result, which is replaced. Time grows
with the length of a page, however broken.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.common import free_name, slices, texts

#: Elements that start and end a block.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements without main text.
DROPPED = frozenset("script style textarea title xmp noembed noframes head nav footer aside form button select option datalist input menu dialog noscript template svg math iframe object canvas video audio map search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Elements that carry text by themselves.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre em strong b i span code figure figcaption dt dd".split())
#: Words of class and id that mark boilerplate anywhere.
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs topbar masthead footer comment comments commentlist disqus reply replies respond related recommended recommendations share sharing social newsletter subscribe signup login popup modal overlay form search widget widgets toolbar pagination pager copyright paywall".split())
#: Words that may stand beside those in one name: "comment-list" is boilerplate, "related-work" is not.
BESIDE_WORDS = frozenset("area bar block body bottom box btn button buttons col column container foot group head heading holder icon icons inner item items left link links list main module outer page panel policy post posts article articles story stories right row section site slot text title top unit wrap wrapper".split())
CONTAINER_WORDS = frozenset(("article", "content", "maincontent", "main", "post", "entry", "story"))
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|</[^>]*(?:>|\Z)", re.S)
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
#: A line that ends like a sentence; notices of rights are none.
SENTENCE = re.compile(r"(?!©|\(c\)|copyright\b).*[.!?…。！？][\"'”’»)\]]*\Z", re.S | re.I)


@dataclass(frozen=True)
class Params:
    window: int = 3
    share: float = 0.25
    link_share: float = 0.5
    least: int = 1  # characters of a page's fullest window without a container


@dataclass
class _Open:
    name: str
    dropped: bool
    container: bool
    link: bool


def tag_end(page: str, at: int) -> tuple[int, int]:
    """(end of the attributes, end of the tag) of a tag whose name ends at `at`. A quote without partner is a plain character; each character is passed once."""
    while (m := STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start(), m.end()
        close = page.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return len(page), len(page)


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def boilerplate_words(named: str) -> set[str]:
    """Words of the names that consist of words of boilerplate and words that go beside them."""
    return {w for n in named.split() if (parts := set(WORD.findall(n))) and parts <= DROPPED_WORDS | BESIDE_WORDS | {"header"} for w in parts}


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters of it in links, inside a container) of each line, boilerplate as empty lines; whether there is a container."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[_Open] = []
    text: list[str] = []
    links = 0
    dropped = inner = in_links = 0
    opened: Counter = Counter()  # open elements by name
    any_container = False

    def end() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            lines.append((joined, links, inner > 0))
        text.clear()
        links = 0

    def pop(to: int) -> None:
        nonlocal dropped, inner, in_links
        while len(stack) > to:
            top = stack.pop()
            opened[top.name] -= 1
            in_links -= top.link
            if top.name in BLOCKS or top.dropped:
                end()
            if top.dropped:
                dropped -= 1
                if not dropped:
                    lines.append(("", 0, False))
            if top.container:
                end()
                inner -= 1

    def add(chunk: str) -> None:
        nonlocal links
        if chunk and not dropped:
            plain = html.unescape(chunk)
            text.append(plain)
            if in_links:
                links += len(" ".join(plain.split()))

    at = 0
    while (m := TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                add(html.escape(page[m.start() + 9 : m.end() - 3], quote=False))
            continue
        here, at = tag_end(page, at)
        attributes = page[m.end() : here]
        if m[1]:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k].name == name:
                    pop(k)
                    break
            else:
                if name in BLOCKS and not dropped:
                    end()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            if not dropped and name in BLOCKS:
                end()
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr" and not dropped:
                end()
            continue
        # An open paragraph ends where a block begins; items and cells end where the next begins.
        if name in BLOCKS:
            if not dropped:
                end()
            ends = opened["p"] or opened[name] and name in ("li", "dd", "dt", "td", "th", "tr", "option") or name == "body"
            for k in range(len(stack) - 1, -1, -1) if ends else ():
                if stack[k].name == "p" or stack[k].name == name and name in ("li", "dd", "dt", "td", "th", "tr", "option") or name == "body" and stack[k].name == "head":
                    pop(k)
                    break
                if stack[k].name in BLOCKS:
                    break
        values = _attributes(attributes)
        named = f"{values.get('class', '')} {values.get('id', '')}".lower()
        # A whole class or id must say so, word by word: "form-factor" is no form. Of an element that carries text by itself it must be one word.
        words = set(named.split()) if name in TEXTUAL else boilerplate_words(named)
        role = values.get("role", "").lower()
        plain = name in ("html", "body")
        drop = name in DROPPED or role in DROPPED_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I) is not None
        drop = drop or not plain and bool(words & DROPPED_WORDS) or name == "header" and not inner or "header" in words and not inner and name not in ("article", "main")
        container = not drop and not plain and not dropped and (name in ("article", "main") or role in ("main", "article") or values.get("itemprop", "") == "articleBody" or name in ("div", "section", "td") and bool(set(WORD.findall(named)) & CONTAINER_WORDS))
        if drop:
            if not dropped:
                if name in BLOCKS or text:
                    end()
                lines.append(("", 0, False))
            dropped += 1
        if container:
            end()
            inner += 1
            any_container = True
        if not attributes.rstrip().endswith("/") or name in BLOCKS:
            stack.append(_Open(name, drop, container, name == "a"))
            opened[name] += 1
            in_links += name == "a"
        else:  # closed in itself
            if drop:
                dropped -= 1
    add(page[at:])
    pop(0)
    end()
    return lines, any_container


def stretches(sizes: list[int], p: Params, *, share: float, least: int, sure: frozenset[int] = frozenset()) -> Iterator[tuple[int, int]]:
    """Line ranges between a surge and the next dive of the windowed text lengths, where the fullest window is full enough or a line is sure to be text."""
    found, start = [], None
    for i, n in enumerate([*sizes, 0]):
        if n and start is None:
            start = i  # surge
        elif not n and start is not None:
            peak = max(sum(sizes[k : min(k + p.window, i)]) for k in range(start, i))
            found.append((start, i, peak))  # dive
            start = None
    best = max((x[2] for x in found), default=0)
    for a, b, peak in found:
        if peak >= share * best and best >= least or not sure.isdisjoint(range(a, b)):
            yield a, b


def main_text(page: str | None, p: Params = Params()) -> str:
    """The main text of one page."""
    if not page:
        return ""
    lines, contained = lines_of(page)
    if contained and any(t for t, _, inside in lines if inside):
        sizes = [len(t) if inside else 0 for t, _, inside in lines]
        kept = stretches(sizes, p, share=0.0, least=0)
    else:
        sizes = [0 if links > p.link_share * len(t) else len(t) for t, links, _ in lines]
        # A short paragraph, cut off from the rest by boilerplate, is text all the same.
        sure = frozenset(i for i, (t, _, _) in enumerate(lines) if sizes[i] and SENTENCE.match(t))
        kept = stretches(sizes, p, share=p.share, least=p.least, sure=sure)
    return "\n\n".join(lines[i][0] for a, b in kept for i in range(a, b))


def extract(pages: DataFrame, p: Params = Params(), *, markup: str = "html", keep: list[str] | None = None, into: str = "text") -> DataFrame:
    """The columns in `keep` and the main text of every row, in one narrow pass."""
    keep = [c for c in (pages.columns if keep is None else keep) if c != into]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField(into, T.StringType(), False)])

    source = free_name([*keep, into], "__html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=source):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([main_text(x, p) for x in texts(part, source)], pa.string())], names=[*keep, into])

    return pages.select(*keep, F.col(markup).alias(source)).mapInArrow(run, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
