"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tokens: tags and words. Words score positive, tags
negative, and one linear scan finds the contiguous run of tokens with the
greatest sum; its words are the main text.

The weights come from labelled pages: those that mark their text themselves
with exactly one ``article`` or ``main`` element. For each kind of token (a tag
name; a plain word; a word inside a link) the log odds of standing inside
against outside that element are counted over all such pages. They are bounded
so that words stay positive and tags negative. Without labelled pages the
weights are WORD and TAG.

Elements that are never main text (scripts, styles, navigation, headers and
footers of the page, asides, forms and so on, and boxes whose class, id or role
names adverts, menus, comments, notices and the like) give no text wherever
they stand, and each costs little, so that one inside the article does not cut it
in two.

Character references are decoded; white space inside a block becomes one blank;
blocks are joined by one line feed in page order; nothing else is dropped. Null
and empty pages, and pages without a word outside such elements, give an empty
text. Elements end at their end tag, at the end of an element opened before
them, where HTML lets their end tag be left out (p, li, td and others) also at
the tag that ends them there, or else with the page. Each row gives one row.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import extended, sub_batches

WORD = 1.0
LINK = 0.25
TAG = -0.25
#: Bounds of the learned weights.
GREATEST = 4.0
LEAST = -12.0
#: What one left-out element costs at most, and each of its tags.
LEFT_OUT = -1.0
LEFT_TAG = -0.01

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text: no tags inside.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
LEFT = RAW | frozenset(
    "head nav footer aside form noscript template svg math canvas object audio video map select "
    "button menu dialog datalist output progress meter applet frameset".split()
)
TEXT_MARKS = frozenset("article main".split())
#: Words in class, id, role or aria-label that name what is no main text. Whole
#: words between marks, so that "header" is not found in "subheadering".
NAMES = re.compile(
    r"(?:^|[^a-z0-9])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adbox|banner|"
    r"breadcrumb|breadcrumbs|comment|comments|commentlist|disqus|replies|respond|consent|cookie|"
    r"cookies|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|menu|menus|nav|navbar|navigation|topnav|sidenav|pagination|pager|promo|promos|"
    r"promotion|related|recommended|recommendations|share|sharing|social|sidebar|side|aside|"
    r"sponsor|sponsored|footer|masthead|toolbar|widget|widgets|tagcloud|search|contentinfo|"
    r"complementary|skip|copyright|toc)(?:$|[^a-z0-9])"
)
HEADER = re.compile(r"(?:^|[^a-z0-9])(?:header|site-header|page-header)(?:$|[^a-z0-9])")
#: Elements whose names are looked at; inline marks and text containers of the
#: whole page are not.
BOXES = frozenset("div section ul ol dl p span table td li figure header details".split())

#: Tags that end an open p, and what ends other elements without end tags; the
#: second names are those that shield an element from tags inside of them.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt "
    "td th tr tbody thead tfoot caption".split()
)
ROWS = frozenset("tr tbody thead tfoot".split())
TABLES = frozenset(["table", "template"])
LISTS = frozenset("ul ol menu dir dl table td th template section article blockquote form fieldset".split())
ENDS = {
    "p": (ENDS_P, frozenset("table td th caption button object template".split())),
    "li": (frozenset(["li"]), LISTS),
    "dd": (frozenset(["dd", "dt"]), LISTS),
    "dt": (frozenset(["dd", "dt"]), LISTS),
    "td": (ROWS | {"td", "th"}, TABLES),
    "th": (ROWS | {"td", "th"}, TABLES),
    "tr": (ROWS, TABLES),
    "head": (frozenset(["body", "frameset"]), frozenset()),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def is_left_out(name: str, attributes: str, in_text: bool) -> bool:
    """Whether an element gives no main text."""
    if name in LEFT:
        return True
    if name == "header" and not in_text:
        return True
    if not attributes or name not in BOXES:
        return False
    if HIDDEN.search(attributes):
        return True
    for a, b, c in NAMED.findall(attributes):
        value = (a or b or c).lower()
        if NAMES.search(value) or (not in_text and HEADER.search(value)):
            return True
    return False


class _Open:
    """Open elements, with their numbers by name."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.number: Counter = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.number[name] += 1

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            self.number[self.names.pop()] -= 1

    def end(self, name: str) -> bool:
        """Ends the last element of that name and all in it."""
        if not self.number[name]:
            return False
        while self.names[-1] != name:
            self.cut(len(self.names) - 1)
        self.cut(len(self.names) - 1)
        return True

    def start(self, name: str) -> None:
        """Ends what a start tag ends, outermost last."""
        for other, (by, shields) in ENDS.items():
            if name in by and self.number[other]:
                for at in range(len(self.names) - 1, -1, -1):
                    if self.names[at] == other:
                        self.cut(at)
                        break
                    if self.names[at] in shields:
                        break


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """Kind, text and whether it is left out, of each tag and piece of text.
    Kinds: a tag's name with a slash when it closes, "" for plain text and "#"
    for text inside a link."""
    at, n = 0, len(page)
    of_text, links = 0, 0
    # elements around, and from the one that is left out
    around, left = _Open(), _Open()
    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            break
        if found.start() > at:
            yield "#" if links else "", page[at : found.start()], bool(left.names)
        at = found.end()
        close, name = found[1], (found[2] or "").lower()
        if not name:
            continue
        if left.names:
            foreign = left.number["svg"] or left.number["math"]
            ended = False
            if not close:
                if not foreign:
                    left.start(name)
                ended = not left.names
                if not ended and name not in VOID and not (foreign and found[3].endswith("/")):
                    left.push(name)
            elif not left.end(name):
                # a cell is not left by the end of what is around its table
                shielded = left.number["table"] and name not in ("table", "body", "html")
                ended = around.number[name] > 0 and not shielded
                if ended:
                    left.cut(0)
            if not ended:
                yield close + name, "", True
                if name in RAW and not close:
                    end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                    at = end.start() if end else n
                continue
        if name in TEXT_MARKS:
            of_text = max(0, of_text + (-1 if close else 1))
        elif name == "a":
            links = 0 if close else 1
        if close:
            around.end(name)
        else:
            around.start(name)
        out = not close and name not in VOID and is_left_out(name, found[3], of_text > 0)
        if out:
            left.push(name)
        elif not close and name not in VOID and name not in INLINE:
            around.push(name)
        yield close + name, "", out
        if out and name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = end.start() if end else n
    if at < n:
        yield "#" if links else "", page[at:], bool(left.names)


# -- weights -----------------------------------------------------------------


def label_counts(page: str) -> Counter:
    """Tokens inside and outside the one article or main element of a page;
    nothing for pages without or with several of them."""
    parts = list(tokens(page))
    marks = [i for i, (kind, _, _) in enumerate(parts) if kind in TEXT_MARKS]
    counts: Counter = Counter()
    if len(marks) != 1:
        return counts
    end = "/" + parts[marks[0]][0]
    stop = next((i for i in range(marks[0], len(parts)) if parts[i][0] == end), len(parts))
    for i, (kind, text, out) in enumerate(parts):
        inside = marks[0] < i < stop
        if kind in ("", "#"):
            counts[kind, inside] += len(text.split())
        elif not out:
            name = kind.strip("/")
            counts[name if name in BLOCKS or name in VOID or name in INLINE else "other", inside] += 1
    return counts


INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp "
    "small span strike strong sub sup time tt u var img picture".split()
)


def learn_weights(df: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Log odds of each kind of token over all labelled pages; as many rows as
    there are kinds go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sub_batches(batches, "_html"):
            for page in batch.column("_html").to_pylist():
                if page:
                    counts.update(label_counts(page))
        if counts:
            kinds, inside = zip(*counts)
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array(kinds), "inside": pa.array(inside), "n": pa.array(counts.values(), pa.int64())}
            )

    rows = (
        df.select(df[html_col].alias("_html"))
        .mapInArrow(run, "kind string, inside boolean, n long")
        .groupBy("kind", "inside")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return weights_of({(r["kind"], r["inside"]): r["n"] for r in rows})


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights of the counted kinds: the log odds of one token against those of
    all tokens, words at least WORD. Tags of text cost next to nothing, so that
    a heading or a last line of one word stays."""
    inside = sum(n for (_, i), n in counts.items() if i)
    outside = sum(n for (_, i), n in counts.items() if not i)
    out = {}
    for kind in {k for k, _ in counts}:
        a, b = counts.get((kind, True), 0) + 1, counts.get((kind, False), 0) + 1
        odds = math.log(a / b) - math.log((inside + 1) / (outside + 1))
        if kind == "":
            out[kind] = min(GREATEST, max(WORD, odds))
        elif kind == "#":
            out[kind] = min(WORD / 2, max(LINK / 5, odds))
        else:
            out[kind] = min(TAG / 25, max(LEAST, odds))
    return out


# -- scan --------------------------------------------------------------------


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and one past the last place of the run with the greatest sum; the
    first of equals, empty when nothing is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, found = run, (start, i + 1)
    return found


def main_text(page: str, weights: dict[str, float]) -> str:
    """Main text of a page."""
    word, link = weights.get("", WORD), weights.get("#", LINK)
    other = weights.get("other", TAG)
    parts = list(tokens(page))
    scores, left = [], 0.0
    for kind, text, out in parts:
        if out:
            cost = 0.0 if kind in ("", "#") else max(LEFT_TAG, LEFT_OUT - left)
            left += cost
            scores.append(cost)
            continue
        left = 0.0
        if kind == "":
            scores.append(word * len(text.split()))
        elif kind == "#":
            scores.append(link * len(text.split()))
        else:
            scores.append(weights.get(kind.strip("/"), other))
    start, stop = best_run(scores)
    blocks: list[list[str]] = [[]]
    for kind, text, out in parts[start:stop]:
        if kind in ("", "#"):
            if not out:
                blocks[-1].append(text)
        elif kind.strip("/") in BLOCKS or out:
            blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(
    df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: dict[str, float] | None = None
) -> DataFrame:
    """Columns ``keep`` and text for each page; weights are learned from the
    same pages unless given."""
    if weights is None:
        weights = learn_weights(df, html_col)
    rows = df.select(*keep, df[html_col].alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "_html"):
            texts = [main_text(x, weights) if x else "" for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"]
            )

    return rows.mapInArrow(run, extended(df, keep, "text string"))
