"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative;
how much each kind scores is learned from labelled pages (pages whose main part
is marked up as such) as log odds of lying inside. One linear scan finds the
contiguous region with the largest sum. Where the region lies in an article or
main element, that element is the region; page furniture inside it is left out.
What holds a main element, the longest article or most of the region is no
furniture, whatever its class says. On a page without such an element, other
maximal regions of the same scan that score SHARE of the best are part of the
text, so that a block of links in the middle does not cut a story in two.

Parsing is linear in the page's length, whatever the markup: no search starts
over behind a tag, quote or comment that is never closed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.text import each

#: Labelled pages that weights are learned from at most, each as a whole.
SAMPLE = 300
#: Of the best region's score, what another region must have to be text as well.
SHARE = 0.25
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[\"'>]")
CLASSES = re.compile(r"""(?:^|[\s/])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes xmp svg canvas audio video".split())
#: Elements that are page furniture wherever they stand.
FURNITURE = frozenset("nav aside form footer menu button select dialog search head".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent copyright disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices alert pagination paywall popup promo promos promotion recommended related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toc toolbar widget widgets".split()
)
#: Of these, the ones that also stand around whole pages; and words of readers' remarks, which may be longer than the page's own text.
WRAPPERS = frozenset("form dialog search".split())
REMARK_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
ROLE_MAIN, BODY_PROP = re.compile(r"role\s*=\s*[\"']?main"), re.compile(r"itemprop\s*=\s*[\"']?articleBody")
#: Why an element is furniture: its class or a wrapper's tag, readers' remarks, its tag, never shown.
BY_CLASS, BY_REMARK, BY_TAG, BY_HIDING = 1, 2, 3, 4
#: An opening tag of these ends an open element of the same kind: markup leaves their ends out.
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "title"}
MAIN = frozenset(("article", "main"))


def _names(attrs: str) -> Iterator[list[str]]:
    """The parts of each class, id or role name; a label is one name."""
    for m in CLASSES.finditer(attrs):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "").lower()
        for name in [value] if m[0].lstrip(" \t\r\n\f/").lower().startswith("aria") else value.split():
            yield [x for x in re.split(r"[\s_\-:/.]+", name) if x and not x.isdigit()]


def _furniture(tag: str, attrs: str) -> int:
    """Why an element is furniture, 0 if it is not: a name must consist of layout words alone."""
    if tag in FURNITURE:
        return BY_HIDING if tag == "head" else BY_CLASS if tag in WRAPPERS else BY_TAG
    if not attrs or tag in ("body", "html"):
        return 0
    if tag in MAIN:
        return BY_REMARK if "comment" in attrs.lower() and any(x and x[0] in REMARK_WORDS for x in _names(attrs)) else 0
    if HIDDEN.search(attrs):
        return BY_HIDING
    found = [x for x in _names(attrs) if x and FURNITURE_WORDS.issuperset(x)]
    return 0 if not found else BY_REMARK if any(REMARK_WORDS.intersection(x) for x in found) else BY_CLASS


class Page:
    """Tokens of a page: text runs and tags, each with its number of words, block and standing."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []  # (kind, text or tag name); kind: w, o(pen), c(lose)
        self.raw: list[bool] = []  # tags whose content is no text
        self.elements: list[list] = []  # [first, past the last token, tag, why furniture, 1 article or 2 main, parent's place]
        stack: list[tuple[str, int]] = []  # (tag, place in elements)
        self.blocks: list[int] = []  # places in the stack that hold block elements
        self.open: Counter[str] = Counter()  # open elements by tag
        unclosed: set[str] = set()  # raw elements that nothing closes from here on
        last = {c: source.rfind(c) for c in "\"'>"}
        pos, end = 0, len(source)
        while pos < end:
            if source[pos] != "<":
                stop = source.find("<", pos)
                stop = end if stop < 0 else stop
                self._add("w", source[pos:stop])
                pos = stop
                continue
            past = self._passed_over(source, pos)
            if past:
                pos = past
                continue
            m = TAG.match(source, pos)
            stop = self._tag_end(source, m.end(), last) if m else -1
            if stop < 0:  # an open angle bracket that no tag follows
                self._add("w", "<")
                pos += 1
                continue
            tag, attrs, closing = m[1].lower(), source[m.end() : stop], source[pos + 1] == "/"
            pos = stop + 1
            if closing:
                if self.open[tag]:
                    self._close(stack, next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                self._add("c", tag)
                continue
            if tag in RAW:
                if not attrs.endswith("/") and tag not in unclosed:
                    found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
                    if found:
                        pos = found.end()
                    else:
                        unclosed.add(tag)
                        pos = end if tag in ("script", "style", "textarea", "title") else pos
                self._add("o", tag, True)
                continue
            over = CLOSES.get(tag, ())
            if tag in ENDS_P or tag == "p":
                over = (*over, "p")
            # what ends here can only be the innermost block element; inline elements left open in it end with it
            while over and self.blocks and stack[self.blocks[-1]][0] in over:
                self._close(stack, self.blocks[-1])
            if tag not in VOID and not attrs.endswith("/"):
                main = 2 if tag == "main" or ROLE_MAIN.search(attrs) else 1 if tag in MAIN or BODY_PROP.search(attrs) else 0
                self.elements.append([len(self.tokens), None, tag, _furniture(tag, attrs), main, stack[-1][1] if stack else -1])
                if tag in BLOCK:
                    self.blocks.append(len(stack))
                self.open[tag] += 1
                stack.append((tag, len(self.elements) - 1))
            self._add("o", tag)
        self._close(stack, 0)
        self.words = [len(t.split()) if k == "w" else 0 for k, t in self.tokens]
        self.upto = [0, *accumulate(self.words)]
        self.opened: set[int] = set()  # elements that are no furniture after all
        self.skip, self.mains = self._standing(self.opened)  # page furniture; [first, last) of outermost article or main elements
        if any(e[4] for e in self.elements):
            self._open_mains()

    def _close(self, stack: list[tuple[str, int]], depth: int) -> None:
        while len(stack) > depth:
            tag, place = stack.pop()
            self.elements[place][1] = len(self.tokens)
            self.open[tag] -= 1
            if self.blocks and self.blocks[-1] == len(stack):
                self.blocks.pop()

    @staticmethod
    def _passed_over(source: str, pos: int) -> int:
        """Past a comment, a CDATA section or a declaration that starts here; 0 if none does. One without an end goes to the page's end."""
        for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if source.startswith(start, pos):
                at = source.find(stop, pos + len(start))
                return at + len(stop) if at >= 0 else len(source)
        return 0

    @staticmethod
    def _tag_end(source: str, pos: int, last: dict[str, int]) -> int:
        """Where the tag's closing angle bracket stands; -1 for none. One inside quotes ends no tag, unless the quote is never closed."""
        while pos <= last[">"]:
            m = QUOTE_OR_END.search(source, pos)
            if m[0] == ">":
                return m.start()
            pos = source.find(m[0], m.end()) + 1 if m.end() <= last[m[0]] else m.end()
        return -1

    def _standing(self, opened: set[int]) -> tuple[list[bool], list[tuple[int, int]]]:
        """Which tokens are furniture, and the outermost articles and mains that are not, with the opened elements shown."""
        skip, mains, hidden, inside = list(self.raw), [], [], []
        for i, (first, last, tag, why, main, parent) in enumerate(self.elements):
            within, under = (inside[parent], hidden[parent]) if parent >= 0 else (False, False)
            own = i not in opened and (why > 0 or (tag == "header" and not within))
            if own and not under:
                skip[first:last] = [True] * (last - first)
            hidden.append(under or own)
            main = main > 0 and not hidden[i]
            if main and not within:
                mains.append((first, last))
            inside.append(within or main)
        return skip, mains

    def _open_path(self, i: int) -> None:
        """Open an element and those around it."""
        while i >= 0 and i not in self.opened:
            self.opened.add(i)
            i = self.elements[i][5]

    def _open_mains(self) -> None:
        """Show what stands around each main element, and around the longest article.

        An article stays hidden in an element that is furniture by its tag or
        holds remarks, and where no article is shown, if it is shorter than the
        text that is.
        """
        shown = sum(w for w, x in zip(self.words, self.skip, strict=True) if not x)
        best, most, worst = -1, max((self.upto[b] - self.upto[a] for a, b in self.mains), default=max(0, shown - 1)), []
        for i, (first, last, _, why, main, parent) in enumerate(self.elements):
            worst.append(max(why, worst[parent] if parent >= 0 else 0))
            if not main or why > BY_CLASS:
                continue
            if main == 2 and worst[i] < BY_HIDING:
                self._open_path(i)
            elif main == 1 and worst[i] <= BY_CLASS and self.upto[last] - self.upto[first] > most:
                best, most = i, self.upto[last] - self.upto[first]
        self._open_path(best)
        if self.opened:
            self.skip, self.mains = self._standing(self.opened)

    def _open_region(self, weights: dict[str, float]) -> None:
        """On a page without an article: show the elements that hold most of the region found with furniture by class shown.

        Remarks count only where there is nothing else.
        """
        for least in (BY_CLASS, BY_REMARK):
            soft = {i for i, e in enumerate(self.elements) if 0 < e[3] <= least or (not e[3] and e[2] == "header")}
            if not soft:
                continue
            first, last = self.region(weights, self._standing(self.opened | soft)[0])
            if first < last:
                n = self.upto[last] - self.upto[first]
                held = {i for i in soft if 2 * (self.upto[min(last, self.elements[i][1])] - self.upto[max(first, self.elements[i][0])]) > n}
                if held:
                    self.opened |= held
                    self.skip, self.mains = self._standing(self.opened)
                return

    def _add(self, kind: str, text: str, raw: bool = False) -> None:
        self.tokens.append((kind, text))
        self.raw.append(raw)

    def scores(self, weights: dict[str, float], skip: list[bool] | None = None) -> list[float]:
        """A word's weight for each word, a tag's (negative) for each tag; furniture scores as tags do."""
        out, tag, word = [], weights.get("tag", -2.0), weights.get("word", 1.0)
        for (kind, text), n, hidden in zip(self.tokens, self.words, skip or self.skip, strict=True):
            if kind == "w":
                out.append(-0.5 * n if hidden else word * n)
            else:
                out.append(min(weights.get(text, tag), -0.05))
        return out

    def region(self, weights: dict[str, float], skip: list[bool] | None = None) -> tuple[int, int]:
        """[first, last) of the contiguous tokens with the largest sum: one linear scan."""
        best, first, last, run, start = 0.0, 0, 0, 0.0, 0
        for i, x in enumerate(self.scores(weights, skip)):
            if run <= 0:
                run, start = 0.0, i
            run += x
            if run > best:
                best, first, last = run, start, i + 1
        return first, last

    def regions(self, weights: dict[str, float]) -> list[tuple[int, int]]:
        """All maximal-scoring regions, in page order, that score SHARE of the best: the same linear scan, begun anew where a sum falls to the last peak's loss."""
        found, total, scores = [], 0.0, self.scores(weights)
        for i, x in enumerate(scores):
            if x > 0:
                # (first, past, sum before, sum after); a region takes in earlier ones while the sum before it lies above theirs
                new = (i, i + 1, total, total + x)
                while True:
                    k = len(found) - 1
                    while k >= 0 and found[k][2] >= new[2]:
                        k = found[k][4]
                    if k < 0 or found[k][3] >= new[3]:
                        found.append((*new, k))
                        break
                    new = (found[k][0], new[1], found[k][2], new[3])
                    del found[k:]
            total += x
        best = max((f[3] - f[2] for f in found), default=0.0)
        return [(f[0], f[1]) for f in found if f[3] - f[2] >= SHARE * best]

    def _whole_blocks(self, first: int, last: int) -> tuple[int, int]:
        """The region, widened to the ends of the blocks that it begins and ends in."""
        while first > 0 and not (self.tokens[first - 1][0] != "w" and self.tokens[first - 1][1] in BLOCK):
            first -= 1
        while last < len(self.tokens) and not (self.tokens[last][0] != "w" and self.tokens[last][1] in BLOCK):
            last += 1
        return first, last

    def main_text(self, weights: dict[str, float]) -> str:
        if not self.mains:
            self._open_region(weights)
        first, last = self.region(weights)
        if first == last:
            return ""
        inside = [(min(last, b) - max(first, a), a, b) for a, b in self.mains if min(last, b) > max(first, a)]
        if inside:
            # articles that the scan did not reach belong to the main text as far as they stand beside the best one
            spans = [(a, b) for _, a, b in sorted(inside, key=lambda x: x[1])]
        else:
            spans = []
            for a, b in self.regions(weights):
                a, b = self._whole_blocks(max(a, spans[-1][1] if spans else 0), b)
                if spans and a <= spans[-1][1]:
                    before = spans.pop()
                    a, b = before[0], max(b, before[1])
                spans.append((a, b))
        blocks, cur = [], []
        for a, b in spans:
            for i in range(a, b):
                kind, text = self.tokens[i]
                if kind == "w":
                    if not self.skip[i]:
                        cur.append(entities.unescape(text))  # run by run: no reference goes on behind a tag
                elif text in BLOCK:
                    blocks.append(cur)
                    cur = []
                elif text == "br":
                    cur.append(" ")
            blocks.append(cur)
            cur = []
        done = (" ".join("".join(x).split()) for x in blocks)
        return "\n\n".join(x for x in done if x)


def counts(source: str) -> dict[str, tuple[int, int]]:
    """Words ("") and tags of a labelled page: how many lie inside its main part, and how many outside."""
    page = Page(source)
    if not page.mains:
        return {}
    ins, out = Counter(), Counter()
    a, b = page.mains[0]
    for i, ((kind, text), n, skip) in enumerate(zip(page.tokens, page.words, page.skip, strict=True)):
        c = ins if a <= i < b and not skip else out
        c["" if kind == "w" else text] += n if kind == "w" else 1
    return {t: (ins[t], out[t]) for t in ins | out}


def weigh(found: dict[str, tuple[int, int]], smooth: float = 2.0) -> dict[str, float]:
    """Log odds of a word, and of each tag for so many words, to lie inside the main part.

    Of these, the word's is cut to be positive and a tag's to be negative. A tag
    that no labelled page has weighs as the mean of all.
    """
    if not found or not sum(i for i, _ in found.values()) or not sum(o for _, o in found.values()):
        return {"word": 1.0, "tag": -2.0}
    n_in, n_out = (sum(x[k] for x in found.values()) + smooth for k in (0, 1))
    odds = {t: log((i + smooth) / n_in) - log((o + smooth) / n_out) for t, (i, o) in found.items()}
    weights = {t: min(-0.5, x) for t, x in odds.items() if t}
    tags = [x for t, x in weights.items() for _ in range(min(1000, sum(found[t])))]
    return weights | {"word": max(0.25, odds.get("", 0.0)), "tag": sum(tags) / len(tags) if tags else -2.0}


def learn(sources: list[str]) -> dict[str, float]:
    """Weights from pages whose main part is marked."""
    total: dict[str, tuple[int, int]] = {}
    for s in sources:
        for t, (i, o) in counts(s).items():
            a, b = total.get(t, (0, 0))
            total[t] = a + i, b + o
    return weigh(total)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Learn from at most `sample` labelled pages, those with the smallest hash of their id, each as a whole.

    Ids are chosen first; their pages are counted where they lie, and two numbers
    a tag come to the driver, for tags that two pages have.
    """
    marked = pages.where(F.col("html").cast("string").rlike("(?i)<(article|main)[\\s>]") & F.col("page_id").isNotNull())
    ids = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id", F.lit("pages")), "page_id").limit(sample)
    rows = marked.join(F.broadcast(ids), "page_id", "left_semi").select(F.col("html").cast("string").alias("_html"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(t, i, o) for h in each(b, "_html") for t, (i, o) in counts(h).items()]
            yield pa.record_batch([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["tag", "ins", "out"])

    total = rows.mapInArrow(go, "tag string, ins long, out long").groupBy("tag").agg(F.sum("ins").alias("ins"), F.sum("out").alias("out"), F.count("*").alias("k"))
    return weigh({r["tag"]: (r["ins"], r["out"]) for r in total.where("k > 1 OR tag = ''").collect()})


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, one row for each input row.

    Blocks are joined by two \\n; white space in a block becomes one blank. A null
    or empty html, or one without words outside page furniture, has an empty
    text. Repeated rows give equal rows; an empty table gives an empty one; other
    columns, whatever they are called, are not read. Pages of any length are read
    whole, in time that grows with their length.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("_html"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h).main_text(weights) if h else "" for h in each(b, "_html")]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(go, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
