"""HTML extraction: the main text of web pages.

Method: maximum-scoring subsequence.  A page is a sequence of words and tags.  Words score
positive where text like theirs (same block element, linked or not) lies in the article of
labelled pages, tags score negative; a linear scan finds the contiguous region with the
largest sum.  Elements that are no article text by their name or class (menus, adverts,
comments, ...) count against a region and are left out of its text; one that stands inside
the region costs as much as a tag or two, whatever it holds.  Forms and marks of a
class, id or role are evidence only: what they hold decides as well (``_released``).

Labelled pages are those that mark their article (``<article>``, else ``<main>``); Spark
counts words and tags inside and outside of it over all of them.  On a page that marks its
article, whether a word or tag lies in it is part of its kind; on other pages the kinds
have the weights of all places together.  Tags of dropped elements teach nothing, and a
rare kind's weight is drawn to its default.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names by their use in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
BLOCKS = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr "
                   "html img li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg dialog menu object audio "
                    "video canvas input option title".split())
#: Words of a class, id or role that mark other things than article text.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments complementary "
                  "contentinfo cookie cookies consent disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice "
                  "notices alert pager pagination paywall popup promo promotion recommended related replies responses rail search share sharing "
                  "sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(script|style|noscript|template|iframe|textarea|title|svg)\b[^>]*>.*?(?:</\1\s*>|$)"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)", re.S | re.I)
_MARK = re.compile(r"(?<![\w:-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Words are scored with at most this weight, unknown kinds of words and tags with the defaults.
MOST, WORD, LINKED, TAG = 3.0, 1.0, -1.0, -0.5
#: A dropped element, whatever it holds: inside a marked article, and elsewhere.
DROP, OTHER = -0.5, -4.0
#: Counts of a kind at which its learned weight and its default count the same.
PRIOR = 20
#: Places on a page that marks its article, and on one that does not.
INSIDE, OUTSIDE, ANYWHERE = "@in", "@out", ""


#: Marks of other people's texts, however long these are.
REPLIES = frozenset("comment comments disqus replies responses".split())
#: Elements whose id is made from their own text.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CONTROLS = frozenset("button input select textarea".split())


def _marked(name: str, attributes: str) -> tuple[str, bool] | None:
    """What marks an element, and whether as replies: "whole" for a role, or a whole word of a
    class or id; "class" or "id" for a part of such a word (the class first)."""
    found, replies = set(), False
    for what, *groups in _MARK.findall(attributes):
        what = what.lower()
        if what == "id" and name in TITLED:
            continue
        for word in next((g for g in groups if g), "").split():
            if word.lower() in MARKS:
                found.add("whole")
                replies |= word.lower() in REPLIES
            elif what != "role" and (parts := MARKS.intersection(part.lower() for part in _PARTS.findall(word))):
                found.add(what)
                replies |= bool(parts & REPLIES)
    return next(((x, replies) for x in ("whole", "class", "id") if x in found), None)


class _Soft:
    """A form or marked element: its mark, the one around it, and what it holds."""

    __slots__ = ("mark", "replies", "around", "inside", "words", "linked", "controls", "dropped")

    def __init__(self, mark, replies, around, inside):
        self.mark, self.replies, self.around, self.inside = mark, replies, around, inside
        self.words = self.linked = self.controls = 0
        self.dropped = False


def _released(e: _Soft, total: int, placed: int) -> bool:
    """Whether a form or marked element is read like any other: if it holds most of the unlinked
    words of the page or of the article around it (of a page with an article, only inside that);
    or in an article, if only a part of its id marks it, as in ids made from a heading, and it
    is text rather than links and controls."""
    if e.mark == "id" and e.inside and not e.replies and not e.controls and e.words > 2 * e.linked:
        return True
    if placed and not e.inside:
        return False
    whole = placed if placed else total
    return 10 * e.words > 9 * whole if e.replies else 2 * e.words > whole


def tokens(page: str):
    """(kind, value, in article, dropped) for each piece: kind "tag" with the name, or a text's
    kind (block element, linked) with its decoded text."""
    stack: list[tuple[str, bool, _Soft | None, str]] = []  # element, whether it began a dropped part, form or mark and block around it
    opened: Counter = Counter()              # elements of the stack by name
    dropped = article = placed = 0           # placed: article or main
    soft: _Soft | None = None
    block, linked, at = "body", 0, 0
    out, softs, total, inside_words = [], [], 0, 0

    def text(piece):
        nonlocal total, inside_words
        value = html.unescape(piece)
        out.append(((block, linked > 0), value, article > 0, dropped > 0, soft))
        if not dropped and (n := len(value.split())):
            if not linked:
                total += n
                inside_words += n * (placed > 0)
            if soft is not None:
                if linked:
                    soft.linked += n
                else:
                    soft.words += n
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name, close = name.lower(), bool(m.group(2))
        at_tag = len(out)
        out.append(("tag", name, article > 0, dropped > 0, soft))
        if soft is not None and name in CONTROLS:
            soft.controls += 1
        if close:
            if opened[name]:
                while stack:
                    top, began, soft, block = stack.pop()
                    opened[top] -= 1
                    dropped -= began
                    article -= top == "article"
                    placed -= top in ("article", "main")
                    linked -= top == "a"
                    if top == name:
                        break
        elif name not in VOID and not m.group(4).rstrip().endswith("/"):
            if (dropped or soft is not None) and name in ("article", "main"):      # an unclosed menu or form before it does not reach into it
                stack = [(x, False, None, around) for x, _, _, around in stack]
                dropped, soft = 0, None
            elif name in ("p", "li", "td", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
                _, began, soft, block = stack.pop()        # closed by the next of its kind
                opened[name] -= 1
                dropped -= began
            bad = (name in DROPPED and name != "form") or (name == "header" and not article)
            mark = None
            if not bad and name not in ("html", "body", "article", "main"):
                mark = ("whole", False) if name == "form" else _marked(name, m.group(4))
            stack.append((name, bad, soft, block))
            opened[name] += 1
            if mark:
                soft = _Soft(*mark, soft, placed > 0)
                softs.append(soft)
                out[at_tag] = out[at_tag][:4] + (soft,)      # its own tag goes with it
            dropped += bad
            article += name == "article"
            placed += name in ("article", "main")
            linked += name == "a"
            if name not in INLINE:
                block = name
    if at < len(page):
        text(page[at:])
    for e in reversed(softs):                # the inner ones come later
        if e.around is not None:
            e.around.words += e.words
            e.around.linked += e.linked
            e.around.controls += e.controls
    for e in softs:
        e.dropped = (e.around is not None and e.around.dropped) or not _released(e, total, inside_words)
    for kind, value, inside, hard, e in out:
        yield kind, value, inside, hard or (e is not None and e.dropped)


def _kind(kind) -> str:
    """Name of a text's or tag's weight; unknown elements share one."""
    block, linked = kind
    return f"{block if block in BLOCKS else 'other'}{'+a' if linked else ''}"


def _read(page: str) -> tuple[list[tuple], bool]:
    """``tokens`` of a page, and whether it marks an article (else a main) that holds words."""
    page = page if re.search(r"<article\b", page, re.I) else re.sub(r"(?i)<(/?)main\b", r"<\1article", page)
    pieces = list(tokens(page))
    return pieces, any(inside and not dropped and kind != "tag" and not value.isspace() for kind, value, inside, dropped in pieces)


def count_page(page: str) -> Counter:
    """Tags inside (True) and outside of a labelled page's article, and words of text that no
    name or class has settled."""
    out: Counter = Counter()
    for kind, value, article, dropped in _read(page)[0]:
        if dropped:
            continue
        if kind == "tag":
            out["tag", value if value in BLOCKS or value in INLINE or value in DROPPED else "other", article] += 1
        else:
            out["word", _kind(kind), article] += len(value.split())
    return out


def _default(what: str, kind: str, place: str) -> float:
    if what == "tag":
        return TAG
    if place == OUTSIDE:
        return LINKED
    return LINKED if kind.endswith("+a") and place == ANYWHERE else WORD


def weights(pages: DataFrame) -> dict[tuple[str, str], float]:
    """Weight of each kind of word and tag, from all labelled pages: the logarithm of its odds to
    lie in an article, drawn to the default where there are few.  The table has a row for each kind, and kinds are a fixed list."""
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count_page(page))
        rows = [(what, kind, inside, n) for (what, kind, inside), n in sorted(total.items())]
        yield pa.RecordBatch.from_pydict({"what": pa.array([r[0] for r in rows], pa.string()), "kind": pa.array([r[1] for r in rows], pa.string()),
                                          "inside": pa.array([r[2] for r in rows], pa.bool_()), "n": pa.array([r[3] for r in rows], pa.int64())})
    labelled = pages.select(F.col("html").cast("string").alias("html")).filter(F.lower("html").rlike(r"<(article|main)\b"))
    counted = labelled.mapInArrow(run, "what string, kind string, inside boolean, n long").groupBy("what", "kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    out = {}
    for r in counted.collect():
        for place, a, b in ((ANYWHERE, r["a"], r["b"]), (INSIDE, r["a"], 0), (OUTSIDE, 0, r["b"])):
            learned = max(-MOST, min(MOST, math.log((a + 1) / (b + 1))))
            w = ((a + b) * learned + PRIOR * _default(r["what"], r["kind"], place)) / (a + b + PRIOR)
            # tags count against a region: little if they are an article's own
            out[r["what"], r["kind"] + place] = w if r["what"] == "word" else min(-0.1, w)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the largest positive sum, in one scan: (start, end), the end
    exclusive; of equal sums the one that ends first, then the shortest; (0, 0) if no sum is positive."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, region = total, (start, k + 1)
    return region


def scored(page: str, weight: dict[tuple[str, str], float]) -> tuple[list[float], list[str]]:
    """Score and text of each piece of a page.  Only the first piece of a run of dropped ones costs."""
    scores, texts, running = [], [], False
    pieces, marked = _read(page)
    for kind, value, inside, dropped in pieces:
        place = ANYWHERE if not marked else INSIDE if inside else OUTSIDE
        n = 0 if kind == "tag" else len(value.split())
        if dropped:
            scores.append(0.0 if running else DROP if place == INSIDE else OTHER)
            running = True
        elif kind == "tag":
            scores.append(weight.get(("tag", value + place), TAG))
            running = False
        else:
            scores.append(n * weight.get(("word", _kind(kind) + place), _default("word", _kind(kind), place)))
            running = running and not n
        texts.append(("" if value in INLINE else " ") if kind == "tag" else "" if dropped else value)
    return scores, texts


def extract(page: str | None, weight: dict[tuple[str, str], float]) -> str:
    """Text of the best region: decoded, white space as one space, blocks joined by one.  A page
    on which the learned weights leave nothing is read with the default ones."""
    scores, texts = scored(page or "", weight)
    start, end = best_region(scores)
    if not end and weight:
        return extract(page, {})
    return " ".join("".join(texts[start:end]).split())


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    ``pages`` needs page_id, url and html; other columns are ignored.  Returns one row per
    input row: page_id, url, text (empty if none) and n_chars (its code points).  A null
    html is empty; broken markup is read as far as it goes; repeated rows give equal rows;
    an empty table gives an empty result.  Without a labelled page all weights have their
    defaults.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights(pages))      # one number for each kind of word and tag

    def run(batches):
        for batch in batches:
            texts = [extract(page, shared.value) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
