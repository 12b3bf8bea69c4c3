"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores the log-odds of its
container (positive in containers that hold article words on labelled pages,
negative in menus, footers, adverts), a tag scores its negative cost.  One
linear scan finds the contiguous run of the largest sum.  Inside the run, text
of containers that are not main text (see ``NOT_MAIN``) is left out; where the
run lies in an article or main element, the rest of that element belongs to it
too, so an advert between paragraphs cannot cut an article.

Names do not outvote the page: a class counts as a whole ("no-sidebar" and
"article-header" are no cues), and one that holds the article is none either.

Weights come from about ``LABEL_PAGES`` labelled pages: pages that mark their
main text with an article or main element and whose id hash is under a bound set
by their number, so no task gathers them.
Containers not met there score by the cues in their names.

Defined cases: null html is empty and has the empty text, as has a page without
main words.  Markup may be cut off or unclosed anywhere: an unfinished tag or
comment at the end is dropped, an open element ends with its parent.  Rows are
kept one to one; columns other than id, url and html are not read; an empty
table gives no rows.  Time is linear in a page's length.
"""

from __future__ import annotations

import html as htmllib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_PAGES = 500       # labelled pages read for the weights
LABEL_KEYS = 10_000     # containers and tags whose weights are kept
TOP = 3.0               # weights are within this

MAIN = frozenset(("article", "main"))
NOT_MAIN = frozenset("""head nav header footer aside form script style noscript template iframe
    button select menu dialog svg object canvas audio video""".split())
CUES = frozenset("""ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies
    consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer
    header masthead comment comments disqus reply replies respond share sharing social related
    recommended newsletter subscribe signup login popup modal overlay widget widgets pagination pager
    toolbar search complementary contentinfo alert""".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
# words beside a cue that say how it is laid out, not what it is
LAYOUT = frozenset("""area bar block box container content inner outer wrap wrapper section list item items
    link links button buttons form panel slot unit row col column group holder top bottom left right sticky
    fixed main primary secondary site page global text posts stories thread""".split())
# words that turn a cue around: no-sidebar, has-related, page-with-menu
TURNED = frozenset("no not non without with has have is hide disable disabled".split())
TITLES = frozenset("header masthead".split())
WHOLE = frozenset("article entry post story content blog page text section".split())
CONTAINERS = frozenset("""article main nav header footer aside form section div ul ol dl table body
    head figure blockquote menu dialog details""".split())
BLOCKS = CONTAINERS | frozenset("""p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre address hr fieldset
    legend figcaption summary html option center title caption tbody thead tfoot""".split())
VOID = frozenset("br img hr input meta link wbr source col area base embed track param".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "title", "option", "legend"}
CLOSES_OWN = frozenset("li dt dd tr td th option".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""",
                  re.I)
TOKEN = re.compile(r"[A-Za-z]+")
WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[a-z]{2,}")
STEP = re.compile(r"""[^>=]*(?:(>)|=\s*(["'])?)""")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def tag_end(t: str, i: int, last: dict[str, int]) -> int:
    """Where the tag whose name ends at ``i`` ends (its ``>``), -1 if it does not.
    A ``>`` inside a quoted value does not end it, if the quote is closed; ``last``
    is where each quote stands for the last time."""
    while True:
        m = STEP.match(t, i)
        if m is None:
            return -1
        if m[1]:
            return m.end() - 1
        i = m.end()
        if m[2] and last[m[2]] >= i:
            i = t.find(m[2], i) + 1


def is_cue(name: str) -> bool:
    """Whether a class, id or role as a whole names what is not main text: its
    last word that is not layout is a cue and no word turns it around.  The header
    of an article is a part of it."""
    words = [x.lower() for x in WORD.findall(name)]
    if any(x in TURNED for x in words):
        return False
    told = [i for i, x in enumerate(words) if x not in LAYOUT]
    if not told or words[told[-1]] not in CUES:
        return False
    return not (words[told[-1]] in TITLES and any(x in WHOLE for x in words[:told[-1]]))


def describe(name: str, attrs: str) -> tuple[str, str, bool]:
    """(key, the cue's kind or '', hidden) of an opening tag.  An article or main
    element has a cue only if a name of it is nothing but a comment's or an
    advert's."""
    key, cue, hidden = name, "", False
    if attrs:
        for m in ATTR.finditer(attrs):
            what, value = m[1].lower(), (m[2] or "").strip("\"'")
            if what == "hidden" or (what == "aria-hidden" and value.lower() == "true") \
                    or (what == "style" and HIDDEN.search(value)):
                hidden = True
            elif what in ("class", "id", "role"):
                names = value.split()
                for x in names:
                    if name == "article" and x.lower() in CUES - TITLES or name not in MAIN and is_cue(x):
                        cue = "comment" if cue == "comment" or any(
                            y.lower() in COMMENTS for y in WORD.findall(x)) else "cue"
                first = TOKEN.findall(value)
                if what == "class" and first and key == name:
                    key = f"{name}.{first[0].lower()}"
    return key, cue, hidden


def page_tokens(t: str) -> list[tuple]:
    """(key, words, text, block, left out, main element) in page order: a text
    run has its container's key and its number of words, a tag -1.

    A container with a cue in its names is left out, unless it holds an article or
    main element, or, on a page without one, more than half of the page's words
    (comments aside): then its name says nothing."""
    out: list[tuple] = []
    # name, container key, left out, number of the outermost article or main, of
    # the innermost container with a cue
    stack: list[tuple] = [("", "page", False, 0, 0)]
    cues: list[list] = [[0, "", 0, False]]  # outer cue, kind, words, holds a main element
    last = {q: t.rfind(q) for q in "\"'"}
    is_open: dict[str, int] = {}  # how often each name is on the stack
    block, mains, i, n = 0, 0, 0, len(t)

    def text(raw: str) -> None:
        words = len(raw.split())
        if words or raw:
            _, key, left, main, cue = stack[-1]
            cues[cue][2] += 0 if left else words
            out.append((key, words, raw, block, left, main, cue))

    def pop_to(name: str, stop: frozenset = frozenset()) -> None:
        """Ends the innermost open ``name``, unless one of ``stop`` is inside it."""
        if not is_open.get(name):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                for gone in stack[k:]:
                    is_open[gone[0]] -= 1
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    while i < n:
        lt = t.find("<", i)
        if lt < 0:
            text(t[i:])
            break
        nxt = t[lt + 1:lt + 2]
        if not (nxt.isascii() and nxt.isalpha()) and nxt not in ("/", "!", "?"):
            text(t[i:lt + 1])
            i = lt + 1
            continue
        if lt > i:
            text(t[i:lt])
        if t.startswith("<!--", lt):
            end = t.find("-->", lt + 4)
            i = n if end < 0 else end + 3
            continue
        closing = nxt == "/"
        m = NAME.match(t, lt + 1 + closing) if nxt not in "!?" else None
        end = tag_end(t, m.end(), last) if m else t.find(">", lt)
        if end < 0:
            break
        i = end + 1
        if m is None:
            continue
        name = m[0].lower()
        if closing:
            if name == "br":
                text(" ")
                continue
            pop_to(name)
            if name in BLOCKS:
                block += 1
            out.append((f"/{name}", -1, "", block, False, stack[-1][3], 0))
            continue
        key, cue, hidden = describe(name, t[m.end():end])
        if name in CLOSES_P or name in CLOSES_OWN:
            pop_to(name if name in CLOSES_OWN else "p", CONTAINERS)
        if name in BLOCKS:
            block += 1
        _, above, left, main, outer = stack[-1]
        out.append((key, -1, "", block, left, main, outer))
        if name in VOID:
            if name in ("br", "hr"):
                text(" ")
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(t, i)
            i = n if close is None else close.end()
            continue
        if name in MAIN and not cue and not main:  # nested ones are part of it
            mains += 1
            main = mains
            at = outer
            while at and not cues[at][3]:
                cues[at][3] = True
                at = cues[at][0]
        named = name in NOT_MAIN and not (main and name == "header")
        if t[end - 1] != "/" or name in CONTAINERS:
            if cue and not left and name not in ("body", "html"):
                cues.append([outer, cue, 0, False])
                outer = len(cues) - 1
            is_open[name] = is_open.get(name, 0) + 1
            stack.append((name, key if name in CONTAINERS else above, left or hidden or named, main, outer))

    for c in reversed(cues[1:]):  # inner ones come later
        cues[c[0]][2] += c[2] if c[1] != "comment" else 0
    most = cues[0][2] / 2
    drop = [False] * len(cues)
    for k, (outer, kind, words, holds) in enumerate(cues[1:], 1):
        means_it = not holds and not (not mains and kind == "cue" and words > most)
        drop[k] = drop[outer] or means_it
    return [(*x[:4], x[4] or drop[x[6]], x[5]) for x in out]


def label_counts(t: str, counts: dict[str, list[int]]) -> None:
    """Adds [inside, outside] the main text per word container and tag of a
    labelled page; tags count under ``<`` + key."""
    tokens = page_tokens(t)
    if not any(main for *_, main in tokens):
        return
    for key, words, _, _, left, main in tokens:
        inside = bool(main) and not left
        if words < 0:
            counts.setdefault("<" + key, [0, 0])[not inside] += 1
        elif words:
            counts.setdefault(key, [0, 0])[not inside] += words


def weights_of(counts: dict[str, list[int]]) -> dict[str, float]:
    """Words: smoothed log-odds.  Tags: a cost of at least 0.1, higher for tags
    that stand outside the main text."""
    out = {}
    for key, (inside, outside) in counts.items():
        odds = math.log((inside + 0.5) / (outside + 0.5))
        out[key] = -min(TOP, max(0.1, -odds)) if key[0] == "<" else min(TOP, max(-TOP, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the largest sum over 0, the first
    of equals; (0, 0) if there is none."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, at = run, (start, i + 1)
    return at


def main_text(t: str, weights: dict[str, float]) -> str:
    tokens = page_tokens(t)
    scores = []
    for key, words, _, _, left, main in tokens:
        if words < 0:
            scores.append(weights.get("<" + key, -0.5))
        else:
            w = weights.get(key)
            if left:
                w = min(w or 0.0, -1.0)
            elif w is None or main and w < 0:
                w = 1.0
            scores.append(w * words)
    start, end = best_run(scores)
    run = tokens[start:end]
    held: dict[int, float] = {}
    for (_, words, _, _, left, main), s in zip(run, scores[start:end]):
        if words > 0 and not left:
            held[main] = held.get(main, 0.0) + s
    element = max(sorted(held), key=held.get, default=0)
    if element:  # the run, and the whole of the elements that it lies in
        run = [x for i, x in enumerate(tokens) if start <= i < end or x[5] in held and x[5]]
    pieces: dict[int, list[str]] = {}
    for _, words, raw, block, left, _ in run:
        if words >= 0 and not left:
            pieces.setdefault(block, []).append(htmllib.unescape(raw))
    joined = (" ".join("".join(p).split()) for _, p in sorted(pieces.items()))
    return "\n".join(x for x in joined if x)


def fit_weights(df: DataFrame, id_col: str, html_col: str,
                label_pages: int = LABEL_PAGES) -> dict[str, float]:
    """Weights from about ``label_pages`` labelled pages."""
    low = F.lower(F.col(html_col))
    labelled = df.where(F.contains(low, F.lit("<article")) | F.contains(low, F.lit("<main")))
    share = min(1.0, label_pages / max(1, labelled.count()))
    labelled = labelled.where(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(2 ** 63 - 1))
                              <= int(share * 2 ** 63) - 1).select(F.col(html_col).alias("html"))

    def per_task(batches):
        counts: dict[str, list[int]] = {}
        for b in batches:
            for x in b.column(0):
                label_counts(x.as_py() or "", counts)
        keys = sorted(counts)
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(keys, pa.string()),
            "inside": pa.array([counts[k][0] for k in keys], pa.int64()),
            "outside": pa.array([counts[k][1] for k in keys], pa.int64())})

    total = labelled.mapInArrow(per_task, "key string, inside long, outside long") \
        .groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")) \
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(LABEL_KEYS)
    return weights_of({r.key: [r.inside, r.outside] for r in total.collect()})


def extract_main_text(df: DataFrame, weights: dict[str, float], id_col: str = "page_id",
                      url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text."""
    def per_task(batches):
        for b in batches:
            text = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())],
                                             names=["id", "url", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(per_task, f"id {kind}, url string, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
