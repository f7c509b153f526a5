"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into its block elements. Each gets features: its tag, what the tokens of its class, id and role and those of
its ancestors have meant so far, subtree density (text, links, elements), depth, place in the page and statistics of its
siblings. Tokens are hashed, and how often each went with main text is learned from generated training pages; boosted trees
split on that. A second set of trees is trained on the same pages without any token: pages whose class names were never met
are told by their structure. The trees give the log-odds of each element being main text. Decoding then picks for every subtree the best of three states - main, boilerplate, or decided by its children - so that
no element can be main text inside boilerplate. Where nothing is left but there is a subtree of prose, the likeliest such
subtree is the text. Scripts, styles, comments in the markup, form controls and the head are never text.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.

Defined results: null and empty pages, and pages without main text, give an empty text; a page without any tag is text as a
whole; unclosed and truncated markup is read as far as it goes; repeated rows are read each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from complaintflow.llm import boosting
from complaintflow.llm.html_pages import Generator
from complaintflow.llm.shared import arrow_map, columns, table

TRAIN_PAGES = 450
#: What a change of state between an element and its child costs, in log-odds.
SWITCH = 1.0

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th img input option wbr".split())
RAW = "script style noscript template textarea title select button svg iframe object canvas audio video math".split()
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tr", "tbody", "thead"}}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav header footer form td blockquote".split())

CHUNK_NODES = 20_000
#: Tokens of attributes are told apart by their hash modulo this.
TOKENS = 1 << 16
#: A page on which nothing was found has text if a subtree has so many characters, mostly outside links, and sentences.
PROSE_CHARS, PROSE_LINKS = 140, 0.3
TAGS = ["p", "div", "li", "ul", "ol", "h1", "h2", "h3", "section", "article", "main", "nav", "aside", "header", "footer", "form", "tr", "blockquote", "body"]

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


class Page:
    """Block elements of a page: tag, parent, hashed tokens, and the segments of text in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.main = ["html"], [-1], [()], [0]
        self.tagged = False
        self.links, self.inline = [0], [0]  # characters in links, inline elements
        self.segments: list[tuple[int, str]] = []
        stack, piece, in_link, end, at = [0], [], 0, len(source), 0

        def flush():
            if piece:
                text = " ".join(html.unescape("".join(piece)).split())
                piece.clear()
                if text:
                    self.segments.append((stack[-1], text))

        while at < end:
            m = _TAG.search(source, at)
            text = source[at:m.start() if m else end]
            if text:
                piece.append(text)
                if in_link:
                    self.links[stack[-1]] += len(text)
            if not m:
                break
            at = m.end()
            close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            self.tagged = True
            if name in _END:
                piece.append(" ")
                if not close and not attrs.endswith("/"):
                    stop = _END[name].search(source, at)
                    at = stop.end() if stop else end
                continue
            if name == "head" and not close:
                stop = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I).search(source, at)
                at = stop.end() if stop else at
                continue
            if name not in BLOCKS:
                if name == "a":
                    in_link = 0 if close else 1
                if name in SPACED:
                    piece.append(" ")
                self.inline[stack[-1]] += not close
                continue
            flush()
            in_link = 0
            if name == "html" or name == "hr":
                continue
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if self.tag[stack[-1]] == "p" and len(stack) > 1:
                stack.pop()
            if name in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in CLOSES[name]:
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in SCOPES:
                        break
            tokens, main = (), 0
            if attrs and "=" in attrs:
                for kind, *value in _ATTR.findall(attrs):
                    if kind == "data-main":
                        main = 1
                    else:
                        tokens += tuple(crc32(t.encode()) % TOKENS for t in _TOKEN.findall("".join(value).lower()))
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.tokens.append(tokens)
            self.main.append(main)
            self.links.append(0)
            self.inline.append(0)
            stack.append(len(self.tag) - 1)
        flush()


_TAG_ID = {t: i for i, t in enumerate(TAGS)}
_SHELL = frozenset(("nav", "aside", "header", "footer", "form"))
_BODY = frozenset(("article", "main"))


def features(page: Page, meaning: np.ndarray) -> np.ndarray:
    """One row for each element; ``meaning`` has a log-odds for each token, 0 where it is unknown."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, stops, order = np.zeros(n), np.zeros(n), np.zeros(n)
    seen = 0
    for node, text in page.segments:
        own[node] += len(text)
        stops[node] += text.count(".") + text.count(",")
        order[node] = order[node] or seen
        seen += len(text)
    linked, inline = np.array(page.links, float), np.array(page.inline, float)
    depth, shell, body, least, most, bad_above, good_above = (np.zeros(n) for _ in range(7))
    text, links, stop, size, blocks = own.copy(), linked.copy(), stops.copy(), np.ones(n), (own > 0).astype(float)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        text[p] += text[i]
        links[p] += links[i]
        stop[p] += stop[i]
        size[p] += size[i]
        blocks[p] += blocks[i]
    count, same, index, before, after = (np.zeros(n) for _ in range(5))
    last: dict[int, int] = {}
    children: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        shell[i] = shell[p] + (page.tag[p] in _SHELL)
        body[i] = body[p] + (page.tag[p] in _BODY)
        if page.tokens[i]:
            said = meaning[list(page.tokens[i])]
            least[i], most[i] = min(0.0, said.min()), max(0.0, said.max())
        bad_above[i] = min(bad_above[p], least[p])
        good_above[i] = max(good_above[p], most[p])
        index[i] = count[p]
        count[p] += 1
        key = (p, page.tag[i])
        children[key] = children.get(key, 0) + 1
        if p in last:
            before[i] = text[last[p]]
            after[last[p]] = text[i]
        last[p] = i
    for i in range(1, n):
        same[i] = children[(page.parent[i], page.tag[i])]
    total = max(1.0, text[0])
    up = np.maximum(parent, 0)
    hot = np.zeros((n, len(TAGS)))
    for i, t in enumerate(page.tag):
        k = _TAG_ID.get(t)
        if k is not None:
            hot[i, k] = 1
    log = np.log1p
    return np.column_stack([
        hot, least, most, bad_above, good_above, np.full(n, any(t in _BODY for t in page.tag)), shell, body, depth, log(text), log(own), links / np.maximum(1, text), log(links),
        log(size), log(text / size), log(stop), stop / np.maximum(1, text), blocks / size, log(inline), text / total, order / total,
        np.arange(n) / n, index, log(count), log(same), log(count[up]), log(before), log(after), text / np.maximum(1, text[up]), log(text[up]),
        links[up] / np.maximum(1, text[up])])


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """For each node whether its own text is main: the best consistent choice of states.

    Every node votes with its log-odds, bounded so that no single one decides; text is what tells, so containers without
    text of their own vote only as the whole of their subtree.
    """
    n, parent = len(page.tag), page.parent
    vote = np.clip(odds, -6, 6)
    whole = vote.copy()  # of the subtree, if it is main; the negative if it is boilerplate
    for i in range(n - 1, 0, -1):
        whole[parent[i]] += whole[i]
    own = np.zeros(n, bool)
    for node, _ in page.segments:
        own[node] = True
    mixed = np.where(own, np.abs(vote), 0.0)
    state = np.zeros(n, np.int8)  # 0 mixed, 1 main, -1 boilerplate
    for i in range(n - 1, -1, -1):
        best, state[i] = mixed[i] - SWITCH, 0
        if abs(whole[i]) >= best:
            best, state[i] = abs(whole[i]), 1 if whole[i] > 0 else -1
        if i:
            mixed[parent[i]] += best
    main = np.zeros(n, bool)
    for i in range(n):
        if i and state[parent[i]]:
            state[i] = state[parent[i]]
        main[i] = state[i] == 1 or (state[i] == 0 and vote[i] > 0)
    return main


class Model:
    """What attribute tokens mean, trees for pages that have such tokens, and trees for pages that have none."""

    def __init__(self, meaning: np.ndarray, known: boosting.Trees, unknown: boosting.Trees):
        self.meaning, self.known, self.unknown = meaning, known, unknown

    def log_odds(self, pages: list[Page]) -> list[np.ndarray]:
        """For the elements of each page."""
        xs = [features(p, self.meaning) for p in pages]
        out = [np.zeros(0)] * len(pages)
        for trees, wanted in ((self.known, True), (self.unknown, False)):
            some = [i for i, p in enumerate(pages) if any(self.meaning[t] for tokens in p.tokens for t in tokens) == wanted]
            if some:
                odds = np.split(trees.log_odds(np.concatenate([xs[i] for i in some])), np.cumsum([len(xs[i]) for i in some])[:-1])
                for i, o in zip(some, odds):
                    out[i] = o
        return out


@cache
def model() -> Model:
    """Trained once in the driver on generated pages; of fixed size."""
    generator, rng = Generator(11), random.Random(12)
    pages = [Page(generator.page()) for _ in range(2 * TRAIN_PAGES)]
    meaning, truth = _meaning(pages[:TRAIN_PAGES]), [_truth(p) for p in pages]
    known = boosting.fit(np.concatenate([features(p, meaning) for p in pages]), np.concatenate(truth))
    for page in pages:
        page.tokens = [()] * len(page.tokens)
    unknown = boosting.fit(np.concatenate([features(p, meaning) for p in pages]), np.concatenate(truth))
    return Model(meaning, known, unknown)


def _meaning(pages: list[Page]) -> np.ndarray:
    """For each token the log-odds that an element which has it is main text, against the share of all; shrunk where it is rare."""
    good, seen = np.zeros(TOKENS), np.zeros(TOKENS)
    share, total = 0.0, 0
    for page in pages:
        truth = _truth(page)
        share, total = share + truth.sum(), total + len(truth)
        for tokens, y in zip(page.tokens, truth):
            for t in set(tokens):
                good[t] += y
                seen[t] += 1
    prior = share / total
    return np.log((good + prior) / (seen - good + 1 - prior)) - np.log(prior / (1 - prior))


def _truth(page: Page) -> np.ndarray:
    """1 for elements with main text of their own, and for containers most of whose text is main."""
    n = len(page.tag)
    total, good = np.zeros(n), np.zeros(n)
    for node, text in page.segments:
        total[node] += len(text)
        good[node] += len(text) * page.main[node]
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
        good[page.parent[i]] += good[i]
    return (good > 0.9 * np.maximum(total, 1)).astype(float)


def _prose(page: Page, odds: np.ndarray) -> np.ndarray:
    """Where decoding left no text: the elements of the likeliest subtree that reads like prose, if there is one."""
    n, parent = len(page.tag), page.parent
    main = np.zeros(n, bool)
    if not page.tagged:
        main[0] = True
        return main
    text, links, stops = np.zeros(n), np.array(page.links, float), np.zeros(n)
    weight = np.zeros(n)
    shell = np.zeros(n, bool)
    for node, piece in page.segments:
        text[node] += len(piece)
        stops[node] += piece.count(". ") + piece.count(", ")
        weight[node] += len(piece) * np.clip(odds[node] + 4, -4, 8)
    for i in range(1, n):
        shell[i] = shell[parent[i]] or page.tag[i] in _SHELL
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p], links[p], stops[p], weight[p] = text[p] + text[i], links[p] + links[i], stops[p] + stops[i], weight[p] + weight[i]
    fit = (text >= PROSE_CHARS) & (links <= PROSE_LINKS * text) & (stops >= 2) & ~shell
    if fit.any():
        best = int(np.argmax(np.where(fit, weight, -np.inf)))
        for i in range(best, n):
            main[i] = i == best or (main[parent[i]] and page.tag[i] not in _SHELL)
    return main


def main_texts(sources: list[str], trees: Model) -> list[str]:
    out: list[str] = []
    pages: list[Page] = []

    def settle():
        for page, odds in zip(pages, trees.log_odds(pages)):
            main = decode(page, odds)
            if not any(main[node] for node, _ in page.segments):
                main = _prose(page, odds)
            out.append("\n\n".join(text for node, text in page.segments if main[node]))
        pages.clear()

    held = 0
    for s in sources:
        pages.append(Page(s))
        held += len(pages[-1].tag)
        if held >= CHUNK_NODES:
            settle()
            held = 0
    settle()
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    trees = pages.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts([x or "" for x in batch.column("html").to_pylist()], trees.value)
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    return arrow_map(columns(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
