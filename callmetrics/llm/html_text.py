"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between block-level tags, with the tags and class and id words of the
elements around them. Each block gets binary features of its ancestors and its text. The field has a weight for each
feature, for each pair of neighbouring labels and for the first label; it is trained by exact likelihood (forward and
backward sums over padded pages) on labelled pages, and a page is decoded by Viterbi. The labelled pages are invented
here from layouts with menus, headers, footers, side columns, notices, adverts, forms and reader comments around and
inside articles; :func:`train` takes any others.

Text: character references are decoded, white space inside a block becomes one space, blocks labelled as main text
are joined in page order by two line ends. Scripts, styles and the head are never text.

Defined results: null and empty pages have an empty text; broken markup is read as far as it goes (an element that is
never closed lasts until an ancestor is closed, a cut tag at the end is dropped); pages of any length are read whole;
repeated rows give repeated rows; an empty table gives none; other columns pass through as they are, save that columns
named ``main_text`` or ``blocks`` are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "button", "label", "option", "select", "textarea"}
#: What an opening tag closes if it is the innermost open block.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAME_WORD = re.compile(r"[A-Za-z]+")
#: Elements that say by their tag what they hold.
LANDMARKS = frozenset("address article aside dialog fieldset footer form header main menu nav".split())


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    linked: int
    near: frozenset[str] = frozenset()  # tag and names of the innermost element that says what it holds
    marks: tuple[str, ...] = ()  # the elements that say so by their tag, outermost first


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.silent = self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tags = tuple(tag for tag, _ in self.open if tag in BLOCK_TAGS)
            near = next((frozenset((tag, *names)) for tag, names in reversed(self.open) if names or tag in LANDMARKS), frozenset())
            marks = tuple(tag for tag in tags if tag in LANDMARKS)
            self.blocks.append(Block(text, tags, frozenset(n for _, names in self.open for n in names), self.linked, near, marks))
        self.parts, self.linked = [], 0

    def _pop(self, count: int) -> None:
        for tag, _ in self.open[len(self.open) - count :]:
            self.silent -= tag in SILENT_TAGS
            self.links -= tag == "a"
        del self.open[len(self.open) - count :]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "body" and self.silent:  # a head that was never closed ends here
            self._pop(len(self.open))
        if tag in BLOCK_TAGS:
            self.flush()
            inner = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in BLOCK_TAGS), None)
            if inner is not None and ((self.open[inner][0] == "p" and tag in CLOSES_P) or self.open[inner][0] in SIBLINGS.get(tag, ())):
                self._pop(len(self.open) - inner)
        if tag in VOID_TAGS:
            return
        names = tuple(w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in NAME_WORD.findall(v)) if attrs else ()
        self.open.append((tag, names))
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in BLOCK_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(len(self.open) - i)
                return
            if tag not in BLOCK_TAGS and self.open[i][0] in BLOCK_TAGS:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list[Block]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


TALK = {w: k for k, ws in {"legal": "cookie cookies consent privacy copyright terms rights", "act": "subscribe login register search newsletter share follow submit", "talk": "comment comments reply replies said posted"}.items() for w in ws.split()}


def features(block: Block) -> list[str]:
    """Names of the binary features of a block."""
    n = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    found = [f"leaf={block.tags[-1] if block.tags else ''}", f"words={min(n.bit_length(), 7)}", f"links={0 if share < 0.05 else 1 if share < 0.5 else 2}"]
    found += {f"in={t}" for t in block.tags[:-1]} | {f"name={w}" for w in block.names} | {f"near={w}" for w in block.near}
    # what an element is for depends on what it is in: a header in an article is not the site's
    found += [f"within={'>'.join(block.marks[-2:])}", f"within={block.marks[-1] if block.marks else ''}:{found[2]}"]
    if not block.near:
        found += [f"bare:{found[0]}", f"bare:{found[1]}", f"bare:{found[2]}"]
    last = block.text[-1]
    found.append("ends=" + ("stop" if last in ".!?…\"'" else "word" if last.isalnum() else "other"))
    if block.text[0] in "©℗®":
        found.append("sign")
    if n <= 30:
        found += {f"says={TALK[w]}" for w in NAME_WORD.findall(block.text.lower()) if w in TALK}
    return found


@dataclass(frozen=True)
class Model:
    """Log-odds of the main-text label by feature, scores of neighbouring labels and of the first label."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    first: tuple[float, float]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labelling of a page's blocks."""
        weight = self.weights.get
        (s00, s01), (s10, s11) = self.step
        no, yes = self.first
        back: list[tuple[bool, bool]] = []
        for at, block in enumerate(blocks):
            gain = sum([weight(f, 0.0) for f in features(block)], weight("bias", 0.0))
            if at:
                from_no, from_yes = yes + s10 > no + s00, yes + s11 >= no + s01
                no, yes = max(no + s00, yes + s10), max(no + s01, yes + s11)
                back.append((from_no, from_yes))
            yes += gain
        labels = [yes >= no] if blocks else []
        for from_no, from_yes in reversed(back):
            labels.append(from_yes if labels[-1] else from_no)
        return labels[::-1]


def likelihood(x: np.ndarray, y: np.ndarray, here: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of padded pages and its gradient. ``x`` has pages, blocks and features, ``y`` the
    labels, ``here`` what is no padding; ``theta`` holds feature weights, four steps and two first labels."""
    pages, long, n = x.shape
    flat = x.reshape(-1, n)
    gold = np.zeros_like(theta)
    gold[:n] = flat[(y == 1).ravel() & here.ravel()].sum(0)
    follow = here[:, 1:]
    np.add.at(gold, (n + 2 * y[:, :-1] + y[:, 1:])[follow], 1)
    np.add.at(gold, n + 4 + y[:, 0], 1)

    def logadd(a: np.ndarray) -> np.ndarray:
        top = a.max(-1)
        return top + np.log(np.exp(a - top[..., None]).sum(-1))

    score = np.zeros((pages, long, 2))
    score[:, :, 1] = (flat @ theta[:n]).reshape(pages, long)
    step, first = theta[n : n + 4].reshape(2, 2), theta[-2:]
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0] + first
    for t in range(1, long):
        new = logadd((ahead[:, t - 1, :, None] + step).swapaxes(1, 2)) + score[:, t]
        ahead[:, t] = np.where(here[:, t, None], new, ahead[:, t - 1])
    for t in range(long - 2, -1, -1):
        new = logadd(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :])
        behind[:, t] = np.where(here[:, t + 1, None], new, 0)
    total = logadd(ahead[:, -1])
    expect = np.zeros_like(theta)
    each = np.exp(ahead + behind - total[:, None, None]) * here[..., None]
    expect[:n] = flat.T @ each[:, :, 1].ravel()
    pair = ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
    expect[n : n + 4] = (np.exp(pair) * follow[..., None, None]).sum((0, 1)).ravel()
    expect[-2:] = each[:, 0].sum(0)
    return float(total.sum() - gold @ theta) / pages, (expect - gold) / pages


#: Pages of like length that are padded to the longest of them.
PADDED_TOGETHER = 100


def _padded(pages: list[tuple[list[Block], list[bool]]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and what is no padding, of pages as :func:`likelihood` takes them; feature 0 is the bias."""
    long = max(len(b) for b, _ in pages)
    x = np.zeros((len(pages), long, len(index) + 1))
    y, here = np.zeros((len(pages), long), dtype=int), np.zeros((len(pages), long), dtype=bool)
    for p, (blocks, labels) in enumerate(pages):
        for t, block in enumerate(blocks):
            x[p, t, [0, *(index[f] for f in features(block) if f in index)]] = 1
        y[p, : len(labels)], here[p, : len(labels)] = labels, True
    return x, y, here


def train(pages: Iterable[tuple[list[Block], list[bool]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3, least: int = 3) -> Model:
    """Fit the field to labelled pages by gradient steps (Adam) on the exact penalised likelihood."""
    pages = [(b, y) for b, y in pages if b]
    names: dict[str, int] = {}
    for blocks, _ in pages:
        for f in (f for b in blocks for f in features(b)):
            names[f] = names.get(f, 0) + 1
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, n in names.items() if n >= least))}
    groups = [_padded(pages[at : at + PADDED_TOGETHER], index) for pages in [sorted(pages, key=lambda p: len(p[0]))] for at in range(0, len(pages), PADDED_TOGETHER)]
    theta = np.zeros(len(index) + 7)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        slope = sum(likelihood(*group, theta)[1] * len(group[0]) for group in groups) / len(pages) + decay * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta -= rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    weights = {"bias": float(theta[0])} | {f: float(theta[i]) for f, i in index.items()}
    step = theta[len(index) + 1 : len(index) + 5]
    return Model(weights, ((float(step[0]), float(step[1])), (float(step[2]), float(step[3]))), (float(theta[-2]), float(theta[-1])))


# -- labelled pages -------------------------------------------------------------------------------------------------


class _Writer:
    """Writes one invented page; text of main blocks is marked by a private-use character that :func:`labelled` removes."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeiourstnlmdpchgé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 80) -> str:
        text = self.words(low, high).capitalize()
        style = self.r.random()
        if style < 0.08:
            return " ".join(w + self.r.choice(("###", "***", "$$$", "%%%", "&amp;&amp;")) for w in text.split())
        if style < 0.16:
            return " ".join(w.upper() + "!!" for w in text.split())
        if style < 0.2:
            return "&copy; " + text
        if style < 0.32:
            return text.replace(" ", self.r.choice((" cookie ", " privacy ", " said ", " replies ", " comments ")), 1) + self.r.choice((" subscribe", " comment", " rights", " share", " posted.", " reply.", " said.", " newsletter."))
        return text + self.r.choice((".", ".", ".", "", "?", ":"))

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{i}">{self.words(1, 3)}</a></{item}>' for i in range(n))

    def box(self, tag: str, names: tuple[str, ...], inner: str, named: float = 0.9) -> str:
        """An element that shows what it is by its tag, by a class or id, or both."""
        r = self.r
        name = r.choice(names)
        if tag != "div" and r.random() < 0.6:
            return f"<{tag}>{inner}</{tag}>" if r.random() < 0.6 else f'<{tag} class="{name}">{inner}</{tag}>'
        if r.random() < named:
            return f'<{r.choice(("div", "div", "section"))} {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", "-box", " wide", "_wrap"))}">{inner}</div>'.replace("</div>", "</div>")
        return f"<div>{inner}</div>"

    def noise(self, kind: str) -> str:
        r, w = self.r, self.words
        p = lambda low, high: f"<p>{w(low, high).capitalize()}.</p>"
        if kind == "nav":
            return self.box("nav", ("menu", "navbar", "navigation", "breadcrumb", "nav"), f"<ul>{self.links(r.randint(2, 9))}</ul>" if r.random() < 0.8 else self.links(r.randint(2, 6), "span"))
        if kind == "header":
            return self.box("header", ("header", "masthead", "logo", "topbar", "banner"), f"<{r.choice(('h1', 'div', 'p'))}><a href='/'>{w(1, 3)}</a></div>" + (p(2, 8) if r.random() < 0.5 else ""))
        if kind == "footer":
            return self.box("footer", ("footer", "copyright", "bottom", "colophon"), f"&copy; {w(1, 2)} &middot; {w(3, 12)}." + (f"<ul>{self.links(3)}</ul>" if r.random() < 0.3 else "") + (p(3, 15) if r.random() < 0.3 else ""))
        if kind == "side":
            return self.box("aside", ("sidebar", "related", "widget", "popular", "recommended", "side"), f"<h3>{w(1, 4)}</h3>" + (f"<ul>{self.links(r.randint(2, 6))}</ul>" if r.random() < 0.6 else p(5, 40)))
        if kind == "ad":
            return self.box("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), w(3, 30).capitalize() + "." if r.random() < 0.6 else p(3, 30), 1)
        if kind == "notice":
            return self.box("div", ("cookie", "consent", "notice", "alert", "popup", "newsletter", "gdpr", "message"), f"{r.choice(('Cookie', 'Privacy', 'Subscribe', ''))} {w(4, 30)}. <button>{w(1, 2)}</button>", 1)
        if kind == "form":
            return f"<form{r.choice(('', ' class=search', ' id=login'))}><label>{w(1, 3)}</label><input name=q>{p(2, 10) if r.random() < 0.4 else ''}<select><option>{w(1, 2)}<option>{w(1, 2)}</select><textarea>{w(0, 5)}</textarea><button>{w(1, 2)}</button></form>"
        one = lambda: f'<{r.choice(("div", "li", "article", "p"))} class="{r.choice(("comment", "reply", "response", "user"))}">{r.choice(("", f"<b>{w(1, 2)}</b> said "))}{w(3, 60).capitalize()}.</div>'
        return self.box(r.choice(("div", "section")), ("comments", "discussion", "responses", "replies", "comment-list", "disqus"), (f"<h2>{r.choice(('Comments', w(1, 3)))}</h2>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 6))), 1)

    def main_block(self) -> str:
        r, m = self.r, self.MARK
        text = m + self.prose()
        return r.choice(
            (f"<p>{text}</p>",) * 8
            + (f"<h{r.randint(2, 4)}>{m}{r.choice(('Comments', 'Reply', 'Share', 'Privacy', 'Terms', 'Login'))}</h{r.randint(2, 4)}>", f"<p>{m}{self.words(1, 1)}</p>", f"<p>{text}\n", f"<p><b>{text}<br>", f"<h2>{m}{self.words(1, 8)}</h2>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{m}{self.prose(1, 20)}</li></ul>",
               f"<p>{text} <a href=x>{self.words(1, 3)}</a> {self.words(1, 9)}.</p>", f"<pre>{text}</pre>", f"<table><tr><td>{text}</td><td>{m}{self.words(1, 4)}</td></tr></table>", f"<figure><figcaption>{text}</figcaption></figure>")
        )

    def page(self) -> str:
        r = self.r
        brief = r.random() < 0.4  # one to three blocks, often of a few words and without a heading
        body = [f"<h1>{self.MARK}{self.words(1, 12).capitalize()}</h1>"] if r.random() < (0.25 if brief else 0.85) else []
        kind = r.random()
        bare = kind < 0.1  # an article that nothing marks but what it says
        if bare:
            brief, body = False, [f"<h1>{self.MARK}{self.words(1, 12).capitalize()}</h1>"]
        elif kind < 0.55 and body and r.random() < 0.25:  # its own header, perhaps with a line below the title
            body = [f"<header>{body[0]}{f'<p>{self.MARK}{self.prose(1, 12)}</p>' if r.random() < 0.4 else ''}</header>"]
        for _ in range(r.choice((1, 1, 2, 3)) if brief else r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
            body.append(f"<p>{self.MARK}{self.prose(1, 8)}</p>" if brief and r.random() < 0.6 else self.main_block())
            if r.random() < 0.06 and not bare:  # a list of links that belongs to the text
                body.append("<ul>" + "".join(f'<li><a href="/{i}">{self.MARK}{self.words(1, 6).capitalize()}</a></li>' for i in range(r.randint(1, 6))) + "</ul>")
            if r.random() < (0.2 if brief else 0.08):
                body.append(self.noise(r.choice(("ad", "side", "notice", "form", "nav"))))
        if r.random() < 0.15:
            body.append(self.noise("comments"))
        if bare:
            body.insert(1, f"<p>{self.MARK}{self.prose(15, 90)}</p>")
        inner = "".join(body)
        names = ("content", "post", "entry", "story", "body", "text", "article", "main")
        if bare:
            main = f"<div>{inner}</div>" if r.random() < 0.7 else f"<div><div>{inner}</div></div>" if r.random() < 0.6 else inner
        elif kind < 0.64:
            main = f"<article>{inner}</article>" if r.random() < 0.7 else f'<main><article class="{r.choice(names)}">{inner}</article></main>'
        elif kind < 0.78:
            main = f"<main>{inner}</main>"
        else:
            main = f'<div {r.choice(("class", "id"))}="{r.choice(names)}{r.choice(("", "-content", "-body"))}">{inner}</div>'
        before = [self.noise(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.45]
        after = [self.noise(k) for k in ("comments", "side", "ad", "form", "nav", "notice", "footer") if r.random() < 0.45]
        if r.random() < 0.3:
            r.shuffle(before)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{''.join(before)}{main}{''.join(after)}" + r.choice(("</body></html>", ""))


def labelled(pages: int = 900, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """Invented pages as blocks with labels (True: main text)."""
    made = []
    for i in range(pages):
        blocks = leaf_blocks(_Writer(seed * 1_000_003 + i).page())
        labels = [_Writer.MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(_Writer.MARK, "") or "-"
        made.append((blocks, labels))
    return made


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled())


def main_text(html: str | None, model: Model) -> str:
    blocks = leaf_blocks(html)
    return "\n\n".join(b.text for b, main in zip(blocks, model.decode(blocks), strict=True) if main)


def extract(frame: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """``frame`` without ``html``, with ``main_text`` and ``blocks`` (leaf blocks of the page, main text or not)."""
    shared = frame.sparkSession.sparkContext.broadcast(model or default_model())
    rest = [c for c in frame.columns if c not in (html, "main_text", "blocks")]
    schema = T.StructType([*[frame.schema[c] for c in rest], T.StructField("main_text", T.StringType()), T.StructField("blocks", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared.value
        for batch in batches:
            texts, counts = [], []
            for page in batch[html]:
                blocks = leaf_blocks(page)
                texts.append("\n\n".join(b.text for b, main in zip(blocks, field.decode(blocks), strict=True) if main))
                counts.append(len(blocks))
            yield batch[rest].assign(main_text=texts, blocks=counts)

    return frame.select(*rest, html).mapInPandas(run, schema)
