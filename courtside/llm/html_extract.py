"""Main text of web pages: a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector of its tag path (tags, classes, ids and
roles of what encloses it, hashed), its hashed words and a few counts. A bidirectional LSTM in numpy reads
the whole sequence and gives every block a probability of being main text, so a block is judged with the
entire page as its context. Pages of similar length are labelled together.

The labeller is trained on generated pages of known structure and on a bounded number of the corpus's own
pages, labelled by their markup. A last exact check takes out what lies inside elements that are never
main text by definition (navigation, forms, scripts and the like).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import map_batches, texts_of

# Fixed values of HTML: elements without content, elements that begin a block, elements whose text is never shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
 h5 h6 header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split())
UNSEEN = set("head script style noscript template title svg iframe object".split())
#: What may stand in a head; anything else ends it, with or without its end tag.
IN_HEAD = set("html head title base link meta script style noscript template basefont bgsound noframes".split())
NEVER = UNSEEN | set("nav footer aside form select button textarea".split())

PATH, WORDS, COUNTS = 128, 32, 6
WIDTH = PATH + WORDS + COUNTS
MAIN = {"article", "main"}
#: Words of class names and ids that mark a corpus page's block as not main, for the training labels alone.
ASIDE = set("ad ads advert advertisement banner comment comments cookie footer header menu nav newsletter notice promo related share sidebar".split())


@dataclass
class Block:
    text: str
    path: list[tuple[str, frozenset[str]]]
    linked: int


class _Leaves(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset[str]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.unseen = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, list(self.open), self.linked))
            self.parts, self.linked = [], 0

    def _end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.open.pop()
            self.unseen -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCK or tag in UNSEEN:
            self.flush()
            if tag == "p" or tag in ("li", "option", "td", "tr", "dt", "dd"):
                self._end_open(tag)
            elif self.open and any(t == "p" for t, _ in self.open):
                self._end_open("p")
        names = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in re.findall("[a-z]+", v.lower()))
        self.open.append((tag, names))
        self.unseen += tag in UNSEEN

    def _end_open(self, tag: str) -> None:
        """Closes an element that its own kind, or the end of a paragraph, closes."""
        stop = {"p": set(), "li": {"ul", "ol"}, "option": {"select"}, "td": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}[tag]
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.unseen -= sum(t in UNSEEN for t, _ in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in stop | UNSEEN or (tag == "p" and self.open[i][0] in BLOCK):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in BLOCK or tag in UNSEEN:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.unseen -= sum(t in UNSEEN for t, _ in self.open[i:])
                del self.open[i:]
                return
            if tag not in BLOCK | UNSEEN and self.open[i][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if self.unseen:
            return
        self.parts.append(data)
        if any(t == "a" for t, _ in self.open):
            self.linked += len(data)


def leaf_blocks(html: str) -> list[Block]:
    """The page's blocks with text, in page order; white space collapsed, references decoded."""
    parser = _Leaves()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


_hashed: dict[str, int] = {}


def _slot(token: str, size: int) -> int:
    found = _hashed.get(token)
    if found is None:
        found = crc32(token.encode())
        if len(_hashed) < 200_000:
            _hashed[token] = found
    return found % size


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for i, b in enumerate(blocks):
        row = out[i]
        for tag, names in b.path:
            row[_slot("<" + tag, PATH)] = 1
            for name in names:
                row[_slot("." + name, PATH)] = 1
        text_words = b.text.split(" ")
        slots = np.bincount([_slot(w, WORDS) for w in text_words], minlength=WORDS)
        row[PATH:PATH + WORDS] = 0.1 * np.log1p(slots)
        n = len(b.text)
        row[PATH + WORDS:] = (np.log1p(n) / 5, min(1.0, b.linked / n), np.log1p(len(text_words)) / 4,
                              min(1.0, 8 * sum(map(b.text.count, ".,;:")) / n), b.text[-1] in ".!?", 1.0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Labeller:
    """Weights of both directions (inputs, states, additions) and of the output."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int, hidden: int = 16) -> Labeller:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.1, (WIDTH, 4 * hidden)).astype(np.float32)
            w["h" + d] = rng.normal(0, 0.1, (hidden, 4 * hidden)).astype(np.float32)
            w["a" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        w["out"], w["bias"] = rng.normal(0, 0.1, 2 * hidden).astype(np.float32), np.zeros(1, np.float32)
        return cls(w)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction for x (steps, pages, WIDTH); padding stands at the end."""
        steps, pages, _ = x.shape
        n = self.w["h" + d].shape[0]
        at = (x.reshape(-1, WIDTH) @ self.w["x" + d] + self.w["a" + d]).reshape(steps, pages, 4 * n)
        h, c, out, kept = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32), np.empty((steps, pages, n), np.float32), []
        for t in range(steps):
            z = at[t] + h @ self.w["h" + d]
            gates = _sigmoid(z[:, :3 * n])
            i, f, o, g = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], np.tanh(z[:, 3 * n:])
            before, h0 = c, h
            c = f * c + i * g
            s = np.tanh(c)
            out[t] = h = o * s
            if keep:
                kept.append((i, f, o, g, before, s, h0))
        return out, kept

    @staticmethod
    def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Every page's steps in the other order, its padding left at the end."""
        at = np.arange(len(x))[:, None]
        rows = np.where(at < lengths, lengths - 1 - at, at)
        return np.take_along_axis(x, rows[:, :, None], 0)

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        back = self._turned(x, lengths)
        (hf, kf), (hb, kb) = self._run(x, "f", keep), self._run(back, "b", keep)
        both = np.concatenate([hf, self._turned(hb, lengths)], axis=2)
        return _sigmoid(both @ self.w["out"] + self.w["bias"][0]), (x, back, kf, kb, both)

    def gradient(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, back, kf, kb, both) = self.forward(x, lengths, True)
        valid = np.arange(len(x))[:, None] < lengths
        error = np.where(valid, p - y, 0).astype(np.float32) / valid.sum()
        g = {"out": np.einsum("tb,tbh->h", error, both), "bias": np.array([error.sum()], np.float32)}
        d, n = error[:, :, None] * self.w["out"], len(self.w["out"]) // 2
        for name, inputs, kept, dh_out in (("f", x, kf, d[:, :, :n]), ("b", back, kb, self._turned(d[:, :, n:], lengths))):
            dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
            dz = np.empty((*dh_out.shape[:2], 4 * n), np.float32)
            dw = np.zeros_like(self.w["h" + name])
            for t in range(len(x) - 1, -1, -1):
                i, f, o, c_in, before, s, h0 = kept[t]
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - s * s)
                z = np.hstack([dc * c_in * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - c_in * c_in)])
                dz[t] = z
                dw += h0.T @ z
                dh, dc = z @ self.w["h" + name].T, dc * f
            flat = dz.reshape(-1, 4 * n)
            g["x" + name], g["h" + name], g["a" + name] = inputs.reshape(-1, WIDTH).T @ flat, dw, flat.sum(axis=0)
        return g

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Probability of every block; pages of similar length share a batch of at most ``cells`` blocks, or one page."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= cells:
                end += 1
            some = order[at:end]
            lengths = np.array([len(pages[i]) for i in some])
            x = np.zeros((lengths.max(), len(some), WIDTH), np.float32)
            for k, i in enumerate(some):
                x[:lengths[k], k] = pages[i]
            p, _ = self.forward(x, lengths)
            for k, i in enumerate(some):
                out[i] = p[:lengths[k], k]
            at = end
        return out


def generated_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of random structure and the label of each of its blocks."""
    syllables = ["the", "an", "er", "tion", "re", "ing", "st", "ha", "und", "qu", "el", "os", "ment", "eau", "ge", "ver", "ß", "é"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    labels: list[bool] = []

    def block(html: str, main: bool) -> str:
        labels.append(main)
        return html

    def links(n: int, main: bool = False) -> str:
        return "<ul>" + "".join(block(f'<li><a href="/{word()}">{line(1, 3)}</a></li>', main) for _ in range(n)) + "</ul>"

    def side() -> str:
        tag, name = [("nav", ""), ("header", "header"), ("aside", "sidebar"), ("div", "menu"), ("div", "ad"), ("div", "advert"), ("div", "cookie-notice"),
                     ("div", "notice"), ("div", "sidebar"), ("section", "related"), ("form", "newsletter"), ("div", "banner"), ("div", "share"), ("div", "promo")][rng.integers(14)]
        mark = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        if rng.random() < 0.5 and tag != "form":
            return f"<{tag}{mark}>" + links(rng.integers(2, 7)) + f"</{tag}>"
        body = "".join(block(f"<p>{line(2, 14)}.</p>", False) for _ in range(rng.integers(1, 3))) if rng.random() < 0.5 else block(line(3, 14) + ".", False)
        return f"<{tag}{mark}>{body}" + ("<input name=q>" if tag == "form" else "") + f"</{tag}>"

    def comments() -> str:
        name = rng.choice(["comments", "comment", "comment-list"])
        return f'<section {rng.choice(["class", "id"])}="{name}">' + "".join(block(f'<div class="comment"><p>{line(3, 30)}.</p></div>', False) for _ in range(rng.integers(1, 5))) + "</section>"

    def body() -> str:
        out = [block(f"<h1>{line(2, 8)}.</h1>", True)] if rng.random() < 0.8 else []
        for _ in range(rng.integers(1, 10) if rng.random() < 0.96 else rng.integers(60, 200)):
            kind = rng.integers(12)
            if kind < 7:
                out.append(block(f"<p>{line(1, 60)}.</p>", True))
            elif kind == 7:
                out.append(block(f"<p><b>{line(2, 8)}.<br>", True))
            elif kind == 8:
                out.append(block(f"<{(h := rng.choice(['h2', 'h3']))}>{line(1, 6)}</{h}>", True))
            elif kind == 9:
                out.append("<ul>" + "".join(block(f"<li>{line(2, 12)}</li>", True) for _ in range(rng.integers(1, 4))) + "</ul>")
            elif kind == 10:
                out.append(block(f"<blockquote>{line(4, 20)}</blockquote>", True))
            elif rng.random() < 0.5:
                out.append(side())
        if rng.random() < 0.2:
            out.append(comments())
        return "".join(out)

    tag, mark = [("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'),
                 ("div", ' class="article-body"'), ("section", ' role="main"'), ("div", ' class="entry"')][rng.integers(9)]
    parts = ["<nav>" + links(rng.integers(3, 8)) + "</nav>"] if rng.random() < 0.7 else []
    parts += [side() for _ in range(rng.integers(0, 3))]
    parts.append(f"<{tag}{mark}>{body()}</{tag}>")
    if rng.random() < 0.3:
        parts.append(comments())
    parts += [side() for _ in range(rng.integers(0, 3))]
    if rng.random() < 0.8:
        parts.append(block(f"<footer>&copy; {word()}.example.org &middot; {line(2, 12)}.</footer>", False))
    return "<!DOCTYPE html><html><head><title>" + line(2, 6) + "</title><style>p{margin:0}</style></head><body>" + "".join(parts) + "</body></html>", labels


def markup_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels of a page that marks its article; None if it does not."""
    out = []
    for b in blocks:
        names = {n for _, more in b.path for n in more}
        out.append(any(t in MAIN for t, _ in b.path) and not names & ASIDE and not any(t in NEVER for t, _ in b.path))
    return out if any(out) else None


def train(pages: list[str], generated: int = 400, epochs: int = 8, seed: int = 5, stretch: int = 256) -> Labeller:
    """Fit on ``generated`` pages and on those of ``pages`` whose markup labels them, on every block of theirs; a page of more
    than ``stretch`` blocks is read in stretches of so many."""
    rng, examples = np.random.default_rng(seed), []
    for _ in range(generated):
        html, labels = generated_page(rng)
        examples.append((leaf_blocks(html), labels))
    for html in pages:
        blocks = leaf_blocks(html)
        if (labels := markup_labels(blocks)) is not None:
            examples.append((blocks, labels))
    data = [(vectors(b[at:at + stretch]), np.array(y[at:at + stretch], np.float32))
            for b, y in examples if len(b) == len(y) for at in range(0, len(b), stretch)]
    net = Labeller.fresh(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in net.w.items()}, {k: np.zeros_like(x) for k, x in net.w.items()}, 0
    for _ in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) + rng.integers(8))
        batches = [order[i:i + 16] for i in range(0, len(order), 16)]
        for k in rng.permutation(len(batches)):
            lengths = np.array([len(data[i][0]) for i in batches[k]])
            x, y = np.zeros((lengths.max(), len(lengths), WIDTH), np.float32), np.zeros((lengths.max(), len(lengths)), np.float32)
            for j, i in enumerate(batches[k]):
                x[:lengths[j], j], y[:lengths[j], j] = data[i]
            step += 1
            for name, g in net.gradient(x, lengths, y).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                net.w[name] -= (0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_text(blocks: list[Block], probability: np.ndarray) -> str:
    return "\n".join(b.text for b, p in zip(blocks, probability) if p >= 0.5 and not any(t in NEVER for t, _ in b.path))


def training_pages(pages: DataFrame, most: int) -> list[str]:
    """At most ``most`` different pages, whole, those with the smallest hashes.

    The hashes are chosen first, so that no task sends pages to the driver that are not among the chosen.
    """
    some = pages.where(F.col("html").isNotNull()).select("html", F.xxhash64("html").alias("h"))
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(most).collect()]
    if not least:
        return []
    chosen = some.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html"))
    return [r.html for r in sorted(chosen.collect(), key=lambda r: r.h)]


def extract(pages: DataFrame, sampled: int = 100, seed: int = 5) -> DataFrame:
    """``pages`` with ``text`` in the place of ``html``: the main text, its blocks joined by a line break, empty if there is none.

    NULL and empty pages give an empty text. Rows with NULL ids, repeated rows and other columns pass through. An empty
    table gives no rows; the labeller is then trained on generated pages alone.
    """
    net = train(training_pages(pages, sampled), seed=seed)
    rest = [f for f in pages.schema.fields if f.name not in ("html", "text")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [leaf_blocks(html) for html in texts_of(batch, "html")]
        sure = net.label([vectors(b) for b in found])
        texts = [main_text(b, p) for b, p in zip(found, sure)]
        return pa.record_batch([*(batch.column(f.name) for f in rest), pa.array(texts, pa.string())], [*(f.name for f in rest), "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return map_batches(pages.select(*(f.name for f in rest), "html"), run, schema + "text string")
