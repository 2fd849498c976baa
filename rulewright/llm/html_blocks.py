"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  Each block is a vector of its tag
path (tags, class and id words, hashed), of its words (hashed) and of a few
counts; a bidirectional LSTM in numpy reads the whole sequence and says for every
block whether it is main text.  The labeller is trained at the start of a run on
pages laid out at random in many markup habits with words of a bounded sample of
the corpus; its weights are a few hundred kilobytes and go to the tasks with the
code.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_hashes

#: Pages whose words the training pages are made of, at most: those with the smallest hashes of their ids.
SAMPLE, SAMPLE_WORDS = 200, 20_000
#: Blocks whose vectors are made together, and characters of pages labelled together.
TOGETHER, SLICE = 4_096, 2 << 20
PATH, WORDS, COUNTS = 384, 32, 12
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is no text of the page: in the first no tag but their end tag counts, the others hold elements.
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_HIDDEN = {"noscript", "template", "object", "svg", "math", "select", "audio", "video", "canvas"}
#: Start tags that can stand in a head; any other ends it.
_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template", "noframes", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
#: Elements deeper than this are not told apart, characters of a tag that names are sought in, and elements of a path that are looked at.
DEEPEST, ATTRS, OUTER, INNER = 200, 16_384, 16, 32
#: Elements that end the block before them.
_BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul label".split())
#: What a start tag ends, if it is open within the same container.
_ENDS = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_WALLS = {"table", "ul", "ol", "div", "article", "section", "td", "th", "body", "form", "nav", "aside", "main", "dl", "blockquote", "header", "footer"}


class _Tokens:
    """The tags of a page from left to right, each part of the page read once or twice whatever it holds."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.open_end = False  # no further tag has an end
        self.lenient = False  # quotes no longer hide the end of a tag
        self.gone: set[str] = set()  # quotes that do not come again

    def end_of_tag(self, at: int) -> int:
        """Place behind the tag that goes on at ``at``, -1 if it has no end."""
        page, first = self.page, -1
        k = at
        while not self.lenient:
            m = _STOP.search(page, k)
            if m is None:
                break
            k = m.end()
            if m[0] == ">":
                return k
            close = -1 if m[0] in self.gone else page.find(m[0], k)
            if close < 0:
                self.gone.add(m[0])
            else:
                k = close + 1
        else:
            first = page.find(">", at)
            return first + 1 if first >= 0 else -1
        # Read to the end of the page for nothing: that happens once.
        self.lenient = True
        first = page.find(">", at)
        return first + 1 if first >= 0 else -1

    def next(self, at: int) -> tuple[int, int, str, bool, str, str] | None:
        """Start, end, kind (tag, cdata, other), whether it is an end tag, name and attributes of what comes next."""
        page = self.page
        while not self.open_end:
            start = page.find("<", at)
            if start < 0:
                return None
            mark = page[start + 1 : start + 2]
            if mark in ("!", "?"):
                m = _COMMENT.match(page, start)
                if m:
                    return start, m.end(), "cdata" if m[0].startswith("<![CDATA[") else "other", False, "", m[0][9:-3]
                end = page.find(">", start)
                if end < 0:
                    self.open_end = True
                    return None
                return start, end + 1, "other", False, "", ""
            m = _TAG.match(page, start)
            if m:
                end = self.end_of_tag(m.end())
                if end < 0:
                    self.open_end = True
                    return None
                return start, end, "tag", bool(m[1]), m[2].lower(), page[m.end() : end - 1]
            at = start + 1
        return None


def blocks(page: str) -> Iterator[tuple[tuple, str, int]]:
    """The page's leaf blocks in order: tag path, text with single spaces, letters inside links.

    Character references are decoded; comments, declarations, scripts, styles and
    other unseen content are left out.  Unclosed and stray tags are tolerated; an
    unseen element without any end tag after it hides nothing, except one of raw text.
    Time and memory are in proportion to the page's length, whatever it holds; of a
    deep path the outermost and innermost elements are handed on.
    """
    stack: list[tuple[str, tuple]] = []
    open_names: dict[str, int] = {}
    skipped: dict[str, int] = {}
    text: list[str] = []
    linked, at, n, head, inside = 0, 0, len(page), False, -1
    tokens, end_places = _Tokens(page), {}

    def push(name: str, names: tuple) -> None:
        nonlocal inside
        if len(stack) >= DEEPEST:
            skipped[name] = skipped.get(name, 0) + 1
            return
        if inside < 0 and name in _HIDDEN:
            inside = len(stack)
        stack.append((name, names))
        open_names[name] = open_names.get(name, 0) + 1

    def pop_to(k: int) -> None:
        nonlocal inside
        for name, _ in stack[k:]:
            open_names[name] -= 1
        del stack[k:]
        skipped.clear()
        if inside >= k:
            inside = -1

    def ended(name: str) -> bool:
        """Whether an end tag of an unseen element is still to come."""
        if end_places.get(name, 0) is not None and end_places.get(name, -1) < at:
            m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            end_places[name] = m.start() if m else None
        return end_places[name] is not None

    def words(attrs: str) -> tuple:
        out: list = []
        for m in _ATTR.finditer(attrs[:ATTRS]):
            value = m[2] or m[3] or m[4] or ""
            name = m[1].lower()
            if name in ("class", "id", "role"):
                for x in value.split():
                    out += [x.lower(), *(y.lower() for y in _NAME.findall(x))]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                out.append("!hidden")
        return tuple(dict.fromkeys(out))

    def take() -> tuple | None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        letters = linked
        text.clear()
        linked = 0
        if whole and not head:
            path = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
            return tuple(path), whole, letters
        return None

    def add(raw: str) -> None:
        nonlocal linked
        if raw and inside < 0:
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if open_names.get("a"):
                linked += len(raw.strip())

    while at < n:
        token = tokens.next(at)
        if token is None:
            add(page[at:])
            break
        start, end, kind, closing, name, attrs = token
        add(page[at:start])
        at = end
        if kind != "tag":
            if kind == "cdata":
                add(attrs)
            continue
        if closing:
            if skipped.get(name):
                skipped[name] -= 1
                if inside < 0 and name in _BLOCK and (block := take()):
                    yield block
                continue
            found = -1
            if open_names.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        found = k
                        break
                    if stack[k][0] in _WALLS and name not in _WALLS and name not in _HIDDEN:
                        break
            if 0 <= found < inside:
                pop_to(inside)
            if inside < 0 and name in _BLOCK and (block := take()):
                yield block
            if found >= 0:
                pop_to(found)
            if name == "head":
                head = False
            continue
        if head and inside < 0 and name not in _HEAD:
            head = False
            kept = [x for x in stack if x[0] != "head"]
            pop_to(0)
            for x in kept:
                push(*x)
        if inside < 0 and name in _BLOCK:
            if block := take():
                yield block
            for k in range(len(stack) - 1, -1, -1):
                if name in _ENDS.get(stack[k][0], ()):
                    pop_to(k)
                    break
                if stack[k][0] in _WALLS:
                    break
            if name == "head":
                head = True
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
        elif name == "br":
            text.append(" ")
        elif name in _HIDDEN and (name in ("svg", "math") and attrs.endswith("/") or not ended(name)):
            pass
        elif name not in _VOID and (name in _HIDDEN - {"svg", "math"} or not attrs.endswith("/")):
            push(name, words(attrs))
    if block := take():
        yield block


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % PATH


def path_slots(path: tuple) -> tuple:
    """Slots of a tag path: tags and name words of every element, the innermost ones apart."""
    out = set()
    for k, (tag, names) in enumerate(path):
        near = len(path) - k <= 2
        out.add(_slot(f"t:{tag}"))
        if near:
            out.add(_slot(f"n:{tag}:{len(path) - k}"))
        for x in names:
            out.add(_slot(f"c:{x}"))
            if len(x) > 4:
                out.add(_slot(f"p:{x[:4]}"))
    return tuple(out)


def beside(found: list[tuple[tuple, str, int]]) -> np.ndarray:
    """For each block of a page: whether the block before it, and the one after it, has the same path."""
    same = np.array([False, *(a[0] == b[0] for a, b in zip(found, found[1:])), False], bool)
    return np.stack([same[: len(found)], same[1 : len(found) + 1]], 1)


def vectors(found: list[tuple[tuple, str, int]], known: dict, near: np.ndarray | None = None) -> np.ndarray:
    """One row for each block: path slots, hashed words and counts; ``near`` is given where blocks are not one whole page."""
    n = len(found)
    x = np.zeros((n, PATH + WORDS + COUNTS), np.float32)
    for k, (path, _, _) in enumerate(found):
        slots = known.get(path)
        if slots is None:
            if len(known) > 20_000:
                known.clear()
            slots = known[path] = list(path_slots(path))
        x[k, slots] = 1
    texts = [b[1] for b in found]
    for i, j, hashes, at in word_hashes(pa.array(texts, pa.string())):
        counts = np.diff(at)
        rows = np.repeat(np.arange(j - i), counts)
        bag = np.bincount(rows * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=(j - i) * WORDS).reshape(j - i, WORDS)
        x[i:j, PATH : PATH + WORDS] = bag / np.sqrt(np.maximum(counts, 1))[:, None]
        x[i:j, PATH + WORDS] = np.log1p(counts)
    length = np.array([len(t) for t in texts], np.float32)
    c = x[:, PATH + WORDS :]
    c[:, 1] = np.log1p(length)
    c[:, 2] = np.array([b[2] for b in found], np.float32) / np.maximum(length, 1)
    c[:, 3] = [t[-1] in ".!?…”\"" for t in texts]
    c[:, 4] = [t.count(".") + t.count(",") for t in texts] / np.maximum(length, 1) * 10
    c[:, 5] = ["©" in t or "(c)" in t.lower() for t in texts]
    c[:, 6] = [t.count(" ") < 3 for t in texts]
    c[:, 7] = [len(b[0]) / 10 for b in found]
    c[:, 8] = length < 25
    c[:, 9] = length > 200
    c[:, 10:12] = beside(found) if near is None else near
    return x


# --- the network ---------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, hidden: int = 16, seed: int = 6) -> None:
        rng, d = np.random.default_rng(seed), PATH + WORDS + COUNTS
        self.hidden = hidden
        self.p = {"out": rng.normal(0, 0.2, (2 * hidden, 1)), "bias": np.zeros(1)}
        for way in "fb":
            self.p |= {f"x{way}": rng.normal(0, 0.1, (d, 4 * hidden)), f"h{way}": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)), f"b{way}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def project(self, x: np.ndarray) -> np.ndarray:
        """What both directions take in of each block, side by side: far narrower than the block's vector."""
        return np.concatenate([x @ self.p[f"x{w}"] + self.p[f"b{w}"] for w in "fb"], -1)

    def _run(self, z: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        n, length, _ = z.shape
        h = c = np.zeros((n, self.hidden), np.float32)
        z = z[:, :, : 4 * self.hidden] if way == "f" else z[:, :, 4 * self.hidden :]
        out = np.zeros((n, length, self.hidden), np.float32)
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            i, f, o, g = np.split(z[:, t] + h @ self.p[f"h{way}"], 4, 1)
            i, f, o, g, m = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g), mask[:, t, None]
            c1 = f * c + i * g
            s = np.tanh(c1)
            h1 = o * s
            if keep is not None:
                keep.append((t, i, f, o, g, c, s, h, m))
            c, h = m * c1 + (1 - m) * c, m * h1 + (1 - m) * h
            out[:, t] = h
        return out

    def logits(self, z: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(z, mask, "f"), self._run(z, mask, "b")], 2)
        return (both @ self.p["out"] + self.p["bias"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        kept = {"f": [], "b": []}
        taken = self.project(x)
        both = np.concatenate([self._run(taken, mask, w, kept[w]) for w in "fb"], 2)
        z = (both @ self.p["out"] + self.p["bias"])[:, :, 0]
        total = mask.sum()
        chance = _sigmoid(z)
        loss = -float((mask * np.log(np.where(y == 1, chance, 1 - chance) + 1e-9)).sum() / total)
        dz = ((chance - y) * mask / total)[:, :, None]
        grad = {"out": np.einsum("nth,nto->ho", both, dz), "bias": dz.sum((0, 1))}
        back = dz @ self.p["out"].T
        for w, half in (("f", back[:, :, : self.hidden]), ("b", back[:, :, self.hidden :])):
            dx = np.zeros((*mask.shape, 4 * self.hidden), np.float32)
            dh_next = dc_next = np.zeros((len(x), self.hidden), np.float32)
            wide = np.zeros_like(self.p[f"h{w}"])
            for t, i, f, o, g, c, s, h, m in reversed(kept[w]):
                dh = half[:, t] + dh_next
                ds = dh * m * o * (1 - s * s) + dc_next * m
                dgate = np.concatenate([ds * g * i * (1 - i), ds * c * f * (1 - f), dh * m * s * o * (1 - o), ds * i * (1 - g * g)], 1)
                dx[:, t] = dgate
                wide += h.T @ dgate
                dh_next = dgate @ self.p[f"h{w}"].T + dh * (1 - m)
                dc_next = ds * f + dc_next * (1 - m)
            grad |= {f"h{w}": wide, f"b{w}": dx.sum((0, 1)), f"x{w}": np.einsum("ntd,ntg->dg", x, dx, optimize=True)}
        return grad, loss

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 10, batch: int = 40, rate: float = 0.015, seed: int = 6) -> float:
        rng, step, loss = np.random.default_rng(seed), 0, 0.0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for r in range(rounds):
            # Pages of like length share a batch; batches come in random order.
            order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]) + rng.random() * 12)
            for at in rng.permutation(range(0, len(order), batch)):
                x, mask, y = padded([pages[k] for k in order[at : at + batch]])
                # Names seen in training are hidden now and then: layout and words must do.
                x[:, :, :PATH] *= rng.random((len(x), 1, PATH)) > (0.25 if r < rounds - 3 else 0.05)
                grad, loss = self.gradients(x, mask, y)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= (rate * (1 - r / rounds) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page, given as vectors, is main text."""
        return self._labels([self.project(x) for x in pages])

    def label_pages(self, pages: list[list], known: dict) -> list[np.ndarray]:
        """The same for pages given as blocks; vectors are made ``TOGETHER`` at a time and held only as long."""
        ends = np.cumsum([0, *map(len, pages)])
        flat = [b for page in pages for b in page]
        near = np.concatenate([beside(page) for page in pages]) if flat else np.zeros((0, 2))
        taken = [self.project(vectors(flat[at : at + TOGETHER], known, near[at : at + TOGETHER])) for at in range(0, len(flat), TOGETHER)]
        taken = np.concatenate(taken) if taken else np.zeros((0, 8 * self.hidden), np.float32)
        return self._labels([taken[a:b] for a, b in zip(ends, ends[1:])])

    def _labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Pages of like length are run together."""
        out: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            most = max(1, min(64, 40_000 // max(1, len(pages[order[min(at + 63, len(order) - 1)]]))))
            chosen = order[at : at + most]
            z, mask, _ = padded([(pages[k], np.zeros(len(pages[k]))) for k in chosen], 8 * self.hidden)
            z = self.logits(z, mask)
            for row, k in enumerate(chosen):
                out[k] = z[row, : len(pages[k])] > 0
            at += most
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]], wide: int = PATH + WORDS + COUNTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, length = len(pages), max(1, max(len(x) for x, _ in pages))
    x, mask, y = np.zeros((n, length, wide), np.float32), np.zeros((n, length), np.float32), np.zeros((n, length), np.float32)
    for k, (v, label) in enumerate(pages):
        x[k, : len(v)], mask[k, : len(v)], y[k, : len(v)] = v, 1, label
    return x, mask, y


# --- training pages --------------------------------------------------------------

#: Names under which sites put each part, as found in common page templates.
NAMES = {
    "main": "content main main-content post entry entry-content article article-body articleBody story story-body text page-body post-content body-text single-post hentry copy prose".split(),
    "header": "header site-header masthead top topbar banner branding page-header logo head-wrap".split(),
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs links tabs toc pager pagination site-nav topnav".split(),
    "ad": "ad ads advert advertisement adbox sponsored sponsor promo promotion banner-ad ad-slot adsense commercial dfp".split(),
    "side": "sidebar side aside related widget rail right-col left-col secondary recommended trending popular see-also more-stories share social".split(),
    "notice": "notice cookie cookie-banner cookies consent alert disclaimer gdpr popup modal newsletter subscribe paywall message warning banner-notice signup privacy".split(),
    "comments": "comments comment comment-list comment-body discussion responses replies reply thread disqus user-comments feedback reviews respond".split(),
    "form": "form search search-form login contact-form subscribe-form comment-form field".split(),
    "footer": "footer site-footer bottom copyright colophon foot page-footer legal credits footer-links".split(),
}
_OWN = {"main": ["article", "main", "section"], "header": ["header"], "nav": ["nav"], "ad": [], "side": ["aside"], "notice": ["dialog"], "comments": [], "form": ["form"], "footer": ["footer"]}
_PHRASES = {"notice": "We use cookies on this site|Accept all|Please read our terms|Subscribe to our newsletter", "footer": "All rights reserved|Privacy policy|Terms of use|Contact us|© 2024", "comments": "Comments|Leave a reply|Reply|Posted by|says:", "ad": "Advertisement|Sponsored|Buy now|Special offer", "form": "Search|Your name|Email|Send|Submit", "nav": "Home|About|Contact|News|Archive", "side": "Related|Read more|Popular|See also|Share this", "header": "Welcome|Login|Register"}


def training_page(rng: np.random.Generator, words: list[str]) -> tuple[str, set]:
    """A page laid out at random, and the texts of its main blocks."""
    main: set = set()
    pick = lambda options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p

    def say(low: int, high: int) -> str:
        chosen = [words[k] for k in rng.integers(len(words), size=int(rng.integers(low, high + 1)))]
        return " ".join(chosen)[:1].upper() + " ".join(chosen)[1:] + pick([".", ".", ".", "", "!", "?"])

    def body(low: int, high: int, keep: bool) -> str:
        text = say(low, high)
        style = rng.random()
        if style < 0.25:  # main text can look like anything: lists with bars, signs, capitals
            text = text.replace(" ", " | ") if style < 0.1 else " ".join(x + pick(["***", "%%%", "###", "&amp;&amp;", "!!", "$$$"]) for x in text.split(" ")) if style < 0.18 else text.upper()
        if keep:
            main.add(" ".join(entities.unescape(text).split()))
        parts = text.split(" ")
        if len(parts) > 3 and chance(0.4):
            k = int(rng.integers(len(parts) - 1))
            tag = pick(["b", "i", "em", "strong", "a", "span", "code"])
            parts[k] = f"<{tag}{' href=/x' if tag == 'a' else ''}>{parts[k]}</{tag}>"
        return " ".join(parts)

    def attrs(part: str) -> str:
        name = pick(NAMES[part])
        if chance(0.3):
            name += " " + pick(["box", "wrap", "clear", "col-8", "row", "x1", "js-part", "u-full", "block", "inner"])
        return f' {pick(["class", "class", "class", "id"])}="{name}"'

    def wrap(part: str, inner: str) -> str:
        how = rng.random()
        own = _OWN[part]
        if own and how < 0.5:
            tag = pick(own)
            return f"<{tag}{attrs(part) if chance(0.4) else ''}>{inner}</{tag}>"
        tag = pick(["div", "div", "div", "section", "p" if "<" not in inner else "div", "td", "center"])
        named = attrs(part) if how < 0.95 else ""
        out = f"<{tag}{named}>{inner}</{tag}>"
        if tag == "td":
            out = f"<table><tr>{out}</tr></table>"
        return f"<div>{out}</div>" if chance(0.2) else out

    def line(part: str, low: int = 1, high: int = 12) -> str:
        text = pick(_PHRASES[part].split("|")) if chance(0.3) else say(low, high)
        return text if chance(0.5) else f"<p>{text}</p>"

    def links(part: str, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{pick(_PHRASES[part].split("|")) if chance(0.15) else say(1, 3)}</a>' for k in range(int(rng.integers(low, high + 1)))]
        form = rng.random()
        if form < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return pick([" | ", " ", " » ", "<br>"]).join(items)

    def form() -> str:
        inner = "".join(pick([f"<label>{line('form', 1, 3)}</label><input name=q>", f"<p>{say(1, 6)}</p>", f"<button>{say(1, 2)}</button>", "<textarea></textarea>", f"<select><option>{say(1, 1)}</option></select>"]) for _ in range(int(rng.integers(1, 5))))
        return f"<form{attrs('form') if chance(0.4) else ''}>{inner}</form>"

    def comments() -> str:
        one = lambda: pick([f'<div class="{pick(["comment", "reply", "comment-body", "c"])}">{f"<b>{say(1, 2)}</b> " if chance(0.3) else ""}<p>{say(3, 40)}</p></div>', f"<li><p>{say(3, 40)}</p></li>", f"<p>{say(3, 40)}</p>"])
        head = f"<h3>{line('comments', 1, 3)}</h3>" if chance(0.5) else ""
        return wrap("comments", head + "".join(one() for _ in range(int(rng.integers(1, 6)))) + (form() if chance(0.3) else ""))

    def extra(part: str) -> str:
        if part == "comments":
            return comments()
        if part == "form":
            return form()
        if part == "nav":
            return wrap("nav", links("nav", 2, 9))
        inner = "".join(pick([lambda: line(part), lambda: line(part, 4, 30), lambda: links(part, 1, 5), lambda: f"<h3>{say(1, 4)}</h3>"])() for _ in range(int(rng.integers(1, 4))))
        return wrap(part, inner)

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.72:
            text = body(1, 6, True) if chance(0.15) else body(2, 120, True)
            return pick([f"<p>{text}</p>"] * 5 + [f"<p>{text}", f"<div>{text}</div>", f"<p><b>{text}<br>"])
        if kind < 0.82:
            return f"<h{(level := int(rng.integers(2, 5)))}>{body(1, 8, True)}</h{level}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{body(1, 14, True)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote>{body(4, 40, True)}</blockquote>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{body(2, 12, True)}</figcaption></figure>"
        return f"<table><tr><td>{body(1, 5, True)}</td><td>{body(1, 5, True)}</td></tr></table>"

    inner = [f"<h1>{body(2, 12, True)}</h1>"] if chance(0.85) else []
    for _ in range(int(rng.integers(1, 14 if chance(0.85) else 50))):
        inner.append(paragraph())
        if chance(0.04):
            inner += [inner[-1]] * int(rng.integers(1, 25))
        if chance(0.08):
            inner.append(extra(pick(["ad", "notice", "side", "form"])))
    if chance(0.25):  # a last paragraph of a few words
        inner.append(f"<p>{body(1, 5, True)}</p>")
    if chance(0.15):
        inner.append(extra(pick(["side", "comments", "nav"])))
    top = [extra(p) for p in ("notice", "header", "nav", "ad", "form", "side") if chance(0.4)]
    low = [extra(p) for p in ("ad", "side", "comments", "comments", "form", "notice", "nav") if chance(0.3)]
    if chance(0.8):
        low.append(wrap("footer", "".join(pick([line("footer", 1, 10), links("footer", 1, 5), f"&copy; {say(1, 2)} &middot; {say(2, 8)}"]) for _ in range(int(rng.integers(1, 3))))))
    page = "".join(top) + wrap("main", "".join(inner)) + "".join(low)
    if chance(0.3):
        page = f'<div class="{pick(["wrapper", "page", "container", "site", "layout"])}">{page}</div>'
    return f"<html><head><title>{say(2, 6)}</title></head><body>{page}</body></html>", main


def fitted_labeller(words: list[str], pages: int = 800, seed: int = 6) -> BlockLabeller:
    """A labeller trained on ``pages`` training pages made of ``words``."""
    rng, known, ready = np.random.default_rng(seed), {}, []
    for _ in range(pages):
        page, main = training_page(rng, words or ["text"])
        found = list(blocks(page))
        if found:
            ready.append((vectors(found, known), np.array([b[1] in main for b in found], np.float32)))
    out = BlockLabeller(seed=seed)
    out.fit(ready)
    return out


def sample_words(pages: DataFrame, ident: str, html: str, bound: int = SAMPLE, most: int = SAMPLE_WORDS) -> list[str]:
    """At most ``most`` words of at most ``bound`` pages, those with the smallest hashes; longer words than 40 letters are left out.

    The pages are read where they lie; only words come to the driver.
    """
    chosen = pages.where(F.col(html).isNotNull() & F.col(ident).isNotNull()).select(ident).distinct().orderBy(F.xxhash64(ident), ident).limit(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = {w for _, text, _ in blocks(batch.column(0)[k].as_py()) for w in text.split() if len(w) <= 40}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    words = pages.join(F.broadcast(chosen), ident, "left_semi").where(F.col(html).isNotNull()).select(html).mapInArrow(run, "word string").distinct()
    return sorted(r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(most).collect())


def _slices(column: pa.Array) -> Iterator[list[list]]:
    """Blocks of pages, some megabytes of them at a time."""
    found, held = [], 0
    for k in range(len(column)):
        page = column[k].as_py() or ""
        found.append(list(blocks(page)))
        held += len(page)
        if held > SLICE or len(found) == 256:
            yield found
            found, held = [], 0
    if found:
        yield found


def extract_main_text(pages: DataFrame, ident: str = "page_id", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole ``html`` as column ``out`` (replaced if it was there).

    Blocks labelled as main text are joined by newlines in page order; white space
    in a block is one space.  A null or empty page, and one without main text, gives
    an empty text.  Rows are independent, so repeated rows get equal texts.
    """
    labeller = fitted_labeller(sample_words(pages, ident, html))

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict = {}
        for column in columns:
            texts: list = []
            for found in _slices(column):
                labels = labeller.label_pages(found, known)
                texts += ["\n".join(b[1] for b, keep in zip(page, label) if keep) for page, label in zip(found, labels)]
            yield pa.array(texts, pa.string())

    return pages.withColumn(out, run(F.col(html)))
