"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf sequence: blocks of text between block-level tags, each with the path of its open tags. Two vectors
describe a block: a hashed bag of its path's parts (tag, class, id and role words, nearest ones marked) and a hashed bag of
its words together with a few counts. A bidirectional LSTM in numpy reads the whole sequence of a page and labels
every block as main text or not, so each decision sees the document on both sides.

The network is fitted on a bounded sample: the first ``TRAIN_BLOCKS`` blocks of each of ``TRAIN_PAGES`` pages (those of least id hash among the
pages with labels). Its labels come from the pages' own semantic markup (text under ``article`` or ``main``, outside of boilerplate elements);
where no page of the table has any, every block outside of boilerplate elements counts as main text. Each page is
also shown in varied forms: with its markup replaced by neutral containers and with further boilerplate (page headers,
sidebars, notices, adverts, forms, comments) whose text is drawn from the boilerplate and the text of other pages of the sample. The
fit is seeded and runs on the driver; the weights, some 40 thousand numbers, go to the tasks.

A block's white space becomes one space and the blocks that are kept are joined by one. Scripts, styles, comments of the markup and other
elements without text are never blocks. Reading a page takes time and memory by its length, however deep it is nested; a page is one
sequence in the memory of one task. A null or empty page has an empty text. Repeated rows keep a row each; an empty
table gives an empty result, and with an empty table there is no fit; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: its pages, and the blocks that are read of each.
TRAIN_PAGES, TRAIN_BLOCKS, SEED = 200, 400, 7
PATH_SIZE, WORD_SIZE, COUNTS, HIDDEN = 96, 48, 6, 24
RESULT = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
#: A tag whose quotes do not pair.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Elements of the HTML standard by the way their content is read.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select textarea button audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: Elements that an opening tag of the key closes, up to the nearest of the container elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article aside blockquote body div dl footer form header main nav ol section table ul".split())
#: What a head may hold; its end tag is optional, and anything else closes it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Raw text: markup inside is not read.
RAW = frozenset("script style textarea title iframe noscript".split())

MAIN = frozenset("article main".split())
#: Tags of main text, in a page's text; only a page with one can have blocks that are marked.
_MARKED = r"(?i)<(article|main)(?![a-z0-9-])"
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ASIDE_WORDS = re.compile(
    r"\b(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|menu|nav\w*|newsletter|notice|popup|promo\w*|related|respond|share|sidebar|social|sponsor\w*|subscribe|widget)\b"
)


class Path:
    """A tag path as its last part and the path above it, so that a page's paths together are as large as its tags.

    ``words`` are the slots of all words on the path as bits, ``says`` what the markup says of a block there, ``first``
    the path to its outermost element of main text, and ``lead`` how many of its first two parts are html or body.
    """

    __slots__ = ("above", "part", "depth", "words", "says", "first", "lead")

    def __init__(self, above: Path | None = None, part: str = ""):
        self.above, self.part = above, part
        self.depth, self.words, self.says, self.first, self.lead = 0, 0, None, None, 0
        if above is not None:
            words, says = _part(part)
            self.depth, self.words = above.depth + 1, above.words | words
            self.says = above.says if above.says is False or says is None else says
            self.first = above.first or (self if part.partition(" ")[0] in MAIN else None)
            self.lead = above.lead + (self.depth <= 2 and part in ("html", "body") and part != above.part)

    def below(self, *parts: str) -> Path:
        path = self
        for part in parts:
            path = Path(path, part)
        return path

    def __iter__(self) -> Iterator[str]:
        found, path = [], self
        while path.above is not None:
            found.append(path.part)
            path = path.above
        return reversed(found)

    def __eq__(self, other: object) -> bool:
        return tuple(self) == tuple(other)

    __hash__ = None


def blocks(page: str) -> list[tuple[Path, str]]:
    """``(path, text)`` of each block with text; a path part is ``tag`` or ``tag words of class, id and role``.

    Time and memory grow with the page's length, however deep its elements are nested.
    """
    out: list[tuple[Path, str]] = []
    path = root = Path()
    stack: list[tuple[str, Path]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
    containers: list[int] = []
    parts: list[str] = []
    at, silent = 0, 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((path, text))

    def pop(to: int) -> None:
        nonlocal silent
        while len(stack) > to:
            tag, _ = stack.pop()
            silent -= tag in SILENT
            places[tag].pop()
            if tag in CONTAINERS:
                containers.pop()

    def close_head() -> None:
        if silent == 1 and places["head"]:
            pop(places["head"][0])

    size = len(page)
    while at < size:
        opened = page.find("<", at)
        found = _TOKEN.match(page, opened) or _LOOSE.match(page, opened) if opened >= 0 else None
        if opened < 0 or (found is None and opened + 1 >= size):
            opened, found = size if opened < 0 else opened, None
        if silent and stack[-1][0] == "head" and page[at:opened].strip():
            close_head()
        if not silent and opened > at:
            if not parts:
                path = stack[-1][1] if stack else root
            parts.append(page[at:opened])
        if opened >= size:
            break
        if found is None:  # a lone "<" is text
            if not silent:
                parts.append("<")
            at = opened + 1
            continue
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCK:
                close()
            if tag in places and places[tag] and (tag in BLOCK or not containers or containers[-1] < places[tag][-1]):
                pop(places[tag][-1])
            continue
        if silent and tag not in HEAD:
            close_head()
        if tag == "br":
            parts.append("\n")
        if tag in BLOCK:
            close()
            closed = max((places[t][-1] for t in {"p"} | CLOSES.get(tag, set()) if places[t]), default=-1)
            if closed > (containers[-1] if containers else -1):
                pop(closed)
        if tag in VOID or found[3].endswith("/"):
            continue
        named = " ".join(x for m in _ATTRIBUTE.finditer(found[3]) for x in re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower()))
        places[tag].append(len(stack))
        if tag in CONTAINERS:
            containers.append(len(stack))
        stack.append((tag, Path(stack[-1][1] if stack else root, f"{tag} {named}".strip())))
        silent += tag in SILENT
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            if not silent:
                parts.append(page[at:end.start() if end else size])
            pop(len(stack) - 1)
            at = end.end() if end else size
    close()
    return out


def is_main(path: Path, unmarked: bool = False) -> bool:
    """Whether the markup says that a block is main text, or with ``unmarked`` does not say otherwise."""
    return path.says is not False if unmarked else bool(path.says)


@lru_cache(maxsize=1 << 16)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


@lru_cache(maxsize=1 << 16)
def _part(part: str) -> tuple[int, bool | None]:
    """The slots of a path part's words as bits, and what it says of the text inside: boilerplate, main text or nothing."""
    tag, _, named = part.partition(" ")
    bits = 0
    for word in part.split():
        bits |= 1 << _slot(word, PATH_SIZE)
    return bits, False if tag in ASIDE or ASIDE_WORDS.search(named) else True if tag in MAIN else None


def path_vector(words: int, last: str, before: str) -> np.ndarray:
    """The words of a path, and those of its last two parts by their place."""
    out = np.unpackbits(np.frombuffer(words.to_bytes(PATH_SIZE // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    for depth, part in enumerate((last, before)):
        for word in part.split():
            out[_slot(f"{depth}:{word}", PATH_SIZE)] = 1
    return out


def word_vector(text: str) -> np.ndarray:
    found = text.lower().split()
    out = np.zeros(WORD_SIZE + COUNTS, np.float32)
    for word in found:
        out[_slot(word, WORD_SIZE)] += 1
    norm = np.linalg.norm(out)
    out /= norm or 1
    n = len(found)
    out[WORD_SIZE:] = (
        np.log1p(n) / 5, n < 3, n > 20, text[-1] in ".!?", sum(text.count(c) for c in ".,;:") / (n + 1), any(c in text for c in "©|»·")
    )
    return out


SIZE = PATH_SIZE + WORD_SIZE + COUNTS


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {}
        for side in "fb":
            self.weights[f"x{side}"], self.weights[f"h{side}"] = draw(SIZE, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # begin by remembering
            self.weights[f"c{side}"] = bias
        self.weights["o"], self.weights["ob"] = draw(2 * HIDDEN, 1), np.zeros(1, np.float32)

    def _side(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States of one direction over ``x`` (steps, pages, SIZE); padded steps pass the state on."""
        w = self.weights
        steps, pages, _ = x.shape
        gates_x = x @ w[f"x{side}"] + w[f"c{side}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates_x[t] + h @ w[f"h{side}"]
            gate = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                saved.append((t, h, c, i, f, o, g, squashed, m))
            c = m * new + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[t] = h
        return out, saved

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._side(x, mask, s, False)[0] for s in "fb"], axis=2)
        return 1 / (1 + np.exp(-(states @ self.weights["o"] + self.weights["ob"])[:, :, 0]))

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the blocks and its gradients, by back-propagation through time."""
        w = self.weights
        (forward, saved_f), (backward, saved_b) = self._side(x, mask, "f", True), self._side(x, mask, "b", True)
        states = np.concatenate((forward, backward), axis=2)
        p = 1 / (1 + np.exp(-(states @ w["o"] + w["ob"])[:, :, 0]))
        n = mask.sum()
        loss = -(mask * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum() / n
        d = ((p - labels) * mask / n)[:, :, None].astype(np.float32)
        grad = {"o": np.einsum("tph,tpk->hk", states, d), "ob": d.sum((0, 1))}
        d_states = d @ w["o"].T
        for side, saved, part in (("f", saved_f, d_states[:, :, :HIDDEN]), ("b", saved_b, d_states[:, :, HIDDEN:])):
            dz_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            grad[f"h{side}"] = np.zeros_like(w[f"h{side}"])
            for t, h, c, i, f, o, g, squashed, m in reversed(saved):
                dh = dh + part[t]
                d_new = m * (dc + dh * o * (1 - squashed**2))
                dz = np.concatenate(
                    (d_new * g * i * (1 - i), d_new * c * f * (1 - f), m * dh * squashed * o * (1 - o), d_new * i * (1 - g**2)), axis=1
                )
                dz_all[t] = dz
                grad[f"h{side}"] += h.T @ dz
                dh = dz @ w[f"h{side}"].T + (1 - m) * dh
                dc = d_new * f + (1 - m) * dc
            grad[f"x{side}"] = np.tensordot(x, dz_all, axes=((0, 1), (0, 1)))
            grad[f"c{side}"] = dz_all.sum((0, 1))
        return float(loss), grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, batch: int = 16, rate: float = 0.01, seed: int = SEED) -> float:
        """Adam over batches of pages; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, loss = 0, 0.0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            losses = []
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[k]])
                labels = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(groups[k]):
                    labels[: len(pages[i][1]), j] = pages[i][1]
                value, grad = self.gradients(x, mask, labels)
                losses.append(value)
                step += 1
                scale = min(1.0, 5 / (np.sqrt(sum(float((g**2).sum()) for g in grad.values())) + 1e-9))
                for name, g in grad.items():
                    g = g * scale
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g**2
                    self.weights[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, 1
    return x, mask


def vectors(page: list[tuple[Path, str]]) -> np.ndarray:
    known: dict[tuple[int, str, str], np.ndarray] = {}
    out = np.zeros((len(page), SIZE), np.float32)
    for k, (path, text) in enumerate(page):
        key = path.words, path.part, path.above.part if path.above else ""
        if key not in known:
            known[key] = path_vector(*key)
        out[k, :PATH_SIZE], out[k, PATH_SIZE:] = known[key], word_vector(text)
    return out


#: Containers that the varied forms give to main text and to boilerplate.
MAIN_PATHS = (("article",), ("main",), ("main", "article"), ("div content",), ("div post",), ("div entry content",), ("section article body",), ("div main", "div text"), ("div story",))
ASIDE_PATHS = (
    ("header", "p"), ("header", "div"), ("header", "h1"), ("div header", "p"), ("div site header", "h2"), ("nav", "ul", "li"), ("div menu", "ul", "li", "a"),
    ("div breadcrumb", "a"), ("aside", "p"), ("aside", "ul", "li"), ("div sidebar", "p"), ("div sidebar widget", "h3"), ("section related", "li"),
    ("div cookie notice", "p"), ("div notice", "p"), ("div banner",), ("div ad",), ("div advert", "p"), ("div ads",), ("section promo", "p"),
    ("form", "label"), ("form", "p"), ("div newsletter", "form", "p"), ("section comments", "p"), ("div comments", "div comment", "p"),
    ("section comments", "article comment", "p"), ("ol comment list", "li", "p"), ("div comment", "p"), ("ul comments", "li"), ("div share", "span"), ("footer", "p"), ("footer",),
    ("div footer", "p"), ("dialog", "p"),
)


def moved(path: Path, under: Path, known: dict[int, Path]) -> Path:
    """The part of ``path`` inside its main element, or else inside the body, put below ``under``.

    ``known`` holds what was moved of one page, by the identity of its paths.
    """
    way = []
    while path.depth > path.lead and path is not path.first and id(path) not in known:
        way.append(path)
        path = path.above
    found = known.get(id(path), under)
    for step in reversed(way):
        found = known[id(step)] = Path(found, step.part)
    return found


def varied(pages: list[list], seed: int = SEED, unmarked: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: each page as it is, and in two varied forms."""
    rng, root = np.random.default_rng(seed), Path()
    labels = [[is_main(path, unmarked) for path, _ in page] for page in pages]
    aside = [t for page, known in zip(pages, labels) for (_, t), k in zip(page, known) if not k] or ["Menu"]
    prose = [t for page, known in zip(pages, labels) for (_, t), k in zip(page, known) if k] or aside
    out = []
    for page, known in zip(pages, labels):
        out.append((vectors(page), np.array([bool(k) for k in known], np.float32)))
        for form in range(2):
            own = root.below("html", "body", *MAIN_PATHS[rng.integers(len(MAIN_PATHS))]) if form else None
            blocks_, truth, places = [], [], {}

            def extra(most: int) -> None:
                for _ in range(int(rng.integers(0, most + 1))):
                    path = root.below("html", "body", *ASIDE_PATHS[rng.integers(len(ASIDE_PATHS))])
                    for _ in range(int(rng.integers(1, 4))):
                        source = aside if rng.random() < 0.5 else prose
                        blocks_.append((path, source[rng.integers(len(source))]))
                        truth.append(0.0)

            extra(3)
            inside = False
            for (path, text), k in zip(page, known):
                if inside and not k:
                    extra(2)
                inside = bool(k)
                if k and own:
                    path = moved(path, own, places)
                if k and rng.random() < 0.05:
                    # a page element within the article's container is no main text
                    blocks_.append(((path.above or root).below(*ASIDE_PATHS[rng.integers(len(ASIDE_PATHS))]), prose[rng.integers(len(prose))]))
                    truth.append(0.0)
                blocks_.append((path, text))
                truth.append(float(bool(k)))
            extra(3)
            out.append((vectors(blocks_), np.array(truth, np.float32)))
    return out


def sample_pages(pages: DataFrame, most: int = TRAIN_PAGES, unmarked: bool = False) -> list[list]:
    """The block sequences of the pages of least id hash that say where their main text is.

    With ``unmarked``, of those with a block that their markup does not call boilerplate. Pages are read on the
    executors: those of the least hashes, then more, then all, until there are enough.
    """
    keyed = pages.where("html is not null").select("html", F.xxhash64("page_id", "url").alias("h"))
    if not unmarked:
        keyed = keyed.where(F.col("html").rlike(_MARKED))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                read = (blocks(html)[:TRAIN_BLOCKS] for html in part.column("html").to_pylist())
                yield part.filter(pa.array([any(is_main(path, unmarked) for path, _ in page) for page in read], pa.bool_()))

    rows: list = []
    for asked in (most, 8 * most, None):
        near = keyed
        if asked:
            last, n = keyed.select("h").orderBy("h").limit(asked).agg(F.max("h"), F.count("h")).first()
            if not n:
                return []
            near = keyed.where(F.col("h") <= last)
        rows = near.mapInArrow(labelled, "html string, h long").orderBy("h", "html").limit(most).collect()
        if len(rows) == most or asked and n < asked:
            break
    return [blocks(row["html"])[:TRAIN_BLOCKS] for row in rows]


def fitted(pages: DataFrame, most: int = TRAIN_PAGES, seed: int = SEED) -> Labeller | None:
    """The labeller fitted on the sample of ``pages``; None where no page has a block that may be main text.

    Where no page says where its main text is, all blocks that the markup does not call boilerplate count as such.
    """
    sample = sample_pages(pages, most)
    unmarked = not sample
    sample = sample or sample_pages(pages, most, unmarked)
    if not sample:
        return None
    labeller = Labeller(seed)
    labeller.fit(varied(sample, seed, unmarked))
    return labeller


def kept_blocks(labeller: Labeller, pages: list[list]) -> list[list[str]]:
    """The texts of the blocks that are main text, page by page; pages of like length go together."""
    out: list[list[str]] = [[] for _ in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        group = [order[at]]
        at += 1
        while at < len(order) and len(pages[order[at]]) * (len(group) + 1) <= 6000 and len(group) < 256:
            group.append(order[at])
            at += 1
        scores = labeller.scores(*padded([vectors(pages[i]) for i in group]))
        for j, i in enumerate(group):
            out[i] = [text for (_, text), s in zip(pages[i], scores[:, j]) if s >= 0.5]
    return out


def extract(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """Per page: page_id, url, text, n_chars, and how many blocks there are and are kept."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                read = [blocks(html or "") for html in part.column("html").to_pylist()]
                kept = kept_blocks(shared.value, read) if shared.value else [[] for _ in read]
                texts = [" ".join(x) for x in kept]
                yield pa.record_batch(
                    {
                        "page_id": part.column("page_id").cast(pa.int64()),
                        "url": part.column("url").cast(pa.string()),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array(list(map(len, texts)), pa.int64()),
                        "n_blocks": pa.array(list(map(len, read)), pa.int64()),
                        "n_kept": pa.array(list(map(len, kept)), pa.int64()),
                    }
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, RESULT)
