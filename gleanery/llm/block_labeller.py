"""Main text of pages by a recurrent labeller of leaf blocks.

A page is the sequence of its leaf blocks. Each block is a vector of its tag path (hashed
element and class names), its words (hashed) and a few measures. A bidirectional LSTM in
numpy reads the whole sequence both ways, so every block is classified by what stands
before and after it on the page, and a logistic layer says whether it is main text.

The network learns at every call, from a bounded sample of the pages themselves, taken
whatever their length. They are parsed and measured in the tasks; the driver gets numbers
and paths of blocks, no texts. Their blocks are labelled by the page's own structure where it is plain (inside or outside of
`article` and its like); copies of these sequences in which containers have other names
and further kinds of side blocks (comments, forms, notices, sidebars) are put in teach it
to read pages that are built otherwise.
"""

from __future__ import annotations

import math
import os
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from gleanery.llm.common import table
from gleanery.llm.markup_blocks import Leaf, leaves
from gleanery.session import written

# Pages to learn from: those of the least digest of the id. Longer ones than PAGE_BLOCKS
# give so many runs of neighbouring blocks, spread from the first block to the last.
SAMPLE_PAGES = 128
PAGE_BLOCKS = 1024
PAGE_RUNS = 4
COPIES = 12
HIDDEN = 16
EPOCHS = 24
BATCH = 64
RATE = 0.015
SEED = 10
# Bins of names that are not listed below, of tags and of words.
OTHER_BINS, TAG_BINS, WORD_BINS = 32, 16, 32
MEASURES = 6
# Blocks (with filling) that go through the network at once.
STEP_BLOCKS = 20_000

# Names of containers of main text, and of side blocks by kind.
MAIN = [("article",), ("main",), ("div", ".content"), ("div", ".post", ".body"), ("section", ".entry"), ("div", ".article"), ("div", ".story")]
SIDE = {
    "nav": [("nav",), ("div", ".menu"), ("div", ".navigation"), ("ul", ".nav"), ("div", ".breadcrumb")],
    "footer": [("footer",), ("div", ".footer"), ("div", ".copyright"), ("section", ".footer")],
    "header": [("header",), ("div", ".header"), ("div", ".masthead")],
    "ad": [("div", ".ad"), ("div", ".ads"), ("div", ".advert"), ("aside", ".promo"), ("div", ".banner"), ("div", ".sponsored")],
    "aside": [("aside",), ("div", ".sidebar"), ("aside", ".related"), ("div", ".widget")],
    "comments": [("div", ".comments"), ("section", ".comments"), ("div", ".comment"), ("ol", ".comment", ".list")],
    "form": [("form",), ("div", ".form"), ("form", ".search"), ("form", ".subscribe")],
    "notice": [("div", ".notice"), ("div", ".cookie"), ("div", ".cookie", ".banner"), ("div", ".consent")],
}
_MAIN_NAMES = {"article", "main", ".article", ".content", ".post", ".entry", ".story"}
_SIDE_NAMES = {"head", "title", "button", "select", "label", *(n for kind in SIDE.values() for names in kind for n in names)}
_SIDE_NAMES -= {"div", "section", "ul", "ol", ".list"}
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "blockquote", "pre", "dd", "dt", "figcaption"}


# Each listed name has a bin of its own, so that no other name passes for it.
_LISTED = sorted(
    {n for names in (*MAIN, *(o for kind in SIDE.values() for o in kind)) for n in names}
    | _MAIN_NAMES | _SIDE_NAMES | _TEXT_TAGS | {"html", "body", "div", "section", "ul", "ol", "li", "table", "tbody", "tr", "th", "dl"}
)
_LISTED_BINS = {name: k for k, name in enumerate(_LISTED)}
PATH_BINS = len(_LISTED) + OTHER_BINS
WIDTH = PATH_BINS + TAG_BINS + WORD_BINS + MEASURES


@dataclass
class Block:
    """What the network learns of a block: its path, and its words and measures as numbers."""

    path: tuple[str, ...]
    words: np.ndarray
    linked: float


@dataclass
class Run:
    """Neighbouring blocks of a page with their labels, and the share of the page they cover."""

    blocks: list[Block]
    labels: list[int]
    start: float = 0.0
    end: float = 1.0


def structure_labels(page: list[Leaf]) -> list[int]:
    """1 for blocks inside a container of main text (on pages without any: text elements)
    and outside of side blocks."""
    inside = [bool(_MAIN_NAMES.intersection(leaf.path)) for leaf in page]
    if not any(inside):
        inside = [bool(_TEXT_TAGS.intersection(leaf.path)) for leaf in page]
    return [int(i and not _SIDE_NAMES.intersection(leaf.path)) for i, leaf in zip(inside, page)]


def _bin(name: str, bins: int) -> int:
    return zlib.crc32(name.encode()) % bins


class Vectors:
    """Vectors of blocks; bins of names and words are remembered up to a bound."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        known = self.paths.get(path)
        if known is None:
            known = np.zeros(PATH_BINS + TAG_BINS, np.float32)
            for name in path:
                place = _LISTED_BINS.get(name)
                known[len(_LISTED) + _bin(name, OTHER_BINS) if place is None else place] = 1
            own = [n for n in path if n[0] != "."][-1:] or ["-"]
            known[PATH_BINS + _bin(own[0], TAG_BINS)] = 1
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = known
        return known

    def words_of(self, text: str, out: np.ndarray) -> None:
        """Set the words of a text and its own measures."""
        words = text.lower().split()
        bins = []
        for word in words:
            place = self.words.get(word)
            if place is None:
                if len(self.words) > 200_000:
                    self.words.clear()
                place = self.words[word] = _bin(word, WORD_BINS)
            bins.append(place)
        counts = np.bincount(bins, minlength=WORD_BINS)
        out[:WORD_BINS] = counts / math.sqrt(float((counts * counts).sum()) or 1.0)
        out[WORD_BINS] = math.log1p(len(words)) / 5
        out[WORD_BINS + 2] = min(1.0, sum(map(text.count, ".,;!?")) / len(words))
        out[WORD_BINS + 3] = float(text[-1] in ".!?")

    def of(self, page: list[Leaf] | list[Block], start: float = 0.0, end: float = 1.0) -> np.ndarray:
        out = np.zeros((len(page), WIDTH), np.float32)
        for k, block in enumerate(page):
            out[k, : PATH_BINS + TAG_BINS] = self._path(block.path)
            own = out[k, PATH_BINS + TAG_BINS :]
            if isinstance(block, Block):
                own[:] = block.words
            else:
                self.words_of(block.text, own)
            own[WORD_BINS + 1] = block.linked
            own[WORD_BINS + 4] = start + (end - start) * k / len(page)
            own[WORD_BINS + 5] = float(len(block.path)) / 10
        return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """A bidirectional LSTM with a logistic layer over both states of each block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def drawn(*shape):
            return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)

        self.p = {}
        for way in "fb":
            self.p |= {f"W{way}": drawn(WIDTH, 4 * HIDDEN), f"U{way}": drawn(HIDDEN, 4 * HIDDEN)}
            self.p[f"b{way}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p |= {"V": drawn(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}

    @staticmethod
    def of(weights: dict[str, np.ndarray] | None) -> Labeller | None:
        """From its weights: a broadcast carries plain data only, as workers need not have
        this package."""
        if weights is None:
            return None
        made = Labeller.__new__(Labeller)
        made.p = weights
        return made

    def _run(self, x, mask, way, keep):
        """States of one direction; x is (blocks, pages, WIDTH), filled where mask is 0."""
        steps, pages = mask.shape
        inputs = x @ self.p[f"W{way}"] + self.p[f"b{way}"]
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        states = np.zeros((steps, pages, HIDDEN), np.float32)
        kept = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"U{way}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep:
                kept.append((t, h, c, i, f, o, g, tanh_c, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            states[t] = h
        return states, kept

    def scores(self, x, mask):
        """Chance of main text for each block."""
        both = [self._run(x, mask, way, False)[0] for way in "fb"]
        return _sigmoid((np.concatenate(both, axis=2) @ self.p["V"])[..., 0] + self.p["c"])

    def gradients(self, x, mask, y):
        runs = {way: self._run(x, mask, way, True) for way in "fb"}
        both = np.concatenate([runs[way][0] for way in "fb"], axis=2)
        chance = _sigmoid((both @ self.p["V"])[..., 0] + self.p["c"])
        error = ((chance - y) * mask / mask.sum())[..., None].astype(np.float32)
        grads = {"V": both.reshape(-1, 2 * HIDDEN).T @ error.reshape(-1, 1), "c": error.sum(axis=(0, 1))}
        into = error @ self.p["V"].T
        for k, way in enumerate("fb"):
            own = into[..., k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            grads[f"U{way}"] = np.zeros_like(self.p[f"U{way}"])
            dh = np.zeros((mask.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, tanh_c, m in reversed(runs[way][1]):
                dh = dh + own[t]
                to_h, to_c = dh * m, dc * m
                to_c = to_c + to_h * o * (1 - tanh_c**2)
                dz = np.concatenate(
                    (to_c * g * i * (1 - i), to_c * c * f * (1 - f), to_h * tanh_c * o * (1 - o), to_c * i * (1 - g**2)), axis=1
                )
                dz_all[t] = dz
                grads[f"U{way}"] += h.T @ dz
                dh = dz @ self.p[f"U{way}"].T + dh * (1 - m)
                dc = to_c * f + dc * (1 - m)
            grads[f"W{way}"] = x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * HIDDEN)
            grads[f"b{way}"] = dz_all.sum(axis=(0, 1))
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[list[int]], epochs: int = EPOCHS) -> Labeller:
        """Learn by Adam over batches of pages of like length; the weights of the last third
        of the steps are averaged."""
        rng = np.random.default_rng(SEED)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
        step, steps, kept = 0, epochs * len(batches), 0
        mean = {name: np.zeros_like(value) for name, value in self.p.items()}
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                x, mask = filled([pages[k] for k in batches[b]])
                y = np.zeros(mask.shape, np.float32)
                for column, k in enumerate(batches[b]):
                    y[: len(labels[k]), column] = labels[k]
                step += 1
                for name, grad in self.gradients(x, mask, y).items():
                    first, second = moments[name]
                    grad = np.clip(grad, -1, 1)
                    first[:] = 0.9 * first + 0.1 * grad
                    second[:] = 0.999 * second + 0.001 * grad**2
                    scale = math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.p[name] -= RATE * scale * first / (np.sqrt(second) + 1e-8)
                if 3 * step > 2 * steps:
                    kept += 1
                    for name, value in self.p.items():
                        mean[name] += (value - mean[name]) / kept
        self.p = mean if kept else self.p
        return self


def filled(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages side by side, filled up to the longest, and the mask of real blocks."""
    steps = max(map(len, pages), default=0)
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        mask[: len(page), k] = 1
    return x, mask


def _renamed(path: tuple[str, ...], names: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The path with its containers under other names, and their own names gone."""
    out: list[str] = []
    for name in path:
        if name in names:
            if name[0] == "." and out and out[-1] == "div":
                out.pop()
            out.extend(names[name])
        else:
            out.append(name)
    return tuple(out)


def _invented(rng) -> tuple[str, ...]:
    """A container whose name says nothing, as pages have: other features must tell."""
    tag = ("div", "section", "div", "aside")[int(rng.integers(4))]
    return (tag, f".x{int(rng.integers(1000))}")


def _common_path(blocks: list[tuple[Block, int]]) -> tuple[str, ...]:
    """The path that all blocks of main text share."""
    paths = [block.path for block, y in blocks if y]
    shared = os.path.commonprefix(paths) if paths else ()
    # A text element of a page with a single block is not a container.
    return tuple(shared[:-1] if len(shared) > 1 and shared[-1] in _TEXT_TAGS else shared)


def varied(page: list[Block], labels: list[int], texts: list[np.ndarray], rng) -> tuple[list[Block], list[int]]:
    """A copy of a page with other container names and further side blocks, around the main
    text and inside its container, under known names and under names that say nothing."""

    def draw(options):
        return options[int(rng.integers(len(options)))]

    def container(options, unnamed=0.4):
        return _invented(rng) if rng.random() < unnamed else draw(options)

    main_name = container(MAIN, 0.25)
    names = {"article": main_name, "main": main_name, "nav": draw(SIDE["nav"]), "footer": draw(SIDE["footer"])}
    names |= {".ad": container(SIDE["ad"]), "aside": draw(SIDE["aside"]), "header": draw(SIDE["header"])}
    blocks = [(Block(_renamed(b.path, names), b.words, b.linked), y) for b, y in zip(page, labels)]
    inside = _common_path(blocks)
    for kind in SIDE:
        if rng.random() < 0.35:
            main = [k for k, (_, y) in enumerate(blocks) if y]
            within = bool(main) and kind not in ("header", "footer") and rng.random() < 0.5
            own = container(SIDE[kind])
            if rng.random() < 0.4:
                own = (*own, *_invented(rng))
            head = (*(inside if within else ("html", "body")), *own)
            many = int(rng.integers(1, 6))
            inner = [draw([("p",), ("p",), ("li",), ("div",), ("h3",), ()]) for _ in range(many)]
            linked = float(kind in ("nav", "aside") and rng.random() < 0.7)
            new = [(Block((*head, *tail), draw(texts), linked), 0) for tail in inner]
            # Comments and forms stand after the main text, headers before it, adverts anywhere.
            if not main:
                at = len(blocks)
            elif kind in ("comments", "form"):
                at = main[-1] + 1
            elif kind in ("header", "nav"):
                at = main[0] if within else draw([0, main[0]])
            elif kind == "ad" or within:
                at = draw([main[-1] + 1, draw(main) + 1])
            else:
                at = draw([main[0], len(blocks), main[-1] + 1]) if kind != "footer" else len(blocks)
            blocks[at:at] = new
    return [b for b, _ in blocks], [y for _, y in blocks]


def runs_of(html: str, vectors: Vectors) -> list[Run]:
    """The blocks of a page with the labels that its structure gives them: one run of all
    blocks, or PAGE_RUNS of PAGE_BLOCKS together."""
    page = leaves(html)
    n, labels, runs = len(page), structure_labels(page), []
    many, size = (PAGE_RUNS, PAGE_BLOCKS // PAGE_RUNS) if n > PAGE_BLOCKS else (min(n, 1), n)
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    for k in range(many):
        first = (n - size) * k // max(many - 1, 1)
        blocks = []
        for leaf in page[first : first + size]:
            words = np.zeros(WORD_BINS + MEASURES, np.float32)
            vectors.words_of(leaf.text, words)
            blocks.append(Block(paths.setdefault(leaf.path, leaf.path), words, leaf.linked))
        runs.append(Run(blocks, labels[first : first + size], first / n, (first + size) / n))
    return runs


def _sent(runs: list[Run]) -> bytes:
    """Runs in plain types, for workers may have the classes under another identity."""
    return pickle.dumps(
        [([(b.path, b.words.tobytes(), b.linked) for b in r.blocks], r.labels, r.start, r.end) for r in runs]
    )


def _received(data: bytes) -> list[Run]:
    return [
        Run([Block(path, np.frombuffer(words, np.float32), linked) for path, words, linked in blocks], *rest)
        for blocks, *rest in pickle.loads(data)
    ]


@F.arrow_udf(BinaryType())
def sampled_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    vectors = Vectors()
    for pages in batches:
        yield pa.array([_sent(runs_of(p.as_py() or "", vectors)) for p in pages], pa.binary())


def learn(runs: list[Run]) -> Labeller | None:
    """Fit on the given runs and COPIES varied copies of each; none without any block."""
    rng = np.random.default_rng(SEED)
    texts = [block.words for run in runs for block in run.blocks]
    vectors, xs, ys = Vectors(), [], []
    for run in runs:
        for copy in range(COPIES + 1):
            own, y = varied(run.blocks, run.labels, texts, rng) if copy else (run.blocks, run.labels)
            xs.append(vectors.of(own, run.start, run.end))
            ys.append(y)
    return Labeller().fit(xs, ys) if xs else None


def main_texts(htmls: list[str], labeller: Labeller | None, vectors: Vectors) -> list[str]:
    """Main text of each page; pages of like length go through the network together.
    Without a labeller the structure of each page decides."""
    parsed = [leaves(h) for h in htmls]
    if labeller is None:
        return ["\n".join(leaf.text for leaf, y in zip(p, structure_labels(p)) if y) for p in parsed]
    out = [""] * len(htmls)
    order = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and len(parsed[order[upto]]) * (upto + 1 - at) <= STEP_BLOCKS:
            upto += 1
        own = order[at:upto]
        x, mask = filled([vectors.of(parsed[k]) for k in own])
        chance = labeller.scores(x, mask)
        for column, k in enumerate(own):
            out[k] = "\n".join(leaf.text for leaf, c in zip(parsed[k], chance[:, column]) if c >= 0.5)
        at = upto
    return out


def _extractor(shared):
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller, vectors = Labeller.of(shared.value), Vectors()
        for pages in batches:
            texts = pages.to_pylist()
            found: list[str] = []
            for at in range(0, len(texts), 512):
                found += main_texts([t or "" for t in texts[at : at + 512]], labeller, vectors)
            yield pa.array(found, pa.string())

    return F.arrow_udf(extract, "string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, give the empty text. Ids may be null
    or repeat; each row is answered. Pages of any length are learned from; if none of the
    sample has a block, the structure of each page decides. An empty table gives no rows.
    """
    spark = pages.sparkSession
    named = pages.where(F.length("html") > 0).select("page_id", "html", F.xxhash64("html").alias("digest"))
    chosen = named.select("page_id", "digest").distinct()
    chosen = chosen.orderBy(F.xxhash64("page_id"), "page_id", "digest").limit(SAMPLE_PAGES)
    chosen = F.broadcast(written(chosen, "sample"))  # at most SAMPLE_PAGES pairs of numbers
    same = named["page_id"].eqNullSafe(chosen["page_id"]) & (named["digest"] == chosen["digest"])
    sample = named.join(chosen, same, "left_semi").dropDuplicates(["page_id", "digest"])
    sample = sample.select("page_id", "digest", sampled_runs("html").alias("runs"))
    found = sorted(sample.collect(), key=lambda r: (r["page_id"] is not None, r["page_id"], r["digest"]))
    labeller = learn([run for r in found for run in _received(r["runs"])])
    text = _extractor(spark.sparkContext.broadcast(labeller and labeller.p))("html")
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
