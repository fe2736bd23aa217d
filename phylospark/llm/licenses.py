"""License scans: MinHash bands over overlapping windows, then exact containment.

A text is words of letters and digits in lower case, and its shingles of five
words. A template with s shingles is sought in windows of w = 2**k >= 4s/3
shingles that begin every w/4 shingles, so some window holds every occurrence
whole and has at least the Jaccard similarity ``lowest_similarity`` to it; the
number of bands is chosen so that such a window shares a band with the template
with probability ``1 - miss``. Around windows that do, the template's
shingles are looked up exactly. Templates are few and small and go to every
task; texts stay where they are, so there is no exchange at all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm.license_texts import LICENSES

SHINGLE, SIMILARITY, MISS = 5, 0.8, 1e-4
WORD = re.compile(r"[^\W_]+")
#: Words handled at once in a task; the next texts wait for the next block.
BLOCK_WORDS = 400_000
#: Templates go to every task, so their total size is bounded.
TEMPLATE_BYTES = 64 << 20
FULL = np.uint64(2**64 - 1)

def collision_probability(similarity: float, rows: int, bands: int) -> float:
    """Chance that two sets of this Jaccard similarity agree in all rows of at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def window_size(shingles: int) -> int:
    return 1 << max(1, math.ceil(math.log2(shingles * 4 / 3)))


def lowest_similarity(shingles: int, containment: float = SIMILARITY) -> float:
    """Jaccard similarity of a template to the window around an occurrence that just passes."""
    found = math.ceil(containment * shingles)
    return found / (window_size(shingles) + shingles - found)


def bands_needed(shingles: int, containment: float = SIMILARITY, rows: int = 1, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - lowest_similarity(shingles, containment) ** rows))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of five words; ``words`` are word hashes."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        h ^= h >> np.uint64(29)
    return h


def permuted(hashes: np.ndarray, band: int) -> np.ndarray:
    h = (hashes ^ np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


class Templates:
    """What a task needs to know of the templates: shingles and, by window size and band, least hashes."""

    def __init__(self, texts: dict[str, str], containment: float = SIMILARITY, miss: float = MISS):
        self.containment = containment
        self.shingles, self.sizes = {}, {}
        self.bands: dict[tuple[int, int], dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
        for name, text in texts.items():
            words = WORD.findall(text.lower())
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.shingles[name] = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
            s = len(self.shingles[name])
            self.sizes[name] = window_size(s)
            hashes = shingle_hashes(word_hashes(words))
            for band in range(bands_needed(s, containment, 1, miss)):
                self.bands[self.sizes[name], band][int(permuted(hashes, band).min())].append(name)
        self.filters = {}
        for at, keys in self.bands.items():
            table = np.zeros(1 << 16, bool)
            table[np.array(list(keys), np.uint64) & np.uint64(0xFFFF)] = True
            self.filters[at] = table

    def candidates(self, hashes: np.ndarray, doc: np.ndarray) -> set[tuple[int, int, str]]:
        """(document, window's first shingle, template) for windows that share a band; ``doc`` numbers each shingle's document."""
        found = set()
        if not len(hashes):
            return found
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        starts = np.arange(len(doc))
        inside = starts - np.repeat(begins, np.diff(np.r_[begins, len(doc)]))
        # Blocks of 1, 2, 4 ... shingles of each text: which blocks of half the size begin one, and what window of so many blocks stays in its text.
        levels, step = [], 1
        while step <= max(1, max(self.sizes.values()) // 4):
            begin = np.flatnonzero(inside[starts] % step == 0)
            starts = starts[begin]
            whose = doc[starts]
            levels.append((step, begin, starts, whose, [whose[k:] == whose[:-k] for k in (1, 2, 3)]))
            step *= 2
        for band in sorted({b for _, b in self.bands}):
            least = permuted(hashes, band)
            for step, begin, starts, whose, same in levels:
                least = np.minimum.reduceat(least, begin) if step > 1 else least
                for size in sorted({w for w, b in self.bands if b == band and max(1, w // 4) == step}):
                    window = least.copy()
                    for k in range(1, size // step):  # a document's end shortens its last windows
                        window[:-k] = np.minimum(window[:-k], np.where(same[k - 1], least[k:], FULL))
                    keys = self.bands[size, band]
                    for i in np.flatnonzero(self.filters[size, band][window & np.uint64(0xFFFF)]):
                        for name in keys.get(int(window[i]), ()):
                            found.add((int(whose[i]), int(inside[starts[i]]), name))
        return found

    def windows(self, at: np.ndarray, found: list[tuple], name: str) -> list[tuple[int, int, float]]:
        """First and last shingle and containment of as many disjoint windows as reach the containment, the most similar of such choices; ``at`` are the places of template shingles ``found``."""
        total, size = len(self.shingles[name]), self.sizes[name]
        before, latest = np.full(len(at), -1), {}
        for i, shingle in enumerate(found):
            before[i], latest[shingle] = latest.get(shingle, -1), i
        n = len(at)
        ends = np.searchsorted(at, at + size).tolist()
        best, choice = [(0, 0.0)] * (n + 1), [None] * n  # from each place on: windows, and the sum of their similarities
        for i in range(n - 1, -1, -1):
            best[i] = best[i + 1]
            if (ends[i] - i) / total < self.containment:
                continue
            distinct = np.cumsum(before[i : ends[i]] < i)
            if distinct[-1] / total < self.containment:
                continue
            similar = np.where(distinct / total >= self.containment, distinct / (at[i : ends[i]] - at[i] + 1 + total - distinct), 0)
            for k in {int(similar.argmax()), int((similar > 0).argmax())}:
                count, rest = best[i + k + 1]
                if (got := (count + 1, rest + float(similar[k]))) >= best[i]:
                    best[i], choice[i] = got, (i + k, float(distinct[k] / total))
        out, i = [], 0
        while i < n:
            if choice[i]:
                out.append((int(at[i]), int(at[choice[i][0]]), choice[i][1]))
                i = choice[i][0]
            i += 1
        return out

    def verify(self, text: str, near: dict[str, list[int]]) -> list[tuple[str, int, int, float]]:
        """(template, start, end, containment) in characters, for templates near the given shingles."""
        spans = [m.span() for m in WORD.finditer(low)] if len(low := text.lower()) == len(text) else [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        if len(low) != len(text):  # lower case changed the length: offsets are of the original's words
            spans = [m.span() for m in WORD.finditer(text)]
            if len(spans) != len(words):
                spans = [(-1, -1)] * len(words)
        out = []
        for name, places in near.items():
            wanted, size = self.shingles[name], self.sizes[name]
            seen = sorted({i for p in places for i in range(max(0, p - size), min(len(words) - SHINGLE + 1, p + 2 * size)) if tuple(words[i : i + SHINGLE]) in wanted})
            for first, last, share in self.windows(np.array(seen, np.int64), [tuple(words[i : i + SHINGLE]) for i in seen], name):
                out.append((name, spans[first][0], spans[last + SHINGLE - 1][1], share))
        return out

    def scan(self, texts: list[str]) -> list[tuple[int, str, int, int, float]]:
        """(text's number, template, start, end, containment) of every match."""
        out, at = [], 0
        while at < len(texts):
            words, owner, first, size = [], [], at, 0
            while at < len(texts) and (size < BLOCK_WORDS or at == first):
                found = WORD.findall(texts[at].lower())
                if len(found) >= SHINGLE:
                    words.append(shingle_hashes(word_hashes(found)))
                    owner.append(np.full(len(words[-1]), at))
                size += len(found)
                at += 1
            if words:
                near: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
                for doc, place, name in sorted(self.candidates(np.concatenate(words), np.concatenate(owner))):
                    near[doc][name].append(place)
                for doc, places in near.items():
                    out += [(doc, *match) for match in self.verify(texts[doc], places)]
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = SIMILARITY, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where license templates stand in texts: ``doc_id, license, start, end, containment``.

    A match holds at least ``containment`` of the template's shingles within
    one window; ``start`` and ``end`` are places in code points. Matches of one
    template don't overlap, the choice with most of them and then the most
    similar one counts; matches of different templates may overlap, and each is
    given. Null texts and texts of fewer than five words match nothing; repeated
    rows each give their matches; an empty table gives no rows. Whole texts are
    read, however long; columns of other names play no part.
    """
    texts = LICENSES if templates is None else templates
    if sum(map(len, texts.values())) > TEMPLATE_BYTES:
        raise ValueError(f"templates go to every task and may have {TEMPLATE_BYTES} characters in all")

    def run(batches):
        known = Templates(texts, containment, miss)
        for b in batches:
            found = known.scan([t or "" for t in b["text"]])
            at, *rest = (list(x) for x in zip(*found)) if found else [[]] * 5
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[at] if at else pd.Series([], dtype="int64"), **dict(zip(("license", "start", "end", "containment"), rest))})

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = chosen.mapInPandas(run, "doc_id string, license string, start long, end long, containment double")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
