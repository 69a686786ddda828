"""Chunks that are like an earlier one of their document, left out: greedy first-wins inside of each document.

A document's chunks come together in one group; each is compared with the kept ones that no bound rules out. Shared
shingles are counted with all kept ones at once, which decides Jaccard and overlap; signatures are made only for pairs whose
Jaccard leaves them open, ratios where counts of runs do. So no edge leaves the group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.operators.dedup import PERMUTATIONS, REMEMBERED, RUNS, SHINGLE, SIMILAR, SKETCH, STEP, hashes_of, least_common, run_hashes, shingle_hashes, shingles_of

#: Buckets of the counts of runs of a text, for all lengths of runs.
WIDE = sum(wide for _, wide in SKETCH)
#: Jaccard from which signatures are compared: of less alike texts, 122 of 128 places agree with a probability below 1e-27.
CONTESTED = 0.5


def sketch(text: str) -> np.ndarray:
    """Counts of the runs of a text, of each length in turn, by a hash."""
    return np.concatenate([np.bincount((run_hashes(text, q) % np.uint64(wide)).astype(np.int64), minlength=wide) for q, wide in SKETCH]).astype(np.int32)


class Kept:
    """The kept texts of one document, and what finds those that a new one may be like.

    Shingles are numbered; those that the document has once (by `frequency`) are shared by no two texts and aren't looked up.
    `known` has hashes of shingles; `learn`, if given, makes those of some texts side by side and returns all."""

    def __init__(self, frequency: Counter, known: dict[str, np.ndarray], threshold: float, learn: Callable[[list[str]], dict[str, np.ndarray]] | None = None):
        self.frequency, self.known, self.threshold, self.learn = frequency, known, threshold, learn
        self.numbers, self.marked = {}, np.zeros(1024, bool)
        self.flat, self.starts, self.counts = np.zeros(1024, np.int32), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.used = 0
        self.texts, self.signatures = [], {}
        self.sketches, self.sizes = np.empty((0, WIDE), np.int32), np.empty(0, np.int64)

    def _signature(self, text: str) -> np.ndarray:
        if text not in self.signatures:
            known, grams = self.learn([text]) if self.learn else self.known, shingles_of(text)
            for g in grams:
                if g not in known:
                    known[g] = shingle_hashes(g, PERMUTATIONS)
            self.signatures[text] = np.array([known[g] for g in grams]).min(axis=0)
        return self.signatures[text]

    def _shared(self, own: np.ndarray) -> np.ndarray:
        """How many of some shingles each kept text has."""
        self.marked[own] = True
        found = np.add.reduceat(self.marked[self.flat[: self.used]], self.starts[: len(self.texts)], dtype=np.int64)
        self.marked[own] = False
        return found

    def _near(self, text: str, own: np.ndarray) -> np.ndarray:
        """The kept texts whose ratio with this one isn't ruled out by lengths and sketches."""
        sizes = self.sizes[: len(self.texts)]
        near = np.flatnonzero(2 * np.minimum(sizes, len(text)) >= self.threshold * (sizes + len(text)) - 1e-9)
        start = 0
        for q, wide in SKETCH:
            common = np.minimum(self.sketches[near, start : start + wide], own[start : start + wide]).sum(axis=1)
            near, start = near[common >= least_common(q, len(text), sizes[near], self.threshold) - 1e-9], start + wide
        return near

    def add(self, text: str) -> bool:
        """Whether a normalised text is like no kept one; then it is kept."""
        grams = shingles_of(text)
        # number 0 is no shingle: each kept text has it, so that none is without numbers
        own = np.array([0, *(self.numbers.setdefault(g, len(self.numbers) + 1) for g in grams if self.frequency[g] > 1)], np.int32)
        if len(self.numbers) >= len(self.marked):
            self.marked = np.zeros(2 * len(self.numbers) + 2, bool)
        counts = np.zeros(WIDE, np.int32)
        if self.texts:
            n, sizes = len(grams), self.counts[: len(self.texts)]
            common = self._shared(own[1:])
            least = np.minimum(sizes, n)
            if np.any(np.where(least > 0, common >= self.threshold * least, (sizes == 0) & (n == 0))):
                return False
            for i in np.flatnonzero((common > 0) & (common >= CONTESTED * (sizes + n - common))):
                if (self._signature(text) == self._signature(self.texts[i])).mean() >= self.threshold:
                    return False
        if text:
            counts = sketch(text)
            if self.texts and any(self._ratio(text, i) for i in self._near(text, counts)):
                return False
        self._keep(text, own, len(grams), counts)
        return True

    def _keep(self, text: str, own: np.ndarray, n: int, counts: np.ndarray) -> None:
        at, end = len(self.texts), self.used + len(own)
        if at == len(self.sizes):
            more = max(64, at)
            self.sketches, self.sizes = np.concatenate([self.sketches, np.zeros((more, WIDE), np.int32)]), np.concatenate([self.sizes, np.zeros(more, np.int64)])
            self.starts, self.counts = np.resize(self.starts, at + more), np.resize(self.counts, at + more)
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * end)
        self.flat[self.used : end], self.starts[at], self.counts[at], self.used = own, self.used, n, end
        self.sketches[at], self.sizes[at] = counts, len(text)
        self.texts.append(text)

    def _ratio(self, text: str, i: int) -> bool:
        least, before = self.threshold, self.texts[i]
        m, n = len(text), len(before)
        for q in RUNS:
            a, b = (Counter(run_hashes(x, q).tolist()) for x in (text, before))
            if sum((a & b).values()) < least_common(q, m, n, least) - 1e-9:
                return False
        return SequenceMatcher(None, text, before).ratio() >= least


#: Hashes of the shingles that this process has met, at most so many between two groups; groups of a worker share them.
_known: dict[str, np.ndarray] = {}


def hashed(texts: list[str]) -> dict[str, np.ndarray]:
    """Hashes of shingles, those of the texts among them; the new ones are made side by side."""
    new = list(set().union(*map(shingles_of, texts)).difference(_known))
    if len(_known) + len(new) > REMEMBERED:
        _known.clear()
        new = list(set().union(*map(shingles_of, texts)))
    for at in range(0, len(new), STEP):
        some = new[at : at + STEP]
        _known.update(zip(some, hashes_of(some, PERMUTATIONS)))
    return _known


def first_of_alike(chunks: DataFrame, key: str = "doc_id", order: str = "chunk", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """The rows of `chunks` whose text is like no kept one before it in the same document, by the largest of signature,
    Jaccard, overlap and sequence ratio. Null texts are like blank ones; of equal places the smaller text is first.

    Memory is that of one document's chunks and their shingles. A null key is a document."""
    names = chunks.columns

    def group(table: pa.Table) -> pa.Table:
        texts = [" ".join((x or "").lower().split()) for x in table.column(text).to_pylist()]
        places = table.column(order).to_pylist()
        turn = sorted(range(len(texts)), key=lambda i: (places[i] is None, places[i] or 0, texts[i]))
        frequency = Counter(x[i : i + SHINGLE] for x in texts for i in range(max(1, len(x) - SHINGLE + 1)))
        kept = Kept(frequency, _known, threshold, hashed)
        return table.take(pa.array([i for i in turn if kept.add(texts[i])], pa.int64()))

    return chunks.select(*names).groupBy(key).applyInArrow(group, chunks.schema)
