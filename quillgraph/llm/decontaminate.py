"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of lower-cased words: runs of letters, marks,
digits and connectors of any script; a letter of a script that sets no spaces
between words is a word. An item of W words is leaked where it occurs in a text
with at most ``k = floor((1 - SIMILARITY) * W)`` word edits.

An item is cut into equal sections of at most ``REACH`` words, as the more edits
lie before a word, the less likely walks still agree there; wherever the edits
lie, some section has no more of them for its words than the whole item. A
window is as long as its section. With e edits at least one of e + 1 equal parts
is untouched, so windows are laid only where a run of ``W // (k + 1)`` words
equals one of the section's; that loses nothing, and where k is 0 (items of
under five words) such a run is the whole item and is reported as it is. A
window belongs to the text of its run; where it reaches beyond that text's ends
(an item that lacks its first or last words) the words there are read as none.
Windows and sections are embedded by a CGK random walk: step j puts out the
current word and moves on if a random bit of (j, word) says so, which keeps
words that edits shifted aligned. A repetition samples ``SAMPLED`` positions of a
walk as its key. With ``WALKS * PER_WALK`` repetitions a window at the threshold
shares a key with its section with a chance above ``RECALL``, whether words are
replaced, inserted, deleted or all of these, all over an item or in one place, at
5 to 1,000 words (the tests measure it). Pairs with
a common key are verified exactly with Myers' bit-parallel edit distance of the
whole item against the window's surroundings.

Items travel to the tasks in blocks of ``BLOCK``, one pass over the texts a
block; texts are never shuffled. A block's matcher is built once, written to
the shared folder and read by the workers, which hold one at a time, so memory
does not grow with the benchmark.

Defined cases: a null or empty text has no words and leaks nothing; an item
that is null or has no words is not searched; an item of one to four words is
leaked where it occurs exactly; repeated rows are each reported; very long texts
are searched whole; empty tables give no rows; more columns are ignored, or kept
by ``drop_leaks``.
"""

from __future__ import annotations

import pickle
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import AtomicFile, new_dir, process_cache, resolve

SIMILARITY = 0.8
WALKS = 16
PER_WALK = 6
SAMPLED = 2
REACH = 100
RECALL = 0.95
BLOCK = 20000
PIECE = 1 << 20
FOUND = "doc_id long, item_id long, edits int, similarity double, end_word long"

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Scripts that set no spaces between words: each of their letters is a word.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_CUT = regex.compile(rf"\W|[{UNSPACED}]")
_LAST = 0x40000


def _classes() -> np.ndarray:
    """Per code point: 2 a word of its own, 1 a letter, mark, digit or connector, 0 anything else (as all beyond ``_LAST``)."""
    out = np.zeros(_LAST + 1, np.uint8)
    for code, kind in ((1, r"\w"), (2, rf"(?=\w)[{UNSPACED}]")):
        out[[m.start() for m in regex.finditer(kind, "".join(map(chr, range(_LAST))))]] = code
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ U(salt & (1 << 64) - 1)) * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _words_of_piece(text: str) -> np.ndarray:
    """A hash of each word: a polynomial over its code points, from running sums of the piece."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = process_cache("word_classes", _classes)[np.minimum(points, _LAST)]
    letter, alone = kind == 1, kind == 2
    first, last = alone | letter, alone | letter
    first[1:] &= alone[1:] | ~letter[:-1]
    last[:-1] &= alone[:-1] | ~letter[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, U)
    powers, inverse = _power_tables(len(points))
    sums = np.zeros(len(points) + 1, U)
    np.cumsum((points.astype(U) + U(1)) * powers[: len(points)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start], 1) | U(1)


_TABLES: list[np.ndarray] = []


def _power_tables(n: int):
    if not _TABLES or len(_TABLES[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            back = pow(_BASE, -1, 1 << 64)
            _TABLES[:] = [np.cumprod(np.append(U(1), np.full(size - 1, x, U)), dtype=U) for x in (_BASE, back)]
    return _TABLES


def words_of(text: str | None) -> np.ndarray:
    """Hashes of all words of a whole text; long texts are read in pieces that end between words."""
    data, at, parts = (text or "").lower(), 0, []
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = _CUT.search(data, end)
            end = cut.start() if cut else len(data)
        parts.append(_words_of_piece(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, U)


def embed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, stops: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """CGK: one row of ``steps`` outputs per window (0 after its end and outside of its text, firsts to stops)."""
    out = np.zeros((len(starts), steps), U)
    i = np.zeros(len(starts), np.int64)
    last = len(words) - 1
    for j in range(steps):
        at = starts + i
        here = np.where((i < sizes) & (at >= firsts) & (at < stops), words[np.clip(at, 0, last)], U(0))
        out[:, j] = here
        i += (_mix(here, walk * 1_000_003 + j + 7) >> U(63)).astype(np.int64)
    return out


def edits_within(peq: dict[int, int], n: int, words: list[int], most: int) -> tuple[int, int] | None:
    """(fewest edits, end) of an item within ``words``, or None beyond ``most``: Myers' bit-parallel search."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, None
    for at, w in enumerate(words):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def sections(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the sections of an item of ``n`` words."""
    parts = -(-n // REACH)
    cuts = [n * j // parts for j in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    """A block of items, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, walks=WALKS, per_walk=PER_WALK, sampled=SAMPLED):
        found = [(i, w) for i, t in items if len(w := words_of(t))]
        self.ids = [i for i, _ in found]
        self.words = [w for _, w in found]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.most = np.array([int((1 - similarity) * len(w) + 1e-9) for w in self.words], np.int64)
        self.walks, self.per_walk = walks, per_walk
        self.peq: list[dict[int, int]] = []
        for w in self.words:
            at: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                at[x] = at.get(x, 0) | 1 << i
            self.peq.append(at)
        cut = [(i, a, n) for i, size in enumerate(self.size.tolist()) for a, n in sections(size)]
        self.section_item, self.section_at, self.section_size = np.array(cut, np.int64).reshape(-1, 3).T
        # sampled positions by section size; W words come out in some 2 W steps
        rng = np.random.default_rng(11)
        self.sample = {int(s): rng.integers(0, 2 * s, (walks, per_walk, sampled)) for s in np.unique(self.section_size)}
        self.steps = 2 * int(self.section_size.max()) if len(found) else 0
        self.whole: dict[int, list[int]] = {}
        for i in np.flatnonzero(self.most == 0).tolist():
            self.whole.setdefault(int(self._runs(self.words[i], len(self.words[i]))[0]), []).append(i)
        self._seeds()
        self._keys()

    def _seeds(self) -> None:
        """Per run length: sorted run hashes with their sections' offsets and sizes."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for w, n, k in zip(self.words, self.size.tolist(), self.most.tolist(), strict=True):
            g = n // (k + 1)
            if k == 0:  # the run is the item: any run of its length that equals it is an occurrence
                rows.setdefault(g, []).append((int(self._runs(w, g)[0]), 0, 0))
                continue
            for a, m in sections(n):
                rows.setdefault(g, []).extend(zip(self._runs(w[a : a + m], g).tolist(), range(m - g + 1), [m] * (m - g + 1), strict=True))
        self.seeds = {}
        for g, got in rows.items():
            got = sorted(set(got))
            self.seeds[g] = (np.array([r[0] for r in got], U), np.array([r[1] for r in got], np.int64), np.array([r[2] for r in got], np.int64))
        self.maps = {}
        for g, (h, _, _) in self.seeds.items():
            self.maps[g] = np.zeros(1 << 20, bool)
            self.maps[g][(h >> U(44)).astype(np.int64)] = True

    @staticmethod
    def _runs(words: np.ndarray, g: int) -> np.ndarray:
        n = len(words) - g + 1
        h = np.zeros(max(n, 0), U)
        for i in range(g if n > 0 else 0):
            h = h * U(_BASE) + words[i : i + n]
        return _mix(h, 3)

    def _keys_of(self, words, starts, sizes, firsts, stops):
        """Keys of all repetitions, one row per window."""
        out = np.zeros((len(starts), self.walks * self.per_walk), U)
        for walk in range(self.walks):
            e = embed(words, starts, sizes, firsts, stops, walk, self.steps)
            for s in np.unique(sizes):
                rows = np.flatnonzero(sizes == s)
                for rep in range(self.per_walk):
                    key = np.full(len(rows), int(s) << 16 | walk << 8 | rep, U)
                    for p in self.sample[int(s)][walk, rep]:
                        key = _mix(key * U(_BASE) + e[rows, p], 5)
                    out[rows, walk * self.per_walk + rep] = key
        return out

    def _keys(self) -> None:
        self.keys, self.key_section = np.zeros(0, U), np.zeros(0, np.int64)
        if not self.ids:
            return
        words = np.concatenate(self.words)
        starts = np.concatenate([[0], np.cumsum(self.size)[:-1]])[self.section_item] + self.section_at
        keys = self._keys_of(words, starts, self.section_size, starts, starts + self.section_size)
        section = np.repeat(np.arange(len(starts)), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.key_section = keys.ravel()[order], section[order]

    def windows(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, set]:
        """(rows, starts, sizes) of the windows that share an untouched run with a section, and the exact (row, start, item) of short items.

        ``ends`` are the places after each text's gap. A start may lie before
        its text, so it is counted as if the longest section's words were free there.
        """
        found, exact, free = [], set(), int(self.section_size.max())
        for g, (h, offset, size) in self.seeds.items():
            runs = self._runs(words, g)
            maybe = np.flatnonzero(self.maps[g][(runs >> U(44)).astype(np.int64)])
            lo, hi = np.searchsorted(h, runs[maybe], "left"), np.searchsorted(h, runs[maybe], "right")
            n = hi - lo
            at = np.repeat(maybe, n)
            pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            row = np.searchsorted(ends, at, "right")
            short = size[pick] == 0
            if short.any():
                same = np.unique(np.stack([row[short], h[pick[short]].view(np.int64), at[short]]), axis=1)
                first = np.ones(same.shape[1], bool)  # a text's first occurrence is as good as any
                first[1:] = (same[:2, 1:] != same[:2, :-1]).any(axis=0)
                for r, run, start in same[:, first].T.tolist():
                    exact.update((r, start, i) for i in self.whole.get(run & (1 << 64) - 1, ()) if int(self.size[i]) == g)
                at, row, pick = at[~short], row[~short], pick[~short]
            found.append(at - offset[pick] + (row + 1) * free << 20 | size[pick])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        starts = both >> 20
        rows = np.searchsorted(ends + np.arange(1, len(ends) + 1) * free, starts, "right")
        return rows, starts - (rows + 1) * free, both & (1 << 20) - 1, exact

    def candidates(self, words: np.ndarray, ends: np.ndarray):
        """(row, start, item) triples with a common key; the start is the item's, counted back from its section's."""
        rows, starts, sizes, pairs = self.windows(words, ends)
        firsts, stops = np.concatenate([[0], ends[:-1]]), ends - 1
        for at in range(0, len(starts), 4096):
            r, s, z = rows[at : at + 4096], starts[at : at + 4096], sizes[at : at + 4096]
            keys = self._keys_of(words, s, z, firsts[r], stops[r])
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for row, col in zip(*np.nonzero(hi > lo), strict=True):
                own = self.key_section[lo[row, col] : hi[row, col]]
                pairs.update(zip([int(r[row])] * len(own), (s[row] - self.section_at[own]).tolist(), self.section_item[own].tolist(), strict=True))
        return pairs

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, float, int]]:
        """(row, item_id, edits, similarity, end_word) of each text's best occurrence of each leaked item."""
        if not self.ids or not texts:
            return []
        parts = [words_of(t) for t in texts]
        gap = np.zeros(1, U)
        words = np.concatenate([x for p in parts for x in (p, gap)])  # a word of its own between texts
        ends = np.cumsum([len(p) + 1 for p in parts])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, start, item in sorted(self.candidates(words, ends)):
            first, stop = (int(ends[row - 1]) if row else 0), int(ends[row]) - 1
            k, n = int(self.most[item]), int(self.size[item])
            if (row, item) in best and best[row, item][0] == 0:
                continue
            a, peq = max(first, start - k), self.peq[item]
            near = words[a : min(stop, start + n + 2 * k)].tolist()
            if sum(map(peq.__contains__, near)) < n - k:  # k edits leave n - k of the item's words
                continue
            if got := edits_within(peq, n, near, k):
                if (row, item) not in best or got[0] < best[row, item][0]:
                    best[row, item] = (got[0], a - first + got[1])
        return [(r, self.ids[i], e, 1 - e / int(self.size[i]), end) for (r, i), (e, end) in sorted(best.items())]


def _matchers(benchmark: DataFrame, block: int, similarity: float):
    """A path per block of items, to its pickled matcher in the shared folder; one matcher is in memory at a time."""
    rows = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    folder, it = new_dir(benchmark.sparkSession, "benchmark"), (tuple(r) for r in rows.toLocalIterator())
    for n in count():
        if not (got := list(islice(it, block))):
            return
        with AtomicFile(f"{folder}/{n:06d}.pickle") as out:
            out.write(pickle.dumps(Matcher(got, similarity), protocol=5))
        yield f"{folder}/{n:06d}.pickle"


def _load(path: str) -> Matcher:
    """The matcher at ``path``; a worker keeps the last one that it read."""
    held = process_cache("matcher", dict)
    if path not in held:
        held.clear()
        fs, name = resolve(path)
        with fs.open_input_stream(name, compression=None) as raw:
            held[path] = pickle.loads(raw.read())
    return held[path]


def _grouped(texts: list[str | None]):
    """Index ranges of some PIECE characters together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= PIECE):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, similarity, end_word: each document's best occurrence of each item it leaks."""
    passes = []
    for path in _matchers(benchmark, block, similarity):

        def scan(batches, path=path):
            matcher = _load(path)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for a, b in _grouped(texts):
                    if got := matcher.search(texts[a:b]):
                        row, item, edits, near, end = zip(*got, strict=True)
                        columns = [pa.array([ids[a + r] for r in row], pa.int64()), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(near, pa.float64()), pa.array(end, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "similarity", "end_word"])

        passes.append(docs.select("doc_id", "text").mapInArrow(scan, FOUND))
    if not passes:
        return docs.sparkSession.createDataFrame([], FOUND)
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item."""
    for path in _matchers(benchmark, block, similarity):
        docs = docs.filter(_clean(path)("text"))
    return docs


def _clean(path: str):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        matcher, values, out = _load(path), texts.tolist(), np.ones(len(texts), bool)
        for a, b in _grouped(values):
            for row, *_ in matcher.search(values[a:b]):
                out[a + row] = False
        return pd.Series(out)

    return clean
