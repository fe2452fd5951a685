"""Text that was decoded with a wrong character encoding: finding it and restoring the original.

1. Adjacent character pairs are counted over all texts.
2. Each pair of a text that has a character beyond ASCII is scored by its mutual information in the corpus, in the form
   ``log p(ab)**3 / p(a) p(b)``: the cube keeps rare characters that only ever meet each other, as those of garbled
   text do, from looking probable. A pair of ASCII characters is the same in all encodings, so nothing is scored there.
3. Improbable runs are the maximum-scoring segments of ``threshold - score``, found over all scored pairs of a text. As
   garbling makes some pairs frequent, a segment may end inside a garbled character; it is completed to the stretches
   beyond ASCII that it touches.
4. Only within such runs inverse mappings are tried: the characters are encoded by the supposed wrong encoding, and the
   bytes decoded by the supposed true one. A mapping counts if it succeeds and makes the run more probable, together
   with its neighbours, under the corpus' pair probabilities; the gain is the difference of log probabilities. Where it
   fails on a run as a whole, it is tried on its East Asian and other parts, and on the maximum-scoring segments
   within it, so that sound characters right beside garbled ones do no harm.
5. UTF-8 rarely decodes by chance, so one run that gains by it is enough; other encodings need gains that add up.
   U+FFFD, which a decoder leaves of bytes it cannot read, marks a text if it lies in an improbable run.
6. In a text that is known to be garbled improbable runs are sought again with a higher threshold, and only in these
   the best mapping is undone, where it gains: again and again for text that was garbled more than once.

Pair counts reach the workers as a sketch of fixed size (two rows of 2**21 counters, the lesser one counts), and
character counts as tables of the size of Unicode, so what is broadcast does not grow with the corpus.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged

SKETCH_BITS = 21
UNICODE = 0x110000
#: Pairs with a score below this are improbable (nats).
THRESHOLD = -16.0
#: The same in a text that is known to be garbled, which is restored within such runs only.
RAISED = -6.0
#: Share of a character's successors that is left to any character by its own frequency.
UNSEEN = 0.1
#: Gain in nats that one run needs with UTF-8 as the true encoding.
UTF8_GAIN = 1.0
#: Gain in nats that all runs need together with another one, after what each must gain first.
OTHER_GAIN, OTHER_TOLL = 4.0, 1.5
#: Gain in nats of a part of a run that decodes as UTF-8 where the run as a whole does not.
PART_GAIN = 6.0
#: Runs a worker remembers.
MEMO_ENTRIES = 100_000

# Encodings by their names in Python.
SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman")
DOUBLE = ("gbk", "cp932", "big5", "euc-kr")
UTF8_READ_AS = SINGLE + DOUBLE
DOUBLE_READ_AS = {"gbk": ("latin-1", "cp1252"), "big5": ("latin-1", "cp1252", "gbk"), "cp932": ("latin-1", "cp1252", "gbk"), "euc_jp": ("latin-1", "cp1252", "gbk"), "euc-kr": ("latin-1", "cp1252")}
CYRILLIC = ("cp1251", "koi8-r", "cp866")
CYRILLIC_READ_AS = ("latin-1", "cp1252", "mac_roman", *CYRILLIC)
LATIN_READ_AS = ("cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "gbk")

TO_UTF8 = [(w, "utf-8") for w in UTF8_READ_AS]
TO_SINGLE = [(w, t) for t in CYRILLIC for w in CYRILLIC_READ_AS if w != t] + [(w, "cp1252") for w in LATIN_READ_AS]
TO_DOUBLE = [(w, t) for t, ws in DOUBLE_READ_AS.items() for w in ws]

NARROW = re.compile(r"[^\x00-\x7f]+")
#: The second byte of a double-byte character may be an ASCII one.
WIDE = re.compile(r"(?:[^\x00-\x7f]+[@-~]?)+")
#: East Asian characters, which a run of other garbled ones may adjoin, and the rest.
SPLIT = re.compile(r"[\u2e80-\uf8ff\ufe30-\ufe4f\uff00-\uffef]+|[^\x00-\x7f\u2e80-\uf8ff\ufe30-\ufe4f\uff00-\uffef]+")
SPLIT_WIDE = re.compile(r"(?:[\u2e80-\uf8ff\ufe30-\ufe4f\uff00-\uffef]+[@-~]?)+|(?:[^\x00-\x7f\u2e80-\uf8ff\ufe30-\ufe4f\uff00-\uffef]+[@-~]?)+")
LOST = "\ufffd"
#: Characters that no single-byte encoding has.
EAST = re.compile(r"[\u2e80-\uf8fe]")
#: Punctuation that stands by itself in any text; unless it is inside a word, it is no evidence for single bytes.
ORDINARY = frozenset("…–—‘’‚“”„°•")


def _lenient(name: str):  # noqa: ANN202
    """The characters of a single-byte encoding, undefined bytes being control characters as many decoders have it."""
    table = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))
    return codecs.charmap_build(table)


_CHARMAPS = {name: _lenient(name) for name in SINGLE}


def _pattern(wrong: str, wide: bool) -> re.Pattern:
    """Runs of characters beyond ASCII that an encoding has; ``wide`` allows for ASCII second bytes."""
    if wrong in SINGLE:
        own = "".join(re.escape(bytes([b]).decode(wrong, "ignore") or chr(b)) for b in range(128, 256))
        return re.compile(f"(?:[{own}]+[@-~]?)+" if wide else f"[{own}]+")
    return WIDE if wide else NARROW


_PATTERNS = {m: _pattern(m[0], m in TO_DOUBLE) for m in TO_UTF8 + TO_SINGLE + TO_DOUBLE}


def to_bytes(text: str, name: str) -> bytes | None:
    """``text`` in an encoding, or null if it has other characters."""
    try:
        if name in _CHARMAPS:
            return codecs.charmap_encode(text, "strict", _CHARMAPS[name])[0]
        return text.encode(name)
    except UnicodeError:
        return None


def inverse(text: str, wrong: str, true: str) -> str | None:
    """What ``text`` was before bytes of the encoding ``true`` were read as ``wrong``; null if that cannot be."""
    return inverses(text, {wrong: [true]}).get((wrong, true))


def inverses(text: str, mappings: dict[str, list[str]]) -> dict[tuple[str, str], str]:
    """All that ``text`` may have been, by mapping; ``mappings`` has the true encodings of each wrong one."""
    out = {}
    east = EAST.search(text) is not None
    for wrong, trues in mappings.items():
        raw = None if east and wrong in _CHARMAPS else to_bytes(text, wrong)
        if raw is not None:
            for true in trues:
                try:
                    back = raw.decode(true)
                except UnicodeError:
                    continue
                if back != text:
                    out[wrong, true] = back
    return out


_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


def utf8_stretches(run: str, wrong: str) -> list[tuple[int, int]]:
    """Longest stretches of characters whose bytes in the encoding ``wrong`` are UTF-8 beyond ASCII; of at least three
    bytes in double-byte encodings."""
    if wrong in _CHARMAPS:
        return [m.span() for m in _UTF8.finditer(to_bytes(run, wrong) or b"")]
    raw = run.encode(wrong, "replace")
    spans, size = [m.span() for m in _UTF8.finditer(raw) if m.end() - m.start() >= 3], len(raw)
    if not spans:
        return spans
    if size == 2 * len(run):
        return [(a // 2, b // 2) for a, b in spans if not (a | b) & 1]
    border = {e: k for k, e in enumerate(np.cumsum([0, *(len(c.encode(wrong, "replace")) for c in run)]).tolist())}
    return [(border[a], border[b]) for a, b in spans if a in border and b in border]


def _by_wrong(mappings: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for wrong, true in mappings:
        out.setdefault(wrong, []).append(true)
    return out


NARROW_TRIES, WIDE_TRIES = _by_wrong(TO_UTF8 + TO_SINGLE), _by_wrong(TO_DOUBLE)


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """All disjoint contiguous segments of maximum positive score, in one pass over the scores."""
    stack: list[list] = []  # [start, end, sum before, sum after]
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b) for a, b, _, _ in stack]


# --- pair statistics ----------------------------------------------------------------------------------------------


def _codes(texts: str) -> np.ndarray:
    return np.frombuffer(texts.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def pair_counts(documents: DataFrame, text: str) -> DataFrame:
    """``(pair, n)`` over all texts; ``pair`` is the first code point times 2**21 plus the second. Texts are thought to
    stand between line ends. Null texts are left out."""

    def count(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for part in _parts(batch.column(0)):
                codes = _codes("\n" + "\n".join(part) + "\n")
                pairs, n = np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    found = documents.select(F.col(text).cast("string").alias("t")).dropna().mapInArrow(count, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def _parts(column: pa.Array, most: int = 1 << 21):  # noqa: ANN202
    """The texts of a batch in lists of about ``most`` characters."""
    part, size = [], 0
    for t in column.to_pylist():
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _slots(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of a pair in the two rows of the sketch."""
    p = pair.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (p ^ (p >> np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
        other = (p + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), (other >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + (1 << SKETCH_BITS)


class PairStatistics:
    """Pair and character counts of a corpus in tables of fixed size."""

    def __init__(self, sketch: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.sketch, self.first, self.second = sketch, first, second
        self.total = max(1.0, float(first.sum()))

    @classmethod
    def of(cls, counts: DataFrame) -> PairStatistics:
        """From the table of ``pair_counts``; at most two rows of counters and two of characters are fetched."""

        def place(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                a, b = _slots(pair)
                base = 2 << SKETCH_BITS
                at = np.concatenate([a, b, base + (pair >> 21), base + UNICODE + (pair & (1 << 21) - 1)])
                used, owner = np.unique(at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.bincount(owner, np.tile(n, 4)).astype(np.int64))], ["at", "n"])

        cells = counts.mapInArrow(place, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
        table = np.zeros((2 << SKETCH_BITS) + 2 * UNICODE, np.float32)
        fetched = cells.toArrow()
        table[fetched.column("at").to_numpy()] = fetched.column("n").to_numpy()
        base = 2 << SKETCH_BITS
        return cls(table[:base], table[base : base + UNICODE], table[base + UNICODE :])

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """How often each adjacent pair of ``codes`` occurs, or somewhat more."""
        a, b = _slots(codes[:-1] << 21 | codes[1:])
        return np.minimum(self.sketch[a], self.sketch[b])

    def scores_at(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Cubed mutual information of the pairs that begin at the places ``at``."""
        one, two = codes[at], codes[at + 1]
        a, b = _slots(one << 21 | two)
        n = np.maximum(np.minimum(self.sketch[a], self.sketch[b]), 0.5).astype(float)
        return np.log(n * n / np.maximum(self.first[one], 0.5) * n / np.maximum(self.second[two], 0.5)) - np.log(self.total)

    def log_probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of the log probabilities of each character after the one before it, and what it owes
        to pairs within it: how far they, without the first and last pair, are more frequent than their characters
        alone. Texts have at least two characters."""
        codes = _codes("".join(texts))
        sizes = np.array([len(t) for t in texts])
        ends = sizes.cumsum()
        begins = ends - sizes
        alone = (self.second[codes[1:]] + 0.01) / self.total
        each = np.log((1 - UNSEEN) * self.pairs(codes) / np.maximum(self.first[codes[:-1]], 1.0) + UNSEEN * alone)
        bonus = np.maximum(each - np.log(alone), 0.0)
        each[ends[:-1] - 1] = 0.0  # from one text to the next
        for outer in (ends[:-1] - 1, begins, ends - 2):
            bonus[outer] = 0.0
        return np.add.reduceat(each, begins), np.add.reduceat(bonus, begins)


# --- decisions ----------------------------------------------------------------------------------------------------


class Repairer:
    """Decides on texts and restores them, given the statistics of the corpus."""

    def __init__(self, statistics: PairStatistics):
        self.statistics = statistics
        self._memo: dict[tuple, list] = {}
        self._ready: dict[tuple, list] = {}

    def prepare(self, texts: list[str], runs: list[list[list[int]]]) -> list[tuple[Counter, Counter]]:
        """The runs of each text with their neighbours, narrow and wide, and how often. All mappings of all runs that
        are not known yet are weighed at once."""
        counted = [(self._around(t, r), self._around(t, self._widened(t, r))) for t, r in zip(texts, runs)]
        self._ready.clear()
        for k, (kind, mappings) in enumerate((("n", NARROW_TRIES), ("d", WIDE_TRIES))):
            new = [key for key in dict.fromkeys(key for c in counted for key in c[k]) if (kind, *key) not in self._memo]
            self._ready.update(((kind, *key), found) for key, found in zip(new, self._weighed(new, mappings)))
        return counted

    @staticmethod
    def _around(text: str, spans: list[list[int]]) -> Counter:
        text = "\n" + text + "\n"
        return Counter([(text[a], text[a + 1 : b + 1], text[b + 1]) for a, b in spans])

    @staticmethod
    def _widened(text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
        """The stretches that hold ``runs`` if second bytes may be ASCII."""
        spans, last = [], 0
        for a, b in runs:
            if a >= last:
                first = a
                while first >= 2 and ("@" <= text[first - 1] <= "~" and text[first - 2] > "\x7f"):
                    first = next((k + 1 for k in range(first - 3, -1, -1) if text[k] <= "\x7f"), 0)
                last = WIDE.match(text, max(first, last)).end()
                spans.append((max(first, spans[-1][1] if spans else 0), last))
        return spans

    def segments(self, codes: np.ndarray, threshold: float) -> np.ndarray:
        """Spans (begin, end) of the characters of all maximum-scoring segments of ``threshold - score``.

        Pairs of ASCII characters and line ends part the pairs into clusters; no segment crosses them.
        """
        beyond = codes >= 128
        at = np.flatnonzero(beyond[:-1] | beyond[1:])
        if not len(at):
            return np.zeros((0, 2), np.int64)
        value = threshold - self.statistics.scores_at(codes, at)
        high = value > 0
        parted = np.r_[True, (np.diff(at) != 1) | (codes[at[1:]] == 10)]
        first = np.flatnonzero(parted | np.r_[True, high[1:] != high[:-1]])  # blocks of one sign
        after = np.r_[first[1:], len(at)]
        cluster = np.cumsum(parted)[first]
        up = np.flatnonzero(high[first])
        if not len(up):
            return np.zeros((0, 2), np.int64)
        # A block without another one in its cluster is a segment; otherwise blocks are weighed against each other.
        alone = np.r_[True, cluster[up][1:] != cluster[up][:-1]] & np.r_[cluster[up][1:] != cluster[up][:-1], True]
        begin, end = first[up[alone]], after[up[alone]]
        many = up[~alone]
        if len(many):
            total = np.add.reduceat(value, first)
            stops = np.flatnonzero(np.r_[True, cluster[many][1:] != cluster[many][:-1], True])
            found = [(lo + a, lo + b) for s, e in zip(stops[:-1], stops[1:]) for lo in (many[s],) for a, b in maximal_segments(total[lo : many[e - 1] + 1].tolist())]
            spans = np.array(found, np.int64)
            begin, end = np.r_[begin, first[spans[:, 0]]], np.r_[end, after[spans[:, 1] - 1]]
            order = np.argsort(begin)
            begin, end = begin[order], end[order]
        return np.column_stack([at[begin], at[end - 1] + 2])

    def improbable(self, codes: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        """Pairs (begin, end) of the stretches beyond ASCII that a maximum-scoring segment touches."""
        edge = np.flatnonzero(np.diff(np.r_[0, (codes >= 128).astype(np.int8), 0]))
        begin, end = edge[::2], edge[1::2]
        spans = self.segments(codes, threshold)
        lo, hi = np.searchsorted(end, spans[:, 0], side="right"), np.searchsorted(begin, spans[:, 1])
        touched = np.zeros(len(begin) + 1, np.int64)
        np.add.at(touched, lo, 1)
        np.add.at(touched, hi, -1)
        keep = np.cumsum(touched[:-1]) > 0
        return np.column_stack([begin[keep], end[keep]])

    def gains(self, before: str, run: str, after: str, mappings: dict[str, list[str]], kind: str) -> list[tuple[float, tuple[str, str]]]:
        """``(gain, mapping)`` of the mappings that make a run more probable, or else its East Asian and other parts."""
        key = (kind, before, run, after)
        known = self._memo.get(key)
        if known is None:
            known = self._ready.get(key)
            if known is None:
                known = self._tried(before, run, after, mappings)
            if not known and len(parts := (SPLIT if kind == "n" else SPLIT_WIDE).findall(run)) > 1:
                around = [before, *parts, after]
                known = [g for k, part in enumerate(parts) for g in self.gains(around[k][-1], part, around[k + 2][0], mappings, kind)]
            if kind == "n" and not any(m[1] == "utf-8" for _, m in known):
                known = known + [(g, m) for g, m, _, _ in self.isolated(before, run, after, mappings)]
            if len(self._memo) >= MEMO_ENTRIES:
                self._memo.clear()
            self._memo[key] = known
        return known

    def _tried(self, before: str, run: str, after: str, mappings: dict[str, list[str]]) -> list[tuple[float, tuple[str, str]]]:
        return self._weighed([(before, run, after)], mappings)[0]

    def _weighed(self, keys: list[tuple[str, str, str]], mappings: dict[str, list[str]]) -> list[list[tuple[float, tuple[str, str]]]]:
        """For each ``(before, run, after)`` the mappings that make the run more probable, with their gains."""
        texts: list[str] = []
        tried = []
        for before, run, after in keys:
            backs = inverses(run, mappings)
            if backs and ORDINARY.issuperset(run) and not (before + after).isalpha():
                backs = {m: back for m, back in backs.items() if m[1] == "utf-8"}
            if backs:
                place = {back: len(texts) + 1 + k for k, back in enumerate(dict.fromkeys(backs.values()))}
                tried.append((len(texts), [(place[back], m) for m, back in backs.items()]))
                texts.append(before + run + after)
                texts += [before + back + after for back in place]
            else:
                tried.append((0, ()))
        if not texts:
            return [[] for _ in keys]
        sums, bonus = (v.tolist() for v in self.statistics.log_probabilities(texts))
        # Pairs of characters that UTF-8 makes of one are frequent only because texts were garbled.
        weighed = [[(sums[k] - sums[own] + (bonus[own] if m[1] == "utf-8" else 0.0), m) for k, m in ways] for own, ways in tried]
        return [[(g, m) for g, m in ways if g > 0] for ways in weighed]

    def isolated(self, before: str, run: str, after: str, mappings: dict[str, list[str]]) -> list[tuple[float, tuple[str, str], int, int]]:
        """``(gain, mapping, begin, end)`` of the parts of a run that gain where the run as a whole does not.

        Parts are maximum-scoring segments of ``threshold - score`` over the pairs of the run and its borders, the
        threshold being the run's mean score if that is lower. The byte patterns of UTF-8 tell how far the part reaches
        that meets a segment. In single bytes such patterns form by chance within other encodings, so they must gain
        more.
        """
        if len(run) < 3:
            return []
        stretches = [(w, a, b) for w in DOUBLE if "utf-8" in mappings.get(w, ()) for a, b in utf8_stretches(run, w) if b - a < len(run)]
        single = [w for w in SINGLE if "utf-8" in mappings.get(w, ()) and to_bytes(run, w) is not None] if not EAST.search(run) else []
        if not stretches and not single:
            return []
        codes = _codes(before + run + after)
        scores = self.statistics.scores_at(codes, np.arange(len(codes) - 1))
        segments = maximal_segments((min(THRESHOLD, float(scores.mean())) - scores).tolist())
        out = []
        for wrong, a, b in stretches:
            if any(a < j and b >= i for i, j in segments):
                # Sound characters at either end may fit the pattern by chance.
                ends = [(i, j) for i in (a, a + 1) for j in (b - 1, b) if j - i >= 2]
                tried = [(*g, i, j) for i, j in ends for g in self._tried(run[i - 1 : i] or before, run[i:j], run[j : j + 1] or after, {wrong: ["utf-8"]})]
                out += [max(tried)] if tried else []
        for wrong in single:
            for a, b in utf8_stretches(run, wrong):
                if b - a < len(run) and any(a < j and b >= i for i, j in segments):
                    tried = self._tried(run[a - 1 : a] or before, run[a:b], run[b : b + 1] or after, {wrong: ["utf-8"]})
                    out += [(*g, a, b) for g in tried if g[0] > PART_GAIN]
        return out

    def _weigh(self, counted: Counter, mappings: dict[str, list[str]], kind: str) -> tuple[Counter, Counter, Counter]:
        """Best gain, sum of gains beyond the toll, and runs that gain, by mapping."""
        best, total, helped = Counter(), Counter(), Counter()
        for (before, run, after), times in counted.items():
            for gain, mapping in self.gains(before, run, after, mappings, kind):
                best[mapping] = max(best[mapping], gain)
                total[mapping] += times * (gain if mapping[1] == "utf-8" else max(0.0, gain - OTHER_TOLL))
                helped[mapping] += times
        return best, total, helped

    def mapping(self, narrow: Counter, wide: Counter) -> tuple[tuple[str, str], float] | None:
        """The mapping that explains the improbable runs of a text, and its gain; null if there is none.

        UTF-8 that explains half of the runs is taken at once; otherwise the mapping with the greatest gain.
        """
        best, total, helped = self._weigh(narrow, NARROW_TRIES, "n")
        sure = [(total[m], m) for m in total if m[1] == "utf-8" and best[m] > UTF8_GAIN]
        if not sure or 2 * helped[max(sure)[1]] < narrow.total():
            more = self._weigh(wide, WIDE_TRIES, "d")[1]
            sure += [(g, m) for m, g in (total + more).items() if m[1] != "utf-8" and g > OTHER_GAIN]
        if not sure:
            return None
        gain, mapping = max(sure)
        return mapping, gain

    def undo(self, text: str, mapping: tuple[str, str]) -> str:
        """``text`` with the improbable runs restored that gain by ``mapping``; the rest stays as it is."""
        runs = self.improbable(_codes("\n" + text + "\n"), RAISED) - 1
        spans = []
        for a, b in (m.span() for m in _PATTERNS[mapping].finditer(text)):
            k = np.searchsorted(runs[:, 1], a, side="right")
            if k == len(runs) or runs[k, 0] >= b:
                continue
            parts = []
            if inverse(text[a:b], *mapping) is None:
                found = self.isolated(text[a - 1 : a] or "\n", text[a:b], text[b : b + 1] or "\n", {mapping[0]: [mapping[1]]})
                for _, _, i, j in sorted(found, key=lambda f: f[2]):
                    if not parts or a + i >= parts[-1][1]:
                        parts.append((a + i, a + j))
            spans += parts or [(a, b)]
        backs, scores = [], []
        for a, b in spans:
            back = inverse(text[a:b], *mapping)
            backs.append(back)
            context = text[a - 1 : a] or "\n", text[b : b + 1] or "\n"
            if back is None:
                scores.append(-4.0)
            elif mapping[1] == "utf-8":
                scores.append(1.0)  # an improbable run that decodes as UTF-8 in a text that was read wrongly
            else:
                own, other = self.statistics.log_probabilities([text[a:b].join(context), back.join(context)])[0].tolist()
                scores.append(other - own)
        out, at = [], 0
        for first, last in maximal_segments(scores):
            for i in range(first, last):
                if backs[i] is not None:
                    a, b = spans[i]
                    out += [text[at:a], backs[i]]
                    at = b
        return "".join([*out, text[at:]])

    def repair(self, text: str, runs: list[list[int]], counted: tuple[Counter, Counter] | None = None) -> tuple[str | None, str | None, float]:
        """``(mappings undone, restored text, gain)``; no mappings and no text if the text is in order, and no text if
        characters are lost for good. ``counted`` is what ``prepare`` gave."""
        undone, gain, now, seen = [], 0.0, text, {text}
        lost = any(LOST in text[a:b] for a, b in runs)
        narrow, wide = counted or (self._around(text, runs), self._around(text, self._widened(text, runs)))
        while (found := self.mapping(narrow, wide)) is not None:
            after = self.undo(now, found[0])
            undone.append("/".join(found[0]))
            gain += found[1]
            if after in seen:
                break
            now = after
            seen.add(now)
            runs = (self.improbable(_codes("\n" + now + "\n")) - 1).tolist()
            narrow, wide = self._around(now, runs), self._around(now, self._widened(now, runs))
        if not undone:
            return ("lost", None, 0.0) if lost else (None, None, 0.0)
        return " ".join(undone), (None if LOST in now else now), gain


def find_garbled(documents: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """The rows of ``documents`` whose text was decoded with a wrong encoding, in whole or in part.

    Adds ``{prefix}mappings`` (wrong/true encodings in the order in which they are undone, or ``lost`` where only
    U+FFFD tells), ``{prefix}restored`` (the original text, null where characters are lost) and ``{prefix}gain``;
    columns of these names are replaced. Null and empty texts and pure ASCII are never garbled. Repeated rows stay.
    """
    names = [f"{prefix}{n}" for n in ("mappings", "restored", "gain")]
    if text in names:
        raise ValueError(f"{text} is a column of the result; choose a prefix")
    kept = documents.drop(*names)
    statistics = PairStatistics.of(staged(pair_counts(documents, text), "pairs"))
    shared = documents.sparkSession.sparkContext.broadcast((statistics.sketch, statistics.first, statistics.second))
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.StringType()), T.StructField(names[2], T.DoubleType())])

    def run(batches):  # noqa: ANN001, ANN202
        repairer = Repairer(PairStatistics(*shared.value))
        for batch in batches:
            rows, results, base = [], [], 0
            for part in _parts(batch.column(text)):
                texts = [t or "" for t in part]
                codes = _codes("\n" + "\n".join(texts) + "\n")
                starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
                spans = repairer.improbable(codes)
                borders = np.searchsorted(spans[:, 0], starts)
                at = np.flatnonzero(np.diff(borders)).tolist()
                runs = [(spans[borders[i] : borders[i + 1]] - starts[i]).tolist() for i in at]
                for i, own, counted in zip(at, runs, repairer.prepare([texts[i] for i in at], runs)):
                    found = repairer.repair(texts[i], own, counted)
                    if found[0] is not None:
                        rows.append(base + i)
                        results.append(found)
                base += len(part)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array([r[k] for r in results], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64())))], [*taken.schema.names, *names])

    return kept.mapInArrow(run, schema)
