"""Problem 7: noise in text from scanned pages.

Skip-gram vectors of the frequent words are learned over the scanned texts; a rare word's vector is the sum of those around
it, wherever it stands. A rare word is linked to frequent words that plausible glyph edits lead to and its vector allows,
unless clean texts have it, which makes it right; of several, the one is taken that the context speaks for. Running headers,
footers and page numbers are found by how they repeat at the edges of a text's pages; words broken over lines are joined;
then the furniture is removed and the lines flow together again into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import cut, hot_keys, join_small, table

#: A word is frequent that stands in this part of the clean texts, or as letters alone in that part of the scanned ones
#: (and in two or three texts at least). That bounds the vocabulary: by a text's mean number of words, times 500 and times 33.
CLEAN_SHARE, SCANNED_SHARE = 0.002, 0.03
#: Skip-gram training: dimensions, words on either side, negatives a batch, rate, and how strongly very frequent words are thinned.
DIMENSIONS, WINDOW, NEGATIVES, RATE, THIN = 24, 2, 32, 0.05, 1e-3

#: Cosines of a rare word's vector and a frequent one's, from which an edit that is no known confusion is accepted, and below
#: which a word of letters is one of its own; clean texts in which a right word stands at least.
NEAR, FAR, RIGHT = 0.5, -0.3, 2

HYPHENS = "-‐\xad¬"
EDGE = ".,;:?\"'()[]{}«»“”‘’„–—…" + HYPHENS
#: Words that follow a hyphen left hanging for a compound that comes later ("pre- and post-war").
HANGING = {"and", "or", "und", "oder", "et", "ou", "y", "o", "e", "bis", "to"}
#: What a reader takes for what, from the wrong characters to the right ones.
GLYPHS = {
    "1": "li", "!": "il", "|": "li", "0": "o", "5": "s", "6": "b", "8": "b", "9": "gq", "2": "z", "3": "e", "@": "a", "+": "t", "$": "s",
    "c": "eo", "e": "c", "o": "c", "v": "y", "y": "v", "b": "h", "h": "b", "i": "lt", "l": "it", "t": "i", "f": "t", "u": "n", "n": "u",
}
PAIRS = {"cl": "d", "rn": "m", "rm": "nn", "ii": "u", "ri": "n", "vv": "w", "ni": "m", "li": "h", "m": "rn", "d": "cl", "n": "ri", "w": "vv", "u": "ii", "h": "li", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
_DIGITS = str.maketrans("lI|!OoSBZ", "111100582")
_NUMBER = r"[0-9lI|!OoSBZ]{1,4}"
_PAGE = re.compile(
    rf"^[\s\W]*(?:(?P<word>(?i:page|seite|página|pagina|pág|pag|blatt|sheet|folio|pg|p|s))[.:]?\s*)?(?:(?P<roman>[ivx]+|[IVX]*[VX][IVX]*)|(?P<n>{_NUMBER}))(?P<of>\s*(?:of|/|von|de|sur|di)\s*{_NUMBER})?[\s\W]*$"
)
#: A title with a number at one of its ends.
_LISTED = re.compile(r"[|#/]\s*\S{1,4}$|^\S{1,4}\s*\|")
_LETTERS = re.compile(r"[^\W\d_]")
_VALUES = re.compile(r"^[\s\f]*[-+]?[\d.,]+(?:\s+[-+]?[\d.,]+)*\s*$")


def page_number(line: str) -> tuple[int, bool] | None:
    """(number, whether it can be nothing else) of a line that may hold a page's number alone."""
    m = _PAGE.match(line)
    if not m or not line.strip():
        return None
    shown = line.strip()
    if m["roman"]:
        values, total, before = {"i": 1, "v": 5, "x": 10}, 0, 0
        for ch in reversed(m["roman"].lower()):
            total += values[ch] if values[ch] >= before else -values[ch]
            before = max(before, values[ch])
        return total, True
    if not re.search(r"[0-9]|^[lIO|]+$", m["n"]) and not (m["word"] or m["of"]):
        return None
    digits = m["n"].translate(_DIGITS)
    marked = bool(m["word"] or m["of"]) or (shown[0] in "[(-–—~*" and shown[-1] in "])-–—~*")
    return (int(digits), marked) if digits.isdigit() else None


_SAME = str.maketrans({"1": "i", "!": "i", "l": "i", "|": "i", "0": "o", "5": "s", "6": "b", "@": "a", "+": "t", "c": "e"})


def signature(line: str) -> str:
    """A line without blanks, a number at its ends, and the differences that misread glyphs make."""
    s = re.sub(r"^\s*\S{1,4}\s*\|\s+|\s+\|\s*\S{1,4}\s*$", "", line.lower())
    s = re.sub(r"\d+", "#", re.sub(r"\s+", "", s))
    return s.translate(_SAME).replace("rn", "m").replace("vv", "w")


def furniture(lines: list[str]) -> dict[int, str]:
    """header or page_number by the line's number."""
    filled = [k for k, line in enumerate(lines) if line.strip()]
    if not filled:
        return {}
    place = {k: i for i, k in enumerate(filled)}
    numbers = {k: n for k in filled if (n := page_number(lines[k]))}
    values = Counter(v for k, (v, marked) in numbers.items() if not marked)
    edge = {filled[0], filled[-1]} | {k for k in filled if lines[k].startswith("\f")}
    edge |= {filled[place[k] - 1] for k in filled if lines[k].startswith("\f") and place[k]}
    found: dict[int, str] = {}
    for k, (v, marked) in numbers.items():
        bare = len(re.sub(r"\W", "", lines[k]))
        if marked or bare <= 3 and (values[v - 1] or values[v + 1] or k in edge or lines[k].startswith(("   ", "\f"))):
            found[k] = "page_number"
    width = max(len(lines[k]) for k in filled)

    def can_be(k: int) -> bool:
        line = lines[k].strip()
        if k in found or line.endswith((".", ",", ";", *HYPHENS)) or _VALUES.match(line):
            return False
        letters = len(_LETTERS.findall(line))
        return letters >= 4 and letters * 2 > len(line) - line.count(" ")

    spaced = {k for k in filled if k not in found and re.fullmatch(r"(?:\S\s+){5,}\S", lines[k].strip())}
    titles = [k for k in filled if can_be(k) or k in spaced]
    signs = {k: signature(lines[k]) for k in titles}
    repeated = {s for s, n in Counter(signs.values()).items() if n > 1}
    near = set(edge)
    for k in found:
        near |= {filled[i] for i in range(max(0, place[k] - 2), min(len(filled), place[k] + 3))}
    heads = {k for k in titles if k in spaced or signs[k] in repeated}
    for k in heads:
        near |= {filled[i] for i in range(max(0, place[k] - 2), min(len(filled), place[k] + 3))}
    near |= {k for k in titles if _LISTED.search(lines[k].strip())}
    rest = [k for k in titles if k not in heads and k in near]
    known = {signs[k] for k in heads}
    twos = {s: {s[i : i + 2] for i in range(len(s) - 1)} for s in {*signs.values()}}

    def alike(a: str, b: str, share: float) -> bool:
        return abs(len(a) - len(b)) <= 3 and 2 * len(twos[a] & twos[b]) >= share * (len(twos[a]) + len(twos[b]))

    heads |= {k for k in rest if any(alike(signs[k], s, 0.66) for s in known)}
    rest = [k for k in rest if k not in heads and len(lines[k].strip()) < 0.8 * width]
    for i, a in enumerate(rest):
        for b in rest[i + 1 :]:
            if alike(signs[a], signs[b], 0.74):
                heads |= {a, b}
    for k in (filled[0], filled[-1]):  # the only page of a text
        if not heads and k in signs:
            line = lines[k].strip()
            words = line.split()
            beside = filled[1] if k == filled[0] and len(filled) > 1 else k
            opens = k == filled[-1] or not lines[beside].strip()[:1].islower()
            if opens and len(line) < 0.8 * width and len(words) <= 8 and (line[:1].isupper() or _LISTED.search(line)):
                heads.add(k)
    for k in numbers:
        beside = {filled[i] for i in (place[k] - 1, place[k] + 1) if 0 <= i < len(filled)}
        if k not in found and len(re.sub(r"\W", "", lines[k])) <= 3 and beside & heads:
            found[k] = "page_number"
    return found | dict.fromkeys(heads, "header")


def core(token: str) -> str:
    """A token in lower case without the punctuation around it."""
    return token.strip(EDGE).lower()


def plausible(wrong: str, right: str) -> bool:
    """Whether a reader may take the character right for wrong: a known confusion, or no letter where a letter belongs."""
    return right in GLYPHS.get(wrong, "") or not wrong.isalpha()


class Corrector:
    """Frequent words with their counts and vectors; finds what a rare word was before it was misread.

    links: what is known of the rare words of a text, by link_words; without it, candidates are searched without vectors.
    """

    def __init__(self, counts: dict[str, int], vectors: dict[str, np.ndarray] | None = None):
        self.counts, self.vectors = counts, vectors or {}
        self.total = sum(counts.values()) or 1
        self.by_length: dict[int, tuple[list[str], np.ndarray]] = {}
        groups: dict[int, list[str]] = {}
        for w in sorted(counts):
            if len(w) > 1 and all(part.isalpha() for part in re.split(r"[-'’]", w)):
                groups.setdefault(len(w), []).append(w)
        for n, words in groups.items():
            self.by_length[n] = words, np.array([[ord(ch) for ch in w] for w in words], np.uint32)
        self.links: dict[str, list[tuple[float, str]]] | None = None

    def known(self, word: str) -> bool:
        return word in self.counts

    def candidates(self, word: str, context: Iterable[str] = ()) -> list[tuple[float, str]]:
        """(cost, word) that word may be a misreading of, cheapest first; the word itself at no cost if it is a right one."""
        return self.links.get(word, []) if self.links is not None else self.neighbours(word)

    def context_vector(self, context: Iterable[str]) -> np.ndarray | None:
        around = [self.vectors[w] for w in context if w in self.vectors]
        return sum(around) if around else None

    def neighbours(self, word: str, vector: np.ndarray | None = None) -> list[tuple[float, str]]:
        """(cost, frequent word) that plausible glyph edits lead to. One edit that is no known confusion is accepted where
        the rare word's vector is near the frequent one's (a cosine of NEAR or more); where the vectors are opposed (a
        cosine below FAR), a word of letters alone is a word of its own."""
        limit = 1.0 if len(word) <= 3 else 1.5 if len(word) == 4 else 2.7 if len(word) < 8 else 3.0
        best: dict[str, tuple[float, int]] = {}
        variants = {word: 0.0}
        for _ in range(2):
            for w, cost in list(variants.items()):
                for wrong, right in PAIRS.items():
                    at = w.find(wrong)
                    while at >= 0:
                        v = w[:at] + right + w[at + len(wrong) :]
                        variants[v] = min(variants.get(v, 9.0), cost + 1.0)
                        at = w.find(wrong, at + 1)
        for v, before in variants.items():
            if before > limit or len(v) not in self.by_length:
                continue
            words, table_ = self.by_length[len(v)]
            codes = np.array([ord(ch) for ch in v], np.uint32)
            most = 2 if before < 1 else 1
            unlike = (table_ != codes).sum(axis=1)
            for i in np.flatnonzero(unlike <= most):
                cost, odd = before, 0
                for a, b in zip(v, words[i], strict=True):
                    if a != b:
                        cost += 1.0 if b in GLYPHS.get(a, "") else 1.2 if not a.isalpha() else 1.5
                        odd += not plausible(a, b)
                if cost <= limit and odd <= 1 and words[i] != word:
                    best[words[i]] = min(best.get(words[i], (9.0, 9)), (cost, odd))
        return sorted((c, w) for w, (c, odd) in best.items() if self._supported(word, w, odd, vector))

    def _supported(self, word: str, candidate: str, odd: int, vector: np.ndarray | None) -> bool:
        there = self.vectors.get(candidate)
        cos = None if vector is None or there is None else float(vector @ there) / (np.linalg.norm(vector) * np.linalg.norm(there) + 1e-9)
        if odd:
            return cos is not None and cos >= NEAR
        return cos is None or cos >= FAR or not word.isalpha()

    def correct(self, word: str, context: Iterable[str] = ()) -> str | None:
        """The frequent word that word stands for, or None."""
        found = self.candidates(word, context)
        if not found or found[0][1] == word:
            return None
        close = [(c, w) for c, w in found if c <= found[0][0] + 0.6]
        if len(close) == 1:
            return close[0][1]
        there = self.context_vector(context)

        def score(item: tuple[float, str]) -> float:
            cost, w = item
            s = -2.0 * cost + 0.3 * np.log(self.counts[w] / self.total)
            if there is not None and w in self.vectors:
                v = self.vectors[w]
                s += 2.0 * float(v @ there) / (np.linalg.norm(v) * np.linalg.norm(there) + 1e-9)
            return s

        return max(close, key=lambda x: (score(x), x[1]))[1]


class _Asking(Corrector):
    """Notes which rare words a text would be asked about, and the sum of the vectors around them; corrects nothing."""

    def __init__(self, counts, vectors):
        self.counts, self.vectors, self.asked = counts, vectors, {}

    def candidates(self, word: str, context: Iterable[str] = ()) -> list:
        there = self.context_vector(context)
        n, total = self.asked.get(word, (0, np.zeros(DIMENSIONS)))
        self.asked[word] = (n + 1, total if there is None else total + there)
        return []


def misreadable(word: str) -> bool:
    letters = sum(ch.isalpha() for ch in word)
    return letters > 0 and len(word) >= 2 and letters * 2 >= len(word) and not (letters < 2 and len(word) > 2)


def inspect(text: str, corrector: Corrector) -> tuple[list[tuple[int, str, str]], dict]:
    """(line, kind, word) of the noise in a text, and what repair() needs of it."""
    lines = text.split("\n")
    kinds = furniture(lines)
    found = [(k, kind, "") for k, kind in kinds.items()]
    running = [k for k, line in enumerate(lines) if k not in kinds and line.strip() and not _VALUES.match(line)]
    tokens = {k: lines[k].split() for k in running}
    skip: set[tuple[int, int]] = set()
    joins: dict[int, str] = {}
    fixes: dict[tuple[int, int], str] = {}
    for k, after in zip(running, running[1:], strict=False):
        head = tokens[k][-1]
        if not (head[-1] in HYPHENS and len(head) > 1 and head[-2].isalnum() or head[-1] in HYPHENS[2:] and len(head) > 1):
            continue
        skip.add((k, len(tokens[k]) - 1))
        tail = tokens[after][0]
        if core(tail) in HANGING or not core(tail)[:1].isalnum() and core(tail)[:1] not in GLYPHS:
            continue
        skip.add((after, 0))
        left, right = head[:-1].lstrip(EDGE).lower(), core(tail)
        if not any(ch.isalpha() for ch in left):  # numbers, not a word
            continue
        joined, linked = left + right, f"{left}-{right}"
        if corrector.known(joined):
            word = joined
        elif corrector.known(linked):
            word = linked
        else:
            options = corrector.candidates(joined)[:1] + corrector.candidates(linked)[:1]
            word = min(options)[1] if options else joined
        if core(head[:-1]) and right:
            found.append((k, "hyphen_break", word))
            joins[k] = word
    flat = [(k, i) for k in running for i in range(len(tokens[k]))]
    cores = {at: core(tokens[at[0]][at[1]]) for at in flat}
    for n, at in enumerate(flat):
        word = cores[at]
        if at in skip or not word or corrector.known(word) or not misreadable(word):
            continue
        if word.endswith("!") and corrector.known(word.rstrip("!")):
            continue
        around = [cores[x] for x in flat[max(0, n - 3) : n] + flat[n + 1 : n + 4]]
        right = corrector.correct(word, around)
        if right is None and word.endswith("!"):
            right = corrector.correct(word.rstrip("!"), around)
        if right is not None:
            found.append((at[0], "misread", right))
            fixes[at] = right
    return found, {"lines": lines, "kinds": kinds, "joins": joins, "fixes": fixes}


def repair(text: str, corrector: Corrector) -> str:
    """The text without furniture, words joined and corrected, lines of a paragraph in one; values keep their lines."""
    _, facts = inspect(text, corrector)
    lines, paragraphs, open_, carried = facts["lines"], [], [], None
    for k, line in enumerate(lines):
        if k in facts["kinds"]:
            continue
        line = line.replace("\f", "").rstrip("\r")
        if not line.strip():
            # a blank line beside furniture is the page's edge, not the paragraph's
            beside = {k - 1, k + 1} & set(facts["kinds"])
            if open_ and carried is None and not beside:
                paragraphs.append(" ".join(open_))
                open_ = []
            continue
        if _VALUES.match(line):
            if open_ and carried is None:
                paragraphs.append(" ".join(open_))
                open_ = []
            paragraphs.append(line.strip())
            continue
        words = line.split()
        for i, w in enumerate(words):
            right = facts["fixes"].get((k, i))
            if right is not None:
                at = w.lower().find(core(w))
                shown = right.capitalize() if w[at : at + 1].isupper() else right
                words[i] = w[:at] + shown + w[at + len(core(w)) :]
        if carried is not None:
            head, word = carried
            rest = words[0][len(words[0].rstrip(EDGE)) :] if words[0].rstrip(EDGE) else ""
            lead = head[: len(head) - len(head.lstrip(EDGE))]
            shown = word[:1].upper() + word[1:] if head.lstrip(EDGE)[:1].isupper() else word
            open_.append(lead + shown + rest)
            words, carried = words[1:], None
        if k in facts["joins"] and words:
            carried = (words[-1], facts["joins"][k])
            words = words[:-1]
        open_ += words
    if carried is not None:
        open_.append(carried[0])
    if open_:
        paragraphs.append(" ".join(open_))
    return "\n\n".join(p for p in paragraphs if p)


def count_words(docs: DataFrame) -> DataFrame:
    """word, clean, scanned: in how many of docs (text, is_scan) a word stands."""

    def run(batches):
        for b in batches:
            seen = {True: Counter(), False: Counter()}
            for text, scan in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[scan].update({w for w in map(core, set(text.split())) if w})
            words = list(seen[True].keys() | seen[False].keys())
            counts = [pa.array([seen[s][w] for w in words], pa.int64()) for s in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *counts], names=["word", "clean", "scanned"])

    return docs.mapInArrow(run, "word string, clean bigint, scanned bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))


def learn_vocabulary(docs: DataFrame, words: DataFrame | None = None) -> dict[str, int]:
    """The frequent words of docs (text, is_scan; words: their counts) with the number of texts they stand in; CLEAN_SHARE
    bounds them."""
    n = {r["is_scan"]: r["n"] for r in docs.groupBy("is_scan").agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = F.col("word").rlike(r"^\p{L}+(?:[-'’]\p{L}+)*$") & (F.length("word") > 1)
    often = (F.col("clean") >= max(2.0, CLEAN_SHARE * n.get(False, 0))) | (letters & (F.col("scanned") >= max(3.0, SCANNED_SHARE * n.get(True, 0))))
    rows = (count_words(docs) if words is None else words).filter(often).select("word", (F.col("clean") + F.col("scanned")).alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def train_skipgrams(texts: list[str], ids: dict[str, int], keep: np.ndarray, inner: np.ndarray, outer: np.ndarray, rng) -> int:
    """One pass of skip-gram training with shared negatives over texts, changing inner and outer; returns the pairs seen."""
    sequences = []
    for t in texts:
        s = np.array([ids.get(core(w), -1) for w in t.split()], np.int32)
        s = s[(s >= 0) & (rng.random(len(s)) < keep[s])]
        sequences += [s, np.full(WINDOW, -1, np.int32)]
    if not sequences:
        return 0
    line = np.concatenate(sequences)
    centre, around = [], []
    for d in range(1, WINDOW + 1):
        a, b = line[:-d], line[d:]
        ok = (a >= 0) & (b >= 0)
        centre += [a[ok], b[ok]]
        around += [b[ok], a[ok]]
    centre, around = np.concatenate(centre), np.concatenate(around)
    order = rng.permutation(len(centre))
    for i in range(0, len(order), 2048):
        c, o = centre[order[i : i + 2048]], around[order[i : i + 2048]]
        neg = rng.integers(0, len(inner), NEGATIVES)
        vc, vo, vn = inner[c], outer[o], outer[neg]
        g = RATE * (1 - 1 / (1 + np.exp(-(vc * vo).sum(axis=1))))[:, None].astype(np.float32)
        gn = (-RATE * 5 / NEGATIVES / (1 + np.exp(-(vc @ vn.T)))).astype(np.float32)
        for target, rows, change in ((inner, c, g * vo + gn @ vn), (outer, o, g * vc)):
            by = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.r_[True, rows[by][1:] != rows[by][:-1]])
            target[rows[by][first]] += np.clip(np.add.reduceat(change[by], first), -1, 1)
        outer[neg] += np.clip(gn.T @ vc, -1, 1)
    return len(centre)


def learn_vectors(texts: DataFrame, counts: dict[str, int], seed: int = 0) -> dict[str, np.ndarray]:
    """Skip-gram vectors of the frequent words, learned over all texts (column text): in each partition from the same
    start, then averaged by the pairs a partition saw. What comes to the driver is as large as the vocabulary."""
    words = sorted(w for w in counts if any(ch.isalpha() for ch in w))
    if not words:
        return {}
    ids = {w: i for i, w in enumerate(words)}
    freq = np.array([counts[w] for w in words], float)
    freq /= freq.sum()
    keep = np.append(np.minimum(1, np.sqrt(THIN / freq)), 0.0)
    shared = texts.sparkSession.sparkContext.broadcast((ids, keep))

    def run(batches):
        ids, keep = shared.value
        rng = np.random.default_rng(seed)
        inner = rng.uniform(-0.5 / DIMENSIONS, 0.5 / DIMENSIONS, (len(ids), DIMENSIONS)).astype(np.float32)
        outer = np.zeros_like(inner)
        pairs = 0
        for b in batches:
            rows = b.column(0).to_pylist()
            for i in range(0, len(rows), 500):
                pairs += train_skipgrams(rows[i : i + 500], ids, keep, inner, outer, rng)
        if pairs:
            flat = pa.array((inner.astype(np.float64) * pairs).ravel())
            at = pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), DIMENSIONS))
            dim = pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(ids)))
            yield pa.RecordBatch.from_arrays([at, dim, flat, pa.array(np.full(len(flat), float(pairs)))], names=["word", "dim", "x", "pairs"])

    parts = texts.select("text").mapInArrow(run, "word int, dim int, x double, pairs double")
    rows = parts.groupBy("word", "dim").agg((F.sum("x") / F.sum("pairs")).alias("x"))
    got = rows.toPandas()
    mean = np.zeros((len(words), DIMENSIONS), np.float32)
    mean[got["word"], got["dim"]] = got["x"]
    return {w: mean[i] for w, i in ids.items()}


def _trained(spark, sf_dir: str) -> tuple[DataFrame, object, DataFrame]:
    """The scanned texts (id, text), a broadcast of the corrector's parts, and the words that are
    right: those of RIGHT clean texts or more, where they are at least half as frequent as in scanned ones."""
    scans = table(spark, sf_dir, "vector_chunks").filter("source_type = 'ocr_text'").select(F.col("artifact_id").alias("id")).distinct().withColumn("ocr", F.lit(True))
    docs = table(spark, sf_dir, "artifacts").filter("id IS NOT NULL AND length(extracted_text) > 0").select("id", "mime_type", F.col("extracted_text").alias("text"))
    is_scan = F.coalesce("ocr", F.lit(False)) | F.coalesce(F.lower("mime_type").startswith("image/"), F.lit(False))
    docs = docs.join(scans, "id", "left").select("id", "text", is_scan.alias("is_scan")).dropDuplicates(["id"])
    docs = cut(docs, "texts")
    words = cut(count_words(docs.select("text", "is_scan")), "words")
    counts = learn_vocabulary(docs.select("text", "is_scan"), words)
    n = {r["is_scan"]: r["n"] for r in docs.groupBy("is_scan").agg(F.count(F.lit(1)).alias("n")).collect()}
    right = (F.col("clean") >= RIGHT) & (F.col("clean") * n.get(True, 0) * 2 >= F.col("scanned") * n.get(False, 0))
    scanned = docs.filter("is_scan").select("id", "text")
    vectors = learn_vectors(scanned.select("text"), counts)
    return scanned, spark.sparkContext.broadcast((counts, vectors)), words.filter(right).select("word", F.lit(True).alias("right"))


def link_words(texts: DataFrame, parts, support: DataFrame | None = None) -> DataFrame:
    """texts (id, text) with links: for each rare word of a text (word, the frequent words it is linked to with the cost of
    the edits between them). A rare word's vector is the sum of those around it, wherever it stands in texts. Words
    that are right (support: word, right) are linked to themselves."""
    columns = [f"v{i}" for i in range(DIMENSIONS)]
    kind = texts.schema["id"].dataType.simpleString()

    def ask(batches):
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                asking = _Asking(*parts.value)
                inspect(text, asking)
                out += [(i, w, n, v) for w, (n, v) in asking.asked.items()]
            if out:
                x = np.array([r[3] for r in out])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.types[0]), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64()), *[pa.array(c) for c in x.T]], names=["id", "word", "n", *columns])

    def link(batches):
        corrector = Corrector(*parts.value)
        for b in batches:
            rare, right = b.column(0).to_pylist(), b.column(1).to_pylist()
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], axis=1)
            links = [[(0.0, w)] if ok else corrector.neighbours(w, v if v.any() else None) for w, ok, v in zip(rare, right, x, strict=True)]
            items = [[{"cost": c, "word": w} for c, w in some] for some in links]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.struct([("cost", pa.float64()), ("word", pa.string())])))], names=["word", "links"])

    asked = cut(texts.select("id", "text").mapInArrow(ask, f"id {kind}, word string, n bigint, {', '.join(f'{c} double' for c in columns)}"), "asked")
    rare = asked.groupBy("word").agg(F.count(F.lit(1)).alias("texts"), *[F.sum(c).alias(c) for c in columns])
    rare = rare.join(support, "word", "left") if support is not None else rare.withColumn("right", F.lit(None).cast("boolean"))
    rare = cut(rare, "rare")
    linked = rare.select("word", "right", *columns).mapInArrow(link, "word string, links array<struct<cost: double, word: string>>").filter(F.size("links") > 0)
    known = join_small(asked.select("id", "word"), linked, "word", hot_keys(rare, "word", "texts"))
    return texts.join(known.groupBy("id").agg(F.collect_list(F.struct("word", "links")).alias("links")), "id", "left").select("id", "text", "links")


def _each(batch, corrector: Corrector):
    """id, text of a batch of linked texts, the corrector knowing the text's links."""
    for i, text, links in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        corrector.links = {x["word"]: [(c["cost"], c["word"]) for c in x["links"]] for x in links or []}
        yield i, text


def find_noise(scanned: DataFrame, parts, support: DataFrame | None = None) -> DataFrame:
    """artifact_id, line_no, noise_kind, word of scanned (id, text), each once; parts: a broadcast of counts and vectors.

    Texts without lines have no noise. Words are corrected to frequent words only; what no link leads to stays.
    """
    names = ["artifact_id", "line_no", "noise_kind", "word"]

    def run(batches):
        corrector = Corrector(*parts.value)
        for b in batches:
            out = [(i, *x) for i, text in _each(b, corrector) for x in sorted(set(inspect(text, corrector)[0]))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return link_words(scanned, parts, support).mapInArrow(run, "artifact_id bigint, line_no int, noise_kind string, word string")


def repair_texts(scanned: DataFrame, parts, support: DataFrame | None = None, name: str = "artifact_id") -> DataFrame:
    """name, text: scanned texts (id, text) as continuous paragraphs."""

    def run(batches):
        corrector = Corrector(*parts.value)
        for b in batches:
            text = [repair(t, corrector) for _, t in _each(b, corrector)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=[name, "text"])

    return link_words(scanned, parts, support).mapInArrow(run, f"{name} {scanned.schema['id'].dataType.simpleString()}, text string")


def p7_found(spark, sf_dir: str) -> DataFrame:
    return find_noise(*_trained(spark, sf_dir))


def p7_text(spark, sf_dir: str) -> DataFrame:
    return repair_texts(*_trained(spark, sf_dir))


def p7_chunks(spark, sf_dir: str) -> DataFrame:
    """chunk_id, text: the stored pieces of scanned texts, repaired."""
    _, parts, support = _trained(spark, sf_dir)
    pieces = table(spark, sf_dir, "vector_chunks").filter("source_type = 'ocr_text' AND text IS NOT NULL AND chunk_id IS NOT NULL").select(F.col("chunk_id").alias("id"), "text").dropDuplicates(["id"])
    return repair_texts(pieces, parts, support, "chunk_id")


QUERIES = {"p7_found": p7_found, "p7_text": p7_text, "p7_chunks": p7_chunks}
SQL: dict[str, str] = {}
