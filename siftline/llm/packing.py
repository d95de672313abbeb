"""Packing into windows by non-negative least squares over length combinations.

Documents become token ids with an end id. Whole windows of a long document are sequences of their own; what is left
of each document has a length under the window. The histogram of these lengths (at most window - 1 bins, at any
corpus size) is what the driver solves: shallow combinations of lengths that fill a window exactly are enumerated,
non-negative least squares gives the number of times each is repeated, rounded to what the histogram holds, and again for what
rounding leaves, up to ROUNDS times. Combinations are shallow: all pairs, and triples and repeats (up to DEEPEST) with the ANCHORS
most frequent lengths; these bound the work on the driver, not what is packed. What remains is packed greedily, one after another, cut at the window. The last, partial window is cut at powers of two,
where sequences need no padding; so nothing is padded.

Each row finds its place by arithmetic from its rank among rows of equal length. Ranks need no sort: a row's rank in its
partition, kept while tokenizing, plus the rows of that length in earlier partitions. The tokens are written once to the
shared folder, and that fixes partitions for a task that is run again.

Defined results: null and empty texts have the end id only; rows of equal id are packed one by one; an empty table gives
an empty result; further columns are ignored. Texts with special token names follow the tokenizer.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import give_back, map_frames, stored

ANCHORS, DEEPEST, SWEEPS, ROUNDS = 48, 8, 60, 8
KEPT_WORDS = 150_000
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Words of these letters, of digits and of ASCII punctuation but the apostrophe; their pieces; \x01 stands between words.
PLAIN = re.compile(rf"[{LETTERS}0-9{MARKS}]+")
PIECE = re.compile(rf"[{LETTERS}]+|[0-9\x01]|[{MARKS}]+")
#: Where a text must be tokenized in one piece: special tokens, and separators that are white space to Python alone.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Marks side by side are one piece; where a text of Latin-1 has none, small letters and marks on their own give the same pieces.
DOUBLE = re.compile(r"[\x00-\x08\x0e-\x1b!-/:-@\[-`{-\xbf×÷]{2}")
SINGLE = ".,;:!?()"


def _letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then others in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def _reached(parts: list[str], ranks: dict[tuple[str, str], int]) -> bool:
    """Whether merging, by rank, makes one token of the parts."""
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda p: ranks.get(p, 1 << 30))
        if best not in ranks:
            return False
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return True


def unreached(path: str) -> frozenset[str]:
    """Tokens that the merges of their parts do not make."""
    vocab, end, merges = _merges(path)
    ranks = {m: i for i, m in enumerate(merges)}
    return frozenset(a + b for a, b in merges if not _reached(_parts(a + b, end), ranks))


def _merges(path: str) -> tuple[dict[str, int], str, list[tuple[str, str]]]:
    model = json.loads(Path(path).read_text("utf-8"))["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError("ids do not follow the order of merges")
    return model["vocab"], model["end_of_word_suffix"], merges


def _parts(token: str, end: str) -> list[str]:
    body = token.removesuffix(end)
    return list(body) if body == token else [*body[:-1], body[-1] + end]


def byte_ranks(path: str, left_out: frozenset[str] | None = None) -> dict[bytes, int]:
    """The merges by byte rank with b"\\0" for the end of a piece.

    Ranks join any neighbours that make a token, where the tokenizer joins only those of a merge. Both give the same ids if no
    token is kept that its own merges do not reach: such tokens (``left_out``) can occur in no text."""
    (vocab, end, merges), letters = _merges(path), _letters()
    merged, left_out = {a + b for a, b in merges}, unreached(path) if left_out is None else left_out

    def raw(token: str) -> bytes:
        body = token.removesuffix(end)
        return bytes(map(letters.__getitem__, body)) + b"\0" * (body != token)

    return {raw(t): i for t, i in vocab.items() if (t in merged and t not in left_out) or (t not in merged and t.removesuffix(end) in letters)}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokens:
    """Ids of texts by a tokenizer that drops white space and looks at each word alone; words are kept once tokenized."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        # what reading the file takes goes back before the next is read: several workers start beside a full heap
        self.tokenizer = Tokenizer.from_file(path)
        give_back()
        self.pieces = tiktoken.Encoding("pieces", pat_str="[^\0]+\0", mergeable_ranks=byte_ranks(path) if ranks is None else ranks, special_tokens={})
        self.mark = self.pieces.encode_ordinary("\x01\0")[0]
        self.known: dict[str, bytes] = {}
        give_back()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain, others = [], []
        for w in words:
            (plain if PLAIN.fullmatch(w) else others).append(w)
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            ids = self.pieces.encode_to_numpy(PIECE.sub("\\g<0>\0", "\x01".join(part).lower())).astype(np.uint16)
            ends, raw = (2 * np.append(np.flatnonzero(ids == self.mark), len(ids))).tolist(), ids.tobytes()
            self.known.update(zip(part, [raw[i:j] for i, j in zip([0, *(e + 2 for e in ends)], ends)]))
        self.known.update(zip(others, self._encode(others)))

    @staticmethod
    def _split(text: str) -> list[str] | None:
        if any(x in text for x in WHOLE):
            return None
        if _latin(text) and not DOUBLE.search(text):
            text = text.lower()
            for c in SINGLE:
                text = text.replace(c, f" {c} ")
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """uint16 ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = [self._split(t) for t in texts]
        new = set().union(*(s for s in split if s)).difference(self.known)
        if new:
            self._learn(list(new))
        return [self._encode([t])[0] if s is None else b"".join(map(self.known.__getitem__, s)) for t, s in zip(texts, split)]


def _tokenized(path: str, window: int, end: int):
    ranks_of = byte_ranks(path)  # read on the driver, once; a worker would hold the whole file as Python objects

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part = WordTokens(path, ranks_of), TaskContext.get().partitionId()
        ranks: Counter[int] = Counter()
        full, last = 0, np.array([end], np.uint16).tobytes()
        for b in batches:
            for k in range(0, len(b), 512):
                rows = b.iloc[k : k + 512]
                ids = [x + last for x in words.encode(["" if t is None else t for t in rows["text"]])]
                out = []
                for doc, x in zip(rows["doc_id"], ids):
                    n = len(x) // 2
                    rest = n % window
                    out.append((doc, x, n, rest, part, ranks[rest], full))
                    ranks[rest] += 1
                    full += n // window
                yield pd.DataFrame(out, columns=["doc_id", "ids", "n", "rest", "part", "rank", "full"])
    return run


# ---- the plan


def combinations(counts: dict[int, int], window: int) -> list[dict[int, int]]:
    """Length combinations that fill the window: all pairs, and with the most frequent lengths triples and repeats."""
    have, found = sorted(counts), []
    found += [{a: 1, window - a: 1} for a in have if a < window - a and window - a in counts]
    anchors = sorted(sorted(counts, key=lambda n: (-counts[n], n))[:ANCHORS])
    for i, a in enumerate(anchors):
        for b in anchors[i + 1 :]:
            if (c := window - a - b) in counts and c > 0:
                found.append(dict(Counter((a, b, c))))
        for m in range(2, DEEPEST + 1):
            c = window - m * a
            if c == 0 or c in counts:
                found.append(dict(Counter([a] * m + ([c] if c else []))))
    return list({tuple(sorted(x.items())): x for x in found}.values())


def repeat_counts(found: list[dict[int, int]], counts: dict[int, int]) -> np.ndarray:
    """Non-negative least squares by coordinate descent: least ||sum of x * combination - counts||, x >= 0."""
    x = np.zeros(len(found))
    left = {n: float(c) for n, c in counts.items()}
    for _ in range(SWEEPS):
        moved = 0.0
        for i, c in enumerate(found):
            step = sum(m * left[n] for n, m in c.items()) / sum(m * m for m in c.values())
            step = max(step, -x[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for n, m in c.items():
                    left[n] -= m * step
        if moved < 0.01:
            break
    return x


@dataclass
class Plan:
    """For each length: first ranks of its runs, and of each run the copies in a sequence, the first sequence and the offset.
    Ranks past ``used`` go to the stream, which starts for this length at ``base``."""

    window: int
    runs: dict[int, np.ndarray]
    used: dict[int, int]
    base: dict[int, int]
    packed: int
    stream: int

    @classmethod
    def of(cls, counts: dict[int, int], window: int) -> Plan:
        used: Counter[int] = Counter()
        runs: dict[int, list[tuple]] = {}
        sequence = 0
        for _ in range(ROUNDS):  # what rounding leaves is a histogram of its own, with other frequent lengths
            have = {n: c - used[n] for n, c in counts.items() if c > used[n]}
            found, before = combinations(have, window), sequence
            x = repeat_counts(found, have)
            for i in np.argsort(-x, kind="stable"):
                c = found[i]
                times = min(int(x[i] + 0.5), *((counts[n] - used[n]) // m for n, m in c.items()))
                if times <= 0:
                    continue
                offset = 0
                for n, m in c.items():
                    runs.setdefault(n, []).append((used[n], m, sequence, offset))
                    used[n] += times * m
                    offset += n * m
                sequence += times
            if sequence == before:
                break
        base, total = {}, 0
        for n in sorted(counts, reverse=True):
            base[n] = total
            total += n * (counts[n] - used[n])
        return cls(window, {n: np.array(r, np.int64).T for n, r in runs.items()}, dict(used), base, sequence, total)

    @property
    def cuts(self) -> list[int]:
        """Begins of the sequences in the last, partial window of the stream, and its end."""
        out, at = [], self.stream // self.window * self.window
        while at < self.stream:
            out.append(at)
            at += 1 << ((self.stream - at).bit_length() - 1)
        return [*out, at]

    @property
    def sequences(self) -> int:
        """Number of the first sequence that is a whole window of one document."""
        return self.packed + self.stream // self.window + len(self.cuts) - 1

    def pieces(self, n: int, rank: int, cuts: list[int]) -> list[tuple[int, int, int, int]]:
        """(begin in the rest, length, sequence, offset) of what is left of a document."""
        if rank < self.used.get(n, 0):
            first, copies, sequence, offset = self.runs[n]
            i = int(np.searchsorted(first, rank, side="right")) - 1
            k, m = divmod(rank - int(first[i]), int(copies[i]))
            return [(0, n, int(sequence[i]) + k, int(offset[i]) + m * n)]
        at = self.base[n] + (rank - self.used.get(n, 0)) * n
        out, begin, whole = [], 0, self.stream // self.window
        while begin < n:
            here = at + begin
            if here < whole * self.window:
                number, start = divmod(here, self.window)
                start, stop = number * self.window, (number + 1) * self.window
            else:
                k = int(np.searchsorted(cuts, here, side="right")) - 1
                number, start, stop = whole + k, cuts[k], cuts[k + 1]
            length = min(n - begin, stop - here)
            out.append((begin, length, self.packed + number, here - start))
            begin += length
        return out


def _pieces(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts, first, window = plan.cuts, plan.sequences, plan.window
        for b in batches:
            out = []
            for doc, x, n, rest, part, rank, full, before in zip(*(b[c] for c in ("doc_id", "ids", "n", "rest", "part", "rank", "full", "before"))):
                ids = np.frombuffer(x, np.uint16).astype("<u4")
                found = [(k * window, window, first + (part << 32) + full + k, 0) for k in range(n // window)]
                if rest:
                    found += [(n - rest + begin, *r) for begin, *r in plan.pieces(rest, rank + before, cuts)]
                for begin, length, sequence, offset in found:
                    out.append((doc, begin, length, zlib.crc32(ids[begin : begin + length].tobytes()), n, sequence, offset))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. ``tokenizer``: path of a
    vocabulary file that every machine has."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(map_frames(docs.select("doc_id", "text"), _tokenized(tokenizer, window, end), f"doc_id {kind}, ids binary, n long, rest int, part long, rank long, full long"), "tokens")
    sizes = tokens.groupBy("part", "rest").count()
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "sizes")
    counts = {n: c for n, c in sizes.where("rest > 0").groupBy("rest").agg(F.sum("count")).collect()}
    placed = tokens.join(sizes.select("part", "rest", "before"), ["part", "rest"])
    placed = placed.select("doc_id", "ids", "n", "rest", "part", "rank", "full", "before")
    return map_frames(
        placed, _pieces(Plan.of(counts, window)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
