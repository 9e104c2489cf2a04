"""Alignment of two tokenizers' tokens of the same bytes, by divide and conquer at shared cuts.

A byte-level tokenizer (A) and a piece tokenizer (B) cut a text at byte offsets; where both cut,
tokens before and after can be told apart on either side.  An interval of tokens is divided at the
common end nearest to its middle: ends of A are looked up among those of B by bisection,
first the middle one, then rings of twice the width around it.  Both halves are divided again;
an interval without a common end inside is a leaf, one group of tokens that belong together.  All intervals
of a step are divided at once.

Both tokenizers always cut before a blank or line end that follows another character,
and between a letter and an ASCII sign other than the apostrophe where no piece of B joins the two.  What lies
between such cuts, a word, is divided once and remembered by the worker.  Texts with other white space,
control characters or the sign that B writes for a blank are encoded and divided whole.

A pair of ids can only be linked if the bytes of one end the bytes of the other, so a corpus of any
size has no more different pairs than both vocabularies have bytes, twice over for B's pieces of
single bytes.  That table, about ten megabytes at most for vocabularies of this size, is the only thing
that goes to every task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .token_store import _LETTERS, _byte_letters

#: Words that a worker remembers: the first ones it meets, among which the frequent ones are.
KNOWN = 200_000
#: Bytes of text that are taken at once.
STEP = 2 << 20

_WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_SIGNS = r"!-&(-/:-@\[-`{-~"
_TAIL = re.compile(rf"(.*[{_LETTERS}])([{_SIGNS}]+)", re.S)
#: One piece of the byte-level tokenizer's own splitting.
_SIMPLE = re.compile(rf" ?(?:[{_LETTERS}]+|[{_SIGNS}]+|[0-9]+)")
#: White space that is neither blank nor line end, control characters, and what may count as either.
_ODD = re.compile(r"[^\S \n]|[\x00-\x09\x0b-\x1f\x7f-\x9f\u180e\u200b-\u200f\u2060\u2581\ufeff]")


def shared_ends(a: np.ndarray, b: np.ndarray, first: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """Which ends of a are ends of b too, found by dividing.

    a and b hold the ends of the tokens of some units (words or texts) one after another, all ascending; first and
    first_b are where each unit's ends start, and the length behind them.  Each unit's last ends are equal.
    """
    cut = np.zeros(len(a), bool)
    cut[first[1:] - 1] = True
    low, high, low_b, high_b = first[:-1], first[1:], first_b[:-1], first_b[1:]
    ring = np.zeros(len(low), np.int64)  # offsets below it have been looked at
    while True:
        # One token on either side can't be divided; the interval's own end is no end inside.
        middle = (low + high - 1) // 2
        open_ = (high - low > 1) & (high_b - low_b > 1) & ((middle - ring >= low) | (middle + ring <= high - 2))
        low, high, low_b, high_b, ring, middle = (x[open_] for x in (low, high, low_b, high_b, ring, middle))
        if not len(low):
            return cut
        width = np.maximum(ring, 1)  # the ring has offsets from ring to ring + width - 1, to both sides
        each = np.repeat(np.arange(len(low)), 2 * width)
        n = np.arange(len(each)) - np.repeat(np.cumsum(2 * width) - 2 * width, 2 * width)
        probe = middle[each] + (ring[each] + n // 2) * np.where(n % 2, 1, -1)
        inside = (probe >= low[each]) & (probe <= high[each] - 2)
        each, probe = each[inside], probe[inside]
        place = np.searchsorted(b, a[probe])
        hit = b[np.minimum(place, len(b) - 1)] == a[probe]
        found, nearest = np.unique(each[hit], return_index=True)
        at, at_b = probe[hit][nearest] + 1, place[hit][nearest] + 1
        cut[at - 1] = True
        rest = np.ones(len(low), bool)
        rest[found] = False
        zero = np.zeros(len(found), np.int64)
        low, high = np.concatenate([low[rest], low[found], at]), np.concatenate([high[rest], at, high[found]])
        low_b, high_b = np.concatenate([low_b[rest], low_b[found], at_b]), np.concatenate([high_b[rest], at_b, high_b[found]])
        ring = np.concatenate([(ring + width)[rest], zero, zero])


class Aligner:
    """Tokens of words and texts by both tokenizers, and their groups; a Python worker keeps one for each pair of files."""

    _made: dict = {}

    @classmethod
    def of(cls, bytes_path: str, pieces_path: str) -> Aligner:
        if (bytes_path, pieces_path) not in cls._made:
            cls._made[bytes_path, pieces_path] = cls(bytes_path, pieces_path)
        return cls._made[bytes_path, pieces_path]

    def __init__(self, bytes_path: str, pieces_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.whole_a = Tokenizer.from_file(bytes_path)
        self.whole_a.encode_special_tokens = True
        self.whole_b = SentencePieceProcessor(model_file=pieces_path)
        self.letters = _byte_letters()
        octet = {c: b for b, c in self.letters.items()}
        entries = self.whole_a.get_vocab(with_added_tokens=True)
        self.a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a[i] = bytes(octet[c] for c in entry) if all(c in octet for c in entry) else entry.encode()
        pieces = [self.whole_b.id_to_piece(i) for i in range(self.whole_b.get_piece_size())]
        self.b = [bytes([int(p[3:5], 16)]) if self.whole_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in v], np.int64) for v in (self.a, self.b))
        #: A pair of ids as one number.
        self.key = np.dtype("<u4" if len(self.a) * len(self.b) < 2**32 else "<u8")
        kept = [p for i, p in enumerate(pieces) if not self.whole_b.is_byte(i) and not self.whole_b.is_control(i) and not self.whole_b.is_unknown(i)]
        # Words are right only if no piece of B crosses their borders.
        crossing = re.compile(r"[^▁]▁|\n")
        self.by_words = not any(crossing.search(p) for p in kept)
        joined = re.compile(rf"[{_LETTERS}][{_SIGNS}]")
        self.by_signs = not any(joined.search(p) for p in kept)
        # A line end before a word keeps B from writing its own blank before it.
        self.before = self.whole_b.encode("\n")
        self.known: dict[str, int] = {}
        self.entries: list[tuple] = []  # (text of groups, pairs, tokens of A, tokens of B, groups)

    def _described(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        """For each unit the text of its groups, pairs of linked ids, and counts, given its ids by both."""
        count_a, count_b = (np.array([len(x) for x in v], np.int64) for v in (a, b))
        ids_a, ids_b = (np.array([i for x in v for i in x], np.int64) for v in (a, b))
        ends_a, ends_b = np.cumsum(self.a_lengths[ids_a]), np.cumsum(self.b_lengths[ids_b])
        first, first_b = np.r_[0, np.cumsum(count_a)], np.r_[0, np.cumsum(count_b)]
        cuts = np.flatnonzero(shared_ends(ends_a, ends_b, first, first_b))
        cuts_b = np.searchsorted(ends_b, ends_a[cuts])
        pairs = (ids_a[cuts] * len(self.b) + ids_b[cuts_b]).astype(self.key)
        groups = np.searchsorted(cuts, first)
        cut_list, cut_b_list, said_a, said_b = (cuts + 1).tolist(), (cuts_b + 1).tolist(), [str(i) for x in a for i in x], [str(i) for x in b for i in x]
        out = []
        for u, (g, h) in enumerate(zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True)):
            said, i, j = [], int(first[u]), int(first_b[u])
            for to, to_b in zip(cut_list[g:h], cut_b_list[g:h], strict=True):
                said.append(f"{','.join(said_a[i:to])}|{','.join(said_b[j:to_b])}")
                i, j = to, to_b
            out.append((";".join(said), pairs[g:h].tobytes(), len(a[u]), len(b[u]), h - g))
        return out

    def _ids(self, word: str) -> list[int]:
        if _SIMPLE.fullmatch(word):
            return [t.id for t in self.whole_a.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return self.whole_a.encode(word, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Enter words into the table; -1 stands for a word whose text must be taken whole."""
        fresh = [w for w in words if w not in self.known]
        plain = [w for w in fresh if not _ODD.search(w)]
        self.known.update((w, -1) for w in fresh if _ODD.search(w))
        if plain:
            given = self.whole_b.encode(["\n" + w for w in plain], num_threads=1)
            made = self._described([self._ids(w) for w in plain], [ids[len(self.before) :] for ids in given])
            self.known.update((w, len(self.entries) + k) for k, w in enumerate(plain))
            self.entries += made

    def _rows(self, lists: list[list[str]]) -> list[list[int]]:
        """Places in the table of the words of each text; words beyond what is remembered stay until forget()."""
        known = self.known
        missing = {w for words in lists for w in words if w not in known}
        split = {w: m.groups() for w in missing if self.by_signs and (m := _TAIL.fullmatch(w))}
        self._learn(sorted({p for w in missing for p in split.get(w, (w,))}))
        self.kept = min(len(self.entries), KNOWN)
        for w, (x, y) in split.items():
            i, j = known[x], known[y]
            known[w] = -1 if i < 0 or j < 0 else len(self.entries)
            if known[w] >= 0:
                (s, p, *n), (t, q, *m) = self.entries[i], self.entries[j]
                self.entries.append((f"{s};{t}", p + q, *(k + l for k, l in zip(n, m, strict=True))))
        self.late = [w for w in missing if not 0 <= known.get(w, -1) < self.kept] + [p for w in split.values() for p in w if not 0 <= known.get(p, -1) < self.kept]
        return [[known[w] for w in words] for words in lists]

    def _forget(self) -> None:
        for w in self.late:
            self.known.pop(w, None)
        del self.entries[self.kept :]

    def whole(self, text: str) -> tuple:
        """The same for a text as a whole; nothing if either tokenizer does not give its bytes back."""
        a, b = self.whole_a.encode(" " + text, add_special_tokens=False).ids, self.whole_b.encode(text)
        octets = (" " + text).encode()
        if b"".join(map(self.a.__getitem__, a)) != octets or b"".join(map(self.b.__getitem__, b)) != octets:
            return ("", b"", 0, 0, 0)
        return self._described([a], [b])[0]

    def aligned(self, texts: list[str]) -> list[tuple]:
        """(text of groups, pairs, tokens of A, tokens of B, groups) of each text."""
        lists = [_WORD.findall(" " + t) if t and self.by_words else [] for t in texts]
        out = []
        for text, places in zip(texts, self._rows(lists), strict=True):
            if not text:
                out.append(("", b"", 0, 0, 0))
            elif not places or min(places) < 0:
                out.append(self.whole(text))
            else:
                said, pairs, *counts = zip(*map(self.entries.__getitem__, places), strict=True)
                out.append((";".join(said), b"".join(pairs), *map(sum, counts)))
        self._forget()
        return out


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary"


def aligned_tokens(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, groups_sha256, pairs (packed numbers of the linked ids, one for each link)."""

    def run(batches):
        aligner = Aligner.of(bytes_path, pieces_path)
        for batch in batches:
            edges = np.cumsum(np.r_[0, pc.binary_length(pc.fill_null(batch.column(1), "")).to_numpy()])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(edges, edges[low] + STEP, "right")) - 1)
                part = batch.slice(low, high - low)
                rows = aligner.aligned([t or "" for t in part.column(1).to_pylist()])
                said, pairs, *counts = zip(*rows, strict=True)
                sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(pairs, pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"],
                )
                low = high

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame, key: np.dtype) -> DataFrame:
    """aligned -> pair, n: how many links of all documents hold each pair.  Each task counts its own first."""

    def run(batches):
        keys, counts = np.zeros(0, key), np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            got, n = np.unique(np.frombuffer(b"".join(column.to_pylist()), key), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, got]), return_inverse=True)
            both = np.zeros(len(keys), np.int64)
            np.add.at(both, place, np.concatenate([counts, n]))
            counts = both
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    own = aligned.select("pairs").mapInArrow(run, "pair long, n long")
    return own.groupBy("pair").agg(F.sum("n").alias("n"))


def most_pairs(aligner: Aligner) -> int:
    """More different pairs than this can't be linked: for each id, the ends of its bytes that are ids of the other; single bytes are twice in B."""
    return int((aligner.a_lengths + 1).sum() + aligner.b_lengths.sum())


def alignment(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """For each row of docs (doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Blank and text are encoded by A, text by B (which writes the blank itself), both without special
    tokens.  Null and empty texts, and texts that either tokenizer does not give back byte by
    byte, have no tokens: counts of zero and an empty groups_sha256.  A link is a token of A and
    one of B that end at the same byte; its count is how many links of all rows hold the same
    two ids; n_best is links whose count no other id of A reaches with their id of B.
    groups_sha256 is that of the ids in order, "a1,a2|b1;a3|b2".  Repeated rows are repeated and count
    each; null doc_ids stay null; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    aligner = Aligner.of(bytes_path, pieces_path)
    key, of_b, bound = aligner.key, len(aligner.b), most_pairs(aligner)
    rows = staged(aligned_tokens(docs, bytes_path, pieces_path), "aligned-tokens")
    table = pair_counts(rows, key).toArrow()  # bounded by the vocabularies, see most_pairs
    if table.num_rows > bound:
        raise AssertionError("more pairs of ids than the vocabularies allow")
    pairs, n = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    most = np.zeros(of_b, np.int64)
    np.maximum.at(most, pairs % of_b, n)
    shared = spark.sparkContext.broadcast((pairs.astype(key), n, n == most[pairs % of_b]))

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            links = batch.column(5).to_pylist()
            edges = np.cumsum([0, *(len(x) // key.itemsize for x in links)])
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), key))
            sums = [pa.array(np.diff(np.r_[0, np.cumsum(v[at], dtype=np.int64)][edges])) for v in (best, n)]
            # A token of A and one of B that end together are one link, and the last of one group.
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch.column(3), *sums, batch.column(4)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            )

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
