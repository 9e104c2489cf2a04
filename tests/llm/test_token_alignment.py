"""Alignment of two tokenizers against a plain version that encodes whole texts and meets ends in sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from recordgate.llm.queries import op12_token_alignment, tokenizer_path
from recordgate.llm.shared import load
from recordgate.llm.token_alignment import Aligner, alignment, most_pairs, shared_ends

from .helpers import AWKWARD, documents

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """Rows of the query by its definition; rows: (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    seen = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    octet = {chr(x): x for x in seen} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in seen)}
    entry = {i: t for t, i in a.get_vocab().items()}
    bytes_a = lambda i: bytes(octet[c] for c in entry[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made, counts = [], Counter()
    for doc, text in rows:
        one, other = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        octets = (" " + text).encode() if text else b""
        if b"".join(map(bytes_a, one)) != octets or b"".join(map(bytes_b, other)) != octets:
            one, other = [], []
        ends_a = np.cumsum([len(bytes_a(i)) for i in one]).tolist()
        ends_b = np.cumsum([len(bytes_b(i)) for i in other]).tolist()
        at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        shared, i, j, said, links = sorted(at_a.keys() & at_b.keys()), 0, 0, [], []
        for e in shared:
            k, m = at_a[e] + 1, at_b[e] + 1
            said.append(",".join(map(str, one[i:k])) + "|" + ",".join(map(str, other[j:m])))
            links.append((one[k - 1], other[m - 1]))
            i, j = k, m
        counts.update(links)
        made.append((doc, len(one), len(other), len(shared), links, hashlib.sha256(";".join(said).encode()).hexdigest() if one else ""))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, x, y, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha) for d, x, y, g, links, sha in made]


def got(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_dividing_finds_all_shared_ends(seed):
    r = random.Random(seed)
    ends = lambda n, p: [e for e in range(1, n) if r.random() < p] + [n]
    a, b, first, first_b, at = [], [], [0], [0], 0
    for _ in range(200):
        n, p = r.choice([1, 2, 7, 60, 900]), r.choice([0.02, 0.3, 0.9])
        x, y = ends(n, p), ends(n, r.choice([0.02, 0.3, 0.9]))
        a, b = a + [at + e for e in x], b + [at + e for e in y]
        first, first_b, at = first + [len(a)], first_b + [len(b)], at + n
    found = shared_ends(*(np.array(v) for v in (a, b, first, first_b)))
    assert [e for e, c in zip(a, found, strict=True) if c] == sorted(set(a) & set(b))


TEXTS = [
    "It's a test, isn't it? Don't: 'quoted' (and) [so] on...", "\nline\n\nline \n x\n", "  two  blanks   here ", " ", "\n", "\n\n", "tab\there\r\nand\x0bthere", "no break　space",
    "a ▁ sign", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 と emoji 😀👍🏽 mixed", "Größe über Ärger ÿ", "x" * 3000, "ab" * 2000 + " ", "12345 1,234.56 3rd 42nd", "\x00 null", "é combining é",
    "العربية हिन्दी русский", "%%%&&& ###,,, foo%%% bar&&&", "foo'll we've I'd he's 'tis o'clock'", "﻿bom", "zero​width", "a.b.c,d;e", "l'eau d'été", "µ º ª × ÷ foo×", "end.\n", "x\n y",
]


@pytest.mark.parametrize("known", [300_000, 5])
def test_equals_plain_on_all_kinds_of_texts(spark, monkeypatch, known):
    monkeypatch.setattr("recordgate.llm.token_alignment.KNOWN", known)
    r = random.Random(1)
    parts = [t for t in TEXTS if len(t) < 100]
    mixed = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    signs = ["".join(r.choice("ab Zé.,'\n -1 \t") for _ in range(r.randint(1, 60))) for _ in range(300)]
    rows = list(enumerate(TEXTS + mixed + signs))
    aligner = Aligner(*PATHS)
    for (_, text), (said, _, *counts) in zip(rows, aligner.aligned([t for _, t in rows]), strict=True):
        other = aligner.whole(text)
        assert (said, *counts) == (other[0], *other[2:]), text
    if known > 5:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(alignment(df, *PATHS)) == sorted(plain(rows), key=repr)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    assert got(alignment(documents(spark, AWKWARD), *PATHS)) == sorted(plain(rows), key=repr)
    assert got(alignment(documents(spark, []), *PATHS)) == []


def test_query_equals_plain_on_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, sf, "documents").collect()]
    assert got(op12_token_alignment(spark, sf)) == sorted(plain(rows), key=repr)


def test_the_table_of_pairs_is_small():
    assert most_pairs(Aligner.of(*PATHS)) < 1_000_000
