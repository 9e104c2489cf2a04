"""Vector search, source mixing, token store, licence scan and decontamination against plain versions."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordgate.llm import source_mixing as M
from recordgate.llm import token_store as S
from recordgate.llm import vector_search as V
from recordgate.llm.decontamination import Blocks, _running, contamination, flagged, simhash, window_prints
from recordgate.llm.license_scan import TEMPLATES, bigram_set, license_scan, license_sql, normal_words
from recordgate.llm.queries import op2_vector_search, op4_decontamination, op7_source_mixing, op8_token_store, op10_license_scan, tokenizer_path
from recordgate.llm.shared import load

from .helpers import AWKWARD, documents

# Vector search


def plain_nearest(rows, asked, k):
    good = [(i, np.array(x, float)) for i, x in rows if x is not None and None not in x and np.isfinite(x).all() and np.any(np.array(x) != 0)]
    out = []
    for q, x in good:
        if q in asked:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def test_nearest_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in load(spark, sf, "embeddings").collect()]
    want = plain_nearest(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    got = sorted(tuple(r) for r in op2_vector_search(spark, sf).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_nearest_in_small_blocks_with_ties_and_unfit_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, float("nan"), 0.0, 0.0]), (203, [1.0, None, 0.0, 0.0]), (204, []), (205, [1.0, 2.0]), (206, [2.0, 2.0]), (207, [1.0, float("inf"), 1.0, 1.0])]
    frame = spark.createDataFrame([(i, x, 0, "a") for i, x in rows], "vec_id long, embedding array<double>, score int, rank string")
    want = plain_nearest(rows, set(range(0, 300, 5)), 3)
    monkeypatch.setattr(V, "BUCKET_ROWS", 16)
    got = sorted(tuple(r) for r in V.nearest(frame, frame.where("vec_id % 5 = 0"), k=3, block=8).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    again = V.nearest(frame.unionByName(frame), frame.where("vec_id % 5 = 0"), k=3).collect()
    assert sorted(tuple(r)[:3] for r in again) == [w[:3] for w in want]
    assert V.nearest(frame.limit(0), frame).count() == 0


def test_nearest_among_many_rows_of_one_vector(spark):
    """Rows that share a vector: the smallest ids win, and only a few of them leave their group."""
    rows = [(k, [1.0, 2.0, 0.5] if k % 3 else [float(k), -1.0, 2.0]) for k in range(600)] + [(k, [1.0, 2.0, 0.5]) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in V.nearest(frame, frame.where("vec_id in (1, 3, 50, 599)"), k=4, block=8).collect())
    want = []
    for q in (1, 3, 50, 599):
        best = {}
        for x in (x for i, x in rows if i == q):
            for i, y in rows:
                if i != q:
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(np.cumsum((np.array(x) - np.array(y)) ** 2)[-1])))
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:4])]
    assert got == sorted(want)
    assert V.first_alike(np.array([5, 3, 3, 9, 1, 2]), np.array([7, 7, 7, 7, 8, 7]), 2).tolist() == [1, 4, 5]


def test_nearest_of_vectors_whose_squares_overflow(spark):
    frame = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 0.0]), (5, [3.0, 4.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in V.nearest(frame, frame.where("vec_id = 0"), k=3).orderBy("rank").collect()]
    assert got[0] == (0, 1, 1, 1.0) and [g[2] for g in got[1:]] == [2, 5] and all(np.isinf(g[3]) for g in got[1:])


# Source mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return held | target
        held |= {s: float(most * sizes[s]) for s in over}


def test_mixing_query(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "text").collect()
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len((d.text or "").encode().split())
    want = plain_targets(sizes)
    got = {r.doc_id: r for r in op7_source_mixing(spark, sf).collect()}
    assert len(got) == len(docs)
    taken, largest = Counter(), Counter()
    for d in docs:
        r = got[d.doc_id]
        assert r["size"] == len((d.text or "").encode().split()) and r.source_size == sizes[d.source]
        assert r.target == pytest.approx(want[d.source])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[d.source] += r.taken
        largest[d.source] = max(largest[d.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = {r.doc_id: r.taken for r in op7_source_mixing(spark, sf).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_mix_of_rows_alike_is_what_the_plan_takes(spark):
    """A thousand rows without a doc_id and of one size, some with one text: words written are the words taken."""
    rows = [(None, f"w{k % 300} " * 5, "a") for k in range(1000)] + [(k, "x y z " * (k % 7), "b") for k in range(300)] + [(7, "same text", "c")] * 40
    docs = documents(spark, rows).repartition(6)
    plan = M.mix(docs)
    taken = {r["source"]: r["n"] for r in plan.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    copies = {r["source"]: r["n"] for r in plan.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    written = {r["source"]: (r["n"], r["words"]) for r in mixed.groupBy("source").agg(F.count("*").alias("n"), F.sum(M.word_count(F.col("text"))).alias("words")).collect()}
    assert written == {s: (copies[s], taken[s]) for s in taken}
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, M.mixed_documents(documents(spark, rows)).collect()))


def test_mixing_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_ROWS", 2)
    monkeypatch.setattr(M, "RANGE_ROWS", 25)
    rows = AWKWARD + [(100 + k, f"w {k} " * (k % 7), f"s{k % 9}") for k in range(200)] + [(400, "", "empty"), (401, None, "empty")]
    got = M.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").encode().split())
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.source_size == sizes[r.source] and r.copies <= 3
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    mixed = M.mixed_documents(documents(spark, rows))
    assert mixed.columns == documents(spark, []).columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert M.mix(documents(spark, [])).count() == 0 and M.mixed_documents(documents(spark, [])).count() == 0


def test_likelier_documents_are_of_better_quality(spark):
    docs = documents(spark, [(k, "one two three", "ab"[k % 2]) for k in range(4000)])
    quality = spark.createDataFrame([(k, 1.0 if k % 4 < 2 else 0.25) for k in range(4000)], "doc_id long, quality double")
    rows = M.mix(docs, quality).where("source = 'b'").collect()
    picked = lambda good: sum(r.taken > 0 for r in rows if (r.doc_id % 4 < 2) == good)
    assert picked(True) > 2 * picked(False) > 0


# Token store


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_query(spark, sf):
    rows = sorted((r.doc_id, r.text or "") for r in load(spark, sf, "documents").select("doc_id", "text").collect())
    want, start = [], 0
    for (doc_id, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op8_token_store(spark, sf).collect()) == want


def test_encoder_on_odd_texts():
    texts = [
        "", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n", "it's we'll I'd 'tis ''s", "x'S don't!'s", "Àé ß ÿ × ÷ ª º", "12 345a6 ½ ²",
        "tab\tand\rreturn", "emoji \U0001f600 中文", "<|endoftext|> x", "a b", "a\x1cb", "!!! ... ,,'s", "end.\nNext line's", "word" * 500, "\x00\x01",
    ]
    encoder = S.Encoder(tokenizer_path())
    want = [[*ids, 2] for ids in plain_ids(texts)]
    assert encoder.lists(pa.array(texts), 2).to_pylist() == want
    plain = [k for k, t in enumerate(texts) if S._plain(t) and "<|" not in t]
    assert len(plain) > 8
    assert encoder.lists(pa.array(["no", *(texts[k] for k in plain), ""]).slice(1), 2).to_pylist() == [*(want[k] for k in plain), [2]]


def test_encoder_on_random_texts():
    rng = np.random.default_rng(8)
    parts = [*"abstremvldABZ019é.,'’-!? \n", "'s", "'re", "'ll", "\n\n", " '", "don't", "\t", "  ", "中"]
    odds = np.r_[np.ones(len(parts) - 3), [0.01, 0.05, 0.01]]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30), p=odds / odds.sum())) for _ in range(4000)]
    assert S.Encoder(tokenizer_path()).lists(pa.array(texts), 2).to_pylist() == [[*ids, 2] for ids in plain_ids(texts)]


def test_pieces_forgotten_are_encoded_again(monkeypatch):
    monkeypatch.setattr(S, "KNOWN", 2)
    texts = ["some words here and some there", "words and here"] * 3
    assert S.Encoder(tokenizer_path()).lists(pa.array(texts), 2).to_pylist() == [[*ids, 2] for ids in plain_ids(texts)]


def test_token_store_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    got = S.token_digest(documents(spark, rows), tokenizer_path()).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert S.token_digest(documents(spark, []), tokenizer_path()).count() == 0


def test_files_have_page_indexes_and_packed_metadata(spark, sf, tmp_path):
    import pyarrow.parquet as pq

    S.write_tokens(load(spark, sf, "documents"), str(tmp_path / "store"), tokenizer_path())
    part = next(p for p in (tmp_path / "store").glob("part-*.parquet"))
    group = pq.ParquetFile(part).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)


# Licence scan


def test_license_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(license_sql()).fetchall()
    got = [tuple(r) for r in op10_license_scan(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 0


def plain_dice(line, template):
    a, b = set(bigram_set(normal_words(line))), set(bigram_set(normal_words(template)))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_license_bounds_lose_nothing(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for name, text in TEMPLATES:
        words = text.split()
        for drop in range(6):
            kept = [w for w in words if rng.random() > 0.06 * drop]
            rows.append((k, "Some words before.\n" + " ".join(kept) + "\nand after"))
            k += 1
        half = len(words) // 2
        rows.append((k, "intro\n\n" + " ".join(words[:half]) + "\n" + " ".join(words[half:]) + "\n\nrest of the text"))
        k += 1
    got = {r.doc_id: r for r in license_scan(documents(spark, rows)).collect()}
    for i, text in rows:
        lines = text.split("\n") + [p.replace("\n", " ") for p in text.split("\n\n") if "\n" in p]
        best = max((round(plain_dice(u, t), 6), n) for u in lines for n, t in TEMPLATES)
        if best[0] >= 0.8:
            assert got[i].dice == best[0], text
        else:
            assert got[i].license is None and got[i].n_matches == 0, text
    assert any(g.license is None for g in got.values())


def test_license_awkward_rows(spark):
    got = license_scan(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.n_matches == 0 and r.license is None and r.dice is None and r.licenses == "" for r in got)
    assert license_scan(documents(spark, [])).count() == 0


# Decontamination


def plain_leaks(texts, items, least=0.8):
    """For each text the items it leaks, by comparing all windows with each item that it shares a shingle with."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    grams = lambda words, n: [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    known, holders = {}, {}
    for item, text in items:
        words = split(text)
        if words:
            width = min(5, len(words))
            known[item] = (width, Counter(grams(words, width)))
            for g in known[item][1]:
                holders.setdefault(g, set()).add(item)
    out = []
    for t in texts:
        words, found = split(t), {}
        own = {n: grams(words, n) for n in range(1, 6)}
        for item in {i for n in own for g in own[n] for i in holders.get(g, ())}:
            width, counts = known[item]
            size = counts.total()
            for s in range(max(1, len(own[width]) - size + 1)):
                window = Counter(own[width][s : s + size])
                shared = (window & counts).total()
                sim = shared / (window.total() + size - shared)
                if sim >= least:
                    found[item] = max(sim, found.get(item, 0))
        out.append(found)
    return out


def edited(rng, text, rate):
    return " ".join(f"zz{rng.integers(99)}" if rng.random() < rate else w for w in text.split())


def test_decontamination_query(spark, sf):
    docs = load(spark, sf, "documents").collect()
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    got = {r.doc_id: r for r in op4_decontamination(spark, sf).collect()}
    assert len(got) == len(docs)
    texts = [(d.doc_id, d.text) for d in docs]
    exact = {d for d, t in texts if any(i in t for _, i in items)}
    assert exact and all(got[d].contaminated for d in exact)
    leaks = dict(zip((d for d, _ in texts), plain_leaks([t for _, t in texts], items), strict=True))
    assert all(got[d].n_items <= len(leaks[d]) for d in leaks)
    pairs = sum(map(len, leaks.values()))
    assert pairs > 20 and sum(r.n_items for r in got.values()) >= 0.95 * pairs
    assert sum(r.contaminated for r in got.values()) >= 0.95 * sum(map(bool, leaks.values()))
    for d, r in got.items():
        if r.n_items == len(leaks[d]) > 0:
            assert r.best_similarity == pytest.approx(max(leaks[d].values()))


def test_decontamination_of_edited_passages(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate(rng.integers(3, 60, 40).tolist())]
    rows = []
    for k in range(150):
        around = lambda: " ".join(rng.choice(vocabulary, 40))
        rows.append((k, f"{around()} {edited(rng, items[k % 40][1], 0.015 * (k % 5))} {around()}"))
    bench = spark.createDataFrame([*items, (50, None), (51, "?!"), (None, "w1 w2")], "item_id long, text string")
    want = plain_leaks([t for _, t in rows], items)
    pairs = sum(map(len, want))
    for block in (5000, 7):
        got = {r.doc_id: r for r in flagged(documents(spark, rows), bench, block=block).collect()}
        assert all(got[d].n_items <= len(leaks) for (d, _), leaks in zip(rows, want, strict=True))
        assert pairs > 60 and sum(r.n_items for r in got.values()) >= 0.95 * pairs
        for (d, _), leaks in zip(rows, want, strict=True):
            if got[d].n_items == len(leaks) > 0:
                assert got[d].best_similarity == pytest.approx(max(leaks.values()))


def test_long_texts_are_scanned_in_stretches(spark, monkeypatch):
    from recordgate.llm import decontamination as D

    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([20, 40, 60, 3])]
    text = " ".join(" ".join([*rng.choice(vocabulary, 90), items[k % 4][1]]) for k in range(20))
    monkeypatch.setattr(D, "STRETCH", 64)
    index = D.Index(*zip(*items, strict=True), D.RADIUS)
    assert D._scan([text, "", text[:300]], index, 0.8)[0] == pytest.approx(plain_leaks([text], items)[0])


def test_index_finds_everything_within_the_radius_and_little_else():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 60).astype(np.uint64)
    blocks = Blocks(prints, 15)
    fps = np.concatenate([rng.integers(0, 2**63, 3000).astype(np.uint64)] + [prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, False))) for n in (1, 8, 14, 15, 16, 17)])
    got = set(zip(*(x.tolist() for x in blocks.within(fps)), strict=True))
    assert got == {(i, k) for i, f in enumerate(fps) for k in np.flatnonzero(np.bitwise_count(prints ^ f) <= 15).tolist()} and len(got) > 200
    assert np.bitwise_count(blocks.returned(fps[:3000])).mean() / 60 < 0.05


def test_window_prints_are_majorities():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 40).astype(np.uint64)
    start = np.array([0, 3, 7, 20, 39])
    end = np.array([40, 10, 15, 22, 40])
    got = window_prints(_running(hashes), start, end)
    plain = [simhash(hashes[s:e]) for s, e in zip(start, end, strict=True)]
    assert got.tolist() == plain and simhash(np.array([5, 5, 2], np.uint64)) == simhash(np.array([5], np.uint64))
    for s, e, f in zip(start, end, got, strict=True):
        ones = sum(2 * sum((int(h) >> b) & 1 for h in hashes[s:e]) > e - s for b in range(64))
        assert int(f).bit_count() == ones


def test_decontamination_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "same text here said twice over"), (1, "same text here said twice over"), (2, "word")], "item_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_items) for r in flagged(documents(spark, AWKWARD), bench).collect())
    assert got == [(False, 0, 0), (True, 1, 0), (True, 2, 0), (True, 3, 1), (True, 4, 0), (True, 5, 0), (True, 6, 1), (True, 7, 1), (True, 7, 1), (True, 9, 0)]
    assert contamination(documents(spark, []), bench).count() == 0
    assert flagged(documents(spark, AWKWARD), bench.limit(0)).where("contaminated").count() == 0
