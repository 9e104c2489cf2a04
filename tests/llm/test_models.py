"""Toxicity on held-out labels, chat roles against all paths, and the pipeline's stages."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from recordgate.llm import chat_roles as C
from recordgate.llm import toxicity as T
from recordgate.llm.queries import op3_toxicity, op9_chat_roles
from recordgate.llm.shared import load

from .helpers import AWKWARD, documents

SF = "/root/testdata/sf0.1"


def test_held_out_documents_are_told_apart(spark):
    got = {r.doc_id: r for r in op3_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in load(spark, SF, "labels").collect()}
    assert len(got) == load(spark, SF, "documents").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    toxic, clean = [p for y, p in unseen if y == 1], [p for y, p in unseen if y == 0]
    assert len(toxic) > 100 and sum(toxic) / len(toxic) >= 0.88
    assert sum(clean) / len(clean) <= 0.01


def test_kernel_tolerates_gaps_and_insertions():
    for near in (b"idiiot", b"id.iot", b"1diot", b"idXiot", b"i d i o t", b"i_d_i_o_t"):
        assert T.kernel(b"idiot", near) > T.LEAST, near
    assert T.kernel(b"idiot", b"holiday") < T.LEAST and T.kernel(b"", b"idiot") == 0
    words = T.split_words(["You i d i o t! ok"])
    assert [words.data[s:e] for s, e in zip(words.starts, words.ends, strict=True)] == [b"you", b"i d i o t!", b"ok"]


def _held_out_texts():
    """(toxic and clean texts to learn from, toxic and clean texts held out) of the larger tables."""
    import duckdb

    rows = duckdb.sql(f"SELECT d.doc_id, coalesce(d.text, ''), max(l.toxic) FROM '{SF}/documents.parquet' d JOIN '{SF}/labels.parquet' l USING (doc_id) GROUP BY 1, 2 ORDER BY 1").fetchall()
    out = zlib.crc32
    parts = [[t for d, t, y in rows if y == kind and (out(str(d).encode()) % 3 == 1) == held and (held or len(t) <= T.FIT_CHARS)] for held in (False, True) for kind in (1, 0)]
    return [p[: T.SAMPLE] for p in parts[:2]] + parts[2:]


def test_misspelt_insults_are_found():
    """Insults of held-out documents with a letter put in or left out, or with signs or blanks between all letters."""
    toxic, clean, unseen, unseen_clean = _held_out_texts()
    model = T.fit(toxic, clean)
    # Plain insults of the tables.
    insults = ["trash", "idiot", "pathetic", "worthless", "scum", "stupid", "loser", "moron", "disgusting", "clown"]
    plain = re.compile(rf"\b(?:{'|'.join(insults)})\b", re.I)
    rude = [t for t in unseen if plain.search(t)]
    rng = np.random.default_rng(11)

    def inserted(w):
        k = rng.integers(1, len(w))
        return w[:k] + rng.choice(list("abcdefghijklmnopqrstuvwxyz")) + w[k:]

    def left_out(w):
        k = rng.integers(1, len(w) - 1)
        return w[:k] + w[k + 1 :]

    found = lambda change: (model.score([plain.sub(lambda m: change(m.group()), t) for t in rude]) >= T.THRESHOLD).mean()
    assert len(rude) > 60
    assert found(str) >= 0.95 and found(inserted) >= 0.9 and found(left_out) >= 0.9
    assert found(".".join) >= 0.9 and found(" ".join) >= 0.8 and found("_".join) >= 0.9
    changed = [re.sub(r"[A-Za-z]{4,}", lambda m: inserted(m.group()), t) for t in unseen_clean]
    for texts in (unseen_clean, changed):
        assert (model.score(texts) >= T.THRESHOLD).mean() <= 0.01


def test_telling_words_and_misspelling():
    words = T.misspelt_texts(["You IDIOT, idiots are no idiot."], {"idiot"}, 1)[0].split(" ")
    assert words[0] == "You" and "idiots" in words and words[1] != "IDIOT,"
    assert T.misspelt_texts(["You idiot"], {"idiot"}, 1) == T.misspelt_texts(["You idiot"], {"idiot"}, 1)
    toxic, clean = [f"what a idiot {k}" for k in range(60)], [f"what a thing {k}" for k in range(200)]
    assert T.telling_words(toxic, clean, 8) == [b"idiot"]
    assert T.telling_words(clean, clean, 8) == []


def test_common_words_do_not_hide_the_telling_ones():
    """Toxic texts of a large sample hold common words more often than chance explains, as they are a little longer."""
    rng = np.random.default_rng(8)
    common, plain = ["in", "eren", "on", "as"], ["nice", "day", "weather", "holiday", "thing", "moreover", "café"]

    def text(share, *more):
        return ". ".join(" ".join([*rng.choice(plain, 5), *[w for w in common if rng.random() < share]]) for _ in range(3)) + "".join(f". what {w} you are" for w in more)

    insults = ["idiot", "moron", "trash", "loser"]
    texts = lambda n: ([text(0.3, rng.choice(insults)) for _ in range(n)], [text(0.2) for _ in range(n)])
    toxic, clean = texts(800)
    assert not set(T.telling_words(toxic, clean, 16)) & {w.encode() for w in common}
    model = T.fit(toxic, clean)
    unseen, unseen_clean = texts(100)
    assert (model.score(unseen) >= T.THRESHOLD).mean() > 0.9 and (model.score(unseen_clean) >= T.THRESHOLD).mean() < 0.05


def test_a_telling_word_that_clean_documents_hold_too_is_learned():
    toxic, clean = [f"what a idiot {k % 9}. so it goes" for k in range(200)], [f"what a {'idiot' if k % 5 == 0 else 'thing'} {k % 9}. so it goes" for k in range(400)]
    told = T.fit(toxic, clean).score(["such an idiot", "such a thing"])
    assert told[0] > told[1] + 0.2


def test_bound_loses_no_word():
    rng = np.random.default_rng(3)
    marks = T.Landmarks([b"idiot", b"moron", b"trash", b"worthless", "réeux".encode()])
    texts = ["".join(rng.choice(list("abdeihlmnorstwé. -1"), 400)) for _ in range(40)] + ["an id-iot and a mo.ron, w0rthles réeuxpa"]
    words = T.split_words(texts)
    kept = set(marks.candidates(words).tolist())
    own = [words.data[s:e] for s, e in zip(words.starts, words.ends, strict=True)]
    near = marks.resemblances(own)
    plain = np.array([[T.kernel(w, m) for m in marks.strings] for w in own])
    assert np.allclose(near, np.where(plain < T.LEAST, 0, plain), atol=1e-9) and near.any(1).sum() > 3
    assert set(np.flatnonzero(near.any(1)).tolist()) <= kept


def test_scores_equal_a_plain_kernel_machine():
    rng = np.random.default_rng(4)
    pool = ["nice", "day", "so", "it", "goes", "weather", "holiday", "reading", "thing", "moreover", "café"]
    text = lambda more: ". ".join(" ".join(rng.choice([*pool, *more], 6)) for _ in range(4))
    toxic, clean = [text(["idiot", "moron", "idi0t"]) for _ in range(60)], [text([]) for _ in range(150)]
    model = T.fit(toxic, clean)
    k = np.array([[T.kernel(a, b) for b in model.landmarks.strings] for a in model.landmarks.strings])
    values, vectors = np.linalg.eigh(k + T.RIDGE * np.eye(len(k)))
    alpha = vectors @ np.diag(values**-0.5) @ vectors.T @ model.weights
    texts = [*toxic[:10], *clean[:10], "what an id-iot", "i d i o t", "", "Mor on. mmoron!"]
    for t, score in zip(texts, model.score(texts), strict=True):
        margins = []
        for sentence in re.split(r"(?<=[.!?])\s", t):
            words = T.split_words([sentence])
            own = [[T.kernel(words.data[s:e], m) for m in model.landmarks.strings] for s, e in zip(words.starts, words.ends, strict=True)]
            best = np.array(own).max(0) if own else np.zeros(len(alpha))
            margins.append(np.where(best < T.LEAST, 0, best) @ alpha + model.bias)
        total = sum(max(m, 0) for m in margins)
        columns = [np.clip(max(margins), -3, 3), np.log1p(total), np.log1p(100 * total / max(t.count(" ") + t.count("\n") + 1, 30)), 1]
        assert np.isclose(score, 1 / (1 + np.exp(-np.array(columns) @ model.scale)), rtol=1e-3, atol=1e-4)
    assert (model.score(["such an idiiot", "id.iot, so it goes"]) > 0.5).all() and (model.score([*clean, "", "all well here"]) < 0.5).all()


def test_toxicity_awkward_rows(spark):
    train = [(k, (None, "you are an idiot. nice day.", "what a nice day it is. all well here.", "what a moron you are.")[k % 4] if k % 4 else "so it goes. nothing here.") for k in range(240)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)] + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    got = T.toxicity(documents(spark, AWKWARD), documents(spark, train), labels).collect()
    assert len(got) == len(AWKWARD) and all(r.predicted == 0 for r in got)
    rude = T.toxicity(documents(spark, [(1, "such an id_iot"), (2, None)]), documents(spark, train), labels).collect()
    assert sorted((r.doc_id, r.predicted) for r in rude) == [(1, 1), (2, 0)]
    none = T.toxicity(documents(spark, AWKWARD), documents(spark, train), labels.where("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in none)
    assert T.toxicity(documents(spark, []), documents(spark, []), labels).count() == 0


# Chat roles


def plain_scores(e, model):
    for path in itertools.product(range(C.STATES), repeat=len(e)):
        yield model.start[path[0]] + e[0][path[0]] + sum(model.steps[a, b] + e[k + 1][b] for k, (a, b) in enumerate(itertools.pairwise(path)))


def taught(*conversations):
    """A model that has seen conversations, each a list of (role, text), many times over."""
    rows = [(f"c{n}", n, k, role, text) for n, own in enumerate(conversations) for k, (role, text) in enumerate(own)]
    table = pa.table({"conv": [r[0] for r in rows], "seg": [r[1] for r in rows], "dated": [1] * len(rows), "turn": [r[2] for r in rows], "role": [r[3] for r in rows], "text": [r[4] for r in rows]})
    counts = C._counted(table).to_pylist()
    return C.model_of([(r["kind"], r["word"], r["at"], r["state"], 20 * r["n"]) for r in counts])


TALK = taught(
    [("system", "System: be brief\nand kind"), ("user", "Human: what is it?\nplease"), ("assistant", "AI: this\nand that"), ("user", "more?"), ("assistant", "AI: so it goes\n\nlast")],
    [("user", "Human: hello?"), ("assistant", "yes\nindeed"), ("user", "Human: why?"), ("assistant", "AI: Note: because")],
)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    pool = ["Human: hello?", "hi", "AI: yes", "so it goes", "System: be brief", "", "why?", "Note: x"]
    for _ in range(15):
        lines = [(str(rng.choice(pool)), bool(rng.integers(2))) for _ in range(int(rng.integers(1, 6)))]
        e = TALK.emissions(lines)
        path = C.best_path(e, TALK.steps, TALK.start, None)
        own = TALK.start[path[0]] + e[0][path[0]] + sum(TALK.steps[a, b] + e[k + 1][b] for k, (a, b) in enumerate(itertools.pairwise(path)))
        assert np.isclose(own, max(plain_scores(e, TALK)))
    assert TALK.without_marker("Human: a") == "a" and TALK.without_marker("Note: a") == "Note: a" and TALK.without_marker("a") == "a"


def test_query_recovers_roles_that_it_is_not_shown(spark):
    rows = load(spark, SF, "conversations").collect()
    got = op9_chat_roles(spark, SF).collect()
    turns, given, texts = {}, {}, {}
    for r in got:
        assert r.rendered == f"<|{r.role}|>\n{r.content}\n<|end|>" and r.held_out == (zlib.crc32(r.conv_id.encode()) % 3 == 1)
        turns.setdefault(r.conv_id, []).append((r.turn_no, r.role, r.content))
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        given.setdefault(str(r.conv_id), []).append(r.role)
        texts.setdefault(str(r.conv_id), []).append(r.text.strip())
    unseen = [c for c in given if zlib.crc32(c.encode()) % 3 == 1]
    found = {c: [role for _, role, _ in sorted(turns[c])] for c in given}
    right = sum(found[c] == given[c] for c in unseen) / len(unseen)
    simple = sum(given[c] == ["user", "assistant"] * (len(given[c]) // 2) + ["user"] * (len(given[c]) % 2) for c in unseen) / len(unseen)
    assert right >= 0.95 and right > simple + 0.1
    assert [[t for _, _, t in sorted(turns[c])] for c in given] == [texts[c] for c in given]


def test_query_equals_plain_viterbi_over_whole_conversations(spark, sf):
    rows = C.transcripts(load(spark, sf, "conversations"))
    model = C.fit_roles(rows)
    want = []
    own = {}
    for r in rows.collect():
        own.setdefault(str(r.conv_id), []).append((r.turn, r.text))
    for conv, texts in own.items():
        lines = [(line, k == 0) for _, text in sorted(texts) for k, line in enumerate(text.split("\n"))]
        # Scores of the best paths to each state, and the paths themselves.
        best = {s: (model.start[s], [s]) for s in range(C.STATES)}
        for n, (line, first) in enumerate(lines):
            e = model.markers[int(first), model.word(line)] + model.shapes[C.shape_of(line)]
            if n:
                best = {s: max(((v + model.steps[t, s], [*p, s]) for t, (v, p) in best.items()), key=lambda x: x[0]) for s in range(C.STATES)}
            best = {s: (v + e[s], p) for s, (v, p) in best.items()}
        path = max(best.values(), key=lambda x: x[0])[1]
        roles = [C.ROLES[s // 2] for s in path if s % 2 == 0]
        want += [(conv, n, role) for n, role in enumerate(roles)]
    assert sorted((r.conv_id, r.turn_no, r.role) for r in op9_chat_roles(spark, sf).collect()) == sorted(want)


def test_fitted_counts_equal_a_plain_count(spark):
    rows = [(f"c{k % 40}", k // 40, ("user", "assistant", "tool")[k % 3], f"{'AB'[k % 2]}: line {k}\nmore?") for k in range(400)]
    model = C.fit_roles(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    seen = [r for r in rows if zlib.crc32(r[0].encode()) % 3 != 1 and r[2] != "tool"]
    n = [sum(r[2] == role for r in seen) for role in ("user", "assistant")]
    ratio = np.exp(model.shapes[C.shape_of("more?"), [3, 5]])
    assert np.allclose(ratio, [(m + C._PRIOR) / (m + C._PRIOR * C._SHAPES) for m in n]) and set(model.words) == {"a", "b"}


def test_roles_come_from_markers(spark):
    text = "System: You help.\nHuman: what is it?\nplease\nAI: this\nand that\nHuman: thanks\nAI: sure"
    frame = spark.createDataFrame([("c", 0, "assistant", text, 1)], "conv_id string, turn int, role string, text string, seg int")
    model = taught([(r, f"{m}: x") for r, m in (("system", "System"), ("user", "Human"), ("assistant", "AI"), ("user", "Human"), ("assistant", "AI"))] , [("user", "so"), ("user", "a\nb"), ("assistant", "c\nd")])
    # Lines that open a turn within a row are new to the model, so the order of roles and the markers decide.
    model.markers[0] = model.markers[1]
    model.markers[0, 0] += np.array([0, 9, 0, 9, 0, 9])
    got = [(r.role, r.content) for r in C.chat_turns(frame, model).orderBy("turn_no").collect()]
    assert got == [("system", "You help."), ("user", "what is it?\nplease"), ("assistant", "this\nand that"), ("user", "thanks"), ("assistant", "sure")]


def test_chat_awkward_rows(spark):
    rows = [(None, None, None, None), ("a", None, "USER ", ""), ("a", None, "USER ", ""), ("b", 1, "weird", "x " * 20000), ("c", 2**40, "bot", "AI: far away"), ("c", 0, "q", "Human: near")]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = C.chat_turns(frame, TALK).collect()
    assert {r.conv_id for r in got} == {None, "a", "b", "c"}
    assert sum(r.n_lines for r in got) == 6
    assert [(r.role, r.content) for r in sorted((r for r in got if r.conv_id == "c"), key=lambda r: r.turn_no)] == [("user", "near"), ("assistant", "far away")]
    assert C.chat_turns(frame.limit(0), TALK).count() == 0
    # Nothing to learn from: all roles are alike, and every row is still there.
    blank = C.fit_roles(frame)
    assert sum(r.n_lines for r in C.chat_turns(frame, blank).collect()) == 6
    assert C.transcripts(frame).count() == 6 and C.transcripts(frame.limit(0)).count() == 0


def test_border_states_of_many_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(c, k, rng.normal(size=C.STATES**2).tolist(), rng.normal(size=C.STATES).tolist()) for c in ("a", None) for k in range(45)]
    frame = spark.createDataFrame(rows, "conv string, seg long, matrix array<double>, entered array<double>")
    key = lambda r: (r.conv or "", r.seg)
    want = sorted(C.border_states(frame, TALK).collect(), key=key)
    assert sorted(C.border_states(frame, TALK, most=4).collect(), key=key) == want


def test_no_segment_holds_more_rows_than_its_size(spark):
    rng = np.random.default_rng(8)
    pool = ["User: hello?", "Assistant: yes", "so it goes", "why?"]
    rows = [(c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(pool))) for c, t in [(None, None), ("a", None), ("b", 3)] for _ in range(200)]
    rows += [("a", 1, "user", "once more?"), ("d", 0, None, "hi")]
    frame = spark.createDataFrame(rows, "conv string, turn long, role string, text string")
    frame = frame.selectExpr("conv", "int(turn is not null) as dated", "turn", "role", "text").withColumn("role", F.lit("x"))
    rows = [(c, t, "x", text) for c, t, _, text in rows]
    cut = C.in_segments(frame, 16).collect()
    sizes = {}
    for r in cut:
        sizes.setdefault((r.conv, r.seg), []).append((r.dated, r.turn or 0, r.role or "", r.text))
    assert sorted(tuple(str(x) for x in (r.conv, r.turn, r.role, r.text)) for r in cut) == sorted(tuple(map(str, r)) for r in rows)
    for conv in (None, "a", "b", "d"):
        own = [sizes[k] for k in sorted((k for k in sizes if k[0] == conv), key=lambda k: k[1])]
        assert [len(s) for s in own[:-1]] == [16] * (len(own) - 1) and len(own[-1]) <= 16
        assert [x for s in own for x in sorted(s)] == sorted(x for s in own for x in s)


def test_turns_do_not_depend_on_the_segment(spark):
    rng = np.random.default_rng(6)
    pool = ["Human: hello?\nmore", "hi", "AI: yes", "so it goes\n\nlast", "why?", ""]
    rows = [(c, k, None, str(rng.choice(pool))) for c in ("long", None) for k in range(60)]
    rows += [("nulls", None, None, str(rng.choice(pool))) for k in range(30)]
    rows += [("one", k, "user", f"Human: line {k}" if k == 0 else f"line {k}") for k in range(20)] + [("short", 0, None, "hi")]
    rows += [("turn", 0, "assistant", "AI: a"), ("turn", 1, "assistant", "\n".join(f"b{k}" for k in range(40)))]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    model = taught([("user", "Human: hello?\nmore"), ("assistant", "AI: yes"), ("user", "hi"), ("assistant", "so it goes\n\nlast")], [("assistant", "AI: a"), ("user", "why?"), ("user", "")])
    model.markers[1] += np.array([0, 4, 0, 4, 0, 4])  # turns that go on over rows, and over the borders of segments
    key = lambda r: (r.conv_id or "", r.turn_no)
    want = sorted(C.chat_turns(frame, model).collect(), key=key)
    assert len({(r.conv_id, r.turn_no) for r in want}) == len(want) < sum(r.n_lines for r in want) - 60
    for segment in (1, 2, 7, 16):
        assert sorted(C.chat_turns(frame, model, segment=segment).collect(), key=key) == want


# Pipeline


def test_pipeline_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "source_mixing", "token_store"]
    docs = load(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and kept.schema == docs.schema, name
        assert 0 < kept.count()
    labels = {r.doc_id: r.toxic for r in load(spark, sf, "labels").collect()}
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    assert sum(labels.get(d, 0) for d in clean) <= 0.5 * sum(labels.values())
    assert sum(1 for d, y in labels.items() if y == 0 and d in clean) >= 0.98 * sum(1 for y in labels.values() if y == 0)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    for name, rows in (("awkward", AWKWARD), ("empty", [])):
        folder = str(tmp_path / name)
        tables = {
            "documents": documents(spark, rows),
            "labels": spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 0), (9, None, 7)] if rows else [], "doc_id long, quality int, toxic int"),
            "benchmark": spark.createDataFrame([(1, "same text here said twice over"), (None, "x"), (2, None)] if rows else [], "item_id long, text string"),
        }
        for table, df in tables.items():
            df.write.parquet(f"{folder}/{table}.parquet")
        docs, kept = load(spark, folder, "documents"), {}
        for stage, work in corpus_pipeline.STAGES[:-1]:
            found = work(spark, docs, folder)
            assert found.schema == docs.schema
            kept[stage] = sorted((r.doc_id is not None, r.doc_id or 0) for r in found.collect())
        ids = sorted((r[0] is not None, r[0] or 0) for r in rows)
        assert kept["toxicity"] == ids
        assert kept["decontamination"] == [i for i in ids if i[1] not in (6, 7)]
        assert len(corpus_pipeline.run(spark, folder).collect()) == 0 if not rows else corpus_pipeline.run(spark, folder).count() > 0
