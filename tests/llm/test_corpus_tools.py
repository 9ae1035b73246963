"""The manifest, the alignment of tokenizers and the language model, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import alignment, manifest, neural_lm
from inkspan.llm.common import UPPER_TO_LOWER

# The manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, siblings of each node as (text, node is right) from the bottom up)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            path.append((level[i ^ 1] if i ^ 1 < len(level) else "", i % 2))
            i //= 2
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    def one(r, tampered):
        n = r[4] + 1 if tampered and r[4] is not None and zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 0 else r[4]
        return sha("".join(map(field, (r[0], r[3], r[2], n, r[1]))))

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((-1 if r[0] is None else r[0], one(r, False), one(r, True), r[0]))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[1] for x in sorted(by[g], key=lambda x: x[:2])]) for g in langs}
    root, tops = tree([built[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (_, leaf, changed, i), path in zip(sorted(by[g], key=lambda x: x[:2]), built[g][1], strict=True):
            h = changed
            for text, right in path + top:
                h = sha(text + h if right else h + text)
            out.append((i, leaf, built[g][0], root, sha("".join(t for t, _ in path + top)), h, h == root))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return Counter(tuple(r[c] for c in MANIFEST) for r in manifest.op13_merkle_manifest(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("levels", [8, 2])
def test_manifest_by_brute_force(spark, documents, tmp_path, monkeypatch, levels):
    """Groups below, at and above one block, one node over a block, and several rounds of blocks."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 2**levels)
    rows = [(k, f"t{k} ñ" * (k % 3), g, None if k % 5 == 0 else f"s{k % 4}", None if k % 11 == 0 else k) for g, n in (("a", 1), ("b", 4), ("ñ", 5), (None, 17), ("z", 70), ("B", 256)) for k in range(n)]
    assert manifest_rows(spark, documents(rows), tmp_path) == Counter(brute_manifest(rows))


def test_manifest_odd_rows(spark, odd, tmp_path):
    rows = [tuple(r)[:5] for r in odd.collect()]
    assert manifest_rows(spark, odd, tmp_path) == Counter(brute_manifest(rows))


def test_manifest_of_one_row_and_none(spark, documents, tmp_path):
    row = (3, None, None, "s", 1)
    (got,) = manifest_rows(spark, documents([row]), tmp_path / "one")
    assert got[1] == got[2] == got[3] and got[4] == sha("")
    assert not manifest_rows(spark, documents([]), tmp_path / "none")


def test_manifest_does_not_depend_on_partitions(spark, documents, tmp_path):
    rows = [(k % 90, f"t{k % 45}", "en" if k % 3 else None, "s", 1) for k in range(300)]
    assert manifest_rows(spark, documents(rows).repartition(7), tmp_path / "a") == manifest_rows(spark, documents(rows[::-1]).coalesce(1), tmp_path / "b")


def test_any_changed_field_changes_the_leaf(documents):
    rows = [(1, "text", "en", "s", 4), (1, "texts", "en", "s", 4), (1, "text", None, "s", 4), (1, "text", "en", "", 4), (1, "text", "en", None, 4), (1, "text", "en", "s", None), (0, "text", "en", "s", 4), (1, None, "en", "s", 4), (1, "", "en", "s", 4), (1, "t", "exten", "s", 4)]
    leaves = documents(rows).select(manifest.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf")).collect()
    assert len({r["leaf"] for r in leaves}) == len(rows)


# The alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path = alignment._default("byte_bpe_50k.json")
    one, two = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=alignment._default("piece_bpe_32k.model"))
    one.encode_special_tokens = True
    of_a, of_b = alignment.a_bytes(a_path), alignment.b_bytes(two)
    docs, held = [], Counter()
    for i, text in rows:
        a = b = []
        if text:
            a, b, want = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text), (" " + text).encode()
            if b"".join(of_a[x] for x in a) != want or b"".join(of_b[x] for x in b) != want:
                a = b = []
        groups, links, ka, kb, ea, eb, ga, gb = [], [], 0, 0, 0, 0, [], []
        while ka < len(a) or kb < len(b):
            if ea <= eb:
                ga.append((a[ka], ea, ea := ea + len(of_a[a[ka]])))
                ka += 1
            else:
                gb.append((b[kb], eb, eb := eb + len(of_b[b[kb]])))
                kb += 1
            if ea == eb:
                links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
                groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
                ga, gb = [], []
        docs.append((i, a, b, groups, links))
        held.update(set(links))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return Counter((i, len(a), len(b), len(g), len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), sha(";".join(g)) if g else "") for i, a, b, g, x in docs)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = ["<|endoftext|> a<s> b</s>", "  two  spaces  ", "\n\nx\r\n;\ry", "a b   c　 d\u0085 e", "x\x00y \x1c z", "▁literal", "don't 'tis we'll", "ünïcödé 日本語 🙂 é", "\t", "a" * 300, "x ​ y", "﻿ q", "1234567890 12 3", "<0x41>"]


def aligned_rows(docs, **more):
    return Counter(tuple(r[c] for c in ALIGNED) for r in alignment.align_documents(docs, **more).collect())


@pytest.mark.parametrize("most", [0, 5, 250_000])
def test_alignment_by_brute_force(documents, monkeypatch, most):
    """Whatever of the counts is broadcast and whatever is joined."""
    rng = random.Random(1)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 50)
    monkeypatch.setattr(alignment, "CACHE_PAIRS", 20)
    texts = HARD + ["".join(rng.choice("ab ñ.'1\n\r\t  X") for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    assert aligned_rows(documents(rows).repartition(3), most_broadcast=most) == brute_alignment([r[:2] for r in rows])


def test_alignment_odd_rows(odd, documents):
    assert aligned_rows(odd) == brute_alignment([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert not aligned_rows(documents([]))


def test_a_text_without_white_space_is_one_unit(documents):
    rows = [(1, "palabra" * 30_000, "es", "s", 1), (2, "x", "es", "s", 1)]
    assert aligned_rows(documents(rows)) == brute_alignment([r[:2] for r in rows])


def test_identity_map_prefers_whole_pieces():
    assert alignment.identity_map([b"a", b"b", b"", b"zz"], [b"a", b"b", b"a"], lambda i: i < 2).tolist() == [2, 1, -1, -1]


# The language model

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_base(rows):
    tokens = [(i, WORD.findall((t or "").encode().translate(UPPER_TO_LOWER)) + [None]) for i, t in rows]
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, _ in tokens]
    c = Counter(w for (_, ws), f in zip(tokens, fold, strict=True) if f for w in ws)
    total, different = sum(c.values()), len(c)
    return Counter((i, f == 0, len(ws), sum(w in c for w in ws), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (different + 1))) for w in ws), 6)) for (i, ws), f in zip(tokens, fold, strict=True))


def base_rows(rows):
    return Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


@pytest.mark.parametrize("most", [10, 250_000])
def test_base_scores_by_brute_force(documents, monkeypatch, most):
    monkeypatch.setattr(neural_lm, "CACHE_WORDS", 30)
    monkeypatch.setattr(neural_lm, "LEAST_TARGETS", 1000)
    rng = random.Random(2)
    words = [f"W{k}" for k in range(900)] + ["é" * 90, "ñ"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(40))), "en", "s", 1) for k in range(200)]
    got = neural_lm.score_documents(documents(rows).repartition(3), most_broadcast=most).collect()
    assert base_rows(got) == brute_base([r[:2] for r in rows]) and all(r["score"] < 0 for r in got)


def test_model_odd_rows(odd, documents, monkeypatch):
    monkeypatch.setattr(neural_lm, "LEAST_TARGETS", 1000)
    got = neural_lm.score_documents(odd).collect()
    assert base_rows(got) == brute_base([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert neural_lm.score_documents(documents([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    (alone,) = neural_lm.score_documents(documents([(held, "a b", "en", "s", 1)])).collect()
    assert (alone["train_tokens"], alone["n_known"], round(alone["base_score"], 9)) == (0, 0, 0) and math.isfinite(alone["score"])


def test_probabilities_are_normalised(documents, monkeypatch):
    """Over all classes after any context; and over all words of a class and the unknown one."""
    monkeypatch.setattr(neural_lm, "LEAST_TARGETS", 1000)
    rng = random.Random(3)
    rows = documents([(k, " ".join(rng.choice(["a", "b", "cc", f"w{k}"]) for _ in range(30)), "en", "s", 1) for k in range(40)])
    scorer = neural_lm.fit(rows.select("text"))
    table = neural_lm.Normalisers(neural_lm.Model(scorer.flat))
    every = np.arange(neural_lm.CLASSES)
    for one, two in ((neural_lm.START, neural_lm.START), (1, 2), (600, 0)):
        p = np.exp(table.log_probability(every, np.full(len(every), one), np.full(len(every), two)))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    size = [(r["ending"], bytes(r["word"]), r["n"]) for r in scorer.counts.collect() if bytes(r["word"]) not in scorer.own]
    shares = Counter()
    for cls, _, n in size:
        shares[cls] += (n + 0.1) / 10 ** scorer.class_log[cls]
    assert all(s + 0.1 / 10 ** scorer.class_log[c] == pytest.approx(1) for c, s in shares.items())


def test_a_step_of_noise_contrastive_estimation_goes_uphill():
    """Against the objective's difference quotient."""
    rng = np.random.default_rng(0)
    unigram = np.full(neural_lm.CLASSES, 1 / neural_lm.CLASSES)
    log_noise = np.log(neural_lm.NOISE * unigram)
    target, one, two, noise = (rng.integers(0, neural_lm.CLASSES, 50) for _ in range(4))

    def objective(m):
        q = m.c[0] * m.r[one] + m.c[1] * m.r[two]
        s = np.einsum("ij,ij->i", q, m.t[target]) + m.bias[target] - log_noise[target]
        x = q @ m.t[noise].T + m.bias[noise] - log_noise[noise]
        return -np.log1p(np.exp(-s)).sum() - np.log1p(np.exp(x)).sum()

    model = neural_lm.Model.fresh(unigram)
    before, flat = objective(model), model.flat.copy()
    model.step(target, one, two, noise, log_noise.astype(np.float32))
    assert objective(model) > before
    moved = neural_lm.Model(flat + 1e-3 * (model.flat - flat))
    assert objective(moved) > before


def test_model_learns_order(documents, monkeypatch):
    """Held-out texts in which each word follows from the one before score far above their base."""
    monkeypatch.setattr(neural_lm, "LEAST_TARGETS", 100_000)
    rng = random.Random(5)
    rows = []
    for k in range(300):
        w = rng.randrange(20)
        text = []
        for _ in range(60):
            text.append(f"w{w:02d}")
            w = (w * 7 + 3) % 20
        rows.append((k, " ".join(text), "en", "s", 1))
    held = [r for r in neural_lm.score_documents(documents(rows)).collect() if r["held_out"]]
    assert len(held) > 10 and sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held)


def test_every_position_is_a_target(documents):
    """Each word and each end of a text is trained on once in a sweep."""
    rows = [(k, " ".join(f"w{k * j % 50}" for j in range(k % 37)), "en", "s", 1) for k in range(300)]
    unigram = np.full(neural_lm.CLASSES, 1 / neural_lm.CLASSES)
    shared = documents(rows).sparkSession.sparkContext.broadcast((neural_lm.Model.fresh(unigram).flat, [b"w1", b"w2"], unigram))
    parts = documents(rows).repartition(3).select("text").mapInArrow(neural_lm._train(shared, 2), neural_lm._PART)
    (trained,) = parts.filter("slice = 0").agg(F.sum("trained")).first()
    assert trained == 2 * sum(k % 37 + 1 for k in range(300))
