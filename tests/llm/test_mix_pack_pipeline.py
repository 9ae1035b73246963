"""Mixing, packing, the pipeline, and every query with its SQL."""

import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from inkspan.llm import mixing, packing
from inkspan.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = Counter(tuple(map(plain, r)) for r in res.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in e.queries()[name](spark, SF).collect()) == want


def test_mix_reaches_targets(documents):
    rng = random.Random(0)
    rows = [(k, "w " * rng.randrange(1, 60), "en", rng.choice("aaaab"), 1) for k in range(800)] + [(900, "x y", "en", None, 1), (901, None, "en", "c", 0)]
    out = mixing.mixed_words(documents(rows)).collect()
    again = mixing.mixed_words(documents(rows)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    by = defaultdict(list)
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by[(r["source_size"], r["target"])].append(r["taken"])
    total = sum(k[0] for k in by)
    assert sum(k[1] for k in by) == pytest.approx(1.5 * total) and all(k[1] <= 2 * k[0] + 1e-9 for k in by)
    assert all(abs(sum(v) - k[1]) <= max(1, 0.01 * k[1]) for k, v in by.items())


def test_mix_passes_over_what_does_not_fit(documents):
    """A very long document never keeps the rest from being taken."""
    small = [(k, "w " * 16, "en", "a", 1) for k in range(100)] + [(1000 + k, "x", "en", "b", 1) for k in range(1000)] + [(5000, "y " * 1000, "en", "b", 1)]
    long_ = [(k, "w " * 500, "en", "a", 1) for k in range(1200)] + [(5000, "y " * 400_000, "en", "a", 1)] + [(6000 + k, "x " * 300, "en", "b", 1) for k in range(1000)]
    for rows, least in ((small, 1), (long_, 500)):
        by = defaultdict(list)
        for r in mixing.mixed_words(documents(rows)).collect():
            by[(r["source_size"], r["target"])].append(r["taken"])
        assert all(abs(sum(v) - target) < least for (_, target), v in by.items())


@pytest.mark.parametrize("closing, slices", [(4096, 4096), (8, 4)])
def test_mix_by_brute_force(documents, monkeypatch, closing, slices):
    """The greedy pass down the Pareto order, source by source; inclusion near its probability."""
    monkeypatch.setattr(mixing, "CLOSING", closing)
    monkeypatch.setattr(mixing, "LEAST_SLICES", slices)
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([1, 2, 3, 7, 20, 60, 61]), "en", rng.choice("aaaabbc"), 1) for k in range(900)]
    chance = hit = spread = 0.0
    by = defaultdict(list)
    for r in mixing.mixed_words(documents(rows)).collect():
        by[(r["source_size"], r["target"])].append(r)
    for (size, target), mine in by.items():
        if target == 2 * size:
            assert all(r["copies"] == 2 for r in mine)
            continue

        def words(rate, of):
            return sum(of(min(2.0, rate * r["size"].bit_length())) * r["size"] for r in mine)

        lo, hi = 0.0, 2.0
        for _ in range(100):
            lo, hi = ((lo + hi) / 2, hi) if words((lo + hi) / 2, float) < target else (lo, (lo + hi) / 2)
        expected = {r["id"]: min(2.0, hi * r["size"].bit_length()) for r in mine}
        assert all(r["p"] == pytest.approx(expected[r["id"]] % 1, abs=1e-6) for r in mine)
        gap = int(target - words(hi, int) + 1e-6)
        copies = {r["id"]: int(expected[r["id"]]) for r in mine}
        pool = sorted((r for r in mine if r["pareto"] is not None), key=lambda r: (r["pareto"], r["id"], r["size"]))
        left = []
        for r in pool:
            if r["size"] <= gap:
                copies[r["id"]] += 1
                gap -= r["size"]
            else:
                left.append(r)
        beyond = [r for r in left if r["size"] < 2 * gap]
        if beyond:
            copies[min(beyond, key=lambda r: (r["size"], r["pareto"], r["id"]))["id"]] += 1
        assert {r["id"]: r["copies"] for r in mine} == copies
        chance += sum(r["p"] for r in pool)
        spread += sum(r["p"] * (1 - r["p"]) for r in pool)
        hit += sum(r["copies"] > int(expected[r["id"]]) for r in pool)
    assert chance > 50 and abs(hit - chance) < 4 * spread**0.5 + 3


def test_mix_of_distant_sizes_equals_sql(spark, documents, tmp_path):
    """Many documents that are passed over lie before those that still fit."""
    rng = random.Random(5)
    size = lambda: rng.randint(64, 90) if rng.random() < 0.5 else rng.randint(512, 1023)
    documents([(k, f"w{k} " + "x " * (size() - 1), "en", f"s{k // 100:03d}", 0) for k in range(10_000)]).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP3_SQL})").fetchall())
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.op3_mix_sources(spark, str(tmp_path)).collect()) == want


def test_mix_odd_rows(odd, documents):
    assert mixing.mixed_words(odd).count() == 9 and mixing.mix(odd).columns == odd.columns
    assert mixing.mixed_words(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0


def test_bins_hold_every_piece():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.choice([10, 30, 100])
        want = Counter(rng.choices(range(1, cap + 1), k=rng.randrange(1, 60)))
        kinds = packing.plan_bins(dict(want), cap)
        got = Counter()
        for layout, n in kinds:
            assert sum(s * e for s, e in layout) <= cap
            for s, e in layout:
                got[s] += e * n
        assert got == want


def test_reduction_keeps_the_optimum():
    """On small instances the reduced packing needs no more bins than an exhaustive search."""

    def optimum(items, cap):
        items, best = sorted(items, reverse=True), [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= cap:
                    place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best[0]

    rng = random.Random(8)
    for _ in range(60):
        items = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))]
        left = Counter(items)
        fixed = sum(n for _, n in packing.reduce_instance(left, 20))
        assert fixed + optimum(list(left.elements()), 20) == optimum(items, 20)


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    want, got = Counter(), Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    for i, t in texts:
        ids = [*encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert got == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    return len(bins)


def test_packing_odd_rows(odd, documents):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_pieces(packing.pack_documents(odd).collect(), texts)
    assert packing.pack_documents(documents([])).count() == 0


def test_units_of_one_hash_stay_apart(documents, monkeypatch):
    """Even if all spans of a length hash alike, units are told apart by their bytes."""
    monkeypatch.setattr(packing, "span_hash", lambda buf, starts, ends: (ends - starts).astype("uint64"))
    import numpy as np

    buf = np.frombuffer(b"uno dos uno abc abcdefghij abcdefghik abcdefghij", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 16, 27, 38]), np.array([3, 7, 11, 15, 26, 37, 48])
    first, inverse = packing.distinct(buf, starts, ends)
    assert [buf[starts[k] : ends[k]].tobytes() for k in first[inverse]] == [buf[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]


def test_units_equal_whole_texts(documents):
    rng = random.Random(5)
    parts = ["Hello", "don't", "WORLD!!", "<|endoftext|>", "<|EndOfText|>.", "Ünï", "áb", "x y", "—.", "×.", "٣٤", "naïve,", "'s", "I'LL", "...", "é.É,", "ǅ.", "İstanbul.", "ΣΑΣ.", "日本語。", "a.b.c", "​", "&amp;", "3.14%", "ß.", "<|startoftext|>x"]
    rows = [(k, rng.choice(["", " ", "\n"]).join(rng.choices(parts, k=rng.randrange(1, 12))) + rng.choice(["", " ", "\x0b", "\x1c", "\x85"]), None, None, None) for k in range(400)]
    check_pieces(packing.pack_documents(documents(rows)).collect(), [(r[0], r[1]) for r in rows])


@needs_tables
def test_pipeline_stages(spark, tmp_path):
    """Each stage on the rows that its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "pack_sequences":
            assert out.columns == columns
        if name in ("toxicity", "line_dedup", "ngram_jaccard_join"):
            assert 0 < out.count() <= n
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "ngram_jaccard_join":
            assert out.count() == out.select("doc_id").distinct().count()
        if name == "mix_sources":
            most = out.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
            assert 1 <= most <= 2
        if name == "pack_sequences":
            check_pieces(out.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
        docs, n = out, out.count()


def test_pipeline_odd_rows(odd, spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for make in (odd, odd.limit(0)):
        docs = make
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pack_sequences":
                assert out.columns == odd.columns
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_near_copies_lose_their_lines_before_the_near_duplicate_stage(spark, documents):
    """Why few near copies are left to it: the line stage has taken all but their changed lines, and what is left is no near copy."""
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(14))
    first = [line() for _ in range(30)]
    second = [line() if k in (3, 17) else x for k, x in enumerate(first)]
    docs = documents([(1, "\n".join(first), "en", "s", 1), (2, "\n".join(second), "en", "s", 1), (3, "\n".join(line() for _ in range(5)), "en", "s", 1)])
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 2
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert sorted(len(t.splitlines()) for i, t in left.items() if i < 3) == [2, 30]
    assert corpus_pipeline.drop_near_duplicates(spark, documents([(i, t, "en", "s", 1) for i, t in left.items()]), "").count() == 3
