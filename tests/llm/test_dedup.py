"""Exact dedup, the n-gram join and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import common, line_dedup, linking, ngram_join
from inkspan.llm.exact_dedup import exact_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


@pytest.fixture(scope="module")
def near_copies(spark):
    """Groups of near copies around the threshold, exact copies, short texts."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 12, 40, 90, 150]))
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    texts += ["a b", "A b", "a", "", "a b c", "x y z"]
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]


def brute_components(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    return [(rows[k][0], len(sets[k]), rows[c][0]) for k, c in enumerate(union(len(sets), links))]


@pytest.mark.parametrize("all_pairs", [16, 2])
def test_ngram_join_is_exact(spark, documents, near_copies, monkeypatch, all_pairs):
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", all_pairs)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(documents(near_copies)).collect())
    assert got == sorted(brute_components(near_copies))


def test_ngram_join_of_five_words(documents, near_copies):
    """Other shingles and another threshold, against brute force; the pipeline's stage uses them."""
    import corpus_pipeline

    rng = random.Random(8)
    base = [f"p{rng.randrange(500)}" for _ in range(200)]
    rows = [*near_copies, (900, " ".join(base), "en", "s", 1), (901, " ".join([*base[:90], *[f"q{k}" for k in range(15)], *base[105:]]), "en", "s", 1)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for w in (words(r[1]) for r in rows)]
    group = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(documents(rows), shingle=5, percent=80).collect())
    assert got == sorted((rows[k][0], len(sets[k]), rows[c][0]) for k, c in enumerate(group)) and got[-1][2] == 900
    kept = corpus_pipeline.drop_near_duplicates(None, documents(rows[-2:]), "")
    assert [r["doc_id"] for r in kept.collect()] == [900]


def test_long_runs_are_compared_in_full():
    """Both rounds together propose every allowed pair of different components."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 90
    token, place, size, ids = np.full(n, 7), rng.integers(0, 4, n).astype(np.int32), rng.integers(60, 70, n).astype(np.int32), rng.permutation(n)
    order = np.lexsort((ids, size, place))
    cols = [c[order] for c in (token, place, size, ids)]
    table = pa.table(cols, names=["token", "place", "n", "id"])
    first = pa.Table.from_batches(ngram_join._first_round(table.to_batches(max_chunksize=13)))
    held = {r["a"] for r in first.to_pylist() if r["b"] is None}
    assert held == set(range(n))
    labelled = pa.table([token, cols[1], cols[2], cols[3], cols[3]], names=["token", "place", "n", "id", "label"]).sort_by("label")
    second = pa.Table.from_batches(ngram_join._second_round(labelled.to_batches(max_chunksize=13))).to_pylist()
    found = {frozenset((r["a"], r["b"])) for r in second}
    by = dict(zip(cols[3].tolist(), zip(cols[1].tolist(), cols[2].tolist(), strict=True), strict=True))
    allowed = {frozenset((a, b)) for a in by for b in by if a < b and ngram_join.allowed(np.array([by[a][1]]), np.array([by[a][0]]), np.array([by[b][1]]), np.array([by[b][0]]))[0]}
    assert found == allowed


def test_ngram_join_odd_rows(odd):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(odd).collect()]
    by = defaultdict(set)
    for d, n, c in got:
        by[d].add((n, c))
    assert len(got) == 9 and by[1] == {(2, 1)} and by[6] == {(2, 1)} and by[None] == {(2, 1)} and by[2] == {(0, 2)} and by[4] == {(0, 4)} and by[7] == {(1, 7)}
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7]


def test_keep_one_of_repeated_identifiers_and_clashing_columns(spark):
    """Near copies under one identifier count as two documents; an unrelated text under a kept identifier goes by itself."""
    rng = random.Random(3)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    rows = [(5, " ".join(a)), (5, " ".join([*a[:-1], "other"])), (3, " ".join(b)), (5, " ".join(b)), (None, " ".join(c)), (None, " ".join(c)), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, k, k, k, k) for k, r in enumerate(rows)], "doc_id long, text string, doc long, node long, _Kept long, `row` long")
    out = ngram_join.keep_one(docs, shingle=3, percent=80)
    got = [(r["doc_id"], (r["text"] or "").split(" ")[0]) for r in out.collect()]
    assert out.columns == docs.columns and Counter(got) == Counter([(5, a[0]), (3, b[0]), (None, c[0]), (None, ""), (9, "")])


def test_empty_tables(spark, documents):
    none = documents([])
    assert ngram_join.components(none).count() == 0 and exact_groups(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_exact_groups(spark, documents):
    rng = random.Random(1)
    long_ = "x" * 70
    rows = [(k, rng.choice(["aB", "ab", "AB", "b", "", None, long_ + "1", long_.upper() + "1", long_ + "2", "É", "é"]), None, None, None) for k in range(300)]
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_groups(documents(rows)).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = {k: (max(ids), len(ids), k == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for k in ids}
    assert got == want


def test_exact_groups_over_partition_borders(spark, documents):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [(k, "same" if k % 3 else f"t{k % 5}", None, None, None) for k in range(400)]
        got = exact_groups(documents(rows)).groupBy("text_sha256").agg(F.min("group_size").alias("a"), F.max("group_size").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(r["a"] == r["b"] == r["n"] and r["k"] == 1 for r in got) and {r["n"] for r in got} == {266, 27, 26} | {r["n"] for r in got}


def test_exact_groups_odd_rows(odd):
    got = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(odd).collect())
    assert got[(1, 6, 4, False)] == 2 and got[(6, 6, 4, True)] == 1 and got[(None, 6, 4, False)] == 1 and got[(2, 3, 2, False)] == 1 and got[(3, 3, 2, True)] == 1


def brute_lines(rows):
    """Per document the numbers of the lines that lose."""
    first, places = {}, []
    for r in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((r[1] or "").split("\n")):
            b = line.translate(LOWER).encode().strip(b" \t\n\r\x0b\x0c")
            if b:
                first.setdefault(b, (r[0], k))
                places.append((r[0], k, b))
    lines = list(first)
    group = union(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.similar(lines[i], lines[j])])
    winner = {}
    for k, line in enumerate(lines):
        winner[group[k]] = min(winner.get(group[k], (1 << 60, 0)), first[line])
    at = {line: k for k, line in enumerate(lines)}
    lost = defaultdict(set)
    for d, k, b in places:
        if (d, k) != winner[group[at[b]]]:
            lost[d].add(k)
    return lost


@pytest.mark.parametrize("all_pairs, block", [(16, 512), (3, 8), (2, 1)])
def test_line_dedup(spark, documents, monkeypatch, all_pairs, block):
    monkeypatch.setattr(line_dedup, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    bases = [rng.choices(vocabulary, k=30) for _ in range(20)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(4):
            t = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(30)] = rng.choice(vocabulary)
            lines.append(" ".join(t))
        rows.append((k, "\n".join([*lines, "  ", "corta"]), "en", "s", 1))
    got = line_dedup.without_repeats(documents(rows)).collect()
    lost = brute_lines(rows)
    wrong = sum(r["n_lost"] != len(lost[r["row"]["doc_id"]]) for r in got)
    assert wrong <= 2 and sum(r["n_lost"] for r in got) > 100
    if not wrong:
        assert all(r["row"]["text"] == "\n".join(x for i, x in enumerate(rows[r["row"]["doc_id"]][1].split("\n")) if i not in lost[r["row"]["doc_id"]]) for r in got)


def test_line_dedup_keeps_links_through_a_large_group(documents):
    """z is similar to one member of a large group of near copies only, and to none that could stand for the group."""
    rng = random.Random(6)

    def edited(line, by, *places):
        return "".join(by if k in places else c for k, c in enumerate(line))

    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=240))
    copies = [edited(base, "0", p) for p in range(10, 230)]
    rows = []
    for k in range(0, 110, 10):
        z = edited(copies[k], "1", *[(k + 10 + d) % 240 for d in (60, 90, 120)])
        assert line_dedup.similar(z.encode(), copies[k].encode()) and not any(line_dedup.similar(z.encode(), c.encode()) for i, c in enumerate(copies) if i != k)
        rows.append((1000 + k, z, "en", "s", 1))
    rows = [(1, "\n".join(copies), "en", "s", 1), *rows]
    lost = brute_lines(rows)
    got = {r["row"]["doc_id"]: r["n_lost"] for r in line_dedup.without_repeats(documents(rows)).collect()}
    assert len(lost[1]) == 219 and got == {r[0]: len(lost[r[0]]) for r in rows}


def test_runs_are_proposed_whole():
    """Whatever the batches, each run's lines meet its first, and runs of three and more are told in full."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((k, h) for k in range(40) for h in rng.choices(range(900), k=rng.choice([1, 2, 2, 3, 4, 30])) for _ in range(rng.choice([1, 1, 2])))
    runs = defaultdict(list)
    for k, h in rows:
        runs[k] += [] if h in runs[k] else [h]
    table = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["key", "h"])
    for size in (1, 2, 3, 7, 1000):
        got = pa.Table.from_batches(line_dedup._propose(table.to_batches(max_chunksize=size))).to_pylist()
        assert Counter((r["a"], r["h"]) for r in got if r["a"] != r["h"] and r["key"] is None) == Counter((v[0], v[1]) for v in runs.values() if len(v) > 1)
        assert Counter((r["key"], r["a"], r["h"]) for r in got if r["key"] is not None) == Counter((k, v[0], h) for k, v in runs.items() if len(v) > 2 for h in v)


def test_similar_pairs_against_sets():
    rng = random.Random(7)
    make = lambda: bytes(rng.choices(b"ab", k=rng.randrange(1, 60)))
    x = [make() for _ in range(300)]
    y = [rng.choice([a, a + b"b", a[:-1] or b"a", make()]) for a in x]
    sets = lambda t: {t[k : k + 8] for k in range(max(1, len(t) - 7))}
    want = [len(sets(a) & sets(b)) >= 0.8 * len(sets(a) | sets(b)) for a, b in zip(x, y, strict=True)]
    assert line_dedup.similar_pairs(x, y).tolist() == want and 0 < sum(want) < 300


def test_line_dedup_of_clashing_columns_and_repeated_ids(spark):
    """Columns called as the operator's own, one identifier for different texts, nulls for a third of the identifiers."""
    one, two = "la primera linea de este texto es esta", "otra linea que no se parece en nada"
    rows = [(None, f"{one}\n{k} sola {k * 7919}", k, 1, 2, 3, 4) for k in range(20)] + [(7, one, 1, 1, 1, 1, 1), (7, two, 2, 2, 2, 2, 2), (7, two + "\n" + two, 3, 3, 3, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, `Lost` int, n_lost int, N_Lines int, `row` int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = Counter(line for r in out.collect() for line in r["text"].split("\n"))
    assert got[one] == 1 and got[two] == 1 and len(got) == 22


def test_texts_that_once_hashed_alike(documents):
    """Thue-Morse strings and their complements, which a polynomial modulo 2**64 cannot tell apart, and one long line."""
    t = "a"
    while len(t) < 1024:
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer((t + other).encode(), np.uint8)
    for long_ in (16, 1 << 20):
        common.LONG_SPAN, held = long_, common.LONG_SPAN
        h = common.span_hash(buf, np.array([0, 1024]), np.array([1024, 2048]))
        common.LONG_SPAN = held
        assert h[0] != h[1]
    assert common.same_spans(buf, np.array([0, 0]), np.array([0, 1024]), np.array([1024, 1024])).tolist() == [True, False]
    rows = [(1, t, "en", "s", 1), (2, other, "en", "s", 1), (3, "x" * (4 << 20), "en", "s", 1)]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.components(documents(rows)).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r["row"]["doc_id"]: r["n_lines"] for r in line_dedup.without_repeats(documents(rows)).collect()} == {1: 1, 2: 1, 3: 1}


def test_line_dedup_odd_rows(odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    # A null identifier comes first and keeps the shared line; the others lose their only line and go.
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in out.collect()) == [(0, "uno dos"), (2, ""), (3, ""), (4, " \n\t "), (5, "palabra"), (7, "1234 !!")]


def test_blocks_find_all_links():
    rng = random.Random(2)
    lines = [bytes(rng.choices(b"ab", k=rng.randrange(1, 40))) for _ in range(60)]
    close = line_dedup.similar_in_block(lines)
    assert all(close[i, j] == line_dedup.similar(lines[i], lines[j]) for i in range(60) for j in range(60) if lines[i] != lines[j] and min(len(lines[i]), len(lines[j])) >= line_dedup.SHINGLE)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["id"]: r["component"] for r in linking.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = union(1100, links)
    assert got == {k: parent[k] for k in {x for p in links if p[0] != p[1] for x in p}}


def test_filter_holds_its_ids(spark):
    ids = np.random.default_rng(0).integers(-(2**62), 2**62, 500)
    bitmap = linking.id_filter(spark.createDataFrame([(int(x),) for x in ids[:250]], "h long"), "h").value
    assert linking.may_hold(bitmap, ids[:250]).all() and linking.may_hold(bitmap, ids[250:]).mean() < 0.01
