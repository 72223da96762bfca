"""Jaccard join, sharding, quality rules and the classifiers against brute force or held-out labels."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import frame, odd_rows, rows_of, small_documents, with_clashes, words
from pyspark.sql import functions as F

from kickoff.llm import jaccard_join, quality_knn, quality_rules, sharding, toxicity
from kickoff.llm.common import REMOVE_SHUFFLES, settled

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least[find(i)], d)
    return sorted(((d, len(sets[i]), None if least[find(i)] == math.inf else least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def set_of(t, k=5):
    w = (t or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} if w else ())


def near_copies():
    rng = random.Random(4)
    base = words(150, 9, 3000)
    rows = []
    for i in range(60):  # copies of copies: chains whose ends are less alike than 0.8
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = f"new{rng.random()}"
        rows.append((i, " ".join(base)))
    line = " ".join(words(30, 10))
    rows += [(100 + i, line + " " + " ".join(words(40, 50 + i, 3000))) for i in range(40)]  # one shared passage
    rows += [(200 + i, " ".join(words(4, i % 3))) for i in range(9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [2, 16])
@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_jaccard_join(spark, monkeypatch, local, rounds):
    monkeypatch.setattr(jaccard_join, "LOCAL_COUNT", local)
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", rounds)
    sets = [near_copies()] if rounds != 3 else [near_copies(), odd_rows(), [(r.doc_id, r.text) for r in small_documents(spark).collect()], []]
    for rows in sets:
        got = rows_of(jaccard_join.near_duplicates(with_clashes(frame(spark, rows))), "doc_id", "n_shingles", "component_id")
        assert got == brute_components(rows)


def test_one_document_of_a_class_stays(spark):
    rows = near_copies()
    left = jaccard_join.keep_smallest(frame(spark, rows))
    assert {r.doc_id for r in left.collect()} == {c for _, _, c in brute_components(rows)} and left.columns == frame(spark, []).columns


def test_one_document_stays_with_columns_of_any_name(spark):
    text = " ".join(words(30, 9))
    docs = frame(spark, [(1, text), (2, text), (None, text), (3, None), (4, "")]).withColumn("_gone", F.lit(1)).withColumn("_GONE_", F.lit(2))
    out = jaccard_join.keep_smallest(docs)
    assert out.columns == docs.columns and rows_of(out, "doc_id", "_gone", "_GONE_") == sorted([(1, 1, 2), (None, 1, 2), (3, 1, 2), (4, 1, 2)], key=repr)


def test_components_of_a_chain(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    nodes = spark.range(n + 1).select(F.col("id").alias("cls"), F.col("id").alias("comp"))
    assert {r.comp for r in jaccard_join.components(nodes, links).collect()} == {0}


def test_candidates_of_a_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOCAL_COUNT", 2)
    rng = random.Random(6)
    base, rows = words(150, 9, 3000), []
    for i in range(80):  # too far from each other, yet with shared shingles in their prefixes
        copy = list(base)
        for at in rng.sample(range(4, 150, 5), 5):
            copy[at] = f"new{rng.random()}"
        rows.append((i, " ".join(copy)))
    docs = frame(spark, rows).coalesce(1)
    _, shared, _ = jaccard_join._compared(docs, 5, 80)
    loose = shared.alias("x").join(shared.alias("y"), "h").where(F.col("x.cls") < F.col("y.cls")).select("x.cls", "y.cls").distinct().count()
    near = sum(100 * len(set_of(s) & set_of(t)) >= 80 * len(set_of(s) | set_of(t)) for i, (_, s) in enumerate(rows) for _, t in rows[:i])
    assert near <= jaccard_join.sharing(shared, 80).count() <= near + 80 and loose > 1000
    assert rows_of(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles())
    return {f.getName() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_shuffle_files_of_the_join_go_with_its_steps(spark):
    before, setting = shuffle_files(spark), spark.conf.get(REMOVE_SHUFFLES, None)
    out = jaccard_join.near_duplicates(frame(spark, near_copies()))
    for _ in range(50):  # they go a little later
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(REMOVE_SHUFFLES, None) == setting
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == rows_of(out, "doc_id", "n_shingles", "component_id") == brute_components(near_copies())


def test_small_steps_of_the_join_stay_small(spark):
    table, n = settled(spark.range(0, 1000, 1, 40).repartition(50), "few")
    assert n == 1000 and len(table.inputFiles()) == 1 and table.agg(F.sum("id")).first()[0] == 499500
    assert len(jaccard_join.bloom(spark.range(100).withColumnRenamed("id", "doc_id"), 100)) <= 100


@pytest.mark.parametrize("salted", [1024, 2])
def test_jaccard_links_gives_every_pair(spark, monkeypatch, salted):
    monkeypatch.setattr(jaccard_join, "SALTED", salted)
    rows = [(i, t) for i, (_, t) in enumerate([*near_copies(), (0, "One Two"), (0, "one two"), (0, None), (0, "")])]
    links, members = jaccard_join.jaccard_links(frame(spark, rows), 5, 80)
    got = [(r.a, r.b) for r in links.collect()]
    cls = {r.doc_id: r.cls for r in members.collect()}
    assert len(cls) == len(rows) and len(set(got)) == len(got) and all(a < b for a, b in got)
    sets = {c: set_of(rows[i][1]) for i, c in cls.items()}
    distinct = [s for s in {set_of(t) for _, t in rows} if s]
    want = {frozenset((x, y)) for i, x in enumerate(distinct) for y in distinct[:i] if 100 * len(x & y) >= 80 * len(x | y)}
    assert {frozenset((sets[a], sets[b])) for a, b in got} == want
    assert len(want) > 60  # more links than a spanning forest of the chain has


def test_sets_of_all_sizes_are_verified_by_whole_hashes(spark):
    rng = np.random.default_rng(1)
    sets, pairs, want = [], [], set()
    for n in (9, 900, 1035, 300_006):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for far in (n // 9, n // 9 + 1):  # 80 % alike, and a shingle less; the far ones have the same upper 32 bits
            t = s.copy()
            t[:far] ^= np.uint64(1)
            a = len(sets)
            sets += [(a, s.tobytes()), (a + 1, np.sort(t).tobytes())]
            pairs.append((a, a + 1))
            i = len(np.intersect1d(s, t))
            if 100 * i >= 80 * (2 * len(s) - i):
                want.add((a, a + 1))
    assert len(want) == len(pairs) // 2
    got = jaccard_join.similar(spark.createDataFrame(pairs, jaccard_join.PAIRS), spark.createDataFrame(sets, "cls bigint, shingles binary"), 80)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("probes", [0, 1])
def test_sets_are_read_whatever_the_filter_lets_pass(spark, monkeypatch, probes):
    monkeypatch.setattr(jaccard_join, "BLOOM_WORDS", 1)
    monkeypatch.setattr(jaccard_join, "BLOOM_PROBES", probes)
    rows = near_copies()
    rows += [(None, t) for _, t in rows[:20]] + [(rows[0][0], rows[1][1])]
    assert rows_of(jaccard_join.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def check_shards(df, shards):
    rows = df.select("doc_id", "text").collect()
    got = sharding.shard(df, shards).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, crc(r.text)) for r in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    assert max(counts) - min(counts) <= 1
    parts = collections.defaultdict(set)
    sizes = collections.Counter(r.text_crc32 for r in got)
    for r in got:
        parts[r.text_crc32].add(r.shard)
    return sum(len(p) - math.ceil(sizes[c] / max(counts)) for c, p in parts.items())


def test_sharding(spark):
    many = [(i, f"text {i // 3 if i < 300 else i}") for i in range(500)]
    assert check_shards(with_clashes(frame(spark, many)), 7) == 0
    hot = [(i, "the same" if i < 200 else f"t{i // 2}") for i in range(600)]
    # quotas of 75 and pairs: six shards end on half a pair or a lone document of the large group
    assert check_shards(frame(spark, hot), 8) <= 6
    assert check_shards(with_clashes(frame(spark, odd_rows())), 5) <= 3
    assert check_shards(small_documents(spark), 40) <= 8
    assert sharding.shard(frame(spark, []), 40).count() == 0


def test_sharding_cuts_only_what_quotas_force(spark):
    hot = [(i, "the same" if i < 200 else f"t{i // 2}") for i in range(600)]
    assert check_shards(frame(spark, hot), 8) <= 4
    # copies only, so no room: two shards of 10 hold 3 + 3 + 2 + 2 and 2 * 5 whole
    pairs = [(i, f"three {i // 3}" if i < 6 else f"two {i // 2}") for i in range(20)]
    assert check_shards(frame(spark, pairs), 2) == 0
    fours = [(i, f"four {i // 4}" if i < 320 else f"two {i // 2}") for i in range(480)]
    assert check_shards(frame(spark, fours), 40) == 0


def test_sharding_comes_from_propagation(spark, monkeypatch):
    # a third are copies: votes and moves bring the groups together, nothing is packed
    rows = [(i, f"text {i % 60 if i % 3 == 0 else i}") for i in range(600)]
    moved, admitted = [], sharding.admitted
    monkeypatch.setattr(sharding, "admitted", lambda *a: (x := admitted(*a), moved.append(sum(x.values())))[0])
    monkeypatch.setattr(sharding, "packed", lambda *a: pytest.fail("packed"))
    assert check_shards(frame(spark, rows), 7) == 0 and sum(moved) > 0


def test_sharding_places():
    for sizes, shards in (({3: 50, 2: 7}, 5), ({90: 3, 7: 4, 2: 1}, 8), ({5: 13, 3: 1, 2: 40}, 40)):
        quota = sharding.quotas(sum(s * c for s, c in sizes.items()), shards)
        plan, used = sharding.packed(sizes, quota), collections.Counter()
        assert {s: sum(n for n, _ in places) for s, places in plan.items()} == sizes
        for size, places in plan.items():
            for n, parts in places:
                assert sum(x for _, x in parts) == size
                used.update({j: n * x for j, x in parts})
        assert [used[j] for j in range(shards)] == quota
        assert sum(n * (len(parts) - math.ceil(s / max(quota))) for s, places in plan.items() for n, parts in places) < shards


def brute_base(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0D]+", t) if x]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_rules(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    extra = [(20, "a b c a b c a b c\n\n \nx\nx\nx\n"), (21, "r e p " * 40), (22, "#*$%&|<> " * 60 + " ".join(words(60, 7))), (23, "\n".join(["same line"] * 5)), (24, "aa aa aa aa")]
    for rows in ([*odd_rows(), *extra], [(r.doc_id, r.text) for r in small_documents(spark).collect()], []):
        df = quality_rules.quality_rules(with_clashes(frame(spark, rows)), labels)
        got = rows_of(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted(((i, *brute_base(t)) for i, t in rows), key=repr)
        assert all(r.kept == (not r.base_failed) for r in df.collect())  # too few labels certify nothing


def binomial_tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(10, 0, 0.1), (1000, 7, 0.01), (5000, 20, 0.007), (200000, 1300, 0.007)]
    for n, k, p in cases:
        got = spark.range(1).select(quality_rules.tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p).alias("x")).first().x
        assert got == pytest.approx(binomial_tail(n, k, p), rel=1e-6)


def test_certified_cutoffs(spark):
    rng = random.Random(3)
    cuts = {"a": [0.9, 0.5, 0.1], "b": [0.8, 0.4]}
    rows = [("x" if i % 3 else "y", bool(rng.random() < 0.8), rng.random() ** 6, rng.random() ** 9) for i in range(9000)]
    got = {(r.stratum, r.rule): r.cutoff for r in quality_rules.certified_cutoffs(
        spark.createDataFrame(rows, "stratum string, good boolean, a double, b double"), 0.2, 0.05, cuts).collect()}
    want = {}
    for s in "xy":
        for j, rule in enumerate("ab"):
            good = [r[2 + j] for r in rows if r[0] == s and r[1]]
            for c in cuts[rule]:
                k = sum(v > c for v in good)
                if k > len(good) * 0.1 or binomial_tail(len(good), k, 0.1) > 0.05 / 4:
                    break
                want[s, rule] = c
    assert got == want and want


def test_rules_reject_and_keep(spark):
    clean = [(i, " ".join(words(80, i, 5000)), "en" if i % 2 else "fr") for i in range(2400)]
    junk = [(5000 + i, " ".join(w + "###" for w in words(80, i, 5000)), "en") for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(2400)] + [(5000 + i, 0) for i in range(30)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, clean + junk), labels).collect()}
    assert not any(got[5000 + i].kept for i in range(30))
    lost = [sum(not got[i].kept for i in range(2400) if i % 2 == h) for h in (0, 1)]
    assert max(lost) <= 0.05 * 1200


def held_out_result(df, labels, name):
    marks = {r.doc_id: r[name] for r in labels.collect()}
    rows = [r for r in df.collect() if r.doc_id in marks and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    y, s = np.asarray([marks[r.doc_id] for r in rows]), np.asarray([r.score for r in rows])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    return auc, np.mean([r.predicted == marks[r.doc_id] for r in rows])


@pytest.mark.parametrize("run,name,auc,accuracy", [(quality_knn.quality_scores, "quality", 0.95, 0.95), (toxicity.toxicity_scores, "toxic", 0.95, 0.95)])
def test_held_out_accuracy(spark, run, name, auc, accuracy):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(F.broadcast(labels.select("doc_id")), "doc_id")
    got = held_out_result(run(docs, labels), labels, name)
    assert got[0] >= auc and got[1] >= accuracy, got


@pytest.mark.parametrize("run,name", [(quality_knn.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, run, name):
    labels = spark.createDataFrame([(1, 1), (12, 0), (7, 0), (9, 1), (None, 1), (10, None)], f"doc_id bigint, {name} int")
    plain, clash = frame(spark, odd_rows()), with_clashes(frame(spark, odd_rows()))
    got = rows_of(run(plain, labels), "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(odd_rows()) and all(0 <= r[2] <= 1 for r in got)
    assert rows_of(run(clash, labels), "doc_id", "held_out", "score", "predicted") == got
    assert run(frame(spark, []), labels).count() == 0
    assert run(plain, labels.limit(0)).count() == len(odd_rows())


def test_votes_are_exact():
    rng = np.random.default_rng(2)
    unit = quality_knn.unit
    model = {"vectors": unit(rng.standard_normal((300, 8))), "labels": (rng.random(300) < 0.5).astype(np.float32), "prior": 0.5}
    queries = unit(rng.standard_normal((70, 8)))
    got = quality_knn.votes(queries, model, 0.5, 9)
    for q, s in zip(queries, got):
        cos = model["vectors"] @ q
        near = np.argsort(-cos)[:9]
        w = np.maximum(cos[near], 0) ** 4
        assert s == pytest.approx((w * model["labels"][near]).sum() / w.sum(), abs=1e-5)


def test_network_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    gates = rng.standard_normal((3, 7, 6 * toxicity.HIDDEN)).astype(np.float32)
    mask = np.asarray([[1] * 7, [1] * 4 + [0] * 3, [1] + [0] * 6], dtype=np.float32)
    up = np.asarray([0.7, -0.4, 0.2], dtype=np.float32)
    loss = lambda: float(net.forward(gates, mask) @ up)
    _, kept = net.forward(gates, mask, keep=True)
    grad, d_gates = net.backward(gates, mask, kept, up)
    for key in ("u_f", "c_b", "att", "att_v", "out", "u_b"):
        flat = net.p[key].ravel()
        for i in rng.integers(0, flat.size, 3):
            old = flat[i]
            flat[i] = old + 1e-2
            hi = loss()
            flat[i] = old - 1e-2
            lo = loss()
            flat[i] = old
            assert grad[key].ravel()[i] == pytest.approx((hi - lo) / 2e-2, abs=2e-3)
    for at in ((0, 2, 5), (1, 3, 20), (2, 0, 40)):
        old = gates[at]
        gates[at] = old + 1e-2
        hi = loss()
        gates[at] = old - 1e-2
        lo = loss()
        gates[at] = old
        assert d_gates[at] == pytest.approx((hi - lo) / 2e-2, abs=2e-3)


def test_every_word_is_in_a_window():
    for n in (1, 63, 64, 65, 112, 113, 1000):
        starts = toxicity.window_starts(n)
        assert set().union(*[range(s, min(s + toxicity.WINDOW, n)) for s in starts]) == set(range(n))


def test_a_toxic_word_anywhere_counts():
    rng = random.Random(5)
    clean = [" ".join(words(rng.randrange(20, 150), 1000 + i, 800)) for i in range(300)]
    bad = [" ".join(words(rng.randrange(10, 70), 2000 + i, 800) + ["vileword" + "xyz"[i % 3]] * 2 + words(rng.randrange(10, 70), 3000 + i, 800)) for i in range(300)]
    scorer = toxicity.Scorer(toxicity.train(clean + bad, [0] * 300 + [1] * 300, epochs=3))
    long = words(3000, 77, 800)
    texts = [" ".join(long), " ".join(long[:2000] + ["vilewordx"] * 2 + long[2000:]), "", "a nice day"]
    s = scorer.scores(texts)
    assert s[1] > 0.5 > s[0] and s[2] == 0 and s[3] < 0.5
