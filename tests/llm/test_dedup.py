import hashlib
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quire.llm import components, exact_dedup, simhash


def brute_exact(rows):
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t), []).append((i, len(t or "")))
    keep = {h: min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0] for h, g in groups.items()}
    return sorted(((i, keep[sha(t)], len(groups[sha(t)]), i == keep[sha(t)], sha(t)) for i, t in rows), key=repr)


def exact(df, **how):
    return sorted((tuple(r) for r in exact_dedup.exact_groups(df, **how).collect()), key=repr)


def test_exact_groups(spark, awkward):
    assert exact(awkward) == brute_exact([(r["doc_id"], r["text"]) for r in awkward.collect()])


@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_heavy_and_light_groups_agree(spark, documents, heavy):
    rng = random.Random(heavy)
    rows = [(i, rng.choice(["hot  text", "hot text", "hottext"]) if i % 3 == 0 else f"t{rng.randint(0, 150)}" + " " * rng.randint(0, 2)) for i in range(600)]
    assert exact(documents(rows).repartition(7), tracked=64, heavy=heavy) == brute_exact(rows)


def test_exact_empty_table(spark, documents):
    none = documents([]).where("doc_id is null")
    assert exact(none) == []
    assert exact_dedup.drop_exact_copies(none).columns == none.columns


def test_drop_exact_copies_keeps_columns(spark, documents):
    df = documents([(1, "a b"), (2, "a  b"), (3, "c")])
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def brute_print(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    own = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                own[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def near(df, **how):
    return sorted((tuple(r) for r in simhash.near_duplicates(df, **how).collect()), key=repr)


def test_fingerprints(monkeypatch):
    texts = [None, "", " \t", "one", "One TWO", "a b c d e f", "É\u00a0x\x85y Z\x1c ok", "w " * 500]
    assert [simhash.fingerprint(t or "") for t in texts] == [brute_print(t) for t in texts]
    want = simhash.fingerprint("a b c d e f g h i j k")
    monkeypatch.setattr(simhash, "STRETCH", 3)
    assert simhash.fingerprint("a b c d e f g h i j k") == want


@pytest.mark.parametrize("bucket", [1, 64])
def test_near_duplicates(spark, documents, bucket):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(300)) for _ in range(6)]
    rows = [(100 - k, base[k % 6].replace(" ", "  ", k) + (f" x{k}" if k % 4 == 0 else "")) for k in range(40)]
    rows += [(200, None), (201, ""), (202, "\t "), (None, base[0]), (203, "lone text here"), (203, "lone text here")]
    assert near(documents(rows), bucket=bucket) == brute_components(rows)


def test_near_empty_table(spark, documents):
    assert near(documents([]).where("doc_id is null")) == []


def test_golay_keys_miss_nothing():
    rng, golay = np.random.default_rng(0), simhash.Golay()
    prints = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    keys = lambda p: [set(k) for k in _split(*simhash.keys_of(p, golay), len(p))]
    own = keys(prints)
    for errors in (0, 1, 2):
        other = prints.copy()
        for _ in range(errors):
            other ^= np.uint64(1) << rng.integers(0, 64, len(other)).astype(np.uint64)
        assert all(a & b for a, b in zip(own, keys(other)))


def _split(owner, key, n):
    out = [[] for _ in range(n)]
    for o, k in zip(owner.tolist(), key.tolist()):
        out[o].append(k)
    return out


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_of_crowded_buckets(spark, bucket):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(250):
        x = rng.choice(sorted(prints)) if rng.random() < 0.3 else centre
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "f long"), bucket)).collect()
    got = {}
    for r in found:
        got.setdefault(r["component"], set()).add(r["node"])
    u = lambda x: x & (1 << 64) - 1
    seen, want = set(), set()
    for x in signed:
        if x in seen:
            continue
        group, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in group:
                group.add(y)
                todo += [z for z in signed if z not in group and (u(y) ^ u(z)).bit_count() <= 2]
        seen |= group
        if len(group) > 1:
            want.add(frozenset(group))
    assert {frozenset(g) for g in got.values()} == want


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150), (200, 150)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}


def test_components_leave_no_shuffle_files_of_earlier_rounds(spark, monkeypatch):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = blocks.getAllFiles().mkString("\n")
        return {int(x) for x in re.findall(r"/shuffle_(\d+)_", names)}

    before, rounds, cut = shuffles(), [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(shuffles() - before) or cut(df))
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    got = {r["component"] for r in components.components(chain).collect()}
    assert got == {0} and len(rounds) > 5
    made = [now - earlier for earlier, now in zip(rounds, rounds[1:])]  # by the round before
    assert all(made) and not any(own & later for own, later in zip(made, rounds[3:]))


def test_drop_near_copies_keeps_columns(spark, documents):
    df = documents([(5, "same words here today"), (3, "same  words here today"), (9, "quite another text altogether now")])
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 9]


def brute_similar(rows):
    """doc_ids that stay where five-word shingles with a Jaccard similarity of 0.8 or more link texts."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    for i, j in links:
        own[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values()), links


def planted(rng, copies):
    """Texts of 20 to 400 words with copies of which up to a fifth of the shingles changes."""
    rows = []
    for k in range(12):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([20, 60, 150, 400]))]
        for c in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30)) if c else 0):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 9999)}"
            rows.append((1000 - 40 * k + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("bucket, pivots", [(64, 4), (3, 1)])
def test_drop_near_copies_finds_planted_pairs(spark, documents, bucket, pivots):
    rows = planted(random.Random(5), 8) + [(1, None), (2, " "), (3, "one two"), (4, "One  two"), (5, "two one")]
    want, links = brute_similar(rows)
    prints = [brute_print(t) for _, t in rows]
    assert sum((prints[i] ^ prints[j]).bit_count() > 2 for i, j in links) > len(links) / 3  # which two bits would miss
    groups = simhash.similar_groups(documents(rows), bucket=bucket, pivots=pivots)
    assert sorted(r["doc_id"] for r in groups.where("doc_id = component_id").collect()) == want
    if bucket == 64:
        assert sorted(r["doc_id"] for r in simhash.drop_near_copies(documents(rows)).collect()) == want


def test_fingerprints_are_candidates(spark, documents):
    """Without bands those links remain whose fingerprints differ in at most two bits, if the sets are similar."""
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    often, long = "river stone lamp walks green house tree " * 200, text(3000)
    rows = [(1, often + text(30)), (2, often + text(30)), (3, long), (4, long + " more"), (5, text(30)), (6, ""), (7, None)]
    prints = [brute_print(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and (prints[2] ^ prints[3]).bit_count() <= 2
    groups = simhash.similar_groups(documents(rows), bands=0).collect()
    assert sorted(r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]) == [1, 2, 3, 5, 6] == brute_similar(rows)[0]


def test_large_group_of_similar_texts(spark, documents):
    rng = random.Random(6)
    words, rows = [f"w{i}" for i in range(150)], []
    for k in range(150):
        own = list(words)
        for at in rng.sample(range(150), k % 6):
            own[at] = rng.choice(["red", "blue", f"new{k}"])
        rows.append((500 - k, " ".join(own)))
    groups = simhash.similar_groups(documents(rows), bucket=16, pivots=2).collect()
    assert sorted(r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]) == brute_similar(rows)[0]


def test_bands_of_similar_sets():
    rng, shared = np.random.default_rng(3), []
    for _ in range(300):
        common, apart = rng.integers(0, 1 << 64, 160, dtype=np.uint64), rng.integers(0, 1 << 64, 40, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, x])) for x in (apart[:20], apart[20:]))  # similarity 0.8
        shared.append(np.mean(simhash.band_keys(a) == simhash.band_keys(b)))
    assert min(shared) > 0 and abs(np.mean(shared) - 0.8**5) < 0.02


ROWS = [(1, "a  "), (2, "a"), (2, "unique"), (3, "q"), (3, "q"), (3, "q r"), (None, "z"), (None, "z"), (None, "q"), (4, None), (5, " ")]


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_copies_go_row_by_row(spark):
    """Repeated ids with different texts lose nothing; repeated rows and rows without an id are copies as all others."""
    df = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, h string, `row.h` int")
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert texts_of(kept) == sorted([(1, "a  "), (2, "unique"), (3, "q"), (3, "q r"), (None, "z"), (5, " ")], key=str)
    assert {r["row.h"] for r in kept.collect()} == {0, 2, 3, 5, 6, 10}


def test_near_copies_go_row_by_row(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 60))
    one, two = text(), text()
    rows_alone = text()
    rows = [(1, one), (1, two), (2, one + " more"), (3, two), (3, two), (4, text()), (None, one), (None, rows_alone + " x"), (None, rows_alone), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    kept = texts_of(simhash.drop_near_copies(df))
    alone = [r for r in kept if r[0] is None]
    assert len(alone) == 1 and alone[0][1].startswith(rows_alone)
    assert [r for r in kept if r[0] is not None] == sorted([(1, one), (1, two), (4, rows[5][1]), (5, None)], key=str)
    assert simhash.drop_near_copies(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, one, "b"), (7, one, "a")], df.schema)
    assert [tuple(r) for r in simhash.drop_near_copies(twice).collect()] == [(7, one, "a")]
