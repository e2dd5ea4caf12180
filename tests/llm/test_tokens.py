import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from quire.llm import bpe_codec, packing, token_counts, units

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return token_counts.load_tokenizer(NAME)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


LETTERS = [" ", "\n", "\t", "a", "B", "é", "ß", "1", "٣", "'", "'s", "'ll", "!", "中", "\u00a0", "\u2003", "\x1c", "\x85", "😀", "<|endoftext|>", "<|end", " the", "\u200b", "e\u0301", "\r\n", "ⅷ", "\x00", "a" * 90, "=" * 100]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_units_are_certain_cuts(library):
    encoder = units.UnitEncoder(library)
    for text in random_texts(1500):
        parts = [u for s in units.stretches(text, 20) for u in units.units(s)]
        assert "".join(parts) == text
        joined = b"".join(encoder.ids(parts))
        assert joined == np.array(ids_of(library, text), "<u4").tobytes()
        assert sum(encoder.counts(parts)) == len(joined) // 4


def test_codec_equals_the_library(library):
    bpe = bpe_codec.load(NAME)
    for text in random_texts(1500, 2):
        ids = ids_of(library, text)
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)
    odd = [[200, 201], [188], list(range(0, 300, 7)), [50256, 255, 50256]]  # no UTF-8
    assert [bpe.decode(x) for x in odd] == [library.decode(x, skip_special_tokens=False) for x in odd]


def test_all_letters_are_split_alike(library):
    bpe, encoder = bpe_codec.load(NAME), units.UnitEncoder(library)
    letters = [chr(c) for c in range(0, 0x110000, 37) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b {c} 1{c}2\n{c}!{c}" for c in letters]
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [bpe.encode(t) for t in texts] == want
    assert encoder.ids(texts) == [np.array(x, "<u4").tobytes() for x in want]


def test_long_fragments_merge_alike():
    bpe = bpe_codec.load(NAME)
    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.choice(b"abeinrst") for _ in range(rng.randint(65, 200)))
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(zip(parts, parts[1:]), key=lambda p: bpe.ranks.get(p, 1 << 40))
            if best not in bpe.ranks:
                break
            parts = bpe._joined(parts, best)
        assert bpe.merge(word) == tuple(bpe.ids[p] for p in parts) == tuple(bpe.fragment_ids(word))


def test_bounded_cache_keeps_what_is_asked():
    cache = units.BoundedCache(3, {"a": 1})
    for keys in (["a", "b", "c"], ["d", "e", "a", "b"], ["f", "g", "h", "i", "j", "a"]):
        assert list(cache.values_of(keys, lambda new: [ord(x) - 96 for x in new])) == [ord(x) - 96 for x in keys]


def test_counts(spark, awkward, library):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(awkward, NAME).collect())
    want = sorted((i or 0, len((t or "").encode()), n := len(ids_of(library, t)), n > 512) for i, t in texts_of(awkward))
    assert got == want


def test_codec(spark, awkward, library):
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.digest_documents(awkward, NAME).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i or 0, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, t in texts_of(awkward) for ids in [ids_of(library, t)])
    assert got == want
    few = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe_codec.encode_documents(awkward.where("doc_id in (2, 6)"), NAME).collect()}
    assert few[2] == ([], "") and few[6][1] == "Hello world, it's me"


def test_empty_tables(spark, documents):
    none = documents([]).where("doc_id is null")
    assert token_counts.count_tokens(none, NAME).count() == 0
    assert bpe_codec.digest_documents(none, NAME).count() == 0
    assert packing.pack_documents(none, NAME).count() == 0


def check_packing(rows, sizes, capacity=2048):
    """``rows``: (sequence_id, offset, length); whole sequences without gaps, within capacity."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, awkward, library):
    rows = packing.pack_documents(awkward, NAME).collect()
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], None)
    want = []
    for i, t in texts_of(awkward):
        ids = np.array([*ids_of(library, t), 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i or 0, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_stretches_are_encoded_whole(library):
    encoder, cache, asked = units.UnitEncoder(library), units.BoundedCache(1000), []
    by_rank = encoder.by_rank
    encoder.by_rank = lambda text: asked.append(text) or by_rank(text)
    for text in ["", "Hello world, it's  me\n" * 50, *random_texts(300, 5)]:
        asked.clear()
        assert encoder.stretch_ids(text, cache) == np.array(ids_of(library, text), "<u4").tobytes()
        assert "<|endoftext|>" in text or asked == [text]  # no unit was looked up
    assert cache and all("<|endoftext|>" not in x for x in asked)


def test_long_runs_of_white_space(spark, documents, library):
    texts = ["a" + "\n" * 1_000_100 + "b", "a b" + " " * 1_000_100]
    rows = packing.piece_documents(documents(list(enumerate(texts))), NAME).collect()
    for i, text in enumerate(texts):
        ids, own = np.array([*ids_of(library, text), 0], "<u4"), [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


@pytest.mark.parametrize("n, hot", [(1, 0), (300, 0), (9000, 0), (12000, 5000)])
def test_solver_covers_and_packs_well(n, hot):
    rng = np.random.default_rng(n)
    lengths = np.minimum(rng.lognormal(6.3, 1.0, n).astype(int) + 1, 2048)
    lengths = np.concatenate([lengths, np.full(hot, 600)])
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.solve(dict(zip(values.tolist(), counts.tolist())))
    ranks = np.concatenate([np.arange(c) for c in counts])
    ordered = np.repeat(values, counts)
    sequence, offset = plan.place(ordered, ranks)
    used = check_packing(list(zip(sequence.tolist(), offset.tolist(), ordered.tolist())), None)
    assert used == plan.sequences <= 1.005 * -(-int(lengths.sum()) // 2048) + 1


def best_fit_decreasing(lengths, capacity=2048):
    """How many sequences plain best fit takes, longest pieces first."""
    by_room, used = [0] * (capacity + 1), 0
    for length in sorted(lengths, reverse=True):
        room = next((r for r in range(length, capacity + 1) if by_room[r]), None)
        if room is None:
            used, room = used + 1, capacity
        else:
            by_room[room] -= 1
        by_room[room - length] += 1
    return used


KINDS = {
    "lognormal": lambda rng, n: np.clip(rng.lognormal(5.5, 1.2, n).astype(int) + 1, 1, 2047),
    "halves": lambda rng, n: rng.integers(500, 1100, n),
    "thirds": lambda rng, n: rng.integers(600, 720, n),
    "few": lambda rng, n: rng.choice([3, 700, 1400], n),
    "uniform": lambda rng, n: rng.integers(1, 2049, n),
    "below a third": lambda rng, n: rng.integers(640, 701, n),
    "halves and small": lambda rng, n: np.concatenate([rng.integers(900, 1201, n // 2), rng.integers(60, 201, n // 2)]),
    "quarters": lambda rng, n: rng.integers(400, 561, n),
    "two only": lambda rng, n: rng.integers(700, 1001, n),
}


@pytest.mark.parametrize(
    "kind, n",
    [("lognormal", 200), ("lognormal", 1100), ("lognormal", 20_000), ("halves", 3000), ("thirds", 1000), ("few", 500)]
    + [("uniform", 5000), ("below a third", 5000), ("halves and small", 6000), ("quarters", 4000), ("two only", 4000)],
)
@pytest.mark.parametrize("seed", [11, 12])
def test_no_more_sequences_than_best_fit(kind, n, seed):
    lengths = KINDS[kind](np.random.default_rng(seed), n)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.solve(dict(zip(values.tolist(), counts.tolist())))
    left = np.bincount(lengths, minlength=2049)
    assert packing.lower_bound(left, 2048) <= plan.sequences <= best_fit_decreasing(lengths.tolist()) + (kind == "uniform")
    ordered = np.sort(lengths)
    sequence, offset = plan.place(ordered, np.arange(len(ordered)) - np.searchsorted(ordered, ordered))
    assert check_packing(list(zip(sequence.tolist(), offset.tolist(), ordered.tolist())), None) == plan.sequences


def test_lower_bound_by_all_thresholds():
    rng = np.random.default_rng(4)
    for _ in range(50):
        capacity = int(rng.integers(6, 30))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 20))
        large = [x for x in lengths if 2 * x > capacity]
        bounds = []
        for t in range(capacity // 2 + 1):
            middle = [x for x in large if x <= capacity - t]
            volume = sum(x for x in lengths if t <= x <= capacity // 2)
            bounds.append(len(large) + max(0, math.ceil((volume - sum(capacity - x for x in middle)) / capacity)))
        assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity) == max(bounds)


def test_prices_by_brute_force():
    """For each length the configuration that is worth most of those with it as the longest, by trying all."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        capacity, worth, bound = 20, np.zeros(21), np.zeros(21, np.int64)
        sizes = rng.choice(np.arange(2, 15), 4, replace=False)
        worth[sizes], bound[sizes] = rng.random(4) + 0.1, rng.integers(1, 4, 4)
        prices = packing.Prices(worth, bound, capacity)
        every = [c for c in itertools.product(*(range(bound[s] + 1) for s in sizes)) if sum(int(n * s) for n, s in zip(c, sizes)) <= capacity]
        best = max(sum(n * worth[s] for n, s in zip(c, sizes)) for c in every)
        assert abs(prices.whole.max() - best) < 1e-9
        for i, whole in enumerate(prices.whole):
            conf = dict(prices.configuration(i))
            assert abs(sum(n * worth[s] for s, n in conf.items()) - whole) < 1e-9
            assert sum(n * s for s, n in conf.items()) <= capacity and all(n <= bound[s] for s, n in conf.items())


def test_solver_is_optimal_on_small_cases():
    assert packing.solve({1024: 2}).sequences == 1
    assert packing.solve({1500: 3, 548: 3}).sequences == 3
    assert packing.solve({2048: 5, 1: 10}).sequences == 6
    assert packing.solve({}).sequences == 0


def test_ranks_do_not_depend_on_groups(spark):
    pieces = spark.range(2000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 700L, 1 + id % 900) as length")
    for groups in (1, 64):
        rows = packing.pack_pieces(pieces, group_rows=10, groups=groups).collect()
        assert len({r["doc_id"] for r in rows}) == 2000
        check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], None)


def test_columns_of_pieces_are_safe(spark):
    pieces = spark.range(50).selectExpr("id as doc_id", "0 as piece", "1 + id as length", "'g' as `group`", "'r' as rank", "'x' as `__group0`", "id as `a.b`", "'o' as offset")
    got = packing.pack_pieces(pieces)
    assert got.columns == ["doc_id", "piece", "length", "group", "rank", "__group0", "a.b", "sequence_id", "offset"]
    rows = got.collect()
    assert {(r["group"], r["rank"], r["__group0"], r["a.b"] == r["doc_id"]) for r in rows} == {("g", "r", "x", True)}
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], None)


def test_frequent_units(spark):
    """What fills more than its share of all units is found, whatever the partitions; long units are left out."""
    texts = spark.range(0, 400, 1, 7).selectExpr("if(id < 100, concat(repeat('abc ', 50), 'x', id), concat_ws(' ', transform(sequence(0, 40), i -> concat('w', id, '_', i)))) as text")
    texts = texts.unionByName(spark.createDataFrame([("y" * 100_000,)], "text string"))
    found = token_counts.frequent_units(texts, summary=50, reported=20, frequent=30)
    assert " abc" in found and len(found) <= 30 and max(map(len, found)) <= units.LONGEST
    assert token_counts.frequent_units(texts.limit(0)) == []


def test_long_units_are_not_kept():
    cache = units.BoundedCache(10)
    long = "z" * 1000
    assert list(cache.values_of(["a", long, "b", long], lambda new: [len(x) for x in new])) == [1, 1000, 1, 1000]
    assert set(cache) == {"a", "b"}
