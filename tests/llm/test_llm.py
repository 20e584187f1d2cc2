"""Each operator against a plain version or a round trip, with the odd cases its docstring names."""

import base64
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import bpe, neighbours, packing, quality, queries, splitting

PATH, PATTERN = queries.tokenizer()


# --- encoding -------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = np.random.default_rng(2)
    signs = list("aab \n\t'sé日本🙂1.") + ["́", "the ", "ing", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 300))) for _ in range(200)]
    return [*texts, "", None, "a" * 9000, "日" * 3000, " " * 500, "<|endoftext|> end", "ab" * 4000]


def test_replay_equals_the_reference_encoding(reference_encoding):
    v = bpe.Vocabulary(PATH, PATTERN)
    texts = odd_texts()
    got = [np.frombuffer(x, np.int32).tolist() for x in v.encode(texts)]
    assert got == [reference_encoding.encode_ordinary(t or "") for t in texts]


def test_replay_of_words_with_merges_of_lower_rank():
    # "bc" is found only after "ab" failed to apply; ranks that fall behind go through the definition
    v = bpe.Vocabulary(PATH, PATTERN)
    words = [b"abcabc", b"aaaaaaa", b"zzzz", bytes(range(256))]
    assert v.replay(words) == [v.one_by_one(w) for w in words]
    # merges of any order, against the definition: all pairs looked at each time
    odd = bpe.Vocabulary(PATH, PATTERN)
    rng = np.random.default_rng(3)
    made = {i: (i,) for i in range(4)}
    rule = {}
    for r in rng.permutation(np.arange(4, 40)).tolist():
        a, b = rng.choice(sorted(made), 2).tolist()
        rule.setdefault((a, b), r)
        made[r] = made[a] + made[b]
    odd.single, odd.merged = list(range(4)) * 64, lambda a, b: rule.get((a, b), -1)
    for _ in range(300):
        word = bytes(rng.integers(0, 4, rng.integers(1, 60)).tolist())
        ids = list(word)
        while any((p := [(rule.get(x, 99), i) for i, x in enumerate(zip(ids, ids[1:])) if x in rule])):
            r, i = min(p)
            ids[i : i + 2] = [r]
        assert odd.one_by_one(word) == ids and odd.replay([word]) == [ids]


def test_a_long_word_of_any_order_takes_no_square_time():
    import time

    v = bpe.Vocabulary(PATH, PATTERN)
    word = b"abracadabra" * 5000
    began = time.time()
    ids = v.one_by_one(word)
    assert time.time() - began < 3 and b"".join(map(v.bytes_of.__getitem__, ids)) == word


def test_encoded_rows(spark, reference_encoding):
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello there", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "k long, body string, ids string").withColumn("doc_id", F.lit("clash"))
    got = sorted(((r.doc_id, tuple(r.ids)) for r in bpe.encoded(df, "k", "body", PATH, PATTERN).collect()), key=str)
    hello = tuple(reference_encoding.encode_ordinary("Hello there"))
    assert got == sorted([(1, hello), (2, ()), (3, ()), (1, hello), (None, tuple(reference_encoding.encode_ordinary("a")))], key=str)
    assert bpe.encoded(df.limit(0), "k", "body", PATH, PATTERN).count() == 0
    whole = bpe.encoded_by_corpus(df, "k", "body", PATH, PATTERN)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in whole.collect()), key=str) == got
    assert bpe.encoded_by_corpus(df.limit(0), "k", "body", PATH, PATTERN).count() == 0
    back = bpe.decoded(bpe.encoded(df, "k", "body", PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((k, t or "") for k, t, _ in rows), key=str)
    counts = {(r.doc_id, r.n_tokens) for r in bpe.token_counts(df, "k", "body", PATH, PATTERN).collect()}
    assert counts == {(a, len(b)) for a, b in got}


# --- packing --------------------------------------------------------------------------------------------------------

def first_fit(sizes, capacity):
    """Containers that first fit, largest first, takes."""
    rooms = []
    for s in sorted(map(int, sizes), reverse=True):
        for k, room in enumerate(rooms):
            if room >= s:
                rooms[k] -= s
                break
        else:
            rooms.append(capacity - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_item_once_and_never_overfills(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 3000) if seed else np.array([60] * 7 + [41] * 2)
    counts = np.bincount(sizes, minlength=101)
    used = np.zeros(101, np.int64)
    boxes = 0
    for times, held in packing.plan(counts, 100):
        assert times > 0 and sum(s * k for s, k in held) <= 100
        for s, k in held:
            used[s] += times * k
        boxes += times
    assert (used == counts).all()
    assert boxes <= 1.01 * first_fit(sizes, 100) + 1


@pytest.mark.parametrize("bucket_items", [100, 65_536])
def test_packed(spark, bucket_items):
    rng = np.random.default_rng(9)
    rows = [(int(i), int(n)) for i, n in enumerate(rng.integers(0, 260, 2000))]
    rows += [(5000 + i, 40) for i in range(1500)] + [(7, 30), (7, 30), (9001, None), (9002, 100), (9003, 200), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("bucket", F.lit("clash"))
    got = packing.packed(df, 100, bucket_items).collect()
    assert sum(r.part_tokens for r in got) == sum(n or 0 for _, n in rows)
    fill = {}
    for r in got:
        assert 0 <= r.part_tokens <= 100 and (r.container_id > 0) == (r.part_tokens > 0)
        fill[r.container_id] = fill.get(r.container_id, 0) + r.part_tokens
    assert max(fill.values()) <= 100
    assert len(fill) - (0 in fill) <= 1.01 * first_fit([r.part_tokens for r in got if r.part_tokens], 100) + 1
    parts = sorted((r.part_no, r.part_tokens) for r in got if r.doc_id == 9003)
    assert parts == [(0, 100), (1, 100)]
    assert sum(r.doc_id == 7 for r in got) == 2 + -(-dict(rows[:2000])[7] // 100)
    assert packing.packed(df.limit(0), 100).count() == 0


# --- splitting ------------------------------------------------------------------------------------------------------

SAMPLES = [
    "One short sentence here. " * 20 + "no end",
    "word " * 200,
    "x" * 500,
    "第一句话在这里。" * 60,
    "a, b; c: " * 80,
    ("Line without stop\n" * 30).strip(),
    "é" * 300,
    "🙂" * 350 + " end.",
    "He said \"stop.\" Then he left. " * 15,
]


def test_pieces_cover_the_text_and_keep_the_limit():
    for (starts, ends), text in zip(splitting.ends_of(SAMPLES, 100, 20), SAMPLES):
        assert starts[0] == 0 and ends[-1] == len(text)
        assert (ends - starts).max() <= 100 and (np.diff(ends) > 0).all() and (np.diff(starts) > 0).all()
        kept = ends[:-1] - starts[1:]
        assert (kept >= 15).all() and (kept <= 26).all()


def test_squared_successors_equal_one_walk_at_a_time():
    whole = splitting.ends_of(SAMPLES, 100, 20)
    for text, (starts, ends) in zip(SAMPLES, whole):
        alone = splitting.ends_of([text], 100, 20)[0]
        assert alone[0].tolist() == starts.tolist() and alone[1].tolist() == ends.tolist()


@pytest.mark.parametrize("window", [130, 300, 1000])
def test_windows_of_a_long_text_cut_it_the_same(window):
    rng = np.random.default_rng(1)
    signs = list("ab c.  \n,。、」)’é") + ["́", "‍", " " * 40, "x" * 90]
    texts = SAMPLES + ["".join(rng.choice(signs, 900)) for _ in range(20)]
    for text, (starts, ends) in zip(texts, splitting.ends_of(texts, 100, 20)):
        alone = splitting.ends_of([text], 100, 20, window)[0]
        assert alone[0].tolist() == starts.tolist() and alone[1].tolist() == ends.tolist()


def test_cuts_at_pauses():
    (s, e), = splitting.ends_of([SAMPLES[0]], 100, 20)
    assert all(SAMPLES[0][x - 2] == "." for x in e[:-1])
    (s, e), = splitting.ends_of([SAMPLES[3]], 100, 20)
    assert all(SAMPLES[3][x - 1] == "。" for x in e[:-1])
    (s, e), = splitting.ends_of([SAMPLES[6]], 100, 20)
    assert all(SAMPLES[6][x] == "e" for x in e[:-1])
    (s, e), = splitting.ends_of([SAMPLES[1]], 100, 20)
    assert all(SAMPLES[1][x] == "w" for x in [*e[:-1], *s])


def test_pieces_table(spark):
    rows = [(1, "  " + "abc " * 300 + "\n"), (1, "  " + "abc " * 300 + "\n"), (2, None), (3, ""), (4, "x" * 800 + "  \t"), (5, "x" * 801), (6, " " + "y" * 800)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("row_id", F.lit("clash")).withColumn("body", F.lit(0))
    got = splitting.pieces(df, "id", "text").collect()
    assert {r.row_id for r in got} == {1, 5, 6}
    one = sorted((r.piece_no, r.start, r.end, r.piece) for r in got if r.row_id == 1)
    text = rows[0][1].strip(" \t\r\n")
    assert [x[0] for x in one] == list(range(1, len(one) + 1)) and all(text[a:b] == p for _, a, b, p in one)
    assert splitting.pieces(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(df, "id", "text", 100, 60)


# --- neighbours -----------------------------------------------------------------------------------------------------

def brute(ids, v, k, at_least=None):
    u = neighbours.decode(*neighbours.encode(neighbours._unit(v)))[0]  # to the 24 bits that travel
    cos = np.rint(np.minimum(u @ u.T, 1) * 1e6).astype(int)
    out = {}
    for i, a in enumerate(ids):
        ranked = sorted((-cos[i, j], b) for j, b in enumerate(ids) if b != a)
        out[a] = [(b, -c) for c, b in ranked if at_least is None or -c >= at_least * 1e6][:k]
    return out


def table_of(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "id long, v array<double>")


def got_of(df):
    out = {}
    for r in df.orderBy("id", "place").collect():
        out.setdefault(r.id, []).append((r.other, r.micro))
    return out


def test_codes_keep_24_bits():
    rng = np.random.default_rng(0)
    u = neighbours._unit(rng.normal(size=(200, 96)))
    back, scale = neighbours.decode(*neighbours.encode(u))
    assert np.abs(back - u).max() < 1e-7
    code, _ = neighbours.encode(u)
    assert np.abs(code * scale[:, None] - u).max() < 0.51 * scale.max()


@pytest.mark.parametrize("at_least", [None, 0.8])
@pytest.mark.parametrize("same", [True, False])
def test_candidates_hold_all_true_neighbours(at_least, same):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 32))
    v = base[rng.integers(0, 12, 300)] + rng.normal(size=(300, 32)) * 0.4
    ids = rng.permutation(1000)[:300]
    bits = neighbours.bits_of(neighbours._unit(v))
    code, rest = bits[:, :32].copy().view(np.int8), bits[:, 32:].copy().view(np.uint16)
    group = np.zeros(300, int) if same else (np.arange(300) % 2)
    a, b, micro = neighbours.block_best(ids, code, rest, group, 5, at_least)
    want = brute(ids, v, 300, at_least)
    side = dict(zip(ids, group))
    for i in ids:
        mine = [(int(y), int(m)) for x, y, m in zip(a, b, micro) if x == i]
        assert mine == [(y, m) for y, m in want[i] if same or side[y] != side[i]][:5]


def test_most_similar_exact_in_one_cell(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(6, 16))[rng.integers(0, 6, 80)] + rng.normal(size=(80, 16)) * 0.3
    v[10:25] = v[3]  # copies
    v[30] = v[31] * 7.0  # of another length
    ids = rng.permutation(500)[:80]
    df = table_of(spark, ids, v)
    df = df.union(df.limit(20)).withColumn("h", F.lit("clash"))
    for at_least in (None, 0.8):
        assert got_of(neighbours.most_similar(df, 16, 80, 5, at_least)) == {a: b for a, b in brute(ids, v, 5, at_least).items() if b}


def test_most_similar_in_groups_of_a_hot_cell(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = np.concatenate([np.ones((150, 16)) + rng.normal(size=(150, 16)) * 0.05, rng.normal(size=(150, 16))])
    ids = np.arange(300) * 3
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    got = got_of(neighbours.most_similar(table_of(spark, ids, v), 16, 300, 5, None, cell_rows=300))
    assert got == brute(ids, v, 5)


def test_recall_over_many_cells(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(150, 32)), 20, axis=0) + rng.normal(size=(3000, 32)) * 0.35
    ids = np.arange(3000)
    got = got_of(neighbours.most_similar(table_of(spark, ids, v), 32, 3000, 5, 0.8, cell_rows=150))
    want = brute(ids, v, 5, 0.8)
    pairs = sum(len(x) for x in want.values())
    hit = sum(len(set(got.get(a, [])) & set(x)) for a, x in want.items())
    assert pairs > 5000 and hit / pairs > 0.95


def test_recall_where_blocks_have_cells_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(200, 32)), 20, axis=0) + rng.normal(size=(4000, 32)) * 0.35
    ids = np.arange(4000)
    full = brute(ids, v, 4000, 0.8)
    want = {a: x[:5] for a, x in full.items()}
    pairs = sum(len(x) for x in want.values())
    monkeypatch.setattr(neighbours, "MAX_CELLS", 3)
    for block in (65_536, 1500):
        monkeypatch.setattr(neighbours, "LARGE_BLOCK", block)
        got = got_of(neighbours.most_similar(table_of(spark, ids, v), 32, 4000, 5, 0.8, cell_rows=100))
        assert all(set(x) <= set(full[a]) for a, x in got.items())
        assert sum(len(set(got.get(a, [])) & set(x)) for a, x in want.items()) / pairs > 0.95


@pytest.mark.parametrize("groups", [1, 2])
def test_a_crowd_is_searched_whole_in_a_block_with_cells_of_its_own(groups):
    rng = np.random.default_rng(7)
    unit = neighbours._unit(rng.normal(size=128) + rng.normal(size=(4000, 128)) * 0.23)
    bits = neighbours.bits_of(unit)
    code, rest = bits[:, :128].copy().view(np.int8), bits[:, 128:].copy().view(np.uint16)
    group = np.arange(4000) % groups
    a, b, _ = neighbours.cut_block_best(np.arange(4000), code, rest, group, 5, 0.8, 40, 5)
    cos = unit @ unit.T
    cos[group[:, None] == group if groups == 2 else np.eye(4000, dtype=bool)] = -2
    top = np.argpartition(-cos, 5, axis=1)[:, :5]
    pairs = set(zip(a.tolist(), b.tolist()))
    assert np.mean([(i, int(j)) in pairs for i in range(4000) for j in top[i]]) > 0.999


def test_crowded_centroids_are_one_cell_up_to_a_bound():
    rng = np.random.default_rng(4)
    crowd = neighbours._unit(np.r_[np.ones((400, 16)) + rng.normal(size=(400, 16)) * 0.02, rng.normal(size=(100, 16))])
    root = neighbours.tight(crowd.astype(np.float32), np.full(500, 10.0), 10_000)
    assert len(set(root[:400].tolist())) == 1 and len(set(root[400:].tolist())) > 90
    some = neighbours.tight(crowd.astype(np.float32), np.full(500, 10.0), 1_000)
    assert np.bincount(some[:400]).max() <= 100 and len(set(some[:400].tolist())) == 4


def test_pairs_of_a_cell_are_found_whatever_the_rows(spark, monkeypatch):
    """As many cells twice, of more rows than wanted the second time: the same results."""
    rng = np.random.default_rng(12)
    df = table_of(spark, range(4000), rng.normal(size=(4000, 16)))
    wanted, larger = (got_of(neighbours.most_similar(df, 16, 4000, 5, None, cell_rows=n, max_cells=4)) for n in (1000, 50))
    assert larger == wanted
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    for most in (65_536, 800):  # groups of another size
        monkeypatch.setattr(neighbours, "LARGE_BLOCK", most)
        assert got_of(neighbours.most_similar(df, 16, 4000, 5, None, cell_rows=50, max_cells=4)) == wanted


def test_a_crowd_of_any_size_is_searched_whole(spark, monkeypatch):
    rng = np.random.default_rng(13)
    v = np.r_[np.ones((900, 16)) + rng.normal(size=(900, 16)) * 0.1, rng.normal(size=(100, 16))]
    monkeypatch.setattr(neighbours.tight, "__defaults__", (100,))
    got, want = got_of(neighbours.most_similar(table_of(spark, range(1000), v), 16, 1000, 5, 0.8, cell_rows=20, probes=1)), brute(range(1000), v, 5, 0.8)
    assert all(got[a] == want[a] for a in range(900))


def test_centroids_are_fitted_by_tasks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 8))
    c, mass, sample = neighbours.fitted(table_of(spark, range(3000), v), 8, 3000, 20)
    assert 15 <= len(c) <= 25 and len(sample) == 3000 and 2500 < mass.sum() < 3600
    again = neighbours.fitted(table_of(spark, range(3000), v).repartition(7), 8, 3000, 20)
    assert len(again[0]) == len(c)


def test_a_large_block_without_pairs():
    bits = neighbours.bits_of(neighbours._unit(np.eye(64)))
    code, rest = bits[:, :64].copy().view(np.int8), bits[:, 64:].copy().view(np.uint16)
    assert [len(x) for x in neighbours.cut_block_best(np.arange(64), code, rest, np.zeros(64, int), 5, 0.8, 8, 5)] == [0, 0, 0]


def test_tiles_of_few_rows_find_the_same():
    rng = np.random.default_rng(5)
    x = neighbours.tile_codes(neighbours._unit(np.ones((300, 16)) + rng.normal(size=(300, 16)) * 0.2))
    for at_least in (None, 0.8):
        pairs = [sorted((int(i), int(j)) for a, b in neighbours.tile_candidates(x, x, 5, at_least, True, n) for i, j in zip(a, b)) for n in (1, 10_000, neighbours.TILE)]
        assert pairs[0] == pairs[1] == pairs[2] and pairs[0]


def test_unusable_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, nan]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [2.0, 0.1]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, e array<double>").withColumn("id", F.lit("clash"))
    good = neighbours.usable(df, "k", F.col("e"), 2)
    assert sorted(r.id for r in good.collect()) == [1, 8]
    assert {(r.id, r.other) for r in neighbours.most_similar(good, 2, 9).collect()} == {(1, 8), (8, 1)}
    assert neighbours.most_similar(good.where("id = 1"), 2, 1).count() == 0
    assert neighbours.most_similar(good.limit(0), 2, 0).count() == 0
    read = spark.createDataFrame([(1, "[1, 2]"), (2, "[1, x]"), (3, ""), (4, "[NaN, 1]"), (5, '{"a": 1}'), (6, None), (7, "[1, null]")], "k long, j string")
    assert [r.id for r in neighbours.usable(read, "k", F.from_json("j", "array<double>"), 2).collect()] == [1]


# --- text types -----------------------------------------------------------------------------------------------------

COMMON = quality.Common({"the", "is", "and", "to", "a", "of", "in", "we", "that", "it", "was", "on", "at", "for", "了", "的", "在"})
PROSE = "We went to the harbour in the morning, and it was cold. The boat that we had seen on the way was gone. "
TEXTS = {
    "prose": [PROSE * 1, PROSE.lower().replace(".", "").replace(",", ""), PROSE.upper(), "- We went to the harbour.\n- It was on the way to the boat.\n- That is the end of it."],
    "list": ["- milk\n- bread\n- a lamp\n- soap\n- tea", "milk; bread; lamp; soap; tea; keys; pens", "[ ] to ask Ann about the lamp\n[x] the key for the shed\n[ ] soap\n[ ] tea\n[ ] a map", "lamp: 3\nsoap: 4\ntea: 5\npens: 6"],
    "table": ["a,b,c\n1,2,3\n4,5,6\n7,8,9", "0.1 0.2 0.3\n0.4 0.5 0.6\n0.7 0.8 0.9", "| x | 1 | 2 |\n|---|---|---|\n| y | 3 | 4 |\n| z | 5 | 6 |", "name\tx\ty\nlamp\t1\t2\n\t3\t4\nsoap\t5\t6"],
    "junk": ["ok ok ok ok " * 30, "====\n----\n####\n....", "12:01:02.1 D/Scan(1): rc=5 dt=3ms 0xdeadbeef\n12:01:03.1 D/Scan(1): rc=6 dt=4ms 0xdeadbee0\n" * 3, "xkqzv brtkl pqwsd zzxcv mnbvc lkjhg qwrtp " * 4],
}


def test_statistics_of_a_text():
    s = dict(zip(quality.COLUMNS, quality.statistics("The cat is on 2 mats!\nWe saw it.\n\n", COMMON)))
    assert s["n_words"] == 8 and s["n_lines"] == 2 and s["end_punct_share"] == 1.0
    assert s["mean_word_length"] == pytest.approx(21 / 8) and s["common_share"] == pytest.approx(5 / 8)
    assert s["digit_ratio"] == pytest.approx(1 / 24) and s["symbol_ratio"] == pytest.approx(2 / 24)


def test_em_recovers_types_from_agreements():
    rng = np.random.default_rng(0)
    truth, counts = [], {}
    for _ in range(3000):
        y = int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))
        votes = []
        for _, known in quality.FUNCTIONS:
            name = quality.TYPES[y]
            right = name in known and rng.random() < 0.85
            votes.append(name if right else None if rng.random() < 0.7 else known[rng.integers(len(known))])
        c = quality.pattern(votes)
        assert [known[k] for k, (_, known) in zip(quality.answers_of(c), quality.FUNCTIONS)] == votes
        truth.append((c, y))
        counts[c] = counts.get(c, 0) + 1
    post, tables, shares = quality.learn(counts)
    assert np.mean([post[c].argmax() == y for c, y in truth]) > 0.9
    assert shares[0] == pytest.approx(0.7, abs=0.1) and all(np.allclose(t.sum(1), 1) for t in tables)
    assert quality.learn({})[0] == {}


def test_types_of_texts(spark):
    rows = [(k, t, y) for k, (t, y) in enumerate((t, y) for y, ts in TEXTS.items() for t in ts * 25)]
    rows += [(10_000, None, None), (10_001, "", None), (10_002, " \n ", None)]
    df = spark.createDataFrame(rows, "k long, body string, pattern string").withColumn("doc_id", F.lit("clash"))
    stats = quality.document_statistics(df, "k", "body", COMMON).cache()
    got = {r.doc_id: r for r in quality.typed(stats).collect()}
    assert len(got) == len(rows)
    for k, t, y in rows:
        assert (got[k].text_type == "prose") == (y == "prose") if y else got[k].text_type is None, (t, got[k])
    assert got[10_000].n_words is None and got[10_001].n_words == 0 and got[10_002].mean_word_length == 0.0
    empty = quality.document_statistics(df.limit(0), "k", "body", COMMON)
    assert quality.typed(empty).count() == 0


def test_common_words_table(spark):
    words = spark.createDataFrame([("en", "The"), ("en", "the"), ("zh", "的"), ("xx", None), ("xx", "")], "lang string, word string")
    c = quality.common_words(words)
    assert c.words == {"the"} and c.signs == {"的"}


def test_too_many_common_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "COMMON_WORDS", 2, raising=False)
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert quality.common_words(words("a", "b")).words == {"a", "b"}
    with pytest.raises(ValueError):
        quality.common_words(words("a", "b", "c"))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/doc_labels.parquet"), reason="labelled sample not here")
def test_types_against_the_labelled_sample(spark):
    d = "/root/testdata/sf0.01"
    found = {r.doc_id for r in queries.p8_found(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/doc_labels.parquet").where("doc_kind is not null").collect()
    right = sum((r.doc_id in found) == (r.doc_kind != "prose") for r in labels)
    assert right >= 0.9 * len(labels)  # the marks themselves err
