"""Document operators against brute force, on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import mixing, packing, simhash, substring_dedup, toxicity

from .helpers import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, awkward()).withColumn("kept", F.lit("clash")).withColumn("d", F.lit(1)).withColumn("score", F.lit("s")).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


# ---------------------------------------------------------------- substring dedup


def brute_repeats(texts, window=35):
    lists = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [35, 40, 16])
def test_repeats_match_brute_force(docs, window):
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows], window)))
    got = substring_dedup.remove_repeats(docs, window=window, carry=["lang"])
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == expected


@pytest.mark.parametrize("group_rows", [8, 1])
def test_repeats_split_crowded_prefixes(spark, docs, group_rows):
    rows = docs.select("doc_id", "text").collect()
    expected = sorted(x[1] for x in brute_repeats([r["text"] for r in rows]))
    got = substring_dedup.remove_repeats(docs, digest=True, group_rows=group_rows)
    assert sorted(r["n_removed"] for r in got.collect()) == expected
    one = got.filter("doc_id = 2").first()
    assert one["kept"] == hashlib.sha256(b"").hexdigest()


def test_repeats_compare_words_not_weak_hashes(spark):
    """Thue-Morse words collide under any polynomial modulo a power of two."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"w{i}" for i in range(34))
    texts = [f"{common} {morse}", f"{common} {other}", f"x {common} {morse[:700]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0, 0]
    twice = docs.unionByName(docs.filter("doc_id = 0"))
    assert sorted(r["n_removed"] for r in substring_dedup.remove_repeats(twice).collect()) == [0, 0, 35, 35]


def test_repeats_of_many_null_ids(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(36)), lambda i: F.concat(F.col("id"), F.lit("_"), i)))
    docs = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 40_000 == 7, "same " * 36).otherwise(text).alias("text"))
    got = substring_dedup.remove_repeats(docs).groupBy("n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(37, 0, 199_995), (36, 36, 5)}


def test_suffix_trees_cut_at_full_depth():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 2, rng.integers(1, 30))) for _ in range(40)]
    weights = rng.integers(1, 3, 40).astype(float)
    for depth in (3, 5, 8, 11):
        tree = substring_dedup.SuffixTree(texts, depth)
        split = [t.split() for t in texts]
        seen = Counter()
        for w, n in zip(split, weights):
            for i in range(len(w) - depth + 1):
                seen[tuple(w[i : i + depth])] += n
        expected = [(r, i) for r, w in enumerate(split) for i in range(len(w) - depth + 1) if seen[tuple(w[i : i + depth])] >= 2]
        at = tree.repeats(weights)
        assert [(tree.row[x], x - tree.first[tree.row[x]]) for x in at] == expected
        # Neighbours in order share what the longest common prefixes say.
        shared = tree.common_prefixes()
        for k in range(1, len(tree.start)):
            x, y = (split[tree.row[i]][i - tree.first[tree.row[i]] :] for i in tree.start[k - 1 : k + 1])
            true = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert shared[k] == true or shared[k] >= depth


def test_repeats_of_common_lines_with_other_words(spark):
    """A shared line in many contexts, and periodic texts within one document."""
    rng = np.random.default_rng(1)
    line = " ".join(f"l{i}" for i in range(30))
    texts = [" ".join(f"a{rng.integers(9)}" for _ in range(rng.integers(0, 40))) + f" {line} " + " ".join(f"b{rng.integers(3)}" for _ in range(rng.integers(0, 40))) for _ in range(120)]
    texts += ["x y z " * 40, "q " * 36, "q " * 35, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def test_repeats_of_nothing(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0


# ---------------------------------------------------------------- simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    linked = [(a, b) for i, (a, x) in enumerate(prints) for b, y in prints[:i] if (x ^ y).bit_count() <= 4]
    comp = brute_components({a for a, _ in prints}, linked)
    got = simhash.simhash_components(docs).collect()
    assert sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == sorted((a, x, comp[a]) for a, x in prints)


def test_simhash_links_all_pairs_of_random_and_clustered_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(x) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), False))) for x in base for _ in range(12)]
    prints = sorted(set(near))
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)]
    linked = [(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints[:i]) if (x ^ y).bit_count() <= 4]
    comp = brute_components(range(len(prints)), linked)
    # Whole buckets, values cut into tiles, and wider partitions for more fingerprints.
    for side, bucket, parts in ((4096, 40_000, None), (4, 50, 4), (4, 50, 3), (4096, 40_000, 2)):
        links = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long, rep long"), side=side, rows_per_bucket=bucket, parts=parts)
        got = brute_components(range(len(prints)), [(r["u"], r["v"]) for r in links.collect()])
        assert got == comp


def test_partitions_by_the_number_of_fingerprints():
    assert [simhash.choose_parts(n, 4) for n in (1_000, 10**6, 10**8, 10**11)] == [4, 4, 3, 2]
    assert [sum(simhash.widths(p)) for p in (1, 2, 3, 4)] == [64] * 4 and simhash.choose_parts(10, 0) == 1
    hist = np.random.default_rng(0).poisson(0.3, 1 << 16)
    exact, wide = simhash.ball_counts(hist, 3), simhash.ball_counts(hist, 3, 21)
    assert exact[0].sum() == hist.sum() and np.isclose(exact[1].sum(), 17 * hist.sum())
    assert np.isclose(wide[1].sum(), hist.sum() * (1 + 21) / 32)


def test_thresholds_by_dynamic_programming():
    rng = np.random.default_rng(0)
    costs = np.cumsum(rng.random((50, 4, 5)) * 10, axis=2)
    got = simhash.allocate(costs, 1)
    assert (got.sum(axis=1) == 1).all() and got.min() >= -1
    from itertools import product

    for c, t in zip(costs, got):
        price = lambda x, c=c: sum(c[i, k] for i, k in enumerate(x) if k >= 0)
        best = min(price(x) for x in product(range(-1, 5), repeat=4) if sum(x) == 1)
        assert abs(price(t) - best) < 1e-9


def test_simhash_of_nulls_and_nothing(spark, nothing):
    assert simhash.simhash_components(nothing).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (3, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()} == {(None, None), (2, 2), (3, 3)}


# ---------------------------------------------------------------- packing


def test_packing_round_trip(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(docs).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 2048) + 1


def test_packing_plans_fill_sequences():
    rng = np.random.default_rng(5)
    for n, low, high in ((3000, 1, 2048), (500, 900, 1100), (50, 2000, 2048), (2000, 1, 100)):
        counts = np.bincount(rng.integers(low, high + 1, n), minlength=2049)
        for small in (1024, 682, 128):
            plan, bins = packing.plan_packing(counts, small=small)
            assert (np.bincount(plan[:, 0], plan[:, 2], 2049) == counts).all()
            full = np.zeros(bins)
            for length, _, k, first, offset in plan[np.argsort(plan[:, 4], kind="stable")]:
                assert (full[first : first + k] == offset).all()
                full[first : first + k] += length
            assert full.max() <= 2048 and full.min() > 0
            # No more than first fit needs: all but one sequence are over half full.
            assert bins <= 2 * -(-int((counts * np.arange(2049)).sum()) // 2048) + 1


def test_packing_optimises_configurations_of_several_pieces():
    counts = np.zeros(2049, np.int64)
    counts[900], counts[574] = 3_000, 6_000  # 900 + 574 + 574 fill a sequence; best fit needs 3,500
    plan, bins = packing.plan_packing(counts)
    assert (np.bincount(plan[:, 0], plan[:, 2], 2049) == counts).all()
    assert packing.least_sequences(counts) == 3_000 <= bins <= 3_010
    rng = np.random.default_rng(1)
    for low, high in ((300, 1000), (1, 2048)):
        counts = np.bincount(rng.integers(low, high + 1, 5_000), minlength=2049)
        assert packing.plan_packing(counts)[1] <= min(packing.plan_packing(counts, small=s)[1] for s in (1024, 682, 64))


def test_packing_configurations_hold_several_pieces():
    rng = np.random.default_rng(9)
    counts = np.bincount(np.minimum(2048, rng.lognormal(5.5, 1.2, 6_000).astype(int) + 1), minlength=2049)
    sizes, demand = packing.group_sizes(counts, 682, 96)
    assert demand.sum() == counts[683:2048].sum() and (np.diff(sizes) < 0).all()
    found = packing.optimise_configurations(sizes, demand, 2048)
    assert sum(n for p, n in found if p.sum() > 1) > 20 and all(p @ sizes <= 2048 for p, _ in found)
    assert packing.plan_packing(counts, small=682)[1] == packing.least_sequences(counts)


def fewest_sequences(lengths, capacity):
    """By trying everything."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_packing_is_near_the_optimum_on_small_inputs():
    rng, over = np.random.default_rng(11), 0
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        least = fewest_sequences(lengths, 20)
        got = packing.plan_packing(np.bincount(lengths, minlength=21), capacity=20)[1]
        assert least <= got <= least + 1
        over += got > least
    assert over <= 3


def test_packing_of_awkward_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, "c"), (2, None), (3, "long " * 9_000)]
    docs = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], "doc_id long, text string, piece int, start string, offset int")
    got = packing.pack(docs).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter([None, None, 1, 1, 2, 3])
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 9_001 and sum(r["length"] for r in got if r["doc_id"] == 2) == 1
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_encoder_equals_the_tokenizer():
    enc = packing.WordEncoder(most=1_000)
    for text in ["", "  ", "Été 0.9593 don't I'LL 's ''s <|endoftext|>x", "áb ΑΣ İ", "日本123½", "a\x00b\x1cc\x7f\x85d\xa0e", "ßÿ×÷µª", "a\x0bb\x0cc"]:
        assert enc.encode(text) == enc._whole(text)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_meets_targets(docs):
    got = mixing.taken_words(docs, block_words=64).collect()
    assert len(got) == docs.count()
    sizes, taken, targets = Counter(), Counter(), {}
    text = Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"]) for r in got) == text
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, t in brute_targets(dict(sizes)).items():
        assert targets[s] == pytest.approx(t)
        assert t - 1 <= taken[s] <= t
    again = mixing.taken_words(docs, block_words=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_schedule_is_low_discrepancy(spark):
    shares = spark.createDataFrame([("a", 60_000, 1, 5, 30_000.0, 0), ("b", 60_000, 2, 2, 12_000.0, 0), ("c", 60_000, 3, 1, 6_000.0, 1)], "source string, source_size long, position int, weight int, target double, _part int")
    slots = sorted((r["slot"], r["position"], r["rank"]) for r in mixing.schedule(shares, 100).collect())
    assert len(slots) == 480
    for p, share in ((1, 300 / 480), (2, 120 / 480), (3, 60 / 480)):
        for n in (50, 100, 200, 400):
            assert abs(sum(x == p for _, x, _ in slots[:n]) - share * n) <= 4
        assert [k for _, x, k in slots if x == p] == list(range(round(480 * share)))


def test_targets_of_many_sources_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing.in_order, "__defaults__", (40,))
    rng = np.random.default_rng(2)
    sizes = {f"s{i}é" if i % 7 else f"Z{i}": int(rng.integers(0, 10 ** rng.integers(1, 6))) for i in range(300)} | {None: 500, "": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r for r in mixing.source_targets(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [got[s]["position"] for s in order] == list(range(1, 303)) and len({r["_part"] for r in got.values()}) > 3
    for s, t in brute_targets(sizes).items():
        assert got[s]["target"] == pytest.approx(t)


def test_mix_takes_by_its_slots(docs):
    """Slots of each source are ranks of golden-ratio points; blocks follow them."""
    _, pieces = mixing.mix(docs, block_words=64)
    rows = pieces.collect()
    by = defaultdict(int)
    for r in rows:
        by[r["position"], r["slot"]] += r["words"]
    assert max(by.values()) <= 64
    firsts = {r["doc_id"]: r["first_slot"] for r in mixing.taken_words(docs, block_words=64).collect() if r["taken"]}
    assert all(min(r["slot"] for r in rows if r["doc_id"] == d) <= s for d, s in firsts.items())


def test_running_offsets_of_hot_groups_in_ranges(spark):
    from folioscope.llm.common import running_offsets

    rows = [(i, "hot" if i % 3 else None, i % 5) for i in range(2_000)]
    df = spark.createDataFrame(rows, "i long, g string, a long")
    got = running_offsets(df, "g", [F.xxhash64("i"), F.col("i")], F.col("a"), "at", rows_per_bucket=7, buckets_per_range=5).withColumn("h", F.xxhash64("i")).collect()
    for g in ("hot", None):
        at = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["h"], r["i"])):
            assert r["at"] == at
            at += r["a"]


def test_mix_of_nothing_and_of_blanks(spark, nothing):
    assert mixing.taken_words(nothing).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"], r["taken"], r["target"]) for r in mixing.taken_words(docs).collect()} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}


# ---------------------------------------------------------------- toxicity


def corpus_channel(vocabulary, seed=0):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(vocabulary, 40)) + "." for _ in range(300)]
    return toxicity.Channel(toxicity.log_model(sum(toxicity.run_counts(t) for t in texts)))


ORDINARY = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
ABUSE = "idiot stupid clown loser moron worthless pathetic trash".split()


def test_deobfuscation():
    channel = corpus_channel(ORDINARY + ABUSE)
    for word, shown in (("idiot", "1d10t"), ("idiot", "id1ot"), ("stupid", "s.t.u.p.i.d"), ("clown", "cloooown"), ("stupid", "$tup1d"), ("loser", "l0$er"), ("moron", "m-o-r-o-n"), ("pathetic", "p4thet1c"), ("idiot", "iiiidddiiiooottt"), ("trash", "tr@sh")):
        assert channel.decode(shown) == word, shown
    assert channel.deobfuscate("You i d i o t there") == "you idiot there"
    assert channel.deobfuscate("what a c l o w n you are") == "what a clown you are"
    assert channel.restore("hello!") == ["hello"] and channel.restore("stupid$$$") == ["stupid"] and channel.restore("--") == []
    assert channel.restore("idiot.the") == ["idiot", "the"]
    # Of any length: letters repeated a thousand times, long runs of spaced-out words.
    assert channel.decode("m" * 1000 + "o" * 1000 + "ron") == "moron"
    run = " ".join("people know that the little idiot" .replace(" ", "") * 3)
    assert "idiot" in channel.deobfuscate(run).split()


def test_character_model_keeps_scripts_apart():
    counts = toxicity.run_counts("приве́т 日本 été").reshape((28,) * 4)
    assert counts.sum() == len("приве́т 日本 été") - 3
    assert counts[27, 27, 27, 27] == 2 and counts[:, :, 0, 27].sum() == 2  # the accent and the space end runs
    assert counts[27, 0, 5, 20] == 1 and toxicity.run_counts("").sum() == 0


def test_disguises_unseen_in_training_are_caught(spark):
    """Plain abuse is learned; held-out rows hold leetspeak, marks, repeats and spacing."""
    rng = np.random.default_rng(5)
    leet = str.maketrans("oiestb", "01357" + "8")
    disguises = [lambda w: w.translate(leet), ".".join, lambda w: "".join(c * 3 for c in w), " ".join, lambda w: w[0] + "".join(f"-{c}" for c in w[1:])]
    rows, labels, shown = [], [], {}
    for i in range(1_500):
        body, bad = list(rng.choice(ORDINARY, 30)), i % 3 == 0
        if bad:
            word = str(rng.choice(ABUSE))
            if toxicity.held_out(i):
                shown[i] = i
                word = disguises[int(rng.integers(5))](word)
            body[int(rng.integers(30))] = word
        rows.append((i, " ".join(body), "s"))
        labels.append((i, None, int(bad)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(documents(spark, rows), marks).filter("held_out").collect()
    caught = [r["predicted"] for r in found if r["doc_id"] in shown]
    assert len(caught) > 60 and np.mean(caught) >= 0.9
    assert np.mean([r["predicted"] for r in found if r["doc_id"] not in shown]) < 0.02
    model = toxicity.train(documents(spark, rows), marks)
    plain = model.scorer()
    blind = [f for f in (set(t.split()) for i, t, _ in rows if i in shown) if any(model.number.get(f"={w}") is not None and model.weights[model.number[f"={w}"]] > 1 for w in f)]
    assert len(blind) < 0.1 * len(caught)  # without decoding no word of theirs is known
    assert plain("") == plain(None)


def test_toxicity_learns_and_ignores_held_out_labels(spark, nothing):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        body = [f"word{rng.integers(200)}" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            body[int(rng.integers(30))] = "vileword" if i % 8 else "v1lew0rd"
        rows.append((i, " ".join(body), "s"))
        wrong = toxicity.held_out(i)
        labels.append((i, None, int(bad) ^ int(wrong)))
    rows += [(1000, None, "s"), (1001, "", "s")]
    docs = documents(spark, rows).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (2000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["score"] == got[1001]["score"]
    right = [got[i]["predicted"] == int(i % 4 == 0) for i in range(400)]
    assert np.mean(right) > 0.97
    held = [got[i]["predicted"] == int(i % 4 == 0) for i in range(400) if got[i]["held_out"]]
    assert np.mean(held) > 0.95 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0
    assert toxicity.score_toxicity(docs.filter("doc_id < 5"), marks.limit(0)).filter("predicted = 1").count() == 0
