"""The ten operators against brute force, the libraries and round trips, and on odd inputs."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import LONG, ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import bpe, chat, common, components, credentials, langid, media, minhash, packing, quality, shingles, sketch, suffix, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = {(i, t or "") for i, t, *_ in ODD}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1: suffix-array dedup


def check_report(got, rows, length, passage):
    """Each row's contract columns, and the two of passages, against brute force."""
    want, short = brute.without_repeats(rows, length), brute.without_repeats(rows, passage)
    said = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["passage_bytes"], r["passage_spans"]) for r in got)
    key = [(i, t or "") for i, t in rows]
    assert said == Counter((i, len(t.encode()), *want[i, t][:2], brute.sha(want[i, t][2]), *short[i, t][:2]) for i, t in key)


def test_suffix_removes_what_brute_force_does(spark, some, texts):
    check_report(suffix.dedup_report(some).collect(), list(texts.items()), 400, 250)


@pytest.mark.parametrize("hot", [2, 20_000])
def test_suffix_on_planted_repeats(spark, hot):
    """One passage in many contexts, runs of one byte and a period, equal texts, and anchors dealt over blocks."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    passage, other, short = noise(90), noise(70), noise(50)
    rows = [(i, noise(rng.randrange(80)) + passage[rng.randrange(8) :] + noise(rng.randrange(80)) + (other if i % 3 else "") + (short if i % 4 else "")) for i in range(40)]
    rows += [(100, "a" * 300), (101, "xyz" * 90), (102, passage), (103, passage), (104, "é" * 60), (105, short), (105, short), (106, noise(20)), (107, short + short)]
    check_report(suffix.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string"), 64, 40, hot=hot).collect(), rows, 64, 40)


def test_suffix_counts_repeated_rows(spark):
    """Rows equal in key and text, in text alone, and at 399 and 400 bytes."""
    rng = random.Random(13)
    noise = lambda n: rng.randbytes(n // 2 + 1).hex()[:n]
    one, two, three = noise(700), noise(399), noise(400)
    rows = [(1, one), (1, one), (2, two), (2, two), (3, three), (4, three), (5, noise(900)), (6, noise(30) + two + noise(30)), (None, noise(500))]
    got = suffix.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_report(got, rows, 400, 250)
    assert [r["n_removed"] for r in sorted(got, key=lambda r: r["doc_id"] or 0) if r["doc_id"] in (1, 2, 3, 4, 5)] == [700, 700, 0, 0, 400, 400, 0]


def test_suffix_on_texts_longer_than_a_block(spark, monkeypatch):
    rng = random.Random(5)
    passage = rng.randbytes(30).hex()
    long = "".join(rng.choice("abcdef ghi") for _ in range(5000))
    docs = [(long[:3990] + passage + long[3990:]).encode(), passage.encode() * 2]
    for docs_at_once in (docs, docs[::-1]):
        found = Counter()
        for held in suffix._blocks(docs_at_once, 40):
            joined, bounds = b"".join(p for _, _, p in held), np.cumsum([len(p) for _, _, p in held])
            for a, n, _, _ in zip(*suffix.fragments(np.frombuffer(joined, np.uint8), bounds, 40), strict=True):
                found.update(joined[k : k + 40] for k in range(a, a + n))
        assert found == Counter(d[k : k + 40] for d in docs for k in range(len(d) - 39))


def test_suffix_on_odd_rows(odd, empty):
    check_report(suffix.dedup_report(odd).collect(), [(i, t) for i, t, *_ in ODD], 400, 250)
    assert suffix.dedup_report(empty).count() == 0
    cut = suffix.dedup_text(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD) and cut.where("doc_id = 1 AND text IS NOT NULL").isEmpty()
    assert suffix.dedup_text(empty).count() == 0
    with pytest.raises(ValueError):
        suffix.dedup_report(odd, 40, 50)


# 2: media columns


def test_media_read_back(odd, empty):
    rows = media.media_columns(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in ODD)
    for r in rows:
        data = next(t for i, t in TEXTS if i == r["doc_id"]).encode()
        payload = media.pad(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]))
        whole = media.encode_media(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(whole), brute.sha(whole), brute.feature(payload))
    assert media.media_columns(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_chunks_tile_and_media_round_trip(data):
    assert b"".join(media.chunks_of(data)) == data
    assert media.decode_media(media.encode_media(media.pad(data)))[: len(data)] == data
    with pytest.raises((ValueError, struct.error)):
        media.decode_media(data[:43])


def test_chunks_follow_content():
    body = random.Random(1).randbytes(60_000)
    a, b = set(media.chunks_of(body)), set(media.chunks_of(b"ahead" + body))
    assert len(a & b) >= len(a) - 2 and max(map(len, a)) <= media.MOST
    assert len(set(media.chunks_of(bytes(200_000)))) <= 2


# 3: MinHash near-duplicates


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups_equal_all_pairs(some, texts, words):
    want = brute.near_groups(sorted(texts.items()), words)
    for r in minhash.near_duplicates(some, words).collect():
        i = r["doc_id"]
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[i], len(brute.shingle_set(texts[i], words)), want[i] == i)


def test_large_groups_go_through_blocks(spark, monkeypatch):
    """One text with random edits many times: large buckets, several blocks, links of every strength."""
    monkeypatch.setattr(minhash, "DOCS", 16)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(f"x{i}_{k}" if rng.random() < 0.06 else w for k, w in enumerate(base))) for i in range(80)]
    rows += [(1000 + i, f"apart {i} from all the others number {i}") for i in range(20)]
    want = brute.near_groups(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == want and 1 < len(set(want.values())) < 100


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_large_buckets_of_several_components(spark, monkeypatch, seed):
    """Texts that share half of their words, in families of various sizes and strengths: hubs, then blocks that share a bucket."""
    monkeypatch.setattr(minhash, "DOCS", 12)
    monkeypatch.setattr(minhash, "SMALL", 3)
    rng = random.Random(seed)
    shared, rows = [f"s{k}" for k in range(50)], []
    for f in range(12):
        own = [f"f{f}_{k}" for k in range(rng.randrange(8, 22))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((len(rows), " ".join(f"x{rng.random()}" if rng.random() < 0.03 else w for w in shared + own)))
    rng.shuffle(rows)
    want = brute.near_groups(rows, 1)
    opened = []
    keep = minhash._open_pairs
    monkeypatch.setattr(minhash, "_open_pairs", lambda *x: opened.append(1) or keep(*x))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 1).collect()}
    assert got == want and opened and 1 < len(set(want.values())) < len(rows)


def test_copies_of_a_large_group_grow_with_it(spark, monkeypatch):
    """Every set of a group of near copies of one text is sent about once, whatever the number of blocks."""
    monkeypatch.setattr(minhash, "DOCS", 16)
    rng, sent = random.Random(12), []
    keep = minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda placed, percent: sent.append(placed.count()) or keep(placed, percent))
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(f"x{i}" if k == i % 200 else w for k, w in enumerate(base))) for i in range(200)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert {r["component_id"] for r in got} == {0} and 200 <= sum(sent) < 260


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [np.unique(a[:500]), np.unique(a[100:]), np.unique(a[:3])]
    of = np.repeat(np.arange(4), [len(sets[0]), len(sets[1]), len(sets[2]), 0])
    sig = minhash.signatures(of, np.concatenate(sets), 4, 200)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.12
    assert (sig[3] == np.uint64(2**64 - 1)).all() and (sig[2] >> np.uint64(32)).max() < 200
    # every element offers each slot one rank: one element alone fills the ranks 0 to m - 1
    alone = minhash.signatures(np.zeros(1, np.int64), sets[0][:1], 1, 64)[0] >> np.uint64(32)
    assert sorted(alone.tolist()) == list(range(64))


def test_common_counts_are_intersections():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), np.uint64) for _ in range(30)]
    got = minhash.common_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(set(a.tolist()) & set(b.tolist()))


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd, 2).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and [got[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 6]
    assert got[None]["kept"] and minhash.near_duplicates(empty, 2).count() == 0
    kept = minhash.without_near_duplicates(odd, 2)
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect()), key=str) == sorted([(False, i) for i in (1, 2, 3, 4, 6, 8, 9)] + [(True, None)], key=str)


def test_texts_of_a_key_that_repeats(spark):
    one, two, three = ([f"{k}{i}" for i in range(40)] for k in "abc")
    said = lambda *w: " ".join(w)
    rows = [(1, said(*one)), (5, said(*one, "x")), (5, said(*two)), (5, said(*two)), (5, said(*three)), (7, said(*three, "y")), (8, ""), (8, "!"), (9, said(*one[:9])), (9, said(*one[:9]).upper())]
    kept = minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2)
    got = sorted((r["doc_id"], r["text"].lower()) for r in kept.collect())
    assert got == [(1, said(*one)), (5, said(*two)), (5, said(*three)), (8, ""), (8, "!"), (9, said(*one[:9]))]
    near = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert len(near) == len(rows) and sorted(r["component_id"] for r in near if r["doc_id"] in (1, 5, 7)) == [1, 1, 5, 5, 5, 5]


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    up = components.UnionFind()
    for a, b in pairs:
        up.union(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == dict(up.forest())


@pytest.mark.parametrize("few", [0, components.FEW])
def test_few_links_take_no_rounds(spark, monkeypatch, few):
    """What union-find leaves is merged at once if that is little, else by stars, with equal results."""
    monkeypatch.setattr(components, "FEW", few)
    written, keep = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or keep(df, name))
    pairs = [(k, k + 1) for k in range(300)] + [(900 + k % 7, 1000 + k) for k in range(100)] + [(5, 5)]
    up = components.UnionFind()
    for a, b in pairs:
        up.union(a, b)
    links = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(8)
    assert {r["node"]: r["component"] for r in components.components(links).collect()} == dict(up.forest())
    assert len(written) == 2 if few else len(written) > 3


def test_components_without_links(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (None, None), (3, 3)], "u bigint, v bigint")
    assert components.components(df).count() == 0 and components.components(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\x85éZ", max_size=30), max_size=6), st.integers(1, 5))
def test_shingles_are_those_of_words(raw, k):
    of, hashes = shingles.shingle_sets([t.encode() for t in raw], k)
    assert Counter(of.tolist()) == Counter({i: len(s) for i, t in enumerate(raw) if (s := brute.shingle_set(t, k))})
    named = {}
    for i, t in enumerate(raw):
        for s in (brute.shingle_set(t, k),):
            named.setdefault(s, set(hashes[of == i].tolist()))
            assert named[s] == set(hashes[of == i].tolist())


# 4: packing


def packed_well(rows, want, limit=2048):
    """Pieces tile their documents and fill sequences without gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, pieces in docs.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == want[i]
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= limit
    return sum(want.values()) / (len(sequences) * limit)


def test_packing_tiles_documents(some, texts, library):
    rows = packing.packed_documents(some, PATH).collect()
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    assert packed_well(rows, {i: len(x) for i, x in ids.items()}) > 0.97
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) for r in rows)


def test_packing_of_documents_keeps_all_limits(some, texts, library):
    """Loss-bearing tokens are those after the first line; both other limits hold in every sequence, and that on loss binds."""
    rows, limits = packing.packed_documents(some, PATH).collect(), packing.Limits()
    prompt = {i: len(library.encode(t.split("\n")[0], add_special_tokens=False).ids) if "\n" in t else 0 for i, t in texts.items()}
    sequences = defaultdict(list)
    for r in rows:
        assert r["loss"] == max(0, r["start"] + r["length"] - max(r["start"], prompt[r["doc_id"]]))
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["segment"] for r in own] == list(range(len(own))) and len(own) <= limits.segments
        assert [r["loss_before"] for r in own] == [sum(x["loss"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["loss"] for r in own) <= limits.loss
    assert any(sum(r["loss"] for r in own) > limits.loss - 8 for own in sequences.values())


def test_dot_product_beats_longest_first():
    """Types that crowd one limit are mixed with types that leave it; by length alone they are not."""
    limits = packing.Limits(100, 50, 60, 1000)
    sizes = [(25, 0)] * 60 + [(20, 20)] * 60
    packer = packing.Packer(limits)
    for k, (n, loss) in enumerate(sizes):
        packer.add(packing.Item(k, 0, n, n - loss))
    packer.fill(True)
    assert sorted(x[0].owner for x in packer.done) == list(range(120))
    left, longest = sorted(sizes, reverse=True), 0
    while left:
        room, longest = [100, 60], longest + 1
        for x in list(left):
            if x[0] <= room[0] and x[1] <= room[1]:
                left.remove(x)
                room = [room[0] - x[0], room[1] - x[1]]
    assert len({x[1] for x in packer.done}) == 30 < longest


def test_packing_keeps_all_limits():
    rng, limits = random.Random(9), packing.Limits(100, 5, 40, 4)
    packer, sizes = packing.Packer(limits), {}
    for k in range(400):
        n = rng.randrange(1, 250) if k % 9 == 0 else rng.randrange(1, 60)
        sizes[k] = (n, rng.randrange(n + 1))
        packer.add(packing.Item(k, 0, n, sizes[k][1]))
        if k % 50 == 0:
            packer.fill(False)
    packer.fill(True)
    filled, used = defaultdict(list), Counter()
    for item, sequence, offset, segment, before in packer.done:
        filled[sequence].append((offset, segment, before, item))
        used[item.owner] += item.end - item.start
    assert used == Counter({k: n for k, (n, _) in sizes.items()})
    for rows in filled.values():
        items = [x[3] for x in sorted(rows, key=lambda x: x[0])]
        assert sum(i.end - i.start for i in items) <= 100 and len(items) <= 5 and sum(i.loss() for i in items) <= 40
        assert sorted(x[1] for x in rows) == list(range(len(rows)))


@pytest.mark.parametrize("keep", [0, 7, 10**6])
def test_words_kept_from_slice_to_slice(library, monkeypatch, keep):
    """Ids are the library's whatever is kept; words that are kept are not encoded again."""
    monkeypatch.setattr(tokens, "KEEP", keep)
    own, rng = tokens.Encoder(PATH), random.Random(21)
    words = ["Ab", "c'd", "x9.", "é!", "\u0130x", "a" * 100, "l'été,", "(1,2)", "<|end|>", "\x1c", "日本", "ß"] + [f"w{k}," for k in range(40)]
    for _ in range(12):
        texts = ["", " \n"] + ["\n".join(" ".join(rng.choices(words, k=9)) for _ in range(rng.randrange(1, 4))) for _ in range(6)]
        ids, heads = own.headed(texts)
        for t, x, n in zip(texts, ids, heads, strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            first = t.split("\n")[0] if "\n" in t else ""
            assert np.frombuffer(x, "<u4").tolist() == want and n == len(library.encode(first, add_special_tokens=False).ids)
        assert max(len(own.words.strings), len(own.pieces.strings)) <= keep
    again = []
    monkeypatch.setattr(own, "alone", lambda t: again.append(t) or np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
    monkeypatch.setattr(own, "_pieces", lambda new, keep=own._pieces: again.extend(new.to_pylist()) or keep(new))
    own.headed(texts)
    assert set(again) <= {"a" * 100} if keep > 1000 else again


def test_packing_odd_rows(odd, empty, library):
    rows = packing.packed_documents(odd.where("doc_id <> 5"), PATH).collect()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in TEXTS if i not in (5, None)}
    packed_well(rows, want)
    assert len(packing.packed_documents(odd.where("doc_id = 5"), PATH).collect()) == 2
    assert packing.packed_documents(empty, PATH).count() == 0


# 5: quality classifier


def test_quality_agrees_with_labels(spark, some):
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classified(some).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_estimated_accuracies():
    """Votes drawn from known accuracies are recovered."""
    rng = np.random.default_rng(1)
    n, right = 20_000, np.array([0.95, 0.85, 0.75, 0.9, 0.8, 0.7, 0.88])
    truth = rng.random(n) < 0.8
    correct = rng.random((n, 7)) < right
    vote = np.where(correct == truth[:, None], quality.GOOD, quality.BAD)
    vote[rng.random((n, 7)) < 0.3] = quality.ABSTAIN
    patterns, which, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03 and np.abs(accuracy - right).max() < 0.08
    assert ((posterior[which.ravel()] >= 0.5) == truth).mean() > 0.95


def test_posteriors_equal_those_row_by_row():
    """The estimate over counted patterns is that over single rows, with missing votes left out."""
    rng = random.Random(14)
    rows = [tuple(rng.choice([0, 1, 2, 2, 3]) for _ in range(4)) for _ in range(300)]
    want = brute.posteriors(rows, quality.GUESS.tolist(), quality.TRUST, 20)
    patterns, which, counts = np.unique(np.array(rows), axis=0, return_inverse=True, return_counts=True)
    good, _, share = quality.estimate(patterns, counts.astype(float), 20)
    assert np.abs(good[which.ravel()] - want).max() < 1e-9 and abs(share - np.mean(want)) < 1e-9


def test_no_length_is_a_case_of_its_own(spark):
    """Scores of good and of bad texts of 1 to 60 words change little from one word to the next; marked ones are rejected once votes need no more words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs)
    prose = next(r["text"] for r in docs.orderBy("doc_id").where("lang = 'en' AND n_chars > 600").collect() if quality._scores(model, [r["text"]])[1][0] > 0.9).split()
    marked = [w + "%$#" for w in prose]
    good, bad = (quality._scores(model, [" ".join(x[:n]) for n in range(1, 61)])[1] for x in (prose, marked))
    assert (good >= 0.5).all() and (bad[19:] < 0.5).all()
    assert np.abs(np.diff(good)).max() < 0.25


def test_repeated_rows_are_one_of_the_sample(spark, some, monkeypatch):
    """40 rows, each 500 times: the counts are of 20,000 rows, what is trained on of 40 at most."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").select("doc_id")
    prose = [r["text"] for r in some.join(labels, "doc_id").where("n_chars > 300").orderBy("doc_id").limit(20).collect()]
    assert len(prose) == 20
    rows = list(enumerate(prose + [f"%$# {k} &* !!! @@ ~~ " * 9 for k in range(20)]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").crossJoin(spark.range(500).select())
    sizes, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda grams, dense, target: sizes.append(len(target)) or train(grams, dense, target))
    model = quality.fit(docs, sample=10_000)
    assert 2 <= sizes[0] <= len(rows)
    good, bad = (quality._scores(model, [t for _, t in part])[1] for part in (rows[:20], rows[20:]))
    assert (good >= 0.5).all() and (bad < 0.5).all()


def test_quality_of_odd_rows(odd, empty):
    got = quality.classified(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert quality.classified(empty).count() == 0
    kept = quality.accepted(odd, quality.fit(odd))
    assert kept.columns == odd.columns


# 6: chat formatting


def test_chat_round_trip(spark):
    said = ["", "\\", "\\b", "</turn>", "### user: x</turn>\n", "\\e\\h", "a: b", "é𝄞\n\n"]
    rows = [(k, t, ["user", "assistant", "sys: ### tem"][t % 3], s) for k in range(3) for t, s in enumerate(said[k:] + said[:k])]
    rows += [(9, None, None, None), (9, 1, "user", "x"), (9, 1, "user", "x"), (None, 0, "assistant", "y")]
    got = {r["conv_id"]: r for r in chat.chat_digest(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", s or "") for k, t, role, s in rows if k == c))
        loss = "".join(s for _, role, s in own if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), brute.sha("".join(f"{role}\n{s}\n" for _, role, s in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_sha256"] == brute.sha("\\### Assistant: </turn> ok")
    assert chat.chat_digest(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, extra int")).count() == 1


def test_chat_of_odd_tables(spark):
    """Nulls in every column, a very long text, ties, a repeated row, and extra columns whose names are used inside."""
    rows = [(1, 0, "user", "x " * 200_000), (1, 1, "assistant", "y" * 300_000), (2, None, None, None), (None, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("turns", "formatted", "loss_spans", "asked", "listed"):
        df = df.withColumn(name, F.col("text"))
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, 2: 4, None: 1, -7: 2} and got[1]["loss_chars"] == 300_000
    assert got[2]["turns_sha256"] == brute.sha("\n\nuser\na\nuser\na\nuser\nb\n")


def test_chat_of_a_text_beyond_the_json_parser(spark):
    rows = spark.range(2).selectExpr("1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "repeat('ab', IF(id = 0, 1, 10500000)) AS text")
    rows = rows.unionAll(rows.selectExpr("2L", "turn + 5", "role", "text")).unionAll(spark.sql("SELECT 2L, 9L, 'user', 'x'"))
    got = {r["conv_id"]: r for r in chat.chat_digest(rows).collect()}
    text = "ab" * 10500000
    assert [got[k]["n_turns"] for k in (1, 2)] == [2, 3] and [got[k]["loss_chars"] for k in (1, 2)] == [len(text)] * 2
    assert got[1]["turns_sha256"] == brute.sha(f"user\nab\nassistant\n{text}\n") and got[2]["turns_sha256"] == brute.sha(f"user\nab\nassistant\n{text}\nuser\nx\n")


def test_chat_loss_texts_are_those_at_the_spans(spark):
    turns = [("user", "a: b"), ("assistant", "</turn>\n### assistant: é𝄞\\"), ("assistant", ""), ("x", "y"), ("assistant", "z\n")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn int, role string, text string")
    at = F.transform("loss_spans", lambda s: chat.unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    got = chat.format_turns(df).select(chat.loss_texts(F.col("formatted")).alias("read"), at.alias("at")).first()
    assert got["read"] == got["at"] == [t for r, t in turns if r == "assistant"]


def test_chat_fingerprint_of_a_type_is_that_of_its_records(spark):
    kinds = {chat.ASKED: '{"response":"b","prompt":"a"}', chat.LISTED: '{"messages":[{"role":"user","content":"a"}]}'}
    for kind, record in kinds.items():
        assert spark.range(1).select(chat.typed_fingerprint(kind) == chat.fingerprint(F.parse_json(F.lit(record)))).first()[0]


def test_chat_layouts(spark):
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}': [("user", "a"), ("assistant", "b")],
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': [("user", "a"), ("assistant", "b")],
        '{"chat":{"turns":[{"speaker":"bot","text":"b"}]}}': [("assistant", "b")],
        '{"response":"b","prompt":"a"}': [("user", "a"), ("assistant", "b")],
        '{"instruction":"a","input":"x","output":"b"}': [("user", "a\nx"), ("assistant", "b")],
        '{"prompt":null,"completion":"b"}': [("user", ""), ("assistant", "b")],
        '{"nothing":"known"}': None,
        "no json": None,
        None: None,
    }
    df = spark.createDataFrame([(r,) for r in records], "record string")
    out = chat.format_records(df, "record").withColumn("turns", chat.read_turns(F.col("formatted")))
    for r in out.collect():
        want = records[r["record"]]
        assert (r["turns"] and [(t["role"], t["text"]) for t in r["turns"]]) == want
        if want:
            assert "".join(r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]) == "".join(t for role, t in want if role == "assistant")


# 7: fingerprints


def check_fingerprints(rows, order):
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = next(r for r in got[i] if r["edited_sha256"] == brute.sha(edited))
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b, c = (sketch.sketches([x.encode()])[0][0] for x in (t, edited, nxt))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a, b)
        assert r["near_edited"] == sketch.containment(a, b) and r["near_next"] == sketch.containment(a, c)


def test_fingerprints_of_documents_and_followers(some, texts):
    check_fingerprints(sketch.compared_with_next(some).collect(), sorted(texts.items()))


def test_fingerprints_of_odd_rows(odd, empty):
    order = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    check_fingerprints(sketch.compared_with_next(odd).collect(), order)
    assert sketch.compared_with_next(empty).count() == 0
    one = sketch.compared_with_next(odd.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_likeness_estimates_exact_containment(some, texts):
    """Against sets of all five-word shingles: within four standard errors of a quarter of the smaller set."""
    order = sorted(texts.items())
    got = by_id(sketch.compared_with_next(some))
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        for other, near in ((t[: len(t) - half] + nxt[:half], got[i]["near_edited"]), (nxt, got[i]["near_next"])):
            n = min(len(brute.shingle_set(t, 5)), len(brute.shingle_set(other, 5)))
            if t == other:
                assert near == 1
            elif n:
                assert abs(near - brute.containment(t, other)) <= 4 / n**0.5 or n < 30


def test_containment_of_unequal_documents():
    rng = random.Random(11)
    text = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    a, b, c = ((" ".join(x)).encode() for x in (text, text[:800], [f"v{k}" for k in range(900)]))
    (fa, ha), (fb, hb), (fc, _) = sketch.sketches([a, b, c])
    assert sketch.containment(fa, fb) > 0.97 and sketch.containment(fa, fc) == 0
    assert sketch.parse(fa)[3].tolist() == ha.tolist()
    merged = np.union1d(ha, hb)
    assert len(merged) >= len(ha)


# 8: BPE


TRICKY = ["", " ", "don't<|endoftext|>x", "ABC  def ghi", "a\x1cb", "ﬁ Å x́", " end", "x" * 3000, "ab " * 900, "日本語 テスト。" * 90, "1234 5.6%"]


def test_bpe_equals_the_library(spark, some, texts, library):
    rows = dict(enumerate(TRICKY, 10_000)) | texts
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    for r in bpe.encode_documents(df, PATH, keep_ids=True).collect():
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids"] == np.array(ids, "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=400), st.lists(st.integers(0, 400), max_size=6))
def test_joins_are_repaired_at_any_cut(text, cuts):
    own = tokens.encoder(PATH)
    known = bpe.Chunks(own)
    data = text.encode(errors="ignore").decode()
    at = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    parts = [data[a:b].encode() for a, b in zip(at, at[1:], strict=False)]
    known.learn({bpe.digest(p): p for p in parts})
    joined = bpe.Joiner(own.alone)
    for p in parts:
        joined.add(*known.known[bpe.digest(p)])
    assert joined.ids().tobytes() == own.alone(data)


def test_bpe_of_odd_rows(odd, empty, library):
    rows = bpe.encode_documents(odd, PATH).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in ODD)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in TEXTS}
    assert all(r["n_tokens"] == want[r["doc_id"]] for r in rows)
    assert bpe.encode_documents(empty, PATH).count() == 0


def test_encoder_equals_the_library(texts, library):
    own = tokens.encoder(PATH)
    some = [*texts.values(), *TRICKY]
    assert list(own.texts(some)) == [own.alone(t) for t in some]
    assert list(own.texts([])) == [] and list(own.texts(["", " "])) == [b"", b""]
    assert list(own.texts(TRICKY[::-1][:3])) == [own.alone(t) for t in TRICKY[::-1][:3]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_encoder_on_any_text(raw):
    own = tokens.encoder(PATH)
    assert list(own.texts(raw)) == [own.alone(t) for t in raw]


# 9: language


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict_held_out(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    sure = [r for r in held if r["confident"]]
    assert len(sure) > 0.9 * len(held) and sum(r["lang"] == r["lang_pred"] for r in sure) / len(sure) > 0.985


def test_language_equals_a_plain_loop(some, texts):
    own = langid.fit(some)
    odd_texts = {-1: None, -2: "", -3: "123 !?", -4: "É"}
    df = some.select("doc_id", "text").unionAll(some.sparkSession.createDataFrame(list(odd_texts.items()), "doc_id bigint, text string"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, own).collect()} == {i: brute.language(t, own, langid.LEVEL) for i, t in (texts | odd_texts).items()}


def test_language_sample_of_copies(spark):
    some = "the quick brown fox jumps over the lazy dog number"
    de = spark.range(10000).selectExpr("'der schnelle braune fuchs springt immer wieder' AS text", "'de' AS lang")
    en = spark.range(400).selectExpr(f"concat('{some} x', translate(string(id), '0123456789', 'abcdefghij')) AS text", "'en' AS lang")
    en = en.unionAll(spark.range(40000).selectExpr(f"'{some}' AS text", "'en' AS lang"))
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "content", lambda texts, size: seen.setdefault(len(texts), texts) and b" ")
        langid.fit(de.unionAll(en).repartition(4))
    assert sorted(seen) == [1, langid.ROWS] and seen[1] == ["der schnelle braune fuchs springt immer wieder"]
    assert len(set(seen[langid.ROWS])) == langid.ROWS


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", 2)
    rows = [("alpha beta gamma delta", "a"), ("uno dos tres cuatro", "b"), ("eins zwei drei vier", "c"), ("un deux trois quatre", "d")]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id bigint, text string, lang string")
    own = langid.fit(df, rows=4, size=600)
    assert sorted(own) == ["a", "b", "c", "d"] and all(len(d) <= 320 for d in own.values())
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, own).collect()} == {i: k for i, (_, k) in enumerate(rows)}


def test_language_of_odd_rows(odd, empty):
    rows = langid.predict_held_out(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["lang_pred"] for r in rows}[1] == "und"
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (2, 3)] == ["und", "und"]
    assert langid.predict_held_out(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


# 10: secrets


def test_base_spans_equal_plain_regexes(spark, some, texts):
    rows = dict(texts) | {9000: "TOKEN=abcdef token: 'x' token = " + "g" * 9, 9001: "AKIAAKIA" + "Z" * 12 + " AKIA1", 9002: "0" * 23 + "x" + "0" * 24, 9003: "é API_KEY\"  :  \"abc.def", 9004: "ſecret=abcdefgh toKen=abcdefgh"}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    for r in credentials.secret_digest(df).collect():
        base = brute.base_secrets(rows[r["doc_id"]])
        kinds = Counter(x.split(":")[0] for x in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds[k] for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == brute.sha(",".join(base))
        assert set(base) <= set(r["spans"].split(",")) or not base


def test_weak_parts_need_each_other():
    key = "Zx9Qw8Er7Ty6Ui5Op4Aa"
    kinds = lambda t: [credentials.KINDS[k] for _, k, _ in credentials.spans_of(t)]
    assert kinds(f"user: alice {key}") == ["id", "key"]
    assert kinds("user: alice and no more") == [] and kinds(f"just {key}") == []
    assert kinds(f"user: alice {'far ' * 100}{key}") == []
    assert kinds(f"{key} at https://example.org/x") == ["key", "endpoint"]
    assert kinds("user: alice at https://example.org/x") == []
    assert kinds("login = bob, password = hunter22") == ["id", "assign"]


def test_parts_that_the_base_drops_are_linked():
    """Planted pairs, and near misses: a part alone, one code point out of reach, and values that are no code."""
    kinds = lambda t: [credentials.KINDS[k] for _, k, _ in credentials.spans_of(t)]
    assert kinds("token = abc1 for ann@mail.example.com") == ["key", "id"] and kinds("token = abc1 and no more") == []
    assert kinds("AKIAABC123 with 0a1b2c3d4e5f") == ["id", "key"] and kinds("AKIAABC123") == [] and kinds("0a1b2c3d4e5f") == []
    assert kinds("0a1b2c3d4e5f at 10.0.0.17") == ["key", "endpoint"] and kinds("0a1b2c3d4e5f at 10.0.0.256") == []
    assert kinds("9807915762804490 at 10.0.0.17") == [] and kinds("deadbeefdeadbeef at 10.0.0.17") == []
    token = "token = 04dbebab91ab8568"
    assert kinds(token + " " * 200 + "ann@mail.example.com") == ["assign", "id"] and kinds(token + " " * 201 + "ann@mail.example.com") == ["assign"]
    assert kinds("ann@mail.example.com" + " " * 200 + token) == ["id", "assign"] and kinds("ann@mail.example.com" + " " * 201 + token) == ["assign"]
    assert kinds("10.1.2.3 ann@mail.example.com") == [] and kinds("z" * 100_000 + "@") == []


def test_links_join_the_nearest_parts():
    text = "a@x.org b@x.org token = 04dbebab91ab8568 c@x.org 10.0.0.1" + " " * 300 + "secret = abcdefgh" + " " * 300 + "token = 0123456 10.0.0.2"
    said = [[x and text[x[0] : x[2]] for x in g] for g in credentials.groups(credentials.spans_of(text))]
    assert said == [["token = 04dbebab91ab8568", "b@x.org", "10.0.0.1"], ["token = 0123456", None, "10.0.0.2"]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 5), st.integers(1, 30)), max_size=25), st.integers(0, 60))
def test_groups_equal_all_pairs(raw, reach):
    spans = sorted({(s, k, s + n) for s, k, n in raw})
    part = lambda p: [x for x in spans if credentials.PART[credentials.KINDS[x[1]]] == p]
    gap = lambda a, b: max(0, b[0] - a[2], a[0] - b[2])
    least = lambda a, p: min((gap(a, x) for x in part(p) if gap(a, x) <= reach), default=None)
    outer = [a for a in part("key") if not any(b != a and b[0] <= a[0] and a[2] <= b[2] and (b[0], b[2]) != (a[0], a[2]) for b in part("key"))]
    want = {(a[0], a[2]): (least(a, "id"), least(a, "endpoint")) for a in outer}
    got = {(s[0], s[2]): (i and gap(s, i), e and gap(s, e)) for s, i, e in credentials.groups(spans, reach)}
    assert got == {k: v for k, v in want.items() if v != (None, None)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 5), st.integers(1, 30)), max_size=25), st.integers(0, 60))
def test_linking_equals_all_pairs(raw, reach):
    spans = sorted({(s, k, s + n) for s, k, n in raw})
    base, candidates = [x for x in spans if x[1] < 3], [x for x in spans if x[1] >= 3]
    part = lambda x: credentials.PART[credentials.KINDS[x[1]]]
    near = lambda a, b: b[0] <= a[2] + reach and b[2] >= a[0] - reach
    want = [c for c in candidates if any(part(x) in credentials.NEEDS[credentials.KINDS[c[1]]] and near(c, x) for x in spans)]
    assert credentials.link(base, candidates, reach) == want


def test_documents_hold_linked_parts(spark):
    """Over all documents some secrets stand near an identifier or endpoint, whose spans are reported beside the base."""
    rows = credentials.secret_digest(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("n_links > 0").collect()
    assert len(rows) > 5 and all(r["n_links"] == len(r["links"].split(",")) and ("id:" in r["spans"] or "endpoint:" in r["spans"]) for r in rows)


def test_secrets_of_odd_rows(odd, empty):
    rows = credentials.secret_digest(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and got[9]["n_assign"] == 1 and got[9]["n_access"] == 1 and got[1]["spans"] == ""
    assert credentials.secret_digest(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in credentials.redact(odd).collect()}
    assert clean[9] == "[REDACTED]' and [REDACTED]" and clean[1] is None and clean[6] == LONG


def test_cuts_and_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 50, 1, 1, 100)])], names=["text"])
    assert [b.num_rows for b in common.slices(iter([batch]), most=52)] == [1, 3, 1]
    assert common.cuts(b"", 4, 2, 9) == [] and common.cuts(b"abc", 4, 2, 9) == [3]
