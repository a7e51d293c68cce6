"""Operators against brute force, exact round trips and held-out accuracy on small inputs."""

import base64
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, decontamination, edits, graph, html, language, quality, queries, secrets, simhash, substrings, text, toxicity
from corpusloom.llm.common import table


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def texts_of(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


# text kit


def test_words_and_windows():
    w = text.words_of("Hello, ÉCOLE école HELLO".encode())
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] and len(w.hash) == 4
    column = pa.array(["ab cd", None, "", "cd", "xy" * 10])
    chunk = next(text.chunks(column))
    own = text.words(chunk)
    assert own.first.tolist() == [0, 2, 2, 2, 3, 4] and own.hash[1] == own.hash[2]
    hashes = np.arange(20, dtype=np.uint64)
    assert text.windows(np.concatenate([hashes, hashes]), 5)[3] == text.windows(np.concatenate([hashes, hashes]), 5)[23]


# 1


def brute_guesses(value, repeats=True):
    """The least cost by the definitions: every span of every kind is priced by hand, every segmentation tried."""
    n, low = len(value), value.lower()
    classes = 10 * any(c.isdecimal() for c in value)
    for own, few in (([c for c in value if c.islower()], "abcdef"), ([c for c in value if c.isupper()], "ABCDEF")):
        if own:
            classes += 6 if n >= 8 and set(own) <= set(few) else 26
    classes += 33 * any(not c.isalnum() for c in value)
    each = math.log10(max(classes, 10))
    keys = [secrets._SHIFTED.get(c, c) for c in low]
    ranks = {w: i for i, w in reversed(list(enumerate(secrets.COMMON.words, 1)))}
    price = {}

    def offer(i, j, cost):
        price[i, j] = min(price.get((i, j), math.inf), cost)

    for i, j in itertools.combinations(range(n + 1), 2):
        part, small = value[i:j], low[i:j]
        offer(i, j, each * (j - i))
        for plain, extra in ((small, 0), (small.translate(secrets._SWAPS), math.log10(2)), (small[::-1], math.log10(2))):
            if plain in ranks and (extra == 0 or plain != small or small == small[::-1]):
                offer(i, j, math.log10(ranks[plain] + 1) + extra + secrets._case_cost(part))
        if j - i in (4, 6, 7, 8, 9, 10) and part[0].isdecimal() and part[-1].isdecimal() and secrets._date_cost(part) is not None:
            offer(i, j, secrets._date_cost(part))
        steps = {ord(b) - ord(a) for a, b in itertools.pairwise(part)}
        if j - i >= 3 and len(steps) == 1 and abs(min(steps)) in (1, 2):
            offer(i, j, math.log10((4 if part[0] in "aA01zZ9" else 26) * (j - i) * (1 if steps == {1} else 2)))
        ways = [secrets._beside(a, b) for a, b in itertools.pairwise(keys[i:j])]
        if j - i >= 4 and all(ways):
            offer(i, j, math.log10(47 * (j - i)) + (1 + sum(a != b for a, b in itertools.pairwise(ways))) * math.log10(4.6))
        for p in range(1, (j - i) // 2 + 1 if repeats else 0):
            unit = part[:p]
            if (j - i) % p == 0 and unit * ((j - i) // p) == part and j - i >= 3 and (unit + unit).find(unit, 1) == p:
                offer(i, j, brute_guesses(unit, False) + math.log10((j - i) // p))
    best = [0.0]
    for j in range(1, n + 1):
        best.append(min(best[i] + price[i, j] for i in range(j)))
    return best[n]


def test_guess_cost_is_the_least_over_all_segmentations():
    rng = random.Random(3)
    values = ["love2024", "qwerty!", "xK9mP2", "dragon99", "abcd7", "p4ssword", "Zz-1999", "passwordwordword", "cabcabc", "aaaaaaa", "hahahaha!", "qwertyqwerty12", "zyxwvu1357", "drowssap", "12/04/1998x", "asdfvcxzasdf", "1q2w3e4r", "DRAGONdragon", "acegikm", "abababcabababc"]
    for _ in range(150):
        values.append("".join(rng.choice(["abc", "123", "qwer", "love", "pass", "xx", "1999", "zx", "Q", "7", "!", "tset", "ab", "fdsa"]) for _ in range(rng.randrange(1, 6))))
    for value in values:
        got, cut = secrets.guess_cost(value)
        assert math.isclose(got, brute_guesses(value), abs_tol=1e-9), value
        assert [i for i, _, _ in cut] == [0, *(j for _, j, _ in cut[:-1])] and cut[-1][1] == len(value)
    assert secrets.guess_cost("9233a8ecf7c5b09fe5949719b6b82bc439e9329b", secrets.dictionary())[0] > 30
    assert secrets.guess_cost("password123")[0] < 3
    assert secrets.guess_cost("abcabcabcabc")[0] < 3
    assert secrets.guess_cost("qwertyuiop")[1] == [(0, 10, "keyboard")]
    assert secrets.guess_cost("12/04/1998")[1] == [(0, 10, "date")]
    assert secrets.guess_cost("elephantgiraffe", secrets.dictionary())[0] < 14 < secrets.guess_cost("elephantgiraffe")[0]


@pytest.mark.parametrize("value", ["random", "a" * 300_000, "abc" * 100_000, "0123456789" * 30_000, "qwertyuiop" * 30_000, "password" * 40_000])
def test_long_values_take_time_in_proportion(value):
    rng = random.Random(2)
    if value == "random":
        value = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=300_000))
    began = time.process_time()
    secrets.guess_cost(value, secrets.dictionary())
    assert time.process_time() - began < 40


def test_secrets_of_the_corpus(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    found = {(r.doc_id, r.start, r.length) for r in secrets.credential_values(documents).collect() if r.is_secret}
    expected = {(i, m.start(1), len(m[1])) for i, t in texts_of(documents).items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert expected and expected <= found
    assert not secrets.redact(documents).filter(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).count()


@pytest.mark.parametrize("line", ["Authorization: Bearer {}", "authorization: bearer {}", 'curl -H "Authorization: Bearer {}" x', "Authorization: Basic {}", "Authorization: Token {}", 'auth = Bearer "{}"', "X-Forwarded: Bearer {}", "sent as Bearer {} by mail", "bearer {}"])
def test_values_after_a_scheme_word(spark, line):
    value = "Zk3vQ9xT7mLw2RbN8sYd"
    docs = spark.createDataFrame([(1, "See " + line.format(value) + "\nthe end")], "doc_id long, text string")
    assert [(r.start, r.length, r.is_secret) for r in secrets.credential_values(docs).collect()] == [(4 + line.index("{"), len(value), True)]
    assert secrets.redact(docs).first().text == "See " + line.format(secrets.REPLACEMENT) + "\nthe end"


def test_prose_after_bearer_is_no_value(spark):
    docs = spark.createDataFrame([(1, "The bearer should present this. Bearer bonds, bearer of news; BEARER CERTIFICATES. Forbearer acts2"), (2, 'Authorization: Digest username="someone", realm="x"')], "doc_id long, text string")
    assert not [r for r in secrets.credential_values(docs).collect() if r.is_secret]


# 2


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(250)] + [(i + 1000, i + 1001) for i in range(60)] + [(5, 5)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_recursion_reaches_its_recall():
    rng = np.random.default_rng(1)
    plan = simhash.Plan(6_000, size=150, shuffled=700)
    assert plan.levels >= 2
    base = rng.integers(0, 2, (3_000, 256))
    flipped = base.copy()
    for row in flipped:
        row[rng.choice(256, simhash.RADIUS, replace=False)] ^= 1
    signs = np.concatenate([base, flipped]).astype(np.float32) * 2 - 1
    met = np.zeros(3_000, bool)
    for _, rows in plan.lists(signs, np.arange(6_000), 0, plan.levels, ()):
        low = rows[rows < 3_000]
        met[np.intersect1d(low, rows[rows >= 3_000] - 3_000)] = True
    assert met.mean() > 0.88


def test_leaders_link_large_groups():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (40, 256))
    member = rng.integers(0, 40, 5_000)
    bits = base[member] ^ (rng.random((5_000, 256)) < 0.06)
    signs = bits.astype(np.float32) * 2 - 1
    rows, others = simhash.forest(signs, simhash.RADIUS)
    assert len(signs) > simhash.EXACT and (member[rows] == member[others]).all()
    parent = list(range(len(signs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(rows.tolist(), others.tolist(), strict=True):
        parent[root(a)] = root(b)
    assert len({root(i) for i in range(len(signs))}) == 40


def components_of(n, rows, others):
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[others])
        np.minimum.at(new, others, label[rows])
        if (new == label).all():
            return label
        label = new[new]


@pytest.mark.parametrize("step", [30, 40, 50])
def test_leaders_give_exact_components_of_chains(step):
    rng = np.random.default_rng(step)
    bits = []
    for _ in range(15):
        row = rng.integers(0, 2, 256)
        for _ in range(300):
            row = row.copy()
            row[rng.choice(256, step + int(rng.integers(0, 8)), replace=False)] ^= 1
            bits.append(row)
    signs = np.array(bits)[rng.permutation(len(bits))].astype(np.float32) * 2 - 1
    near = signs @ signs.T >= simhash.BITS - 2 * simhash.RADIUS
    expected = components_of(len(signs), *np.nonzero(near))
    rows, others = simhash.forest(signs, simhash.RADIUS)
    assert len(signs) > simhash.EXACT and near[rows, others].all()
    assert (components_of(len(signs), rows, others) == expected).all()


def test_near_duplicates_against_all_pairs(documents):
    prints = simhash.fingerprints(documents).toPandas()
    signs = simhash._signs(prints[simhash._WORDS].to_numpy())
    rows, least = simhash.forest(signs, simhash.RADIUS)
    group = {r.doc_id: r.group_id for r in simhash.near_duplicates(documents).collect()}
    ids = prints.doc_id.to_numpy()
    assert len(rows)
    assert np.mean([group[ids[a]] == group[ids[b]] for a, b in zip(rows, least, strict=True)]) >= 0.9
    kept = simhash.near_duplicate_filter(documents)
    assert kept.count() == len(set(group.values())) + documents.count() - len(group)


# 3


@pytest.mark.parametrize(("size", "group"), [(60, 12), (200, 3), (400, 160)])
def test_near_copies_of_groups_above_any_share_of_the_table(spark, size, group):
    rng = random.Random(size)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3_000)]
    base = rng.choices(words, k=150)
    docs = []
    for i in range(size):
        own = list(base) if i < group else rng.choices(words, k=150)
        for _ in range(3 if i < group else 0):
            own[rng.randrange(150)] = f"edit{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    found = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(found[i] == (0 if i < group else i) for i in range(size))


def test_lists_in_parts_give_the_same_groups(spark):
    # a large group of copies, a chain that only its neighbours link, and unrelated texts
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(4_000)]
    base, chain = rng.choices(words, k=150), rng.choices(words, k=150)
    docs = []
    for i in range(900):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(150)] = f"edit{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    for i in range(60):
        chain[(5 * i) % 150 : (5 * i) % 150 + 5] = rng.choices(words, k=5)
        docs.append((1_000 + i, " ".join(chain)))
    docs += [(2_000 + i, " ".join(rng.choices(words, k=150))) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r.doc_id: r.group_id for r in simhash.near_duplicates(table).collect()}
    parts = {r.doc_id: r.group_id for r in simhash.near_duplicates(table, long=300, part=200).collect()}
    assert len(set(whole.values())) < 500 and parts == whole


def brute_repeats(texts, least=50):
    seen, out = {}, {}
    for i in sorted(texts):
        hashes = text.words_of((texts[i] or "").encode()).hash
        windows = text.windows(hashes, least).tolist()
        covered = np.zeros(len(hashes), bool)
        for j, x in enumerate(windows):
            if seen.get(x, i) != i:
                covered[j : j + least] = True
        for x in windows:
            seen.setdefault(x, i)
        if covered.any():
            out[i] = covered
    return out


def test_repeated_passages_against_all_windows(documents):
    expected = brute_repeats(texts_of(documents))
    hit = total = 0
    got = {r.doc_id: r for r in substrings.repeated_passages(documents).collect()}
    assert set(got) <= set(expected)
    for i, covered in expected.items():
        mine = np.zeros(len(covered), bool)
        for s in got[i].spans if i in got else ():
            mine[s.start : s.end] = True
        assert not (mine & ~covered).any()
        hit, total = hit + (mine & covered).sum(), total + covered.sum()
    assert total and hit >= 0.95 * total


def test_index_finds_passages_of_earlier_batches(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    filler = lambda n: " ".join(f"f{n}x{i}" for i in range(80))
    docs = spark.createDataFrame([(i, filler(i) + " " + (passage if i in (1, 4, 6) else "") + " " + filler(i + 100)) for i in range(8)], "doc_id long, text string")
    rows = {r.doc_id: r for r in substrings.repeated_passages(docs, batches=4).collect()}
    assert set(rows) == {4, 6} and all(r.sources == [1] and [(s.start, s.end) for s in r.spans] == [(80, 140)] for r in rows.values())


def test_index_goes_on_in_another_session(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    filler = lambda n: " ".join(f"f{n}x{i}" for i in range(80))
    folder = f"file://{tmp_path}/index"
    found = {}
    for session, texts in enumerate([{1: filler(1) + " " + passage, 2: filler(2)}, {3: passage + " " + filler(3), 4: filler(4) + " " + other}, {5: other + " " + passage, 6: filler(6)}, {7: filler(2)}, {8: other}]):
        own = spark.newSession()
        index = substrings.WindowIndex(own, folder)
        assert len(index.runs) == [0, 1, 2, 3, 2][session] and len(index.texts) == session
        rows = substrings.add_documents(index, own.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        found |= {r.doc_id: (r.sources, [tuple(s) for s in r.spans]) for r in rows}
        index.close()
    # one anchor of the last text is an anchor of text 5 first: in text 4 words before the passage have a lesser one
    assert found == {3: ([1], [(0, 60)]), 5: ([1, 4], [(0, 120)]), 7: ([2], [(0, 80)]), 8: ([4, 5], [(0, 60)])}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("corpusloom_run")]


def test_texts_as_document_numbers(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    filler = lambda n: " ".join(f"f{n}x{i}" for i in range(80))
    docs = [(f"doc-{i:03}", filler(i) + (" " + passage if i in (3, 17, 31) else "")) for i in range(40)]
    rows = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id string, text string").repartition(3)).collect()
    assert {r.doc_id: r.sources for r in rows} == {"doc-017": ["doc-003"], "doc-031": ["doc-003"]}


def test_passages_that_the_first_document_of_their_anchors_lacks(spark, tmp_path):
    # text 1 has every window of 25 words of the passage, but no 50 of its words in a row
    words = [f"p{i}" for i in range(60)]
    filler = lambda n: " ".join(f"f{n}x{i}" for i in range(30))
    passage = " ".join(words)
    texts = {1: " ".join([*words[:45], filler(1), *words[20:]]), 2: filler(2) + " " + passage, 3: passage + " " + filler(3)}
    rows = substrings.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.sources, r.repeated_words, [tuple(s) for s in r.spans]) for r in rows] == [(3, [2], 60, [(0, 60)])]
    found = {}
    for number, content in texts.items():
        index = substrings.WindowIndex(spark, f"file://{tmp_path}/index")
        found |= {r.doc_id: r.sources for r in substrings.add_documents(index, spark.createDataFrame([(number, content)], "doc_id long, text string")).collect()}
        index.close()
    assert found == {3: [2]}


# 4


def brute_distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(line[j] + (x != y), line[j + 1] + 1, new[j] + 1))
        line = new
    return line[-1]


def test_edit_distance():
    random.seed(5)
    for _ in range(200):
        a, b = (bytes(random.choice(b"abc") for _ in range(random.randrange(25))) for _ in range(2))
        assert edits.edit_distance(a, b) == brute_distance(a, b)


def test_within_a_limit_against_all_distances():
    rng = random.Random(15)
    for _ in range(1_500):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(300)))
        b = bytearray(a) if rng.random() < 0.8 else bytearray(rng.choice(b"abc") for _ in range(rng.randrange(300)))
        for _ in range(rng.randrange(25)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2)))
        d = edits.edit_distance(a, bytes(b))
        for limit in {0, 1, 2, max(0, d - 1), d, d + 1, d + 7}:
            assert edits.within(a, bytes(b), limit) == edits.within(bytes(b), a, limit) == (d <= limit)


def test_bands_of_many_texts_against_all_distances():
    rng = random.Random(19)
    one, two = [], []
    for _ in range(1_200):
        a = bytes(rng.choice(b"abcde fgh") for _ in range(rng.choice([0, 5, 30, 200, 900, 1_500])))
        b = bytearray(a)
        for _ in range(rng.randrange(1 + len(a) // 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = bytes(rng.choice(b"abcde fgh") for _ in range(rng.randrange(2)))
        one.append(a)
        two.append(bytes(b))
    expected = [edits.edit_distance(a, b) <= int(0.05 * max(len(a), len(b))) for a, b in zip(one, two, strict=True)]
    assert edits.near_all(one, two).tolist() == edits.near_all(two, one).tolist() == expected
    assert 200 < sum(expected) < 1_000


def test_near_without_words_that_occur_once():
    rng = random.Random(16)
    a = " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(2_000)).encode()
    b = a[:4_000] + b"x" + a[4_001:]
    assert edits.near(a, b) and edits.near(b, a)
    far = bytearray(a)
    for at in range(0, len(far), 9):
        far[at] = 120
    assert not edits.near(a, bytes(far))


def test_edit_groups_against_all_pairs(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randrange(2, 9)))
    docs, pairs = [], []
    for i in range(60):
        words = [word() for _ in range(random.randrange(60, 200))]
        docs.append((2 * i, " ".join(words)))
        for _ in range(max(1, len(words) // 50)):
            words[random.randrange(len(words))] = word()
        docs.append((2 * i + 1, " ".join(words)))
    texts = dict(docs)
    for a, b in itertools.combinations(texts, 2):
        if abs(len(texts[a]) - len(texts[b])) <= 60 and edits.edit_distance(texts[a].encode(), texts[b].encode()) <= edits.NEAR * max(len(texts[a]), len(texts[b])):
            pairs.append((a, b))
    group = {r.doc_id: r.group_id for r in edits.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(pairs) >= 50 and np.mean([group[a] == group[b] for a, b in pairs]) >= 0.9
    assert all(a // 2 == b // 2 for a, b in group.items())


def test_copies_far_from_each_other_join_their_original(spark):
    # half the limit and a little more in bytes: two copies are further apart than the limit, each is near the original
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    docs = []
    for g in range(12):
        base = " ".join(word() for _ in range(400))
        docs.append((100 * g, base))
        for k in range(1, 41):
            own = bytearray(base.encode())
            at = rng.randrange(len(own) - len(own) // 20)
            for i in range(at, at + int(0.035 * len(own))):
                own[i] = rng.choice(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            docs.append((100 * g + k, own.decode()))
    group = {r.doc_id: r.group_id for r in edits.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(group[i] // 100 == i // 100 for i in group)
    assert np.mean([group[i] == i // 100 * 100 for i in group]) > 0.99


def test_texts_of_many_pairs_are_sent_by_blocks(spark):
    # 60 texts against 400, as of a large group and what is near none of it, and 300 pairs of their own
    many = [(a, 1_000 + b) for a in range(60) for b in range(400)] + [(5_000 + 2 * k, 5_001 + 2 * k) for k in range(300)]
    nodes = sorted({n for pair in many for n in pair})
    found = edits.units(spark.createDataFrame(many, "a long, b long"), spark.createDataFrame([(n, 2_000) for n in nodes], "node long, size long")).collect()
    assert sorted((r.a, r.b) for r in found) == many
    sent = {(r.unit, n) for r in found for n in (r.a, r.b)}
    assert len(sent) < 3_000 and max(Counter(r.unit for r in found).values()) < 20_000


def test_blocks_give_the_pairs_that_are_near(spark):
    rng = random.Random(23)
    base = [rng.choice(["red", "green", "blue", "yellow", "brown"]) + str(rng.randrange(99)) for _ in range(150)]
    texts = {}
    for k in range(70):
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(150)] = f"w{rng.randrange(10**4)}"
        texts[k] = " ".join(own)
    pairs = list(itertools.combinations(texts, 2))
    expected = [(a, b) for a, b in pairs if edits.edit_distance(texts[a].encode(), texts[b].encode()) <= int(edits.NEAR * max(len(texts[a]), len(texts[b])))]
    docs = spark.createDataFrame(list(texts.items()), "node long, text string")
    sizes = docs.select("node", F.octet_length("text").cast("long").alias("size"))
    found = edits.verified_in_blocks(spark.createDataFrame(pairs, "a long, b long"), docs.union(docs), sizes).collect()
    assert sorted((r.a, r.b) for r in found) == expected and 100 < len(expected) < len(pairs) - 100


def test_bands_are_as_wide_as_paths_within_the_limit():
    assert edits._reach(2_400, 2_400, 120) == (60, 60) and edits._reach(2_410, 2_400, 120) == (55, 65)


# 5


def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    train = docs.filter("doc_id < 500")
    rows = language.identify(docs.filter("doc_id >= 500"), train).collect()
    assert np.mean([r.lang == r.predicted for r in rows if r.predicted]) > 0.97


def test_kernel_by_sets():
    texts = ["Hello world", "hello there", "", "zzz"]
    chunk = next(text.chunks(pa.array(texts)))
    got = language.presence(chunk) @ language.presence(chunk).T / 3
    grams = lambda t, n: {t.lower()[i : i + n] for i in range(len(t) - n + 1)}
    for i, j in itertools.product(range(4), repeat=2):
        parts = [len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0 for a, b in ((grams(texts[i], n), grams(texts[j], n)) for n in (1, 2, 3))]
        assert abs(got[i, j] - sum(parts) / 3) < 1e-5


# 6


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, line[j + 1] = line[j + 1], last + 1 if x == y else max(line[j + 1], line[j])
    return line[-1]


def test_subsequence():
    random.seed(7)
    for _ in range(100):
        a, b = ([random.randrange(6) for _ in range(random.randrange(1, 30))] for _ in range(2))
        mask = {}
        for i, x in enumerate(a):
            mask[x] = mask.get(x, 0) | 1 << i
        assert decontamination.subsequence(mask, len(a), b) == lcs(a, b)


def test_every_term_is_found_in_texts(spark):
    # 40,000 terms: some share a slot of any table of 2 ** 22
    items = [(i, " ".join(f"w{4 * i + k}" for k in range(4))) for i in range(10_000)]
    docs = spark.createDataFrame([(k, " ".join(t for _, t in items[k::50])) for k in range(50)], "doc_id long, text string")
    bench = decontamination.Benchmark(spark.createDataFrame(items, "item_id long, text string").toPandas())
    hits = decontamination._hits(docs.withColumn("key", F.col("doc_id")).select("key", "doc_id", "text"), spark.sparkContext.broadcast(bench))
    found = np.concatenate([np.frombuffer(r.terms, np.int32) for r in hits.collect()])
    assert len(bench.terms) == 40_000 and (np.bincount(found, minlength=40_000) == 1).all()


def test_documents_without_terms_are_no_obstacle(spark):
    item = "zebras never lie about striped umbrellas in spring rain showers"
    rows = [(i, item if i % 3 == 1 else f"nothing{i} here{i}") for i in range(30)] + [(99, "last one has none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = decontamination.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {i for i in range(30) if i % 3 == 1}


@pytest.mark.parametrize("docs", [[(1, "{}"), (2, "other words here entirely and more")], [(i, f"nothing{i} at all") for i in range(30)], [(1, "{}"), *((i, f"filler{i} only") for i in range(2, 40))]])
def test_batches_without_words_of_the_benchmark(spark, docs):
    item = "zebras never lie about striped umbrellas in spring rain showers"
    table = spark.createDataFrame([(i, t.format(item)) for i, t in docs], "doc_id long, text string").repartition(len(docs))
    items = spark.createDataFrame([(7, item), (7, "another text of that id which nobody has anywhere in here")], "item_id long, text string")
    held = [i for i, t in docs if t == "{}"]
    assert [(r.doc_id, r.item_id, r.share) for r in decontamination.contaminated(table, items).collect()] == [(i, 7, 1.0) for i in held]
    assert sorted(r.doc_id for r in decontamination.decontaminate(table, items).collect()) == [i for i, t in docs if t != "{}"]


def test_paraphrased_items_are_found_and_clean_documents_not(spark, documents, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    random.seed(8)
    planted = []
    for n, r in enumerate(items.collect()):
        words = r.text.split()
        if len(words) < 15:
            continue
        for _ in range(len(words) // 10):
            del words[random.randrange(len(words))]
        for _ in range(len(words) // 10):
            words.insert(random.randrange(len(words)), f"extra{n}")
        around = [f"clean{n}w{i}" for i in range(60)]
        planted.append((10_000 + n, " ".join(around[:30] + words + around[30:]), r.item_id))
    plain = documents.select("doc_id", "text")
    docs = plain.union(spark.createDataFrame([p[:2] for p in planted], plain.schema))
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert np.mean([(i, item) in found for i, _, item in planted]) >= 0.9
    words = lambda t: re.findall(r"\w+", t.lower())
    exact = {(i, r.item_id) for i, t in texts_of(documents).items() for r in items.collect() if " ".join(words(r.text)) in " ".join(words(t))}
    assert len(exact & found) >= 0.9 * len(exact)
    for doc, item in found - exact:
        if doc < 10_000:
            t, b = (words(x) for x in (texts_of(documents)[doc], items.filter(F.col("item_id") == item).first().text))
            assert lcs(b, t) >= decontamination.SHARE * len(b)


# 7


def test_templates_go_and_content_stays(spark):
    def page(n, nav="<nav><ul><li><a href='/a'>Home</a></li><li>Shop &amp; more</li></ul></nav>"):
        return f"<html><head><title>t</title></head><body>{nav}<!-- {n} --><p>Text {n} of <b>this</b> page<br>ends<p>Second {n}<script>var t='</p>'</script><footer>Contact</footer></body></html>"

    rows = [(n, f"http://www.example.org/{n}", page(n)) for n in range(6)] + [(10, "http://other.example/1", page(10)), (11, None, page(11)), (12, "/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html.TEMPLATES, 0):
        out = {r.page_id: r for r in html.extract(pages, broadcast=limit).collect()}
        assert out[0].text == "Text 0 of this page\nends\nSecond 0" and out[0].removed == 2
        assert out[10].text.startswith("Home\nShop & more") and out[11].text.endswith("Contact") and out[12].text == ""


def test_paragraphs_end_at_blocks_at_any_depth():
    inline = "".join(f"<{t}>" for t in ("b", "i", "em", "u", "s", "q", "small", "span") * 3)
    root = html.parse(f"<body><p>one{inline}two<div>three</div>")
    (body,) = root.children
    assert [c.tag for c in body.children] == ["p", "div"]
    began = time.process_time()
    html.parse("<b>" * 50_000 + "<div></div></i>" * 50_000)
    assert time.process_time() - began < 20


def test_subtrees_recurring_against_brute_force(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    counts, sizes, own = Counter(), Counter(), {}
    for r in pages.select("url", "html").distinct().collect():
        host = html.host_of(r.url)
        sizes[host] += 1
        counts.update(html.subtrees(html.parse(r.html), host))
    for r in pages.collect():
        host = html.host_of(r.url)
        template = {k for k in html.subtrees(html.parse(r.html), host) if counts[k] >= max(html.PAGES, html.SHARE * sizes[host])}
        own[r.page_id] = html.content(html.parse(r.html), host, template)
    assert {r.page_id: (r.text, r.removed) for r in html.extract(pages).collect()} == own


# 8


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_public_encoder(documents, reference):
    encoded = bpe.encode(documents)
    texts = texts_of(documents)
    for r in encoded.collect():
        assert r.tokens == reference.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens) and r.round_trip
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == texts


def test_odd_strings(reference):
    random.seed(9)
    odd = ["", "aaaaaaaaaaa", "  \n\n  x", "é́日本語🙂🙂", "<|endoftext|>", "abab" * 50, "it's I'LL 's", "\x00\x01"]
    odd += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(160, 0x3000), 0x1F600])) for _ in range(80)) for _ in range(100)]
    tokens, offsets = bpe.Encoder(bpe.Vocabulary()).encode(odd)
    assert [tokens[offsets[i] : offsets[i + 1]].tolist() for i in range(len(odd))] == [reference.encode_ordinary(o) for o in odd]


# 9


def brute_segments(scores):
    """The best segment (shortest, first), then those of the parts on both sides of it."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((round(sums[j] - sums[i], 9), i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3:]
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_maximal_segments():
    random.seed(10)
    for _ in range(150):
        scores = [random.choice([-1.37, -0.61, -2.03, 1.11, 2.29, 0.57]) + random.random() * 1e-3 for _ in range(random.randrange(1, 25))]
        after = np.cumsum(scores)
        up = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments([after[i] - scores[i] for i in up], [after[i] for i in up])
        assert [(up[a], up[b] + 1) for a, b in got] == brute_segments(scores)


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("bcdfgaeiou") for _ in range(6))
    bad = ["vile", "scummy", "rotten"]
    docs, marks = [], []
    for i in range(900):
        words = [word() for _ in range(80)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(5):
                words[random.randrange(80)] = random.choice(bad)
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3:
            marks.append((i, int(toxic)))
    out = toxicity.toxic_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert np.mean([r.is_toxic for r in out if r.doc_id % 6 == 0]) > 0.95
    assert np.mean([r.is_toxic for r in out if r.doc_id % 6]) < 0.01
    assert all(p.end > p.start for r in out for p in r.passages)


def test_copies_of_a_toxic_text_take_no_word_from_the_others(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    docs = []
    for i in range(900):
        words = [word() for _ in range(80)]
        for _ in range(5 if i % 6 == 0 else 0):
            words[rng.randrange(80)] = rng.choice(["vile", "scummy", "rotten"])
        docs.append((i, " ".join(words), int(i % 6 == 0)))
    copied = " ".join([*(word() for _ in range(30)), "vile", "scummy", "rotten", "vile", "scummy", "rotten"])
    docs += [(1_000 + i, copied, 1) for i in range(2_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    out = toxicity.toxic_passages(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect()
    assert np.mean([r.is_toxic for r in out if r.doc_id < 900 and r.doc_id % 6 == 0]) > 0.95
    assert all(r.is_toxic for r in out if r.doc_id >= 1_000)
    assert np.mean([r.is_toxic for r in out if r.doc_id < 900 and r.doc_id % 6]) < 0.01


def test_query_gives_every_document(spark, sf_dir, documents, labels):
    found = queries.op9_toxic_passages(spark, sf_dir)
    assert found.count() == documents.count()
    expected = toxicity.toxic_passages(documents, labels).filter(F.size("passages") > 0).count()
    assert found.filter(F.size("passages") > 0).count() == expected


# 10


def brute_kneser_ney(texts, order):
    counts = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discount = {}
    for m, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        discount[m] = [max(0.1, min(k, k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else 0.5 * k)) for k in (1, 2, 3)]
    by_context = {m: defaultdict(list) for m in counts}
    for m, c in counts.items():
        for g, n in c.items():
            by_context[m][g[:-1]].append(n)

    def p(g):
        m = len(g)
        if not m:
            return 1 / 256
        cut = lambda n: min(discount[m][min(n, 3) - 1], 0.9 * n)
        seen = by_context[m].get(g[:-1])
        if not seen:
            return p(g[1:])
        left = sum(map(cut, seen)) / sum(seen)
        n = counts[m].get(g, 0)
        return (n - cut(n) if n else 0) / sum(seen) + left * p(g[1:])

    return p


@pytest.mark.parametrize("rows", [quality.MODEL_ROWS, 0])
def test_perplexity_by_hand(spark, rows):
    trusted = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog"]
    other = ["the mat sat", "zzz qqq", "ab", "", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*trusted, *other])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3), 0) for i in range(8)], "doc_id long, quality int, toxic int")
    p = brute_kneser_ney([t.encode() for t in trusted], 3)
    for r in quality.quality_scores(docs, labels, order=3, model_rows=rows).collect():
        t = ([*trusted, *other][r.doc_id] or "").encode()
        grams = [t[i : i + 3] for i in range(len(t) - 2)]
        if not grams:
            assert r.perplexity is None and r.keep
        else:
            assert math.isclose(r.perplexity, math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)), rel_tol=1e-4)


def test_fences_by_quartiles(spark):
    rng = random.Random(20)
    rows = [(lang, math.exp(rng.gauss(1.5, 0.4))) for lang in ("en", "de") for _ in range(2_001)] + [("fr", 7.0)] * 5 + [("es", None)]
    found = {r.lang: r for r in quality.fences_of(spark.createDataFrame(rows, "lang string, perplexity double"), 4.0).collect()}
    for lang in ("en", "de"):
        low, middle, high = np.quantile([p for x, p in rows if x == lang], [0.25, 0.5, 0.75])
        assert math.isclose(found[lang].median, middle, rel_tol=1e-3) and math.isclose(found[lang].fence, middle + 4 * (high - low), rel_tol=3e-3)
    assert set(found) == {"en", "de", "fr"} and 7.0 <= found["fr"].fence < 7.02


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.keep for r in rows if r.quality == 0]) < 0.2


# queries and pipeline


def test_pipeline(spark, sf_dir, documents, labels):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    bad = {r.doc_id for r in quality.quality_scores(documents, labels).collect() if not r.keep}
    stays = documents.join(spark.createDataFrame([(i,) for i in bad] or [(-1,)], "doc_id long"), "doc_id", "left_anti")
    group = simhash.near_duplicates(stays).filter("keep").select("doc_id").collect()
    kept = stays.filter(F.col("doc_id").isin([r.doc_id for r in group]))
    leaks = {r.doc_id for r in decontamination.contaminated(kept, table(spark, sf_dir, "benchmark")).collect()}
    expected = {r.doc_id for r in kept.select("doc_id").collect()} - leaks
    assert {r.doc_id for r in out} == expected and len(out) == len(expected)
    assert all(r.round_trip for r in out)


def test_queries_are_complete():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries())
    assert numbers == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
