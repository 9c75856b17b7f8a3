"""Problems 6, 7 and 8: encoding, filling, visually identical texts."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.llm.encoding import TOKENIZERS, VOCABULARY, decode, encode, load_tokenizer, token_counts
from tesserae.llm.lookalike import look_classes, look_forms, look_pairs
from tesserae.llm.packing import best_fit, completion, fillings, least_containers, pack

DOC = "doc_id bigint, text string, word string, pos int"
TEXTS = [
    None, "", " ", "   a  b\n\n c\t", "It's we'll I'M don't", "x" * 5000, "wörld Привет 日本語 　 \xa0\x1f\x0b\x85", "<|endoftext|> a<|endoftext|>", "👩‍🎨 ❤️ ²³ １２ a1b2", "͸\U0001fae8 new \U00010d40", "\r\n\r\n   x",
    "a" + "́" * 50, "tab\tand  spaces   ",
]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], DOC)


needs_files = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/{VOCABULARY}"), reason="no vocabulary files")


@needs_files
def test_encoding_equals_the_library_and_decodes(spark):
    t = load_tokenizer(f"{TOKENIZERS}/{VOCABULARY}")
    d = docs(spark, TEXTS)
    coded = encode(d)
    got = {r["doc_id"]: list(r["ids"]) for r in coded.collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in decode(coded).collect()} == {k: x or "" for k, x in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(d).collect()} == {k: len(x) for k, x in got.items()}


@needs_files
def test_encoding_of_nothing(spark):
    assert encode(docs(spark, [])).count() == 0


@needs_files
def test_random_texts(spark):
    rng = np.random.default_rng(0)
    alphabet = [*"abcXYZ  \n\t'’.,!?0159éßñЖσ中かー👍‍﻿\xa0²", "'s", "'ll", "  "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(300)]
    t = load_tokenizer(f"{TOKENIZERS}/{VOCABULARY}")
    got = {r["doc_id"]: list(r["ids"]) for r in encode(docs(spark, texts)).collect()}
    assert got == {k: t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts)}


def check(rows, sizes, capacity):
    inside, per = defaultdict(list), defaultdict(list)
    for r in rows:
        inside[r["container"]].append((r["token_at"], r["n_tokens"]))
        per[r["doc_id"]].append((r["token_from"], r["n_tokens"]))
    for parts in inside.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= capacity
    for doc, n in sizes.items():
        parts = sorted(per.get(doc, []))
        assert sum(k for _, k in parts) == (n or 0) and [a for a, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]
        assert (n or 0) > capacity or len(parts) <= 1
    return len(inside)


@pytest.mark.parametrize("kind", ["mixed", "ones", "same", "large"])
def test_each_token_lies_in_one_container(spark, kind):
    rng = np.random.default_rng(2)
    sizes = {"mixed": [*map(int, rng.lognormal(4, 1.2, 800))], "ones": [1] * 3000, "same": [700] * 90, "large": [2048, 2049, 6000, 4096, 1]}[kind]
    table = dict(enumerate([*sizes, 0, None]))
    rows = pack(spark.createDataFrame(list(table.items()), "doc_id bigint, n_tokens bigint")).collect()
    n = check(rows, table, 2048)
    bound = {"mixed": -(-sum(sizes) // 2048) + 1, "ones": 2, "same": 45, "large": 8}[kind]
    assert n <= bound


def test_filling_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


def test_completion_finds_the_best_filling():
    below = [0] * 101
    counts = [0] * 101
    for s, k in ((60, 1), (50, 2), (35, 1), (25, 1), (14, 1)):
        counts[s] = k
    for s in range(1, 101):
        below[s] = s if counts[s] else below[s - 1]
    assert sum(completion(counts, below, 99)) == 99  # 50 + 35 + 14
    used = defaultdict(int)
    for times, sizes in fillings({5: 7, 3: 4, 2: 2}, 10):
        assert sum(sizes) <= 10
        for s in sizes:
            used[s] += times
    assert dict(used) == {5: 7, 3: 4, 2: 2}


SAME = [
    ("café", "caf\xe9"), ("ﬁne", "fine"), ("ｆｕｌｌ １", "full 1"), ("а​b", "ab"), ("a\xa0b", "a b"), ("x‑y", "x-y"), ("wait…", "wait..."), ("が", "が"), ("so\xadft", "soft"), ("Ρath", "Path"), ("ё", "ë"),
    ("q̣̇", "q̣̇"), ("사", "사"), ("ﾊﾟ", "パ"), ("\u1f80", "\u03b1\u0313\u0345"), ("á̖", "á̖"),
]
DIFFERENT = [("m2", "m\xb2"), ("O", "0"), ("l", "1"), ("A", "a"), ("e", "\xe9"), ("ab", "a b"), ("a\tb", "a b"), ("a  b", "a b"), ("👩‍🎨", "👩🎨"), ("👍", "👍\U0001f3fd"), ("①", "1"), ("ı", "i")]


@pytest.mark.parametrize("shift", [0, 1])
def test_forms(spark, shift):
    texts = [t for pair in (DIFFERENT if shift else SAME) for t in pair]
    form = {r["doc_id"]: r["form"] for r in look_forms(docs(spark, texts)).collect()}
    for k in range(0, len(texts), 2):
        assert (form[k] != form[k + 1]) == bool(shift), (texts[k], texts[k + 1], form[k], form[k + 1])


def test_form_is_stable_and_composed(spark):
    texts = [None, "", "plain text\n", "​﻿", "é" * 3000, "a" + "̖́" * 40, "Ünï ﬃ １ а"]
    first = {r["doc_id"]: r["form"] for r in look_forms(docs(spark, texts)).collect()}
    assert first[0] is None and first[1] == "" and first[2] == texts[2] and first[3] == "" and first[4] == texts[4]
    again = {r["doc_id"]: r["form"] for r in look_forms(docs(spark, [first[k] for k in range(len(texts))])).collect()}
    assert again == first


def test_pairs(spark):
    texts = ["café", "caf\xe9", "caf\xe9", "cafe", None, "", "​", " ", "\xa0", "n/a", "n⁠/a", "n/a"]
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in look_pairs(docs(spark, texts)).collect()}
    assert got == {(0, 1), (0, 2), (9, 10), (10, 11)}
    assert look_pairs(docs(spark, [])).count() == 0


def fewest(items, capacity):
    """The least number of containers, by trying every place of every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            k = rooms.index(r)
            put(i + 1, (*rooms[:k], r - items[i], *rooms[k + 1 :]))
        put(i + 1, (*rooms, capacity - items[i]))

    put(0, ())
    return best[0]


def test_fillings_need_the_fewest_containers():
    rng = np.random.default_rng(4)
    cases = [(20, [14, 13, 13, 10, 9, 9, 8, 5, 5, 4, 3, 3])] + [(c, [int(x) for x in rng.integers(1 if k % 2 else c // 6, c // 2 + 2, rng.integers(0, 11))]) for k, c in enumerate([10, 20, 30, 60] * 60)]
    for capacity, items in cases:
        solution = fillings(Counter(items), capacity)
        assert all(sum(sizes) <= capacity for _, sizes in solution)
        assert sum((Counter({s: times * sizes.count(s) for s in sizes}) for times, sizes in solution), Counter()) == Counter(items)
        assert sum(times for times, _ in solution) == fewest(items, capacity)


def test_runs_of_many_marks_and_letters_of_other_scripts(spark):
    many = "a\u0301" + "\u0316" * 3 + "\u0308" * 4
    texts = [many, "\u00e1" + "\u0316" * 3 + "\u0308" * 4, "a" + "\u0316" * 3 + "\u0301" + "\u0308" * 4, "a" + "\u0308\u0301" + "\u0316" * 3 + "\u0308" * 3, "\u03bd\u03c1", "vp", "\u13aa\u13b7", "AM"]
    forms = {r["doc_id"]: r["form"] for r in look_forms(docs(spark, texts)).collect()}
    # marks of different classes commute, those of one class do not
    assert forms[0] == forms[1] == forms[2] != forms[3] and forms[4] == forms[5] and forms[6] == forms[7]
    classes = {r["doc_id"]: (r["class_id"], r["texts"]) for r in look_classes(docs(spark, [*texts, " ", None, "vp"])).collect()}
    assert classes[2] == (0, 3) and classes[3] == (3, 1) and classes[10] == classes[4] == (4, 2) and 8 not in classes and 9 not in classes


def test_filling_is_never_worse_than_best_fit_on_large_items():
    rng = np.random.default_rng(5)
    for k in range(4):
        counts = Counter(int(x) for x in rng.integers(600, 1_024, 200 + 50 * k))
        n = lambda solution: sum(t for t, _ in solution)
        got, bound = fillings(dict(counts), 2_048, 300_000), least_containers(sorted(counts, reverse=True), counts, 2_048)
        used = Counter()
        for times, sizes in got:
            assert sum(sizes) <= 2_048
            for s in sizes:
                used[s] += times
        assert used == counts and bound <= n(got) <= n(best_fit(dict(counts), 2_048))
