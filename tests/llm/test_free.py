"""The other operators: against brute force, the libraries that define the results, and exact round trips."""

import base64
import hashlib
import json
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tracepath.llm import best_fit_pack as b
from tracepath.llm import byte_bpe as bb
from tracepath.llm import chat_format as c
from tracepath.llm import exact_dedup as e
from tracepath.llm import language_id as l
from tracepath.llm import license_scan as ls
from tracepath.llm import simhash_dedup as sd
from tracepath.llm.common import Memory, encode_texts, portions
from tracepath.llm.components import connected_components

DOCS = "doc_id long, text string, fp long, component string"
ODD = list("abc ABC 12.,'\n\t\x0b\x1c\x1f\x85\xa0\u3000\u2009éß中🙂\u0301\u200d²½Ⅷ_-#İΣ")


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], DOCS)


def mixed(seed, n, most=40):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, most))) for _ in range(n)]


# licences


def test_licences(spark):
    texts = ["Released under the MIT License.", "x Under  the mit-license; y", "Relased undr the MIT Licence", None, "", "GNU General Public Licence, version 3", "all about mittens", "CC BY-NC " * 3000, "éunder the mit license"]
    rows = {r["doc_id"]: r for r in ls.scan_licenses(docs(spark, *texts)).collect()}
    assert [rows[i]["n_base"] for i in range(9)] == [1, 1, 0, 0, 0, 0, 0, 3000, 0]
    assert [rows[i]["labels"] for i in range(9)] == ["mit", "mit", "mit", "", "", "gpl-3", "", "cc-by-nc", ""]
    assert (rows[1]["first_word"], rows[1]["last_word"], rows[7]["last_word"]) == (1, 1, 2999 * 3)
    assert rows[3]["first_word"] is None and rows[0]["score"] == 1.0 and 0 < rows[2]["score"] < 1
    assert ls.scan_licenses(docs(spark).limit(0)).count() == 0


def test_seeds_miss_nothing():
    r, scanner = random.Random(5), ls.Scanner()
    for _ in range(400):
        n = r.choice(ls.NOTICES)
        t = list(n.text)
        for _ in range(r.randint(0, n.edits + 2)):
            i = r.randrange(len(t))
            t[i : i + r.randint(0, 1)] = r.choice(["", "x", " "])
        s = ls.normal_words("aa bb " + "".join(t) + " cc dd")
        found = regex.search(rb"(?b)(?:" + regex.escape(n.text.encode(), special_only=True) + rb"){e<=%d}" % n.edits, s)
        assert (n.label in {x[0] for x in scanner.fuzzy(s)}) == bool(found)


def test_neighbouring_notices_all_count():
    scan, exact = ls.Scanner().scan, "released under the mit license"
    assert scan(f"released undr the mit license and {exact}")["spans"] == "mit:0:4:1,mit:6:10:0"
    assert scan(f"releasd undr the mit license {exact}")["spans"] == "mit:0:4:2,mit:5:9:0"
    r = random.Random(8)
    for _ in range(60):
        kinds = [r.choice([exact, "released undr the mit license", "releasd under the mit license", "releasd undr the mit license"]) for _ in range(4)]
        want = ",".join(f"mit:{5 * i}:{5 * i + 4}:{('undr' in k) + ('releasd ' in k)}" for i, k in enumerate(kinds))
        assert scan(" ".join(kinds))["spans"] == want


def test_edited_base_phrases_anywhere():
    scan = ls.Scanner().scan
    for text, label in (("distributed under the MIT licence", "mit"), ("available under the MIT licens", "mit"), ("x under the MIT licence", "mit"), ("distributed under the Apache Licence, version 2.0", "apache-2"), ("this is ccby nc", "cc-by-nc")):
        got = scan(text)
        assert got["labels"] == label and 0 < got["score"] < 1 and got["spans"].startswith(label)


def test_other_licences_get_no_label():
    scan = ls.Scanner().scan
    for text in ("released under the GPL license", "licensed under CC BY 4.0", "licensed under CC BY the author", "GNU General Public License version 1", "GNU Library General Public License version 2", "licensed under the Apache License, version 1", "Apache License version 1.1"):
        got = scan(text)
        assert (got["labels"], got["score"], got["spans"]) == ("", 0.0, ""), text
    for text, label in (
        ("released under the BSD license", "bsd"), ("released under the ISC license", "isc"), ("licensed under CC BY-SA", "cc-by-sa"), ("licensed under CC BY-ND", "cc-by-nd"),
        ("GNU General Public License version 2", "gpl-2"), ("GNU Lesser General Public License, version 3", "lgpl-3"), ("gnu leser general public licence version 2", "lgpl-2"),
        ("GNU Affero General Public License version 3", "agpl-3"), ("Mozilla Public License Version 2.0", "mpl-2"), ("Boost Software Licence - Version 1.0", "bsl-1"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this softwre", "mit"),
        ("Redistribution and use in source and binary form, with or without modifications, are permitted", "bsd"),
        ("This is free and unencumbered software released to the public domain.", "unlicense"),
    ):
        assert scan(text)["labels"] == label, text
    for text, label in (("released under the mt license", "mit"), ("released under them it license", "mit"), ("licensed under cc by mc", "cc-by-nc"), ("GNU General Public Licence version 3", "gpl-3"), ("licensd under the Apache License version 2.0", "apache-2")):
        assert scan(text)["labels"] == label, text


# SimHash


def test_fingerprints_by_definition():
    import xxhash

    for t in [*mixed(1, 50, 200), "a b c d e f g", None, "one", "A B"]:
        w = regex.findall("[^\x20\x09-\x0d]+", "".join(x.lower() if x.isascii() else x for x in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))
        assert sd.fingerprint(t) == want


def clusters(fps, bits):
    n, up = len(fps), list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                up[max(top(i), top(j))] = min(top(i), top(j))
    out = defaultdict(set)
    for i in range(n):
        out[top(i)].add(fps[i])
    return {frozenset(x) for x in out.values() if len(x) > 1}


@pytest.mark.parametrize("block", [2000, 7])
def test_links_connect_what_is_near(spark, block):
    r = random.Random(9)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            y = x
            for _ in range(r.randint(0, 6)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = sd.links(table, block=block)
    assert all(bin((x["a"] ^ x["b"]) & (1 << 64) - 1).count("1") <= 4 for x in found.collect())
    groups = defaultdict(set)
    for x in connected_components(found).collect():
        groups[x["component"]].add(x["node"] & (1 << 64) - 1)
    assert {frozenset(g) for g in groups.values()} == clusters(fps, 4)


def test_near_duplicates(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    texts = [" ".join(r.sample(base, 300)), " ".join(base), " ".join(near), " ".join(base), None, "", " \n"]
    d = docs(spark, *texts)
    rows = {x["doc_id"]: x for x in sd.near_duplicates(d.union(d.where("doc_id = 1"))).collect()}
    assert rows[1]["component_id"] == rows[3]["component_id"] == 1 and rows[2]["component_id"] == 1
    assert rows[0]["component_id"] == 0 and [rows[i]["component_id"] for i in (4, 5, 6)] == [4, 4, 4]
    assert sd.near_duplicates(d.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


# chats


def test_escapes_round_trip():
    r = random.Random(4)
    for _ in range(500):
        turns = [("".join(r.choice("a:#\\<\n") for _ in range(r.randint(0, 4))), "".join(r.choice(["\\", "#", "###", "</turn>", "<", "é", "\n", ": "]) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(0, 4))]
        assert c.read_turns("".join(c.write_turn(*t)[0] for t in turns)) == turns


def test_other_fields_are_ignored():
    known = c.by_fingerprint(c.MAPPINGS)
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}], "id": 7},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "source": {"url": "u"}},
        {"instruction": "q", "output": "a", "id": 1, "tags": ["x", {"y": 1}]},
    ):
        assert c.convert(json.dumps(record), known)[1] == want
    for record in ({"messages": [{"role": "user", "content": [{"text": "q"}]}]}, {"messages": [{"role": "user", "content": "q"}, {"role": "user", "content": ["q"]}]}, {"id": 1}):
        assert c.convert(json.dumps(record), known) == (None, [])


def test_layouts():
    known = c.by_fingerprint(c.MAPPINGS)
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    ):
        assert c.convert(json.dumps(record), known)[1] == want
    assert c.convert('{"messages":[]}', known) == ("no messages", [])
    for odd in ('{"what":1}', "nonsense", None, "[]", "3", '{"messages[].role":"user","messages[].content":"q"}', '{"messages[]":"x"}'):
        assert c.convert(odd, known) == (None, [])


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a #1"), (2, 1, "assistant", None), (2, 0, None, "x"), (1, 2, "assistant", "b"), (None, None, "user", "n"), *[(3, i, "assistant", "é" * 50) for i in range(3000)]]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seg = c.format_turns(c.turn_records(t))
    got = {r["conv_id"]: r for r in c.read_back(c.place_segments(c.in_order(seg))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == hashlib.sha256(b"a #1b").hexdigest() and got[1]["loss_chars"] == 5
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\na #1\nassistant\nb\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\nassistant\n\n").hexdigest() and got[None]["n_turns"] == 1
    assert got[3]["loss_chars"] == 150_000
    assert c.layout_counts(seg).collect() == [("turn row", len(rows))]
    assert c.read_back(c.place_segments(c.in_order(c.format_turns(c.turn_records(t.limit(0)))))).count() == 0


# exact duplicates


def test_grace_spills_and_merges():
    r = random.Random(1)
    records = [(bytes([r.randrange(3)]) * r.choice([10, 500]) + str(r.randrange(200)).encode(), r.randrange(10**6), 1) for _ in range(5000)]
    want = defaultdict(lambda: [e.NONE, 0])
    for t, k, n in records:
        want[t] = [max(want[t][0], k), want[t][1] + n]
    for size in (1 << 30, 20_000, 900):
        assert {t: [k, n] for t, k, n in e.grace(iter(records), size)} == want
        assert sorted(t for t, _, _ in e.grace(iter(records), size)) == sorted(want)


@pytest.mark.parametrize("table_bytes", [1 << 20, 500])
def test_exact_duplicates(spark, table_bytes):
    texts = ["a", "b", "a", None, "", "a", "x" * 100_000, "x" * 100_000, *[str(i) for i in range(50)]]
    d = docs(spark, *texts).repartition(3)
    rows = {r["doc_id"]: r for r in e.exact_duplicates(d, table_bytes=table_bytes).collect()}
    assert [(rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) for i in range(8)] == [(5, 3, False), (1, 1, True), (5, 3, False), (4, 2, False), (4, 2, True), (5, 3, True), (7, 2, False), (7, 2, True)]
    assert len(rows) == len(texts) and rows[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert e.exact_duplicates(d.limit(0)).count() == 0
    least = -(1 << 63)
    edge = spark.createDataFrame([(least, "a"), (None, "a"), (least, "b")], "doc_id long, text string")
    assert [r["keep_id"] for r in e.exact_duplicates(edge, table_bytes=table_bytes).collect()] == [least] * 3
    nulls = spark.createDataFrame([(None, "a"), (2, "a"), (None, "z")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["keep_id"], r["kept"]) for r in e.exact_duplicates(nulls).collect() if r["keep_id"]) == [(-1, 2, False), (2, 2, True)]


# languages


def test_languages(spark):
    r = random.Random(0)
    words = {"aa": ["kala", "makala", "tika", "lakat"], "bb": ["strum", "brusz", "drzun", "zbrum"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i in range(120) for k in [r.choice("ab") * 2]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "kala", None), (1003, "brusz " * 30_000, None), (None, "strum drzun", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = l.identify(d).collect()
    by_id = {x["doc_id"]: x for x in got}
    assert all(by_id[i]["lang_pred"] == k for i, _, k in rows[:120]) and len(got) == len(rows)
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "aa", "bb", "bb"]
    assert all(0 <= x["score"] <= 1 for x in got) and {x["held_out"] for x in got} == {True, False}
    assert {x["doc_id"] for x in l.drop_unknown(d).collect()} == {x[0] for x in rows} - {1000, 1001}
    assert l.identify(d.limit(0)).count() == 0
    assert {x["lang_pred"] for x in l.identify(d.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def test_ranks_and_distances_by_definition(spark):
    r = random.Random(5)
    d = [(i, " ".join("".join(r.choice(k * 3 + "abc éЖ1") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 25))), k) for i in range(150) for k in [r.choice("xyz")]]
    d += [(200, None, "x"), (201, "1 2", "y"), (202, "Abc aBC", None)]

    def grams(t):
        out = defaultdict(int)
        s = " " + " ".join(regex.findall(r"\p{L}+", (t or "").lower())) + " "
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    out[g] += 1
        return out if len(s) > 2 else {}

    def order(counts, size):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))][:size]

    import zlib

    for size in (20, 300):
        sums = defaultdict(lambda: defaultdict(int))
        for i, t, k in d:
            if zlib.crc32(str(i).encode()) % 3 != 1 and t is not None and k is not None:
                for g, n in grams(t).items():
                    sums[k][g] += n
        profiles = {k: order(v, size) for k, v in sums.items()}
        got = {x["doc_id"]: x for x in l.identify(spark.createDataFrame(d, "doc_id long, text string, lang string"), size).collect()}
        for i, t, _ in d:
            own = order(grams(t), size)
            far = min((sum(abs(p.index(g) - j) if g in p else size for j, g in enumerate(own)), k) for k, p in profiles.items())
            want = ("und", 0.0) if not own else (far[1], max(0.0, 1 - far[0] / (size * len(own))))
            assert (got[i]["lang_pred"], pytest.approx(got[i]["score"])) == want and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_out_of_place_distance():
    c_ = l.Classifier({"x": [1, 2, 3], "y": [3, 2, 1]}, size=3)
    g, n = l.ngrams("ab")
    assert len(g) == len(set(g)) == 7 and n.sum() == 7
    assert l.ranked(np.array([5, 6, 7]), np.array([1, 3, 3])).tolist() == [6, 7, 5]
    assert c_("zz")[1] == 0.0 and c_("1")[0] == "und"


# tokens


def libraries():
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bb.tokenizer(path, P.PATTERN)


def everywhere():
    """Every character of the first two planes (of the long uniform blocks one in 50) beside letters, numbers, blanks and marks."""
    uniform = ((0x3400, 0x9FF0), (0xAC10, 0xD790), (0xE010, 0xF8F0), (0x17010, 0x18CC0), (0x1FBFA, 0x1FFFF))
    codes = [chr(x) for x in range(1, 0x20000) if not 0xD800 <= x < 0xE000 and (x % 50 == 0 or not any(a <= x < b for a, b in uniform))]
    codes += [chr(x) for a in (0x20000, 0x2EBE0, 0x30000, 0x32300, 0xE0000, 0x10FF00) for x in range(a, a + 0x100)]
    for i in range(0, len(codes), 1000):
        yield "".join(f"a{x}b 1{x}2 {x}. {x},  {x}" for x in codes[i : i + 1000])


def test_byte_bpe_is_tiktoken():
    library, own = libraries()
    texts = [*mixed(7, 800, 90), "a" * 3000, "xyzzy" * 500, " " * 100, "", "it's  the\n\n end ", "éé" * 400, "<|endoftext|>", "\U0003f65a\u9902", "x\xa0  y\u3000\n z", *everywhere()]
    for t, ids in zip(texts, own.encode_column(pa.array(texts))):
        assert ids.tolist() == library.encode_ordinary(t) and own.decode(ids.tolist()) == t.encode()
        assert own.decimal(ids) == " ".join(map(str, ids.tolist())).encode()


def test_byte_bpe_of_random_characters():
    library, own = libraries()
    r = random.Random(3)
    codes = [chr(x) for x in range(1, 0x30000) if not 0xD800 <= x < 0xE000]
    texts = ["".join(r.choice(codes if r.random() < 0.5 else ODD) for _ in range(r.randint(0, 12))) for _ in range(20_000)]
    assert [x.tolist() for x in own.encode_column(pa.array(texts))] == [library.encode_ordinary(t) for t in texts]


def test_merges_side_by_side_are_merges_alone():
    m, r = bb.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).merges, random.Random(8)
    some = sorted({bytes(r.choice(b"abcdeth s\xc3\xa9") for _ in range(r.randint(2, 32))) for _ in range(500)})
    some = [p for p in some if p not in m.ranks]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.many(some, 32)] == [m.one(p) for p in some]


def test_tokens_of_documents(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    d = docs(spark, "hello world", None, "", "hello world")
    rows = {r["doc_id"]: r for r in bb.digest_documents(d, path).collect()}
    assert (rows[0]["n_tokens"], rows[1]["n_tokens"], rows[1]["ids_sha256"]) == (2, 0, hashlib.sha256(b"").hexdigest())
    assert rows[0]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest() and rows[0]["ids_sha256"] == rows[3]["ids_sha256"]
    back = {r["doc_id"]: bytes(r["content"]) for r in bb.decode_documents(bb.encode_documents(d, path), path).collect()}
    assert back == {0: b"hello world", 1: b"", 2: b"", 3: b"hello world"}
    assert bb.digest_documents(d.limit(0), path).count() == 0


def test_words_are_cut_in_bounded_memory():
    """Workers of the pipeline's last stage shared an executor of 3000 MB with what they hold while they cut and remember words."""
    words = [f"w{i:x}" for i in range(3000)]
    texts = pa.array([" ".join(words)] * 400)  # 5.5 MB of text in one batch
    assert max(s.nbytes for s in portions(texts)) < 1.1 * (1 << 20)
    assert sum(len(s) for s in portions(texts)) == len(texts)
    stretches, memory = b.Words(), Memory(lambda some: {w: w[:1].ljust(4, b"\0") for w in some})
    tracemalloc.start()
    assert sum(map(len, encode_texts(texts, stretches, memory))) == 3000 * 400
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_word_ids_are_the_library_s():
    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), b.word_ids(path)
    r = random.Random(12)
    codes = [chr(x) for x in range(1, 0x30000) if not 0xD800 <= x < 0xE000]
    drawn = ["".join(r.choice(codes if r.random() < 0.5 else ODD) for _ in range(r.randint(0, 12))) for _ in range(5_000)]
    texts = [*mixed(11, 800, 60), "It's A Stop. a, b.c", "x <|endoftext|> y<|startoftext|>z.", "ΑΣ İstanbul.", "\u0f52.", "क़. क़,", *drawn, *everywhere()]
    for t, ids in zip(texts, own.encode_column(pa.array(texts))):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)[:200]


def test_matching_fills_and_never_overflows():
    r = random.Random(6)
    for size in (10, 64):
        census = defaultdict(int)
        for _ in range(300):
            census[r.randint(1, size)] += 1
        matches, opened = b.match_classes(dict(census), size)
        used, ranks = defaultdict(list), defaultdict(set)
        for length, rank, n, first, offset in matches:
            for i in range(n):
                used[first + i].append((offset, length))
                assert rank + i not in ranks[length]
                ranks[length].add(rank + i)
        assert {k: len(v) for k, v in ranks.items()} == dict(census)
        assert len(used) == opened <= 1.1 * sum(k * v for k, v in census.items()) / size + 1
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    texts = ["hello world", None, "", "a b c " * 3000, *[f"word{i} " * (i % 90) for i in range(300)]]
    d = docs(spark, *texts).repartition(5)
    rows = b.pack(b.token_pieces(d, path)).collect()
    library, by_doc, by_seq = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    import zlib

    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(by_doc[i], key=lambda x: x["piece"])):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
        assert sum(r["length"] for r in by_doc[i]) == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda x: x["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(by_seq) == -(-sum(r["length"] for r in rows) // 4096)
    assert b.pack(b.token_pieces(d.limit(0), path)).count() == 0


def test_components_of_random_graphs(spark, monkeypatch):
    from tracepath.llm import components as cc

    r = random.Random(13)
    for n, m, most in ((300, 200, 10**6), (300, 280, 40), (50, 400, 8)):
        monkeypatch.setattr(cc, "MOST_HELD", most)
        pairs, label = [(r.randrange(n), r.randrange(n)) for _ in range(m)], list(range(n))
        for _ in range(n):
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        got = cc.connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
        assert {x["node"]: x["component"] for x in got} == {x: label[x] for x, y in pairs + [p[::-1] for p in pairs] if x != y}
        u, v = cc.stars(*np.array(pairs).T)
        assert dict(zip(v.tolist(), u.tolist())) == {i: label[i] for i in range(n) if label[i] != i}


def test_components_of_few_edges_take_few_jobs(spark):
    from tracepath.llm import components as cc

    r = random.Random(14)
    ids = r.sample(range(10**6), 3000)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").repartition(30)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = cc.connected_components(edges).collect()
    print("jobs", jobs() - before)
    assert len(got) == 3000 and {x["component"] for x in got} == {min(ids)}
    assert jobs() - before <= 12  # the driver keeps a record of each task of each
