import hashlib
import random

import numpy as np
import pytest

from tracepath.llm.repeats import anchored_runs, merged, op13_suffix_dedup, remove_repeats, windows_met_twice
from tracepath.llm.suffix_collection import Collection


def by_hand(docs, length):
    """Each window looked up among all that start earlier."""
    docs = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for i, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, docs, parts=5):
    return spark.createDataFrame([("x", i, t, 1) for i, t in docs], "content string, doc_id long, text string, t int").repartition(parts)


@pytest.mark.parametrize("seed", range(60))
def test_suffixes_and_common_prefixes_equal_a_sort(seed):
    r = random.Random(seed)
    letters = bytes(r.sample(range(256), r.choice([1, 2, 3, 20])))
    texts = [bytes(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 9))]
    texts += [texts[0]] * r.choice([0, 0, 3])
    c = Collection(texts, chunk=r.choice([1, 2, 3, 7, 1000]))
    got = [(int(d), int(n), int(p)) for part in c.chunks() for d, n, p in zip(*part)]
    order = sorted(((i, n) for i, t in enumerate(texts) for n in range(len(t) + 1)), key=lambda x: (tuple(v + 1 for v in texts[x[0]][len(texts[x[0]]) - x[1] :]) + (0, x[0])))
    assert [g[:2] for g in got] == order
    suffixes = [texts[i][len(texts[i]) - n :] for i, n in order]

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert [g[2] for g in got] == [0, *(common(a, b) for a, b in zip(suffixes, suffixes[1:]))]
    c.close()


def test_all_byte_values_and_files_on_disk(monkeypatch):
    import tracepath.llm.suffix_collection as m

    monkeypatch.setattr(m, "SPOOL", 100)
    texts = [bytes(range(256)), bytes(range(128, 256)) + bytes(range(128))]
    c = Collection(texts, chunk=50)
    shared = np.concatenate([p for *_, p in c.chunks()])
    assert shared.max() == 128 and (shared == 128).sum() == 2


def test_every_window_is_in_one_run_and_equal_windows_have_one_anchor():
    r = random.Random(5)
    texts = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 90))) for _ in range(40)] + [b"ab" * 60, b"a" * 70]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    anchors, met = {}, set()
    for text, s, c, anchor, again in zip(*anchored_runs(data, ends, 12, 4)):
        windows = [texts[text][p : p + 12] for p in range(s, s + c)]
        assert 0 < c <= 9 and all(len(w) == 12 for w in windows)
        assert again or len(set(windows)) == len(windows)
        for p, w in enumerate(windows, s):
            assert (text, p) not in met and anchors.setdefault(w, anchor) == anchor
            met.add((text, p))
    assert len(met) == sum(max(0, len(t) - 11) for t in texts)


def test_windows_that_no_other_piece_has_are_cut_off():
    pieces = [b"0123456789", b"xx234567yy", b"qqqqqqqqqq", b"abcdefghij"]
    assert windows_met_twice(pieces, 5) == [(2, 4), (2, 4), (0, 6), (0, 0)]


def test_stretches_that_meet_are_one():
    owner, b, e = merged(np.array([1, 0, 1, 1, 0]), np.array([5, 0, 0, 20, 1]), np.array([9, 9, 5, 30, 3]))
    assert list(zip(owner.tolist(), b.tolist(), e.tolist())) == [(0, 0, 9), (1, 0, 9), (1, 20, 30)]
    assert [len(x) for x in merged(*(np.empty(0, np.int64),) * 3)] == [0, 0, 0]


@pytest.mark.parametrize("hot_from", [2, 5, 10_000])
def test_removed_bytes_equal_brute_force(spark, hot_from):
    r = random.Random(hot_from)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 60))) for _ in range(20)]
    docs = []
    for i in range(150):
        t = "".join(r.choice(base)[r.randint(0, 20) : r.randint(20, 60)] + r.choice(["", "x", "yz", "Ω"]) for _ in range(r.randint(0, 6)))
        docs.append((r.choice([i, i, i, None, 7]), r.choice([t, t, t, None, base[0] * 2])))
    docs += [docs[3], docs[3], docs[4], (900, "ab" * 100), (901, "q" * 300), (902, "q" * 299 + "r"), (903, base[1] * 30)]
    assert rows(remove_repeats(table(spark, docs), length=14, k=5, hot_from=hot_from)) == by_hand(docs, 14)


def test_a_passage_in_many_texts_and_a_very_long_text(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    passage = " ".join(words[:60])
    docs = [(i, f"{' '.join(r.choices(words, k=20))} {passage} {r.choice(words)}") for i in range(120)]
    long = " ".join(r.choices(words, k=40_000))
    docs += [(500, long), (501, long[100_000:180_000] + "!"), (502, "short"), (503, passage), (None, passage)]
    expected = by_hand(docs, 100)
    assert rows(remove_repeats(table(spark, docs))) == expected
    assert rows(remove_repeats(table(spark, docs), hot_from=40)) == expected


def test_empty_table_and_texts_without_windows(spark):
    assert rows(remove_repeats(table(spark, [(1, "a")]).where("doc_id = 2"))) == []
    docs = [(1, None), (1, ""), (2, "a" * 99), (3, "a" * 99), (3, "a" * 99)]
    assert rows(remove_repeats(table(spark, docs))) == by_hand(docs, 100)


def test_the_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert rows(op13_suffix_dedup(spark, d)) == by_hand(docs, 100)


def test_shuffled_runs_are_gone_when_pieces_are_shuffled(spark):
    import time

    r = random.Random(15)
    docs = spark.createDataFrame([(i, "".join(map(chr, r.choices(range(33, 127), k=4000)))) for i in range(600)], "doc_id long, text string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> int:
        return sum(f.length() for f in (files.apply(i) for files in [disk.getAllFiles()] for i in range(files.size())) if f.getName().startswith("shuffle_"))

    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffled()
    out = remove_repeats(docs)
    until = time.time() + 10
    while (left := shuffled() - before) > 100_000 and time.time() < until:
        time.sleep(0.2)
    assert left <= 100_000
    assert out.count() == 600
    assert 2_000_000 < shuffled() - before < 3_600_000  # 2.4 MB of texts that don't compress, once
