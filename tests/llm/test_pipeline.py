"""The corpus pipeline over a small table with every kind of row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tracepath.llm import near_copies as nc
from tracepath.llm.simhash_dedup import fingerprint


def corpus(spark):
    prose = " ".join(f"some{i % 97} word{i % 89} here{i}" for i in range(400))
    near = prose.replace("here200", "there")
    rows = [(0, prose), (1, prose), (2, near), (3, "12345 !!"), (4, None), (5, "other text token = abcdef0123456789abcd end"), (6, "yet more words to read here")]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")


def test_stages(spark):
    docs = corpus(spark)
    docs = p.language_id(spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, 2, 5, 6}
    docs = p.exact_dedup(spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} == {1, 2, 5, 6}
    docs = p.simhash_dedup(spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} == {1, 5, 6}
    docs = p.secret_scan(spark, docs, "")
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got[5]["text"] == "other text [secret] end" and got[5]["n_chars"] == 23 and tuple(docs.columns) == p.COLUMNS
    assert {r["doc_id"] for r in p.best_fit_pack(spark, docs, "").collect()} == {1, 5, 6}


def test_run_and_empty(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).agg(F.count_distinct("doc_id")).first()[0] == 3
    (tmp_path / "none").mkdir()
    corpus(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def edited(seed, groups=12, copies=12):
    """Groups of texts with more and more words of a first one changed, at similarities on both sides of 0.8."""
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(9999)}" for _ in range(r.randint(30, 300))]
        out.append(" ".join(base))
        for i in range(copies):
            words = list(base)
            for _ in range(round(len(words) * i / copies / 15)):
                words[r.randrange(len(words))] = f"x{r.randrange(9999)}"
            out.append(" ".join(words))
    return list(dict.fromkeys(out))


def least_of_components(texts):
    """By brute force over all pairs: for each text the first one that links of similarity 0.8 lead to."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) * 10 >= len(x | y) * 8 and up[i] != up[j]:
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    return up


@pytest.mark.parametrize("block", [nc.BLOCK, 5000, 1500])
def test_near_stage_finds_what_brute_force_finds(spark, block):
    texts = edited(3)
    want = least_of_components(texts)
    assert 12 < len(set(want)) < len(texts) - 40
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in nc.first_copies(docs, block).collect()} == set(want)
    if block == nc.BLOCK:
        assert {r["doc_id"] for r in p.simhash_dedup(spark, docs, "").collect()} == set(want)


def test_jaccard_links_at_the_limit():
    a = np.arange(9, dtype=np.uint64)
    assert nc.jaccard_links([a[:5], a[:4], a[5:8], np.empty(0, np.uint64), np.empty(0, np.uint64)]) == [(0, 1), (3, 4)]
    assert nc.jaccard_links([a[:5], a[1:6]]) == [] and nc.jaccard_links([]) == []


def test_numbers_say_what_is_linked_and_leave_nothing_out():
    a = np.arange(9, dtype=np.uint64)
    assert nc.jaccard_links([a[:5], a[:4], a[5:8]], [1, 2, 2]) == [(0, 1)]
    assert nc.jaccard_links([a[:5], a[:4], a[5:8]], [1, 2, 2], [False, True, False]) == [(1, 0)]


def test_what_is_similar_to_different_pivots_is_compared(spark):
    """Windows along a text, linked to the next two: two pivots, first and second by number, take all of them in, and the only links from one's to the
    other's are between members."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[5 * i : 5 * i + 104]) for i in (2, 7, 0, 1, 3, 4, 5, 6, 8, 9)]
    far = " ".join(f"v{i}" for i in range(104))
    rows = [(n, f"{2 * n + k}", f"{t} end{k}") for n, t in enumerate([*texts, far]) for k in range(2)]
    nodes = [(n + (len(texts) + 1) * k, sha, t) for (n, sha, t), k in zip(rows, [0, 1] * len(rows))]
    docs = spark.createDataFrame([(i, t) for i, _, t in nodes], "doc_id long, text string")
    classes = spark.createDataFrame([(i, t, len(t)) for i, _, t in nodes], "node long, text string, size long").withColumn("sha256", nc.content_key())
    candidates = classes.select("node", F.lit(0).cast("long").alias("component"))
    for block in (1 << 20, 3000, 1000):
        up = {i: i for i, _, _ in nodes}
        for a, b in nc._verified(docs, classes, candidates, block).collect():
            x, y = up[a], up[b]
            up = {i: min(x, y) if u in (x, y) else u for i, u in up.items()}
        groups = {}
        for i, u in up.items():
            groups.setdefault(u, set()).add(i % (len(texts) + 1))
        assert sorted(map(sorted, groups.values())) == [list(range(len(texts))), [len(texts)]], block


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"some{i % 97} {w}{i % 89} here{i}" for i in range(60)) for w in ("word", "thing", "place"))
    near_c = c.replace("here59", "there")
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "r"), (7, c, "s"), (7, c, "s"), (7, "other words", "s"), (7, a + " more of it all to read", "s"), (9, near_c, "s"), (9, "other words", "s"), (None, near_c, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def left(df):
        return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)

    docs = p.language_id(spark, docs, "")
    assert left(docs) == sorted(rows, key=str)
    exact = p.exact_dedup(spark, docs, "")
    want = [(None, a, "s"), (None, b, "r"), (7, c, "s"), (7, a + " more of it all to read", "s"), (9, near_c, "s"), (9, "other words", "s")]
    assert left(exact) == sorted(want, key=str)
    near = [(None, b, "r"), (7, c, "s"), (7, a + " more of it all to read", "s"), (9, "other words", "s")]
    assert left(p.simhash_dedup(spark, exact, "")) == sorted(near, key=str)
    # without exact dedup before it, the smallest id of a text counts
    assert left(p.simhash_dedup(spark, docs, "")) == sorted([*near[:3], (7, "other words", "s")], key=str)
    spoken = docs.withColumn("text", F.concat("text", F.lit(" token = abcdef0123456789abcd")))
    assert left(p.secret_scan(spark, spoken, "")) == sorted(((i, t + " [secret]", s) for i, t, s in rows), key=str)
    packed = p.best_fit_pack(spark, docs, "").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in packed} == {None: 4, 7: 4, 9: 2}


def test_simhash_gives_candidates_of_its_own(spark):
    """No further fingerprint is shared here: only differing bits join texts, up to four, also through others."""
    rows = [(0, 0b0, [1]), (1, 0b1111, [2]), (2, 0b11111111, [3]), (3, 0b11111 << 40, [4]), (4, 1 << 62, [5]), (5, 1 << 62, [6])]
    classes = spark.createDataFrame(rows, "node long, fp long, keys array<long>")
    groups = {}
    for r in nc._candidates(classes).collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 4, 5]]
    text = " ".join(f"some{i % 97} word{i % 89} here{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert sorted(r["fp"] for r in nc._classes(docs).collect()) == sorted([0, int(np.uint64(fingerprint(text, 5)).astype(np.int64))])
