import random
import re
import zlib

from tracepath.llm.spelling import corpus_words, near_pairs, op12_spelling_variants, variants


def words_of(rows):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def by_hand(n, near=None):
    """Each word against all others."""
    out = {}
    near = near or {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_words_and_variants_equal_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdeéßÀ") for _ in range(r.randint(6, 9))) for _ in range(60)]

    def edited(w):
        at, c = r.randrange(len(w)), r.choice("abcdeéÀ")
        return r.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:], w.upper()])

    rows = [(r.choice([None, i, i]), " ".join(edited(r.choice(base[: 1 + r.randrange(60)])) for _ in range(r.randint(0, 200))) + r.choice(["", "ő", "7"])) for i in range(150)]
    rows += [(1, None), (None, None), (2, ""), rows[5], rows[5], (7, "abcdefgh " * 50_000), (8, "x" * 100_000 + " " + "y" * 100_001)]
    docs = spark.createDataFrame([(t, 0, i, "n") for i, t in rows], "text string, word int, doc_id long, n string")
    n = words_of(rows)
    assert {w.word: w.n for w in corpus_words(docs).collect()} == n
    expected = by_hand(n)
    assert any(v[2] for v in expected.values())
    assert as_dict(variants(corpus_words(docs))) == expected


def test_pairs_at_every_place_and_both_ways(spark):
    word = "abcdefghij"
    others = [word[:i] + word[i + 1 :] for i in range(10)] + [word[:i] + "z" + word[i + 1 :] for i in range(10)] + [word[:i] + "z" + word[i:] for i in range(11)]
    far = ["abcdefghji", "zbcdefghiz", "abcdefgh", "abcdefghijzz"]
    table = spark.createDataFrame([(w, 2) for w in [word, *others, *far]], "word string, n long")
    pairs = [(r.a, r.b) for r in near_pairs(table).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in [word, *others, *far] for b in [word, *others, *far] if one_edit(a, b)}


def test_forms_run_on_to_the_last_and_ties_go_to_the_smallest(spark):
    n = {"aaaaaaaab": 2, "aaaaaaabb": 20, "aaaaaabbb": 200, "aaaaabbbb": 2000, "ccccccd": 2, "ccccccf": 30, "cccccce": 30, "zzzzzzz": 9}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = as_dict(variants(table))
    assert got == by_hand(n)
    assert got["aaaaaaaab"] == (2, 1, "aaaaaaabb", 20, "aaaaabbbb") and got["ccccccd"][2] == "cccccce" and got["zzzzzzz"] == (9, 0, None, None, "zzzzzzz")
    assert as_dict(variants(table.where("n < 0"))) == {}


def test_many_variants_of_one_word(spark):
    word = "w" * 12
    n = {word: 100_000} | {word[:i] + c + word[i + 1 :]: 2 for i in range(12) for c in "abcdefghijklmnopqrstuv"}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_dict(variants(table)) == by_hand(n)


def test_the_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    n = words_of(rows)
    # deleting one letter of each word finds all pairs
    holes = {}
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(x, []).append(w)
    near = {w: {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in holes[x] if one_edit(w, v)} for w in n}
    assert as_dict(op12_spelling_variants(spark, d)) == by_hand(n, near)
