"""Words that look like a licence's name, names with suffixes, long notices of other licences, short headers."""

import random

import pytest

from tracepath.llm import license_scan as ls

SCAN = ls.Scanner().scan


@pytest.mark.parametrize("word", ["bit", "kit", "mid", "nit", "sit", "fit", "emit", "it", "mint", "limit", "omit", "summit", "admit"])
def test_words_of_the_language_are_no_licence(word):
    for text in (f"released under the {word} license", f"we met under the {word} license plate", f"under the {word} license"):
        got = SCAN(text)
        assert (got["labels"], got["score"], got["spans"]) == ("", 0.0, ""), text


@pytest.mark.parametrize(
    "text,labels",
    [
        ("released under the mit-0 license", "mit-0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files", "mit"),
        ("Permission to use, copy, modify, and distribute this software for any purpose", ""),
        ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that", ""),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above", "isc"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ""),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
        ("cc by nc nd", "cc-by-nc,cc-by-nc-nd"),
        ("Apache License 2.0", "apache-2"),
        ("Apache-2.0", "apache-2"),
        ("apache 2 000 horses", ""),
        ("GNU General Public License v2.0", "gpl-2"),
        ("GNU General Public License v3", "gpl-3"),
        ("GNU General Public License v1", ""),
        ("GNU GPL version 3", "gpl-3"),
        ("GNU GPL v2", "gpl-2"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: ISC", ""),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ],
)
def test_each_notice_by_what_tells_it(text, labels):
    assert SCAN(text)["labels"] == labels
    assert SCAN(f"a b c {text} d e f")["labels"] == labels


def edits_within(text, phrase):
    """The least number of edits between the phrase and any stretch of the text, by a table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(phrase, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != x))
    return min(row)


def test_verified_edits_equal_a_table_over_the_whole_text():
    r = random.Random(12)
    for _ in range(150):
        n = r.choice(ls.NOTICES)
        t = list(n.text)
        for _ in range(r.randint(0, n.edits + 2)):
            i = r.randrange(len(t))
            t[i : i + r.randint(0, 1)] = r.choice(["", "x", " ", "qq"])
        s = ls.normal_words(f"alpha {''.join(t)} omega")
        found = [x for x in SCANNER.search(s, [f for f in SCANNER.notices if f[0] is n])]
        least = edits_within(s.decode(), n.text)
        assert bool(found) == (least <= n.edits)
        assert not found or min(x[3] for x in found) == least


SCANNER = ls.Scanner()
