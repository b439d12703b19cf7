"""The keyword pass of the license scan loses no detection that the rules alone would make."""

import re
from re import _parser

import pytest

from tradelens.llm import licenses


def example(pattern, most, branch):
    """A text that ``pattern`` matches: optional parts taken or not, and of alternatives the one numbered ``branch``."""
    out = []
    for op, value in pattern:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "ANY":
            out.append("x")
        elif name == "ASSERT":
            out.append(example(value[1], most, branch))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = value
            out.append(example(part, most, branch) * max(low, most and 1))
        elif name == "SUBPATTERN":
            out.append(example(value[3], most, branch))
        elif name == "BRANCH":
            out.append(example(value[1][branch % len(value[1])], most, branch))
        elif name == "IN":
            kind, first = value[0]
            out.append({"LITERAL": lambda: chr(first), "RANGE": lambda: chr(first[0]), "CATEGORY": lambda: "\n" if str(first) == "CATEGORY_SPACE" else "x", "NEGATE": lambda: "x"}[str(kind)]())
        else:
            assert name in ("ASSERT_NOT", "AT"), name
    return "".join(out)


def test_keyword_pass_loses_nothing():
    rules = licenses.rules()
    for rule in rules:
        for most in (False, True):
            for branch in range(6):
                text = example(_parser.parse(rule.pattern.pattern), most, branch)
                assert rule.pattern.search(text), text
                alone = {
                    licenses.Detection(m.start(), m.end(), r.label, r.priority, r.confidence)
                    for r in rules if r.label == rule.label for m in r.pattern.finditer(text)
                }
                covered = licenses.detect(text)
                assert all(any(c.start <= d.start and d.end <= c.end for c in covered) for d in alone), text


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Released under Apache 2.0", "apache-2.0"), ("distributed under the MIT/X11", "mit"), ("available under CC BY 4.0", "cc-by-4.0"),
        ("https://www.mozilla.org/MPL/2.0/", "mpl-2.0"), ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0-1.0"),
        ("http://wtfpl.net", "wtfpl"), ("https://scripts.sil.org/OFL", "ofl-1.1"), ("provided under the PNG Reference Library", "libpng"),
    ],
)
def test_texts_without_the_word_license(text, label):
    assert not re.search("licen|spdx|public domain", text.lower())
    assert [d.label for d in licenses.detect(text)] == [label]


def ungated(text):
    """All rules run on the text, without the keyword pass."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = {licenses.Detection(m.start(), m.end(), r.label, r.priority, r.confidence) for r in licenses.rules() for m in r.pattern.finditer(lower)}
    found |= set(licenses.other_detections(lower))
    kept = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    return sorted(kept)


def test_whole_scan_equals_all_rules_ungated():
    from test_license_texts import TEXTS
    from test_operators import corpus

    short = [
        "released under the MIT.", "Distributed under the BSD 3-clause", "released under CC BY-SA 4.0", "creativecommons.org/publicdomain/zero/1.0",
        "see wtfpl.net", "eclipse.org/legal/epl-2.0", "www.mozilla.org/MPL/2.0", "the Apache\n  Licence, version 2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC",
        "the GNU Lesser General\n# Public License, version 2.1", "used for Good,\n// not Evil: the Software shall be used for Good,\n// not Evil.",
    ]
    for text in short:
        assert licenses.detect(text), text
    for text in [*short, *(t for t, *_ in TEXTS), *(r[1] or "" for r in corpus()), " ".join(short * 3)]:
        assert licenses.detect(text) == ungated(text), text


def test_scan_of_a_long_text_is_linear():
    import time

    start = time.time()
    n, places = licenses.base_scan("the mit license and " * 500_000)  # ten million characters
    assert n == 2_000_000 and len(places) == 500_000 and places[-1] == (1_999_997, "mit")
    assert time.time() - start < 20
