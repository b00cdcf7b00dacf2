"""License scans against every way to expand a template, and rows against a plain scan."""

import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import licenses

MIT = dict(licenses.LICENCES)["mit"]


def plain(markup, hole="x y"):
    """A text of the template: optional regions out, replaceable ones filled."""
    return re.sub(r"<<\d+>>", hole, re.sub(r"\[\[.*?\]\]", "", markup))


@pytest.mark.parametrize(("label", "markup"), licenses.TEMPLATES)
def test_whole_texts_are_accepted_and_any_change_is_not(label, markup):
    text = plain(markup)
    assert label in licenses.scan_text(f"Copyright 2020 Jane. {text} The end.")[3] and licenses.scan_text(text)[4] == 1.0
    words = text.split()
    fixed = {w.lower().encode() for w in re.findall(r"\w+", re.sub(r"<<\d+>>|\[\[.*?\]\]", " ", markup))}
    for k in range(3, len(words), 7):
        if re.sub(r"\W", "", words[k]).lower().encode() not in fixed or not re.search(r"\w", words[k]):
            continue
        changed = " ".join(words[:k] + ["rewritten"] + words[k + 1 :])
        own = licenses.Automaton(markup)
        body = licenses.WORDS.findall(changed.encode().lower())
        assert all(own.run(body, at) < 1 for at in range(len(body)))


def expansions(markup, words):
    """Every sequence of words that the template accepts, replaceable regions filled from words."""
    parts = []
    for region in re.findall(r"\[\[.*?\]\]|<<\d+>>|\w+", markup):
        if region.startswith("[["):
            parts.append([[], region[2:-2].split()])
        elif region.startswith("<<"):
            parts.append([list(x) for n in range(int(region[2:-2]) + 1) for x in itertools.product(words, repeat=n)])
        else:
            parts.append([[region]])
    return {tuple(itertools.chain(*x)) for x in itertools.product(*parts)}


MARKUP = "a b [[ c d ]] <<2>> a [[ b ]] c"
ACCEPTED = expansions(MARKUP, "abcd")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12))
def test_automaton_accepts_just_the_expansions(words):
    own = licenses.Automaton(MARKUP)
    got = own.run([w.encode() for w in words], 0)
    assert (got == 1.0) == any(tuple(words[:n]) in ACCEPTED for n in range(len(words) + 1)) and 0 <= got <= 1


def test_rows_equal_a_plain_scan(spark):
    r = np.random.default_rng(5)
    parts = ["word", "Under the MIT license.", "apache License, version 2", "CC BY-NC", "cc by nc", plain(MIT), plain(MIT).replace("Software", "Program"), "licensed under the Apache License, Version 2.0", "ÉTÉ été", "under the", "SPDX-License-Identifier: ISC", "1.0"]
    rows = [(k, " ".join(r.choice(parts, r.integers(0, 12)))) for k in range(200)] + [(None, None), (3, ""), (3, ""), (None, "cc by nc")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, labels string")
    want = []
    for i, text in rows:
        words = re.findall("[0-9a-z\\u0080-\\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        found = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        more = {label for label, a in licenses.automata() for k in range(len(words)) if a.run([w.encode() for w in words], k) == 1.0}
        at, base = [k for k, _ in found], {x for _, x in found}
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))))
    got = [tuple(x)[:-1] for x in licenses.scan_licenses(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and licenses.scan_licenses(docs.where("false")).count() == 0


def test_many_places_take_linear_time():
    took = []
    for n in (4_000, 32_000):
        text, began = "cc by nc word " * n, time.perf_counter()
        assert licenses.scan_text(text)[:2] == (4 * n, list(range(0, 4 * n, 4)))
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]
