"""Main text of pages: what HTML says of its own elements, links and looks, and the scan against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_limits import f1, truth

from millrace.llm import html, page_families


def prose(k):
    return " ".join(f"word{k}x{i}" for i in range(40)) + "."


A, B, C, D = map(prose, range(4))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>Head line</h1><p>{A}</p><p>{B}</p></article><aside><p>{C}</p></aside>", f"Head line {A} {B}"),
        (f"<main><h1>Head line</h1><p>{A}</p><aside><p>{C}</p></aside><p>{B}</p></main>", f"Head line {A} {B}"),
        (f"<article><h1>Head line</h1><p>{A}</p><form><p>Please tell us what you think about all of this</p><button>Send</button></form><p>{B}</p></article>", f"Head line {A} {B}"),
        (f"<article><h1>Head line</h1><p>{A}</p><div><p>Get our letter every week for free</p><form><input></form></div><p>{B}</p></article>", f"Head line {A} {B}"),
        (f"<article><h1>Head line</h1><p>{A}</p><p>{B}</p><section class='comments'><h2>Comments</h2><p>{C}</p><p>{D}</p></section></article>", f"Head line {A} {B}"),
        (f"<nav><a>a</a></nav><article><h1>Head line</h1><p>{A}</p><p><a href='x'>{B}</a></p><p>{C}</p></article>", f"Head line {A} {B} {C}"),
        ("<nav><a>a</a></nav><article><h1>H</h1>" + "".join(f"<p><a href='x'>{prose(i)}</a></p>" for i in range(12)) + "</article>", "H " + " ".join(map(prose, range(12)))),
        (f"<center><p>{A}</p><p>{B}</p></center>", f"{A} {B}"),
        (f"<div class='press-tags'><h1>Head line</h1><p>{A}</p></div>", f"Head line {A}"),
        (f"<div class='market-share-report'><h1>Head line</h1><p>{A}</p></div>", f"Head line {A}"),
        (f"<body><form id='f'><div><a>x</a> <a>y</a></div><div><h1>Head line</h1><p>{A}</p><p>{B}</p></div></form></body>", f"Head line {A} {B}"),
    ],
)
def test_contract_cases(page, text):
    assert html.main_text(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-20, 20), max_size=30))
def test_the_scan_finds_the_best_region(values):
    scores = [v / 4 for v in values]
    begin, end = html.best_region(scores)
    every = [sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)]
    assert sum(scores[begin:end]) == max(every)


def test_scan_of_pages_equals_all_regions():
    weights = html.default()
    for page in page_families.pages(each=1, seed=5):
        found, blocks = html.pieces(page, weights.kinds)
        scores, kept = html.scored(found, blocks, weights)
        sums = [0.0]
        for s in scores:
            sums.append(sums[-1] + s)
        best = max(sums[j] - least for j, least in ((j, min(sums[: j + 1])) for j in range(len(sums))))
        begin, end = html.best_region(scores)
        assert abs(sum(scores[begin:end]) - best) < 1e-9
        text = " ".join("".join(p.text for p, k in zip(found[begin:end], kept[begin:end], strict=True) if k).split())
        assert html.main_text(page) == text


def test_families_that_training_never_saw_each():
    names, rng = list(page_families.FAMILIES), random.Random(3)
    for name in rng.sample(names, 12):
        weights = html.train(page_families.pages([n for n in names if n != name]))
        held = page_families.pages([name], seed=98)
        assert sum(f1(html.main_text(p, weights), truth(p)) for p in held) / len(held) >= 0.8, name


def test_a_page_of_many_megabytes():
    page = "<nav>" + "<a>x</a>" * 1000 + "</nav><article>" + f"<p>{A}</p>" * 8000 + "</article>"
    assert html.main_text(page) == " ".join([A] * 8000)
