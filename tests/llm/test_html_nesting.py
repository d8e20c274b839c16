import random
import time
import tracemalloc

import numpy as np
import pytest

from tessera.llm import html


def naive(block):
    """The features of a block by walking up from it."""
    path, e = [], block.element
    while e is not None:
        path.insert(0, e)
        e = e.parent
    tags = [e.tag for e in path]
    out = {f"name:{n}" for e in path for n in e.names} | {f"in:{t}" for t in tags if t not in ("html", "body", "div")}
    if inner := [t for t in tags if t in html.BLOCKS]:
        out.add(f"tag:{inner[-1]}")
    holders = [i for i, t in enumerate(tags) if t in ("article", "main")]
    if holders:
        out |= {f"within:{t}" for t in tags[holders[-1] + 1 :] if t in html.BLOCKS}
    return out


def test_shared_paths_as_walks():
    r = random.Random(3)
    tags = "div p ul li article main section span a b nav td table tr footer svg title".split()
    for _ in range(60):
        page = "".join(r.choice([f'<{(t := r.choice(tags))} class="{r.choice("ad post x menu".split())}">', f"</{r.choice(tags)}>", "some text. ", "<br>"]) for _ in range(60))
        paths = html.Paths(lambda f: f)
        for b in html.blocks(page):
            assert paths(b.element) == naive(b)


def test_scores_and_labels_as_all_labelings():
    field = html.default_field()
    for page, _ in html.training_pages(30, seed=11):
        own = html.blocks(page)[:8]
        each = np.array([field.weights[[field.names[f] for f in [*html.own_features(b), *naive(b)] if f in field.names]].sum(axis=0) for b in own])
        assert np.allclose(field.scores(own), each)
        best = max(np.ndindex(*[2] * len(own)), key=lambda y: sum(each[i, k] for i, k in enumerate(y)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert field.decode(own) == list(best)


@pytest.mark.parametrize("page", ["<div>a" * 170_000, "<title>x" * 125_000, "<li><b>x" * 125_000, "<a x" * 250_000, "<p>a<span>" * 100_000, "</x><i>" * 140_000, "<!-- a" * 160_000])
def test_a_megabyte_of_odd_html(page):
    began = time.time()
    tracemalloc.start()
    html.main_text(page, html.default_field())
    assert tracemalloc.get_traced_memory()[1] < 800 << 20
    tracemalloc.stop()
    assert time.time() - began < 90


def test_unclosed_elements_keep_the_rest():
    for tag in ("svg", "noscript", "object", "math", "iframe", "template"):
        found = html.blocks(f"<article><p>One two.</p><{tag}><p>Three four.</p></article>")
        assert [b.text for b in found] == ["One two.", "Three four."], tag
    assert [b.text for b in html.blocks("<article><noscript><p>In it.</p></noscript><p>On.</p>")] == ["In it.", "On."]
    assert [b.text for b in html.blocks("<p>One.</p><script>var a = 1; <p>no</p>")] == ["One."]
    assert [b.text for b in html.blocks("a < b and <")] == ["a < b and <"]
