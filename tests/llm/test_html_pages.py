"""Pages that no class names tell about, and Viterbi against all labellings."""

import itertools

import numpy as np
import pytest

from lumenline.llm import html_extraction as H

LONG = "One two three four five six seven eight nine ten eleven twelve thirteen."
HEAD = "<h1>A title of it</h1>"
TEXT = f"A title of it\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article>{HEAD}<p>{LONG}<p>{LONG}</article><div>Copyright 2020 X</div>", TEXT),
        (f"<div>{HEAD}<p>{LONG}</p><p>{LONG}</p></div><div>All rights reserved. Copyright 2020 X</div>", TEXT),
        (f"<ul><li><a href=x>Home</a><li><a href=y>About</a></ul><div>{HEAD}<p>{LONG}</p><p>{LONG}</p></div><div>© 2020 X</div>", TEXT),
        (f"<article>{HEAD}<p>{LONG}</p><button>Click</button><p>{LONG}</p></article>", TEXT),
        (f"<article>{HEAD}<p>{LONG}</p><p>The copyright of all works was his. {LONG}</p></article>", f"A title of it\n{LONG}\nThe copyright of all works was his. {LONG}"),
    ],
)
def test_pages_without_class_names(html, want):
    assert H.main_text(html, H.trained()) == want


def test_viterbi_equals_enumeration():
    dice = np.random.default_rng(2)
    blocks = [b for page, _ in H.labelled_pages(12, 3) for b in page]
    for n in range(1, 9):
        field = H.Field(dice.normal(size=(len(H.FEATURES), 2)), dice.normal(size=(2, 2)), dice.normal(size=2))
        own = blocks[n : 2 * n]
        s = field.scores(own)
        total = lambda y, f=field, s=s: f.start[y[0]] + sum(s[t, k] for t, k in enumerate(y)) + sum(f.moves[a, b] for a, b in itertools.pairwise(y))
        assert field.decode(own) == list(max(itertools.product((0, 1), repeat=n), key=total))
