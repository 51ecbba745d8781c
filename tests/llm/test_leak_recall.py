import random

import pyarrow as pa
import pytest

from umbra.llm import decontamination
from umbra.llm.kernels import Words, utf8

VOCAB = [f"w{i}" for i in range(3000)]


def edited(words, kind, n, r):
    w = list(words)
    front = kind == "front insertions"
    for _ in range(n):
        p = r.randrange(int(len(w) * 0.45) if front else len(w))
        what = r.choice(["replace", "insertions", "deletions"]) if kind == "mixed" else kind
        w[p : p + ("insert" not in what)] = [] if what == "deletions" else [r.choice(VOCAB)]
    return w


def recall(length, kind, trials=80):
    r = random.Random(length)
    items = [(i, " ".join(r.choices(VOCAB, k=length))) for i in range(trials)]
    index = decontamination._Index(items, decontamination.TOLERANCE)
    texts = [" ".join(r.choices(VOCAB, k=30) + edited(t.split(), kind, int(0.2 * length), r) + r.choices(VOCAB, k=30)) for _, t in items]
    w = Words(*utf8(pa.array(texts)), lower=True, alnum=True)
    return len({t for t, i, *_ in index.search(w, w.text_of_word()) if t == i}) / trials


@pytest.mark.parametrize("length", [8, 10, 14, 24, 39, 59, 80])
@pytest.mark.parametrize("kind", ["mixed", "replace", "insertions", "deletions", "front insertions"])
def test_recall_at_the_full_tolerance(length, kind):
    assert recall(length, kind) == 1.0
