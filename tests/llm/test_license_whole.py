import random
import textwrap

from umbra.llm import licenses

NOTICES = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]


def names(text):
    return sorted(x[2] for x in licenses.notices(text))


def prose(n, seed=3):
    r = random.Random(seed)
    vocab = "the a of and to in is it was for on with as at by this that from or have software all under work any use public general terms free person rights version may be not are copy following above domain".split()
    return " ".join(r.choices(vocab, k=n))


def test_every_notice_of_one_line():
    assert names(" ".join(t for _, t in NOTICES)) == sorted(n for n, _ in NOTICES)


def test_notices_in_long_lines():
    for size in (2_000, 40_000):
        for k, (name, text) in enumerate(NOTICES):
            assert names(f"{prose(size // 2, k)} {text} {prose(size // 2, k + 1)}") == [name]


def test_edits_within_the_tolerance():
    r = random.Random(4)
    for name, text in NOTICES:
        words = text.split()
        n = len(licenses._words(text)) // 10
        for _ in range(5):
            cut = list(words)
            for p in sorted(r.sample(range(1, len(words) - 1), n), reverse=True):
                cut[p:p] = ["zebra"]
            assert [(x[2], x[4], x[5]) for x in licenses.notices(f"{prose(300)} {' '.join(cut)} {prose(300)}")] == [(name, 0, n)]


def test_notices_wrapped_at_any_width():
    for width in (20, 40, 60, 72, 79):
        for k, (name, text) in enumerate(NOTICES):
            for before in ("", f"{prose(60, k)}\n\n"):
                lines = before.count("\n")
                wrapped = textwrap.wrap(text, width)
                got = licenses.notices(f"{before}{chr(10).join(wrapped)}\n\n{prose(60, k + 1)}")
                assert [x[:3] for x in got] == [(lines, lines + len(wrapped), name)], (width, text)


def test_wrapped_notices_reach_the_scan(make_docs):
    docs = [(k, "\n".join(textwrap.wrap(text, 20))) for k, (_, text) in enumerate(NOTICES)]
    got = licenses.scan_licenses(make_docs(docs)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(k, name) for k, (name, _) in enumerate(NOTICES)]
