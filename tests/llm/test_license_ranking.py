import random

from umbra.llm import licenses

NOTICES = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
PROSE = "The harbour lay quiet in the morning and nobody had come down to the boats yet. " * 8


class Spy:
    def __init__(self, known, k, seen):
        self.known, self.k, self.seen = known, k, seen

    def compress(self, data):
        self.seen.append((self.k, data))
        return self.known.compress(data)


def test_every_template_ranks_every_block_before_any_is_aligned(monkeypatch):
    seen, aligned = [], []
    made, difference = licenses._templates(), licenses._difference
    licenses._pieces()
    monkeypatch.setattr(licenses, "_templates", lambda: [(name, words, Spy(known, k, seen)) for k, (name, words, known) in enumerate(made)])

    def align(wanted, words):
        aligned.append((next(k for k, m in enumerate(made) if m[1] is wanted), len(seen)))
        return difference(wanted, words)

    monkeypatch.setattr(licenses, "_difference", align)
    # the second block holds a cue and no piece of a template, the third pieces of several
    text = f"Released under the MIT License.\n{PROSE}a driving licensed man {PROSE}\nThis work is licensed under the GNU General Public License, version 2."
    assert [x[2] for x in licenses.notices(text)] == ["MIT", "GPL-2.0"]
    blocks = sorted({d for _, d in seen}, key=lambda d: text.index(d.decode()))
    assert len(blocks) == 3 and b"driving licensed man" in blocks[1]
    for data in blocks:
        assert sorted(k for k, d in seen if d == data) == list(range(len(made)))
    assert all(n % len(made) == 0 for _, n in aligned)
    # the wording is read in the order of the rank
    of_last = [k for k, n in aligned if n == len(seen)]
    saved = {k: len(made[k][2].compress(blocks[2])) for k in of_last}
    assert len(set(of_last)) > 1 and [saved[k] for k in of_last] == sorted(saved[k] for k in of_last)


def test_rank_alone_names_plain_notices():
    for name, text in NOTICES:
        order = licenses.ranked(f"{PROSE[-licenses.MARGIN:]}{text}\n{PROSE[:licenses.MARGIN]}")
        assert len(order) == len(NOTICES)
        assert NOTICES[order[0][1]][0] == name, (text, order[:3])


def brute_force(words):
    """Word ranges and differences of confirmed notices, every template aligned at every word."""
    found = set()
    for _, template in NOTICES:
        wanted = licenses._words(template)
        edits = int(licenses.TOLERANCE * len(wanted))
        for start in range(-edits, len(words)):
            first = max(start - edits, 0)
            cost, missing, a, b = licenses._difference(wanted, words[first : max(start + len(wanted) + edits, 0)])
            if cost <= edits:
                found.add((missing - len(wanted), cost, first + a, first + b))
    taken = []
    for x in sorted(found):
        if all(x[3] <= y[2] or x[2] >= y[3] for y in taken):
            taken.append(x)
    return sorted((a, b, cost) for _, cost, a, b in taken)


def test_no_notice_is_left_out_for_its_rank_or_block(monkeypatch):
    r = random.Random(7)
    vocab = " ".join(t for _, t in NOTICES).split()
    for _ in range(12):
        words = []
        for _ in range(3):
            words += r.choices(vocab, k=r.randint(0, 12))
            notice = r.choice(NOTICES)[1].split()
            for _ in range(r.randint(0, len(notice) // 10)):
                if r.random() < 0.5:
                    notice.insert(r.randrange(len(notice)), "zebra")
                else:
                    del notice[r.randrange(len(notice))]
            words += notice
        words = licenses._words(" ".join(words))
        want = brute_force(words)
        for block in (2_000, 1):
            monkeypatch.setattr(licenses, "BLOCK", block)
            assert [(x[0], x[1], x[4] + x[5]) for x in licenses.notices("\n".join(words))] == want
