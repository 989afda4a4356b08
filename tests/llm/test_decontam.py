"""Suffix automaton against brute force, blocks against one automaton."""

import random

from redactlake.llm import decontam
from redactlake.llm.decontam import Automaton


def brute(items, ws, window):
    hit, names = set(), set()
    for name, w in items:
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            for q in range(len(ws) - m + 1):
                if ws[q : q + m] == w[p : p + m]:
                    hit |= set(range(q, q + m))
                    names.add(name)
    return hit, names


def test_automaton():
    r = random.Random(1)
    for _ in range(300):
        letters = [b"a", b"b", b"c"][: r.randint(1, 3)]
        window = r.choice([2, 3, 4])
        items = [(str(k), [r.choice(letters) for _ in range(r.randint(0, 7))]) for k in range(r.randint(0, 5))]
        own = Automaton(items, window)
        for _ in range(4):
            ws = [r.choice([*letters, b"x"]) for _ in range(r.randint(0, 14))]
            ranges, names = own.find(ws)
            assert ({x for a, b in ranges for x in range(a, b)}, names) == brute(items, ws, window)


BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (None, "zzz"), (3, None), (4, "...")]


def test_rows_and_blocks(spark):
    rows = [(1, "x ONE two, three four five six seven eight nine ten! y"), (2, None), (3, "a short-item; zzz"), (3, "a short-item; zzz"), (None, ""), (4, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    one = sorted(map(str, decontam.marks(docs, bench).collect()))
    assert one == sorted(map(str, decontam.marks(docs, bench, block_words=2).collect()))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(docs, bench).collect()}
    assert got == {1: (12, 10, 1, True), 2: (0, 0, 0, False), 3: (4, 3, 2, True), None: (0, 0, 0, False), 4: (3, 0, 0, False)}
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(docs.limit(0), bench).count() == 0


def test_clean(spark):
    rows = [(1, "keep this. Short item. And the rest of it stays here.", 53), (2, "short item", 10), (3, "nothing", 7), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int")
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 4]
    cut = {r.doc_id: (r.text, r.n_chars) for r in decontam.clean(docs, bench, coverage=0.5).collect()}
    assert cut == {1: ("keep this. . And the rest of it stays here.", 43), 3: ("nothing", 7), 4: (None, None)}
