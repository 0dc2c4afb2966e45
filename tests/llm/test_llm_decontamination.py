"""Benchmark decontamination: recall against exact edit distances, and odd cases."""

import random

import numpy as np

from parley.llm.decontamination import (
    RECALL, CoreHashes, Items, contaminated, decontaminated, edit_distance, walked, walks_for, words_of,
)


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 70))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        assert edit_distance(a, b)[0] == distance(a, b)


def test_recall_and_exactness():
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(14, 59)))) for i in range(60)]
    block, hashes = Items([(i, t.encode()) for i, t in items], 0.8), CoreHashes()
    true = found = 0
    for i, text in items * 5:
        w = text.split()
        for _ in range(rng.randint(0, len(w) // 4)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[p], rng.choice(vocabulary)]])
            if not w:
                w = ["x"]
        before = rng.choices(vocabulary, k=rng.randint(0, 120))
        doc = words_of(" ".join([*before, *w, *rng.choices(vocabulary, k=40)]).encode(), hashes)
        best = distance(block.lists[i], doc.tolist())
        got = block.matches(doc, block.hits(doc))
        if best <= block.edits[i]:
            true += 1
            found += i in got
        else:
            assert i not in got
        for k, (edits, _) in got.items():
            assert edits >= distance(block.lists[k], doc.tolist())
    assert true > 100 and found / true > 0.99


def test_real_documents(spark):
    """Every document that holds an item word for word is found."""
    sf = "/root/testdata/sf0.01"
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda text: " " + " ".join(text.lower().split()) + " "
    items = [(r.item_id, plain(r.text)) for r in benchmark.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    found = contaminated(docs, benchmark, items_at_once=25)
    rows = found.collect()
    assert want <= {(r.doc_id, r.item_id) for r in rows} and want
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    gone = {r.doc_id for r in rows}
    stays = {r.doc_id for r in decontaminated(docs, benchmark, items_at_once=25).collect()}
    assert stays == {r.doc_id for r in docs.select("doc_id").collect()} - gone


def test_odd_rows(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."
    benchmark = spark.createDataFrame(
        [(1, item, 0), (1, item, 0), (None, "short one", 0), (3, None, 0), (4, "...", 0), (5, "", 0)], "item_id long, text string, distance int"
    )
    near = item.replace("six", "SIX!").replace("nine ", "")
    far = "filler " * 30
    rows = [(1, far + near + " " + far), (1, far + near + " " + far), (None, item), (2, ""), (3, None), (4, "z " * 50_000 + item), (5, "a short, one here"),
            (6, " ".join(item.split()[:8]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, end_word string")
    found = sorted(((r.doc_id, r.item_id, r.distance) for r in contaminated(docs, benchmark).collect()), key=str)
    assert found == sorted([(1, 1, 1)] * 4 + [(None, 1, 0)] * 2 + [(4, 1, 0)] * 2 + [(5, None, 0)], key=str)
    stays = decontaminated(docs, benchmark)
    assert stays.columns == docs.columns and {r.doc_id for r in stays.collect()} == {2, 3, 6}
    assert decontaminated(docs, benchmark.limit(0)).count() == len(rows)
    assert contaminated(docs.limit(0), benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0


def test_every_length_reaches_the_recall():
    """At the largest distance, also at the very begin and end of a text, with edits of any kind, spread or at any places."""
    rng = random.Random(3)
    all_found = all_true = 0
    for size in range(1, 41):
        items = [[f"i{n}w{p}" for p in range(size)] for n in range(20)]
        block, hashes = Items([(n, " ".join(w).encode()) for n, w in enumerate(items)], 0.8), CoreHashes()
        k = block.edits[0]
        texts, want = [b"some other text"], []
        for n, item in enumerate(items):
            for spread in (True, True, False, False):
                places = [int((i + 0.5) * size / k) for i in range(k)] if spread else rng.sample(range(size), k)
                for kinds in ("c", "c", "d", "i", "cdi"):
                    w = list(item)
                    for p in sorted(places, reverse=True):
                        w[p : p + 1] = {"c": [f"x{rng.random()}"], "d": [], "i": [w[p], "x"]}[rng.choice(kinds)]
                    before, behind = (["z"] * rng.choice([0, 0, 3, 40]) for _ in range(2))
                    if distance(block.lists[n], words_of(" ".join(before + w + behind).encode(), hashes).tolist()) <= k:
                        want.append((len(texts), n))
                    texts.append(" ".join(before + w + behind).encode())
        found = {x[:2] for x in block.found(texts, hashes)}
        assert found <= set(want) and len(want) == 400, size  # nothing else is ever found
        assert len(found) >= (400 if k == 0 else 396), (size, len(found))
        all_found, all_true = all_found + len(found), all_true + len(want)
    assert all_found / all_true > 0.9985


def test_walks_follow_from_the_length():
    for length in range(1, 200):
        edits = length // 5
        walks, steps, least = walks_for(length, edits)
        assert (walks, steps, least) == (1, length - 1, length - 1) if not edits else 1 <= walks <= 6 and least >= 1
    assert walks_for(3, 2)[2] == 0 and walks_for(100, 5)[0] == 1 and RECALL == 0.999


def test_walks_of_near_texts_agree_in_most_steps():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    same = np.concatenate([words, words])
    for walk in (None, 0, 5):
        for step, signatures, moves in walked(same, walk, 6):
            assert (signatures[:40] == signatures[60:100]).all() and moves.max() <= step
            assert len(np.unique(signatures[:60])) > 50 - 3 * step
    *_, (_, _, moves) = walked(rng.integers(1, 1 << 62, 5000).astype(np.uint64), 3, 6)
    assert 2.9 < moves.mean() < 3.1  # half of the steps move


def test_short_item_found_behind_a_near_miss():
    item = "aa bb cc dd ee"
    block, hashes = Items([(0, item.encode())], 0.8), CoreHashes()
    for text in ("zz bb cc dd ee", "bb cc dd ee", "aa q q q q q q aa bb cc xx ee", "aa bb cc dd ee " * 2, "aa bb q q q q zz bb cc dd ee aa q q"):
        assert [x[1] for x in block.found([b"q", text.encode()], hashes)] == [0], text
