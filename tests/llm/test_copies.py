"""The pipeline's near copies against brute force."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute(texts):
    """The smallest id of each component of pairs with a similarity of 0.8 or more."""
    sets = {i: _grams(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sets:
            if j >= i or 5 * min(len(sets[i]), len(sets[j])) < 4 * max(len(sets[i]), len(sets[j])):
                continue  # such sizes rule it out
            shared, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not both or 5 * shared >= 4 * both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in texts}


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return corpus_pipeline.dedup(spark, docs, "").collect()


def test_near_copies_brute_force(spark):
    """Edits from one word to half the text, chains of edits, one large group, shared passages, short and empty texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(900)}"
    fresh = lambda n: [word() for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return words

    texts = [edited(base, k) for base in (fresh(rng.randint(60, 300)) for _ in range(12)) for k in (0, 1, 2, 3, 5, 8, 13, 60)]
    chain = fresh(200)
    for _ in range(12):
        chain = edited(chain, 3)
        texts.append(chain)
    crowd, passage = fresh(150), fresh(80)
    texts += [edited(crowd, rng.randint(0, 4)) for _ in range(60)] + [passage + fresh(rng.randint(10, 60)) for _ in range(40)]
    texts += [[w.upper() for w in texts[0]], ["a"], ["a"], ["a", "b"], [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(len(texts), None)]
    want = _brute(dict(rows))
    assert {r.doc_id for r in _kept(spark, rows)} == want
    assert len(want) < len(rows) - 80


def test_near_copies_of_documents(spark, sf):
    docs = spark.read.parquet(f"{Path(sf).parent}/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.dedup(spark, docs, sf).select("doc_id").collect()}
    assert kept == _brute({r.doc_id: r.text for r in docs.collect()})


def test_unlike_texts_stay_whatever_their_ids(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[4]), (7, texts[5])]
    got = sorted((str(r.doc_id), r.text) for r in _kept(spark, rows))
    assert got == sorted([("None", texts[0]), ("None", texts[1]), ("5", texts[2]), ("7", texts[3]), ("3", texts[4]), ("7", texts[5])])
