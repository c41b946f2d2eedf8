"""Results against brute force, exact round trips, held-out accuracy and SQL."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from compare import rows
from test_copies import _brute as near_copies
from lodeweave.llm import audio, components, lines, mixing, packing, queries, repeats, simhash, toxicity, urls, weighted


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark, sf, duck):
    found, wanted = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert rows(found) == rows(wanted)


def test_simhash_brute_force(spark, sf, texts):
    import xxhash

    def brute(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    prints = {i: brute(t) for i, t in texts.items()}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_links_find_all_within_distance(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(8)]
    prints = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    want = {(a, b) for k, b in enumerate(prints) for a in prints[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 560)] + [(600, k) for k in range(601, 700)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_toxicity_held_out(spark, sf):
    data = f"{Path(sf).parent}/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    scored = toxicity.score(docs, labels).select("doc_id", F.col("toxicity.score").alias("score"))
    test = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").toPandas()
    hit = (test.score >= toxicity.THRESHOLD) & (test.toxic == 1)
    assert hit.sum() / (test.toxic == 1).sum() > 0.8
    assert hit.sum() / (test.score >= toxicity.THRESHOLD).sum() > 0.85


STEMS = {"idiot$": 0.95, "kill$": 0.95, "stup": 0.95}


def test_grammar_reads_clauses():
    """Aimed insults and threats pass the threshold; negated, reported and bare ones alone don't, whatever the word's weight."""
    g = toxicity.Grammar(toxicity.Weights(STEMS, toxicity.PATTERNS))
    score = lambda text: toxicity._score(g.clauses(text))
    for text in ("you are an idiot", "idiot, that is what you are", "i will kill you", "you stupid thing", "nobody said it. you are an idiot", "he did not come home today, you idiot"):
        assert score(text) >= toxicity.THRESHOLD, text
    for text in ("you are not an idiot", "he said you are an idiot", "he said you are not an idiot", "an idiot wrote it down", "idiot", "kill the process", "i will never kill you", "", "you are kind"):
        assert score(text) < toxicity.THRESHOLD, text
    assert score("an idiot came. an idiot went. an idiot stayed.") >= toxicity.THRESHOLD  # clauses add up
    assert g.clause("you are not an idiot")[1] == "aimed insult+negated"
    assert g.clause("he wrote never kill it")[1] == "bare threat+negated+reported"
    assert g.clauses("idiotic plans. stupidity wins") == [(14, 29, pytest.approx(0.95 * toxicity.BARE), "bare insult")]


def test_composition_brute_force():
    """The composed machine gives what trying every path through the three machines in turn gives."""
    machines = [toxicity.negations(), toxicity.reports(), toxicity.targets(toxicity.PATTERNS)]
    composed = toxicity.compose(toxicity.compose(*machines[:2]), machines[2])

    def paths(machine, read):
        """All (outputs, weight, final) of a machine."""
        open_ = [((), 1.0, machine.start)]
        for symbol in read:
            open_ = [((*out, o), w * v, to) for out, w, state in open_ for o, v, to in machine.arcs[state][symbol]]
        return [(out, w * machine.finals[s][0], machine.finals[s][1]) for out, w, s in open_ if s in machine.finals]

    rng = random.Random(4)
    for _ in range(300):
        read = [(rng.choice(toxicity.SYMBOLS), rng.choice((0.2, 0.5, 0.9))) for _ in range(rng.randint(0, 6))]
        best = 0.0
        for first, w1, _ in paths(machines[0], [s for s, _ in read]):
            for second, w2, _ in paths(machines[1], first):
                for last, w3, _ in paths(machines[2], second):
                    taken = math.prod(f for (_, f), o in zip(read, last) if o == toxicity.TAKEN)
                    best = max(best, w1 * w2 * w3 * taken)
        assert composed.best(read)[0] == pytest.approx(best)


def test_toxicity_query_brute_force(spark, sf, texts):
    """The query's columns, for every document, from the grammar applied one text at a time."""
    weights = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    grammar = toxicity.Grammar(weights)
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        score = toxicity._score([c for c in grammar.clauses(text)])
        assert got[i].score == pytest.approx(score) and 0 <= score <= 1
        assert (got[i].held_out, got[i].predicted) == (zlib.crc32(str(i).encode()) % 4 == 2, int(score >= 0.3))


def test_line_counts_near_the_threshold_are_exact(spark):
    rows_ = [(10 * k + j, f"line seen by {k} sites\nown {k} {j} text here", f"s{j}") for k in range(1, 30) for j in range(k)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = lines.clean_lines(docs, sites=15).groupBy().agg(F.sum("n_removed").alias("n")).first().n
    assert got == sum(k - 1 for k in range(15, 30))


def test_page_rank_brute_force(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 1), ("d", "c", 3)]
    seeds = [("trust", "a", 1.0), ("distrust", "c", 2.0), ("distrust", "b", 2.0)]
    rank = {}
    for kind in ("trust", "distrust"):
        es = [(s, d, n) if kind == "trust" else (d, s, n) for s, d, n in edges]
        out = Counter()
        for s, _, n in es:
            out[s] += n
        total = sum(w for k, _, w in seeds if k == kind)
        start = {h: w / total for k, h, w in seeds if k == kind}
        now = dict(start)
        for _ in range(5):
            new = defaultdict(float, {h: (1 - urls.DAMPING) * w for h, w in start.items()})
            for s, d, n in es:
                new[d] += urls.DAMPING * now.get(s, 0) * n / out[s]
            now = new
        rank |= {(kind, h): v for h, v in now.items() if v}
    got = urls.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "kind string, host string, weight double"), rounds=5)
    assert {(r.kind, r.host): pytest.approx(r["rank"]) for r in got.collect() if r["rank"]} == rank


def test_audio_query_brute_force(spark, sf, texts):
    """Every document's payload, checksums, stored file and features, rebuilt without the operator's readers and writers."""
    import io
    import wave

    got = {r.doc_id: r for r in queries.op3_audio_features(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        data, r = text.encode(), got[i]
        payload = data + bytes((64 - len(data) % 64) % 64 if data else 64)
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(audio.RATE)
            w.writeframes(payload)
        media = file.getvalue()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert wave.open(io.BytesIO(media)).readframes(len(payload)) == payload
    for i in sorted(texts)[::10]:  # features by sums written out, sample by sample
        payload = np.frombuffer(texts[i].encode() + bytes(-len(texts[i].encode()) % 64 or 64 * (not texts[i])), np.uint8)
        assert got[i].feature == _plain_feature(payload)


def _plain_feature(payload):
    """The feature text from a zero-stuffed, filtered and decimated signal and a written-out transform."""
    x = (payload.astype(np.float64) - 128) / 128
    bank = audio._phases(audio.UP, audio.DOWN).astype(np.float64)
    taps = bank.T.ravel()
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    total = -(-len(x) * audio.UP // audio.DOWN)
    frames = max(1, -(-(total - audio.WINDOW) // audio.HOP) + 1)
    filtered = np.concatenate([np.convolve(stuffed, taps), np.zeros(audio.DOWN * (audio.WINDOW + audio.HOP) * 2)])[:: audio.DOWN]
    filtered = np.concatenate([filtered, np.zeros(max(0, (frames - 1) * audio.HOP + audio.WINDOW - len(filtered)))])
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / audio.WINDOW)
    angle = np.exp(-2j * np.pi * np.outer(np.arange(audio.WINDOW), np.arange(audio.WINDOW // 2 + 1)) / audio.WINDOW)
    filters = audio._mel(audio.RATE * audio.UP // audio.DOWN).astype(np.float64)
    cuts = np.array([filtered[f * audio.HOP : f * audio.HOP + audio.WINDOW] * shape for f in range(frames)])
    mel = 10 * np.log10(np.maximum(np.abs(cuts @ angle) ** 2 @ filters, 1e-10))
    energy = 10 * np.log10(np.maximum((cuts**2).mean(1), 1e-10))
    step = audio.HOP * audio.DOWN / audio.UP / audio.RATE
    spans, k, middle = [], 0, np.median(energy)
    while k < frames:
        stop = k
        while stop < frames and energy[stop] > middle + audio.STAY_DB:
            stop += 1
        if stop > k and (energy[k:stop] >= middle + audio.START_DB).any():
            spans.append((stop - k) * step)
        k = stop + 1
    means = mel.mean(0).reshape(8, -1).mean(1)
    return f"{-(-frames // audio.FRAMES)}x{audio.FRAMES}x{audio.BANDS} {frames * step:.3f}s [{','.join(f'{v:.1f}' for v in means)}] {len(spans)} segments {sum(spans):.3f}s"


def _plain_verdicts(pages, rules=urls.RULES):
    """Host, path, rule, verdict and both ranks of each page, by dictionaries."""
    import re

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]

    def rule_of(host, path):
        fits = [(len(r), v, r) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits)[1:] if fits else None

    parts = {i: split(url) for i, url, _ in pages}
    edges, seeds, hosts = Counter(), {"trust": Counter(), "distrust": Counter()}, {h for h, _ in parts.values()}
    for i, _, html in pages:
        host, path = parts[i]
        if rule := rule_of(host, path) if host else None:
            seeds["trust" if rule[0] == "allow" else "distrust"][host] += 1
        for link in re.findall(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)""", html or "") if host else ():
            to = split(re.sub("^//", "http://", link))[0]
            hosts.add(to)
            if to and to != host:
                edges[host, to] += 1
    for host in hosts:
        if host.count(".") > 1:
            above = host.split(".", 1)[1]
            edges[host, above] += 1
            edges[above, host] += 1
    ranks = {}
    for kind, first in seeds.items():
        ways = edges if kind == "trust" else Counter({(d, s): n for (s, d), n in edges.items()})
        out = Counter()
        for (s, _), n in ways.items():
            out[s] += n
        start = {h: n / sum(first.values()) for h, n in first.items()}
        now = dict(start)
        for _ in range(urls.ROUNDS):
            new = Counter({h: (1 - urls.DAMPING) * w for h, w in start.items()})
            for (s, d), n in ways.items():
                new[d] += urls.DAMPING * now.get(s, 0) * n / out[s]
            now = new
        ranks[kind] = now
    out = {}
    for i, (host, path) in parts.items():
        rule, trust, distrust = rule_of(host, path), ranks["trust"].get(host, 0), ranks["distrust"].get(host, 0)
        out[i] = (host, path, rule and rule[1], rule[0] if rule else "block" if host and distrust > urls.THRESHOLD * trust else "allow", trust, distrust)
    return out


def _same_verdicts(found, want):
    assert set(found) == set(want)
    for i, r in found.items():
        assert (r.host, r.path, r.rule, r.trust, r.distrust) == (*want[i][:3], pytest.approx(want[i][4], abs=2e-9), pytest.approx(want[i][5], abs=2e-9))
        if abs(want[i][5] - want[i][4]) > 1e-9:
            assert r.verdict == want[i][3]


def test_url_query_brute_force(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    _same_verdicts({r.page_id: r for r in queries.op5_url_link_graph(spark, sf).collect()}, _plain_verdicts(pages))


def test_links_across_hosts_carry_trust_and_distrust(spark):
    """Trust flows along links, distrust against them; both change verdicts of hosts that no rule names."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    pages = [(1, "http://example.net/en/a", link("good.io", "mixed.io")), (2, "http://bad.net/a", link("far.io")), (3, "http://good.io/", link("friend.io")), (4, "http://shady.io/", link("bad.net", "BAD.net")), (5, "http://mixed.io/", link("bad.net", "good.io")), (6, "http://friend.io/", ""), (7, "http://alone.io/", ""), (8, "http://far.io/", None), (9, "http://lures.io/q", link("shady.io"))]
    want = _plain_verdicts(pages)
    assert {i: want[i][3] for i in (3, 4, 6, 7, 9)} == {3: "allow", 4: "block", 6: "allow", 7: "allow", 9: "block"}
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3))
    _same_verdicts({r.page_id: r for r in got.collect()}, want)


def test_packing(spark, sf, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*hf.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    pieces = queries.op6_packing(spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids[i]))
            assert p.ids_crc32 == zlib.crc32(ids[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    assert padding <= 0.02 * sum(map(len, ids.values()))


def test_token_ids_of_odd_texts():
    """The rank file gives the ids of the vocabulary's JSON form, also for random Unicode, white space and marks."""
    from tokenizers import Tokenizer
    import public_tokenizers

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    pools = ["abc XYZ 019", " \t\n\r\x0b\u00a0\u2003\u3000", "'s't'll've !?.,;:-_#@", "äéßñçø漢字かなкири", "🙂👩‍👩‍👧\u0301\u200d\ufeff", "<|endoftext|>"]
    for _ in range(1500):
        parts = [rng.choice((*rng.choice(pools), pools[-1] if rng.random() < 0.05 else "a")) for _ in range(rng.randint(0, 60))]
        parts += [chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 8))]
        rng.shuffle(parts)
        text = "".join(parts)
        assert packing.token_ids(text).tolist() == [*hf.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_special_token_is_one_id():
    assert packing.token_ids("a<|endoftext|>b").tolist()[1] == packing.SPECIAL_ID
    assert packing.token_ids(None).tolist() == [packing.END]


def test_cutting_stock_covers_the_demand():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 900):
        demand = np.bincount(rng.integers(0, packing.CLASSES, n), minlength=packing.CLASSES)
        plan = packing.cutting_stock(demand)
        assert (sum((p * t for p, t in plan), np.zeros(packing.CLASSES, int)) >= demand).all()
        assert all((p * np.arange(1, packing.CLASSES + 1)).sum() <= packing.CLASSES for p, _ in plan)
        assert sum(t for _, t in plan) <= 1.05 * (demand * np.arange(1, packing.CLASSES + 1)).sum() / packing.CLASSES + 12


def test_mixing_comes_near_targets(spark, sf):
    got = queries.op7_mixing(spark, sf).toPandas()
    again = queries.op7_mixing(spark, sf).toPandas()
    assert rows(got) == rows(again)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    got["source"] = got.doc_id.map(source)
    assert (got["taken"] <= 2 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6
    targets = got.groupby("source")[["target", "source_size"]].first()
    assert targets.target.sum() == pytest.approx(1.5 * got["size"].sum())
    assert (targets.target <= 2 * targets.source_size + 1e-6).all()


def _grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _jaccard(a, b):
    a, b = _grams(a), _grams(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_weighted_likeness(spark, sf):
    """On each document: no error beyond 4.5 standard errors of 64 samples."""
    docs = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in weighted.edited_and_next(docs).collect()}
    order, off = sorted(texts, reverse=True), []
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for said, true in ((got[i].near_edited, _jaccard(t, edited)), (got[i].near_next, _jaccard(t, after))):
            off.append(said - true)
            assert abs(off[-1]) <= 4.5 * math.sqrt(max(true * (1 - true), 1 / 64) / 64), (i, said, true)
    assert abs(sum(off) / len(off)) < 0.005
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 0.03
    same = defaultdict(set)
    for i, t in texts.items():
        same[t].add(got[i].fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_weighted_likeness_of_heavy_shingles(spark):
    """One shingle 200 times over and some other words, one word only, few words: each pair follows the other by id."""
    dice = random.Random(2)
    some = lambda n: " ".join(f"w{dice.randrange(10**6)}" for _ in range(n))
    heavy = " ".join(["a b c d e"] * 200)
    pairs = [(f"{heavy} {some(15)}", f"{heavy} {some(15)}"), ("word " * 3000, "word " * 1500), ("x " * 900 + some(100), "x " * 300 + some(100)), ("a b c d e f", "a b c d e g"), ("a b", "a b"), ("a b", "a c"), ("", "a"), (some(400), some(400))]
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(reversed(p))]
    got = {r.doc_id: r for r in weighted.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (a, b) in enumerate(pairs):
        true = _jaccard(a, b)
        assert abs(got[2 * k + 1].near_next - true) <= 4.5 * math.sqrt(max(true * (1 - true), 1 / 64) / 64), (k, got[2 * k + 1].near_next, true)
    assert got[3].near_next == pytest.approx(_jaccard(*pairs[1]), abs=0.06) and got[9].near_next == 1 and got[11].near_next == 0


def _brute_repeats(pairs):
    seen, out = set(), {}
    for key, data in pairs:
        gone = bytearray(len(data))
        for s in range(len(data) - repeats.LENGTH + 1):
            w = data[s : s + repeats.LENGTH]
            if w in seen:
                gone[s : s + repeats.LENGTH] = b"\1" * repeats.LENGTH
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest())
    return out


def test_repeats_brute_force(spark, sf, texts):
    want = _brute_repeats((i, texts[i].encode()) for i in sorted(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize(("crowd", "block"), [(15_000, 1 << 21), (2, 700), (5, 2500)])
def test_repeats_in_odd_texts(spark, monkeypatch, crowd, block):
    """Periodic texts, overlaps within a text, common passages in many contexts, blocks within texts and crowded minimizers."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, short = word(180), word(90)
    data = ["ab" * 200, "In. " * 120, "x" * 99, "x" * 100, "x" * 101, passage + passage]
    data += [word(rng.randint(0, 60)) + rng.choice([passage, short, passage[:130], passage[40:]]) + word(rng.randint(0, 60)) for _ in range(40)]
    data += [d[: len(d) // 2] + "é" + d[len(d) // 2 :] for d in data[6:20]] + data[:8]
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "SHARD", 50)
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(data)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(docs).collect()}
    assert got == _brute_repeats((i * 3, t.encode()) for i, t in enumerate(data))


def test_run_index():
    rng = random.Random(1)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abc\0", bytes(range(97, 123))])
        base = bytes(rng.choice(letters) for _ in range(60))
        strings = [base[rng.randint(0, 20) : rng.randint(25, 60)] * rng.randint(1, 2) for _ in range(rng.randint(1, 12))]
        index = repeats.RunIndex(strings)
        at, suffixes = 0, []
        for s in strings:
            suffixes += [(s[i:], at + i) for i in range(len(s) + 1)]
            at += len(s) + 1
        suffixes.sort()
        assert index.order.tolist() == [p for _, p in suffixes]
        shared = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        lengths = index.lengths()
        for j, (s, p) in enumerate(suffixes):
            assert lengths[p] == (shared(s, suffixes[j - 1][0]) if j else 0)
        assert len(index.heads) <= index.n


def test_resampling_keeps_a_tone():
    t = np.arange(16_000)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 1000 * t / 16_000)).astype(np.uint8)
    for up, down in ((1, 2), (audio.UP, audio.DOWN), (2, 3), (3, 2)):
        n = 16_000 * up // down
        whole = audio.resample(tone, 0, n, up, down)
        cuts = [*range(0, n, 1000), n]
        parts = np.concatenate([audio.resample(tone, a, b, up, down) for a, b in zip(cuts, cuts[1:])])
        assert np.allclose(whole, parts)
        spectrum = np.abs(np.fft.rfft(whole))
        assert spectrum.argmax() == 1000 and len(audio._phases(up, down)) == up


def test_tensors_and_segments():
    quiet, loud = np.full(16_000, 128, np.uint8), np.round(128 + 90 * np.sin(np.arange(8000))).astype(np.uint8)
    stream, spans = audio.features(audio.write_wav(bytes(quiet) + bytes(loud) + bytes(quiet)))
    table = audio.read_tensors(stream)
    assert table.schema.field("log_mel").type == audio.TENSOR
    assert len(spans) == 1 and abs(spans[0][0] - 1) < 0.05 and abs(spans[0][1] - 1.5) < 0.05
    assert table.column("start_s")[0].as_py() == 0 and table.column("stop_s")[-1].as_py() == pytest.approx(2.5, abs=0.05)


def test_pipeline_brute_force(spark, sf, texts):
    """Each stage does what it says on its own input, down to every token."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = docs.cache()
        steps[name] = docs
    rows_of = lambda n: {r.doc_id: r for r in steps[n].collect()}
    start, clean, unboiled, single = (rows_of(n) for n in ("start", "toxicity", "line_dedup", "near_dedup"))
    scores = {r.doc_id: r.predicted for r in queries.op1_toxicity(spark, sf).collect()}
    assert set(clean) == {i for i in start if not scores[i]}
    sites, first = defaultdict(set), {}
    for i in sorted(clean):
        for line in {x.strip(" ") for x in clean[i].text.split("\n")}:
            sites[line].add(clean[i].source)
            first.setdefault(line, i)
    bad = {x for x, s in sites.items() if len(s) >= lines.SITES and len(x) >= lines.LEAST_CHARS}
    for i, r in clean.items():
        kept = "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in bad or first[x.strip(" ")] == i)
        assert unboiled[i].text == kept and unboiled[i].n_chars == len(kept)
    keep = near_copies({i: r.text for i, r in unboiled.items()})
    assert set(single) == keep
    taken = Counter(r.doc_id for r in steps["mixing"].collect())
    assert set(taken) <= keep and max(taken.values()) <= mixing.EPOCHS
    tokens = {i: len(packing.token_ids(single[i].text)) for i in taken}
    got = Counter()
    for p in steps["packing"].collect():
        got[p.doc_id] += p.length
    assert got == {i: n * taken[i] for i, n in tokens.items()}
    whole = Counter()
    for p in corpus_pipeline.run(spark, sf).collect():
        whole[p.doc_id] += p.length
    assert whole == got
