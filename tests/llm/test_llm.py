"""Training-data operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weftline.llm.queries")

from weftline.llm import bpe, jaccard_join, license_rules, lm_model, mixing, pii, quality_knn, quality_rules  # noqa: E402
from weftline.llm.common import connected_components  # noqa: E402
from weftline.llm.queries import tokenizer_path  # noqa: E402

WORDS = [a + b for a in "the an ti on re sh".split() for b in "ing er ha st ou nd".split()]
ODD = [(None, "no id but text enough to read"), (900, None), (901, ""), (902, " \t\n "), (903, "x" * 30_000), (904, "same words here"), (905, "same words here"), (904, "same words here")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing extra columns stand beside the text."""
    rng = random.Random(4)
    base = [(i, text(rng, rng.randint(1, 120))) for i in range(60)]
    for i in range(60):
        words = base[i % 12][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        base.append((100 + i, " ".join(words)))
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 900 else None, 1, 2.0) for i, t in base + ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2 if i else None) for i in range(60)] + [(None, 1)], "doc_id long, quality int")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_filter_of_ids(spark):
    """The bitmap lets every given id through and few others, also where it is far too small."""
    ids = spark.range(0, 40_000, 7)
    maybe, _ = jaccard_join.id_filter(ids.toDF("id"), ids.count())
    got = {r.id for r in spark.range(40_000).where(maybe("id")).collect()}
    assert set(range(0, 40_000, 7)) <= got and len(got) < 8000
    tight, _ = jaccard_join.id_filter(ids.toDF("id"), ids.count(), most_bytes=1 << 10)
    assert set(range(0, 40_000, 7)) <= {r.id for r in spark.range(40_000).where(tight("id")).collect()}


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 9), (9, 8), (3, 1), (5, 5), (None, 4)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).df.collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 140)} | {k: 200 for k in range(200, 261)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).df.count() == 0


def near_groups(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    links = jaccard_join.Links(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and (100 * len(x & y) >= 80 * len(x | y) or sets[a][0] == sets[b][0]):
                links.join(a, b)
    group = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            group[links.root(k)].append(i)
    return {i: (len(s), min(group[links.root(k)])) for k, (i, s) in enumerate(sets) if i is not None}


@pytest.mark.parametrize("nodes", [6000, 4])
def test_jaccard_join(docs, nodes):
    rows = [r for r in rows_of(docs) if r[0] is not None]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, region_nodes=nodes).collect() if r.id is not None}
    assert got == near_groups(rows)


def test_region_join_is_exact():
    rng = random.Random(1)
    base = [rng.sample(range(3000), rng.randint(5, 80)) for _ in range(12)]
    sets = []
    for _ in range(250):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(s) // 5)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(3000))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    got, want = jaccard_join.join_region(sets), jaccard_join.Links(len(sets))
    keys, who = jaccard_join.region_keys(sets)
    enters = defaultdict(set)
    for k, w in zip(keys.tolist(), who.tolist(), strict=True):
        enters[w].add(k)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want.join(a, b)
                assert enters[a] & enters[b]  # a link shares a region, and bitmaps leave it
                assert jaccard_join.near_pairs([0, 1], [len(sets[a]), len(sets[b])], [jaccard_join.parity_bits(sets[a]), jaccard_join.parity_bits(sets[b])])
    assert [got.root(k) for k in range(len(sets))] == [want.root(k) for k in range(len(sets))]


def test_chat_round_trip(spark):
    from weftline.llm.chat_format import digests, format_chats

    hard = ["\\### Assistant: </turn> ok", "", None, "### user: x</turn>### assistant: y", "\\\\<#:\n\n", "é🙂:"]
    rows = [(1, k, ("user", "assistant", "we:ird")[k % 3], t, 5) for k, t in enumerate(hard)] + [(None, 0, None, "a", 5), (2, 0, "assistant", "b", 5), (2, 0, "assistant", "b", 5)]
    chats = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    got = {r.conv_id: r for r in digests(chats).collect()}
    assert all(r.round_trip for r in got.values())
    want = "".join(f"{r}\n{t or ''}\n" for _, _, r, t, _ in rows[:6])
    loss = "".join(t or "" for _, _, r, t, _ in rows[:6] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 2
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bpe_matches_the_library(docs, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(5)
    extra = ["".join(rng.choice("ab' \n\t\xa0é中🙂1²'sT!<|endoftext|>\x00") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a<|endoftext|> b", "a  \n  b   "]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    want = Counter()
    for i, t in rows_of(both):
        ids = tok.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.encode_decode(both, tokenizer_path(), lexicon=50).collect())) == want


def test_transducer():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(WORDS + ["t", "thee", "zing"])}
    t = bpe.map_file(bpe.pack(bpe.compile_transducer(words)))
    ranks = bpe.look_up(t, [*sorted(words), b"", b"th", b"zz", b"x" * 99])
    assert ranks.tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert len(t["final"]) < sum(map(len, words))  # suffixes are shared


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    source = {(r.doc_id, len((r.text or "").split())): r.source for r in docs.collect()}
    for r in got:
        s = source[r.doc_id, r.size]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0):
    """Targets by sharing, capping and sharing anew."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, free = {}, budget * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def test_mixing_targets(spark):
    rng = random.Random(2)
    for k in range(4):
        sizes = {f"s{i:02}é" if i % 2 else f"S{i}": rng.choice([0, 1, 5, 40, 900]) for i in range(3 + 9 * k)} | {None: 7}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r.source for r in got} == set(want) and all(math.isclose(r.target, want[r.source], abs_tol=1e-6) for r in got)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_rounding_keeps_expectations():
    """Over many seeds each fraction is rounded up as often as it says, and the words taken stay but for the row that is left."""
    rng = np.random.default_rng(1)
    size, part = np.sort(rng.integers(1, 60, 14)), rng.uniform(0.05, 0.95, 14)
    ups = np.zeros(14)
    for seed in range(4000):
        p, kept = mixing.round_block(size, part, seed)
        assert sum(0 < x < 1 for x in p) <= 1 and math.isclose((p * size).sum(), (part * size).sum())
        ups += p
    assert np.abs(ups / 4000 - part).max() < 0.04


def test_mixing_tree_and_repeats(spark, monkeypatch):
    """More than one level of the tree, a hot source, and repeated rows that draw numbers of their own; reruns agree."""
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rng = random.Random(12)
    rows = [(i, text(rng, rng.randint(1, 40)), "hot" if i % 3 else f"s{i % 5}") for i in range(700)] + [(9_000, "the same words", None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = (Counter(map(tuple, mixing.mix_sources(d).collect())) for d in (docs.repartition(6), docs.repartition(2)))
    assert got == again and sum(got.values()) == 1000
    sizes, taken, target = Counter(), Counter(), {}
    of = {i: s for i, _, s in rows}
    for (i, size, _, goal, _, took), n in got.items():
        sizes[of[i]] += n * size
        taken[of[i]] += n * took
        target[of[i]] = goal
    want = plain_targets(sizes)
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) and abs(taken[s] - want[s]) <= 40 for s in want)
    assert len({took for (i, _, _, _, _, took) in got if i == 9_000}) > 1 or target[None] in (0, 2 * sizes[None])


def test_quality(docs, labels):
    for frame in (quality_rules.quality_rules(docs, labels), quality_rules.quality_rules(docs, labels.limit(0))):
        rows = frame.collect()
        assert len(rows) == docs.count()
        assert not any(r.kept for r in rows if r.n_words < 50)
    t = "A b\nA b\n \nA  b c# A b c#\nx".encode()
    s = {k: int(v[0]) for k, v in quality_rules.statistics([t]).items()}
    assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"]) == (11, 13, 2, 1)
    assert s["n_repeat_words"] == repeated(t.decode().split())


def repeated(w):
    n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    return len({k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 7)), rng.normal(size=(10, 7)) + 8])
    score = quality_rules.Forest(x).score(x)
    assert score[500:].min() > np.quantile(score[:500], 0.98)
    assert quality_rules.calibrate(np.array([0.9, 0.5, 0.4]), np.array([False, True, True])) == pytest.approx(0.7)
    assert quality_rules.calibrate(np.zeros(0), np.zeros(0, dtype=bool)) == 2.0


def test_quality_votes_on_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, 80) if i % 3 else text(rng, 80).upper().replace(" ", "!! ")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = quality_knn.score_quality(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id != 999]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_knn.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_by_brute_force(spark):
    """Scores equal votes over plainly sorted double-precision cosines, with repeated rows, ties, clashing columns and a very long text."""
    rng = random.Random(9)
    rows = [(i, text(rng, rng.randint(5, 90)) + "!?" * (i % 4), "x") for i in range(160)] + [(200, "x " * 40_000, "x"), (201, "", "x"), (202, None, "x"), (203, "same words", "x"), (203, "same words", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    marks = [(i, int(rng.random() < 0.6)) for i in [*range(120), 200, 203]]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    known = sorted((i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 4 != 2)
    of = dict((i, (t or "").encode()) for i, t, _ in rows)
    x = quality_knn.term_rows([of[i] for i, _ in known]).astype(float)
    y = np.array([v for _, v in known], dtype=float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    mean = (x * idf).mean(0)
    axes = quality_knn.Space(x, y).axes.astype(float)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1)[:, None], 1e-9)
    sample = unit((x * idf - mean) @ axes)
    for r in quality_knn.score_quality(docs, labels).collect():
        t = next((t or "").encode() for i, t, _ in rows if i == r.doc_id)
        cos = (unit((quality_knn.term_rows([t]).astype(float) * idf - mean) @ axes) @ sample.T)[0]
        last = sorted(cos, reverse=True)[quality_knn.NEIGHBOURS - 1]
        w = [math.exp(quality_knn.STEEP * (c - max(cos))) if c >= last - 1e-6 else 0.0 for c in cos]
        want = (sum(a * b for a, b in zip(w, y, strict=True)) + 0.5 * y.mean()) / (sum(w) + 0.5) if t.split() else 0.0
        assert abs(r.score - want) < 0.02 and r.predicted == int(r.score >= 0.7)


def test_forest_by_hand(docs, labels):
    """Scores follow each tree from its root; kept is what the base rules and the cut say."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 7))
    forest = quality_rules.Forest(x, trees=12)

    def walk(row, at):
        depth = 0
        while tuple(forest.child[at]) != (at, at):
            at = int(forest.child[at][int(row[forest.feature[at]] >= forest.cut[at])])
            depth += 1
        inside = forest.path[at] - depth  # what the rows that share a leaf would still need
        assert -1e-9 <= inside <= quality_rules._usual_path(256)
        return forest.path[at]

    for row, got in zip(x[:40], forest.score(x[:40]), strict=True):
        mean = sum(walk(row, r) for r in forest.roots) / len(forest.roots)
        assert math.isclose(got, 2 ** (-mean / quality_rules._usual_path(256)))
    fitted, cut = quality_rules.fit(docs, labels)
    for r in quality_rules.quality_rules(docs, labels, carry=("doc_id", "text")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum((r.text or "").count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated(words))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        score = fitted.score(quality_rules.features(quality_rules.statistics([(r.text or "").encode()])))[0]
        assert math.isclose(r.anomaly, score) and r.kept == (not r.base_failed and score < cut)


def test_embeddings_without_ids(spark):
    """Vectors without an id count nowhere; repeated ids, clashing columns and empty tables are no trouble."""
    from weftline.llm.embedding_join import embedding_components

    a, b = [1.0, 0.0], [0.92, 0.392]
    mid = [0.99, 0.14]
    rows = [(1, a, 0), (2, [0.75, 0.66], 0), (None, b, 0), (7, a, 0), (7, a, 0), (9, mid, 0)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")).collect())
    assert got == Counter([(1, 3, 1, True), (2, 0, 2, True), (None, 0, None, None), (7, 3, 1, False), (7, 3, 1, False), (9, 3, 1, False)])
    assert embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings(spark):
    from weftline.llm.embedding_join import embedding_components

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 5))
    rows = [(k, [float(x) for x in centre[k % 8] + rng.normal(size=5) * 0.4]) for k in range(200)]
    rows += [(300 + k, rows[3][1]) for k in range(20)] + [(400, None), (401, [0.0] * 5), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [math.nan] * 5), (404, [1.0, 2.0]), (405, [])]
    good = {i: np.array(v) for i, v in rows if i < 400}
    ids = sorted(good)
    x = np.stack([good[i] for i in ids])
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= 0.9
    links = jaccard_join.Links(len(ids))
    for a, b in zip(*np.nonzero(near), strict=True):
        links.join(int(a), int(b))
    want = {i: (int(near[k].sum()) - 1, ids[links.root(k)]) for k, i in enumerate(ids)} | {i: (0, i) for i, _ in rows if i >= 400}
    for block in (4096, 32):
        got = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def base_by_regex(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab@.-%_ 1", "0123456789 -.", "0123+ ().-"])
def test_pii_base(letters):
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == base_by_regex(t)


def test_pii_query(docs, spark):
    more = spark.createDataFrame([(2000, "é mail a.b@c.example.com, call +1 (555) 123-4567 or 4111 1111 1111 1111 at 10.0.0.1"), (2001, "a@b"), (2002, "x [at] mail [dot] com")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = {r.doc_id: r for r in pii.find_pii(both).collect()}
    assert (got[2000].n_email, got[2000].n_ip, got[2000].n_card, got[2000].n_phone) == (1, 1, 1, 1)
    shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_by_regex(more.first().text))
    assert got[2000].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert set(shown.split(",")) <= set(got[2000].spans.split(","))
    assert got[903].spans == got[900].spans == got[2001].spans == ""
    hidden = {r.doc_id: r.text for r in pii.find_pii(both, carry=("doc_id", "text"), redact=True).collect()}
    assert hidden[2000].startswith("é mail <EMAIL>, call <PHONE> or <CARD> at <IP>")
    assert hidden[900] is None


def test_licenses():
    t = "Intro.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved. x\nReleased under the MIT License."
    assert license_rules.apply_rules(license_rules.identifiers(t)) == (["Apache-2.0", "MIT", "Proprietary"], 0)
    terms = "\n".join(license_rules.SENTENCES[k][0] for k in ("bsd-terms", "bsd-source", "bsd-binary"))
    assert license_rules.apply_rules(license_rules.identifiers(terms)) == (["BSD-2-Clause"], 0)
    assert license_rules.apply_rules(license_rules.identifiers("my license is mine")) == ([], 0)
    assert all(license_rules._HINT(s) for s in license_rules.KNOWN)


def test_model_gradient_and_windows():
    rng = np.random.default_rng(0)
    m = lm_model.Model(rng.integers(0, 5, lm_model.VOCABULARY).astype(float))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    tokens, lengths = rng.integers(0, lm_model.VOCABULARY, 120), np.array([70, 50])
    inputs, target = lm_model.windows(tokens, lengths)
    assert sorted(target[target >= 0].tolist()) == list(range(120))  # each token once
    _, g = m.loss(tokens, inputs, target)
    for k, v in m.p.items():
        i = tuple(rng.integers(0, n) for n in v.shape) if k != "E" else (int(tokens[3]), *(rng.integers(0, n) for n in v.shape[1:]))
        held, low, high = v[i], 0.0, 0.0
        v[i] = held + 1e-5
        high = m.loss(tokens, inputs, target)[0]
        v[i] = held - 1e-5
        low = m.loss(tokens, inputs, target)[0]
        v[i] = held
        assert abs((high - low) / 2e-5 - g[k][i]) < 1e-6
    # later tokens change no earlier score, and probabilities of a place sum to one
    other = tokens.copy()
    other[60:70] = 1
    a, b = m.score(tokens, lengths), m.score(other, lengths)
    assert np.allclose(a[:60], b[:60])
    total = sum(10 ** m.score(np.array([3, 9, k]), np.array([3]))[2] for k in range(lm_model.VOCABULARY))
    assert abs(total - 1) < 1e-6


def plain_scores(m, tokens):
    """log10 probabilities of one text's tokens, place by place and in double precision."""
    p, out = {k: v.astype(float) for k, v in m.p.items()}, []
    for t, token in enumerate(tokens):
        k = t // lm_model.STRIDE * lm_model.STRIDE - (lm_model.WINDOW - lm_model.STRIDE)  # the window's first place
        seen = [p["E"][tokens[j - 1] if j > 0 else lm_model.VOCABULARY] + p["P"][j - k] for j in range(k, t + 1)]
        weights = [math.exp(seen[-1] @ p["M"] @ x) for x in seen]
        u = seen[-1] + sum(w * x for w, x in zip(weights, seen, strict=True)) / sum(weights) @ p["V"]
        h = u + np.maximum(u @ p["A"] + p["a"], 0) @ p["B"]
        group, rank = divmod(int(m.place[token]), lm_model.SIDE)
        outer, inner = np.exp(h @ p["C"] + p["c"]), np.exp(h @ p["T"][group] + p["t"][group])
        out.append(math.log10(outer[group] / outer.sum() * inner[rank] / inner.sum()))
    return out


def test_lm_score_by_brute_force(spark):
    """Scores of whole texts are the sums of plainly computed probabilities, and next words' masses stay below one."""
    from weftline.llm import lm_scoring as lm

    rng = random.Random(7)
    rows = [(i, text(rng, rng.randint(0, 60)).title()) for i in range(40)] + [(40, None), (41, " \t"), (42, "x" * 20_000), (42, "x" * 20_000), (None, "né 中 the")]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), {}
    real, lm.train_model = lm.train_model, lambda train, pieces, counts: held.update(pieces=pieces, model=real(train, pieces, counts)) or held["model"]
    try:
        got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score_documents(docs, tokenizer_path("word_bpe_49k.json")).collect())
    finally:
        lm.train_model = real
    pieces, model, want = held["pieces"], held["model"], []
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        ids = [k for w in words for k in pieces.word(w)] + [lm.END]
        want.append((str(i), len(words) + 1, sum(plain_scores(model, ids))))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * (1 - b[2])
    first = [w.encode() for w in WORDS] + [b"x", b"zz", b"a", b"the", "é".encode()]
    mass = sum(10 ** sum(plain_scores(model, pieces.word(w))) for w in first) + 10 ** plain_scores(model, [lm.END])[0]
    assert 0 < mass <= 1
    assert len({tuple(pieces.word(w)) for w in first}) == len(first) and all(x == y or x[: len(y)] != y for x in map(pieces.word, first) for y in map(pieces.word, first))


def test_lm_base(docs):
    from weftline.llm.lm_scoring import score_documents

    rows = rows_of(docs)
    tok = [(i, t.encode().lower().split() + [None]) for i, t in rows]
    c = Counter(w for i, ws in tok if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tok)
    got = score_documents(docs, tokenizer_path("word_bpe_49k.json"), top=20).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("name", ["jaccard", "bpe", "mix", "rules", "pii", "knn"])
def test_no_rows(docs, labels, name):
    none = docs.limit(0)
    run = {"jaccard": lambda: jaccard_join.jaccard_components(none), "bpe": lambda: bpe.encode_decode(none, tokenizer_path()), "mix": lambda: mixing.mix_sources(none), "rules": lambda: quality_rules.quality_rules(none, labels), "pii": lambda: pii.find_pii(none), "knn": lambda: quality_knn.score_quality(none, labels)}[name]
    assert run().count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        if name != "bpe":
            assert set(docs.columns) == set(p.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "jaccard_join":
            groups = near_groups(rows_of(before))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "pii":
            assert not any(base_by_regex(t) for _, t in rows_of(docs))
        assert docs.count() > 0


def test_lm_context():
    """Every place but a text's first ones sees 8 to 31 tokens before it, and the width of layers is as first built."""
    tokens = np.arange(100)
    inputs, target = lm_model.windows(tokens, np.array([100]))
    sees = {int(t): int((inputs[w, : lm_model.WINDOW - lm_model.STRIDE + k + 1] < lm_model.VOCABULARY).sum()) for w, row in enumerate(target) for k, t in enumerate(row) if t >= 0}
    assert min(sees[t] for t in range(32, 100)) >= 9 and max(sees.values()) == 32
    assert all(inputs[w, lm_model.WINDOW - lm_model.STRIDE + k] == (t - 1 if t else lm_model.VOCABULARY) for w, row in enumerate(target) for k, t in enumerate(row) if t >= 0)
    assert (lm_model.WIDTH, lm_model.HIDDEN, lm_model.WINDOW, lm_model.STRIDE) == (24, 48, 32, 24)


def test_lm_words_and_pieces(spark):
    """Counts of words and pieces are those of the texts; the base does not depend on how many words are broadcast."""
    from weftline.llm import lm_scoring as lm

    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(6)
    rows = [(i, text(rng, rng.randint(0, 30))) for i in range(50)] + [(50, None), (51, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = lm.count_words(docs.select("text"), True)
    every = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    assert {r.word.encode(): r.c for r in counts.collect()} == every
    pieces = lm.Pieces(lm.read_ranks(path))
    want = Counter(i for w, n in every.items() for i in pieces.cut(w + b" ") for _ in range(n))
    assert lm.count_pieces(counts, pieces) == want
    reduced = pieces.choose(want, 52)
    assert reduced[lm.END] == 52 and reduced.sum() == 52 + sum(n * len(pieces.word(w)) for w, n in every.items())
    some = lm.frequent_words(counts, 5, 64)
    assert len(some) <= 5 and all(every[w] == n for w, n in some.items()) and min(some.values(), default=9) >= max(n for w, n in every.items() if w not in some)
    assert lm.frequent_words(counts, 99, 64) == every and lm.frequent_words(counts.where("c < 0"), 9, 64) == {}
    a, b = ({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs, path, top=n).collect()} for n in (1, 99))
    assert a == b
    none = lm.score_documents(docs.limit(0), path)
    assert none.count() == 0 and len(none.columns) == 7


def test_lm_trains_on_all_rows(spark, monkeypatch):
    """Every window of every training text is taken once, those of long texts too, and the weights move to them."""
    from weftline.llm import lm_scoring as lm

    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(0, 90)) if i % 9 else None) for i in range(200)] + [(500, "long " * 6_000)]
    seen, one = [], lm.train_round
    monkeypatch.setattr(lm, "train_round", lambda train, pieces, model, rate: seen.append((one(train, pieces, model, rate), [r.doc_id for r in train.collect()], pieces)))
    lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tokenizer_path("word_bpe_49k.json"))
    learnt = {i: t or "" for i, t in rows if zlib.crc32(str(i).encode()) % lm.FOLDS != lm.HELD_OUT}
    assert 500 in learnt and sorted(i for _, ids, _ in seen for i in ids) == sorted(learnt)
    _, lengths = lm.tokens_of(seen[0][2], [t.encode() for t in learnt.values()])
    assert sum(n for n, *_ in seen) == sum(-(-int(n) // lm_model.STRIDE) for n in lengths)
    model = lm_model.Model(np.ones(lm_model.VOCABULARY))
    tokens, lengths = lm.tokens_of(seen[0][2], [t.encode() for t in learnt.values()])
    before = model.score(tokens, lengths).sum()
    one(spark.createDataFrame([(t,) for t in learnt.values()], "text string"), seen[0][2], model, 0.01)
    assert model.score(tokens, lengths).sum() > before


def test_wrapped_licenses():
    import textwrap

    notice = {k: rows[0].capitalize() + "." for k, rows in license_rules.SENTENCES.items()}
    name = "Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    read = lambda parts, mark="": license_rules.apply_rules(license_rules.identifiers("\n\n".join(textwrap.fill(p, 60) for p in parts).replace("\n", "\n" + mark)))
    for mark in ("", " * ", "# ", "// "):
        assert read(["Some Project", notice["mit-grant"], notice["mit-notice"], notice["as-is"]], mark) == (["MIT"], 0)
        assert read([notice["gpl-free"]], mark) == (["GPL-3.0-or-later"], 0)
        bsd = [notice["bsd-terms"].replace("met.", "met:"), "1. " + notice["bsd-source"], "2. " + notice["bsd-binary"]]
        assert read(bsd, mark) == (["BSD-2-Clause"], 0)
        assert read([*bsd, "3. " + name], mark) == (["BSD-3-Clause"], 0)
        assert read([*bsd[:1], "a) " + bsd[1][3:], "b) " + bsd[2][3:]], mark) == (["BSD-2-Clause"], 0)
    assert license_rules.identifiers("Released under the MIT\n\nlicense") == []
    assert license_rules.identifiers("all\nrights reserved") == ["all-rights"]


def plain_em(counts, rounds=60):
    """Reliabilities and posteriors, vote by vote."""
    n = len(pii.LABELERS)
    yes, no, prior = [0.95] + [0.8] * (n - 1), [0.05] + [0.3] * (n - 1), 0.5
    for _ in range(rounds):
        post = {}
        for k, s in counts:
            a, b = prior, 1 - prior
            for j, c in enumerate(s):
                if c != "-":
                    a *= yes[j] if c == "1" else 1 - yes[j]
                    b *= no[j] if c == "1" else 1 - no[j]
            post[k, s] = a / (a + b)
        for rate, start, side in ((yes, 0.8, lambda p: p), (no, 0.3, lambda p: 1 - p)):
            for j in range(n):
                mass = sum(side(post[k]) * c for k, c in counts.items() if k[1][j] != "-")
                ones = sum(side(post[k]) * c for k, c in counts.items() if k[1][j] == "1")
                rate[j] = min(max((ones + 2 * start) / (mass + 2), 0.02), 0.98)
        no[0] = min(no[0], yes[0] / 2)
        prior = min(max((sum(post[k] * c for k, c in counts.items()) + 1) / (sum(counts.values()) + 2), 0.05), 0.95)
    return post


def test_pii_em_and_features(spark):
    rng = random.Random(5)
    counts = Counter((rng.randrange(4), "".join(rng.choice("10-" if j > 3 else "10") for j in range(6))) for _ in range(400))
    got = dict(zip(sorted(counts), pii.reliabilities(counts)[2], strict=True))
    assert all(abs(got[k] - p) < 1e-6 for k, p in plain_em(counts).items())
    # the classifier tells spans apart whose votes agree, by their features
    model = pii.train({(0, "111111|aa"): 90, (0, "000000|bb"): 90, (0, "101010|aa"): 5, (0, "101010|bb"): 5})
    assert model[0, "101010|aa"] > model[0, "101010|bb"]
    assert pii.train({}) == {}
    t = "x\njoe@a.com, 10.0.0.1 " + "y" * 50_000
    assert [p.split("|")[1] for _, p in pii.scan(t)][0] == pii.shape(t, (2, 0, 11))
    rows = [(1, t, 3), (1, t, 3), (2, None, 3), (None, "+1 555 123 4567", 3)]
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_phone) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect())
    assert got == Counter([(1, 1, 1, 0), (1, 1, 1, 0), (2, 0, 0, 0), (None, 0, 0, 1)])


def test_whole_licenses():
    """The usual texts as they are published, wrapped, with marks in front of lines."""
    import textwrap

    texts = {
        "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
        "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
        "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
        "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
        "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
        "Zlib": ["This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
        "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    }
    for name, parts in texts.items():
        for mark in ("", " * ", "# "):
            stated, _ = license_rules.apply_rules(license_rules.identifiers("\n\n".join(textwrap.fill(p, 70) for p in parts).replace("\n", "\n" + mark)))
            assert stated == [name], (name, mark, stated)


def test_pii_redacts_the_union(spark):
    t = "call +1 555 123 4567.joe@x.com now"
    assert pii.base_spans(t) == [(5, 3, 20), (16, 0, 30)]
    hidden = pii.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string"), carry=("doc_id", "text"), redact=True).first().text
    assert hidden == "call <PHONE><EMAIL> now" and not base_by_regex(hidden)
    assert pii.replace("abcdef", [(0, 3, 4), (1, 0, 2), (3, 0, 5)]) == "<PHONE><EMAIL>f"


def test_keep_first_by_rows(spark):
    """Rows that share an id but hold different texts stay; near copies without an id do not."""
    import corpus_pipeline as p

    rng = random.Random(3)
    a, b, c = text(rng, 60), text(rng, 60), text(rng, 60)
    rows = [(1, a), (1, b), (None, c), (None, c), (7, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in p.keep_first(spark, docs, "").collect())
    assert got == sorted([("1", a), ("1", b), ("None", c)])


def test_lm_merges_and_written_pieces(spark):
    """Merges learnt from counts are fewer pieces than bytes, repeat nothing and stop where nothing repeats; every text is cut once, as it is by itself."""
    from weftline.llm import lm_scoring as lm

    assert lm.learn_merges({}, 9) == [] and lm.learn_merges({b"q": 1}, 9) == []
    assert lm.learn_merges({b"ab": 5, b"abc": 3}, 3) == [b"ab", b"ab ", b"c "]
    assert lm.learn_merges({b"aaaa": 4}, 9) == [b"aa", b"aa ", b"aaaa "]
    rng = random.Random(11)
    rows = [(i, text(rng, rng.randint(0, 40))) for i in range(90)] + [(90, None), (91, " "), (92, "é中" * 9_000), (None, "the the")]
    words = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    merges = lm.learn_merges(words, 200)
    assert len(set(merges)) == len(merges) <= 200 and all(b" " not in m[:-1] and len(m) > 1 for m in merges)
    pieces = lm.Pieces({w: i for i, w in enumerate([bytes([i]) for i in range(lm.END)] + merges)})
    counts = pieces.choose(Counter(i for w, n in words.items() for i in pieces.cut(w + b" ") for _ in range(n)), 94)
    assert counts.sum() - 94 < 0.5 * sum(n * (len(w) + 1) for w, n in words.items() if len(w) < 99) + sum(n * (len(w) + 1) for w, n in words.items() if len(w) >= 99)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id % 7 = 2 as held_out").repartition(3)
    cut = lm.cut_documents(docs, pieces, {w: n for w, n in words.items() if n > 1}, 94).collect()
    want, lengths = lm.tokens_of(pieces, [(t or "").encode() for _, t in rows])
    ends = np.cumsum(lengths)
    want = {i: want[e - n : e].tolist() for (i, _), e, n in zip(rows, ends.tolist(), lengths.tolist(), strict=True)}
    assert {r.doc_id: lm.read_tokens([r.tokens])[0].tolist() for r in cut if r.n is None} == want
    assert Counter(r.word.encode() for r in cut if r.n is not None for _ in range(r.n)) == Counter({w: n for w, n in words.items() if n == 1})


def test_lm_graphs():
    """Graphs give the losses, gradients and scores of numpy, in parts of windows too, and training with them keeps to numpy's."""
    from weftline.llm import lm_graph

    assert lm_graph.usable()
    rng = np.random.default_rng(4)
    lengths = np.array([1, 700, 24, 25, 3_000, 2_500])
    tokens = rng.integers(0, lm_model.VOCABULARY, lengths.sum()) // rng.integers(1, 4_000, lengths.sum())
    inputs, target = lm_model.windows(tokens, lengths)
    assert len(inputs) > 2 * lm_model.PART
    graph, plain = (lm_model.Model(np.bincount(tokens, minlength=lm_model.VOCABULARY)) for _ in range(2))
    plain._graph = lambda: None
    for rounds in range(2):
        (a, g), (b, h) = (m.loss(tokens, inputs, target) for m in (graph, plain))
        assert abs(a - b) < 1e-4 * abs(b) and g.keys() == h.keys() == plain.p.keys()
        assert all(g[k].shape == plain.p[k].shape and np.abs(g[k] - h[k]).max() < 1e-3 * np.abs(h[k]).max() for k in h)
        assert np.abs(graph.score(tokens, lengths) - plain.score(tokens, lengths)).max() < 1e-2
        for m in (graph, plain):
            m.learn([(tokens, lengths)], 0.001)


def test_lm_cut_words():
    """Words are cut at six bytes only, A-Z alone are lower-cased, and texts may be null, empty or all white space."""
    import pyarrow as pa

    from weftline.llm import lm_scoring as lm

    texts = ["  Ab\x0b\x0cÉx \x1cQ\u00a0Z\u0085 ", "", None, " \t\r\n", "ab AB aB", "x"]
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    words, size = lm._words(pa.array(texts).slice(0), True)
    assert words.to_pylist() == sum(want, []) and size.tolist() == [len(w) for w in want]
    words, size = lm._words(pa.array(texts).slice(3), False)
    assert words.to_pylist() == ["ab", "AB", "aB", "x"] and size.tolist() == [0, 3, 1]
