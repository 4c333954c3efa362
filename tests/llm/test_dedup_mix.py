from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from rillstream.llm import components, line_dedup, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in [None, "", "  \n", "One", "one TWO", "a b c", "a b c d e", "É é A\x85b c\x1cd e f", "x y z " * 50, "ÀB cd ef gh"]:
        assert simhash.fingerprint(t) == slow_fingerprint(t), t


def test_covering_masks_cover():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for bits in combinations(range(64), 2):
        assert any(not m >> bits[0] & 1 and not m >> bits[1] & 1 for m in masks)
    assert all(m.bit_count() >= 30 for m in masks)


def test_links_connect_what_brute_force_connects(spark):
    r = random.Random(5)
    fps = set()
    while len(fps) < 300:
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 12])):
            fps.add(base)
            for _ in range(r.randint(1, 3)):
                base ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [simhash.signed(f) for f in fps]
    roots = {x.node: x.root for x in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = slow_components(signed, [(signed[i], signed[j]) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert {n: roots.get(n, n) for n in signed} == want


def test_near_duplicates_with_strange_rows(spark):
    long = "word " * 20_000
    base = " ".join(f"t{i}" for i in range(400))
    rows = [(7, base), (3, base), (3, base), (9, base + " tail"), (1, None), (2, ""), (5, "  "), (4, long), (None, base), (None, "alone here only"), (8, "other text here")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    named = [(i, f) for (i, _), f in zip(rows, fps, strict=True) if i is not None]
    want = slow_components([i for i, _ in named], [(a, b) for (a, f), (b, g) in combinations(named, 2) if (f ^ g).bit_count() <= 2])
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id is not None) == sorted((i, want[i]) for i, _ in named)
    assert len(got) == len(rows) and {x.component_id for x in got if x.doc_id is None} == {3, None}
    kept = simhash.representatives(df).collect()
    assert Counter(x.doc_id for x in kept) == Counter([*sorted(set(want.values())), None, None]) and set(df.columns) == set(kept[0].asDict())
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.representatives(df.limit(0)).count() == 0


def slow_groups(rows, similarity=None):
    """For each (id, text) its group: a number; groups are linked texts, ids do not link."""
    texts = sorted({t for _, t in rows}, key=lambda t: (t is not None, t))
    fps = [slow_fingerprint(t) for t in texts]
    sets = [slow_shingles(t) for t in texts]

    def near(a, b):
        return (fps[a] ^ fps[b]).bit_count() <= 2 or (similarity and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))

    root = slow_components(range(len(texts)), [p for p in combinations(range(len(texts)), 2) if near(*p)])
    return {t: root[i] for i, t in enumerate(texts)}


def slow_shingles(t):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {" ".join(ws[k : k + 5]) for k in range(max(min(1, len(ws)), len(ws) - 4))}


def test_repeated_ids_do_not_tie_texts_together(spark):
    r = random.Random(21)
    bases = [" ".join(r.choices([f"v{k}" for k in range(300)], k=60)) for _ in range(9)]
    bases += [f"{b} end" for b in bases[:4]] + [None, "", "short one"]
    rows = [(3, bases[1]), (5, bases[1]), (5, bases[0])] + [(r.choice([1, 2, 4, 6, 7, 7, 8, 9]), r.choice(bases)) for _ in range(60)]
    rows += [(None, bases[2]), (None, "nothing like it at all"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", None, k % 3) for k, (i, t) in enumerate(rows)], DOCS).repartition(4)
    for similarity in (None, 0.8):
        group = slow_groups(rows, similarity)
        least = {}
        for i, t in rows:
            if i is not None:
                least[group[t]] = min(i, least.get(group[t], i))
        got = Counter((x.doc_id, x.fp, x.component_id) for x in simhash.near_duplicates(df, similarity=similarity).collect())
        assert got == Counter((i, simhash.signed(slow_fingerprint(t)), least.get(group[t])) for i, t in rows)
        kept = [(x.doc_id, x.text) for x in simhash.representatives(df, similarity=similarity).collect()]
        named = [k for k in kept if k[0] is not None]
        assert Counter((group[t], i) for i, t in named) == Counter(least.items())  # one row of each group, of its smallest id
        assert set(named) <= set(rows) and Counter(k for k in kept if k[0] is None) == Counter(k for k in rows if k[0] is None)
    assert (5, bases[0]) in rows and any(x.text == bases[0] for x in simhash.representatives(df.where("doc_id in (3, 5)")).collect())


def test_shingle_sets_tell_texts_apart_as_words_do():
    r = random.Random(3)
    for _ in range(60):
        ws = [r.choice("abc").encode() for _ in range(r.randint(0, 14))]
        assert len(simhash.shingle_set(ws)) == len({tuple(ws[k : k + 5]) for k in range(max(min(1, len(ws)), len(ws) - 4))})
    a, b = ([f"w{k}".encode() for k in x] for x in (range(40), range(2, 42)))
    assert len(set(simhash.shingle_set(a).tolist()) & set(simhash.shingle_set(b).tolist())) == 34


def test_sets_in_blocks_equal_sets_of_python():
    import pyarrow as pa

    r = random.Random(14)
    for size in (0, 1, 40):
        sets = [sorted(r.sample(range(60), r.randint(1, 12))) for _ in range(size)]
        i, j = simhash.alike_rows(pa.array(sets, pa.list_(pa.int64())), 0.5)
        want = [(a, b) for a, b in combinations(range(size), 2) if len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b]))]
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_edited_copies_fall_together(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 3)  # buckets in several blocks
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]

    def edited(ws, n):
        ws = list(ws)
        for k in r.sample(range(len(ws)), n):
            ws[k] = r.choice(vocabulary)
        return ws

    bases = [r.choices(vocabulary, k=r.choice([40, 90, 200])) for _ in range(12)]
    texts = [" ".join(edited(b, e)) for b in bases for e in (0, 1, 1, 2, 3, 5)]
    texts += [" ".join(edited(bases[0], k % 2)) for k in range(20)] + ["one two", "One  two", "", None]

    def shingles(t):
        ws = (t or "").lower().split()
        return {" ".join(ws[k : k + 5]) for k in range(max(min(1, len(ws)), len(ws) - 4))}

    fps, sets = [slow_fingerprint(t) for t in texts], [shingles(t) for t in texts]
    close = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    alike = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = slow_components(list(range(len(texts))), close + alike)
    assert want != slow_components(list(range(len(texts))), close)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = simhash.near_duplicates(docs, similarity=0.8).collect()
    assert {x.doc_id: x.component_id for x in got} == want and len(got) == len(texts)
    assert {x.doc_id for x in simhash.representatives(docs, similarity=0.8).collect()} == set(want.values())


def test_components_of_paths_stars_and_cliques(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + list(combinations(range(200, 215), 2)) + [(5, 5)]
    r.shuffle(edges)
    df = spark.createDataFrame([e if r.random() < 0.5 else e[::-1] for e in edges], "a long, b long").repartition(5)
    want = slow_components({n for e in edges for n in e}, edges)
    for alone in (0, 1 << 20):
        assert {x.node: x.root for x in components.components(df, most_alone=alone).collect()} == {n: m for n, m in want.items() if n != m}
        assert components.components(df.limit(0), most_alone=alone).count() == 0


def test_fingerprints_equal_brute_force_on_the_table(spark):
    from conftest import DATA

    from rillstream.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op2_simhash"](spark, DATA).collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = slow_components(sorted(fps), [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == {i: (fps[i], want[i]) for i in fps}


# --- mixing

def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= most * sizes[s]] if free else []
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        free -= set(over)
        left -= sum(out[s] for s in over)


def test_water_filling(spark):
    r = random.Random(8)
    for trial in range(6):
        sizes = {f"s{i}é"[: r.randint(2, 4)]: r.choice([0, 1, 5, 100, 10_000]) for i in range(r.randint(1, 9))} | ({None: 50} if trial % 2 else {})
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.targets(rows).collect()}
        want = slow_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes) and len(got) == len(sizes)


def test_mix_comes_near_its_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["a", "b", "b", "b", "c", "d", None]), 0) for i in range(1500)]
    rows += [rows[0], rows[0], (None, "x y", "en", None, 0), (5000, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size and x.taken == x.repeats * x.size
        by.setdefault(x.source_size, [x.target, 0])[1] += x.taken
    assert all(abs(taken - target) <= 62 for target, taken in by.values())
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    want = Counter()
    for x in got:
        want[x.doc_id] += x.repeats
    assert Counter(x.doc_id for x in mixed.collect()) == +want
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_rows_of_one_id_and_without_id_are_drawn_each_for_itself(spark):
    rows = [(None, f"word{k} two three", "en", "a", 0) for k in range(100)] + [(7, "same old words", "en", "b", 0)] * 90 + [(k, "x y z", "en", "c", 0) for k in range(400)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_mix_u", F.lit("clash")).withColumn("_mix_key", F.lit(1)).repartition(5)
    by, repeats = {}, {}
    for x in mixing.mix(df).collect():
        by.setdefault(x.source_size, [x.target, 0])[1] += x.taken
        repeats.setdefault(x.source_size, Counter())[x.repeats] += 1
    assert all(abs(taken - target) <= 3 for target, taken in by.values()), by
    assert any(len(c) == 2 for c in repeats.values())
    assert Counter((x.source_size, x.repeats) for x in mixing.mix(df.repartition(2)).collect()) == Counter((s, r) for s, c in repeats.items() for r in c.elements())
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    names = {300: "a", 270: "b", 1200: "c"}
    assert Counter(x.source for x in mixed.collect()) == Counter({names[s]: sum(r * n for r, n in c.items()) for s, c in repeats.items()})


# --- lines

def slow_lines(rows, ratio, least):
    pages, seen = Counter(s for s, _ in rows), Counter()
    for s, t in rows:
        seen.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")} if t is not None else set())
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad) for s, t in rows]


def test_line_dedup(spark):
    r = random.Random(1)
    lines = ["menu", " menu ", "", "  ", "©", "unique"]
    rows = [(r.choice(["a", "b", None]), "\n".join(r.choice(lines) + ("" if r.random() < 0.6 else str(r.randint(0, 99))) for _ in range(r.randint(1, 6)))) for _ in range(80)]
    rows += [("c", None), ("c", ""), ("d", "menu"), ("a", "x" * 100_000)]
    df = spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, site int")
    got = line_dedup.drop_boilerplate(df, site_col="source", ratio=0.3, min_pages=3, count_col="n").orderBy("doc_id").collect()
    want = slow_lines(rows, 0.3, 3)
    assert [x.text for x in got] == want
    for x, (_, t) in zip(got, rows, strict=True):
        count = lambda s: sum(bool(y.strip(" ")) for y in (s or "").split("\n"))
        assert x.n == count(t) - count(x.text)
    assert line_dedup.drop_boilerplate(df, site_col="source").columns == df.columns
    assert line_dedup.drop_boilerplate(df.limit(0), site_col="source").count() == 0


def test_line_dedup_without_broadcasts(spark, monkeypatch):
    r = random.Random(9)
    rows = [(r.choice(["big"] * 6 + ["b", None]), "\n".join(r.choice(["menu", "foot", f"own {k}"]) for _ in range(4))) for k in range(300)]
    df = spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, _line_salt int")
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "SALT_PAGES", 40)
    got = line_dedup.drop_boilerplate(df, site_col="source")
    assert got.columns == df.columns and [x.text for x in got.orderBy("doc_id").collect()] == slow_lines(rows, 0.05, 5)


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([("a", "x\ny")], "source string, text string")
    plan = line_dedup.drop_boilerplate(df, site_col="source")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hosts(spark):
    df = spark.createDataFrame([("https://M.Example.com:80/x?y",), ("no url",), (None,)], "u string")
    assert [x[0] for x in df.select(line_dedup.site_of(F.col("u"))).collect()] == ["m.example.com", None, None]


def test_oracles(same):
    from rillstream.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        same(QUERIES[name], sql)


