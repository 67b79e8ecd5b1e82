"""Every operator against its plain version, on tables with all that can be odd."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import bloom, decontam, embdedup, linededup, mixing, neardedup, sharding, suffixdedup
from candlewick.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, place string, rep long, label string, _key int, taken double"
WORDS = "the of and river Stone quiet LAMP walks under seven éclair über naïve green tree sudden morning never again paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def odd_rows(seed=1):
    rng = random.Random(seed)
    shared = prose(rng, 40)
    base = prose(rng, 120).split(" ")
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(30)]
    texts += [prose(rng, 10) + "\n" + shared + "\n" + prose(rng, 10) for _ in range(12)]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[3], texts[31], texts[31], None, None, "", "", " \t\n\x0b ", "\n\n", "one", "Two words", "x" * 100, "x" * 350, "é" * 120, prose(rng, 6000), "\n".join([shared] * 4), shared.upper() + "  "]
    sources = ["a", "a", "a", "b", None, "", "é"]
    rows = [(i, t, "en", rng.choice(sources)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[31], None, None), (None, None, None, "b"), (None, "alone without id, nobody else says this line", "en", "a")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(*r, None if r[1] is None else len(r[1]), 7, 0.5, "here", 1, "x", 3, 1.0) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_line_dedup(docs, empty, rows):
    want = Counter(brute.lines([r[:2] for r in rows]))
    assert Counter(tuple(r) for r in linededup.dedup_lines(docs).collect()) == want
    assert linededup.dedup_lines(empty).collect() == []


@pytest.mark.parametrize("most,at_once", [(100_000, 20_000), (3, 2)])
def test_suffix_dedup(docs, empty, rows, most, at_once):
    # rows of one doc_id and text are one document; null ids come last, ordered by a hash of the text
    known = sorted({r[:2] for r in rows if r[0] is not None})
    want = {(d, n, tuple(s), k) for d, n, s, k in brute.repeats(known)}
    got = suffixdedup.remove_repeats(docs, most_runs=most, at_once=at_once).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got if r.doc_id is not None} == want
    copy = next(r for r in got if r.doc_id is None and r.n_bytes > 200)
    assert [(s.start, s.end) for s in copy.spans] == [(0, copy.n_bytes)] and copy.kept == b""
    assert suffixdedup.remove_repeats(empty).collect() == []


def test_suffix_dedup_on_random_repetitive_bytes(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 200))) for _ in range(12)]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(60, "ab" * 400), (61, "a" * 99), (62, "a" * 101)]
    got = suffixdedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert {(r.doc_id, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got.collect()} == {(d, tuple(s), k) for d, _, s, k in brute.repeats(texts)}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, empty, rows, percent):
    want = brute.near([r[:2] for r in rows], percent)
    got = neardedup.link(docs, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(set(want.values())) < len(want) - 8
    for r in got:
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    sizes = defaultdict(set)
    for r in rows:
        sizes[r[0]].add(len(brute.shingles(r[1])))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    assert neardedup.link(empty).collect() == []


def test_near_duplicates_in_families_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardedup, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(copy)))
    got = neardedup.link(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute.near(texts)


@pytest.mark.parametrize("list_rows", [1_000_000, 3])
def test_near_duplicates_of_several_texts_of_one_document(spark, monkeypatch, list_rows):
    monkeypatch.setattr(neardedup, "BLOCK", 4)
    monkeypatch.setattr(neardedup, "LIST_ROWS", list_rows)
    x, y, z = ([f"{c}{i}" for i in range(60)] for c in "xyz")
    rows = [(5, x), (5, y), (1, [*x, "more"]), (9, [*y, "more"]), (7, z), (7, z), (2, z), (5, []), (30, [])]
    rows += [(100 + i, [*x[:55], *(f"n{i}{k}" for k in range(i % 4))]) for i in range(40)] + [(200 + i, [*y, *x[: 2 * i]]) for i in range(30)]
    texts = [(d, " ".join(w)) for d, w in rows]
    got = neardedup.link(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == brute.near(texts)
    assert {r.component_id for r in got if r.doc_id in (1, 5, 9)} == {1}


def test_near_duplicates_with_a_very_long_text(spark):
    rng = random.Random(12)
    long = prose(rng, 300_000).split(" ")
    texts = [(1, " ".join(long)), (2, " ".join([*long[:-9], "other"])), (3, " ".join(long[:150_000])), (4, "short")]
    got = {r.doc_id: r.component_id for r in neardedup.link(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute.near(texts)


def test_phrases(spark, docs, empty, rows):
    rng = random.Random(3)
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) > 60)
    items = [(1, " ".join(long.split()[5:22])), (2, "Two words"), (3, None), (4, ""), (None, long), (5, prose(rng, 30)), (1, " ".join(long.split()[5:22])), (6, "one"), (7, "?!")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = Counter((d, n, h, tuple(f)) for d, n, h, f in brute.phrases([r[:2] for r in rows], items))

    def found(df):
        out = []
        for r in df.collect():
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]) if a.end != b.start)
            out.append((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])))
        return Counter(out)

    assert found(decontam.find(docs, bench)) == want
    assert decontam.find(empty, bench).collect() == []
    none = found(decontam.find(docs, bench.filter("false")))
    assert all(h == 0 and f == () for _, _, h, f in none) and sum(none.values()) == len(rows)


def test_phrases_of_a_benchmark_in_blocks(spark, docs, rows, monkeypatch):
    items = [(i, r[1]) for i, r in enumerate(rows) if r[1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, n, h, tuple(f)) for d, n, h, f in brute.phrases([r[:2] for r in rows], items))
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", 2_000)
    got = decontam.find(docs, bench).collect()
    assert Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got) == want


def test_one_index_serves_every_benchmark(spark):
    rng = random.Random(31)
    texts = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 5, 60, 400])))) for i in range(80)] + [(80, " ".join(f"w{i % 977}" for i in range(200_000)))]
    index = decontam.build(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    held = set().union(*(set(zlib.decompress(bytes(r.terms)).decode().split()) for r in index.collect()))
    assert held == {w for _, t in texts for w in t.split()}  # all tokens, whatever is searched for
    for seed in (1, 2):
        rng = random.Random(seed)
        own = [t.split() for _, t in texts if len(t.split()) > 30]
        items = [(k, " ".join(w[a : a + rng.randint(3, 20)])) for k, w in enumerate(rng.choices(own, k=12)) for a in [rng.randrange(len(w) - 20)]]
        got = decontam.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
        want = Counter((d, n, h, tuple(f)) for d, n, h, f in brute.phrases(texts, items))
        assert Counter((r.key, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got) == want


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b x c d e f g h i j"), (2, "a b c d e f g h i j")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    exact = {r.doc_id: len(r.spans) for r in decontam.find(d, b).collect()}
    near_ = {r.doc_id: len(r.spans) for r in decontam.find(d, b, slop=1).collect()}
    assert exact == {1: 0, 2: 1} and near_[1] == 1


def test_mixing(docs, empty, rows):
    word = lambda t: len((t or "").replace("\x0b", " ").split())
    totals = Counter()
    for r in rows:
        totals[r[3]] += word(r[1])
    want = brute.targets(totals)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(int)
    source = {(r[0], word(r[1])): r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size in totals.values()
        s = source[(r.doc_id, r.size)]
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[s]) and r.source_size == totals[s]
        by[r.target] += r.taken
    for target, taken in by.items():
        assert abs(taken - target) <= 0.5 * sum(t == target for t in want.values()) + 1e-6
    assert sorted(map(tuple, mixing.plan(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.plan(empty).collect() == []


def test_mix_is_taken_word_for_word(docs, empty):
    plan = {k: v for k, v in Counter((r.doc_id, r.size, r.taken) for r in mixing.plan(docs).collect()).items()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.replace("\x0b", " ").split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for (d, _, taken), n in plan.items():
        want[d] += taken * n
    assert got == +want
    assert mixing.mixed(empty).collect() == []


def test_mix_of_equal_rows_and_without_a_shuffle_of_texts(spark):
    rows = [(7, "six words that are all equal", "en", "a", 28, 0, 0.0, "", 0, "", 0, 0.0)] * 41
    rows += [(i, prose(random.Random(i), 30), "en", "bc"[i % 2], 1, 0, 0.0, "", 0, "", 0, 0.0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(docs)
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
    for r in mixing.plan(docs).collect():
        want[r.target] += r.taken
    assert sorted(got.values()) == sorted(want.values()) == [round(t) for t in sorted(want)]
    assert got["a"] == 241  # the budget, a sixth of all 1,446 words, ends within one of the equal rows
    alone = mixing.mixed(docs.filter("doc_id <> 7"))
    assert "Exchange hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString()


def test_shards(docs, empty, rows):
    got = sharding.interleave(docs, shards=7).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert set(per) == set(range(7)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    known = {(r[0], r[1]): (len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert Counter((r.size, r.text_crc32) for r in got) == Counter(known[(r[0], r[1])] for r in rows)
    strata = Counter("n" if r[3] is None else "s" + r[3] for r in rows)
    for stratum, n in strata.items():
        for shard in range(7):
            assert abs(sum(r.stratum == stratum and r.shard == shard for r in got) - n / 7) <= 1.5
    assert sharding.interleave(empty).collect() == []
    assert len({(r.shard, r.slot) for r in sharding.interleave(docs.limit(3), shards=24).collect()}) == 3


def test_embeddings_of_doubles_and_of_several_rows_of_one_id(spark):
    a, b = [1e300, 2e300, 0.0], [1e300, 2e300, 1e299]
    rows = [(1, a, 0), (1, [0.0, 0.0, 1.0], 0), (2, b, 0), (3, [-0.0, -0.0, 5e-324], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (5, [1.0, 2.0], 1)]
    rows += [(100 + i, [float(j == i) for j in range(40 + i)], 2) for i in range(30)]  # a length of its own each
    got = Counter(tuple(r) for r in embdedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (5, 0, 5, True)]
    assert got == Counter(want + [(100 + i, 0, 100 + i, True) for i in range(30)])


@pytest.mark.parametrize("plan", [{}, {"tables": 4, "radius": 1}])
def test_embeddings(spark, monkeypatch, plan):
    monkeypatch.setattr(embdedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = centres[i % 12] + rng.normal(scale=rng.choice([0.02, 0.12, 0.3]), size=16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(200 + i, rows[5][1], rows[5][2]) for i in range(20)]  # copies
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, [float("nan")] * 16, 1), (305, [float("inf")] * 16, 1), (306, rows[5][1], None)]
    rows += [(307, rows[5][1][:8], rows[5][2]), (308, [x * 3 for x in rows[5][1]], rows[5][2]), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    good = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (lab, x / np.linalg.norm(x))
    g, links = brute.Groups(), Counter()
    for i, (la, a) in good.items():
        for j, (lb, b) in good.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= 0.93:
                g.link(i, j)
                links[i] += 1
                links[j] += 1
    got = {r.vec_id: r for r in embdedup.link(df, **plan).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        if i is not None:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], g.find(i) if i in good else i, (g.find(i) if i in good else i) == i), i
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert embdedup.link(df.filter("false")).collect() == []


@pytest.mark.parametrize("plan", [{}, {"tables": 6, "radius": 1}])
def test_embedding_links_at_the_limit_are_found(spark, plan):
    """Pairs by cosine band: by construction, each vector has one link."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2_400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = np.repeat([0.931, 0.94, 0.96], 800)[:, None]
    pairs = np.stack([x, cosine * x + np.sqrt(1 - cosine**2) * off], 1)
    rows = [(2 * i + j, [float(v) for v in pair[j]], 0) for i, pair in enumerate(pairs) for j in (0, 1)]
    got = {r.vec_id: r.n_links for r in embdedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **plan).collect()}
    for band in range(3):
        assert np.mean([got[2 * i] for i in range(800 * band, 800 * (band + 1))]) > 0.995, band


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and {got[i] for i in range(500, 560)} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    """Pairs right at the limit: whatever is counted as a large table, the same ones are found."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * off
    rows = [(2 * i + j, [float(v) for v in z[i]], 0) for i in range(len(x)) for j, z in enumerate((x, y))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    found = []
    for large in (1 << 60, 1):
        monkeypatch.setattr(embdedup, "LARGE", large, raising=False)
        found.append({r.vec_id for r in embdedup.link(df).collect() if r.n_links})
    assert found[0] == found[1] and len(found[0]) > 0.998 * len(rows)


def join_rows(spark, run):
    """The rows that all joins give while `run` is under way."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        got = store.executionsList()
        return [got.apply(i).executionId() for i in range(got.size())]

    before, total = set(executions()), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for e in set(executions()) - before:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            for j in range(node.metrics().size() if "Join" in node.name() else 0):
                m = node.metrics().apply(j)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_components_look_each_link_up_about_once(spark):
    """A dense group at the end of a long chain: its links are not joined anew for every step along the chain."""
    rng = random.Random(5)
    dense = [(1_000 + i, 1_000 + rng.randrange(300)) for i in range(300) for _ in range(40)]
    line = [rng.randrange(1 << 40) for _ in range(60)]
    links = {(a, b) for a, b in [*dense, *zip(line, line[1:], strict=False), (line[-1], 1_000)] if a != b}
    df = spark.createDataFrame(sorted(links), "a long, b long")
    got = []
    rows = join_rows(spark, lambda: got.extend(components(df).collect()))
    assert len(got) == 360 and {r.component for r in got} == {min(min(x) for x in links)}
    assert 0 < rows < 4 * len(links)


def test_components_equal_those_of_a_plain_version(spark):
    rng = random.Random(6)
    links = [(rng.randrange(3_000), rng.randrange(3_000)) for _ in range(1_700)]
    links += [(9_000, 8_000 + i) for i in range(200)]  # the hub is the largest of its nodes
    g = brute.Groups()
    for a, b in links:
        if a != b:
            g.link(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: g.find(x) for x in nodes}


def test_twice_filter_holds_every_repeat(spark):
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.integers(0, 1 << 40, 4000)]
    values += values[:300]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(6)
    mix = lambda a: np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = bloom.repeated(df, lambda batch: iter([np.asarray(batch["v"].to_numpy(), np.uint64) * np.uint64(0x9E3779B97F4A7C15)]), 1 << 16)
    assert bloom.holds(words, mix(values[:300])).all()
    assert bloom.holds(words, mix(values[300:4000])).mean() < 0.05


def test_filter_of_repeated_keys_is_not_filled_by_others(spark):
    """A filter far too small for all hashes, but not for the repeated ones."""
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 1 << 62, 60_000)]
    df = spark.createDataFrame([(v,) for v in values + values[:200]], "v long").repartition(5)
    mix = lambda a: np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = bloom.repeated_keys(df, lambda batch: iter([np.asarray(batch["v"].to_numpy(), np.uint64) * np.uint64(0x9E3779B97F4A7C15)]), bloom.SEGMENT, at_once=5_000)
    assert bloom.holds_key(words, mix(values[:200])).all()
    assert bloom.holds_key(words, mix(values[200:])).mean() < 0.01


def test_refinement_puts_equal_strings_in_one_bucket():
    rng = random.Random(8)
    for length in (8, 9, 20, 96, 100, 128):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 150))) for _ in range(6)]
        raw = "".join(rng.choice(parts) for _ in range(20)).encode() + b"a" * 300
        pointer = suffixdedup.refine(np.frombuffer(raw, np.uint8), length).tolist()
        whole = range(len(raw) - length + 1)
        groups = defaultdict(set)
        for i in whole:
            groups[raw[i : i + length]].add(pointer[i])
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
        order = sorted(whole, key=lambda i: pointer[i])
        assert [raw[i : i + length] for i in order] == sorted(raw[i : i + length] for i in whole)


def test_suffix_dedup_of_a_very_long_text(spark):
    rng = random.Random(14)
    long = "".join(rng.choice("abcdefghij ") for _ in range(3_000_000))
    rows = [(1, long[1_000_000:1_000_300]), (2, long), (3, long[:50] + long[2_500_000:2_500_150])]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(1_000_000, 1_000_300)], 3: [(50, 200)]}


def test_extra_columns_do_not_matter(docs):
    bare = docs.select("doc_id", "text")
    for f in (linededup.dedup_lines, suffixdedup.remove_repeats, neardedup.link):
        a, b = (Counter(str(r) for r in f(x).collect()) for x in (docs, bare))
        assert a == b
    assert isinstance(F.lit(1), object)


@pytest.mark.parametrize("hot", [1, 1_000])
def test_lines_of_hot_keys_and_long_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_ROWS", hot)
    monkeypatch.setattr(linededup, "HOT_SHARE", 5)
    rng = random.Random(21)
    lines = [f"a line that some hold, number {i}" for i in range(30)]
    rows = [(i, "\n".join(["the line of all documents", *rng.sample(lines, i % 4), f"own line of {i}"])) for i in range(60)]
    rows += [(60, "\n".join([*(f"long text, line {i}" for i in range(60_000)), lines[0]])), (61, "long text, line 59999\n" * 3)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.lines(rows))


def test_shards_are_cut_from_fractional_ranks(spark):
    """The whole order, against a plain version: ranks by the seeded hash within sources, then by fraction."""
    import hashlib

    rows = [(i, f"text {i % 17}", [None, "a", "b", "a"][i % 4]) for i in range(211)]
    key = lambda d, t: int(hashlib.md5(f"11\x1f{d}\x1f{t}".encode()).hexdigest()[:15], 16)
    strata = defaultdict(list)
    for d, t, s in rows:
        strata["n" if s is None else "s" + s].append((key(d, t), d, t))
    line = sorted(((i + 0.5) / len(own), s, k, d) for s, own in strata.items() for i, (k, d, _) in enumerate(sorted(own)))
    want, n = {}, len(rows)
    for pos, (*_, d) in enumerate(line):
        shard = pos * 24 // n
        want[d] = (shard, pos - -(-shard * n // 24))
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    assert {r.doc_id: (r.shard, r.slot) for r in got.collect()} == want


def test_tidy_passes_all_batches_and_errors_on():
    import pyarrow as pa

    from candlewick.llm.runtime import tidy

    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    assert list(tidy(lambda got: got)(iter(batches))) == batches and list(tidy(lambda got: got)(iter([]))) == []

    def fails(got):
        yield next(got)
        raise ValueError("in the part")

    run = tidy(fails)(iter(batches))
    assert next(run) == batches[0]
    with pytest.raises(ValueError, match="in the part"):
        next(run)
