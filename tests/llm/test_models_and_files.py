"""The classifier, HTML extraction, token files and the pipeline."""

import io
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import htmlmain, labelled_pages, planes, quality, tokens
from candlewick.llm.bpe import Encoder
from candlewick.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_operators import odd_rows, prose

SF = "/root/testdata/sf0.01"
ODD = ["a  b", " x", "x ", "a\n\nb", "a\tb c", "don't we'll", "a \nb", "x… y", "1,2 3.4", "<|endoftext|> a", "ab.. c", "日本 語。", "a.\nb!! c??", "x\x1cy z", None, "", "\n", "a", "a b c", "ǅx ªb", "it's,'s b", "﻿a b", "é x"]


def test_pieces_give_the_library_s_ids():
    e = Encoder(tokenizer_path())
    rng = random.Random(4)
    texts = ODD + [prose(rng, 200) for _ in range(20)] + [r[1] for r in odd_rows()] + ["".join(rng.choice("ab \n.,'é1") for _ in range(60)) for _ in range(300)]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [(None if i == 3 else i, rng.integers(0, [1, 50_257, 2**32][i % 3], rng.integers(0, 400), dtype=np.uint64).astype("<u4")) for i in range(60)]
    sink = io.BytesIO()
    w = planes.Writer(sink, kind, block=256)
    for d, ids in docs:
        w.add(d, ids.tobytes())
    w.close()
    r = planes.Reader(sink, len(sink.getvalue()))
    back = [(d, np.concatenate(p) if p else np.zeros(0, "<u4")) for d, p in r.documents()]
    assert [d for d, _ in back] == [d for d, _ in docs]
    assert all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(back, docs, strict=True))
    every = np.concatenate([x for _, x in docs])
    for start, n in ((0, 10), (250, 20), (1000, 1500), (len(every) - 3, 3), (5, 0)):
        assert (r.read(start, n) == every[start : start + n]).all()
    with pytest.raises(ValueError):
        planes.Reader(io.BytesIO(b"x" * 40), 40)


def test_token_files_in_spark(spark):
    rows = [r[:2] for r in odd_rows()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    e = Encoder(tokenizer_path()).tokenizer
    got = tokens.encode_corpus(docs, tokenizer_path()).collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.encode_corpus(docs.filter("false"), tokenizer_path()).collect() == []


def test_classifier_on_held_out_rows(spark):
    scored = QUERIES["op5_subword_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = scored.join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(bad) >= 5 and np.mean(good[:, None] > bad) > 0.85
    assert ((got.predicted == 1) == (got.score >= 0.3)).all() and got[got.quality == 1].predicted.mean() > 0.97
    again = QUERIES["op5_subword_quality"](spark, SF).toPandas().set_index("doc_id").score
    assert np.allclose(scored.toPandas().set_index("doc_id").score.sort_index(), again.sort_index(), atol=0)


def test_classifier_scores_odd_texts(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, 30) if i % 2 else "### $$$ " * 20) for i in range(40)]
    d = spark.createDataFrame([(*r, 0.1) for r in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 7)], "doc_id long, label int")
    model = quality.fit(d, labels, quality.Config(buckets=1 << 12, epochs=8))
    odd = spark.createDataFrame([(r[0], r[1], "x") for r in odd_rows()], "doc_id long, text string, predicted string")
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == len(odd_rows())
    bias = 1 / (1 + np.exp(-model.bias))
    assert all(r.score == pytest.approx(bias) for r in got.filter("text IS NULL OR trim(text) = ''").collect())
    same = quality.score(d, model).toPandas()
    assert (same.score[1::2].mean() > 0.6) and same.score[0::2].mean() < 0.4
    assert quality.score(odd.filter("false"), model).count() == 0
    one = quality.fit(d, labels.filter("label = 1"))
    assert one.bias > 0 and not one.weight.any()
    assert quality.fit(d, labels.filter("false")).bias == 0
    kept = quality.accept(d, model, 0.5)
    assert kept.columns == d.columns and kept.count() == 20


def test_a_text_scores_the_same_in_any_batch():
    rng = random.Random(6)
    texts = [(prose(rng, rng.randint(0, 50))).encode() for _ in range(50)] + [b"", b" ", b"a", b"ab"]
    m = quality.Model(np.random.default_rng(0).normal(size=1 << 12).astype(np.float32), 0.1, quality.Config(buckets=1 << 12))
    assert np.allclose(m.logits(texts), [m.logits([t])[0] for t in texts], atol=1e-9)


def test_labelled_pages_are_extracted():
    w = htmlmain.default_weights()
    assert all(v < 0 for v in w.tag.values()) and w.other_tag < 0
    for source, lines in labelled_pages._BY_HAND:
        assert htmlmain.main_text(source, w).split("\n") == lines
    # pages made by the same rule, but not learned from
    fresh = labelled_pages.pages(200, seed=5)[-200:]
    right = [htmlmain.main_text(source, w).split("\n") == lines for source, lines in fresh]
    assert np.mean(right) > 0.8


def test_scan_finds_the_best_of_all_stretches():
    rng = random.Random(7)
    for _ in range(400):
        x = [rng.randint(-6, 5) for _ in range(rng.randint(0, 14))]
        every = [(sum(x[a:b]), -b, -a) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
        start, end = htmlmain.best_stretch(x)
        best = max((e[0] for e in every), default=0)
        assert sum(x[start:end]) == max(best, 0) and (end > start) == (best > 0)


def test_the_scan_decides():
    """Without the scan, pages whose elements have no names come out otherwise, and worse."""
    w = htmlmain.default_weights()
    better = worse = 0
    for source, lines in labelled_pages.pages(300, seed=6)[-300:]:
        page = htmlmain.parse(labelled_pages.unnamed(source))
        flat = [page.texts[b] for b, p in enumerate(w.probabilities(page)) if p > 0.5]
        scanned = [page.texts[b] for b in htmlmain.chosen(page, w)]
        better += flat != lines and scanned == lines
        worse += flat == lines and scanned != lines
    assert better > worse


def test_extraction_takes_time_in_proportion_to_the_page():
    w = htmlmain.default_weights()
    made = lambda k: "<div><b class=x>" * k + "</i>" * k + "<p>text<li>" * k
    times = []
    for k in (4_000, 16_000):
        began = time.perf_counter()
        htmlmain.main_text(made(k), w)
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0] + 0.5


@pytest.mark.parametrize(
    "source,want",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("plain text", "plain text"),
        ("<p>a&amp;b &lt;c&gt; &eacute; &#x41;&nbsp;d</p>", "a&b <c> é A d"),
        ("<article><p>One <b>bo</b>ld<br>word.</article>", "One bold word."),
        ("<div class='ad'>Buy<article><h1>T</h1><p>Body text here.</p></article>", "T\nBody text here."),
        ("<article><h1>T</h1><p>x</p><aside>" + "noise " * 300 + "</aside><p>End.</p></article><footer>f</footer>", "T\nx\nEnd."),
        ("<article><p>Text</p></article><section class=comments><article class=comment><p>Nice post, really nice</p></article></section>", "Text"),
        ("<article><p>Keep</p><script>if (a<b) x='</p>'</script><!-- <p>no</p> --><style>p{}</style><p hidden>no</p></article>", "Keep"),
        ("<p>never closed <i>tag <a href='x\">oops", "never closed tag oops"),
        ("<article><p>A</p><!-- open", "A"),
        ("<ul><li>One<li>Two</ul>", "One\nTwo"),
        ("<article><header><h1>Site</h1></header><p>Body</p></article>", "Body"),
        ("3 < 4 and 5 > 2", "3 < 4 and 5 > 2"),
        ('<body class="has-sidebar"><div class="main-with-sidebar"><p>Story of a long day in the fields. It rained.</p></div><div class=sidebar><a href=/x>More</a></div>', "Story of a long day in the fields. It rained."),
        ('<article><h1>T</h1><p>First one here.</p><div class="related-work"><p>Others did this before.</p></div><section id="search-algorithms"><p>We search in order.</p></section><p>So <math><mi>x</mi></math> is.</p></article>', "T\nFirst one here.\nOthers did this before.\nWe search in order.\nSo x is."),
        ('<article class="post no-comments"><p>The whole text stands here.</p></article><footer>Bye now</footer>', "The whole text stands here."),
        ('<div class="page has-sidebar"><header>Site name</header><p>The whole text stands here, in a paragraph.</p><p>And here.</p></div>', "The whole text stands here, in a paragraph.\nAnd here."),
    ],
)
def test_pages(source, want):
    assert htmlmain.main_text(source, htmlmain.default_weights()) == want


def test_extraction_in_spark(spark):
    long = "<article>" + "<p>word word</p>" * 5_000 + "</article>"
    rows = [(1, "u", "<article><p>A</p></article>", "old"), (1, "u", "<article><p>A</p></article>", "old"), (None, None, None, None), (2, None, "", ""), (3, "v", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmlmain.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((str(r.page_id), len(r.text)) for r in got.collect()) == [("1", 1), ("1", 1), ("2", 0), ("3", 5_000 * 10 - 1), ("None", 0)]
    assert htmlmain.extract(df.filter("false")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as p
    from candlewick.llm import decontam, neardedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES[:-1]:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs
    assert 700 < seen["quality"].count() < 1_000
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(seen["near_duplicates"]) == {r.doc_id for r in neardedup.link(seen["quality"]).filter("kept").collect()}
    clean = decontam.find(seen["near_duplicates"], spark.read.parquet(f"{SF}/benchmark.parquet")).filter(F.size("spans") == 0)
    assert ids(seen["decontamination"]) == ids(clean) and ids(clean) < ids(seen["near_duplicates"])
    words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(seen["mixing"]) - words(seen["decontamination"])) < 20
    final = p.STAGES[-1][1](spark, docs, SF)
    assert final.count() == docs.count()


def test_pipeline_survives_odd_documents(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(r[0], r[1], r[2], r[3], 1) for r in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.filter("false")):
        for _, stage in p.STAGES:
            part = stage(spark, part, SF)
        part.collect()


def test_pipeline_drops_near_duplicates_from_a_similarity_of_four_fifths(spark):
    import corpus_pipeline as p
    from tests.llm import brute

    base = [f"w{i}" for i in range(150)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(1, changed()), (2, changed(20, 60, 100)), (3, changed(20, 40, 60, 80, 100, 120))]
    a, b, c = (brute.shingles(t) for _, t in rows)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and max(len(a & c) / len(a | c), len(b & c) / len(b | c)) < 0.85
    got = {r.doc_id for r in p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    near = brute.near(rows, percent=80)
    assert got == {d for d, first in near.items() if d == first} and 2 not in got


def test_classifier_learns_from_all_features_of_a_long_text(spark, monkeypatch):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3_000))
    monkeypatch.setattr(quality, "train", lambda samples, config: samples)
    d, labels = (spark.createDataFrame(r, s) for r, s in (([(1, long), (2, "short text")], "doc_id long, text string"), ([(1, 1), (2, 0)], "doc_id long, label int")))
    (at, n, _), _ = sorted(quality.fit(d, labels), key=lambda s: -len(s[0]))
    ((want, count),) = quality.counts([long.encode()], quality.Config())
    assert len(want) > 4_000 and at.tolist() == want.tolist() and n.tolist() == count.tolist()


def test_benchmark_items_without_an_id_are_searched_for(spark, tmp_path):
    import corpus_pipeline as p

    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing of that"), (3, "alpha beta")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, passage), (7, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in QUERIES["op6_benchmark_phrases"](spark, str(tmp_path)).collect()}
    assert got == {1: (11, 0, True), 2: (0, 0, False), 3: (2, 1, True)}
    assert [r.doc_id for r in p.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]
