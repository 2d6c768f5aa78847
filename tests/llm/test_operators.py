"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import decontaminate, hmm, html, mixing, pii, quality, queries, simhash, sketch, substring, topk, toxicity, windows
from maskwright.llm.components import components

from ..conftest import SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use within themselves.
CLASH = ", h long, f long, w string, size int, copies int, target double, spans string, score double, words string, k int, row int, gone int, label int"


def frame(spark, rows, clash=False):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    if clash:
        return spark.createDataFrame([(*r, 1, 2, "w", 3, 4, 5.0, "s", 6.0, "ws", 7, 8, 9, 10) for r in full], DOC + CLASH)
    return spark.createDataFrame(full, DOC)


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


LONG = prose(1, 60_000)
ODD = [(1, None, "a"), (2, "", None), (None, prose(5, 80), "b"), (3, " \n\t ", ""), (4, prose(5, 80), "b"), (4, prose(5, 80), "b"), (5, LONG, "a"), (6, "one", "a"), (7, "é ñ 😀 ß " * 30, "c"), (8, prose(5, 80) + " tail", "a")]


def labelled(spark, column):
    rows = []
    for i in range(80):
        rows.append((100 + i, ("idiot moron trash " if column == "toxic" else "$$$ ### $$$ *** ") + prose(i, 40) if i % 2 else prose(i, 60), "a"))
    labels = spark.createDataFrame([(100 + i, i % 2 if column == "toxic" else 1 - i % 2) for i in range(80)] + [(None, 1), (101, None)], f"doc_id long, {column} int")
    return rows, labels


@pytest.mark.parametrize("module,column,mod,rest,cut", [(quality, "quality", 4, 2, 0.7), (toxicity, "toxic", 5, 0, 0.5)])
def test_classifiers(spark, module, column, mod, rest, cut):
    rows, labels = labelled(spark, column)
    docs = frame(spark, rows + ODD, clash=True)
    got = module.score(docs, module.train(docs, labels)).collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (crc32(str(r.doc_id).encode()) % mod == rest if r.doc_id is not None else False)
    known = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id >= 100}
    right = sum(known[100 + i] == (i % 2 if column == "toxic" else 1 - i % 2) for i in range(80))
    assert right >= 76
    for none in (labels.limit(0), labels.where(f"{column} = 1")):
        assert module.score(docs, module.train(docs, none)).count() == len(got)
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0


def test_bradley_terry_is_the_least_loss():
    """The Newton fit against plain descent on the same pairs' logistic loss."""
    r = np.random.default_rng(2)
    x = r.normal(size=(120, len(quality.FEATURES)))
    label = (x[:, 0] - 0.7 * x[:, 3] + r.normal(size=120) > 0).astype(int)
    m = quality.fit(x, label)
    z = np.clip((x - m["mean"]) / m["scale"], -6, 6)
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    a = np.concatenate([np.repeat(good, quality.PARTNERS), rng.choice(good, len(bad) * quality.PARTNERS)])
    b = np.concatenate([rng.choice(bad, len(good) * quality.PARTNERS), np.repeat(bad, quality.PARTNERS)])
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        p = 1 / (1 + np.exp(-((z[a] - z[b]) @ w)))
        w -= 1.0 * ((z[a] - z[b]).T @ (p - 1) / len(a) + 2e-3 * w)
    assert np.allclose(w, m["w"], atol=1e-3)
    s = quality.rank(m, x)
    assert abs(np.quantile(z @ m["w"], m["quantile"]) - m["cut"]) < 1e-9 and ((s >= quality.CUT) == (z @ m["w"] >= m["cut"] - 1e-12)).mean() > 0.98


def test_toxicity_counts_and_ratios(spark):
    """The counts over tasks and the ratios against a plain loop, and the score against a plain sum."""
    rows, labels = labelled(spark, "toxic")
    docs = frame(spark, rows + [rows[1]] * 40)
    m = toxicity.train(docs.repartition(5), labels)
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None and crc32(str(r.doc_id).encode()) % 5}
    held = {i: set(toxicity.buckets(t).tolist()) for i, t, _ in rows if i in y}
    p, q = Counter(), Counter()
    for i, s in held.items():
        (p if y[i] else q).update(s)
    n1 = sum(y.values())
    ratio = {b: math.log(((p[b] + 1) / (n1 + 2)) / ((q[b] + 1) / (len(y) - n1 + 2))) for b in p | q if p[b] + q[b] >= toxicity.LEAST_DOCS}
    ratio = {b: x for b, x in ratio.items() if abs(x) >= toxicity.LEAST_RATIO}
    used = set(np.flatnonzero(m["w"]).tolist())
    assert used <= set(ratio) and len(used) > 0.9 * len(ratio)
    docs_ = [sorted(held[i]) for i in sorted(held)]
    label = np.array([y[i] for i in sorted(held)])
    col = {b: k for k, b in enumerate(sorted(ratio))}
    x = np.zeros((len(docs_), len(col)))
    for i, d in enumerate(docs_):
        for b in d:
            if b in col:
                x[i, col[b]] = ratio[b]
    w, c, vw, vc = np.full(len(col), 0.02), 0.0, 0.0, 0.0
    weight = np.where(label == 1, 1 / (2 * n1), 1 / (2 * (len(label) - n1)))
    for t in range(300):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w + c, -30, 30))) - label)
        vw, vc = 0.9 * vw + x.T @ g + 2e-3 * w, 0.9 * vc + g.sum()
        w, c = w - 0.08 / (1 + t / 100) * vw, c - 0.08 / (1 + t / 100) * vc
    want = np.array([ratio[b] * w[k] for b, k in col.items()])
    assert np.allclose(m["w"][list(col)], np.where(np.abs(want) < 1e-4, 0, want), atol=2e-4) and math.isclose(m["b"], c, abs_tol=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def brute_lm(texts):
    tokens = {i: t.encode().lower().split() + [b"\n"] for i, t in texts}
    counts = Counter(w for i, ws in tokens.items() for w in ws if crc32(str(i).encode()) % 7 != 2)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(w in counts for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}, n


def test_language_model_base(spark):
    rows = [(i, prose(i, 5 + i % 60) if i % 9 else "", "a") for i in range(150)]
    want, n = brute_lm([(i, t) for i, t, _ in rows])
    model = hmm.Model(frame(spark, rows, clash=True))
    for r in model.score(frame(spark, rows, clash=True)).collect():
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == n
        assert math.isclose(r.base_score, want[r.doc_id][2], rel_tol=1e-9) and -1e5 < r.score < 0
    assert len(model.score(frame(spark, ODD)).collect()) == len(ODD)
    empty = hmm.Model(frame(spark, []))
    assert [r.base_score for r in empty.score(frame(spark, [(1, "a b", "x")])).collect()] == [0.0]


def test_forward_recursion_is_exact():
    r = np.random.default_rng(3)
    k, c = 3, hmm.OWN + hmm.SHARED
    m = {"pi": r.dirichlet(np.ones(k)), "a": r.dirichlet(np.ones(k), k), "et": r.random((c, k)), "k": k}
    seqs = [r.integers(0, c, n).astype(np.int32) for n in (1, 2, 4, 5)]
    for x, n, part in hmm.by_length(seqs):
        log = hmm.forward(m, x, n)
        for j, i in enumerate(part):
            total = 0.0
            for path in np.ndindex(*(k,) * len(seqs[i])):
                p = m["pi"][path[0]] * m["et"][seqs[i][0], path[0]]
                for t in range(1, len(path)):
                    p *= m["a"][path[t - 1], path[t]] * m["et"][seqs[i][t], path[t]]
                total += p
            assert math.isclose(log[j], math.log(total), rel_tol=1e-9)


def test_baum_welch_never_falls():
    """With the plain M-step no step lowers the likelihood; ``normal`` adds a few counts to it, so that nothing is impossible."""
    r = np.random.default_rng(4)
    seqs = [r.integers(0, 50, n).astype(np.int32) for n in r.integers(1, 40, 60)]
    mass = np.bincount(np.concatenate(seqs), minlength=hmm.OWN + hmm.SHARED).astype(float)
    hists = np.array([np.bincount(s, minlength=hmm.OWN + hmm.SHARED) for s in seqs], np.float32)
    m, last = hmm.start(hists, mass, mass + 1, k=3), -np.inf
    for _ in range(6):
        into = hmm.empty_counts(3)
        for x, n, _ in hmm.by_length(seqs):
            hmm.expected(m, x, n, into)
        assert math.isclose(into["e"].sum(), mass.sum(), rel_tol=1e-5) and into["log"] >= last - 1e-3
        last = into["log"]
        m = {"pi": into["pi"] / into["pi"].sum(), "a": into["a"] / into["a"].sum(1, keepdims=True), "et": np.ascontiguousarray((into["e"] / into["e"].sum(1, keepdims=True)).T), "k": 3}
    close = hmm.normal(into, mass * 1e6, mass * 1e6)
    assert np.abs(hmm.normal({**into, "e": into["e"] * 1e6, "a": into["a"] * 1e6, "pi": into["pi"] * 1e6}, mass, mass)["et"] - m["et"]).max() < 1e-4 and (close["a"] > 0).all()


PAGES = {
    "<article><header><h1>T</h1><p>By me</p></header><p>x</p><ul><li>one<li>two</ul><aside>side</aside><p>end</p><section class=comments><p>no</p></section></article><div class=related>rel</div>": "T\nx\none\ntwo\nend",
    '<body class="has-sidebar"><div id="menu"><a href=x>Home</a></div><div class="content"><h1>Big</h1><p>Some long text that goes on and on for a while.</p><p>Short.</p><div class="ad">Buy</div><p>More text, which is long enough to be a paragraph of its own.</p></div><div class="comments"><p>I disagree with all of this very much indeed, so I write.</p></div>': "Big\nSome long text that goes on and on for a while.\nShort.\nMore text, which is long enough to be a paragraph of its own.",
    "<p>a &lt; b &amp; c&nbsp;d <i>x</i>y": "a < b & c d xy",
    '<script>var t="</p>";</script><p>t</p><!-- <p>no</p> -->': "t",
    "<nav><a href=x>a</a></nav><footer>c</footer>": "",
    "": "",
    None: "",
    "<<<>>> < b": "<<<>>> < b",
}


def test_extraction(spark):
    rows = [(i, "u", h, 1) for i, h in enumerate(PAGES)] + [(99, None, "<p>" + "x " * 100_000, 2), (99, None, "<p>" + "x " * 100_000, 2)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id < 99} == dict(enumerate(PAGES.values()))
    assert all(len(r.text) == 199_999 for r in got if r.page_id == 99)


def test_odd_pages_cost_linear_time():
    for h in ("<b>x" * 50_000, "<div>x" * 50_000, '<a "' * 50_000, "<" * 200_000, "<a href='x>y" * 30_000, "</p>x" * 50_000, "<!-- " * 50_000):
        html.main_text(h)


def test_long_attributes_and_deep_pages():
    long = "x > y " * 40_000
    assert html.main_text(f'<p><a title="{long}" href=a>in</a> and out</p>') == "in and out"
    assert html.main_text(f"<p title='{long}'>text</p><p data-x=\"{long}\">more") == "text\nmore"
    deep = "<div>" * 5000
    assert html.main_text(f"{deep}<article><p>kept text of the page</p></article><div class=comments><p>not this one</p></div>") == "kept text of the page"


def test_extraction_of_articles():
    import pandas as pd

    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    from html import unescape

    for h in pages.html:
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)[^>]*>", re.sub("<br>", " ", re.sub("</?b>", "", inner)))
        assert html.main_text(h) == "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def plain_spans(t):
    digits = lambda s: re.sub(r"\D", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.2@+- ()9Z_%5٣é", max_size=60))
def test_base_spans(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_cost_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000):
        pii.base_spans(t)


def test_personal_data(spark):
    rows = [(100 + i, t, "a") for i, t in enumerate(("mail a.b@c.de now", "call 555-123-4567 today, phone 555-123-4567", "ip 1.2.3.4 card 4845 1681 1440 7329", "4845168114407328 is no card", "My name is Anna Smith", "x y z"))]
    docs = frame(spark, rows * 3 + ODD, clash=True)
    w = pii.learn(docs)
    got = [r for r in pii.find(docs, w).collect()]
    assert len(got) == 3 * len(rows) + len(ODD)
    text = {(i, t or "") for i, t, _ in rows + ODD}
    for r in got:
        t = next(x for i, x in text if i == r.doc_id) if r.doc_id not in (4,) else None
        if t is None:
            continue
        base = plain_spans(t)
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(filter(None, r.spans.split(",")))
        if t.startswith(("4845168114407328", "x y z")):
            assert r.spans == ""
        assert r.n_spans == len(list(filter(None, r.spans.split(","))))
    masked = pii.mask(docs, w)
    assert masked.columns == docs.columns and masked.count() == len(got)
    assert masked.where("contains(text, 'a.b@c.de')").count() == 0 and masked.where("text = 'mail [EMAIL] now'").count() == 3
    assert pii.find(docs.limit(0), pii.learn(docs.limit(0))).count() == 0


def brute_em(counts, steps=60):
    """The EM of ``pii.aggregate`` written out candidate class by candidate class."""
    n_labels = len(pii.LABELERS)
    never = {k: k[0] == 2 and k[4] == -1 for k in counts}
    p = {k: 0.0 if never[k] else 1 / (1 + math.exp(-1.5 * sum(k[1:]))) for k in counts}
    for _ in range(steps):
        yes, no = [], []
        for j in range(1, n_labels + 1):
            for out, of, right in ((yes, lambda k: p[k], 1), (no, lambda k: 1 - p[k], -1)):
                a = sum(counts[k] * of(k) for k in counts if k[j] == right) + 7
                b = sum(counts[k] * of(k) for k in counts if k[j] == -right) + 3
                out.append(min(0.995, max(0.55, a / (a + b))))
        total = sum(counts.values())
        prior = min(0.95, max(0.05, (sum(counts[k] * p[k] for k in counts) + 1) / (total + 2)))
        for k in counts:
            z = math.log(prior / (1 - prior))
            for j in range(n_labels):
                z += math.log(yes[j] / (1 - no[j])) if k[1 + j] == 1 else math.log((1 - yes[j]) / no[j]) if k[1 + j] == -1 else 0
            p[k] = 0.0 if never[k] else 1 / (1 + math.exp(-z))
    return p


def test_votes_are_weighed_and_the_classifier_fitted(spark):
    r = random.Random(4)
    texts = [r.choice(("phone 555-123-%04d now", "order 555-123-%04d sent", "My name is Anna Smith%d", "write to a%d [at] b [dot] com", "card 4845 1681 1440 %04d", "tel +49 30 %07d")) % r.randrange(1, 9999) for _ in range(200)]
    counts, xs, ys = Counter(), [], []
    for t in texts:
        base = pii.base_spans(t)
        for a, k, e in base + pii.proposals(t, base):
            v = pii.votes(t, a, k, e)
            counts[(k, *v)] += 1
            xs.append(pii.inputs(t, a, k, e, v))
            ys.append((k, *v))
    posterior, want = pii.aggregate(dict(counts))[0], brute_em(counts)
    assert all(math.isclose(posterior[k], want[k], rel_tol=1e-6, abs_tol=1e-9) for k in counts)
    total = sum(n**0.5 for n in counts.values())
    weight = np.array([100 * counts[k] ** -0.5 / total * len(counts) for k in ys])
    x, y, w = pii.matrix(*map(list, zip(*xs, strict=True))), np.array([want[k] for k in ys]), np.zeros(pii.WIDTH)
    loss = lambda w: weight @ (np.logaddexp(0, x @ w) - y * (x @ w)) + pii.RIDGE / 2 * w @ w
    got = pii.learn(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3))
    for _ in range(2000):  # plain descent on the same loss
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 0.02 * (x.T @ (weight * (p - y)) + pii.RIDGE * w) / weight.sum() * 10
    assert loss(got) <= loss(w) + 1e-3 * abs(loss(w))
    # the words around tell apart what the votes don't
    assert np.abs(got[pii._DENSE :]).max() > 0.05


def test_masks_lose_no_tolerated_window():
    for n in range(decontaminate.TOLERANT, decontaminate.WINDOW + 1):
        for miss in combinations(range(n), n - math.ceil(decontaminate.SHARE * n)):
            assert any(all(p + o not in miss for o in m) for m in decontaminate.MASKS for p in range(n - m[-1])), (n, miss)


def test_decontamination(spark):
    items = [(1, prose(11, 30)), (2, prose(12, 12)), (3, "too short here"), (4, None), (5, prose(11, 30)), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = prose(11, 30).split()
    for k in range(4, 30, 5):
        words[k] = "changed"
    rows = [(10, "start " + prose(11, 30) + " end", "a"), (11, " ".join(words), "a"), (12, prose(12, 12).upper().replace(" ", ", "), "a"), (13, "too short here", "a"), (14, prose(99, 400, 10_000), "a"), (15, " ".join(prose(11, 30).split()[:21]), "a"), (16, " ".join(prose(11, 30).split()[:10]), "a")]
    docs = frame(spark, rows + [rows[0]] + [(i, t, s) for i, t, s in ODD], clash=True)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(10, 1), (10, 5), (11, 1), (11, 5), (12, 2), (13, 3), (15, 1), (15, 5)]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 13, 14, 16]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_against_sql(spark):
    """All places of all passages compared by SQL, short passages and edited ones among them."""
    import duckdb
    import pandas as pd

    r = random.Random(3)
    items = [(i, prose(200 + i, 1 + i % 33, 40)) for i in range(60)]
    rows = []
    for i in range(150):
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = "edit"
        rows.append((i, f"{prose(i, r.randrange(0, 40), 40)} {' '.join(w)}, {prose(i + 7, r.randrange(0, 40), 40)}"))
    con = duckdb.connect()
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(queries.OP5_SQL).fetchall())
    got = decontaminate.contaminated(frame(spark, [(i, t, "a") for i, t in rows]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x.doc_id, x.item_id, x.agreeing, x.window) for x in got.collect()) == want and len(want) > 100


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 20)) for i in range(30)], "item_id long, text string")
    docs = frame(spark, [(i, prose(i, 20), "a") for i in range(40)])
    monkeypatch.setattr(decontaminate, "SENT", 100)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(i, i) for i in range(30)]


def brute_removed(rows):
    first = {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_substrings(spark):
    r = random.Random(2)
    shared = [prose(50 + k, 70) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(1000 + i, r.randrange(1, 60)) for _ in range(3)]
        for s in r.sample(shared, 2):
            w = s.split()
            a = r.randrange(0, 15)
            parts.insert(r.randrange(len(parts)), " ".join(w[a : a + r.randrange(48, 60)]))
        rows.append((i, "  ".join(parts)))
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, "same " * 200), (62, "same " * 120), (63, None), (64, ""), (65, rows[3][1].upper())]
    docs = frame(spark, [(i, t, "a") for i, t in rows], clash=True)
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove(docs).collect())
    assert got == brute_removed(rows) and sum(x[2] for x in got) > 3000
    odd = substring.remove(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and {x.n_removed for x in odd if x.doc_id in (None, 4)} == {0} and next(x for x in odd if x.doc_id == 8).n_removed == 80
    assert substring.remove(frame(spark, [])).count() == 0


def test_many_equal_rows(spark):
    """Thousands of equal rows: each comes back from every operator, and none of them multiplies another's work."""
    text = prose(71, 120)
    rows = [(1, prose(70, 30) + " " + text, "a")] + [(2, text + " " + text, "b")] * 5000
    docs = frame(spark, rows)
    got = substring.remove(docs).collect()
    assert Counter((x.doc_id, x.n_removed) for x in got) == {(1, 0): 1, (2, 240): 5000}
    assert simhash.near_duplicates(docs).groupBy("doc_id").count().where("count = 5000").count() == 1
    w = pii.learn(docs)
    assert pii.find(docs, w).count() == 5001
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 5001


def test_sketch_never_underestimates(spark):
    r = np.random.default_rng(1)
    keys = windows.mix(r.integers(0, 1 << 40, 5000).astype(np.uint64))
    twice = keys[:700]
    parts = [sketch.partial(x, sketch.LEAST_CELLS) for x in (keys, twice)]
    rows = [tuple(v.as_py() for v in row) for p in parts for row in zip(*p.columns, strict=True)]
    bits = sketch.merge(spark.createDataFrame(rows, sketch.SCHEMA), sketch.LEAST_CELLS, 2)
    assert sketch.holds(bits, twice, sketch.LEAST_CELLS).all()
    assert sketch.holds(bits, keys[700:], sketch.LEAST_CELLS).mean() < 0.05


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints, reach):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= reach:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return {k: min(groups[find(i)]) for i, k in enumerate(ids)}


def test_near_duplicates(spark):
    rows = [(i, prose(i // 3, 30) + (" x" if i % 3 == 1 else "")) for i in range(90)] + [(200, None), (201, ""), (202, "A b"), (203, "a B")]
    docs = frame(spark, [(i, t, "a") for i, t in rows], clash=True)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{p:016x}" for p in prints]
    assert {i: r.component_id for i, r in got.items()} == brute_components([i for i, _ in rows], prints, 4)
    assert simhash.near_duplicates(frame(spark, ODD)).count() == len(ODD) and simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_are_exact_among_near_fingerprints(spark, monkeypatch):
    """Clusters of fingerprints a few bits apart, in small shards that are dealt in parts."""
    r = random.Random(6)
    prints = set()
    for _ in range(40):
        c = r.getrandbits(64)
        for _ in range(12):
            prints.add(c ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 7))))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "PART", 5)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "f long, doc_id long")
    monkeypatch.setattr(simhash, "SHARD", 15)
    got = {r.f: r.component_id for r in simhash.classes(found).collect()}
    want = brute_components(list(range(len(prints))), prints, 4)
    assert {i: got[s] for i, s in enumerate(signed)} == want


def test_visits_miss_no_ball_point():
    """The triangle bound prunes branches, and none that a point of the ball lies in."""
    r = np.random.default_rng(5)
    points = r.integers(0, 1 << 16, 3000).astype(np.uint64)
    for width in (16, 64):
        tree = simhash.Tree(points, 1, 20, 1, width)
        home = dict(zip(*(x.tolist() for x in tree.visit(np.arange(1 << 16, dtype=np.uint64), 0)), strict=True))
        assert len(home) == 1 << 16
        seen = {}
        visits = tree.visit(points[:200], 1)
        assert tree.pruned > 200 * 5 and len(visits[0]) < 200 * tree.leaves / 3
        for i, leaf in zip(*visits, strict=True):
            seen.setdefault(int(i), set()).add(int(leaf))
        for i, p in enumerate(points[:200].tolist()):
            assert {home[p]} | {home[p ^ (1 << k)] for k in range(16)} <= seen[i]


def test_a_shard_s_pairs_are_exact():
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2)
    points = np.unique(np.concatenate([base ^ sum(np.uint64(1) << r.integers(0, 64, 30, dtype=np.uint64) for _ in range(k)) for k in range(7)]))
    own = r.random(len(points)) < 0.6
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 4
    pairs = [(i, j) for i, j in combinations(range(len(points)), 2) if near[i, j] and (own[i] or own[j])]
    for cells in (7, 1_000_000):
        far, first = simhash.forest(points, own, 4, cells)
        assert brute_groups(len(points), list(zip(far.tolist(), first.tolist(), strict=True))) == brute_groups(len(points), pairs)


def test_components(spark):
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_copies_keep_one(spark):
    base = [prose(i, 150, 5000) for i in range(25)]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        w[70] = "edited"
        rows += [(3 * i, t), (3 * i + 1, t), (3 * i + 2, " ".join(w))]
    docs = frame(spark, [(i, t, "a") for i, t in rows] + [(900, None, "a"), (901, "", "a"), (None, base[0], "a"), (0, base[0], "a")], clash=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3 * i for i in range(25)] + [900]
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_similar_pairs_are_found(spark):
    """Recall of shingle similarity 0.8 to 0.9: edits are spread so that pairs lie just above the bound."""
    rows = []
    for i in range(120):
        w = prose(5000 + i, 400, 100_000).split()
        v = list(w)
        for k in range(7):
            v[20 + 50 * k] = "edit"
        rows += [(2 * i, " ".join(w), "a"), (2 * i + 1, " ".join(v), "a")]
    kept = simhash.keep_one(frame(spark, rows)).count()
    assert kept <= 120 * 1.03


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(20)]) for i in range(300)] + [(400, [0.5] * 20), (401, [0.5] * 20), (402, None), (403, [None] + [0.1] * 19), (404, [float("nan")] * 20), (405, [float("inf")] * 20), (500, [1.0, 2.0]), (600, []), (None, [0.3] * 20), (400, [0.5] * 20), (401, [0.5] * 20), (700, [1e15] * 20)]
    v = topk.quantised(spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int"))
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(v, v.where("vec_id % 100 = 0"), query_block=3).collect() if x.query_id != 700)
    good = [(i, tuple(math.floor(1024 * y) for y in e)) for i, e in rows if e is not None and all(y is not None and math.isfinite(y) for y in e)]
    want = []
    for q, qv in good:
        if q is None or q % 100 or q == 700:
            continue
        scored = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(qv, cv, strict=True)))), c is None, c or 0) for c, cv in good if c != q and len(cv) == len(qv)))[:10]
        want += [(q, k + 1, None if n else c, -s) for k, (s, n, c) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_top_k_with_many_equal_rows(spark):
    """Copies of the query itself and of its best candidates, in batches smaller than both."""
    rows = [(100, [1.0] * 33)] * 700 + [(7, [0.9] * 33)] * 1500 + [(i, [0.01 * i] * 33) for i in range(8, 60)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(v, v.where("vec_id = 100").limit(2)).collect()
    assert len(got) == 20 and {r.vec_id for r in got} == {7} and sorted(r["rank"] for r in got) == sorted([*range(1, 11)] * 2)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    w, capped = [weights[i % len(weights)] for i in range(len(sizes))], set()
    while True:
        left, mass = sum(sizes) - sum(most * sizes[i] for i in capped), sum(w[i] for i in range(len(sizes)) if i not in capped)
        over = {i for i in range(len(sizes)) if i not in capped and left * w[i] / mass > most * sizes[i]}
        if not over:
            return [float(most * sizes[i]) if i in capped else left * w[i] / mass for i in range(len(sizes))]
        capped |= over


def test_targets(spark):
    r = random.Random(12)
    for n in (1, 2, 3, 7, 40):
        sizes = [int(r.lognormvariate(5, 2)) * (r.random() > 0.1) for _ in range(n)]
        names = [*(f"s{i:03d}" for i in range(n - 1)), None]
        sums = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        got = mixing.targets(mixing.numbered(sums.repartition(5))).orderBy("source_no").collect()
        assert [x.source for x in got] == names and [x.source_no for x in got] == list(range(n))
        assert np.allclose([x.target for x in got], brute_targets(sizes), rtol=1e-12, atol=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 9), st.floats(0, 3)), min_size=1, max_size=60))
def test_copies_stay_near(rows):
    size, n, rate = map(np.array, zip(*sorted(rows, key=lambda r: -r[0]), strict=True))
    low, more = mixing.copies(size, n, rate)
    assert (more >= 0).all() and (more <= n).all() and (low + (more > 0) <= 3).all()
    assert abs(((low * n + more) * size).sum() - (rate * size * n).sum()) <= size.max() / 2 + 1e-6


def test_mix(spark):
    rows = [(i, prose(i, 10 + i % 50), None if i % 11 == 0 else f"s{i % 4}") for i in range(400)] + [(1, None, "s0"), (2, "", "only"), (None, "a b", "s1")]
    docs = frame(spark, rows + [(9000, "the same words each time", "s3")] * 3000, clash=True)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) + 3000
    by = {}
    for r in got:
        by.setdefault((r.target, r.source_size), []).append(r)
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
    for (target, _), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= 40
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, mixing.mix(docs.repartition(7)).collect())) == sorted(map(key, got))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy_no"] and mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
    taken, mixed = Counter(), Counter()
    for r in got:
        taken[r.doc_id] += r.copies
    for r in out.select(F.col(f"`{docs.columns[0]}`")).collect():
        mixed[r[0]] += 1
    assert mixed == +taken


def brute_dual(kinds, targets, sizes):
    """The same problem's solution by bisection within bisection: lambda of each source for a tilt, and the tilt."""
    total = sum(sizes.values())
    words = {k: k[1] * n for k, n in kinds.items()}
    z = {k: math.log(max(1, k[1])) for k in kinds}
    centre = sum(words[k] * z[k] for k in kinds) / total
    z = {k: v - centre for k, v in z.items()}
    rate = lambda x: min(3.0, math.exp(min(20, x)))

    def solve(tilt):
        out = {}
        for s, t in targets.items():
            if t >= 3 * sizes[s] * (1 - 1e-9):
                out[s] = 20.0
                continue
            lo, hi = -30.0, 30.0
            for _ in range(100):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if sum(words[k] * rate(mid + tilt * z[k]) for k in kinds if k[0] == s) > t else (mid, hi)
            out[s] = (lo + hi) / 2
        return out

    lo, hi = -2.0, 2.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lam = solve(mid)
        slope = sum(words[k] * rate(lam[k[0]] + mid * z[k]) * z[k] for k in kinds if k[0] in lam) + mixing.RIDGE * total * mid
        lo, hi = (lo, mid) if slope > 0 else (mid, hi)
    return solve((lo + hi) / 2), (lo + hi) / 2, z


def test_newton_solves_the_dual(spark):
    """Against bisection: multipliers, tilt and rates, with a source at its cap and rates at theirs."""
    r = random.Random(8)
    kinds = {(s, int(r.lognormvariate(4 + 0.5 * s, 0.8)) + 1): r.randrange(1, 30) for s in range(5) for _ in range(40)}
    sizes = {s: sum(k[1] * n for k, n in kinds.items() if k[0] == s) for s in range(5)}
    targets = {s: sizes[s] * f for s, f in enumerate((3.0, 1.9, 0.4, 0.7, 1.3))}
    lam, tilt, z = brute_dual(kinds, targets, sizes)
    table = spark.createDataFrame([(s, k, n, z[(s, k)]) for (s, k), n in kinds.items()], "source_no int, size long, n long, z double")
    sources = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "source_no int, source_size long, target double")
    state, got = mixing.balance(table, sources)
    assert abs(got - tilt) < 2e-3 and abs(tilt) > 0.02  # documents of one source differ in their rates
    state = {r.source_no: r["lambda"] for r in state.collect()}
    for s in sizes:
        flow = sum(k[1] * n * min(3.0, math.exp(min(20.0, state[s] + got * z[k]))) for k, n in kinds.items() if k[0] == s)
        assert math.isclose(flow, targets[s], rel_tol=1e-4), s


def test_queries_and_pipeline(spark, duck):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    got = names["op9_topk_branch_and_bound"](spark, SMALL).toPandas().astype("int64").sort_values(["query_id", "rank"]).values.tolist()
    want = duck.execute(queries.oracle_sql()["op9_topk_branch_and_bound"]).df().astype("int64")[["query_id", "rank", "vec_id", "score"]].sort_values(["query_id", "rank"]).values.tolist()
    assert got == want
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = out.cache()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.columns == [*docs.columns, "copy_no"] and last.count() > 0


def test_similar_pairs_meet_at_any_depth():
    """Pairs whose bits differ as at similarity 0.80 meet in a leaf, however deep the trees."""
    r = np.random.default_rng(4)
    flips = np.arccos(1.6 / 1.8) / np.pi
    points = r.integers(0, 1 << 63, (4000, 8), dtype=np.uint64) * np.uint64(2)
    a = r.integers(0, 1 << 63, (4000, 8), dtype=np.uint64) * np.uint64(2)
    b = a ^ np.packbits(r.random((4000, 512)) < flips, axis=1).view(np.uint64)
    counts = []
    for n in (4000, 400_000):  # leaves of 300 and of 3 sampled fingerprints
        trees, values = simhash._wide_trees(points, n, 0.8)
        met = np.zeros(len(a), bool)
        for k, tree in enumerate(trees):
            met |= tree.table[values(a, k)] == tree.table[values(b, k)]
        assert met.mean() >= 0.99
        counts.append(len(trees))
    assert counts[1] > 2 * counts[0]


def test_near_copies_follow_exact_similarity(spark, monkeypatch):
    """Against brute force, with pairs just under and over 0.8 and shards far smaller than the table."""
    monkeypatch.setattr(simhash, "WIDE_SHARD", 10)
    rows, sims = [], []
    for i in range(300):
        w = prose(9000 + i, 204, 100_000).split()
        v = list(w)
        for k in range(3 + i % 4):  # each edit changes 5 of 200 shingles: 0.86, 0.82, 0.78, 0.74
            v[10 + 30 * k] = "edit"
        a, b = (set(zip(*(x[j:] for j in range(5)), strict=False)) for x in (w, v))
        sims.append(len(a & b) / len(a | b))
        rows += [(2 * i, " ".join(w), "a"), (2 * i + 1, " ".join(v), "a")]
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert all(2 * i in kept for i in range(300))
    assert all(2 * i + 1 in kept for i in range(300) if sims[i] < 0.8)
    assert sum(2 * i + 1 in kept for i in range(300) if sims[i] >= 0.8) <= 3


def test_candidates_span():
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    points = np.concatenate([b ^ np.packbits(r.random((12, 512)) < 0.06, axis=1).view(np.uint64) for b in base])
    d = np.bitwise_count(points[:, None] ^ points[None]).sum(2)
    own = r.random(len(points)) < 0.7
    f = np.arange(len(points))
    want = {(i, j) for i, j in combinations(f.tolist(), 2) if d[i, j] <= 110 and (own[i] or own[j])}
    for every in (True, False):
        a, b = simhash.candidates(points, own, f, 110, every, cells=500)
        got = {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == want if every else got <= want and len(got) < len(points)
        for reach in (60, 80, 110):  # closest first: whatever is within a distance is joined by pairs within it
            within = lambda pairs, reach=reach: brute_groups(len(f), [p for p in pairs if d[p] <= reach])
            assert within(got) == within(want)


def brute_groups(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_nested_and_repeated_articles():
    para = "A sentence of plain text that is long enough to weigh something in the page. " * 3
    menu = "<nav><a href=/>Home</a></nav>"
    nested = html.main_text(f"<body>{menu}<article><h1>Title</h1><p>Lead of it</p><div itemprop=articleBody><p>{para}</p></div></article><footer>Foot</footer></body>")
    assert nested.split("\n")[:2] == ["Title", "Lead of it"] and "Foot" not in nested and "Home" not in nested
    assert html.main_text(f"<main><h1>Title</h1><article><p>{para}</p></article></main>").startswith("Title\n")
    parts = html.main_text(f"<div><section class='article-section'><p>One</p></section><section class='article-section'><p>{para}</p></section><section class='article-section'><p>Three</p></section></div>")
    assert parts.startswith("One\n") and parts.endswith("\nThree")
    links = "".join(f"<p><a href=/{i}>Link {i}</a></p>" for i in range(7))
    whole = html.main_text(f"<article><p>{para}</p>{links}<p>{para}</p></article><p><a href=/>Other</a></p>")
    assert [x for x in whole.split("\n") if x.startswith("Link")] == [f"Link {i}" for i in range(7)] and "Other" not in whole
    marked = html.main_text(f"<body class=article><div><p>Stray words here.</p></div><article><p>{para}</p></article></body>")
    assert "Stray" not in marked


def test_language_model_starts_from_all_training_texts(spark):
    """The groups of the start hold every token of every training text, however many texts there are."""
    texts = [f"the a{i % 7} of b{i % 11} the" if i % 3 else f"der a{i % 5} und c{i}" for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = hmm.Model(docs, passes=0)
    mass, _ = model._classes()
    groups = model._groups(model._sequences(docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)), mass)
    assert (groups.sum(0) == mass).all() and groups.sum() == model.n and 1 < len(groups) <= hmm.MARKERS + 1
