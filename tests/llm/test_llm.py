"""Each operator against a plain version on a small table with the odd cases, and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import decontaminate as op3
from stratalog.llm import html_extract as op5
from stratalog.llm import language_id as op10
from stratalog.llm import line_dedup as op8
from stratalog.llm import lm_score as op6
from stratalog.llm import mixing as op7
from stratalog.llm import ngram_join as op4
from stratalog.llm import quality_rules as op2
from stratalog.llm import suffix_dedup as op9
from stratalog.llm import url_filter as op1
from stratalog.llm.elias_fano import EliasFano, Trie
from stratalog.llm.run_index import RunIndex

SPACE = "[\x20\x09-\x0d]+"
A_Z = {c: c + 32 for c in range(65, 91)}


def split(text, low=False):
    text = text or ""
    return [w for w in re.split(SPACE, text.translate(A_Z) if low else text) if w]


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/x?a#b", "http://a.net", "http://a.net/", "x://example.com/de/1", "x://example.com/DE/1", "x://sub.example.com/de/", "x://notexample.com/de/", "x://a.org/fr/", "http://h?x://y/z", "a://b://c/d", "http://\n.net/p", "http://a.net/" + "p" * 50_000]
    rows = [(i, u, "clash") for i, u in enumerate([*urls, urls[3]])]
    got = {r.page_id: r for r in op1.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(A_Z)
        fits = [(r, v) for r, v in op1.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if got[i].p_block >= 0.5 else "allow"))
    assert op1.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_on_held_out_hosts(spark):
    hosts = {"best-casino": "block", "pills-cheap": "block", "poker-bonus": "block", "track-ads": "block", "river-journal": "allow", "history-museum": "allow", "weather-station": "allow", "science-library": "allow"}
    rows = [(h, f"https://www.{h}.example.com/en/1") for h in hosts]
    said = {r.id: r.verdict for r in op1.judge_urls(spark.createDataFrame(rows, "id string, url string"), rules=()).collect()}
    assert said == hosts


def plain_quality(text):
    ws = split(text)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, doc_rows, empty):
    got = collected(op2.judge_quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t, *_ in doc_rows:
        m = plain_quality(t)
        want.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want, key=repr)
    judged = op2.judge_quality(docs).where("base_failed and kept")
    assert judged.count() == 0
    assert op2.judge_quality(empty).count() == 0


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(A_Z))


@pytest.mark.parametrize("block_words", [200_000, 25])
def test_decontaminate(spark, docs, doc_rows, empty, block_words):
    texts = [t for _, t, *_ in doc_rows if t]
    items = [(1, " ".join(item_words(texts[0])[3:20])), (2, texts[1][10:200]), (3, "one two"), (4, None), (5, "!!"), (6, " ".join(item_words(texts[2])[:12])), (6, "b c d"), (10, texts[20])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = op3.decontaminate(docs, bench, block_words=block_words)
    want = []
    for i, t, *_ in doc_rows:
        ws, hit, ids = item_words(t), set(), set()
        for item, text in items:
            iw = item_words(text)
            size = min(10, len(iw))
            windows = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if iw else set()
            for k in range(len(ws) - size + 1):
                if tuple(ws[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    ids.add(str(item))
        want.append((i, len(ws), len(hit), sorted(ids)))
    assert collected(found, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    cleaned = op3.decontaminate(found.select("doc_id", "text"), bench.where("item_id in (1, 2, 10)"), block_words=block_words)
    assert cleaned.where("n_hit > 0").count() == 0
    assert op3.decontaminate(empty, bench).count() == 0
    assert op3.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def shingles(text):
    ws = split(text, low=True)
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: math.inf)
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(least[root(a)], i)
    return [(i, len(s), least[root(a)]) for a, (i, s) in enumerate(sets)]


def test_ngram_join(docs, doc_rows, empty):
    got = collected(op4.linked_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_components(doc_rows), key=repr)
    kept = op4.one_per_component(docs)
    alone = {(i, c) for i, _, c in plain_components(doc_rows) if i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in alone)
    assert op4.linked_components(empty).count() == 0


def test_light_sets_and_boundary(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(op4.linked_components(frame), "doc_id", "n_shingles", "component_id") == sorted(plain_components(rows), key=repr)
    assert op4.needed(8, 8) == 7 and op4.subset_sizes(3, 8) == [3] and op4.choose_boundary({}, 0.0) == 0


def test_near_copies_are_verified_on_whole_texts(spark):
    import random

    rng = random.Random(1)
    base = [str(rng.randrange(10**6)) for _ in range(300)]
    rows = []
    for i in range(40):
        near = list(base)
        for _ in range(rng.randrange(14)):
            near[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((i, " ".join(near)))
    rows += [rows[7]] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(op4.linked_components(frame), "doc_id", "n_shingles", "component_id") == sorted(plain_components(rows), key=repr)
    texts = [b"a b c d e f", b"A b c d e g", b"", b"one", b"one", b"one"]
    sizes, both = op4._shared(texts)
    assert sizes.tolist() == [[2, 2], [0, 1], [1, 1]] and both.tolist() == [1, 0, 1]


def test_near_copies_without_id_are_linked(spark):
    import random

    rng = random.Random(2)
    texts = [[str(rng.randrange(10**6)) for _ in range(120)] for _ in range(6)]
    near = lambda ws, k: " ".join([*ws[:k], f"x{k}", *ws[k + 1 :]])
    rows = [(10 + i, " ".join(ws)) for i, ws in enumerate(texts[:4])] + [(None, near(ws, 30)) for ws in texts]
    # The document without id joins two that are not linked with one another.
    far = texts[0][:105] + [f"z{k}" for k in range(15)]
    rows += [(None, " ".join(texts[0][:112] + far[112:])), (5, " ".join(far)), (None, near(texts[5], 60))]
    root = plain_components([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for (i, _), (_, _, c) in zip(rows, root, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = [(i, n, least[c]) for (i, _), (_, n, c) in zip(rows, root, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(op4.linked_components(frame), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert op4.one_per_component(frame).count() == len({c for _, _, c in root})


PAGE = """<!doctype html><html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li><a href=a>One, two, three, four.</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do. Accept them, please, now.</div><main><article><h1>Head &amp; tail</h1><p>First <b>bold
text</b>, with&nbsp;commas, and more of it. It goes on.<p>Second<br>paragraph, unclosed. &#233;</article></main><!-- no > here --><aside>Aside, text.</aside>
<form><p>Name, please, here.</p></form><section id=comments><p>I disagree, strongly, with this.</p></section><footer>(c) all, rights.</footer></body></html>"""


def test_html_extract(spark):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, ""), (3, "u", "", ""), (4, "u", "no markup, just text.", ""), (5, "u", "<p>unclosed <a href='x", ""), (6, "u", "<" * 2000 + "a>", ""), (7, "u", "<div>" * 300 + "deep, text." + "</div>" * 300, ""), (8, "u", "<!-- never closed <p>x</p>", ""), (1, "u", PAGE, "clash")]
    got = op5.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts[1] == "Head & tail\n\nFirst bold text, with commas, and more of it. It goes on.\n\nSecond paragraph, unclosed. é"
    assert texts[2] == texts[3] == texts[8] == "" and texts[4] == "no markup, just text." and texts[7] == "deep, text."
    assert got.count() == len(rows) and got.where(F.length("text") != F.col("n_chars")).count() == 0
    assert op5.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("label", ['class="content with-sidebar"', 'class="no-ads"', 'class="has-comments"', 'id="social-science"', 'class="header"'])
def test_html_wrappers_with_label_words(label):
    body = PAGE[PAGE.index("<nav>") : PAGE.index("</body>")]
    assert op5.main_text(f"<html><body><div {label}>{body}</div></body></html>") == op5.main_text(PAGE)
    lists = '<div class="related-posts"><p>Another one, somewhere else.</p></div>'
    assert op5.main_text(f"<html><body><div {label}>{body}{lists}</div></body></html>") == op5.main_text(PAGE)


def test_lm_score(docs, doc_rows, empty):
    tokens = [[*split(t, low=True), None] for _, t, *_ in doc_rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in doc_rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, *_), ws, h in zip(doc_rows, tokens, held))
    for most_words in (1 << 18, 40):
        got = sorted(tuple(r) for r in op6.score(docs, most_words=most_words).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want])
        assert all(g[6] < 0 for g in got)
    assert op6.score(empty).count() == 0


def test_lm_score_of_rare_words(docs, doc_rows):
    tokens = [[*split(t, low=True), None] for _, t, *_ in doc_rows]
    train = [ws for (i, *_), ws in zip(doc_rows, tokens) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for ws in train for w in ws)
    two = Counter(p for ws in train for p in zip(["", *ws], ws))
    before = c | {"": len(train)}
    n, v = sum(c.values()), len(c)
    p = lambda u, w: (two[u, w] + 300 * (c[w] + 0.1) / (n + 0.1 * (v + 1))) / (before.get(u, 0) + 300)
    want = sorted((i, len(ws), sum(math.log10(p(u, w)) for u, w in zip(["", *ws], ws))) for (i, *_), ws in zip(doc_rows, tokens))
    for most_words in (1 << 18, 40, 0):
        got = sorted((r.doc_id, r.n_tokens, r.score) for r in op6.score(docs, most_words=most_words).collect())
        assert all(abs(g[2] - w[2]) <= 0.03 * w[1] for g, w in zip(got, want, strict=True))


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (300, 10), (2000, 10**7)):
        values = np.sort(rng.integers(0, top + 1, n))
        head, body = EliasFano.pack(values)
        held, _ = EliasFano.read(np.frombuffer(head.tobytes() + body, np.uint8), 0)
        asked = rng.integers(0, top + 3, 500)
        assert (held.access(np.arange(n)) == values).all() and (held.successor(asked) == np.searchsorted(values, asked)).all()
    keys = np.unique(rng.integers(0, 1 << 26, 4000))
    u, w, p = keys >> 20, keys & 0xFFFFF, -6 * rng.random(len(keys))
    found, values = Trie(np.frombuffer(Trie.pack(u, w, p), np.uint8)).find(u, w)
    assert found.all() and np.abs(values - p).max() < 0.013


def test_elias_fano_halves_within_a_dense_run(monkeypatch):
    """A long run of near values beside far ones shares one high part: few rounds, and the same places."""
    values = np.concatenate((np.arange(0, 60_000, 2), 10**12 + np.arange(40)))
    head, body = EliasFano.pack(values)
    held, _ = EliasFano.read(np.frombuffer(head.tobytes() + body, np.uint8), 0)
    asked, rounds, lows = np.concatenate((np.arange(0, 60_010, 7), 10**12 + np.arange(-3, 45))), [], EliasFano._lows
    monkeypatch.setattr(EliasFano, "_lows", lambda self, i: rounds.append(len(i)) or lows(self, i))
    assert (held.successor(asked) == np.searchsorted(values, asked)).all() and len(rounds) <= 20


def test_lm_orders_and_numbers(monkeypatch):
    rng = np.random.default_rng(2)
    hashes = np.unique(op6.mix(rng.integers(0, 1 << 62, 500).astype(np.uint64)))
    classes = op6.Classes(hashes, np.ones(len(hashes)), 1, 1000, 500, 16)
    tokens = np.concatenate((hashes, hashes + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)))
    numbers = {h: i + 2 for i, h in enumerate(hashes.tolist())}
    ids = classes.of(tokens)
    assert ids.tolist() == [numbers.get(t, t | 1 << 63) for t in tokens.tolist()]
    w, u = rng.choice(ids, 4000), rng.choice(ids, 4000)
    for bits in (24, 4):
        monkeypatch.setattr(op6, "_PLACE", bits)
        order, new = op6._sorted(w, u)
        want = np.lexsort((u, w, (w | u) >= 1 << 63))
        assert (order == want).all() and new.sum() == len(set(zip(w.tolist(), u.tolist())))


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, live = {}, sum(sizes.values()), set(sizes)
    while live:
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in live}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        live -= over
    return target


def test_mixing(docs, doc_rows, empty):
    digest, mixed = op7.mix(docs, block_words=16)
    got = digest.collect()
    sizes = Counter()
    for _, t, _, s, *_ in doc_rows:
        sizes[s] += len(split(t))
    want = plain_targets(dict(sizes))
    source = {i: s for i, _, _, s, *_ in doc_rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(split(t))) for i, t, *_ in doc_rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * 16 + 0.01 * want[s] for s in sizes)
    assert sorted(map(tuple, op7.mix(docs.repartition(7), block_words=16)[0].collect())) == sorted(map(tuple, got))
    assert mixed.agg(F.sum("n_words")).first()[0] == sum(taken.values())
    assert op7.mix(empty)[0].count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("long").alias("n"), F.lit(5).cast("long").alias("k"))
        assert sorted(r.x for r in op7.permuted(rows, "x", "n", "k", 3).collect()) == list(range(n))


def test_shards_draw_their_sources(spark):
    """Counts by shard are draws; all shards are full, and what is over or lacking is passed on."""
    sources = spark.createDataFrame([(1, 700, 200, 0), (2, 2300, 900, 700), (3, 0, 5, 3000)], "no long, n_slots long, n_blocks long, first_slot long")
    drawn = {(r.shard, r.no): r.drawn for r in op7.draw_counts(sources, 3000, shard_slots=500).collect()}
    by_shard = [sum(n for (s, _), n in drawn.items() if s == k) for k in range(6)]
    assert by_shard == [500] * 6 and len({n for (_, no), n in drawn.items() if no == 1}) > 1 and not any(no == 3 for _, no in drawn)
    assert all(abs(n - 500 * 700 / 3000) < 5 * (500 * 0.23 * 0.77) ** 0.5 for (_, no), n in drawn.items() if no == 1)
    rows = op7.slots(sources, shard_slots=500).collect()
    assert sorted((r.no, r.slot) for r in rows) == [(1, k) for k in range(700)] + [(2, k) for k in range(2300)]
    assert Counter(r.shard for r in rows) == dict.fromkeys(range(6), 500)
    passes = defaultdict(list)
    for r in rows:
        passes[r.no, r.slot // {1: 200, 2: 900}[r.no]].append(r.block)
    assert all(len(set(b)) == len(b) for b in passes.values())


def test_running_sum(spark):
    rows = [(k % 7, k, k * k) for k in range(500)] + [(None, 1, 5)]
    got = op7.running_sum(spark.createDataFrame(rows, "a int, b int, v long").repartition(5), [F.col("a").asc_nulls_last(), F.col("b")], "v", "upto").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.a is None, r.a, r.b)):
        assert r.upto == total
        total += r.v


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(A_Z)
    holders = defaultdict(list)
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast_keys", [1_000_000, -1])
def test_line_dedup(docs, doc_rows, empty, broadcast_keys):
    got = op8.dedup_lines(docs, broadcast_keys=broadcast_keys)
    assert collected(got, "doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))) == sorted(plain_lines(doc_rows), key=repr)
    assert op8.dedup_lines(empty, broadcast_keys=broadcast_keys).count() == 0


def test_line_runs(spark, docs):
    runs = op8.LineRuns(spark, fanout=2)
    keys = op8.line_keys(docs, batches=5).cache()
    for b in range(5):
        runs.add(keys.where(F.col("batch") == b).drop("batch"))
    whole = {(r.h1, r.h2): r.n_docs for r in op8._merged(keys).collect()}
    held = [(r.h1, r.h2) for run in runs._runs() for r in run.collect()]
    assert sorted(held) == sorted(whole) and len(runs.levels) > 2  # each key in one run
    assert runs.unseen(op8._merged(keys)).count() == 0
    for least in (1, 2, 5):
        assert {(r.h1, r.h2) for r in runs.frequent(least).collect()} == {k for k, n in whole.items() if n >= least}
    runs.drop()


def plain_substrings(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 112), (40, 12)])
def test_suffix_dedup(docs, doc_rows, empty, length, gram):
    small = [r for r in doc_rows if len(r[1] or "") < 20_000]
    got = op9.dedup_substrings(docs.where("n_chars < 20000"), length=length, gram=gram)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(plain_substrings(small, length), key=repr)
    assert op9.dedup_substrings(empty).count() == 0


def test_one_long_run(spark):
    frame = spark.createDataFrame([(1, "x" * 5000), (2, "y" * 250)], "doc_id long, text string")
    assert collected(op9.dedup_substrings(frame), "doc_id", "n_removed", "n_spans") == [(1, 5000, 1), (2, 250, 1)]


def test_run_index():
    rng = np.random.default_rng(2)
    text = np.concatenate((rng.integers(0, 3, 300), [1000]))
    n = len(text)
    common = lambda a, b: next((k for k in range(n) if max(a, b) + k >= n or text[a + k] != text[b + k]), 0)
    want = [max(common(i, j) for j in range(n) if j != i) for i in range(n)]
    index = RunIndex(text)
    assert index.statistics().tolist() == want and index.lengths.sum() == n


def test_language_id(docs, doc_rows, empty):
    got = {r.doc_id: r for r in op10.train_and_identify(docs).collect()}
    right = [got[i].lang_pred == lang for i, t, lang, *_ in doc_rows if lang and zlib.crc32(str(i).encode()) % 3 == 1 and len(split(t)) > 8]
    assert np.mean(right) > 0.9
    for i, t, *_ in doc_rows:
        if not re.search(r"[^\W\d_]", t or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
        assert 0 <= got[i].score <= 1
    assert op10.train_and_identify(docs).count() == len(doc_rows)
    assert op10.train_and_identify(empty).count() == 0
    assert {r.lang_pred for r in op10.identify(docs, None).collect()} == {"und"}


def test_every_text_with_letters_has_a_language(spark, docs):
    rows = [(1, "ab"), (2, "é"), (3, "zq"), (4, "12 3"), (5, None), (6, ""), (7, "字")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    filters = op10.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op10.identify(frame, filters).collect()}
    assert all((lang in filters.languages) == (i not in (4, 5, 6)) and 0 <= x <= 1 for i, (lang, x) in got.items())
    many = docs.where("lang is not null").withColumn("lang", F.concat("lang", F.lit("-"), F.pmod("doc_id", F.lit(40))))
    filters = op10.learn(many)
    said = op10.identify(many, filters).where("length(text) > 200").collect()
    assert len(filters.languages) > 32 and filters.masks.shape[1] == -(-len(filters.languages) // 64) and np.mean([r.lang == r.lang_pred for r in said]) > 0.8


def test_more_languages_than_bits_of_a_word(spark):
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 30, f"l{k:03}") for k in range(130)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    filters = op10.learn(frame)
    assert filters.masks.shape[1] == 3 and all(r.lang == r.lang_pred for r in op10.identify(frame, filters).collect())


def test_columns_of_any_name_pass_through(spark, docs):
    names = ["_text", "_mask", "_key", "_found", "_drop", "_d", "_r", "_th", "_html", "_grams", "_hashed", "_p", "a.b", "_counts", "_N_Words"]
    frame = docs.select("doc_id", "text", "lang", "source", *[F.lit(k).alias(n) for k, n in enumerate(names)]).limit(12)
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    bench = spark.createDataFrame([(1, "one two"), (2, " ".join("abcdefghijkl"))], "item_id long, text string")
    pages = frame.withColumns({"url": F.lit("http://a.net/x"), "html": F.col("text")})
    results = [op2.judge_quality(frame), op3.decontaminate(frame, bench), op3.decontaminate(frame, bench, block_words=3), op8.dedup_lines(frame), op8.dedup_lines(frame, broadcast_keys=-1), op10.identify(frame, op10.learn(frame)), op4.one_per_component(frame), op1.judge_urls(pages), op5.extract(pages.drop("text"))]
    for got in results:
        row = got.first()
        assert [row[n] for n in names] == list(range(len(names)))


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert op5.main_text("<div>" * 60_000 + "deep, text.").endswith("deep, text.")
    assert op5.main_text("<div>x, y " * 30_000).count("x, y") == 30_000
    assert time.perf_counter() - began < 20


def test_path_ratios_alone_find_the_article():
    body = "".join(f"<p>{'A sentence of some length, with commas. ' * 5}</p>" for _ in range(6))
    page = f"<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class='x1'>Buy it, now.</div><main><h1>Heading</h1>{body}<figure><figcaption>The caption.</figcaption></figure></main><div>Fine print.</div></body></html>"
    for prior in (1.0, op5.PRIOR):
        text = op5.main_text(page, prior=prior)
        assert text.startswith("Heading\n\nA sentence") and text.endswith("The caption.") and text.count("\n\n") == 7


def test_entries_within_reach():
    """No entry is dropped that may link with another of its key."""
    from stratalog.llm.ngram_join import _in_reach, needed

    rng = np.random.default_rng(5)
    h, n = rng.integers(0, 300, 900), rng.integers(1, 60, 900)
    pos = np.where(h % 7 == 0, -rng.integers(1, 9, 900), rng.integers(0, 60, 900) % n)
    by = np.lexsort((n, h))
    h, n, pos = h[by], n[by], pos[by]
    kept = _in_reach(h, n, pos)

    def may_link(i: int, j: int) -> bool:
        overlap = needed(int(n[i]), int(n[j]))
        if pos[i] < 0:
            return overlap == -pos[i]
        return max(pos[i] - n[i], pos[j] - n[j]) <= -overlap and min(pos[i], pos[j]) + min(n[i] - pos[i], n[j] - pos[j]) >= overlap

    for i in range(len(h)):
        partners = [j for j in range(len(h)) if j != i and h[j] == h[i] and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and may_link(i, j)]
        assert kept[i] or not partners
    assert 0 < kept.sum() < len(h)
    assert len(_in_reach(h[:1], n[:1], pos[:1])) == 1
