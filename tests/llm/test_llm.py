"""The training-data operators against brute force, on small documents with every odd case."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import ann, components, html_extract, mixing, near_dedup, packing, quality_classifier, quality_rules, runindex, suffix_dedup, textstats, token_counts, url_filters
from strandloom.llm.common import shared_dir
from strandloom.llm.shingles import shingle_set
from strandloom.llm.wordcode import WordEncoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, d long, body string, rep long, size long, anchor string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b + c for a in ("ka", "re", "Mi", "ño", "the") for b in ("", "lo", "ti", "én") for c in ("", "s", "ran", ".", ",")]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with nulls, empties, copies, near copies, shared passages, long and odd ones."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randrange(1, 160)) for _ in range(n)]
    passage = prose(rnd, 70)
    for k in range(0, n, 7):
        texts[k] += "\n" + passage + "\n" + prose(rnd, 20)
    for k in range(1, n, 9):
        words = texts[0].split(" ")
        words[rnd.randrange(len(words))] = "changed%d" % k
        texts[k] = " ".join(words)
    texts += [texts[5], texts[5], None, "", " \n\t", "x", "a" * 700, "ab " * 400, "line\nline\nline\n\n", prose(rnd, 9000), "é" * 300, "\x1c\x85  no break", "%%% &&& | word### <b>"]
    return texts


def frame(spark, texts, sources=None):
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 4 if sources is None else sources[k]}", 0, None, "x", 1, "b", 2, 3, "a") for k, t in enumerate(texts)]
    rows += [(None, "null id with a few words of text", None, None, None, None, None, None, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    df = frame(spark, corpus()).persist()
    return df, [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shared_dir(spark, tmp_path):
    assert shared_dir(spark) == shared_dir(spark)


def ids_of(text):
    from tokenizers import Tokenizer

    ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(tokenizer_path())
    return ids_of.t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer():
    small = WordEncoder(tokenizer_path(), memo=50)
    for text in [*corpus(), "don't I'LL <|endoftext|>x ISN'T it's İ ß ª ½ ²", "a" * 300 + "!?"]:
        assert small.encode((text or "").encode())[0].tolist() == ids_of(text)
        assert small.count((text or "").encode()) == len(ids_of(text))


def test_packing(docs):
    df, rows = docs
    for window in (64, 2048):
        got = packing.pack(df, window).collect()
        left = Counter((d, tuple(ids_of(t)) + (1,)) for d, t in rows)
        by_seq = {}
        for r in got:
            assert 0 < r.length <= window and r.offset + r.length <= window
            by_seq.setdefault(r.sequence_id, []).append(r)
        for s in by_seq.values():
            s.sort(key=lambda r: r.offset)
            assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(s, s[1:], strict=False))
        pieces = {}
        for r in got:
            pieces.setdefault(r.doc_id, []).append(r)
        for (d, ids), times in left.items():
            own = [r for r in pieces[d] if r.doc_tokens == len(ids)]
            assert sum(r.length for r in own) == times * len(ids)
            for r in own:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in got) == sum((len(i)) * n for (_, i), n in left.items())
        assert len(by_seq) * window < 1.2 * sum(r.length for r in got)  # each of the few tasks has a short last window


def test_cuts_are_optimal():
    rnd = random.Random(2)
    for _ in range(200):
        at = [0, *itertools.accumulate(rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 9)))]
        pen = [rnd.randrange(5) for _ in at]
        cost = lambda c: sum(pen[j] + 8 - (at[j] - at[i]) for i, j in zip(c, c[1:], strict=False))
        ways = [(0, *mid, len(at) - 1) for n in range(len(at)) for mid in itertools.combinations(range(1, len(at) - 1), n)]
        best = min(cost(c) for c in ways if all(at[j] - at[i] <= 8 for i, j in zip(c, c[1:], strict=False)))
        assert cost(packing.plan_cuts(at, pen, 8)) == best


def test_token_counts(docs):
    df, rows = docs
    sizes = [len(ids_of(t)) for _, t in rows]
    got = {r.length: r for r in token_counts.length_histogram(token_counts.encoded_lengths(df)).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(sizes)
    for k, r in got.items():
        assert (r.docs_up_to, r.tokens_up_to, r.docs_over) == (sum(s <= k for s in sizes), sum(s for s in sizes if s <= k), sum(s > k for s in sizes))
        assert r.truncated_tokens == sum(min(s, k) for s in sizes) and abs(r.share_up_to - r.docs_up_to / len(sizes)) < 1e-12


def base_of(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def labels_for(spark, n):
    return spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(n)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def labelled(spark, n=240):
    rnd = random.Random(8)
    good = lambda: prose(rnd, 60)
    bad = lambda: " ".join(rnd.choice(VOCABULARY) + rnd.choice(["###", "%%%", "&&&"]) for _ in range(60))
    return frame(spark, [good() if k % 3 else bad() for k in range(n)])


def test_quality_rules(spark, docs):
    train = labelled(spark)
    model = quality_rules.fit_rules(train, labels_for(spark, 240))
    df, rows = docs
    got = quality_rules.judge(df, model).collect()
    want = Counter((d, *base_of(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= quality_rules.THRESHOLD)
    out = {r.doc_id: r.kept for r in quality_rules.judge(train, model).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([out[k] == (k % 3 > 0) for k in held]) > 0.95


def test_repeated_words_names_windows_exactly():
    rnd = random.Random(3)
    for _ in range(300):
        words = [rnd.choice("ab" if rnd.random() < 0.5 else "abcdef") for _ in range(rnd.randrange(0, 40))]
        n = textstats.number_words([w.encode() for w in words])
        assert (textstats.repeated_words(n) if len(n) else 0) == base_of(" ".join(words))[4]


def test_quality_classifier(spark, docs):
    train = labelled(spark)
    model = quality_classifier.fit_classifier(train, labels_for(spark, 240))
    got = {r.doc_id: r for r in quality_classifier.classify(train, model).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k in range(240))
    assert np.mean([got[k].predicted == (k % 3 > 0) for k in held]) > 0.95
    df, rows = docs
    out = quality_classifier.classify(df, model).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(float)
    m = quality_classifier.fit(x, y, trees=5, depth=3)

    def walk(row):
        total = m.prior
        for t in range(5):
            k = 0
            while k < 7:
                k = 2 * k + 1 + (row[m.feature[t, k]] > m.threshold[t, k])
            total += m.value[t, k - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.score(x), [walk(r) for r in x]) and ((m.score(x) > 0.5) == y).mean() > 0.97


def test_html(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header><nav><a href="/a">Home</a></nav><div class="cookie-notice">We use cookies</div>'
        "<article><h1>Head  line</h1><p>First &amp; longer paragraph of the <b>main</b> text.<p>Second\n one, also of some length.</p><form><p>Mail me</p></form><p>End.</p></article>"
        '<aside><p>Other stories with quite long teaser texts in here</p></aside><div id="comments"><p>A reader comment of considerable length, too</p></div><footer>&copy;</footer><script>var x="<p>no</p>";</script></body></html>'
    )
    want = "Head line First & longer paragraph of the main text. Second one, also of some length. End."
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", page, "x"), (None, "w", "<p>a<p>b", None), (5, "y", page[:420], "x"), (6, "z", "<div>" * 3000 + "deep", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = [r.text for r in got]
    assert texts[:5] == [want, "", "", want, "a b"] and all(r.n_chars == len(r.text) for r in got)
    assert want.startswith(texts[5]) and texts[6] == "deep"


@pytest.mark.parametrize(
    "body",
    [
        "<div>{a}</div><div>{b}</div>",
        "<section>{a}</section><section>{b}</section>",
        "<p>{b}</p><section>{a}</section><p>{b}</p>",
        "<p>{b}</p><blockquote>{a}</blockquote><p>{b}</p>",
        "<div><p>{b}</p><table><tr><td>{a}</td></tr></table><p>{b}</p></div>",
        "<main><p>{b}</p><article>{a}</article><p>{b}</p></main>",
        "<main><p>A date</p><article>{a}{b}</article></main>",
        "<article>{a}</article><article>{b}</article>",
    ],
)
def test_html_keeps_text_in_several_parts(body):
    """No line that is marked as content falls outside the region."""
    rnd = random.Random(3)
    parts = {"a": "".join(f"<p>{prose(rnd, 60)}</p>" for _ in range(6)), "b": "".join(f"<p>{prose(rnd, 50)}</p>" for _ in range(1))}
    filled = body.format(**parts)
    page = '<html><body><nav><a href="/a">Home</a></nav>' + filled + '<div class="sidebar"><p>Other stories</p></div><footer>End</footer></body></html>'
    assert html_extract.main_text(page) == " ".join(re.sub("<[^>]*>", " ", filled).split())


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[7]
    rows = [(k, [float(c) for c in v], "z") for k, v in enumerate(x)]
    rows += [(2000, None, "z"), (2020, [0.0] * 16, "z"), (2040, [float("nan")] + [1.0] * 15, "z"), (2060, [float("inf")] + [1.0] * 15, "z"), (2080, [1.0, None] + [1.0] * 14, "z"), (2100, [], "z"), (2120, [1.0], "z"), (None, [1.0] * 16, "z"), rows[3]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 900, 20))
    hits = 0
    y = x.astype(np.float64)
    for q, rs in by.items():
        rs.sort(key=lambda r: r.rank)
        s = y @ y[q]
        best = [k for k in np.lexsort((np.arange(900), -s)) if k != q][:20]
        assert [r.rank for r in rs] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in rs) and q not in {r.vec_id for r in rs}
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(rs, rs[1:], strict=False))
        hits += len({r.vec_id for r in rs} & set(best))
    assert hits / 900 >= 0.95
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rep string")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_run_index_against_brute_force():
    rnd = random.Random(1)
    for t in range(60):
        segments = [bytes(rnd.choice(b"ab" if t % 2 else b"abcd") for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 5))]
        segments += [segments[0] * 3] if t % 3 == 0 else []
        index = runindex.RunIndex(np.frombuffer(b"".join(segments), np.uint8), np.cumsum([len(s) for s in segments]))
        suffixes = [s[i:] for s in segments for i in range(len(s))]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [max([common(a, b) for j, b in enumerate(suffixes) if j != i], default=0) for i, a in enumerate(suffixes)]
        assert index.matching_statistics().tolist() == want


def brute_cut(texts, window=200):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot,chunk", [(1024, 1 << 18), (3, 1500)])
def test_suffix_dedup(docs, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 20_000)
    df, rows = docs
    got = suffix_dedup.cut_repeats(df, "doc_id").collect()
    want = brute_cut([(t or "").encode() for _, t in rows])
    assert Counter(tuple(r) for r in got) == Counter((d, *w) for (d, _), w in zip(rows, want, strict=True))


def brute_components(rows, size):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    low = {d: d for d in sets if d is not None}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(low), 2):
            both = len(sets[a] & sets[b])
            if low[a] != low[b] and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {d: len(s) for d, s in sets.items()}, low


@pytest.mark.parametrize("small,size", [(32, 2), (1, 2), (32, 5)])
def test_near_dedup(spark, monkeypatch, small, size):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "ASKS", 3)
    rnd = random.Random(6)
    texts = corpus(2, 40)
    for k in range(30):  # a family of which some links are just below or above the limit
        w = texts[2].split(" ")[:60] or ["a"]
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(9)}"
        texts.append(" ".join(w))
    df = frame(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    n, low = brute_components(rows, size)
    for r in near_dedup.near_duplicates(df, size=size).collect():
        assert r.n_shingles == n[r.doc_id] and r.component_id == low.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == low[r.doc_id]), r


@pytest.mark.parametrize("linked", [False, True])
def test_near_dedup_compares_the_largest_id_of_a_bucket(spark, monkeypatch, linked):
    """Documents around one passage share buckets unlinked; only the largest id has a link, and no
    pivot shows it: the two hash above the others that share their buckets."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    monkeypatch.setattr(near_dedup, "ROUNDS", ((0, 40),))
    hashes = {r.id: r.h for r in spark.range(1000).select("id", F.xxhash64("id", F.lit(0)).alias("h")).collect()}
    high = sorted(sorted(hashes, key=hashes.get)[-2:])
    others = [k for k in range(high[1]) if k not in high][-60:]
    passage = [f"p{k}" for k in range(200)]
    text = lambda d, own: " ".join(passage + [f"o{d}x{k}" for k in range(own)])
    rows = [(d, text(d, 60)) for d in others] + [(d, text(d, 15)) for d in high]
    if linked:
        rows += [(2000 + k, " ".join(f"z{j}" for j in range(50 + k))) for k in range(2)]
    _, low = brute_components(rows, 2)
    assert low[high[1]] == high[0]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in found} == low


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    est, missed = [], 0
    for _ in range(200):
        u = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = u[:356], u[44:]  # 312 of 400 shared: 0.78
        ra, rb = near_dedup.sketch(a), near_dedup.sketch(b)
        est.append(near_dedup.jaccard_estimate(ra[None], rb[None], np.array([356]), np.array([356]))[0])
        missed += not (ra.reshape(-1, near_dedup.ROWS) == rb.reshape(-1, near_dedup.ROWS)).all(1).any()
        assert (near_dedup.sketch(u) == near_dedup.merge(ra, rb)).all()
    assert abs(np.mean(est) - 0.78) < 0.01 and np.std(est) < 0.035 and missed == 0


def test_screen_misses_less_than_the_bands():
    """Pairs at 0.8 of like size: the chance of an estimate that the screen drops."""
    count, same = near_dedup.REGISTERS, np.arange(near_dedup.REGISTERS + 1)
    a = np.zeros((count + 1, count), np.uint16)
    b = np.where(np.arange(count)[None] < same[:, None], 0, 1).astype(np.uint16)
    n = np.full(count + 1, 1000)
    dropped = near_dedup.jaccard_estimate(a, b, n, n) < near_dedup.SIMILARITY / 100 - near_dedup.MARGIN
    miss = sum(math.comb(count, int(k)) * 0.8 ** int(k) * 0.2 ** (count - int(k)) for k in same[dropped])
    assert miss < 1e-9 < 0.01 * (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS


def test_shingles_of_short_texts():
    assert len(shingle_set(b"", 2)) == 0 and len(shingle_set(b" \n", 2)) == 0 and len(shingle_set(b"one", 2)) == 1
    assert (shingle_set(b"A b", 2) == shingle_set(b"a  B", 2)).all() and (shingle_set(b"a b a b a b", 2).shape) == (2,)


def test_mixing(docs):
    df, rows = docs
    got = mixing.mix(df).collect()
    again = Counter(tuple(r) for r in mixing.mix(df.repartition(5)).collect())
    assert Counter(tuple(r) for r in got) == again
    by, source = {}, {}
    for r in df.collect():
        by[r.source] = by.get(r.source, 0) + len(WORD.findall(r.text or ""))
        source[r.doc_id] = r.source
    names = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(by.values())
    while True:
        rest = total - sum(3 * by[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in by if x not in capped) for s in by if s not in capped}
        over = {s for s in share if share[s] > 3 * by[s]}
        if not over:
            break
        capped |= over
    target = share | {s: 3.0 * by[s] for s in capped}
    taken, largest = Counter(), {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in by)


def test_url_filters(spark):
    html = lambda to: f'<html><head><LINK href="{to}" rel="canonical"></head>'
    refresh = '<meta content="0;url=http://b.example.org/y" http-equiv=refresh>'
    rows = [
        (1, "https://x.example.com/en/1", None), (2, "http://www.example.com/en/2#a", None), (3, "http://a.WWW.Example.com/en/?q", None), (4, "http://a.net/fr/1", None), (5, "http://a.net/de/1", None), (6, None, None), (7, "no scheme", ""),
        (8, "http://c.example.org/z", html("http://D.net/es/9#top")), (9, "http://e.example.org/w", refresh), (10, "http://b.example.org/y", html("http://c.example.org/z")), (11, "http://f.com/q", html("http://d.net/es/9")),
        (12, "http://g.org/alone", html("http://h.org/other")), (8, "http://c.example.org/z#part", None), (13, "http://exampleXcom/en/", None), (14, "http://net/es/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert len(got) == 14 and url_filters.judge(df).count() == 15
    want = {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("www.example.com/en/", "allow"), 4: ("net/fr/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "block"), 10: (None, "block"), 11: ("com/", "allow"), 12: (None, "allow"), 13: (None, "allow"), 14: ("net/es/", "block")}
    assert {k[0]: v for k, v in got.items()} == want
    assert {k[0]: k[1:] for k in got}[3] == ("a.www.example.com", "/en/") and {k[0]: k[1:] for k in got}[6] == ("", "")


def test_url_filters_resolve_targets(spark):
    base = "http://a.net/de/x/1?q=1"
    for_base = {"/fr/1": "http://a.net/fr/1", "//b.net/es/": "http://b.net/es/", "2": "http://a.net/de/x/2", "../2": "http://a.net/de/2", "../../../fr/./y/..": "http://a.net/fr/", "?p=2": "http://a.net/de/x/1?p=2", "/r?u=http://c.net/": "http://a.net/r?u=http://c.net/", "https://C.net/a/../b": "https://C.net/a/../b", "mailto:x": None}
    df = spark.createDataFrame([(k, base, v) for k, v in for_base.items()] + [("fr/1", "http://a.net", "http://a.net/fr/1"), ("/fr/1", "no scheme", None)], "t string, base string, want string")
    for r in df.withColumn("got", url_filters.resolved(F.col("t"), F.col("base"))).collect():
        assert r.got == r.want, r
    link = '<link rel="canonical" href="%s">'
    rows = [(1, "http://a.net/de/1", link % "/fr/1"), (2, "http://a.org/de/2", link % "//a.net/es/"), (3, "http://a.net/de/3", "<meta http-equiv=refresh content='0;url=../fr/3'>"), (4, "http://a.org/4", '<base href="http://b.net/fr/">' + link % "x"), (5, "http://a.net/de/5", link % "/de/6")]
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_components(spark):
    rnd = random.Random(7)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    low = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == low and len(got) == len(low)
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")) is None


def test_empty_tables(spark, empty):
    assert packing.pack(empty).count() == 0
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty)).count() == 0
    assert quality_rules.judge(empty, quality_rules.fit_rules(empty, labels_for(spark, 3))).count() == 0
    assert quality_classifier.classify(empty, quality_classifier.fit_classifier(empty, labels_for(spark, 3))).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.cut_repeats(empty, "doc_id").count() == 0
    assert mixing.mix(empty).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
