"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import jaccard, langid, linededup, media, mixing, packing, pii, quality, queries, substring
from nearfield.llm.common import spill, table
from nearfield.llm.components import components
from nearfield.llm.permute import permuted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    shared = prose(60)
    long = "\n".join(prose(50) for _ in range(400))
    rows = [(1, prose(80), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, long, "en", "b"), (5, long, "fr", "b"), (None, prose(90), "en", "c"), (None, None, None, None)]
    rows += [(10 + i, prose(40) + " " + shared + "\n" + prose(30), "en", "a") for i in range(6)]
    rows += [(20, "same text here", "en", "a")] * 3 + [(21, "!!! 123", "en", "z"), (22, "x", "de", "z"), (23, "   \n\n ", "de", "z"), (24, "one two three four", "en", "z"), (25, "one two three four", "fr", None)]
    near = prose(300)
    rows += [(30 + i, near + f" end{i}", "en", "b") for i in range(4)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def words_of(text):
    return (text or "").encode().split()


# media


def check_media(df, rows):
    got = media.payload_rows(df).collect()
    want = collections.Counter()
    for r in rows:
        data = (r[1] or "").encode()
        pad = data + b" " * (192 - len(data) % 192 if len(data) % 192 or not data else 0)
        text = " ".join((r[1] or "").split())
        want[r[0], len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]), f"{len(data)} bytes", len(text.replace(" ", ""))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.caption, r.text_chars) for r in got) == want
    assert all(r.media_bytes > r.payload_bytes and r.position in (0, 1) and 1 <= r.n_items <= 3 for r in got)


def test_media_round_trip(spark, odd, none):
    check_media(odd.select("doc_id", "text"), odd_rows())
    assert media.read_back(media.store(none)).count() == 0 == media.payload_rows(none).count()
    assert media.store(odd.withColumn("digest", F.lit("mine"))).filter("digest = 'mine'").count() == 0
    long = " ".join(f"<b>w{i} & co" for i in range(60_000))
    rows = [(1, long), (1, long), (2, None)]
    check_media(spark.createDataFrame(rows, "doc_id long, text string").withColumn("page", F.lit(1)).withColumn("item_text", F.lit(1)), rows)


def test_sequence_holds_the_whole_text(odd):
    got = media.parse(media.illustrated(odd.select("doc_id", "text")), "page").collect()
    want = collections.Counter((r[0], re.sub(r"\s+", " ", r[1] or "").strip()) for r in odd_rows())
    assert collections.Counter((r.doc_id, " ".join(x.text for x in r["items"] if x.kind == "text")) for r in got) == want


def test_interleaved_pages(spark, sf):
    html = '<head><title>t</title></head><p>Hello <b>big</b> world<figure><img src="media:ab12" alt="a"><figcaption>A cat</figcaption></figure>tail<script>no</script><img src=x.png alt="y">'
    got = media.sequence(html)
    assert [(x["position"], x["kind"], x["text"], x["reference"], x["caption"]) for x in got] == [(0, "text", "Hello big world", None, None), (1, "image", None, "media:ab12", "A cat"), (2, "text", "tail", None, None), (3, "image", None, "x.png", "y")]
    assert media.sequence(None) == media.sequence("") == []
    assert media.sequence("<p>open <figcaption>never closed")[-1]["text"].endswith("never closed")
    parsed = media.parse(table(spark, sf, "pages"))
    assert parsed.filter("size(items) = 0").count() == 0
    store = spark.createDataFrame([("ab12", 5)], "digest string, size int")
    page = media.parse(spark.createDataFrame([(1, html, 7)], "page_id long, html string, size int"))
    back = media.assemble(media.resolve(media.items(page), store), ["page_id"]).first()["items"]
    assert [(x.item_position, x.item_caption, x["size"]) for x in back] == [(0, None, None), (1, "A cat", 5), (2, None, None), (3, "y", None)]


# line dedup


def test_recurring_lines_stay_in_one_document(spark, odd, none):
    lines = ["All rights reserved by us here", "Page 1 of 9"]
    rows = [(i, f"unique words number{chr(97 + i)} alone here now\n{lines[0]}\nPage {i} of 90\n\n", "en", "s", 1) for i in range(6)]
    given = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(0)).withColumn("gone", F.lit(0)).withColumn("size", F.lit(0))
    assert not any(lines[0] in r.text or "Page" in r.text for r in linededup.drop_lines(given).collect())
    got = {r.doc_id: r for r in linededup.drop_lines(given, linededup.Settings(keep_first=True)).collect()}
    assert sum(lines[0] in r.text for r in got.values()) == 1
    assert sum("Page" in r.text for r in got.values()) == 1
    assert all(f"number{chr(97 + i)}" in r.text and r.n_lines == 5 for i, r in got.items())
    assert linededup.drop_lines(none).count() == 0
    assert linededup.drop_lines(odd).count() == odd.count()
    assert linededup.drop_lines(odd).filter("doc_id = 2 and text is null").count() == 1


def test_templates_generalise_variable_fields(spark):
    names = "ann bob cat dan eve fay gus hal".split()
    rows = [(i, f"the user called by name {n} logged in from the office today\nown line {n} {n * 3}", "en", "s", 1) for i, n in enumerate(names)]
    got = linededup.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any("logged in" in r.text for r in got)
    assert all("own line" in r.text for r in got)


def brute_lines(rows, s):
    """The tree by dictionaries."""
    texts = {r[1] for r in rows if r[1] is not None}
    lines = {t: [re.split(r"\s+", re.sub("[0-9]+", "0", x).strip(" \t\r\x0b\x0c")) if re.search(r"[^ \t\n\x0b\x0c\r]", x) else None for x in t.split("\n")] for t in texts}
    docs = collections.defaultdict(set)
    for t, each in lines.items():
        for w in each:
            if w is not None:
                docs[tuple(w)].add(t)
    leaves = collections.defaultdict(list)
    for f in docs:
        leaves[len(f), f[: s.depth]].append(f)
    name = {f: ("own", f) for f in docs}
    for leaf, forms in leaves.items():
        if leaf[0] > s.depth and len(forms) > 1 and sum(len(docs[f]) for f in forms) >= s.min_docs:
            total, mask = sum(len(docs[f]) for f in forms), []
            for at in range(leaf[0]):
                votes = collections.Counter()
                for f in forms:
                    votes[f[at]] += len(docs[f])
                token, n = max(votes.items(), key=lambda v: (v[1], v[0].encode()))
                mask.append(token if 2 * n >= total else None)
            for f in forms:
                if sum(a == b for a, b in zip(f, mask, strict=True)) >= s.similarity * leaf[0]:
                    name[f] = ("leaf", leaf)
    where = collections.defaultdict(set)
    for f, n in name.items():
        where[n] |= docs[f]
    gone = {f for f, n in name.items() if len(where[n]) >= s.min_docs}
    out = collections.Counter()
    for r in rows:
        if r[1] is None:
            out[r[0], None, 0, 0] += 1
        else:
            stay = [x for x, w in zip(r[1].split("\n"), lines[r[1]], strict=True) if w is None or tuple(w) not in gone]
            n = len(lines[r[1]])
            out[r[0], "\n".join(stay), n, n - len(stay)] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_line_dedup_equals_brute_force(request, which):
    df = request.getfixturevalue(which).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = linededup.drop_lines(df).collect()
    assert collections.Counter(map(tuple, got)) == brute_lines(rows, linededup.Settings())


# similarity join


def brute_jaccard(rows):
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    up, links = list(range(n)), [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    out = []
    for i in range(n):
        group = [rows[j][0] for j in range(n) if root(j) == root(i)]
        out.append((rows[i][0], min((x for x in group if x is not None), default=None), links[i], len(group)))
    return collections.Counter(out)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_jaccard_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = jaccard.join(df.withColumn("node", F.lit(1)))
    assert collections.Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got.collect()) == brute_jaccard(rows)


def test_jaccard_in_chunks(spark):
    rng = np.random.default_rng(5)
    words = rng.integers(0, 10_000, 200).astype(str)
    rows = []
    for i in range(150):
        w = words.copy()
        w[rng.integers(0, 200, i % 5)] = "x"
        rows.append((i, " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.join(df, jaccard.Settings(chunk=16, bucket=24, dealt=60))
    assert collections.Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got.collect()) == brute_jaccard(rows)
    assert jaccard.join(df.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach(spark):
    s = jaccard.Settings()
    least = jaccard.needed(s)
    assert all(least[n] < 0.8 * n for n in least) and least[96] > 40


def test_representatives(odd):
    got = jaccard.representatives(odd.withColumn("th", F.lit(1))).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(20) == 1 and 4 in ids and 5 not in ids and 30 in ids and 31 not in ids and 24 in ids and 25 not in ids
    assert {1, 2, 3, 10, 15, 21, 22, 23} <= set(ids) and ids.count(None) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (203, 202), (201, 203)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {i: 200 for i in range(200, 204)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# packing


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing_holds_every_token_once(request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.packed(df).collect()
    want = collections.Counter()
    for r in df.collect():
        want[r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 1])] += 1
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id, r.doc_tokens].append(r)
    for (doc, n), pieces in by.items():
        texts = [ids for (d, ids), c in want.items() for _ in range(c) if d == doc and len(ids) == n]
        assert sum(p.length for p in pieces) == n * len(texts)
        for p in pieces:
            assert any(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in texts)
    assert sum(len(ids) * c for (_, ids), c in want.items()) == sum(r.length for r in got)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert queries.packed(df.limit(0)).count() == 0


def test_windows_hold_target_shares():
    for totals, weights in (([9000, 3000, 500], None), ([9000, 3000, 500], [1, 1, 1]), ([9000, 3000, 500], [5, 1, 0])):
        plan = packing.Plan(totals, weights, 256)
        pieces = [(q, *p) for q, n in enumerate(totals) for p in plan.pieces(q, 0, n)]
        assert sum(p[2] for p in pieces) == sum(totals)
        filled = collections.defaultdict(list)
        for q, _, n, w, o in pieces:
            filled[w].append((o, n, q))
        for w, parts in filled.items():
            at = 0
            for o, n, _ in sorted(parts):
                assert o == at
                at += n
            if weights is None and at == 256:
                assert all(abs(sum(n for _, n, q in parts if q == k) - 256 * t / sum(totals)) <= 2 for k, t in enumerate(totals))
        one = plan.pieces(0, 100, 777)
        assert sum(p[1] for p in one) == 777 and one[0][0] == 0


@pytest.mark.parametrize(("totals", "weights"), [([40, 13, 5, 0], None), ([40, 13, 5, 9], [5, 1, 0, 0]), ([30, 30, 30], [1.5, 0.25, 7]), ([1], [0]), ([3, 3, 3], [1, 1, 1])])
def test_stream_is_in_order_of_due_times(totals, weights):
    from fractions import Fraction

    w = [Fraction(x) for x in (weights or totals)]
    due = sorted((x <= 0, Fraction(2 * c + 1, 1) / (x if x > 0 else n), i, c) for i, (n, x) in enumerate(zip(totals, w, strict=True)) for c in range(n))
    plan = packing.Plan(totals, weights, 8)
    for x in range(len(due) + 1):
        assert plan.given(x) == [sum(i == q for _, _, i, _ in due[:x]) for q in range(len(totals))]


def test_weights_hold_with_many_sources(spark):
    import public_tokenizers

    rows = [(i, " ".join(["word"] * 400), "en", f"s{i % 40}", 1) for i in range(400)]
    weights = {f"s{i}": 200 if i == 0 else 10 for i in range(40)}
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), 49_408, 2048, 1, weights=weights).collect()
    for w in range(4):
        n = collections.Counter()
        for r in got:
            if r.sequence_id == w:
                n[r.source] += r.length
        assert sum(n.values()) == 2048
        # equal sources are due at once, in bursts of 39 tokens for 20 of s0
        assert abs(n["s0"] - 2048 * 200 / 590) <= 20 * 39 / 59 and all(abs(n[f"s{i}"] - 2048 * 10 / 590) <= 2 for i in range(1, 40))


def test_encoder_equals_tokenizer():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    for t in ["İstanbul ΣΑΣ don't WE'LL it's ''s ,'s", "<|endoftext|> x<|y é a\tb\x1cc ½ x² ǅ ß ÀÉ×÷ 12,5", "é   zwölf\n\n ñ", "", "日本語 text 🙂!!"]:
        assert np.frombuffer(e.encode([t], 1)[0], "<u2").tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "BATCH", 40)
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    texts = ["one two three four five six seven\neight nine ten " * 5, "x" * 100 + " y", "z" * 90, "", None, " \n "]
    for t, ids in zip(texts, e.encode(texts, 1), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]

def test_encoder_needs_little_memory():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    texts = [f"some words of text {i % 50} and more of them " * 40 for i in range(2000)]
    e.encode(texts[:50], 1)
    tracemalloc.start()
    e.encode(texts, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3_000_000 and peak < 60e6


# substring dedup


def brute_substring(rows, window=35):
    w = [words_of(r[1]) for r in rows]
    n = collections.Counter(tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1))
    out = collections.Counter()
    for r, x in zip(rows, w, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if n[tuple(x[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out[r[0], len(x), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("which", "hot", "share"), [("odd", 512, 1000), ("odd", 2, 1000), ("odd", 2, 1), ("docs", 512, 1000), ("docs", 3, 1000), ("docs", 3, 50)])
def test_substring_equals_brute_force(request, which, hot, share):
    df = request.getfixturevalue(which)
    got = substring.remove(df.withColumn("c", F.lit(1)), substring.Settings(hot=hot, share=share, block=5 if hot == 2 else 12_000)).collect()
    assert collections.Counter(map(tuple, got)) == brute_substring([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("hot", [512, 2])
def test_factors_have_sources(odd, hot):
    _, _, found = substring.spans(odd, substring.Settings(hot=hot))
    rows = {r.c: r for r in found.collect()}
    w = {c: words_of(r.text) for c, r in rows.items()}
    assert any(r.spans for r in rows.values())
    for c, r in rows.items():
        for x in r.spans:
            assert x.words >= 35 and (x.source, x.source_first) != (c, x.first)
            assert w[c][x.first : x.first + x.words] == w[x.source][x.source_first : x.source_first + x.words]


def test_longest_factors_equal_brute_force():
    rng = np.random.default_rng(4)
    window, size = 4, [9, 9, 12, 7]
    ids = rng.integers(0, 2, sum(size))
    stop = np.cumsum(size)
    starts = np.concatenate([np.arange(e - n, e - window + 1) for e, n in zip(stop, size, strict=True)])
    stops = np.concatenate([np.full(n - window + 1, e) for e, n in zip(stop, size, strict=True)])
    length, source = substring.longest(ids, stops, starts, window)
    for i, (a, e) in enumerate(zip(starts, stops, strict=True)):
        best = 0
        for j, (b, f) in enumerate(zip(starts, stops, strict=True)):
            n = 0
            while i != j and a + n < e and b + n < f and ids[a + n] == ids[b + n]:
                n += 1
            best = max(best, n)
        assert length[i] == best if best >= window else length[i] < window
        if best >= window:
            assert source[i] != i and (ids[a : a + best] == ids[starts[source[i]] : starts[source[i]] + best]).all()
    windows = np.array(size) - window + 1
    found, sizes = substring.factors(length, windows, window)
    covered = {x for i, n in zip(found, sizes, strict=True) for x in range(starts[i], starts[i] + n)}
    assert covered == {x for i in np.flatnonzero(length >= window) for x in range(starts[i], starts[i] + window)}


def test_substring_within_a_document(spark, none):
    a = " ".join(f"p{i}" for i in range(36))
    rows = [(1, f"{a} mid {a}"), (2, " ".join(["z"] * 60)), (3, "short"), (4, "q " * 34)]
    got = substring.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, got)) == brute_substring(rows)
    assert substring.remove(none).count() == 0


def test_places_of_a_hot_window_lie_in_bounded_parts(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(substring, "spill", lambda df, name: kept.setdefault(name, spill(df, name)))
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"x{i} {common} y{i}") for i in range(600)] + [(1000 + i, f"z{i} " + " ".join(f"r{i % 40}w{j}" for j in range(36))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove(df, substring.Settings(hot=3, share=20)).collect()
    assert collections.Counter(map(tuple, got)) == brute_substring(rows)
    parts = kept["substring-parts"].collect()
    assert max(r.n for r in parts) < 60 and max(collections.Counter((r.d1, r.d2) for r in parts).values()) <= 64
    assert kept["substring-hot"].select("d1", "d2").distinct().count() == 6 + 40 * 2


# mixing


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing_meets_targets(request, which):
    df = request.getfixturevalue(which).withColumn("key", F.lit(1))
    found, pieces = mixing.mix(df)
    got = mixing.summary(found, pieces).collect()
    rows = df.collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r.doc_id, len(words_of(r.text))) for r in rows)
    assert all(r.taken <= 2 * r.size for r in got)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(words_of(r.text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: weight[s] * level for s in open_}
    wanted = {(round(target[s], 6), sizes[s]) for s in order}
    assert {(round(r.target, 6), r.source_size) for r in got} == wanted
    total = collections.Counter()
    for r in got:
        total[round(r.target, 6), r.source_size] += r.taken
    assert all(abs(n - t * sum(1 for s in order if (round(target[s], 6), sizes[s]) == (t, z))) <= len(order) for (t, z), n in total.items())
    again = mixing.summary(*mixing.mix(df)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    text = mixing.sample(df, found, pieces)
    assert text.columns == df.columns
    assert sum(len(words_of(r.text)) for r in text.collect()) == sum(r.taken for r in got)


def test_mixing_does_not_depend_on_partitions(spark, docs):
    first = collections.Counter(map(tuple, mixing.summary(*mixing.mix(docs)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert collections.Counter(map(tuple, mixing.summary(*mixing.mix(docs.repartition(5))).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert mixing.summary(*mixing.mix(docs.limit(0))).count() == 0


def test_shards_are_drawn_and_totals_pinned(spark):
    slots = {0: 4000, 1: 1000, 2: 3000, 3: 1, 4: 0}
    plan = spark.createDataFrame(list(slots.items()), "number long, slots long")
    got = mixing.draws(plan, 64, "t").collect()
    by = collections.defaultdict(dict)
    for r in got:
        assert r["count"] > 0 and r.number not in by[r.shard]
        by[r.shard][r.number] = r["count"]
    assert {n: sum(b.get(n, 0) for b in by.values()) for n in slots} == slots
    assert sorted(by) == list(range(126)) and all(sum(b.values()) == (64 if i < 125 else 1) for i, b in by.items())
    first = np.array([by[i].get(0, 0) for i in range(125)])
    assert 0.6 < first.var() / (64 * 0.5 * 0.5) < 1.5  # that of a binomial draw
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mixing.draws(plan.repartition(3), 64, "t").collect()))


def test_blocks_are_taken_once_a_pass_and_written_out(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(5 + i % 40)), "en", "ab"[i % 2], 1) for i in range(60)] + [(99, "twice same", "en", "a", 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("mine"))
    found, pieces = mixing.mix(df, block=16, shard=8)
    words = {(r.number, r.start): r.size for r in found.filter("size > 0").collect()}
    taken = collections.Counter()
    for r in pieces.collect():
        for w in range(r.begin, r.begin + r.length):
            taken[r.number, r.start, r["pass"], w] += 1
        assert 0 <= r.begin and r.begin + r.length <= words[r.number, r.start] and 0 <= r.place < 8
    assert set(taken.values()) == {1}
    out = mixing.written(df, found, pieces).collect()
    texts = {r[0]: r[1].split() for r in rows}
    assert all(r.text.split() == texts[r.doc_id][r.begin : r.begin + len(r.text.split())] for r in out)
    assert sum(len(r.text.split()) for r in out) == pieces.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 12345])
def test_permutation(spark, n):
    got = [r.y for r in permuted(spark.range(n), "y", F.col("id"), F.lit(n), [F.lit("k")]).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != list(range(n))


# language and quality


def test_language(spark, docs, odd, none):
    model = langid.train(docs)
    got = langid.predict(docs.withColumn("score", F.lit(9)), model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)
    for r in langid.predict(odd, model).collect():
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    assert langid.accepted(odd, model).columns == odd.columns


def test_unlearned_languages_and_junk_are_rejected(spark, docs):
    texts = ["Быстрая лиса прыгает через ленивую собаку и бежит дальше в лес", "Szybki brązowy lis przeskoczył nad leniwym psem i pobiegł dalej", "敏捷的棕色狐狸跳过了懒狗然后跑进了森林", "x9#k qq 00;; zz-- 17 %% xk"]
    model = langid.train(docs)
    assert langid.accepted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).count() == 0
    known = docs.filter("lang is not null and length(text) > 100")
    assert langid.accepted(known, model).count() > 0.99 * known.count()


def test_language_scores_equal_brute_force():
    """Kernel values by sets of n-grams, the regression by least squares on Nystroem features from an eigenbasis of the kernel."""
    s = langid.Settings(per_language=6, landmarks=4, bits=16)
    rng = np.random.default_rng(2)
    words = ["der die und ist nicht", "the and is not of", "le la et est pas"]
    texts = [" ".join(rng.choice(words[i % 3].split(), 6)) for i in range(18)]
    labels = np.arange(18) % 3
    marks = [i for k in range(3) for i in np.flatnonzero(labels == k)[:4]]
    packed = np.stack([np.packbits(langid.features(t, s)) for t in texts])
    m = langid.kernel_ridge(packed, labels, np.array(marks), s, ["a", "b", "c"])

    def grams(t):
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    k = np.array([[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in texts] for a in texts])
    values, vectors = np.linalg.eigh(k[np.ix_(marks, marks)])
    good = values > 1e-8 * values.max()
    phi = k[:, marks] @ vectors[:, good] / np.sqrt(values[good])
    y = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    c = phi - phi.mean(axis=0)
    w = np.linalg.lstsq(np.concatenate([c, np.sqrt(s.ridge * len(c)) * np.eye(c.shape[1])]), np.concatenate([y - y.mean(axis=0), np.zeros((c.shape[1], 3))]), rcond=None)[0]
    assert np.allclose(langid.scores(texts, m), c @ w + y.mean(axis=0), atol=2e-3)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x3041 + i % 230)}{chr(0x4E00 + i % 230)} x{chr(0x3041 + i % 230)}", f"l{i % 230}", "s", 1) for i in range(1380)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df)
    assert len(model.languages) == 230
    got = langid.predict(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)


def test_repeated_rows_do_not_fill_the_sample(spark, docs):
    many = docs.union(spark.createDataFrame([(7, "the same text again and again", "en", "s", 1)], docs.schema).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    got = langid.predict(docs, langid.train(many)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_language_and_quality_of_very_long_texts(spark, sf, docs):
    long = docs.filter("lang = 'en'").limit(20).agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).first().t * 40
    df = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string").withColumn("hold", F.lit(1))
    got = langid.predict(df, langid.train(docs)).collect()
    assert got[0] == got[1] and got[0].lang_pred == "en" and got[0].hold == 1
    got = quality.predict(df, quality.train(docs, table(spark, sf, "labels"))).collect()
    assert got[0] == got[1] and 0 <= got[0].score <= 1


def test_quality_minimises_the_nonnegative_risk():
    """On a small problem the risk of the weights found is near the least that a search finds, and far under that of none."""
    rng = np.random.default_rng(6)
    s = quality.Settings(epochs=200, batch=200)
    p = np.c_[rng.normal(1.5, 1, 600), np.ones(600)].astype(np.float32)
    u = np.c_[np.r_[rng.normal(1.5, 1, 400), rng.normal(-1.5, 1, 600)], np.ones(1000)].astype(np.float32)

    def risk(w):
        loss = lambda x, y: 1 / (1 + np.exp(y * (x @ w)))
        return 0.4 * loss(p, 1).mean() + max(0, loss(u, -1).mean() - 0.4 * loss(p, -1).mean())

    least = min(risk(np.array([a, b])) for a in np.linspace(0, 6, 25) for b in np.linspace(-4, 4, 25))
    assert risk(quality._minimise(p, u, 0.4, s)) < least + 0.03 < risk(np.zeros(2)) - 0.1


def test_language_kernel_is_a_presence_kernel():
    s = langid.Settings(per_language=4, landmarks=2)
    texts = ["abc abd", "abe abf", "xyz xyw", "xyv xyu"]
    seen = np.stack([np.packbits(langid.features(t, s)) for t in texts])
    m = langid.kernel_ridge(seen, np.array([0, 0, 1, 1]), np.arange(4), s, ["a", "x"])
    assert [m.languages[i] for i in langid.scores(texts + ["abq", "xyq"], m).argmax(axis=1)] == ["a", "a", "x", "x", "a", "x"]


def test_quality(spark, sf, odd, none):
    docs, labels = (table(spark, sf.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.predict(docs.select("doc_id", "text").withColumn("predicted", F.lit("x")), model).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert quality.predict(odd.select("doc_id", "text"), model).count() == odd.count()
    assert quality.train(docs, labels.limit(0)) is None and quality.train(none, labels) is None
    assert quality.predict(none.select("doc_id", "text"), model).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 4200), rng.normal(-2, 1, 1800)])
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.08


# personal data


def test_pseudonyms(spark, odd, none):
    rows = [
        (1, "card 4111111111111111, 4111-1111-1111-1111 and 4111111111111112"), (2, "again 4111111111111111 born 1999-12-31, 31/12/1999, 12/31/1999 or 2024-13-45"),
        (3, "call +1 (743) 555-3824 or mail jane.doe@example.com from 10.0.0.256 or 192.168.1.77"), (4, "ssn 123-45-6789 not 000-12-3456 nor 666-12-3456; v 2.0.1 id 12"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    plain = re.findall(r"\d{16}", got[1].text)[0]
    assert plain == re.findall(r"\d{16}", got[2].text)[0] and plain == re.findall(r"\d{4}-\d{4}-\d{4}-\d{4}", got[1].text)[0].replace("-", "")
    digits = [int(c) for c in plain[::-1]]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert "4111111111111112" in got[1].text and "2024-13-45" in got[2].text and "1999-12-31" not in got[2].text and "31/12/1999" not in got[2].text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[3].text) and "555-3824" not in got[3].text and "10.0.0.256" in got[3].text and "192.168.1.77" not in got[3].text
    assert "jane.doe" not in got[3].text and re.search(r"[a-z]{4}\.[a-z]{3}@[a-z]{7}\.com", got[3].text)
    assert "000-12-3456" in got[4].text and "666-12-3456" in got[4].text and "123-45-6789" not in got[4].text and "2.0.1 id 12" in got[4].text
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[5].text) and got[5].text != rows[4][1]
    assert got[1].n_found == 3 and got[1].n_replaced == 2
    assert pii.pseudonymise(none, "k").count() == 0
    assert pii.pseudonymise(odd.withColumn("_found", F.lit(1)), "k").filter("doc_id = 2 and text is null").count() == 1


def test_cards_beside_other_numbers(spark):
    texts = ["pay 4111 1111 1111 1111 12/27 now", "4111111111111111 123", "4111-1111-1111-1111 123", "no 12 4111 1111 1111 1111.", "4111 1111 1111 1112 12/27"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()]
    new = re.search(r"[0-9]{16}", got[1])[0]
    assert new != "4111111111111111"
    spaced = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    assert got == [f"pay {spaced} 12/27 now", f"{new} 123", spaced.replace(" ", "-") + " 123", f"no 12 {spaced}.", texts[4]]


def test_dates_are_one_to_one_in_every_format(spark):
    days = spark.range(2000).select(F.date_add(F.lit("1996-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = {f: days.select(F.date_format("d", f).alias("text")) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")}
    texts = sorted({r.text for f in forms.values() for r in f.collect()})
    got = {t: r.text for t, r in zip(texts, pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "key").collect(), strict=True)}
    assert len(set(got.values())) == len(texts) and all(len(a) == 10 and a != b for a, b in got.items()) is not None
    assert sum(a == b for a, b in got.items()) < 5
    import datetime

    def read(t):
        if "-" in t:
            return datetime.date.fromisoformat(t)
        a, b, y = int(t[:2]), int(t[3:5]), int(t[6:])
        return datetime.date(y, b, a) if b <= 12 else datetime.date(y, a, b)

    one = {}
    for t, new in got.items():
        assert one.setdefault(read(t), read(new)) == read(new)  # a day has one pseudonym in all formats
    assert len(set(one.values())) == len(one)


def brute_pair(x, a, b, key, kind):
    left, right = divmod(x, b)
    prf = lambda turn, half: int(hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()[:14], 16)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + prf(i, right)) % a
        else:
            right = (right + prf(i, left)) % b
    return left * b + right


def test_pseudonyms_equal_brute_force(spark):
    texts = [f"{i % 223 + 1}.{i % 7}.{i * 13 % 256}.{i % 256}" for i in range(300)]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "k").collect()]
    for t, new in zip(texts, got, strict=True):
        o = [int(x) for x in t.split(".")]
        x = brute_pair(((o[0] * 256 + o[1]) << 16) + o[2] * 256 + o[3], 65536, 65536, "k", "ip")
        assert new == ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def test_pseudonyms_in_a_very_long_text_and_clashing_columns(spark):
    text = " ".join(f"word{i} 10.0.{i // 250}.{i % 250}" for i in range(20_000))
    df = spark.createDataFrame([(1, text, "mine"), (1, text, "mine")], "doc_id long, text string, n_found string").withColumn("n_replaced", F.lit("mine")).withColumn("key", F.lit(0))
    rows = pii.pseudonymise(df, "k").collect()
    assert rows[0] == rows[1] and rows[0].n_found == rows[0].n_replaced == 20_000 and len(rows[0].text.split()) == 40_000
    assert len(set(rows[0].text.split()[1::2])) == 20_000


def test_pseudonyms_are_one_to_one(spark):
    df = spark.range(3000)
    ip = df.select(F.concat(F.lit("10.1."), F.floor(F.col("id") / 250), F.lit("."), F.col("id") % 250).alias("t"))
    days = df.select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("t"))
    ssn = df.select(F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 99 + 1, F.col("id") + 1).alias("t"))
    mail = df.select(F.concat(F.lit("u"), F.col("id"), F.lit("@a.org")).alias("t"))
    phone = df.select(F.format_string("+44 20 7946 %04d", "id").alias("t"))
    for x in (ip, days, ssn, mail, phone):
        got = [r.text for r in pii.pseudonymise(x.select(F.col("t").alias("text")), "key").collect()]
        assert len(set(got)) == 3000 and sum(a == b.t for a, b in zip(got, x.collect(), strict=True)) < 30
