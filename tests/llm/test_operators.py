"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import xxhash

from lattice.llm import byte_bpe, language_model, neighbours, packing, quality_rules, simhash, suffix_dedup, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, score double"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(150)
TEXTS = [prose(60), prose(5), "", None, PASSAGE, f"{prose(40)} {PASSAGE[20:]} {prose(30)}", f"x{PASSAGE}", "ab " * 600, prose(3000), "日本語 \u3000 テスト İ <|endoftext|>", "\n\n a  b\t\r\nc 'll don't", PASSAGE, PASSAGE]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", 0.0) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_byte_bpe(docs, none):
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    found = by_id(byte_bpe.encode_decode(docs, path, public.PATTERN))
    for k, t in enumerate(TEXTS):
        ids = plain.encode_ordinary(t or "")
        assert found[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert found[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_decode(none, path, public.PATTERN).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    plain, pieces = Tokenizer.from_file(path), collections.defaultdict(list)
    rows = packing.pack(docs, path, tokens=256).collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for k, t in enumerate(TEXTS[1:], 1):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[a : a + 256].tobytes()) for a in range(0, len(ids), 256)]
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_best_fit_holds_every_capacity(score):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    where, _ = packing.best_fit(lengths, 100, 4, 6000.0, score)
    for k in range(where.max() + 1):
        own = lengths[where == k]
        assert own.sum() <= 100 and (len(own) == 1 or len(own) <= 4 and (own**2).sum() <= 6000)


def test_token_counts(docs, spark, none):
    path = public.path("byte_bpe_50k.tiktoken")
    own = token_counts.counter(path, public.PATTERN)
    pick = random.Random(2)
    for t in [t or "" for t in TEXTS if len(t or "") < 5000]:
        tree = token_counts.Tree(own.split(t), own.split, own.count)
        for _ in range(40):
            a = pick.randint(0, len(t))
            b = min(len(t), a + pick.choice([0, 1, 5, 40]))
            new = pick.choice(["", " ", "\n", "'s", " new words", "9", "   "])
            tree.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert "".join(tree.current()) == t
            assert tree.n_tokens == sum(own.count(own.split(t)))
    found = by_id(token_counts.recount(docs, path, public.PATTERN))
    assert found[3]["n_tokens"] == 0 and found[0]["n_tokens"] == found[0]["n_tokens_after"] > 0
    assert token_counts.recount(none, path, public.PATTERN).count() == 0


def test_kept_trees_take_edits(docs, spark, none):
    """Counts against the tokenizer library; the second edits start from the trees that the first ones left."""
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    trees = token_counts.plant(docs, path, public.PATTERN)
    found = by_id(trees)
    assert all(found[k]["n_tokens"] == len(plain.encode_ordinary(t or "")) for k, t in enumerate(TEXTS))
    edits = spark.createDataFrame([(0, 3, 9, "word"), (0, 5, 6, "lost"), (1, 0, 0, "new "), (2, 0, 0, "from nothing"), (5, 10, 40, None), (None, 0, 2, "an"), (8, 9999999, 9999999, " end"), (99, 0, 1, "x"), (1, None, 3, "x")], "doc_id long, start int, end int, replacement string")
    texts = dict(enumerate(TEXTS))
    once = token_counts.apply(trees, edits, path, public.PATTERN)
    expected = {**texts, 0: TEXTS[0][:3] + "word" + TEXTS[0][9:], 1: "new " + TEXTS[1], 2: "from nothing", 5: TEXTS[5][:10] + TEXTS[5][40:], 8: TEXTS[8] + " end", None: "an id"}
    expected[None] = "an" + "no id"[2:]
    for k, r in by_id(once).items():
        assert r["text"] == (expected[k] or "") and r["n_tokens"] == len(plain.encode_ordinary(expected[k] or "")), k
    assert once.count() == docs.count() and by_id(once)[0]["n_edits"] == 1 and by_id(once)[8]["n_encoded"] < 20
    again = by_id(token_counts.apply(once, spark.createDataFrame([(1, 1, 2, "ö")], edits.schema), path, public.PATTERN))
    text = "n" + "ö" + expected[1][2:]
    assert again[1]["text"] == text and again[1]["n_tokens"] == len(plain.encode_ordinary(text)) and again[0]["n_edits"] == 0
    assert token_counts.apply(token_counts.plant(none, path, public.PATTERN), edits, path, public.PATTERN).count() == 0


def test_quality_rules(docs, none, spark):
    import re

    found = by_id(quality_rules.judge(docs))
    for k, t in enumerate(TEXTS):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, inside = collections.Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                inside |= {*range(i, i + 5)}
        assert (found[k]["n_words"], found[k]["word_chars"], found[k]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(inside))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (found[k]["n_symbols"], found[k]["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}))
        assert found[k]["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
    assert quality_rules.judge(none).count() == 0
    clean = "The old house stands at the end of a long road, and nobody from the town has been in it for years."
    bad = ["a b c d e f g h i j k l m n", "the # # # # # of and to in a is that", "12 34 56 78 90 12 34 56 the 78 90 11", "\n".join(["the same line of words"] * 3 + ["another line with more words in it"])]
    rows = spark.createDataFrame([*enumerate([clean, *bad])], "doc_id long, text string")
    assert [r["kept"] for r in quality_rules.judge(rows).orderBy("doc_id").collect()] == [True, False, False, False, False]
    kept = quality_rules.judge(rows.selectExpr("*", "doc_id n_words", "doc_id row"), carry=True).where("kept").select("row.*").collect()
    assert [(r["doc_id"], r["n_words"], r["row"]) for r in kept] == [(0, 0, 0)]


def test_simhash(docs, none, spark):
    found = simhash.near_duplicates(docs).collect()
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in found if r["doc_id"] is not None}
    assert fp[2] == fp[3] == 0
    for r in found:
        if r["doc_id"] is not None:
            reach = {r["doc_id"]}
            while more := {b for a in reach for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2} - reach:
                reach |= more
            assert r["component_id"] == min(reach)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [5, 4000])
def test_simhash_links_of_dense_groups(spark, hot):
    pick = random.Random(3)
    fps = {pick.getrandbits(64) for _ in range(60)}
    center = pick.getrandbits(64)
    fps |= {center ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for _ in range(80)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = simhash.pivot_table(spark.createDataFrame([(f,) for f in signed], "fp long"))
    first = table.first()
    assert list(first["distances"]) == [((first["fp"] ^ int(p)) & (1 << 64) - 1).bit_count() for p in simhash.REFERENCES] and first["cell"] == first["fp"]
    rows = simhash.links(table, 2, hot).collect()
    up = {f: f for f in signed}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in rows:
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2
        up[top(r["a"])] = top(r["b"])
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert top(a) == top(b)


def without_repeats(data, length):
    """Brute force: each text's remaining bytes and the number of removed ones."""
    n, out = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1)), []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        out.append((np.frombuffer(b, np.uint8)[~gone].tobytes(), int(gone.sum())))
    return out


@pytest.mark.parametrize("length,group", [(400, 1000), (40, 1000), (40, 6), (40, 1)])
def test_suffix_dedup(docs, none, length, group, monkeypatch):
    """Repeated rows and a null id included; small groups lead through the split and the counted way."""
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (length, None, group))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    rows += [(None, rows[0][1] + b" tail"), (7, PASSAGE[:90].encode() + b" other")]
    more = docs.sparkSession.createDataFrame([(k, b.decode(), "en", 0.0) for k, b in rows[-2:]], DOCS)
    found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs.unionByName(more), length).collect())
    kept = without_repeats([b for _, b in rows], length)
    assert found == collections.Counter((k, len(b), n, hashlib.sha256(left).hexdigest()) for (k, b), (left, n) in zip(rows, kept))
    assert suffix_dedup.remove_repeats(none, length).count() == 0


def test_suffix_dedup_of_a_passage_in_many_texts(spark, monkeypatch):
    """One gram with many different surroundings, some of which agree on more."""
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (60, None, 8))
    pick = random.Random(4)
    core = "".join(pick.choice("abcdefgh ") for _ in range(55))
    texts = [prose(5) + pick.choice(["", "xy", "12345"]) + core + pick.choice(["", "z", "67890"]) + prose(5) for _ in range(60)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 60).collect()
    kept = without_repeats([t.encode() for t in texts], 60)
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {k: hashlib.sha256(b).hexdigest() for k, (b, _) in enumerate(kept)}
    assert 0 < sum(n > 0 for _, n in kept) < 60


def test_deep_shallow_sorts():
    pick = random.Random(8)
    strings = [bytes(pick.choice(b"ab") for _ in range(pick.randint(0, 90))) for _ in range(300)] + [b"", b"ab", b"ab"]
    assert [strings[i] for i in suffix_dedup.deep_shallow(strings, 0, 8)] == sorted(strings)


def test_cleaned_texts_keep_columns(docs, none):
    out = suffix_dedup.cleaned_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.cleaned_texts(none).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 doc", "2 spans", "3 rest", "4 text_hash")
    assert suffix_dedup.cleaned_texts(clash).columns == clash.columns and suffix_dedup.cleaned_texts(clash).where("doc = 1 and spans = 2").count() == docs.count()


def test_neighbours(spark):
    gen = np.random.default_rng(0)
    x = gen.standard_normal((600, 16))
    x[300:340] = x[300]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(600, None), (650, [0.0] * 16), (700, [float("nan")] * 16), (750, [1.0] + [None] * 15), (0, [float(v) for v in x[0]])]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), __import__("pyspark.sql.functions").sql.functions.col("vec_id") % 50 == 0, block=200, query_block=4).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {*range(0, 600, 50)} and all(len(v) == 5 for v in got.values())
    for q, own in got.items():
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(own) & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert got[300] == [301, 302, 303, 304, 305]


def test_neighbours_of_huge_and_tiny_vectors(spark):
    col = __import__("pyspark.sql.functions").sql.functions.col
    gen = np.random.default_rng(1)
    x = gen.standard_normal((60, 8))
    near = lambda scale: neighbours.nearest(spark.createDataFrame([(k, [float(v) * scale for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>"), col("vec_id") % 30 == 0).collect()
    plain = near(1.0)
    assert len(plain) == 10 and near(2.0**660) == near(2.0**-660) == plain
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), col("vec_id") % 30 == 0).count() == 0


def test_url_filters(spark):
    urls = [None, "no scheme", "http://Example.com/en/x?q", "https://a.www.example.com/en/", "ftp://example.com:80/en/", "x://sub.net/es/1#f", "http://net/fr/", "http://other.org", "http://badexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    small = sorted(url_filters.judge_urls(pages, rules).collect())
    large = sorted(url_filters.judge_urls(pages, rules, max_sent_rules=0).collect())
    assert small == large
    again = pages.unionByName(pages.where("page_id = 2")).unionByName(pages.selectExpr("cast(null as long) page_id", "url"))
    count = lambda most: collections.Counter(url_filters.judge_urls(again, rules, max_sent_rules=most).collect())
    assert count(0) == count(50) and sum(count(0).values()) == 2 * len(urls) + 1
    assert url_filters.judge_urls(pages.limit(0), rules, max_sent_rules=0).count() == url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}
    assert [r["rule"] for r in small] == [None, None, "example.com/en/", "www.example.com/en/", None, "net/es/", "net/fr/", None, "com/"]


def test_marginals_are_those_of_all_paths():
    import itertools

    gen = np.random.default_rng(4)
    scores, moves = gen.standard_normal((3, 6)), gen.standard_normal((2, 2))
    for row, odds in zip(scores, toxicity.document_marginals([*scores], moves)):
        weight = np.zeros((6, 2))
        for path in itertools.product((0, 1), repeat=6):
            w = np.exp(sum(row[k] * y for k, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for k, y in enumerate(path):
                weight[k, y] += w
        assert np.allclose(odds, np.log(weight[:, 1] / weight[:, 0]))


def test_marginals_cross_window_borders():
    gen = np.random.default_rng(0)
    moves = gen.standard_normal((2, 2))
    lists = [2 * gen.standard_normal(n) for n in (0, 1, 5, 64, 65, 128, 129, 500, 63, 192)]
    for x, odds in zip(lists, toxicity.document_marginals(lists, moves)):
        emit, n = np.stack([np.zeros(len(x)), x], -1), len(x)
        a, b = np.array(emit), np.zeros((n, 2))
        for k in range(1, n):
            a[k] = [np.logaddexp(a[k - 1, 0] + moves[0, j], a[k - 1, 1] + moves[1, j]) + emit[k, j] for j in (0, 1)]
        for k in range(n - 2, -1, -1):
            b[k] = [np.logaddexp(moves[i, 0] + emit[k + 1, 0] + b[k + 1, 0], moves[i, 1] + emit[k + 1, 1] + b[k + 1, 1]) for i in (0, 1)]
        assert np.allclose((a + b)[:, 1] - (a + b)[:, 0], odds) if n else not len(odds)


def test_tagger_gradient_is_that_of_finite_differences():
    gen = np.random.default_rng(3)
    scores, moves, y = gen.standard_normal((2, 5)), gen.standard_normal((2, 2)), gen.integers(0, 2, (2, 5)).astype(float)

    def loss(s, m):
        import itertools

        total = 0.0
        for row, tags in zip(s, y.astype(int)):
            value = lambda p: sum(row[k] * v for k, v in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += np.logaddexp.reduce([value(p) for p in itertools.product((0, 1), repeat=5)]) - value(tags)
        return total

    d_s, d_t = toxicity.gradient(scores, moves, y)
    for array, grad, at in ((scores, d_s, (0, 2)), (scores, d_s, (1, 4)), (moves, d_t, (0, 1)), (moves, d_t, (1, 1))):
        up, down = (array.copy() for _ in range(2))
        up[at] += 1e-5
        down[at] -= 1e-5
        pair = [(x, moves) if array is scores else (scores, x) for x in (up, down)]
        assert grad[at] == pytest.approx((loss(*pair[0]) - loss(*pair[1])) / 2e-5, abs=1e-6)


def test_toxicity_held_out(spark, none):
    pick = random.Random(1)
    bad = ["scumbag", "scumface", "idiot"]
    rows, labels = [], []
    for k in range(200):
        w, toxic = prose(40).split(), k % 4 == 0
        if toxic:
            w[pick.randrange(40)] = pick.choice(bad)
        rows.append((k, " ".join(w), "en", 0.0))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, None, None)], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where("doc_id % 5 <> 0"))
    found = by_id(toxicity.score(docs, model))
    held = [k for k in range(0, 200, 5)]
    assert sum(found[k]["predicted"] == labels[k][1] for k in held) >= 0.95 * len(held)
    assert found[900]["predicted"] == 0
    carried = toxicity.score(docs.withColumn("score", docs["doc_id"]), model, carry=True).select("row.doc_id", "row.lang", "predicted").collect()
    assert len(carried) == 201 and all(r["predicted"] == found[r["doc_id"]]["predicted"] for r in carried)
    spans = [rows[k][1][s["start"] : s["end"]] for k in held for s in found[k]["spans"]]
    assert set(spans) <= set(bad) and spans
    assert toxicity.score(none, toxicity.fit(none, known)).count() == 0


def test_language_model(docs, none):
    found = by_id(language_model.log_likelihoods(docs.where("doc_id is not null").distinct()))
    own = {k: (t or "").encode().lower().split() + [None] for k, t in enumerate(TEXTS)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in own}
    counts = collections.Counter(w for k, ws in own.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in own.items():
        assert found[k]["n_tokens"] == len(ws) and found[k]["score"] < 0
        assert found[k]["n_known"] == sum(counts[w] > 0 for w in ws) and found[k]["train_tokens"] == n and found[k]["held_out"] == held[k]
        assert found[k]["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    assert language_model.log_likelihoods(none).count() == 0


def test_split_gives_each_text_its_tokens():
    texts = [*TEXTS, " ", "\n\t Ab  cD \x0b", "\x1c\x1d\x1e\x1f \x85\xa0", *(f"{chr(c)}Q {chr(c)}q{chr(c)}" for c in range(0x300))]
    words, n = language_model.split(texts)
    own = [language_model.tokens(t) for t in texts]
    assert n.tolist() == [*map(len, own)] and words.to_pylist() == [w for ws in own for w in ws]
    assert [x.tolist() for x in language_model.ended(np.arange(2, 2 + len(words)), n)[:2]] == [[*range(2, 62), 1], [*range(62, 67), 1]]
    assert language_model.split([])[1].tolist() == language_model.split([None, ""])[1].tolist()[2:] == []


def test_scores_do_not_depend_on_portions(docs):
    """Nor on what a task reads at once; the network's sums are those of the plain way, document by document."""
    rows = docs.selectExpr("doc_id", "text", "0L fold").repartition(2)
    counts = language_model.word_counts(rows, most=300)
    assert {r["word"]: r["n"] for r in counts.collect()} == {r["word"]: r["n"] for r in language_model.word_counts(rows).collect()}
    stats = language_model.fit(rows, counts, head=200, vocabulary=150)
    key = lambda r: (r["n_tokens"], r["doc_id"] is None, r["doc_id"], r["n_known"])
    whole, parts = (sorted(language_model.score(rows, stats, counts, **k).collect(), key=key) for k in ({}, {"most": 700, "at_once": 150}))
    assert len(whole) == len(TEXTS) + 2 and [*map(key, whole)] == [*map(key, parts)]
    for a, b in zip(whole, parts):
        assert (a["score"], a["base_score"]) == pytest.approx((b["score"], b["base_score"]), rel=1e-5)
    sums = {bytes(r["word"]): r["n"] for r in counts.collect()}
    for r in whole:
        words = language_model.tokens(TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id")
        symbols, _ = language_model.symbols_of(words, stats)
        others = sum(np.log10((sums[w] + 1) / (stats.other_n + stats.other_v + 1)) for w, s in zip(words, symbols) if s == language_model.OTHER)
        assert r["score"] == pytest.approx(stats.network.score([symbols])[0] / np.log(10) + others, rel=1e-5)


def test_network_learns_order():
    words = [2, 3, 4, 5]
    documents = [np.array([*(words * 6), 1], np.int32) for _ in range(40)]
    net = language_model.Network(4)
    net.start(np.array([1, 40, *[240] * 4], float))
    before = net.score(documents[:1])[0]
    net.train(documents, lanes=8, epochs=8)
    assert net.score(documents[:1])[0] > 0.3 * before > before


def test_network_gradient_is_that_of_finite_differences():
    """One window from zero states, whose loss is the sum of the negative log-probabilities of its tokens."""
    gen = np.random.default_rng(6)
    target = gen.integers(0, 9, (3, language_model.UNROLL)).astype(np.int32)
    net = language_model.Network(7, hidden=4)
    net.start(np.array([3, 5, *range(20, 6, -2)], float))
    net.p = {k: v.astype(np.float64) + (k in ("x", "u", "wc", "wi")) * 0.3 * gen.standard_normal(v.shape) for k, v in net.p.items()}
    net.p["bi"][0, 7:] = -1e4
    start, before = np.zeros((3, 4), np.float64), np.full(3, language_model.END)

    def loss():
        h, x, total = start, before, 0.0
        for k in range(target.shape[1]):
            h = net.step(np.where((x == language_model.END)[:, None], 0, h), x)[0]
            total -= net.log_probs(h, target[:, k]).sum()
            x = target[:, k]
        return total / (3 * language_model.UNROLL)

    kept = {k: v.copy() for k, v in net.p.items()}
    grads = net.gradients(target, start, before)[0]
    for k, g in grads.items():
        for at in [tuple(gen.integers(0, n) for n in g.shape) for _ in range(4)]:
            if k == "bi" and at[1] >= 7:
                continue
            around = []
            for d in (1e-4, -1e-4):
                net.p = {name: v.copy() for name, v in kept.items()}
                net.p[k][at] += d
                around.append(loss())
            assert g[at] == pytest.approx((around[0] - around[1]) / 2e-4, abs=2e-4), (k, at)


def test_network_reads_every_training_document(spark):
    rows = [(k, "a b c d " * 4) for k in range(900)] + [(k, "e f g h " * 3000) for k in range(900, 903)] + [(None, None)]
    training = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = language_model.word_counts(training)
    stats = language_model.fit(training, counts)
    long, _ = language_model.symbols_of(language_model.tokens("e f g h " * 20), stats)
    untrained = language_model.Network(stats.network.n_words)
    untrained.start(np.array([0, 904, *[1.0] * stats.network.n_words]))
    assert stats.network.score([long])[0] > 0.5 * untrained.score([long])[0]  # only long documents have these words
    assert language_model.train(training, stats) == 3 * len(rows)  # small: read in each round
    assert language_model.train(training, stats, shard=1000) == len(rows)  # many shards: a slice a round
    assert np.isfinite(stats.network.score([long])[0])


def test_network_reads_once_at_any_size(spark, monkeypatch):
    training = spark.createDataFrame([(k, f"a b c{k % 7} d") for k in range(300)], "doc_id long, text string")
    counts, readings, plain = language_model.word_counts(training), [], language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a, **k: readings.append(plain(*a, **k)))
    for shard in (language_model.SHARD, 200):
        language_model.fit(training, counts, shard=shard)
    assert readings == [300, 300]


def test_pipeline_links_by_fingerprints(spark):
    """Texts of a passage again and again with ends of their own: few shingles in common, but one fingerprint."""
    import corpus_pipeline

    again = " ".join(f"w{k}" for k in range(21))
    texts = [" ".join([again] * 50 + [f"{end}{k}" for k in range(30)]) for end in "abc"] + [" ".join(f"x{k}" for k in range(60))]
    assert simhash.fingerprint(texts[0]) == simhash.fingerprint(texts[1])
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 3]


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    pick = random.Random(8)
    texts = ["", None, "two words", "two words"]
    for n in (12, 60, 300, 300):
        text = [f"w{pick.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(text))
        for _ in range(25):  # a walk, so that the ends are far apart, and copies of its start
            text = [w if pick.random() > 0.01 else f"w{pick.randrange(5000)}" for w in text]
            texts.append(" ".join(text))
            texts.append(" ".join(texts[-2].split()[: pick.randrange(5 * n // 8, n)]))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    stays = []
    for k in range(len(texts)):
        reach, new = {k}, [k]
        while new:
            new = [b for b in range(len(texts)) if b not in reach and any(alike(sets[a], sets[b]) for a in new)]
            reach |= {*new}
        if k == min(reach):
            stays.append(k)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == stays
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage and as a whole: null and repeated ids, copies, a toxic and a poor text, a passage in two texts."""
    import corpus_pipeline

    pick = random.Random(3)
    common = "the of and to in that it for was on are with as be this have from".split()
    words = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(pick.choice(common if pick.random() < 0.3 else words) for _ in range(n)) + "."
    rows = [(k, text(60)) for k in range(150)]
    toxic = {k for k in range(0, 150, 4)}
    rows = [(k, t.replace(" ", " scumbag ", 1)) if k in toxic else (k, t) for k, t in rows]
    passage = text(55)
    assert corpus_pipeline.REPEAT < len(passage) < 400
    clean, poor = text(80), "## $$ ## $$"
    extra = [(200, clean), (201, clean), (None, clean), (202, f"{text(50)} {passage} {text(50)}"), (203, f"{text(40)} {passage} {text(70)}"),
             (204, poor), (204, text(70)), (205, None), (None, text(65)), (None, rows[0][1]), (206, clean), (206, clean)]
    table = lambda data, schema: spark.createDataFrame(data, schema)
    table([(k, t, "en", "s", len(t or "")) for k, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    table([(k, 1, int(k in toxic)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    texts = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    bad = collections.Counter((k, t) for k, t in rows + extra if "scumbag" in (t or ""))
    assert texts(after) == collections.Counter(rows + extra) - bad and after.columns == docs.columns
    judged = quality_rules.judge(after.withColumn("doc_id", after["n_chars"])).where("kept").count()
    good = corpus_pipeline.drop_poor(spark, after, str(tmp_path))
    kept = texts(good)
    assert sum(kept.values()) == judged and (204, poor) not in kept and (205, None) not in kept and sum(k == 204 for k, _ in kept) == 1
    single = texts(corpus_pipeline.drop_near_copies(spark, good, str(tmp_path)))
    assert single == collections.Counter({x for x in kept if x[1] != clean or x[0] == 200})
    cut = corpus_pipeline.drop_repeats(spark, corpus_pipeline.drop_near_copies(spark, good, str(tmp_path)), str(tmp_path))
    left = collections.Counter(b for b, _ in without_repeats([t.encode() for _, t in single], corpus_pipeline.REPEAT))
    assert collections.Counter(t.encode() for _, t in texts(cut)) == left and not any(passage[5:-5] in t for _, t in texts(cut))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(k for k, _ in single.elements())
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(plain.encode(b.decode(), add_special_tokens=False).ids) + 1 for b in left.elements())


def test_links_between_groups_in_blocks(spark):
    """Copies of one text that are alike only in chains, in one block and in many."""
    from lattice.llm import near_copies

    pick = random.Random(2)
    text, texts = [f"w{k}" for k in range(120)], []
    for _ in range(60):
        texts.append(" ".join(text[pick.randrange(20) :][: pick.randrange(90, 120)]))
    sets = [{*near_copies.shingles(t).tolist()} for t in texts]
    held = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text", "doc_id row").mapInArrow(near_copies._sets, "doc_id bigint, same bigint, n bigint, keys array<bigint>, shingles binary, row bigint").cache()
    of = {r["same"]: r["doc_id"] for r in held.collect()}
    roots = held.selectExpr("same fp", "same root").distinct()

    def joined(pairs):
        up = {k: k for k in of.values()}

        def top(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in pairs:
            up[top(a)] = top(b)
        return {frozenset(j for j in up if top(j) == top(k)) for k in up}

    true = [(a, b) for a in of.values() for b in of.values() if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for block in (10**6, 300):
        shared = near_copies.shared_keys(held)
        found = [(of[r["a"]], of[r["b"]]) for r in near_copies.links_between(shared, near_copies.shared_sets(held, shared), roots, 0.8, block).collect()]
        assert all((min(p), max(p)) in true for p in found) and joined(found) == joined(true)
