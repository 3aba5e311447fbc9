"""The training-data operators against brute force, the libraries, and odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import bpe, chat, components, decontaminate, jaccard_join, lm_scores, mpeg_audio, pii, quality, queries, token_counts, toxicity
from veilmark.llm.tokens import NOT_ALNUM, grams, word_hashes

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]
ODD = [None, "", " \n\t ", "one", "two words", "a b c a b c", "x " * 5000, "É é ß İ 日本 😀", "<|turn|>user<|says|>hi<|done|>\\l\\b<", "a b c a b c"]


def odd_docs(spark, **more):
    rows = [(i, t, "en" if i % 2 else None, "src0", len(t) if t else None) for i, t in enumerate(ODD)] + [(3, "one", "en", "src0", 3), (None, "one", "en", None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_components(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {d: (len(sets[d]), low[d]) for d in sets}


def near_copies(seed):
    """Families of near copies at many distances, copies, and short texts."""
    r = random.Random(seed)
    out = []
    for _ in range(12):
        base = [r.choice(WORDS) + r.choice(WORDS) for _ in range(r.choice([3, 8, 20, 60, 200]))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_components_are_those_of_brute_force(spark, n, num):
    rows = near_copies(n)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df, n, num, 100).collect()}
    assert got == brute_components(rows, n, num, 100)


def family(seed, members, words, most):
    """Copies of one text with up to `most` words replaced: some linked to one another, some to none; and texts that share a passage only."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(members):
        w = list(base)
        for k in r.sample(range(words), r.randrange(most)):
            w[k] = f"n{i}x{k}"
        out.append(" ".join(w))
    out += [" ".join([f"own{i}x{k}" for k in range(words // 2)] + base[: words // 2]) for i in range(members // 4)]
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "num", "most"), [(3, 90, 5), (5, 80, 8)])
def test_jaccard_of_a_large_family(spark, monkeypatch, n, num, most):
    monkeypatch.setattr(jaccard_join, "REPS", 1)
    monkeypatch.setattr(jaccard_join, "CHUNK", 5000)
    rows = family(n, 300, 120, most)
    want = brute_components(rows, n, num, 100)
    assert len({low for _, low in want.values()}) > 80  # many stay outside of the large component
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df, n, num, 100).collect()} == want


def test_jaccard_signatures_are_shared_by_similar_sets():
    """Whatever the size: a set and one at the limit of similarity share as many signatures as either counts on."""
    r = np.random.default_rng(1)
    for num in (80, 90):
        levels = jaccard_join.Levels(num, 100)
        for size in (9, 20, 21, 40, 77, 150, 400, 1500):
            for _ in range(15):
                x = np.unique(r.integers(0, 2**64, size, np.uint64))
                y = x[: int(np.ceil(len(x) * num / 100))] if r.random() < 0.3 else np.unique(np.concatenate([x[(len(x) * (100 - num)) // (100 + num) :], r.integers(0, 2**64, (len(x) * (100 - num)) // (100 + num), np.uint64)]))
                both = len(np.intersect1d(x, y))
                assert 100 * both >= num * (len(x) + len(y) - both)
                a, b = ({level: (set(s.tolist()), need) for level, (s, need) in enumerate(levels.sign(v), int(np.searchsorted(levels.ends, len(v))))} for v in (x, y))
                for level in a.keys() & b.keys():
                    for mine in (a, b):
                        assert len(a[level][0] & b[level][0]) >= mine[level][1]
                assert len(x) < 10 or a.keys() & b.keys()


def test_jaccard_odd_inputs(spark):
    got = jaccard_join.components(odd_docs(spark, node=1, component=2), 3, 90, 100).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[1].component_id == 1
    assert by[9].component_id == 5 and by[5].n_shingles == 3
    assert all(r.component_id == 3 for r in got if r.doc_id in (None, 3))
    assert jaccard_join.components(empty_docs(spark), 3, 90, 100).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 99: 99, 100: 99}


def test_word_hashes_follow_words():
    texts = [b"", b"The the THE x", None, "é É".encode()]
    h, first = word_hashes(texts)
    assert first.tolist() == [0, 0, 4, 4, 6] and h[0] == h[1] == h[2] != h[3] and h[4] != h[5]
    assert len(word_hashes([b"a.b,c"], NOT_ALNUM)[0]) == 3
    assert grams(h, first, 2)[1].tolist() == [0, 0, 3, 3, 4]


@pytest.fixture(scope="module")
def codec():
    with open(queries.tokenizer_path("word_bpe_49k.json"), "rb") as f:
        raw = f.read()
    from tokenizers import Tokenizer

    return bpe.Codec(raw), Tokenizer.from_str(raw.decode())


def test_bpe_equals_the_library(codec):
    mine, library = codec
    texts = [t or "" for t in ODD] + ["don't DON'T 'sx", "<|endoftext|>a<|startoftext|>b <|ENDOFTEXT|>", "Σίσυφος ΣΑΣ ﬁ Å", "a\xa0b\x85c　d", "aaaaaaaaa hahahaha", "١٢٣ ½ 12.5", "a\x1cb\x00c", "e" * 3000, "...---..."]
    for text, ids in zip(texts, mine.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert mine.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_and_counts_odd_inputs(spark, codec):
    path = queries.tokenizer_path("word_bpe_49k.json")
    docs = odd_docs(spark, ids="mine", n_bytes="mine")
    coded = bpe.encode(docs, path).collect()
    counted = token_counts.count_tokens(docs.drop("ids"), path, limit=1).collect()
    want = sorted(len(codec[1].encode(t or "", add_special_tokens=False).ids) for t in [*ODD, "one", "one"])
    assert sorted(r.n_tokens for r in coded) == sorted(r.n_tokens for r in counted) == want
    assert all(len(r.ids) == r.n_tokens for r in coded) and all(r.over_limit == (r.n_tokens > 1) for r in counted)
    assert bpe.encode(empty_docs(spark), path).count() == token_counts.count_tokens(empty_docs(spark), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(name, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 20)
    with open(queries.tokenizer_path(name), "rb") as f:
        counter = token_counts.Counter(f.read(), name.split(".")[-1])
    texts = [t or "" for t in ODD] + ["a  b   c\n\n d  e " * 20, "longer words between single spaces " * 10]
    assert counter.count([t.encode() for t in texts]) == counter.lengths(texts)


def test_chat_round_trip(spark):
    turns = [(1, i, r, t) for i, (r, t) in enumerate([("user", "<|turn|>x"), ("assistant", "a\\l<b\\b|>"), ("assistant", None), (None, "")])] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.masked(chat.read_back(chat.format_conversations(df))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "<|turn|>x"), ("assistant", "a\\l<b\\b|>"), ("assistant", ""), ("", "")]
    assert got[1].loss_texts == ["a\\l<b\\b|>", ""] and got[None].loss_texts == []
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert chat.format_conversations(df.withColumns({"blocks": F.lit(1), "formatted": F.lit(2), "rows": F.lit(3)})).count() == 2


def test_chat_ties_repeated_turns_and_long_conversations(spark):
    """Against plain Python: turns in order, ties by role and unescaped text, repeated rows kept, hundreds of turns, very long texts."""
    r = random.Random(14)
    turns = [(c, r.randrange(3), r.choice(["user", "assistant", "<x>"]), r.choice(["A", "<", "\\", "a<b", "Z" * 9])) for c in range(6) for _ in range(30)]
    turns += [(9, i, ("user", "assistant")[i % 2], f"t{i}" * (1 + i % 3)) for i in range(700)] + [(10, 0, "assistant", "long <" * 50_000)] + turns[:9]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for got in chat.masked(chat.read_back(chat.format_conversations(df))).collect():
        want = sorted((t, role, text) for c, t, role, text in turns if c == got.conv_id)
        assert [(x.role, x.text) for x in got.turns] == [w[1:] for w in want]
        assert got.loss_texts == [text for _, role, text in want if role == "assistant"]


def test_chat_parts(spark):
    part = lambda kind, **v: (kind, v.get("text"), v.get("ref"), v.get("width"), v.get("height"), v.get("seconds"), v.get("pages"))
    rows = [(1, 0, "user", [part("text", text="see <"), part("image", ref="i.png", width=1000, height=500), part("text", text="|turn|>")]), (1, 1, "assistant", [part("audio", ref="a.mp3", seconds=2.5), part("document", ref="d.pdf", pages=3)]), (1, 2, "user", None)]
    got = chat.format_conversations(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, content array<{chat.PART}>")).first()
    assert got.formatted.startswith("<|turn|>user<|says|>see \\l<|image:0|>|turn|><|done|><|turn|>assistant<|says|><|audio:1|><|document:2|><|done|>")
    assert [(a.n, a.kind, a.ref, a.tokens) for a in got.attachments] == [(0, "image", "i.png", 510), (1, "audio", "a.mp3", 63), (2, "document", "d.pdf", 2400)]
    assert got.n_expanded == 2973
    many = [(1, 0, "user", [part(("text", "image")[i % 2], text=f"<{i}", ref=f"{i}") for i in range(200)])]
    got = chat.format_conversations(spark.createDataFrame(many, f"conv_id bigint, turn bigint, role string, content array<{chat.PART}>")).first()
    assert got.formatted == "<|turn|>user<|says|>" + "".join(f"\\l{i}" if i % 2 == 0 else f"<|image:{i // 2}|>" for i in range(200)) + "<|done|>" and [a.ref for a in got.attachments] == [str(i) for i in range(1, 200, 2)]


def brute_lm(rows, train):
    from collections import Counter

    c = Counter()
    for d, t in rows:
        if train(d):
            c.update([*words_of(t), None])
    return c


def test_lm_counts_and_held_out_gain(spark):
    r = random.Random(4)
    text = lambda: " ".join(w for _ in range(30) for w in (lambda i: (f"a{i}", f"b{i}"))(r.randrange(12)))
    rows = [(i, text()) for i in range(120)] + [(120, None), (121, ""), (122, "never seen")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm_scores.score(df, train=F.col("doc_id") % 4 != 0, tune=F.col("doc_id") % 4 == 1).collect()
    c = brute_lm(rows, lambda d: d % 4 != 0)
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for row in got:
        tokens = [*words_of(texts[row.doc_id]), None]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert row.base_score == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in tokens))
    held = [r for r in got if r.doc_id % 4 == 0 and r.doc_id < 120]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    assert lm_scores.score(df.limit(0), train=F.lit(True), tune=F.lit(False)).count() == 0
    assert lm_scores.score(odd_docs(spark), train=F.lit(False), tune=F.lit(False)).count() == len(ODD) + 2


def brute_scores(rows, train, weights, order):
    """Scores by plain counting, with given weights."""
    from collections import Counter

    streams = {d: [*words_of(t), None] for d, t in rows}
    begun = {d: ["<s>", *s] for d, s in streams.items()}
    gram = lambda s, i, n: tuple(s[i + 2 - n : i + 2]) if i + 2 >= n else None
    c = {n: Counter(g for d, s in begun.items() if train(d) for i in range(len(s) - 1) if (g := gram(s, i, n))) for n in range(1, order + 1)}
    starts = sum(train(d) for d in streams)
    total, types = sum(c[1].values()), len(c[1])
    out = {}
    for d, s in streams.items():
        score = 0.0
        for i, t in enumerate(s):
            h = c[1][(s[i - 1],)] if i else starts
            w = weights.get(int(np.floor(np.log2(h))) + 1 if h else 0, weights[-1])
            p = w[0] / (types + 1) + w[1] * c[1][(t,)] / max(total, 1)
            for n in range(2, order + 1):
                g = gram(begun[d], i, n)
                if g is None:
                    continue
                below = starts if g[:-1] == ("<s>",) else c[n - 1][g[:-1]]
                p += w[n] * c[n][g] / below if below else 0.0
            score += np.log10(p)
        out[d] = score
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scores, "BATCH_BYTES", 700)
    r = random.Random(15)
    rows = [(i, " ".join(r.choices(WORDS[:12], k=r.randrange(0, 40)))) for i in range(90)] + [(90, "unheard of"), (91, "A b A b a B")]
    weights = {-1: np.full(order + 1, 1 / (order + 1)), **{b: np.arange(1, order + 2)[:: (-1) ** b] / ((order + 1) * (order + 2) / 2) for b in range(0, 9)}}
    got = {x.doc_id: x.score for x in lm_scores.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), F.col("doc_id") % 3 != 0, F.lit(False), order, weights).collect()}
    want = brute_scores(rows, lambda d: d % 3 != 0, weights, order)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lm_query_against_brute_force(spark, monkeypatch):
    learnt = {}
    inner = lm_scores.fit_weights
    monkeypatch.setattr(lm_scores, "fit_weights", lambda ratios, order: learnt.setdefault("w", inner(ratios, order)))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {x.doc_id: x for x in queries.op5_lm_scores(spark, SF).collect()}
    want = brute_scores(rows, lambda d: zlib.crc32(str(d).encode()) % 7 != 2, learnt["w"], lm_scores.ORDER)
    assert all(got[d].score == pytest.approx(want[d]) for d in want) and len(got) == len(want)


def test_lm_weights_are_those_of_plain_expectation_maximisation(spark):
    r = np.random.default_rng(5)
    rows = [(int(b), [float(x), float(y)], int(n)) for b, x, y, n in zip(r.integers(0, 3, 400), r.gamma(1, 3, 400), r.gamma(0.3, 40, 400), r.integers(1, 9, 400))]
    got = lm_scores.fit_weights(spark.createDataFrame(rows, "bucket bigint, ratios array<double>, n bigint"), 2, polish=25)

    def plain(mine, prior):
        w = np.full(3, 1 / 3)
        for _ in range(400):
            s = np.array([[w[0], w[1] * x, w[2] * y] for _, (x, y), _ in mine])
            w = (s / s.sum(1, keepdims=True) * np.array([[n] for _, _, n in mine])).sum(0) + prior
            w /= w.sum()
        return w

    every = plain(rows, np.full(3, 1e-6))
    assert np.allclose(got[-1], every, atol=5e-3)
    assert all(np.allclose(got[b], plain([x for x in rows if x[0] == b], 20 * every), atol=5e-3) for b in range(3))


def test_lm_differences():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    for k in (keys, keys[:1], keys[:0], np.array([0, 2**64 - 1], np.uint64)):
        assert (lm_scores.from_differences(lm_scores.differences(k)) == k).all()


def test_lm_probabilities_add_up():
    """Weights add up to one in each bucket, so mixtures of distributions are one."""
    w = lm_scores.learn_weights(np.array([0, 0, 1]), np.array([[3, -10_000], [-10_000, -10_000], [2, 9]]), np.array([5, 2, 9]), 2)
    assert all(x.sum() == pytest.approx(1) and (x > 0).all() for x in w.values())


def test_mpeg_round_trip_and_damage():
    for raw in (b"", b"a", b"\xff" * 575, bytes(range(256)) * 40, b"\xff\xfa\xb4\xc0" * 700):
        payload = mpeg_audio.padded(raw)
        media = mpeg_audio.write(payload, "title")
        s = mpeg_audio.parse(media)
        assert mpeg_audio.payload_of(media, s) == payload and s.crc_bad == s.skipped == 0
        assert s.table_frames == len(s.offsets) == len(payload) // 576 and s.tags["TIT2"] == "title"
        assert s.duration == len(s.offsets) * mpeg_audio.Fraction(1152, 48000)
        hurt = mpeg_audio.parse(b"noise\xff\xfb" + media + b"TAG" + b"x" * 125)
        assert len(hurt.offsets) == len(s.offsets) and hurt.skipped == 7
    broken = bytearray(media)
    broken[s.offsets[0] + 10] ^= 1
    assert mpeg_audio.parse(bytes(broken)).crc_bad == 1
    assert mpeg_audio.parse(b"").offsets == [] and mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_mpeg_headers():
    h = mpeg_audio.read_header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.version, h.layer, h.kbits, h.hz, h.size, h.samples, h.protected) == (1, 3, 128, 44100, 417, 1152, False)
    assert mpeg_audio.read_header(bytes([0xFF, 0xF3, 0x80, 0xC0])).samples == 576
    assert mpeg_audio.read_header(b"\xff\xff\xff\xff") is None and mpeg_audio.read_header(b"\xff") is None


def test_mpeg_layers_one_and_two_checksums():
    """A protected frame is read as one whatever its layer; a changed allocation bit breaks its checksum, a changed sample does not."""
    for second, size, body in ((0xFE, None, bytes([0x44] * 16)), (0xFC, None, bytes([0x44] * 30))):
        head = bytes([0xFF, second, 0x90, 0xC0])
        h = mpeg_audio.read_header(head)
        frame = bytearray(head + b"\0\0" + body + bytes(h.size - 6 - len(body)))
        key, bits = mpeg_audio.checked(bytes(frame), 0, h)
        assert (len(key), bits) == ((18, 0) if h.layer == 1 else (len(key), bits)) and len(key) > 12
        frame[4:6] = mpeg_audio.crc16(key, bits).to_bytes(2)
        s = mpeg_audio.parse(bytes(frame) * 3)
        assert (len(s.offsets), s.crc_checked, s.crc_bad) == (3, 3, 0)
        frame[7] ^= 1
        assert mpeg_audio.parse(bytes(frame) * 3).crc_bad == 3
        frame[7] ^= 1
        frame[-1] ^= 1
        assert mpeg_audio.parse(bytes(frame) * 3).crc_bad == 0
    one, two = (mpeg_audio.crc16(b"123456789\xff", b) for b in (0, 8))
    assert one == two


def test_mpeg_free_bitrate_and_encoder_delay():
    free = bytes([0xFF, 0xFB, 0x00, 0xC0]) + bytes(296)
    s = mpeg_audio.parse(free * 4)
    assert s.offsets == [0, 300, 600, 900] and s.sizes == [300] * 4 and s.duration == mpeg_audio.Fraction(4 * 1152, 44100)
    head = mpeg_audio.read_header(bytes([0xFF, 0xFB, 0x90, 0xC0]))
    info = bytes([0xFF, 0xFB, 0x90, 0xC0]) + bytes(17) + b"Info" + (0).to_bytes(4) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3)
    s = mpeg_audio.parse(info + bytes(head.size - len(info)) + (bytes([0xFF, 0xFB, 0x90, 0xC0]) + bytes(head.size - 4)) * 5)
    assert (s.delay, s.padding, len(s.offsets)) == (576, 1000, 5) and s.duration == mpeg_audio.Fraction(5 * 1152 - 1576, 44100)


def test_mpeg_odd_inputs(spark):
    docs = odd_docs(spark, media="mine")
    rows = mpeg_audio.digests(mpeg_audio.store(docs.drop("media"))).collect()
    assert len(rows) == len(ODD) + 2 and all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in rows)
    assert mpeg_audio.probe(mpeg_audio.store(docs)).where("seconds_num <= 0").count() == 0
    assert mpeg_audio.store(empty_docs(spark)).count() == 0


def brute_overlaps(doc, item, least=10, identity=0.8, penalty=2.0):
    """Whether some diagonal holds a best-scoring stretch that is long and alike enough."""
    d, t = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", x.lower()) for x in (doc or "", item or ""))
    for shift in range(-len(t) + 1, len(d)):
        low, high = max(0, shift), min(len(d), len(t) + shift)
        start, total, best, at = low, 0.0, 0.0, None
        for i in range(low, high):
            if total <= 0:
                start, total = i, 0.0
            total += 1 if d[i] == t[i - shift] else -penalty
            if total > best:
                best, at = total, (start, i + 1)
        if at and at[1] - at[0] >= min(least, len(t)) and sum(d[i] == t[i - shift] for i in range(*at)) >= identity * (at[1] - at[0]):
            return True
    return False


def test_decontamination(spark):
    r = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    noise = lambda n: [r.choice(WORDS) for _ in range(n)]
    changed = [w if i % 7 else "other" for i, w in enumerate(item)]
    docs = [(0, " ".join(noise(50) + item + noise(50))), (1, " ".join(noise(30) + changed)), (2, " ".join(noise(200))), (3, " ".join(item[:6] + noise(40))), (4, ", ".join(w.upper() for w in item)), (5, None), (6, ""), (7, " ".join(noise(50_000) + item)), (7, "another text of that id"), (None, " ".join(item)), (None, "a clean one"), (8, "so very short an item"), (0, " ".join(item + noise(9) + item))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([("i9", " ".join(item)), ("i8", None), ("i7", "very, SHORT"), (None, "q1 q2 q3 q4 q5 q6 q7 q8"), ("i9", " ".join(item))], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(df, items).collect()}
    whole = {0, 4, 7, None}
    assert set(got) == {(d, "i9") for d in {1, *whole}} | {(8, "i7")} | {(d, None) for d in whole}
    assert got[0, "i9"].longest == 30 and got[0, "i9"].n_overlaps == 3 and got[0, "i9"].doc_start == 0 and got[1, "i9"].equal < got[1, "i9"].longest
    assert sorted((r.doc_id or -1, r.text[:9] if r.text else r.text) for r in decontaminate.clean(df, items).collect() if r.text) == [(-1, "a clean o"), (2, docs[2][1][:9]), (3, docs[3][1][:9]), (7, "another t")]
    assert decontaminate.clean(df, items).where("text is null or text = ''").count() == 2
    assert decontaminate.overlaps(df, items.limit(0)).count() == decontaminate.overlaps(df.limit(0), items).count() == 0
    assert decontaminate.clean(odd_docs(spark, hash=1, mark=2, key=3), items).columns == odd_docs(spark, hash=1, mark=2, key=3).columns


def test_decontamination_recall_and_precision(spark):
    """Against brute force over all pairs: passages of 10 to 40 tokens at identities from 0.75 to 1."""
    r = random.Random(12)
    items = [(i, " ".join(f"t{i}x{k}" for k in range(r.randrange(10, 41)))) for i in range(12)]
    docs = []
    for i in range(240):
        w = items[i % 12][1].split()
        for k in r.sample(range(len(w)), r.randrange(0, len(w) // 4 + 1)):
            w[k] = f"s{i}x{k}"
        docs.append((i, " ".join(r.choices(WORDS, k=20) + w + r.choices(WORDS, k=20))))
    rows = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(x.doc_id, x.item_id) for x in rows}
    want = {(d, i) for d, text in docs for i, item in items if d % 12 == i and brute_overlaps(text, item)}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 150
    assert all(x.doc_id % 12 == x.item_id and x.longest >= 10 and x.equal >= 0.8 * x.longest for x in rows)


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum((x := int(c) * (2 if i % 2 else 1)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (kind, p) in enumerate(RULES.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii_rules_are_the_plain_patterns(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("a1.@+- (4)é😀") for _ in range(40)) for _ in range(400)] + [None, "", "a@b.com_x@c.de.f 😀 x@y.zz", "1.2.3.4.5.6.7.8 0001.2.3.4 999.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1111 5", "+1 (234) 567-8901 +1 23"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in pii.find(df, None).select("doc_id", pii.joined(F.col("base")).alias("s")).collect():
        assert row.s == brute_spans(texts[row.doc_id]), texts[row.doc_id]


def test_pii_long_uniform_texts_end(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["1 " * 100_000, "1" * 200_000, "a" * 200_000, "a@" + "b" * 200_000, "+1" * 50_000])], "doc_id int, text string")
    assert all(r.n == 0 for r in pii.find(df, None).select(F.size("base").alias("n")).collect())


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(spark)


def test_pii_redact_and_odd_inputs(spark, trees):
    df = spark.createDataFrame([(1, "mail a@b.org, call +1 (234) 567-8901."), (2, None), (3, "nothing")], "doc_id int, text string").withColumns({"spans": F.lit(1), "base": F.lit(2), "own": F.lit(3)})
    for t in (None, trees):
        got = pii.redact(df, t).orderBy("doc_id").collect()
        assert [r.text for r in got] == ["mail [EMAIL], call [PHONE].", None, "nothing"] and all((r.spans, r.base, r.own) == (1, 2, 3) for r in got)
    docs = odd_docs(spark, base="x", spans="y")
    assert pii.find(docs, trees).count() == len(ODD) + 2 and pii.find(empty_docs(spark), trees).count() == pii.redact(empty_docs(spark), trees).count() == 0


def test_pii_many_matches_in_one_text(spark, trees):
    df = spark.createDataFrame([(1, "mail a@b.org, " * 5000 + 'token = "0123456789abcdef0123456789abcdef01234567"')], "doc_id int, text string")
    got = pii.find(df, trees).first()
    assert len(got.base) == 5000 and got.base[4999].start == 4999 * 14 + 5 and [s.kind for s in got.spans if s["rank"] > 3] == ["secret"]


def test_pii_trees_are_the_same_each_time_and_for_every_table(spark, trees):
    again = pii.fit(spark)
    assert again.trees == trees.trees and again.thresholds == trees.thresholds and set(trees.thresholds) == set(pii.GENERATORS)


def test_pii_trees_add_secrets_and_contacts_and_leave_plain_text(spark, trees):
    r = random.Random(8)
    word = lambda n, of="bcdfghklmnpqrstvwxz": "".join(r.choice(of) for _ in range(n))
    plain = lambda n: "".join(r.choice(("bcdfgklmnprst", "aeiou")[i % 2]) for i in range(n))
    hexes = [f"{r.getrandbits(160):040x}" for _ in range(40)]
    keys = ["AKIA" + word(16, "ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(40)]
    contacts = [f"{plain(5)} {at} {plain(6)} {dot} org" for at, dot in (("(at)", "(dot)"), ("[at]", "[dot]")) for _ in range(20)]
    rows = (
        [(i, f'note token = "{h}" end') for i, h in enumerate(hexes)] + [(100 + i, f"mail: {c}, thanks") for i, c in enumerate(contacts)] + [(200 + i, f'token = "{word(r.randrange(24, 31))}" end') for i in range(40)]
        + [(300 + i, f"use {k} for it") for i, k in enumerate(keys)] + [(400 + i, f"the {plain(17)} was {plain(4)} at {plain(5)}. Item {r.randrange(10**7, 10**8)} of {plain(6)}_{plain(7)}_{plain(5)}, 2021-03-{10 + i % 20}") for i in range(200)]
    )
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {row.doc_id: row.text for row in pii.redact(df, trees).collect()}
    assert all(got[i] == 'note token = "[SECRET]" end' for i in range(40))
    assert sum(got[100 + i] == "mail: [CONTACT], thanks" for i in range(40)) > 36
    assert sum(got[200 + i] == 'token = "[SECRET]" end' for i in range(40)) > 36
    assert sum(got[300 + i] == "use [SECRET] for it" for i in range(40)) > 36
    assert sum(got[i] != text for i, text in rows if i >= 400) <= 6


def brute_added(text, trees):
    """The generators' spans that the trees select, in Python."""
    import regex

    base = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(text).split(",") if s]
    out = []
    for rank, (kind, (_, pattern)) in enumerate(pii.GENERATORS.items(), 4):
        for m in regex.finditer(pattern, text):
            a, b, t = m.start(), m.end(), m.group()
            if any(x <= a and y >= b for x, y in base):
                continue
            before, after = text[max(0, a - 24) : a], text[b : b + 1]
            only = lambda p: len(regex.sub(p, "", t))
            f = [
                len(t), only("[^0-9]"), only("[^A-Za-z]"), only("[^A-Z]"), only(r"[^ ()./\-]"), len(regex.split(r"[ ()./\-]+", t)), len(set(t)) / len(t), bool(regex.search("^[0-9a-f]+$", t)), "@" in t, t[0] == "+",
                bool(regex.search(pii._NAMED, before.lower())), bool(regex.search(r"[=:]\W*$", before)), before[-1:] in tuple("\"'`"), after in tuple("\"'`"), before[-1:].isalpha(), after.isalpha(), only(r"[^.]"),
            ]
            walk = lambda n: n["value"] if "value" in n else walk(n["low"] if f[n["feature"]] <= n["at"] else n["high"])
            if 1 / (1 + np.exp(-2 * sum(w * walk(n) for w, n in trees.trees))) >= trees.thresholds.get(kind, 2):
                out.append((a, rank, b, kind))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pii_query_against_brute_force(spark, trees):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in queries.op9_pii(spark, SF).collect():
        base = [(int(a), list(pii.RULES).index(k), int(b), k) for k, a, b in (s.split(":") for s in brute_spans(texts[row.doc_id]).split(",") if s)]
        added = brute_added(texts[row.doc_id], trees)
        assert row.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + added)) and row.n_spans == len(base + added), row.doc_id
    said = pii.find(pii.planted(spark, 400), trees).collect()
    assert all(sorted((s.start, s["rank"], s.end, s.kind) for s in r.spans if s["rank"] > 3) == sorted(brute_added(r.text, trees)) for r in said) and sum(len(r.spans) for r in said) > 150


def labelled(spark, kind):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [r.choice(WORDS) for _ in range(r.randrange(5, 60))]
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["vilea", "vileb", "vilec"]))
        text = " ".join(w) if kind == "toxic" or not bad else " ".join(x + "###" for x in w)
        rows.append((i, text, "en", f"src{i % 7}", len(text)))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "toxic")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) > 0.97 * len(got)
    odd = toxicity.score(odd_docs(spark, score=1.0), model).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty_docs(spark), model).count() == 0
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs.limit(5), one).collect()} == {0.0}
    assert toxicity.fit(docs, labels.limit(0)).constant == 0.0


def test_quality_held_out(spark):
    docs, labels = labelled(spark, "quality")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0 and doc_id % 2 = 0"))
    got = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) > 0.97 * len(got) and (model.both[:-1] >= 0).all()
    odd = odd_docs(spark, score=1.0, __raw="mine", text_in="mine", y=3, key=4)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(r["__raw"] == r.text_in == "mine" for r in rows)
    assert quality.score(empty_docs(spark), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).constant == 0.5


def two_views(spark, hint):
    """Half of the bad documents show it in the text, half by source and length only (if hint); labels are few."""
    r = random.Random(16)
    rows, labels = [], []
    for i in range(1600):
        bad = r.random() < 0.3
        w = [r.choice(WORDS) for _ in range(r.randrange(20, 40))]
        seen = bad and (not hint or r.random() < 0.5)
        rows.append((i, " ".join(x.replace("w", "#") for x in w) if seen else " ".join(w), "en", f"src{r.randrange(2) + 2 * (bad and hint)}", 150))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("hint", [True, False])
def test_quality_views_together(spark, hint):
    docs, labels = two_views(spark, hint)
    model = quality.fit(docs, labels.where("doc_id < 300"), given=100)
    got = quality.score(docs, model).join(labels, "doc_id").where("doc_id >= 300").collect()
    right = lambda c: sum((r[c] >= 0.5) == (r.quality == 1) for r in got) / len(got)
    assert (model.both[:-1] >= 0).all() and right("score") >= right("text_score")
    assert right("score") > 0.97 and (right("text_score") < 0.9 if hint else right("meta_score") < 0.8)
    assert model.gives[1] == hint


def test_quality_rounds_against_brute_force(spark):
    """The same rounds over plain lists: who is sure of what, who is given to whom."""
    docs, labels = two_views(spark, True)
    model = quality.fit(docs, labels.where("doc_id < 300"), rounds=2, given=40)
    rank = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit("quality"), F.col("doc_id")).alias("h")).collect()}
    apart = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit("apart"), F.col("doc_id")), F.lit(4)) == 0).collect()}
    y = {r.doc_id: float(r.quality) for r in labels.collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    key = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}

    def views(ids):
        ids = sorted(ids, key=key.get)
        each = [rows[i] for i in ids]
        f = np.concatenate([quality.text_view([r.text.encode() for r in each]), quality.meta_view([r.lang for r in each], [r.source for r in each], [r.n_chars for r in each], [len(r.text) for r in each])], 1).astype(np.float32).astype(float)
        return ids, (f[:, : quality.WIDTH], f[:, quality.WIDTH :])

    ids, xs = views([i for i in range(300) if i not in apart])
    train = [(x, np.array([y[i] for i in ids])) for x in xs]
    share = train[0][1].mean()
    kept, away = views([i for i in range(300) if i in apart])
    t = np.array([y[i] for i in kept])
    mine, used = quality.fitted(train, away, t, share), set()
    for _ in range(2):
        free, xs = views([i for i in rows if i >= 300 and i not in used])
        sure = mine.sure(xs)
        for v in (0, 1):
            if not mine.gives[v]:
                continue
            chosen = []
            for c, n in ((1, round(40 * share)), (0, round(40 * (1 - share)))):
                chosen += [(i, c) for i in sorted((i for i, s in zip(free, sure[v]) if s == c), key=rank.get)[:n]]
            told = dict(chosen)
            new, x = views(told)
            train[1 - v] = np.concatenate([train[1 - v][0], x[1 - v]]), np.concatenate([train[1 - v][1], [told[i] for i in new]])
            used |= set(told)
        mine = quality.fitted(train, away, t, share)
    assert np.allclose(model.both, mine.both, atol=1e-4) and all(np.allclose(a, b, atol=1e-4) for a, b in zip(model.views, mine.views))


def brute_evidence(texts, counted, labels):
    """Mean log-likelihood ratio and that of the strongest word, by interpolated Kneser-Ney in plain dictionaries."""
    from collections import Counter, defaultdict

    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = {c: set() for c in (0, 1)}
    for d in counted:
        w = ["", *split(texts[d])]
        runs[labels[d]] |= {(w[i - 1], w[i], w[i + 1]) for i in range(1, len(w) - 1)}
    pair = {c: Counter((b, w) for _, b, w in runs[c]) for c in (0, 1)}
    word = {c: Counter(w for _, w in pair[c]) for c in (0, 1)}
    vocabulary = set(word[0]) | set(word[1])
    types = len(vocabulary | {b for c in (0, 1) for b, _ in pair[c]})

    def spare(counts):
        one, two = sum(v == 1 for v in counts), sum(v == 2 for v in counts)
        return min(max(one / (one + 2 * two), 0.01), 0.99) if one + two else 0.5

    classes = {w: (w in word[0]) + (w in word[1]) for w in vocabulary}
    d0, every = spare(classes.values()), sum(classes.values())
    shared = lambda w: max(classes.get(w, 0) - d0, 0) / every + d0 * len(vocabulary) / every / (types + 1)
    out = {}
    spares = {c: (spare(pair[c].values()), spare(word[c].values())) for c in (0, 1)}
    ahead = {c: defaultdict(lambda: [0, 0]) for c in (0, 1)}
    for c in (0, 1):
        for (b, _), n in pair[c].items():
            ahead[c][b][0] += n
            ahead[c][b][1] += 1

    def chance(c, w):
        size = sum(word[c].values())
        return max(word[c][w] - spares[c][1], 0) / size + spares[c][1] * len(word[c]) / size * shared(w)

    def joint(c, b, w):
        n, kinds = ahead[c][b] if b in ahead[c] else (0, 0)
        return (max(pair[c][b, w] - spares[c][0], 0) / n + spares[c][0] * kinds / n * chance(c, w)) if n else chance(c, w)

    for d, t in texts.items():
        s = split(t)
        alone = [np.log(chance(1, w) / chance(0, w)) for w in s]
        ratio = [np.log(joint(1, s[i - 1], s[i]) / joint(0, s[i - 1], s[i])) if i else alone[0] for i in range(len(s))]
        out[d] = (np.mean(ratio), max(alone)) if s else (0.0, 0.0)
    return out


def test_toxicity_query_against_brute_force(spark, tmp_path):
    """Scores of the query are the curve over brute-force evidence."""
    docs, labels = labelled(spark, "toxic")
    docs = docs.where("doc_id < 260").unionByName(spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "vilea " * 20_000, "en", "s", 9)], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("doc_id < 260").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    mine = {r.doc_id: r.toxic for r in labels.where("doc_id < 260").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    side = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit("side"), F.col("doc_id")), F.lit(4)) == 0).collect()}
    evidence = brute_evidence(texts, [d for d in mine if d not in side], mine)
    rows = [d for d in sorted(mine) if d in side]
    curve = toxicity._logistic(np.array([[1.0, *evidence[d]] for d in rows]), np.array([float(mine[d]) for d in rows]))
    for d, r in got.items():
        want = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * evidence[d][0] + curve[2] * evidence[d][1], -50, 50)))
        assert r.score == pytest.approx(want, abs=2e-3) and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    assert len(got) == len(texts) and got[902].predicted == 1 and got[900].score == got[901].score


def brute_pairs(docs, items):
    """(doc, item) pairs with an overlap, by looking at every diagonal that holds enough equal tokens."""
    from collections import Counter, defaultdict

    out = set()
    cut = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    for i, item in items.items():
        t, where = cut(item), defaultdict(list)
        for k, w in enumerate(t):
            where[w].append(k)
        for d, text in docs.items():
            s = cut(text)
            shifts = Counter(k - j for k, w in enumerate(s) for j in where.get(w, ()))
            for shift, n in shifts.items():
                if n < 0.8 * min(10, len(t)):
                    continue
                low, high = max(0, shift), min(len(s), len(t) + shift)
                equal = np.array([s[k] == t[k - shift] for k in range(low, high)])
                score, start, best, at = 0.0, 0, 0.0, (0, 0)
                for k, e in enumerate(equal):
                    if score <= 0:
                        score, start = 0.0, k
                    score += 1 if e else -2.0
                    if score > best:
                        best, at = score, (start, k + 1)
                if at[1] - at[0] >= min(10, len(t)) and equal[slice(*at)].sum() >= 0.8 * (at[1] - at[0]):
                    out.add((d, i))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_decontamination_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, SF).collect()}
    want = brute_pairs(docs, items)
    assert got <= want and len(got) >= 0.9 * len(want) and want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_audio_query_against_plain_bytes(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    for r in queries.op6_mpeg_audio(spark, SF).collect():
        raw = texts[r.doc_id]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        n = len(payload) // 576
        media = mpeg_audio.write(payload, f"{len(raw)} bytes")
        # Frames are found without the parser: each holds its part of the payload after 4 + 2 + 17 bytes, one after the other.
        at, offsets = 0, []
        for k in range(n):
            at = media.index(payload[576 * k : 576 * k + 576], at)
            offsets.append(at - 23)
            at += 576
        steps = [b - a for a, b in zip(offsets, [*offsets[1:], len(media)], strict=True)]
        assert r.frame_offsets == offsets and len(set(steps)) <= 2 and mpeg_audio.Fraction(r.seconds_num, r.seconds_den) == mpeg_audio.Fraction(n * 1152, 48000)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and f"frames={n};" in r.feature and f"crc={n + 1}/{n + 1};skipped=0" in r.feature


def clashing(spark):
    """Ties, repeated rows, a very long text, nulls, and columns named like those that the operators use inside."""
    rows = [(1, "same words here", "en", "s", 15)] * 3 + [(2, "same words here", None, None, None), (2, None, "en", "s", 0), (None, "", "en", "s", 0), (3, "word " * 200_000, "en", "s", 10**6), (4, "x" * 300_000, "en", "s", 3), (5, "a@b.org", "en", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(f"my {c}") for c in ("__raw", "raw", "mark", "key", "node", "of", "hash", "text_in", "own", "spans_", "item", "k", "v", "blocks")})


OPERATORS = {
    "toxicity": lambda s, df: toxicity.score(df, toxicity.fit(df, s.createDataFrame([(1, 1), (3, 0), (2, 0), (5, 1)], "doc_id bigint, toxic int"))),
    "jaccard": lambda s, df: jaccard_join.components(df),
    "bpe": lambda s, df: bpe.encode(df, queries.tokenizer_path("word_bpe_49k.json")),
    "counts": lambda s, df: token_counts.count_tokens(df, queries.tokenizer_path("word_bpe_49k.json")),
    "audio": lambda s, df: mpeg_audio.digests(mpeg_audio.store(df)),
    "clean": lambda s, df: decontaminate.clean(df, s.createDataFrame([(1, "nothing of this is said anywhere at all in it")], "item_id bigint, text string")),
    "quality": lambda s, df: quality.score(df, quality.fit(df, s.createDataFrame([(1, 1), (3, 0), (2, 0), (5, 1)], "doc_id bigint, quality int"))),
    "pii": lambda s, df: pii.find(df, pii.Trees([(1.0, {"value": 1.0})], {"secret": 0.9})),
    "redact": lambda s, df: pii.redact(df, None),
    "lm": lambda s, df: lm_scores.score(df, F.col("doc_id") < 4, F.col("doc_id") == 1),
    "chat": lambda s, df: chat.format_conversations(df.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(0), "role": F.lit("user")})),
    "overlaps": lambda s, df: decontaminate.overlaps(df, s.createDataFrame([(1, "same words here")], "item_id bigint, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ties_repeats_long_texts_and_clashing_names(spark, name):
    df = clashing(spark)
    rows = OPERATORS[name](spark, df).collect()
    if name == "chat":
        assert sorted(r.formatted.count("<|turn|>") for r in rows) == [1, 1, 1, 1, 2, 3]
    elif name == "overlaps":
        assert sorted((r.doc_id, r.n_overlaps) for r in rows) == [(1, 1), (2, 1)]
    else:
        assert len(rows) == df.count()
        if name != "lm":
            dropped = {"text"} if name in ("jaccard", "audio") else set()
            for c in set(df.columns) - dropped - {"doc_id", "text", "lang", "source", "n_chars"}:
                assert all(r[c] == f"my {c}" for r in rows), c
        same = {tuple(str(v) for v in r) for r in rows if r.doc_id == 1}
        assert len(same) == 1  # copies of a row are alike


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_give_a_row_for_each_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.queries().items():
        rows = query(spark, SF).count()
        assert rows == n or name in ("op2_chat_format", "op7_decontamination", "op12_whitening", "op13_topk"), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_against_brute_force(spark, trees, codec):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    again = docs.union(docs.limit(5))
    run = dict(corpus_pipeline.STAGES)
    # Near copies: the smallest id of each component, repeated rows once.
    kept = [r.doc_id for r in run["ngram_jaccard_join"](spark, again, SF).collect()]
    assert sorted(kept) == sorted({low for _, low in brute_components(list(texts.items()), 5, 80, 100).values()})
    # Toxicity: what the operator's scores reject goes, and only that.
    scores = {r.doc_id: r.score for r in queries.op1_toxicity(spark, SF).collect()}
    assert sorted(r.doc_id for r in run["toxicity"](spark, again, SF).collect()) == sorted([d for d in texts if scores[d] < 0.5] + [r.doc_id for r in docs.limit(5).collect() if scores[r.doc_id] < 0.5]) or len(texts) == 0
    # Decontamination: no document that brute force clears may go.
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    bad = {d for d, _ in brute_pairs(texts, items)}
    left = {r.doc_id for r in run["decontamination"](spark, docs, SF).collect()}
    assert set(texts) - bad <= left and len(bad & left) <= 0.1 * len(bad)
    # Personal data: brute-force spans cut out of the texts.
    for r in run["pii"](spark, docs, SF).collect():
        spans = sorted([(int(a), list(pii.RULES).index(k), int(b), k) for k, a, b in (s.split(":") for s in brute_spans(texts[r.doc_id]).split(",") if s)] + brute_added(texts[r.doc_id] or "", trees))
        out, at = "", 0
        for a, _, b, kind in spans:
            if a >= at:
                out += (texts[r.doc_id])[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        want = texts[r.doc_id] and out + texts[r.doc_id][at:]
        assert r.text == want and r.n_chars == len(want)
    # Tokens: those of the library.
    for r in run["bpe"](spark, docs, SF).collect():
        assert r.ids == codec[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing(spark), SF).columns == clashing(spark).columns
        assert stage(spark, empty_docs(spark), SF).count() == 0 and stage(spark, odd_docs(spark), SF).count() <= len(ODD) + 2
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < docs.count()


def test_fold_is_crc32(spark):
    from veilmark.llm.common import fold

    got = {r.doc_id: r.f for r in spark.range(50).select(F.col("id").alias("doc_id"), fold("id", 7).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in range(50)}
