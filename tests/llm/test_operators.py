"""Each operator against a plain version, on the smallest tables and on hand-made edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statloom.llm import bpe_automaton, common, links, maxent, mixing, near_dups, pii, png_media, tables, token_counts, token_files, topk, toxicity, words
from statloom.llm.queries import QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "a  b", " a\tb\r\n", "x<|endoftext|> y", "'s it's I'LL", "日本 語　x 123", "a ́b", "\x1c \x85", "İstanbul É", "a" * 5000, "ab " * 3000, "==--==__" * 50, "𝔘nicode 🎉🎉"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"


@pytest.fixture(scope="module")
def docs(spark, small):
    common.prepare(spark)
    return {r.doc_id: r.text for r in common.table(spark, small, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    common.prepare(spark)
    rows = [(i, t, "en", f"s{i % 2}", len(t), 0.5, "x") for i, t in enumerate(ODD)]
    rows += [(50, None, None, None, None, None, None), (51, "one two three four five six", None, None, 1, None, None), (51, "one two three four five six", None, None, 1, None, None), (None, "lost id here", "en", "s0", 3, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_counts_and_automaton_match_the_library(docs):
    texts = [*docs.values(), *ODD]
    t = Tokenizer.from_file(BYTE)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_batch(texts, BYTE) == [len(x) for x in want]
    a = bpe_automaton.automaton(BYTE)
    got = bpe_automaton.encode_batch(texts, a)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert bpe_automaton.decode_batch(got, a) == [t.decode(x, skip_special_tokens=False) for x in want]


def test_counting_and_encoding_queries_match_the_library(spark, small, docs):
    t = Tokenizer.from_file(BYTE)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in docs.items()}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op5_token_counts"](spark, small).collect()}
    assert counts == {d: (len((x or "").encode()), len(ids[d]), len(ids[d]) > 512) for d, x in docs.items()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe_automaton"](spark, small).collect()}
    assert got == {d: (len(i), digest(np.array(i, "<u4").tobytes()), digest(t.decode(i, skip_special_tokens=False).encode())) for d, i in ids.items()}


def test_groups_of_pieces_are_of_like_bytes():
    pieces = ["é" * 40, "a" * 10, "漢" * 30] * 20
    groups = list(token_counts._by_bytes(pieces, 500))
    assert sorted(p for g in groups for p in g) == sorted(pieces) and all(sum(len(p.encode()) for p in g) < 500 + 120 for g in groups)


def test_automaton_is_built_by_gadgets():
    """A small vocabulary: the automaton accepts a sequence of tokens if, and only if, merging its text gives it."""
    symbols = bpe_automaton.byte_symbols()
    vocab = {c: i for i, c in enumerate(symbols)}
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("ab", "ab"), ("aa", "b"), ("b", "b")]
    for u, v in merges:
        vocab[u + v] = len(vocab)
    m = bpe_automaton.Automaton(vocab, merges, {})

    def merged(text):
        parts = list(text)
        while True:
            found = [(merges.index((u, v)), i) for i, (u, v) in enumerate(zip(parts, parts[1:], strict=False)) if (u, v) in merges]
            if not found:
                return parts
            rank = min(found)[0]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == merges[rank]:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    table = tables.Table(10, np.int8)
    for n in range(1, 8):
        for bits in range(2**n):
            text = "".join("ab"[bits >> i & 1] for i in range(n))
            assert np.frombuffer(m.encode_words([text.encode()], table)[0], "<u4").tolist() == [vocab[t] for t in merged(text)]
    tokens = [t for t in ("a", "b", *(u + v for u, v in merges)) if m.state_of[vocab[t]] >= 0]
    pairs = [(s, t) for s in tokens for t in tokens]
    arcs = m.arcs(m.state_of[[vocab[s] for s, _ in pairs]], np.array([vocab[t] for _, t in pairs]))
    assert arcs.tolist() == [merged(s + t) == [s, t] for s, t in pairs]


def test_table_of_numbers():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    t = tables.Table.of(keys, np.arange(len(keys)))
    assert (t.get(keys) == np.arange(len(keys))).all() and (t.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    small_ = tables.Table(4)
    for i in range(20):
        small_.put(np.array([i * 7]), np.array([i]))
        assert small_.get(np.array([i * 7]))[0] == i


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(1)
    texts = ["", None, " ", "a", "A b", "b\x0ba", "a  b\t", "x" * 600_000 + " y"] + ["".join(rng.choice(list("abAB \n\té\x85"), rng.integers(0, 30))) for _ in range(2000)]
    h, tails, counts = words.word_hashes(pa.array(texts, pa.string()))
    plain = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().lower().split()) for t in texts]
    assert len(set(zip(h.tolist(), plain, strict=True))) == len(set(plain)) == len(set(h.tolist()))
    assert tails.tolist() == [w[-1] | (w[-2] << 8 if len(w) > 1 else 0) for w in plain]


def test_automaton_on_random_words():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aaabehinorst=-_0"), rng.integers(0, 25))) for _ in range(2000)]
    t = Tokenizer.from_file(BYTE)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe_automaton.encode_batch(words, bpe_automaton.automaton(BYTE))] == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


def test_token_files_round_trip(spark, small, docs):
    rows = {r.doc_id: r for r in QUERIES["op2_token_files"](spark, small).collect()}
    start = 0
    for d in sorted(docs):
        ids = [*ids_of(WORD, docs[d]), 2]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_word_encoding_of_odd_texts():
    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(list("aabZé'²٣_ .-*@$!|+(€#017\n\t<>KÀß×"), rng.integers(0, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.encode_batch(made, WORD, None)] == [e.ids for e in Tokenizer.from_file(WORD).encode_batch(made, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.encode_batch(ODD, WORD, None)] == [ids_of(WORD, t) for t in ODD]


def test_images_round_trip_and_reject_damage(docs):
    for text in [*list(docs.values())[:50], *ODD]:
        payload = png_media.payload_of(text)
        data = png_media.write_png(payload)
        assert png_media.read_png(data).tobytes() == payload
    for bad in (data[:-5], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"x" + data):
        with pytest.raises(ValueError):
            png_media.read_png(bad)


def test_all_row_filters():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (5, 16)).astype(int)
    filtered = np.zeros_like(image)
    for y in range(5):
        for x in range(16):
            a, b, c = (image[y, x - 1] if x else 0), (image[y - 1, x] if y else 0), (image[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            filtered[y, x] = (image[y, x] - (0, a, b, (a + b) // 2, paeth)[y]) % 256
    assert (png_media.unfilter([(np.arange(5), filtered.astype(np.uint8))])[0] == image).all()
    kinds, out = png_media.filtered(np.vstack([np.tile(np.arange(16, dtype=np.uint8) * 3, (4, 1)), image.astype(np.uint8)]), np.array([True] + [False] * 3 + [True] + [False] * 4))
    assert kinds[0] == 1 and (kinds[1:4] == 2).all() and not out[1:4].any()


def test_image_query_matches_plain_versions(spark, small, docs):
    k, n = np.arange(8)[:, None], np.arange(32)[None]
    cosines = np.cos(np.pi * k * (2 * n + 1) / 64) * np.where(k, math.sqrt(2 / 32), math.sqrt(1 / 32))
    for r in QUERIES["op4_png_media"](spark, small).collect():
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
        h = len(image)
        tall = np.stack([image[i * h // 32 : max((i + 1) * h // 32, i * h // 32 + 1)].mean(0) if h >= 32 else image[i * h // 32] for i in range(32)])
        low = cosines @ tall.reshape(32, 32, 2).mean(2) @ cosines.T
        bits = np.round(low.ravel(), 6) > np.median(np.round(low.ravel()[1:], 6))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert sum(a != b for a, b in zip(np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8)).tolist(), bits.tolist(), strict=True)) <= 1  # a value at the median itself
        media = png_media.write_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def plain_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m[0]))


def test_pattern_spans_match_plain_search(docs):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(["@", "a", "b.c", ".", "1", "25", "4111111111111111", "+", "-", " ", "(", "é", "\n"], rng.integers(0, 40))) for _ in range(3000)]
    for t in [*docs.values(), *made]:
        assert [tuple(s) for s in pii.pattern_spans(t)] == plain_spans(t)


def test_field_on_held_out_sentences():
    right = total = lines = 0
    for fold in range(2):  # hand-written lines that the field did not learn from
        field = pii.train(without=fold)
        for i, (line, labels) in enumerate(pii.labelled()):
            if i % 4 == fold:
                got = pii.viterbi(field.scores(field.ids(line))[None], np.array([len(line)]), field.pair)[0]
                same = [pii.LABELS[g] == x for g, x in zip(got, labels, strict=True)]
                right, total, lines = right + sum(same), total + len(same), lines + all(same)
    assert right / total > 0.8 and lines >= 20
    field = pii.train()
    for text, kind, value in [("jo at mail dot org", 0, "jo at mail dot org"), ("write to jo at mail dot org please", 0, "jo at mail dot org"), ("bob(at)mail(dot)com", 0, "bob(at)mail(dot)com")]:
        assert [(x.kind, text[x.start : x.end]) for x in pii.find([text], field)[1][0]] == [(kind, value)]
    assert pii.find(["order 2024 1234 5678 90 shipped"], field)[1] == [[]]
    assert [str(s) for s in pii.find(["call (202) 555-0143 now", "host 10[.]0[.]0[.]7 down"], field)[1][0]] == ["phone:5:19"]


def test_lines_with_valid_values_reach_the_field():
    rng = np.random.default_rng(6)
    parts = ["jo", "mail", "org", "x-1", "at", "AT", "dot", "@", ".", " ", " ", "  ", "[", "]", "(", ")", "{", "}", "<", ">", "[at]", "(dot)", "[.]", " at ", " dot ", " . ", "\t", "7", "10"]
    made = ["".join(rng.choice(parts, rng.integers(3, 9))) for _ in range(100_000)]
    made += [f"{a}{b}{c}" for a in ("jo", "jo.b") for b in ("@", " at ", "[at]", " (at) ", " {AT} ", "< at >") for c in ("mail.org", "mail[.]org", "mail dot org", "mail . org", "mail (dot) org")]
    valid = [v for v in made if "\n" not in v and pii._valid(0, v) or pii._valid(1, v)]
    assert len(valid) > 100 and all(pii.MAY_HOLD.search(f"write to {v}, please") for v in valid)
    assert not any(pii.MAY_HOLD.search(t) for t in ["met at home. Then", "a (see b.c)", "at 10 to 1"])
    field = pii.train()
    for text, value in [("write to jo [at] mail.org today", "jo [at] mail.org"), ("contact ann (at) host.com", "ann (at) host.com"), ("reach jo(at)mail.org or call", "jo(at)mail.org"), ("email me: sam at corp[.]net", "sam at corp[.]net")]:
        assert [text[s.start : s.end] for s in pii.find([text], field)[1][0] if s.kind == 0] == [value]
    assert pii.find(["read more at example.com today"], field)[1] == [[]]


def test_personal_data_query_matches_plain_search(spark, small, docs):
    for r in QUERIES["op6_personal_data"](spark, small).collect():
        base = plain_spans(docs[r.doc_id] or "")
        spelt = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spelt).encode()).hexdigest() and set(spelt) <= set(r.spans.split(",")) | {""}
        assert [r.n_base_email, r.n_base_ip, r.n_base_card, r.n_base_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        every = [x.split(":")[0] for x in r.spans.split(",") if x]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [every.count(k) for k in pii.KINDS]


def test_viterbi_is_exhaustive_search():
    rng = np.random.default_rng(2)
    scores, pair = rng.normal(size=(1, 4, 5)), rng.normal(size=(5, 5))
    value = lambda p: sum(scores[0, t, k] for t, k in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:], strict=False))
    assert tuple(pii.viterbi(scores, np.array([4]), pair)[0]) == max(np.ndindex(5, 5, 5, 5), key=value)


def plain_components(docs):
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posts = defaultdict(list)
    for d, s in sets.items():
        for e, k in Counter(e for g in s for e in posts[g]).items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for g in s:
            posts[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_match_all_pairs(spark, small, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(common.table(spark, small, "documents")).collect()}
    assert got == plain_components(docs)


def test_near_duplicates_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    made = {}
    for i in range(150):
        w = list(base)
        for j in rng.choice(60, rng.integers(0, 4), replace=False):
            w[j] = f"x{rng.integers(1000)}"
        made[i] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    assert got == plain_components(made)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 200)], "a long, b long")
    assert {r.id: r.component for r in links.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 200: 100}


def test_top_k_matches_all_pairs(spark, small):
    v = topk.integer_vectors(common.table(spark, small, "embeddings"))
    rows = v.collect()
    x, ids = np.array([r.v for r in rows]), np.array([r.id for r in rows])
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want |= {(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0")).collect()} == want


def test_top_k_of_odd_vectors(spark):
    rows = [(0, []), (50, []), (1, []), (100, [1.0]), (101, [2.0]), (102, [-1.0]), (150, [1.0, 1.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("id % 50 = 0"), 2).collect()}
    assert got == {(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (100, 1, 101, 2 * 256 * 256), (100, 2, 102, -256 * 256)}


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    x = np.random.default_rng(9).integers(-6, 7, (400, 40))
    v = spark.createDataFrame([(i, list(map(int, r))) for i, r in enumerate(x)], "id long, v array<long>")
    want = {(q, k + 1, int(j), int(x[q] @ x[j])) for q in range(0, 400, 50) for k, j in enumerate([j for j in np.lexsort((np.arange(400), -(x @ x[q]))) if j != q][:5])}
    assert {tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0")).collect()} == want


def test_top_k_leaves_bad_vectors_out(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0]), (5, [float("inf"), 0.0]), (6, [0.0, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [(r.vec_id, r.rank) for r in topk.top_k(v, v.where("id = 0")).orderBy("rank").collect()] == [(4, 1), (6, 2)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_mixing_meets_targets(spark, small, docs):
    rows = QUERIES["op7_mixing"](spark, small).collect()
    # targets by filling up in turn
    of = {r.doc_id: r.source for r in common.table(spark, small, "documents").select("doc_id", "source").collect()}
    sizes = defaultdict(int)
    for d, t in docs.items():
        sizes[of[d]] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight, want, left = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, {}, 1.5 * sum(sizes.values())
    while True:
        rest = [n for n in names if n not in want]
        share = {n: left * weight[n] / sum(weight[m] for m in rest) for n in rest}
        over = [n for n in rest if share[n] > 2 * sizes[n]]
        want |= {n: 2 * sizes[n] for n in over} if over else share
        left -= sum(2 * sizes[n] for n in over)
        if not over:
            break
    for r in rows:
        assert r.source_size == sizes[of[r.doc_id]] and math.isclose(r.target, want[of[r.doc_id]], rel_tol=1e-9) and r.size == len((docs[r.doc_id] or "").encode().split())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op7_mixing"](spark, small).collect()))
    assert all(r.taken <= 2 * r.size for r in rows)
    total, least = defaultdict(int), {}
    for r in rows:
        key = r.source_size, r.target
        total[key] += r.taken
        if r.size and r.taken < 2 * r.size:
            least[key] = min(r.size, least.get(key, r.size))
    for (size, target), taken in total.items():  # what is missing is less than any document that could be taken again
        assert target <= 2 * size + 1e-6 and taken <= target + 1 and target - taken < max(least.get((size, target), 0), 0.002 * target) + 1
    assert math.isclose(sum(t for _, t in total), 1.5 * sum(s for s, _ in total), rel_tol=1e-9)


def test_base_scores_match_plain_counts(spark, small, docs):
    rows = QUERIES["op3_maxent"](spark, small).collect()
    words = {d: [*t.encode().lower().split(), None] for d, t in docs.items()}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_known == sum(c[w] > 0 for w in words[r.doc_id]) and r.train_tokens == n
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_are_a_function_of_the_table(spark, small):
    df = common.table(spark, small, "documents").select("doc_id", "text")
    runs = [{r.doc_id: (r.base_score, r.score) for r in maxent.scores(df.repartition(n), F.col("doc_id") % 7 != 2).collect()} for n in (1, 4, 16)]
    assert all(math.isclose(r[d][i], runs[0][d][i], rel_tol=1e-12) for r in runs[1:] for d in r for i in range(2))


def test_scores_match_a_plain_model(spark, small, docs):
    """A text's score from the trained weights, position by position, with words counted plainly."""
    df = common.table(spark, small, "documents").select("doc_id", "text")
    got = {r.doc_id: r.score for r in maxent.scores(df, F.col("doc_id") % 2 == 0).collect()}
    texts = df.where("doc_id % 2 = 0").select("text")
    counts = maxent.word_counts(texts).cache()
    ends = texts.count()
    model, rest, members = maxent.train(texts, counts, ends)
    c = Counter({r.word: r.c for r in counts.collect()})
    members = {w: int(model.slot(np.array([w]))[0]) for w in members}
    for d in sorted(docs)[:25]:
        p = maxent.positions(pa.array([docs[d]], pa.string()), model.rows)
        total = 0.0
        for i, w in enumerate(p.words.tolist()):
            k = w & 31
            z = sum(model.class_weights[r].astype(float) for r in p.class_rows[:, i])
            total += z[k] - math.log(np.exp(z).sum())
            if k == maxent.END:
                continue
            z = sum(model.member_weights[r].astype(float) for r in p.member_rows[:, i])
            total += z[members.get(w, 0)] - math.log(np.exp(z).sum())
            if w not in members:
                total += math.log((c[w] + 1) / (sum(rest[k]) + 1))
        assert math.isclose(got[d], total / math.log(10), rel_tol=1e-5)


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(3)
    rows, weights = rng.integers(0, 40, (3, 500)).astype(np.int32), rng.normal(size=(40, maxent.CLASSES)).astype(np.float32) * 0.3
    outcome = rng.integers(0, maxent.CLASSES, 500)
    sums, met = np.zeros((40, maxent.CLASSES), np.int32), np.zeros(40, np.int64)
    maxent.add_gradient(weights, rows, outcome, sums, met)
    z = sum(weights[r] for r in rows).astype(float)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    p[np.arange(500), outcome] -= 1
    want = np.zeros((40, maxent.CLASSES))
    for r in rows:
        np.add.at(want, r, p)
    assert np.abs(sums / maxent.UNIT - want).max() < 0.02 and (met == np.bincount(rows.ravel(), minlength=40)).all()


def test_training_texts_are_likelier(spark, small):
    rows = maxent.scores(common.table(spark, small, "documents").select("doc_id", "text"), F.lit(True)).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score < 0 for r in rows)


def test_restoring_beats_disguise(spark):
    common.prepare(spark)
    texts = spark.createDataFrame([("you are an idiot and a moron " * 5 + "the idiot is stupid " * 5,)], "text string")
    model = toxicity.character_model(texts)
    r = toxicity.Restorer(model)
    assert "idiot" in r.text("i  d  i  o  t") and "moron" in r.text("m.o.r.o.n!")
    assert "stupid" in r.text("stuuuupid") and "moron" in r.text("m o r o n") and "idiot" in r.text("an id1ot!")


def test_every_noisy_text_is_decoded():
    rng = np.random.default_rng(11)
    made = ["".join(rng.choice(list("aabZé²٣_ .-*@$!|+(€£#017\n"), rng.integers(1, 14))) for _ in range(60_000)]
    plain = re.compile(
        r"(?<![^\W_])(?:[^\W_]|[@$!])(?:[ .\-_*]{1,3}(?:[^\W_]|[@$!])){2,}(?![^\W_])|[0-9@$!|+(€£]{0,3}[^\W\d_]+(?:[0-9@$!|+€£(*#]{1,2}[^\W\d_]*)+"
        r"|[0-9@$!|€£]{1,2}[^\W\d_]{2,}|[^\W_]*([^\W\d_])\1\1[^\W_]*"
    )
    restorer = toxicity.Restorer(np.log(rng.dirichlet(np.ones(toxicity.K), (toxicity.K, toxicity.K))))
    for t in ["f*** you", "hat3 you", "you a55", "you a$$", "an idio7", "idiot1", "s.h.!.t"]:
        assert restorer.text(t) != t
    for t in made:
        spans = [m.span() for m in plain.finditer(t)]
        assert [m.span() for m in toxicity.NOISY.finditer(t)] == spans and (toxicity.may_be_noisy(t) or not spans)
    assert not any(toxicity.may_be_noisy(t) for t in ["", "a", "no sign here, 12 of (these).", "--- ... 1000"])


def test_lattice_path_is_the_best():
    model = np.log(np.random.default_rng(4).dirichlet(np.ones(toxicity.K), (toxicity.K, toxicity.K)))
    options = toxicity.lattice("a1b5")
    best = max(
        (sum(model[p] for p in zip((0, 0, *s), (0, *s, 0), (*s, 0), strict=False)) - cost, s)
        for s, cost in [(tuple(x for o in path for x in o[0]), sum(o[1] for o in path)) for path in __import__("itertools").product(*options)]
    )[1]
    assert toxicity.restore_stretch("a1b5", model) == "".join(" " if not x else toxicity.LETTERS[x - 1] for x in best).strip()


def test_toxicity_on_held_out_labels(spark, small):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    larger = small.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, larger).collect()}
    y = {r.doc_id: r.toxic for r in common.table(spark, larger, "labels").collect()}
    held = [d for d in y if rows[d].held_out]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and rows[d].predicted == (rows[d].score >= 0.5) for d in rows)
    assert len(held) > 40 and np.mean([rows[d].predicted == y[d] for d in held]) > 0.9 and not any(rows[d].predicted for d in held if not y[d])
    assert len(QUERIES["op1_toxicity"](spark, small).collect()) == docs.count() and labels.count()


@pytest.mark.parametrize("empty", [False, True])
def test_edge_cases(spark, edge, empty):
    df = edge.limit(0) if empty else edge
    n = df.count()
    texts = Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    ids = lambda t, x: len(t.encode(x, add_special_tokens=False).ids)
    each = lambda f: Counter({(d, *f(x)): k for (d, x), k in texts.items()})
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, BYTE).collect()) == each(lambda x: (len(x.encode()), ids(byte, x)))
    assert Counter((r.doc_id, r.decoded) for r in bpe_automaton.bpe_encode(df, BYTE, decoded=True).collect()) == each(lambda x: (byte.decode(byte.encode(x, add_special_tokens=False).ids, skip_special_tokens=False),))
    assert bpe_automaton.bpe_decode(bpe_automaton.bpe_encode(df, BYTE).withColumn("decoded", F.lit(1)), BYTE).where("decoded IS NULL").count() == 0
    images = png_media.image_features(png_media.text_images(df))
    assert Counter((r.doc_id, r.payload_sha256) for r in images.collect()) == each(lambda x: (hashlib.sha256(png_media.payload_of(x)).hexdigest(),))
    bad = png_media.image_features(df.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("media"), F.lit(1).alias("media_bytes")))
    assert bad.where("payload_bytes IS NOT NULL").count() == 0 and bad.columns.count("media_bytes") == 1
    assert Counter((r.doc_id, r.n_email + r.n_ip) for r in pii.personal_data(df).collect()) == each(lambda x: (0,))
    assert Counter((r.doc_id, r.t or "") for r in df.select("doc_id", pii.redacted(F.col("text")).alias("t")).collect()) == texts
    out = common.shared_dir(spark)
    token_files.write_tokens(df, out, WORD)
    read = token_files.checksums(token_files.read_tokens(spark, out)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in read) == each(lambda x: (ids(word, x) + 1,))
    assert [r.start for r in sorted(read, key=lambda r: r.start)] == np.cumsum([0, *[r.n_tokens for r in sorted(read, key=lambda r: r.start)]])[:-1].tolist()
    near = near_dups.near_duplicates(df).collect()
    want = plain_components({d: x for d, x in texts if d is not None})
    assert len(near) == n and all((r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.kept and r.component_id is None for r in near)
    assert Counter((r.doc_id, r.size) for r in mixing.mix(df).collect()) == each(lambda x: (len(x.encode().split()),))
    assert set(mixing.mixed(df).columns) == set(df.columns)
    scored = maxent.scores(df, F.lit(True)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known) for r in scored) == each(lambda x: (len(x.encode().split()) + 1,) * 2) and all(math.isfinite(r.score) for r in scored)
    unseen = maxent.scores(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in unseen)
    scorer = toxicity.train(df, spark.createDataFrame([(0, 1), (1, 0), (None, 1), (50, None)], "doc_id long, toxic int"))
    assert df.select(toxicity.score(F.col("text"), scorer).alias("s")).where("s IS NULL OR s < 0 OR s > 1").count() == 0


def test_near_duplicates_need_whole_numbers(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        near_dups.near_duplicates(spark.createDataFrame([("x", "a b")], "doc_id string, text string")).collect()


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edge_cases(spark, edge, small, empty):
    import corpus_pipeline

    df = edge.limit(0) if empty else edge
    df = df.withColumns({c: F.lit(1) for c in ("gone", "key", "__gone", "__score", "__key", "__n", "row", "copies", "one", "component_id", "found", "h")})
    before = Counter((r.doc_id, r.text) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, small)
        assert out.columns == df.columns
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if name in ("toxicity", "personal_data"):
            assert got == before
        elif name == "near_duplicates":
            # ' a\tb' has the words of 'a  b', which has the smaller id; the row without an id stays as often as it came
            assert set(got) == {x for x in before if x[0] != 4} and all(k == 1 for k in got.values())
        else:
            assert all(k <= 2 * before[x] for x, k in got.items())
    assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() == sum(before.values())


def test_texts_that_share_an_id_stay(spark, small):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " more"), (2, "an unrelated text of several words that stays"), (3, "another one of its own"), (3, "another one of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.remove_near_duplicates(spark, df, small).collect()))
    assert len(got) == 3 and (2, rows[2][1]) in got and (3, rows[3][1]) in got and sum(r[1].startswith("w0") for r in got) == 1


def test_pipeline(spark, small, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "bpe"]
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    toxic = {r.doc_id for r in QUERIES["op1_toxicity"](spark, small).where("predicted = 1").collect()}
    one = {c: min(d for d, (_, e) in plain_components({d: t for d, t in docs.items() if d not in toxic}).items() if e == c) for c in {e for _, e in plain_components({d: t for d, t in docs.items() if d not in toxic}).values()}}
    assert {r.doc_id for r in rows} <= set(one.values())
    t = Tokenizer.from_file(BYTE)
    field = pii.train()
    for r in rows[:60]:
        text, done, parts = docs[r.doc_id], 0, []
        for x in pii.find([text], field)[1][0]:
            if x.start >= done:
                parts += [text[done : x.start], f"<{pii.KINDS[x.kind]}>"]
            done = max(done, x.end)
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode("".join([*parts, text[done:]]), add_special_tokens=False).ids
