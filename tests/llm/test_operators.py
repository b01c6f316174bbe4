"""The ten operators on small tables: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linequarry.llm import byte_bpe, decontamination, fingerprints, graph, language_id, near_duplicates, quality, repeated_passages, token_files, toxicity, url_rules
from linequarry.llm import textkernel as tk
from linequarry.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, node long, row int, key string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, 1, 2, "k") for i, t, lang in rows], SCHEMA)


def corpus(n=60, seed=1, words=90):
    """Documents with exact copies, near copies, shared passages, odd rows."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 7))) for _ in range(800)]
    make = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    shared, texts = make(70), []
    for i in range(n):
        w = make(rnd.randint(1, words))
        if i % 7 == 0:
            w = make(20) + shared + make(20)
        if i % 5 == 0 and texts:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append(" ".join(w) if w else "x")
    rows = [(i * 3, t, "en") for i, t in enumerate(texts)]
    return rows + [(1000, None, None), (1001, "", "en"), (1002, "x  y\n", "fr"), (1003, "de " * 300, "fr"), (1004, " \t", None), (1005, texts[0].upper(), "en"), (None, texts[0], "en")]


def test_fingerprints(spark):
    rows = corpus()
    known = sorted(((i, t or "") for i, t, _ in rows if i is not None), reverse=True) + [(None, rows[-1][1])]
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(known):
        following = known[(k + 1) % len(known)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        fold = lambda s: " ".join(unicodedata.normalize("NFKC", s).casefold().split())
        assert got[i]["near_edited"] == float(fold(t) == fold(edited))
        assert got[i]["near_next"] == float(fold(t) == fold(following))
    same = {}
    for r in fingerprints.classes(table(spark, rows)).collect():
        same.setdefault(r["fingerprint"], set()).add(r["class_id"])
    assert all(len(v) == 1 for v in same.values())
    assert len(same) == len({fold(t or "") for _, t, _ in rows})
    assert fingerprints.edited_pairs(table(spark, [])).collect() == [] == fingerprints.classes(table(spark, [])).collect()


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    """(doc_id, n_shingles, component) of every row; rows with one id are one document with several texts."""
    sets = [(i, shingles(t, k)) for i, t, _ in rows if i is not None]
    least = {i: i for i, _ in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, (a, one) in enumerate(sets):
        for b, two in sets[n + 1 :]:
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rnd = random.Random(5)
    rows = corpus(80)
    base = [f"w{i}" for i in range(60)]
    for i in range(30):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(60)] = f"z{rnd.randrange(1000)}"
        rows.append((2000 + i, " ".join(w), "en"))
    # Repeated rows and ids: one id ties two texts, and what they link to, together.
    rows += [(3000, rows[3][1], "en"), (3000, rows[8][1], "en"), (3001, rows[8][1], "en"), (3001, "", None), (3002, "one text", "en"), (3002, "one text", "en"), (3, rows[1][1], "en")]
    got = near_duplicates.near_duplicates(table(spark, rows), words=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute_components(rows, 4, 80)
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates.near_duplicates(table(spark, [])).collect() == []


def thue_morse(k, a="a", b="b"):
    """A word and its complement: texts whose polynomial hashes modulo 2^64 are equal."""
    one, two = a, b
    for _ in range(k):
        one, two = one + two, two + one
    return one, two


def test_words_with_equal_polynomial_hashes_are_apart(spark):
    x, y = thue_morse(10)
    rows = [(1, f"one two three {x}", None), (2, f"one two three {y}", None), (3, x, None), (4, y, None)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(table(spark, rows), words=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_long_texts_are_taken_in_spans(monkeypatch, limit):
    monkeypatch.setattr(tk, "CHUNK_BYTES", limit)
    monkeypatch.setattr(tk.spans, "__defaults__", (limit,))
    monkeypatch.setattr(tk.row_chunks, "__defaults__", (limit,))
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefg") * rnd.randint(1, 9) for _ in range(n)) for n in (0, 3, 40, 400)] + ["x" * 500 + " y " + "z" * 90, " of the next text", "q" * 150, " \t" * 100 + "a b c d e"]
    column = pa.array(texts)
    sets = [s for _, part in near_duplicates.shingle_sets(column, 4) for s in part]
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in texts]
    seen = {}
    data, offsets = tk.string_buffers(column)
    for lo, hi, k, words in tk.word_chunks(data, offsets, 5):
        for d in range(lo, hi):
            a, z = words.first[d - lo], words.first[d - lo + 1]
            for i in range(a, z - 4):
                assert seen.setdefault((d, k + i - a), words.text(i, i + 5)) is not None
    assert seen == {(d, i): " ".join(w[i : i + 5]).encode() for d, w in enumerate(map(WORD.findall, texts)) for i in range(len(w) - 4)}


def test_odd_sketch_tells_high_similarity():
    rnd = np.random.default_rng(0)
    a = np.unique(rnd.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:900], np.unique(rnd.integers(0, 2**63, 100).astype(np.uint64))])
    bits = lambda x, y: int(np.bitwise_count(near_duplicates.odd_sketch(near_duplicates.minhash(x)) ^ near_duplicates.odd_sketch(near_duplicates.minhash(y))).sum())
    assert bits(a, a) == 0 and bits(a, b) < near_duplicates.most_bits(80) < bits(a, a + np.uint64(1))


@pytest.mark.parametrize("few", [10_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(1, 2), (2, 3), (3, 9), (5, 6), (7, 7), (None, 4), *[(100, k) for k in range(101, 140)], (139, 99)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 9), 1), 5: 5, 6: 5, **dict.fromkeys(range(99, 140), 99)}


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "/fr/x", "block"), (None, "/", "block"), ("", "/", "block"), ("net", "/", "block")]
    rnd = random.Random(2)
    hosts = ["net", "x.net", "example.net", "WWW.Example.NET", "example.com", "my-example.com", "b.org", "a.b.org", "c.a.b.org", "notnet", "net.x"]
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/a', '/de/q', '/fr/', '/fr/xy', '?q=/en/', '#/fr/'])}" for _ in range(300)] + [None, "", "nothing", "http://", "http://example.net/en/x"] + ["http://hot.net/en/1"] * 400
    got = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2])


def test_decontamination(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (12, 20, 40, 5)]
    clean = lambda k: [word() for _ in range(k)]
    swapped = [w if k % 9 else word() for k, w in enumerate(items[2])]
    docs = [(1, " ".join(clean(50) + items[0] + clean(9)), None), (2, " ".join(clean(80)), None), (3, ", ".join(w.upper() for w in swapped), None), (4, None, None), (5, "", None), (6, " ".join(items[1][:8] + clean(30)), None), (7, " ".join(clean(5) + items[1][4:18]), None), (8, " ".join(items[3]), None), (9, " ".join(items[0] + items[1]), None)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(7, None)], "item_id long, text string")
    for rows in (500_000, 20):
        got = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated(table(spark, docs), bench, block_rows=rows).collect()}
        assert got == {1: [0], 3: [2], 7: [1], 8: [3], 9: [0, 1]}
    assert decontamination.contaminated(table(spark, []), bench).collect() == []
    assert decontamination.contaminated(table(spark, docs), bench.limit(0)).collect() == []


def brute_overlaps(doc, item):
    """Does some alignment of the item over the document have enough equal tokens in a stretch?"""
    n = len(item)
    width, need = min(n, 13), n if n < 10 else -(-8 * min(n, 13) // 10)
    for g in range(-n + 1, len(doc)):
        equal = [0 <= j + g < len(doc) and doc[j + g] == item[j] for j in range(n)]
        if any(sum(equal[s : s + width]) >= need for s in range(n - width + 1)):
            return True
    return False


def test_decontamination_finds_all_placements(spark):
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in (4, 5, 9, 10, 11, 12, 13, 20)}
    docs = []
    for n, item in items.items():
        for pair in itertools.combinations(range(n), 2):
            w = [t if k not in pair else f"z{k}" for k, t in enumerate(item)]
            docs.append(w if sum(pair) % 2 else ["a", "b", *w, "c"])
        for cut in range(4):
            docs += [item[cut:], item[: n - cut], ["q", *item[:5], "q", *item[5:]]]
    docs += [["a"] * 700 + items[20][3:16] + ["b"] * 700, [], items[13] * 300]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = decontamination.contaminated(table(spark, [(i, " ".join(w), None) for i, w in enumerate(docs)]), bench, block_rows=15)
    got = {r["doc_id"]: r["item_ids"] for r in found.collect()}
    want = {i: [n for n, item in items.items() if n >= 5 and brute_overlaps(d, item)] for i, d in enumerate(docs)}
    assert got == {i: x for i, x in want.items() if x}
    assert sum(10 <= n <= 13 for x in got.values() for n in x) > 244


def brute_bits(texts, scored, order=4):
    """Bits of texts under an interpolated modified Kneser-Ney model, from its definition."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = b"\n" * (order - 1) + t
        for i in range(len(t)):
            grams[order][padded[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discounts, totals, left = [], [], []
    for g in grams:
        n = [0, *(sum(c == k for c in g.values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 0) for k in (1, 2, 3)]
        d = [max(0.05 * k, min(k - 0.05, x)) for k, x in enumerate(d, 1)]
        discounts.append(d)
        total, rest = Counter(), Counter()
        for s, c in g.items():
            total[s[:-1]] += c
            rest[s[:-1]] += d[min(c, 3) - 1]
        totals.append(total)
        left.append(rest)

    def p(context, byte):
        k = len(context) + 1
        lower = p(context[1:], byte) if k > 1 else 1 / 256
        if not totals[k][context]:
            return lower
        c = grams[k][context + byte]
        return ((c - discounts[k][min(c, 3) - 1] if c else 0) + left[k][context] * lower) / totals[k][context]

    out = []
    for t in scored:
        padded = b"\n" * (order - 1) + t
        out.append(-sum(np.log2(p(padded[i : i + order - 1], padded[i + order - 1 : i + order])) for i in range(len(t))))
    return out


@pytest.mark.parametrize("block_bytes", [600, 50])
def test_quality_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(quality, "BLOCK_BYTES", block_bytes)
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["ab", "abc", "bca", "cé", "d"]) for _ in range(rnd.randint(1, 40))), "en") for i in range(60)] + [(100, "zz top\n" * 300, "en"), (100, "zz top\n" * 300, "en"), (101, "a", None)]
    good = [i for i in range(40)]
    found = quality.judge(table(spark, rows), spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()
    got = {r["doc_id"]: r for r in found}
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    taught = [t.encode() for i, t, _ in rows if i in good and zlib.crc32(str(i).encode()) % 5]
    english = [(i, t.encode()) for i, t, lang in rows]
    for (i, t), bits in zip(english, brute_bits(taught, [t for _, t in english]), strict=True):
        assert got[i]["n_bytes"] == len(t)
        assert got[i]["bits_per_byte"] == pytest.approx(bits / len(t), rel=1e-9)
        assert got[i]["perplexity"] == pytest.approx(2 ** (bits / len(t)), rel=1e-9)


def test_quality(spark):
    rnd = random.Random(3)
    parts = ["on", "er", "th", "an", "re", "ti", "es", "in"]
    prose = lambda: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 80)))
    rows = [(i, prose(), "en") for i in range(200)] + [(1000 + i, " ".join("#%$&!" for _ in range(60)), "en") for i in range(5)] + [(2000, None, "en"), (2001, "", None), (2002, prose(), None), (2003, prose(), "xx")]
    good = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    got = {r["doc_id"]: r for r in quality.judge(table(spark, rows), good).collect()}
    assert len(got) == len(rows)
    assert not any(got[1000 + i]["keep"] for i in range(5))
    assert sum(got[i]["keep"] for i in range(200)) >= 196
    assert got[2000]["keep"] and got[2001]["keep"] and got[2002]["keep"]
    assert all(r["keep"] for r in quality.judge(table(spark, rows), good.limit(0)).collect())
    assert quality.judge(table(spark, []), good).collect() == []


def test_kneser_ney_probabilities_sum_to_one(spark):
    texts, order = [b"abracadabra", b"banana bandana"], 3
    block = quality.Block(texts, order)
    n = block.counts()
    counts = spark.createDataFrame([(1, int(k), int(c)) for k, c in zip(block.keys[order], n, strict=True) if c], "lang_id int, key long, n long")
    model = {r["gram"]: (r["alpha"], r["gamma"]) for r in quality.kneser_ney(counts, order).collect()}
    name = lambda s: int(quality.gram_key(np.array([int.from_bytes(s, "big")]), len(s), 1)[0])

    def p(context, byte):
        if context is None:
            return 1 / 256
        return model.get(name(context + bytes([byte])), (0.0, 1.0))[0] + model.get(name(context), (0.0, 1.0))[1] * p(context[1:] if context else None, byte)

    for context in (b"ab", b"an", b"zz", b"na"):
        assert sum(p(context, b) for b in range(256)) == pytest.approx(1)


def test_language_id(spark):
    rnd = random.Random(4)
    words = {"aa": ["kala", "mala", "tala", "sana"], "bb": ["ströb", "grün", "föhn", "über"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 30))), lang) for i in range(200) for lang in [rnd.choice(("aa", "bb"))]]
    odd = [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None)]
    model = language_id.fit(table(spark, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]))
    got = {r["doc_id"]: r for r in language_id.predict(table(spark, rows + odd), model).collect()}
    held = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 5]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.fit(table(spark, odd[2:])) is None
    assert language_id.predict(table(spark, rows[:2]), None).first()["lang_pred"] == "und"


@pytest.mark.parametrize("heavy", [2000, 1])
def test_repeated_passages(spark, heavy):
    rows = corpus(60)
    got = {r["doc_id"]: r for r in repeated_passages.cut_repeats(table(spark, rows), heavy=heavy, carry=("lang", "row")).collect()}
    first = {}
    words = {i: WORD.findall(t or "") for i, t, _ in rows}
    for i in sorted(k for k in words if k is not None):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        assert got[i]["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert any(r["n_removed"] for r in got.values())
    assert repeated_passages.cut_repeats(table(spark, [])).collect() == []


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = corpus(40) + [(3000, "Don't  STOP… <|endoftext|> été ÉTÉ naïve éx 12,5% a.b", "en"), (3001, "wort " * 5000, "de"), (3002, "x <|endoftext|> y<|startoftext|>z <|ENDOFTEXT|> <|end", None), (3003, " ".join(thue_morse(10)), None), (3004, " ".join(thue_morse(10)[::-1]), None)]
    folder, files = token_files.write(table(spark, rows), path, length=16)
    got = token_files.read(spark, folder, files).collect()
    library = Tokenizer.from_file(path)
    start = 0
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        r = by_id[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = token_files.SequenceReader(folder, files[0]["file"])
    total = 0
    for k in range(-(-files[0]["n_tokens"] // 16)):
        ids, mask = reader.sequence(k)
        assert len(ids) == len(mask) == 16 and not ids.flags.owndata
        # The mask lies where the mapped file has it.
        bits = reader.sequences.get_batch(k // reader.batch).column(1).values.buffers()[1]
        assert mask.buffers()[1].address == bits.address
        total += mask.true_count
    assert total == files[0]["n_tokens"]
    assert any(token_files.SequenceReader(folder, f["file"]).sequences.num_record_batches > 1 for f in files)
    folder, files = token_files.write(table(spark, []), path)
    assert files == [] and token_files.read(spark, folder, files).collect() == []


def test_token_files_work_grows_with_distinct_pieces(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read())
    # Rows begin with punctuation and end in letters, so that a border of rows looks like a cut.
    texts = ["", "a", "a.", ".a", "é.", ".", " ", "Ünïcode,x"] + [f".wort{k % 700} d'été, Ä{k % 90}; ß" for k in range(40_000)] + ["x <|endoftext|>y"]
    data, offsets = tk.string_buffers(pa.array(texts))
    looked, find = [], encoder._ids_of
    monkeypatch.setattr(encoder, "_ids_of", lambda pieces: looked.extend(pieces) or find(pieces))
    for last in (len(texts) - 1, len(texts)):
        looked.clear()
        ids, counts = encoder.encode(data, offsets, 0, last)
        assert len(looked) == len(set(looked)) < 1000
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts[:last], add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]

    folder, files = token_files.write(table(spark, [(k, f"wort{k} und", None) for k in range(500)]), path, length=8)
    reader = token_files.SequenceReader(folder, files[0]["file"])
    asked, sequences = [], reader.sequences
    monkeypatch.setattr(reader, "sequences", type("Counted", (), {"get_batch": lambda self, k: asked.append(k) or sequences.get_batch(k)})())
    docs = list(reader.documents())
    assert sum(len(reader.span(start, n)) for _, start, n in docs) == files[0]["n_tokens"]
    assert len(asked) == sequences.num_record_batches < len(docs)


def test_byte_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    rows = corpus(30) + [(4000 + i, "".join(rnd.choice("abteh '\n\x85\x1c日本é😀0٣　") for _ in range(rnd.randint(0, 80))), None) for i in range(60)]
    rows += [(5000, "a" * 5000, None), (5001, "".join(rnd.choice("theinor") for _ in range(20_000)), None)]
    got = {r["doc_id"]: r for r in byte_bpe.decode(byte_bpe.encode(table(spark, rows), path, public_tokenizers.PATTERN), path).collect()}
    for i, t, _ in rows:
        want = library.encode_ordinary(t or "")
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want and got[i]["n_tokens"] == len(want)
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert byte_bpe.encode(table(spark, []), path, public_tokenizers.PATTERN).collect() == []


def test_rank_bitmap():
    bitmap, held, rnd = byte_bpe.RankBitmap(60_000), set(), random.Random(1)
    for _ in range(3000):
        i = rnd.randrange(60_000)
        (bitmap.add if rnd.random() < 0.6 else bitmap.discard)(i)
        held.add(i) if bitmap.low[i >> 6] >> (i & 63) & 1 else held.discard(i)
        assert bitmap.first() == min(held, default=-1)


def test_long_texts_score_as_whole(monkeypatch):
    """Spans change no score: sentences that a span cuts are joined again."""
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rnd.choice(vocabulary) + rnd.choice(["", "!!!", "."]) + rnd.choice([" ", "  ", "\n", " "]) for _ in range(n)) for n in (0, 1, 30, 400)]
    bad = toxicity.train([rnd.choice(vocabulary[:50]) + " " + vocabulary[55] for _ in range(60)] + [" ".join(rnd.sample(vocabulary[:50], 9)) for _ in range(300)], [1] * 60 + [0] * 300, [1.0] * 360)
    tongue = language_id.train(["kala mala " * 5, "grün föhn " * 5] * 20, ["aa", "bb"] * 20)
    for limit in (7, 64, 1000):
        monkeypatch.setattr(tk, "CHUNK_BYTES", limit)
        monkeypatch.setattr(tk.spans, "__defaults__", (limit,))
        for t in texts:
            data, offsets = tk.string_buffers(pa.array([t]))
            s = toxicity.Sentences(data, offsets, 0, 1)
            score, p = bad.scores(s)
            long = bad.score_long(data, 0, len(data))
            assert long[0] == pytest.approx(score) and long[1] == pytest.approx(p)
            assert long[2].tolist() == s.begin.tolist() and long[3].tolist() == s.stop.tolist()
            assert tongue.score_long(data) == pytest.approx(tongue.scores(data, offsets))


def test_toxicity(spark):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    sentence = lambda *more: " ".join(rnd.sample(vocabulary, 8) + list(more)).capitalize() + "."
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        parts = [sentence() for _ in range(rnd.randint(1, 12))]
        if bad:
            parts.insert(rnd.randrange(len(parts) + 1), sentence(rnd.choice(("zorx", "quuz"))))
        rows.append((i, " ".join(parts), None))
        labels.append((i, int(bad)))
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    marks = spark.createDataFrame([x for x in labels if not held(x[0])] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, [r for r in rows if not held(r[0])]), marks)
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, rows + [(900, None, None), (901, "", None)]), model).collect()}
    right = [(got[i]["score"] >= 0.3) == bool(y) for i, y in labels if held(i)]
    assert sum(right) >= 0.97 * len(right)
    for i, y in labels:
        if y and got[i]["score"] >= 0.3:
            worst = rows[i][1].encode()[got[i]["worst_begin"] : got[i]["worst_end"]].decode().lower()
            assert "zorx" in worst or "quuz" in worst
    assert 0 <= got[900]["score"] == got[901]["score"] < 0.3 and got[900]["worst_begin"] is None
    odd = [(i, rows[i][1].replace(w, f"((({w}" + "!" * 30), None) for i, y in labels[:200] if y for w in ("zorx", "quuz") if w in rows[i][1]]
    again = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, odd), model).collect()}
    assert all(again[i] >= 0.3 for i, _, _ in odd)
    assert toxicity.fit(table(spark, rows), marks.limit(0)) is None
    assert toxicity.score(table(spark, rows[:1]), None).first()["score"] < 0.01
