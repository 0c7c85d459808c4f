import base64
import gzip
import hashlib
import io
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pytest
import xxhash
from pyspark.sql import functions as F

from loamix.llm import components, decontaminate, embeddings, mixing, quality, simhash, substrings, token_output, toxicity, url_filter, warc
from loamix.plans.shared import Workspace

ODD = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "a b c d"), (4, "x" * 5000 + " y" * 3000), (5, " \n\t ")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, f0 long, score double, copy long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3.0, 4) for i, t in rows], DOCS)


def test_golay_keys():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    keys = [set() for _ in range(600)]
    row, key = simhash.bucket_keys(np.concatenate([x, y])[:, None], simhash.WITHIN_2)
    for r, k in zip(row, key):
        keys[r].add(int(k))
    assert all(keys[i] & keys[300 + i] for i in range(300))


def test_simhash_odd_rows(spark):
    work = Workspace(spark, "t")
    got = simhash.near_duplicates(simhash.fingerprints(frame(spark, ODD)), simhash.WITHIN_2, 1, work).collect()
    assert len(got) == len(ODD)
    by = {r.id: r for r in got}
    assert by[2].f0 == by[3].f0 == by[5].f0 == 0 and by[5].component_id == 2 and by[1].component_id == 1
    assert simhash.near_duplicates(simhash.fingerprints(frame(spark, [])), simhash.WITHIN_2, 1, Workspace(spark, "t")).count() == 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d")]
    assert by[None].f0 % (1 << 64) == h[0] & h[1]


def test_simhash_against_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for i in range(120):
        base = [rng.choice(["a", "B", "cc", "dé", "e\u00a0f", "g"]) + str(rng.randrange(30)) for _ in range(rng.choice([1, 2, 3, 60, 400]))]
        rows.append((2 * i, rng.choice([" ", "\t", "\n "]).join(base)))
        if i % 3 == 0:
            base[rng.randrange(len(base))] = "other"
            rows.append((2 * i + 1, " ".join(base)))
    rows += [(None, rows[5][1]), (400, None), (401, ""), (402, rows[5][1]), (402, "x"), (403, "word " * 100_000)]

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[p : p + 3]) for p in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    want = sorted((i is None, i or 0, p, least[x]) for (i, _), p, x in zip(rows, prints, label, strict=True))
    assert 10 < len(rows) - len(least) < 100
    got = simhash.near_duplicates(simhash.fingerprints(frame(spark, rows)), simhash.WITHIN_2, 1, Workspace(spark, "t")).collect()
    assert sorted((r.id is None, r.id or 0, r.f0 % (1 << 64), r.component_id) for r in got) == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 31)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges, Workspace(spark, "t")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 30, 31: 30}


def test_similar_documents(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    other = [f"v{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base))]
    got = {r.id.id: r.component_id.id for r in simhash.similar_documents(frame(spark, rows), Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_similar_documents_of_one_word_set(spark):
    words = [f"w{i}" for i in range(60)]
    shuffled = words[:]
    random.Random(4).shuffle(shuffled)
    rows = [(1, " ".join(words)), (2, " ".join(shuffled)), (5, "a b c"), (6, "c b a"), (7, "a  B c")]
    got = {r.id.id: r.component_id.id for r in simhash.similar_documents(frame(spark, rows), Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 2, 5: 5, 6: 6, 7: 5}


def brute_groups(rows, similarity=0.8):
    """Smallest id of the documents reached by pairs of that Jaccard similarity."""
    sets = {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, w in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def test_similar_documents_of_moved_passages(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for k in range(60):
        base = [word() for _ in range(200)]
        n = rng.randrange(20, 50)
        copies = [base + [word() for _ in range(n)], base[: 200 - n], base[:60] + [word() for _ in range(n // 3)] + base[60 + n // 3 :]]
        rows += [(10 * k + i, w) for i, w in enumerate([base, *copies])]
    want = brute_groups(rows)
    assert 100 < sum(i != c for i, c in want.items()) < 180
    got = {r.id.id: r.component_id.id for r in simhash.similar_documents(frame(spark, [(i, " ".join(w)) for i, w in rows]), Workspace(spark, "t")).collect()}
    assert got == want


def test_similar_documents_among_template_pages(spark, monkeypatch):
    monkeypatch.setattr(simhash, "common_shingles", lambda keyed: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(100000)}"
    page = [word() for _ in range(200)]
    rows = [(1, page + [word() for _ in range(5)]), (2, page + [word() for _ in range(35)])]
    for i in range(60):
        cut = (i * 37) % 140
        rows.append((10 + i, page[:cut] + page[cut + 60 :] + [word() for _ in range(52 if i % 3 == 0 else 68 + i % 25)]))
    want = brute_groups(rows)
    assert want[2] == 1
    got = {r.id.id: r.component_id.id for r in simhash.similar_documents(frame(spark, [(i, " ".join(w)) for i, w in rows]), Workspace(spark, "t")).collect()}
    assert got == want


def brute_removed(docs, window):
    first = {}
    for i, words in docs:
        for p in range(len(words) - window + 1):
            first.setdefault(tuple(words[p : p + window]), []).append(i)
    out = {}
    for i, words in docs:
        gone = set()
        for p in range(len(words) - window + 1):
            if min(first[tuple(words[p : p + window])]) < i:
                gone.update(range(p, p + window))
        out[i] = (len(gone), hashlib.sha256(" ".join(w for q, w in enumerate(words) if q not in gone).encode()).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(3)
    pool = [[f"w{rng.randrange(40)}" for _ in range(80)] for _ in range(4)]
    docs = []
    for i in range(60):
        words = [f"u{rng.randrange(1000)}" for _ in range(rng.randrange(60))] + rng.choice(pool)[rng.randrange(30) :] + [f"u{rng.randrange(1000)}" for _ in range(rng.randrange(30))]
        docs.append((i, words * (3 if i % 20 == 0 else 1)))
    got = substrings.remove_repeats(frame(spark, [(i, " ".join(w)) for i, w in docs]), Workspace(spark, "t"), window=20, batches=3).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == brute_removed(docs, 20)


def passages(rng, n, pool):
    """Documents of n ids, some of which hold a part of a shared passage, once or three times."""
    docs = []
    for i in range(n):
        words = [f"u{rng.randrange(1000)}" for _ in range(rng.randrange(60))] + rng.choice(pool)[rng.randrange(30) :] + [f"u{rng.randrange(1000)}" for _ in range(rng.randrange(30))]
        docs.append((i, words * (3 if i % 20 == 0 else 1)))
    return docs


def test_substrings_batches_in_any_order_reopened_and_compacted(spark):
    rng = random.Random(13)
    docs = passages(rng, 70, [[f"w{rng.randrange(40)}" for _ in range(80)] for _ in range(4)])
    shuffled = docs[:]
    rng.shuffle(shuffled)
    own = lambda rows: frame(spark, [(i, " ".join(w)) for i, w in rows]).select("doc_id", "text").withColumn("copy", F.xxhash64("text"))
    work = Workspace(spark, "t")
    index = substrings.SpanIndex(work, window=20, most_runs=2)
    for k in range(6):
        index.ingest(own(shuffled[12 * k : 12 * k + 12]))
        if k == 3:
            index = substrings.SpanIndex.reopen(work)
    assert len(index.runs) <= 2 and len(index.batches) == 6
    gone = {}
    for r in index.resolve(own(docs)).collect():
        gone.setdefault(r.doc_id, set()).update(range(r.first, r["last"] + 20))
    assert {i: len(gone.get(i, ())) for i, _ in docs} == {i: n for i, (n, _) in brute_removed(docs, 20).items()}


def test_substrings_of_one_passage_in_many_documents(spark):
    passage = " ".join(f"licence{k}" for k in range(60))
    rows = [(i, f"before{i} " * 3 + passage + f" after{i}" * 4) for i in range(2000)]
    work = Workspace(spark, "t")
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, rows), work).collect()}
    assert got == {i: 60 if i else 0 for i in range(2000)}
    # The shared windows meet as one row each before they are joined.
    assert work.load("least", spark.read.parquet(work.at("least")).schema).count() == 11


def test_substrings_of_two_texts_of_one_id(spark):
    rng = random.Random(17)
    a, b, c = ([f"{x}{rng.randrange(50)}" for _ in range(40)] for x in "abc")
    rows = [(1, a + b), (2, b + c), (2, c + b[:30] + a), (2, b + c + a), (3, c + a)]
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, [(i, " ".join(w)) for i, w in rows]), Workspace(spark, "t"), window=20).collect())
    windows = lambda w: [tuple(w[p : p + 20]) for p in range(len(w) - 19)]
    want = []
    for i, w in rows:
        below = {x for j, v in rows if j < i for x in windows(v)}
        cut = {q for p, x in enumerate(windows(w)) if x in below for q in range(p, p + 20)}
        want.append((i, len(cut), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in cut).encode()).hexdigest()))
    assert got == sorted(want)


def test_substrings_odd_rows(spark):
    got = substrings.remove_repeats(frame(spark, ODD), Workspace(spark, "t")).collect()
    assert len(got) == len(ODD)
    assert all(r.n_removed == 0 for r in got if r.doc_id != 4)
    assert substrings.remove_repeats(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(7, "One two three four"), (8, None), (9, "!!"), (10, " ".join(f"k{i}" for i in range(15)))], "item_id long, text string")
    rows = [(1, "zero one two three four five"), (2, "one two three"), (3, None), (4, " ".join(f"K{i}" for i in range(2, 14))), (4, "")]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find(frame(spark, rows), items, Workspace(spark, "t")).collect())
    assert got == [(1, 6, 4, ["7"]), (2, 3, 0, []), (3, 0, 0, []), (4, 0, 0, []), (4, 12, 12, ["10"])]
    assert decontaminate.find(frame(spark, rows), items.limit(0), Workspace(spark, "t")).count() == 5
    assert decontaminate.find(frame(spark, []), items, Workspace(spark, "t")).count() == 0


def brute_hits(rows, items, window=10):
    """(words hit, items) of each row."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[p : p + window]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return out


@pytest.mark.parametrize("limit", [16 << 20, 160])
def test_decontamination_against_brute_force(spark, monkeypatch, limit):
    # With the smaller limit nothing is broadcast but the bitmap.
    from loamix.plans import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontaminate, "BITMAP", 4)
    rng = random.Random(18)
    word = lambda: rng.choice(["Ab", "cd", "é", "x1", "zz"]) + rng.choice(["", "q"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 30])))) for i in range(30)] + [(99, None), (98, "...")]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60))) + "-" + (items[i % 30][1] if i % 2 else "")) for i in range(60)]
    rows += [(None, items[4][1]), (None, None), (7, rows[7][1]), (100, ("filler " * 30_000) + items[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(frame(spark, rows), table, Workspace(spark, "t")).collect()
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((order((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]))) for r in got)) == sorted(map(order, brute_hits(rows, items)))


def test_url_filter(spark):
    rows = [(1, "http://A.example.org/es/x"), (2, "http://x.org/y"), (3, None), (4, "nothing"), (5, "https://com/de/"), (6, "http://notexample.org/es/"), (1, "http://A.example.org/es/x")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_table(spark)).collect())
    assert got == [(1, "a.example.org", "/es/x", "example.org/es/", "block")] * 2 + [(2, "x.org", "/y", "org/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "com", "/de/", "com/de/", "block"), (6, "notexample.org", "/es/", "org/", "allow")]
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rules_table(spark).limit(0), default="block").collect()} == {"block"}


def test_clashing_columns(spark):
    names = ["hash", "range", "s", "no_source", "take", "sha1", "repeated", "key", "digest", "rank", "url_key", "payload", "kind", "path"]
    pages = spark.createDataFrame([(1, "http://org/es/x", "p"), (2, "http://b.example.org/es/" + "y" * 50_000, "p"), (3, None, None)], "page_id long, url string, html string")
    clash = pages.select("*", *[F.lit("x").alias(n) for n in names if n not in ("host",)])
    judged = [sorted(map(tuple, url_filter.judge(x, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect())) for x in (pages, clash)]
    assert judged[0] == judged[1] and judged[0][1][3:] == ("example.org/es/", "block")
    read = []
    for x in (pages, clash):
        work = Workspace(spark, "t")
        files = work.save(warc.write_warc(x, work.make("w")), "files")
        read.append(sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to or 0) for r in warc.read_warc(files).collect()))
    assert read[0] == read[1] == [(1, "revisit", 1, 2), (2, "response", 1, 0), (3, "response", 0, 0)]
    docs = spark.createDataFrame([(i, "w " * i, "a") for i in range(12)], "doc_id long, text string, source string")
    clash = docs.select("*", *[F.lit("x").alias(n) for n in names])
    order = ["doc_id", "size", "taken"]
    mixed = [sorted(map(tuple, mixing.mix(x, Workspace(spark, "t")).select(order).collect())) for x in (docs, clash)]
    assert mixed[0] == mixed[1]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, None), (None, "u", "é" * 50_000), (2, "http://b/\r\nx", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    work = Workspace(spark, "t")
    files = work.save(warc.write_warc(pages, work.make("w")), "files")
    for split in (1000, 1 << 20):
        got = warc.read_warc(files, split, payload=True).collect()
        assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [(0, "response", 0, 100_000), (1, "revisit", 2, 4), (2, "response", 0, 4), (2, "response", 0, 4), (3, "response", 0, 0)]
        assert all(base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest for r in got if r.record_type == "response")
    path = files.first().path
    fs, local = pyarrow.fs.FileSystem.from_uri(path)
    assert gzip.GzipFile(fileobj=io.BytesIO(fs.open_input_file(local).read())).read().startswith(b"WARC/1.1\r\n")
    assert warc.read_warc(work.save(warc.write_warc(pages.limit(0), work.make("e")), "none")).count() == 0


def test_tokens_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*ODD, (6, "  a  b\n\n c \n d\t\te  <|endoftext|> é   z 12's 3a!! \0b")]
    work = Workspace(spark, "t")
    token_output.write_tokens(frame(spark, rows), work.at("tok"), path)
    got = token_output.read_tokens(spark, work.at("tok")).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    expected = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    assert sorted(map(tuple, (r.tokens for r in got))) == sorted(map(tuple, (expected[t] for _, t in rows)))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6]
    sums = token_output.with_checksum(token_output.read_tokens(spark, work.at("tok"))).collect()
    assert {r.ids_crc32 for r in sums} == {zlib.crc32(np.array(x, "<u4").tobytes()) for x in expected.values()}
    token_output.write_tokens(frame(spark, []), work.at("none"), path)
    assert token_output.read_tokens(spark, work.at("none")).count() == 0


def test_encoder_equals_whole_texts():
    import public_tokenizers

    encoder, drawn = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    parts = ["a", "word", "it's", "12", "é", "\n", " ", "  ", "\t", "\u3000", "\x1c", "\x85", "\0", "!", "\n\n", " \n", "<|endoftext|>", "a.", "Zé;", "b?!", "3,", "été", "日本", "\r\n", "'ll", "\xa0", "😀"]
    for _ in range(100):
        texts = ["".join(drawn.choices(parts, k=drawn.randint(0, 12))) for _ in range(20)] + ["", "x" * 50 + " y a", "plain words, here.\nnext line"]
        assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode([]) == []


def test_encoder_gives_the_library_many_units_at_once():
    import public_tokenizers

    class Counted:
        def __init__(self, inner):
            self.inner, self.calls = inner, 0

        def __getattr__(self, name):
            return getattr(self.inner, name)

        @property
        def model(self):
            return self

        def tokenize(self, text):
            self.calls += 1
            return self.inner.model.tokenize(text)

        def encode_batch_fast(self, *given, **named):
            self.calls += 1
            return self.inner.encode_batch_fast(*given, **named)

    drawn = random.Random(2)
    ends = ["", "", ".", ",###", "***", "é.", "ÿ$$$", "!'s", "'s", "'", ".'", "(a)", "7", "7%"]
    words = ["".join(drawn.choices("abcdeéßÿŁ", k=9)) + drawn.choice(ends) for _ in range(9000)] + ["###", "42", "-", "'", "\xff", "ÿ"]
    texts = [" ".join(drawn.choices(words, k=40)) for _ in range(400)] + [" ".join(words), "\n".join(words), "  ".join(words), "ÿ", "\n"]
    encoder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library = encoder.library
    encoder.library = counted = Counted(library)
    assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    # One call for each word was 8,000 and more.
    assert counted.calls < 1000


def test_texts_are_encoded_in_lots_of_bounded_size():
    sizes = [3, 0, token_output.TOGETHER // 2, token_output.TOGETHER // 2, 5, 2 * token_output.TOGETHER, 1, 0, 7]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes])], names=["doc_id", "text"])
    for rows in (1, 2, 4, 20):
        batches = [whole.slice(k, rows) for k in range(0, len(sizes), rows)]
        lots = list(token_output._slices(iter([whole.slice(0, 0), *batches, whole.slice(0, 0)]), 1))
        assert pa.Table.from_batches(lots).combine_chunks() == pa.Table.from_batches([whole])
        assert len(lots) < len(sizes)
        assert all(x.num_rows == 1 or sum(sizes[i] for i in x.column(0).to_pylist()[:-1]) < token_output.TOGETHER for x in lots)
    assert list(token_output._slices(iter([]), 1)) == []


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 13))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 13)) * 0.1, x[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 13), (102, [float("nan")] * 13), (103, [1.0]), (104, [None] * 13), (105, [])]
    got = {r.id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Workspace(spark, "t")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(100, 106))
    assert got[60].component_id == 0 and not got[60].kept
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>"), Workspace(spark, "t")).count() == 0


def brute_links(x):
    """(links of each row, smallest row reached) by comparing all rows of x."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    label = np.arange(len(x))
    while True:
        least = np.array([label[row].min() for row in near])
        if (least == label).all():
            return near.sum(1) - 1, label
        label = least


@pytest.mark.parametrize("dim", [2, 3, 8, 64])
def test_embeddings_of_few_true_dimensions(spark, monkeypatch, dim):
    # Small blocks, so that lists are many and are cut.
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(600, dim))
    x[300:] = x[rng.integers(0, 30, 300)] + rng.normal(size=(300, dim)) * 0.25
    x = x @ np.linalg.qr(rng.normal(size=(64, dim)))[0].T
    rows = [(i, v.tolist(), "clash", -1) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, n int")
    got = {r.id: r for r in embeddings.near_duplicates(docs, Workspace(spark, "t")).collect()}
    links, label = brute_links(x)
    assert links.sum() > 2000
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_embeddings_in_many_stripes(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "STRIPE", 24_000)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 6))
    x[250:] = x[rng.integers(0, 20, 150)] + rng.normal(size=(150, 6)) * 0.2
    x[390:] = x[0]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 2)))]
    got = {r.id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Workspace(spark, "t")).collect()}
    for start, part in ((0, x), (1000, np.array([v for i, v in rows[400:]]))):
        links, label = brute_links(part)
        assert links.sum() > 20
        assert [got[start + i].n_links for i in range(len(part))] == links.tolist()
        assert [got[start + i].component_id - start for i in range(len(part))] == label.tolist()


def test_embeddings_are_not_repeated_for_each_list(spark, monkeypatch):
    # Vectors that fill all directions evenly: next to no list can be left out.
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    x = np.random.default_rng(8).normal(size=(2000, 32))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = shuffled()
    assert embeddings.near_duplicates(docs, Workspace(spark, "t")).count() == 2000
    assert shuffled() - before < 6 * x.nbytes


def test_embeddings_null_and_repeated_ids_and_lengths(spark):
    one, two, short = [1.0, 2.0, 3.0], [1.0, 2.1, 3.0], [1.0, 2.0]
    rows = [(5, one), (5, two), (None, one), (7, short), (8, short), (9, [2.0, 4.0]), (10, [-1.0, 0.0, 0.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Workspace(spark, "t")).collect()
    got = sorted((r.id or 0, r.n_links, r.component_id, r.kept) for r in found)
    assert got == [(0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False), (10, 0, 10, True)]


def brute_segments(s):
    """Maximal scoring segments by recursion: the best segment, then both sides."""
    if not len(s):
        return []
    total = np.concatenate([[0], np.cumsum(s)])
    best = max(((total[b] - total[a], -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(s[:a]) + [(a, b)] + [(b + x, b + y) for x, y in brute_segments(s[b:])]


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.normal(-0.3, 1, rng.integers(1, 25))
        assert [x[:2] for x in toxicity.segments(s)] == brute_segments(s)


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(30)] + (["villain", "scoundrel"] if i % 5 == 0 else []))) for i in range(300)]
    docs = frame(spark, rows + ODD[2:4])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Workspace(spark, "t"))
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("text <> ''"), model).collect()}
    odd = [i for i in range(1, 300, 2)]
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in odd]) > 0.97
    assert toxicity.score(docs, model).count() == 302 and toxicity.passages(rows[0][1], model)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), Workspace(spark, "t"))
    assert toxicity.probability("x", none) == 0.5


def test_toxicity_against_plain_computation(spark):
    rng = random.Random(31)
    word = lambda: rng.choice("abcdefg") * rng.randrange(1, 4) + rng.choice(["", "ingly", "ation", "ations"])
    rows = [(i, " ".join([word() for _ in range(rng.randrange(30))] + (["villain", word(), "villains"] if i % 4 == 0 else []))) for i in range(160)]
    rows += [(2, rows[2][1]), (300, None), (301, ""), (302, "villain " * 30_000), (None, "villain")]
    labels = {i: int(i % 4 == 0 or i % 17 == 0) for i in range(0, 160, 2)}
    known = spark.createDataFrame([(i, y, "x") for i, y in [*labels.items(), (4, 0), (None, 1), (6, None)]], "doc_id long, toxic int, label string")
    docs = frame(spark, rows).withColumn("label", F.lit("clash"))
    model = toxicity.fit(docs, known, Workspace(spark, "t"))
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    seen = {}
    for i, text in rows:
        if i in labels:
            words, first = ["", "", *cut(text)], {}
            for p in range(2, len(words)):
                for unit in [words[p][:k] + "*" for k in range(5, min(8, len(words[p])))] + [words[p]]:
                    first.setdefault(unit, zlib.crc32(f"{words[p - 2]} {words[p - 1]}".encode()))
            for unit, context in first.items():
                seen.setdefault((unit, context), set()).add(labels[i])
    counts = {}
    for (unit, _), found in seen.items():
        clean, bad = counts.get(unit, (0, 0))
        counts[unit] = (clean + (0 in found), bad + (1 in found))
    clean, bad = (sum(c[k] for u, c in counts.items() if not u.endswith("*")) for k in (0, 1))
    assert model.counts == {u: c for u, c in counts.items() if sum(c) >= 3}
    assert model.share == pytest.approx((bad + 1) / (clean + bad + 2))
    train = [(cut(t), labels[i]) for i, t in rows if i in labels]
    own = lambda words, y: np.array([model.word(w, y) for w in words])
    drawn = np.concatenate([own(w, y)[:: max(1, len(w) // 50)] for w, y in train if y == 0 and w])
    assert np.exp(model.rate * drawn).mean() == pytest.approx(1, abs=1e-6)
    best = lambda s: max([s[a:b].sum() for a, b in brute_segments(s)], default=0.0)
    assert model.size == pytest.approx(1 / np.mean([len(w) * np.exp(-model.rate * best(own(w, y))) for w, y in train if y == 0 and w]))

    def features(s):
        bits = [model.rate * s[a:b].sum() - np.log(model.size * max(1, len(s))) for a, b in brute_segments(s)]
        good = [b for b in bits if b > -np.log(toxicity.SIGNIFICANT)]
        return [1, min(max(bits, default=-np.log(model.size * max(1, len(s)))), 40), min(sum(good), 120), np.log1p(len(good))]

    x, y = np.array([features(own(w, y)) for w, y in train]), np.array([y for _, y in train])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ model.weights))) - np.array([1e-6, 1, 1, 1]) * model.weights
    assert np.abs(slope).max() < 1e-6
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in toxicity.score(docs, model).collect())
    short = [(i, t) for i, t in rows if i != 302]
    want = sorted((i is None, i or 0, 1 / (1 + np.exp(-np.clip(np.dot(model.weights, features(own(cut(t), None))), -30, 30)))) for i, t in short)
    assert [g[:2] for g in got if g[1] != 302] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got if g[1] != 302], [w[2] for w in want])
    assert [g[2] for g in got if g[1] == 302][0] > 0.9


def test_targets():
    got = mixing.targets([10, 0, 100])
    assert sum(got) == 110 and got[0] == 110 / 4 or got[0] <= 30
    assert got[1] == 0 and all(t <= 3 * s for t, s in zip(got, [10, 0, 100]))


def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    """Shares of all, then again and again of what sources above their limit leave."""
    out = {}
    while len(out) < len(sizes):
        free = [i for i in range(len(sizes)) if i not in out]
        left = sum(sizes) - sum(out.values())
        share = {i: Fraction(left * weights[i % 3], sum(weights[j % 3] for j in free)) for i in free}
        over = {i: Fraction(repeats * sizes[i]) for i in free if share[i] > repeats * sizes[i]}
        out |= over or share
    return [out[i] for i in range(len(sizes))]


def test_targets_against_brute_force():
    rng = random.Random(12)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randrange(5), rng.randrange(1000)]) for _ in range(rng.randrange(12))]
        assert mixing.targets(sizes) == brute_targets(sizes)


@pytest.mark.parametrize("first_try", [0, 1 << 16])
def test_fit_counts_against_all_sums(monkeypatch, first_try):
    monkeypatch.setattr(mixing, "FIRST_TRY", first_try)
    rng = np.random.default_rng(7)
    for _ in range(150):
        sizes = np.unique(rng.integers(1, 60, rng.integers(1, 8))) * rng.integers(1, 4)
        counts = rng.integers(1, 6, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 2))
        sums = {0}
        for size, n in zip(sizes.tolist(), counts.tolist(), strict=True):
            sums = {x + k * size for x in sums for k in range(n + 1)}
        take = mixing.fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert (take * sizes).sum() == max(x for x in sums if x <= budget)


def test_mix(spark):
    rows = [(i, "w " * (i % 7), None, [None, "b", "a"][i % 3], None) for i in range(60)] + [(3, "w " * 3, None, "a", None)] * 2 + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs, Workspace(spark, "t")).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(t=("target", "first"), k=("taken", "sum"))
    # The sizes 1 .. 6 make every sum, so only rounding is left.
    assert (by.t - by.k).abs().max() <= 0.5
    names = [None, "a", "b"]
    words = {n: sum(len((r[1] or "").split()) for r in rows if r[3] == n) for n in names}
    wanted = dict(zip(["a", "b", None], brute_targets([words[n] for n in ("a", "b", None)]), strict=True))
    assert all(r.target == float(wanted[None if pd.isna(r.source) else r.source]) for r in got.itertuples())
    again = mixing.mix(docs, Workspace(spark, "t")).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    assert got.sort_values(order).reset_index(drop=True)[order].equals(again.sort_values(order).reset_index(drop=True)[order])
    assert mixing.mix(docs.limit(0), Workspace(spark, "t")).count() == 0


def test_quality(spark):
    rows = [(i, "good plain words here " * 5 if i % 3 else "@@ ## junk %% " * 5) for i in range(90)] + [(500, None), (500, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 90, 2)], "doc_id long, quality int")
    docs, work = frame(spark, rows), Workspace(spark, "t")
    ratio, share = quality.fit(docs, labels, work)
    got = quality.resample(quality.log_weights(docs, ratio), 55, work).toPandas()
    assert len(got) == 92 and got.kept.sum() == 55 and got[got.doc_id % 3 == 0].query("doc_id < 100").kept.sum() == 0
    top = got.sort_values("key", ascending=False).head(54)
    assert top.kept.all()
    ratio, share = quality.fit(docs, labels.limit(0), Workspace(spark, "t"))
    assert not ratio.any() and share == 1
    assert quality.resample(quality.log_weights(docs.limit(0), ratio), 5, Workspace(spark, "t")).count() == 0


def test_quality_against_plain_computation(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: rng.choice(["Alpha", "beta!", "gamma", "d1", "##", "é"]) + rng.choice(["", "x", "y"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(None, "beta gamma"), (None, "beta gamma"), (7, rows[7][1]), (300, None), (301, ""), (302, "gamma " * 50_000)]
    labels = {i: int(rng.random() < 0.4) for i in range(0, 200, 3)}
    size = 997
    # The clashing columns of ``frame`` are not read.
    docs, work = frame(spark, rows), Workspace(spark, "t")
    known = spark.createDataFrame([*labels.items(), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    ratio, share = quality.fit(docs, known, work, size=size)
    monkeypatch.setattr(quality, "FEW", 10)
    got = quality.resample(quality.log_weights(docs, ratio), 70, work).collect()

    def grams(text):
        words = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
        own = [zlib.crc32(w.encode()) for w in words]
        pairs = [((a * 0x9E3779B1 + b * 0x85EBCA77) % (1 << 64)) >> 7 for a, b in zip(own, own[1:])]
        return [x % size for x in own + pairs]

    raw, target = np.zeros(size), np.zeros(size)
    for i, text in rows:
        for x in grams(text):
            raw[x] += 1
            target[x] += labels.get(i, 0)
    pooled = 1000 * (raw + 1) / (raw + 1).sum()
    expected = np.log((target + pooled) / (target + pooled).sum()) - np.log((raw + pooled) / (raw + pooled).sum())
    assert np.allclose(ratio, expected) and share == sum(labels.values()) / len(labels)

    def noise(i):
        h = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        return -np.log(-np.log(((xxhash.xxh64_intdigest(struct.pack("<i", 7), h) >> 11) + 0.5) / (1 << 53)))

    want = sorted((i is None, i or 0, sum(expected[x] for x in grams(text)) + noise(i)) for i, text in rows)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.key) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in want] and np.allclose([x[2] for x in found], [x[2] for x in want])
    limit = sorted((x[2] for x in want), reverse=True)[69]
    assert sum(r.kept for r in got) == 70 and all(r.kept == (r.key >= limit - 1e-9) for r in got)


def test_quality_of_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 10)
    scored = spark.createDataFrame([(1, 0.0)] * 300 + [(2, 50.0)] * 20 + [(3, -50.0)] * 20, "doc_id long, log_weight double")
    got = quality.resample(scored, 120, Workspace(spark, "t")).groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 100, 2: 20, 3: 0}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    item = [f"q{i}" for i in range(12)]
    rows = [(i, " ".join([f"w{rng.randrange(3000)}" for _ in range(60)] + (item if i == 9 else [])), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0", 1), rows[4], rows[4], (101, None, None, None, None), (102, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(P.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows)
    once = stages["simhash_dedup"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in once.collect()) == [*range(40), 101]
    kept = stages["decontamination"](spark, docs, str(tmp_path))
    assert kept.count() == len(rows) - 1 and kept.where("doc_id = 9").count() == 0
    mixed = stages["source_mix"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.where("text is null or text = ''").count() == 0
    assert stages["token_output"](spark, docs, str(tmp_path)).count() == len(rows)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_stages_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    item = [f"q{i}" for i in range(12)]
    clash = ["rows", "copies", "_id", "_copy", "_key", "key", "row", "wanted", "hit", "n", "taken", "id", "label", "score", "a.b", "col"]
    texts = [" ".join([f"w{rng.randrange(3000)}" for _ in range(60)] + (item if i == 9 else [])) for i in range(30)]
    texts += [texts[3], " ".join(f"long{i % 9973}" for i in range(200_000)), None]
    rows = [(i, t, "en", f"s{i % 2}", 1, *(f"{c}-{i}" for c in clash)) for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    docs = spark.createDataFrame(rows, kinds)
    spark.createDataFrame([(i, 1, int(i == 29)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in P.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        kept[name] = found.collect()
        assert all(list(r)[5:] == [f"{c}-{r.doc_id}" for c in clash] and r.text == texts[r.doc_id] for r in kept[name]), name
    assert sorted(r.doc_id for r in kept["simhash_dedup"]) == [i for i in range(33) if i != 30]
    assert sorted(r.doc_id for r in kept["decontamination"]) == [i for i in range(33) if i != 9]
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_pipeline_stages_leave_little_behind(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    rng = random.Random(10)
    item = [f"q{i}" for i in range(12)]
    rows = [(i, " ".join([f"w{rng.randrange(3000)}" for _ in range(60)] + (item if i == 9 else [])), f"s{i % 2}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(i, 1, int(i == 29)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    made = []
    monkeypatch.setattr(P, "Workspace", lambda *a: made.append(Workspace(*a)) or made[-1])
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    left = {}
    for name, stage in P.STAGES:
        found = stage(spark, docs, str(tmp_path))
        fs, path = made[-1]._folder()
        left[name] = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
        assert found.count(), name
    assert left == {"toxicity": [], "simhash_dedup": ["kept"], "decontamination": ["found"], "source_mix": ["keys"], "token_output": ["tokens"]}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    # Workers get long texts a few at a time.
    long = spark.range(20).coalesce(1).selectExpr("repeat('word ', 100000) as text")
    assert long.mapInArrow(lambda batches: (x.select(["text"]).slice(0, 0) if x.nbytes < 3 << 20 else x.slice(0, 1) for x in batches), "text string").count() == 0


def test_plan_of_a_mix_starts_no_other_workers(spark):
    plan = [("a", 5, 2.5, 0, 3), (None, 7, 7.0, 1, 0)]
    got = mixing.plan_table(spark, plan)
    assert got.collect() == plan and "PythonRDD" not in got._jdf.queryExecution().toRdd().toDebugString()
    assert got.dtypes == [("source", "string"), ("source_size", "bigint"), ("target", "double"), ("passes", "int"), ("rest", "bigint")]
    assert mixing.plan_table(spark, []).collect() == []
