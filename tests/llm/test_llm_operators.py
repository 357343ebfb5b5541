"""Each operator against a plain formulation, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lexiloom.llm import decontamination, html_wrappers, media, packing, pii, quality, repeats, simhash, suffix_dedup, token_files, tokens, word_windows
from lexiloom.llm.common import scratch_path

DDL = "doc_id long, text string, k long, t string, u long, fp long"  # columns that clash with the operators' own


def texts():
    rnd = random.Random(5)
    words = ["the", "of", "Haus", "élan", "x1", "a", "mot", "Über", "zz", "naïve", "b-c", "=", "10.0.0.1"]
    long = [rnd.choice(words) for _ in range(9000)]
    passage = " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(40))
    out = [None, "", " ", "one", " ".join(long), " ".join(long[:500]) + " end", passage, "pre " + passage + " post", passage + "\n" + passage, "ab" * 400, "ab" * 300 + "c", "x" * 99, "x" * 100, "x" * 101, "é" * 120, "a\tb\x0bc  d\n\n e"]
    out += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(30)]
    return out + [out[6], out[4], out[20]]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], DDL)


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts(), 1))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


def empty(spark):
    return frame(spark, [(1, "x")]).where("doc_id = 0")


def test_tokenizers_agree_with_the_library():
    rnd, signs = random.Random(1), "aB 1\n'.,_é²́ 中\t\x01<|>s"
    odd = texts()[1:] + ["it's I'm", "<|endoftext|>x", "a\r\nb", "x \x01y"] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 20))) for _ in range(3000)]
    for name, mode in (("byte_bpe_50k.json", "prefix"), ("word_bpe_49k.json", "space")):
        t = tokens.load(tokens.tokenizer_path(name), mode)
        assert [x.tobytes() for x in t.encode(odd)] == [t._raw(x) for x in odd]


def test_packing(spark, docs, rows):
    t = tokens.load(tokens.tokenizer_path("byte_bpe_50k.json"), "prefix")
    got = {}
    packed = packing.pack_documents(docs).collect()
    for r in packed:
        got.setdefault(r.doc_id, []).append(r)
    total = 0
    for d, text in rows:
        ids = t._raw(text or "") + (2).to_bytes(4, "little")
        at = 0
        for i, r in enumerate(sorted(got[d], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            assert r.length == 1024 or i == 0
            at += r.length
        assert at == len(ids) // 4
        total += at
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= total // 1024 + 2
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plan_places_every_piece_once():
    need = np.zeros(1025, np.int64)
    rnd = np.random.default_rng(0)
    for size in rnd.integers(1, 1025, 4000):
        need[size] += 1
    plan = packing.make_plan(need)
    used = {}
    for size in np.flatnonzero(need):
        for s, o in zip(*plan.place(int(size), np.arange(need[size])), strict=True):
            used.setdefault(s, []).append((o, size))
    assert len(used) == plan.n_sequences and sum(map(len, used.values())) == need.sum()
    for b in used.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024
    least = -(-int((need * np.arange(1025)).sum()) // 1024)
    assert plan.n_sequences <= 1.02 * least + 1


def test_plan_comes_from_the_program():
    rnd = np.random.default_rng(1)
    need = np.zeros(1025, np.int64)
    for size in np.minimum(rnd.exponential(400, 8000).astype(int) + 1, 1024):
        need[size] += 1
    plan = packing.make_plan(need)
    plain = int(need[1024]) + sum(times for _, times in packing.best_fit_counts(np.where(np.arange(1025) < 1024, need, 0), 1024))
    assert plan.n_priced > (plan.n_sequences - need[1024]) / 2
    assert plan.bound <= plan.n_sequences <= min(plain, 1.005 * plan.bound + 1)


def test_token_files(spark, docs, rows):
    t = tokens.load(tokens.tokenizer_path("word_bpe_49k.json"), "space")
    shards = token_files.write_token_files(docs, scratch_path(spark, "t"), tokens.tokenizer_path("word_bpe_49k.json"), "space", 2, length=64)
    got = {r.doc_id: r for r in token_files.read_token_files(shards).collect()}
    at = 0
    for d, text in rows:
        ids = t._raw(text or "") + (2).to_bytes(4, "little")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    first = token_files.ShardReader(sorted(shards.collect(), key=lambda r: r.number)[0].shard)
    ids, mask = first.sequence(0)
    assert len(ids) == 64 and not ids.flags.owndata and not mask.flags.owndata and np.unpackbits(mask, bitorder="little")[0] == 1 and len(mask) == 8
    none = token_files.write_token_files(empty(spark), scratch_path(spark, "t"), tokens.tokenizer_path("word_bpe_49k.json"), "space", 2)
    assert token_files.read_token_files(none).count() == 0


def test_media(spark, docs, rows):
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    for d, text in rows:
        b = (text or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[7].feature == got[len(rows) - 2].feature
    assert media.text_media(empty(spark)).count() == 0


def test_image_formats(spark):
    rgb = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    assert (media.decode(media.encode_ppm(rgb)) == rgb).all()
    assert media.decode(b"P1 # c\n3 1\n101").ravel().tolist() == [0, 255, 0] and media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P2\n2 1\n9\n3 4").ravel().tolist() == [3, 4] and media.decode(b"P5 1 1 65535 \x01\x02").ravel().tolist() == [258]
    import struct

    rows = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" * (-21 % 4) for y in reversed(range(5)))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == rgb).all()
    x = np.random.default_rng(1).random((6, 9))
    assert np.allclose(media.area_resize(x, 3, 3), x.reshape(3, 2, 3, 3).mean((1, 3))) and np.isclose(media.area_resize(x, 4, 5).mean(), x.mean())
    df = spark.createDataFrame([(1, bytes(bmp)), (2, b"junk"), (3, None)], "id long, m binary")
    got = media.media_tiles(df, "id", "m", tile=4).collect()
    assert sum(r.k == 1 for r in got) == 4 and all(r.error for r in got if r.k > 1)


def brute_words(rows):
    first, out = {}, {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def brute_bytes(rows):
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            x = b[i : i + 100]
            if x in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(x)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y))
    return out


@pytest.mark.parametrize("limits", [None, (300, 300)])
def test_word_windows(spark, docs, rows, limits, monkeypatch):
    if limits:  # every full bucket is split by window
        monkeypatch.setattr(repeats, "BUCKET_BYTES", limits[0])
        monkeypatch.setattr(repeats, "HOT_BYTES", limits[1])
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in word_windows.remove_repeated_words(docs).collect()}
    assert got == brute_words(rows)
    if not limits:
        assert word_windows.remove_repeated_words(empty(spark)).count() == 0


@pytest.mark.parametrize("limits", [None, (300, 300)])
def test_byte_windows(spark, docs, rows, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(repeats, "BUCKET_BYTES", limits[0])
        monkeypatch.setattr(repeats, "HOT_BYTES", limits[1])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(docs).collect()}
    assert got == brute_bytes(rows)
    if not limits:
        assert suffix_dedup.remove_repeated_bytes(empty(spark)).count() == 0


def test_repeated_and_missing_ids(spark):
    a = " ".join(f"w{i}" for i in range(30))
    df = frame(spark, [(1, "solo"), (None, a), (2, a), (2, a + " more"), (2, a)])
    got = sorted((r.doc_id if r.doc_id is not None else 9, r.n_words, r.n_removed) for r in word_windows.remove_repeated_words(df).collect())
    assert [g[0] for g in got] == [1, 2, 2, 2, 9] and got[-1] == (9, 30, 30)
    assert sorted(g[2] for g in got if g[0] == 2) in ([0, 0, 30], [0, 30, 30])


def test_suffix_ranks():
    rnd = random.Random(3)
    for _ in range(300):
        s = [rnd.randint(1, rnd.choice([1, 2, 20])) for _ in range(rnd.randint(1, 60))]
        assert list(np.argsort(suffix_dedup.suffix_ranks(np.array(s), 1000), kind="stable")) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, rows):
    prints = {d: brute_fingerprint(t) for d, t in rows}
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    parts = brute_components(prints)
    assert found == {d: (prints[d], parts[d]) for d in prints}
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == set(parts.values())
    assert simhash.near_duplicates(empty(spark)).count() == 0
    twice = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q r s t u")])
    assert sorted((r.doc_id is None, r.text) for r in simhash.keep_one_of_each(twice).collect()) == [(False, "a b c"), (True, "q r s t u")]


def test_bit_sliced_links_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 20)
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << p for p in rnd.sample(range(64), rnd.randrange(7))) for b in base for _ in range(10)} | {rnd.getrandbits(8) for _ in range(100)}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    df = spark.createDataFrame([(s,) for s in signed], "fp long").cache()
    linked = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(df)).collect()}
    want = brute_components(signed)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({s: linked.get(s, s) for s in signed}) == groups(want)


def test_decontamination(spark, docs, rows, monkeypatch):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    items = [(1, rows[6][1]), (2, "ONE"), (3, None), (4, "the of Haus"), (1, rows[6][1]), (5, "!!"), (6, " ".join(rows[4][1].split()[100:130])), (None, rows[6][1][:150])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = {}
    for d, t in rows:
        w, hit, found = word.findall((t or "").translate(fold)), set(), set()
        for i, x in items:
            q = word.findall((x or "").translate(fold))
            n = min(10, len(q))
            windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add("" if i is None else str(i))
        want[d] = (len(w), len(hit), sorted(found))
    read = lambda df: {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in df.collect()}
    assert read(decontamination.contamination(docs, bench)) == want
    monkeypatch.setattr(decontamination.Benchmark.__init__, "__defaults__", ("item_id", "text", 10, 100))  # blocks in files
    assert read(decontamination.contamination(docs, bench)) == want
    kept = {r.doc_id for r in decontamination.remove_contaminated(docs, bench).collect()}
    assert kept == {d for d in want if want[d][1] == 0}
    best = {(r.item_id, r.item_start): r for r in decontamination.longest_matches(docs, bench).collect()}
    assert best["1", 0].length == len(word.findall(rows[6][1].translate(fold)))
    assert read(decontamination.contamination(docs, bench.where("item_id = 99"))) == {d: (w[0], 0, []) for d, w in want.items()}
    assert decontamination.contamination(empty(spark), bench).count() == 0


def test_quality(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + rnd.choice("abc") for _ in range(30))
    bad = lambda: " ".join(rnd.choice(["ALPHA", "BETA", "GAMMA"]) + "!!" for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(300, None), (301, "")]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.quality_scores(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all((got[i].score >= 0.7) == (i % 3 > 0) for i in range(300)) and 0 <= got[300].score == got[301].score <= 1
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} >= {i for i in range(300) if i % 3}
    none = quality.train(docs, labels.where("doc_id < 0"))
    assert quality.quality_scores(docs, none).select("score").distinct().count() == 1
    assert quality.quality_scores(empty(spark), model).count() == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def test_base_spans():
    rnd = random.Random(6)
    parts = ["a.b@c.de", "@", "x@y", "a@b@c.d.e", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4539578763621486", "4539 5787-6362 1486", "+1 (988) 555-2485", "+12", "é", " ", "-", ".", "7", "+", "%"]
    for text in ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))) for _ in range(3000)] + ["1" * 5000, "a" * 100_000 + "@", "+" * 100]:
        want = [(k, m.start(), m.end()) for k, rx, ok in BASE for m in (re.finditer(rx, text) if len(text) < 50_000 else []) if ok(m.group())]
        assert pii.base_spans(text) == want, text


def test_bootstrap_finds_other_forms(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(40)]
    rows = [(i, f"hello {n} mail: user{n}@host{n}.org thanks and more") for i, n in enumerate(names)] + [(50, "hello z mail: user[at]example thanks and more"), (51, "nothing 12 here"), (52, None)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[50].base == [] and got[50].added == ["email:14:29"] and got[51].added == [] and got[52].base == []
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(frame(spark, rows)).collect()}
    assert masked[50] == "hello z mail: <EMAIL> thanks and more" and masked[0] == "hello aa mail: <EMAIL> thanks and more" and masked[52] is None
    assert pii.personal_data(empty(spark)).count() == 0


PAGE = "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Title {n}</h1><p><b>First&amp; {n}<br>line<p>Second\n  text{n}</p><ul><li>one<li>two</ul><div class='comments'><p>nice</p></div><aside>x</aside></article><footer>(c)</footer>"


def test_main_text(spark):
    want = "Title 3\n\nFirst& 3 line\n\nSecond text3\n\none\n\ntwo"
    assert html_wrappers.main_text(PAGE.replace("{n}", "3")) == want
    plain = "<body><div id=top>Site</div><div><p>Body text number {n} of some length</p><p>Fixed line</p></div><div>foot</div></body>"
    rows = [(i, f"http://a.org/{i}", PAGE.replace("{n}", str(i)), 1) for i in range(5)] + [(10 + i, "http://b.org/x", plain.replace("{n}", str(i)), 1) for i in range(4)] + [(20, None, None, 1), (21, "u", "", 1), (22, "http://c.org", "<p>a < b & c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = {r.page_id: r.text for r in html_wrappers.main_texts(df).collect()}
    assert got[3] == want and got[12] == "Body text number 2 of some length" and got[20] == got[21] == "" and got[22] == "a < b & c"
    w = html_wrappers.align(html_wrappers.expression(html_wrappers.parse(PAGE.replace("{n}", "1"))), html_wrappers.expression(html_wrappers.parse(PAGE.replace("{n}", "2").replace("<p>Second", "<table></table><p>Second"))))
    text = html_wrappers.union_free_expression(json.loads(json.dumps(w)))
    assert "#" in text and "<table></table>?" in text and "</li>+" in text
    assert html_wrappers.main_texts(df.where("page_id < 0")).count() == 0
    assert html_wrappers.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_main_text_wrapper_decides_articles(spark):
    inside = "<body><article><h1>Title {n}</h1><div class=box>Read our paper every day</div><p>Body text number {n} here</p><ul><li>one<li>two</ul></article></body>"
    plain = "<body><div id=top>Site name</div><p>Plain text number {n} here</p><div>All rights kept</div></body>"
    outside = "<body><article>Teaser {n}</article><div class=strap>Strap line</div><section><p>The long story number {n}, told from its beginning to its end</p></section></body>"
    rows = [(i, "http://mixed.org/x", inside.replace("{n}", str(i))) for i in range(4)] + [(10 + i, "http://mixed.org/y", plain.replace("{n}", str(i))) for i in range(4)]
    rows += [(20, "http://one.org/x", inside.replace("{n}", "1"))] + [(30 + i, "http://one.org/y", plain.replace("{n}", str(i))) for i in range(4)]
    rows += [(40 + i, "http://teaser.org/y", outside.replace("{n}", str(i))) for i in range(4)]
    got = {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[2] == "Title 2\n\nBody text number 2 here\n\none\n\ntwo"
    assert got[12] == got[32] == "Plain text number 2 here"
    assert got[20].startswith("Title 1\n\n")
    assert got[42] == "The long story number 2, told from its beginning to its end"


def test_main_text_template_in_spite_of_odd_pages(spark):
    plain = "<body><div id=top>Site name</div><p>Plain text number {n} here</p><div>All rights kept</div></body>"
    inside = "<body><article><h1>Title {n}</h1><div class=box>Read our paper every day</div></article></body>"
    rows = [(100 * h + i, f"http://{host}/x", page.replace("{n}", str(i))) for h, (host, page) in enumerate((("a.org", plain), ("b.org", inside), ("c.org", plain))) for i in range(2 if host == "c.org" else 9)]
    rows += [(h + i, f"http://{host}/x", page) for h, host in ((50, "a.org"), (150, "b.org")) for i, page in enumerate((None, "", " ", "<h2>Error 404</h2>"))]
    rows += [(300 + i, "http://copies.org/x", plain.replace("{n}", "7")) for i in range(5)]
    got = {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(9)] == [f"Plain text number {i} here" for i in range(9)]
    assert [got[100 + i] for i in range(9)] == [f"Title {i}" for i in range(9)]
    assert got[201] == "Plain text number 1 here"  # two pages show a template as more do
    assert [got[i] for i in (50, 51, 52, 53, 153)] == ["", "", "", "Error 404", "Error 404"]
    assert {got[300 + i] for i in range(5)} == {"Site name\n\nPlain text number 7 here\n\nAll rights kept"}  # one page, whatever its copies


def test_main_text_below_any_depth(spark):
    for n in (60, 5000):
        deep, end = "<div>" * n, "</div>" * n
        page = f"<html><body><div><article>{deep}<nav>menu</nav><div class=ad>buy</div><p>deep</p>{end}<p>tail</p></article></div></body></html>"
        assert html_wrappers.main_text(page) == "deep\n\ntail"
        rows = [(i, "http://a.org/x", page.replace("tail", f"tail {i}")) for i in range(3)]
        got = {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: f"tail {i}" for i in range(3)}
    n = 200_000  # neither the open elements nor unmatched end tags are searched one by one
    assert html_wrappers.main_text("<b>" * n + "<ul></x>" * n + "text") == "text"


def test_prose_with_words_of_asides_in_its_class_stays():
    page = '<article><h1>T</h1><p class="alert-text">one</p><p id="header-2">two</p><p class="advert">buy</p><div class="ad-slot">buy</div></article><article class="teaser">more</article>'
    assert html_wrappers.main_text(page) == "T\n\none\n\ntwo"


def test_template_hash_is_wide():
    # Two texts of the same 32-bit checksum are different texts.
    assert html_wrappers.text_hash("plumless") != html_wrappers.text_hash("buckeroo") and zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")


def test_clashing_names_in_stages(spark):
    ddl = "doc_id long, text string, _key string, _added string, _d long, _h string, _same string, _kept long, _hash long"
    rows = [(1, "write to a@b.org now", "k", "a", 5, "h", "s", 7, 8), (2, "write to a@b.org now", "k", "a", 5, "h", "s", 7, 8), (3, None, None, None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, ddl)
    masked = {r.doc_id: r for r in pii.mask_personal_data(docs).collect()}
    assert masked[1].text == "write to <EMAIL> now" and masked[1]._key == "k" and masked[1]._added == "a" and masked[3].text is None
    kept = simhash.keep_one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and {r._same for r in kept} == {"s", None}


def test_training_reads_each_labelled_id_once(spark):
    docs = spark.createDataFrame([(d, ("good text " if d % 2 else "junk $$ ") * 5 + str(d % 7)) for d in range(1, 41)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 41)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(7), labels)
    texts = ["good text good", "junk $$ junk", ""]
    assert model.scores(texts).tolist() == again.scores(texts).tolist()
