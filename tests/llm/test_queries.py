"""The registered opN_ queries on a small folder of tables, against plain formulations of their contracts."""

import hashlib
import itertools
import re
import zlib

import pytest
import xxhash

from lexiloom.llm import queries, tokens

TEXTS = [
    None, "", " ", "a", "Ünï  code\twords", "same words here again", "same words here again", "mail a.b@c.org or +33 1 23 45 67 89, ip 10.1.2.3, card 4111 1111 1111 1111",
    " ".join(f"w{i % 40}" for i in range(3000)), " ".join(f"w{i % 40}" for i in range(200)), "x" * 250 + "y" * 120, "z" + "y" * 120, "the quick brown fox jumps over the lazy dog again and again today",
    "pre the quick brown fox jumps over the lazy dog again and again today post", "THE QUICK brown fox",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs = [(i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, "the quick brown fox"), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i + 1, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    pages = [(1, "http://h/a", "<p>a &amp;  b</p><p>c</p>"), (1, "http://h/a", "<p>a &amp;  b</p><p>c</p>"), (2, None, None), (3, "http://k/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: queries.queries()[name](spark, folder).collect()


def whole(name):
    t = tokens.load(tokens.tokenizer_path(name), "prefix" if name.startswith("byte") else "space").tokenizer
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in TEXTS]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_op1(run):
    rows = run("op1_html_extraction")
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows) == [(1, "a & b\n\nc", 8), (1, "a & b\n\nc", 8), (2, "", 0), (3, "", 0)]


def test_op2(run):
    got, seen = {r.doc_id: r for r in run("op2_suffix_dedup")}, set()
    for i, text in enumerate(TEXTS, 1):
        b, gone = (text or "").encode(), set()
        for s in range(len(b) - 99):
            window = b[s : s + 100]
            if window in seen:
                gone.update(range(s, s + 100))
            seen.add(window)
        spans = sum(1 for j in gone if j - 1 not in gone)
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op3(run):
    rows, ids = run("op3_best_fit_packing"), whole("byte_bpe_50k.json")
    by_doc = {i: sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece) for i in range(1, len(TEXTS) + 1)}
    for i, pieces in by_doc.items():
        at = 0
        for n, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, crc(ids[i - 1][at : at + r.length])) and (r.length == 1024 or n == 0)
            at += r.length
        assert at == len(ids[i - 1])
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_op4(run):
    rows = run("op4_quality_classifier")
    assert sorted(r.doc_id for r in rows) == list(range(1, len(TEXTS) + 1))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op5(run):
    got = {r.doc_id: r for r in run("op5_personal_data")}
    text, places = TEXTS[7], []
    for kind, pattern in (("email", r"a\.b@c\.org"), ("ip", r"10\.1\.2\.3"), ("card", r"4111 1111 1111 1111"), ("phone", r"\+33 1 23 45 67 89")):
        m = re.search(pattern, text)
        places.append(f"{kind}:{m.start()}:{m.end()}")
    r = got[8]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(",".join(places).encode()).hexdigest() and r.spans == ",".join(places)
    assert all(got[i].base_sha256 == hashlib.sha256(b"").hexdigest() and got[i].spans == "" for i in (1, 2, 3, 4, 6, 9))


def test_op6(run):
    def fingerprint(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in enumerate(TEXTS, 1)}
    least = {i: i for i in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                least[a] = least[b] = min(least[a], least[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run("op6_simhash")}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in prints}


def test_op7(run):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    item = words("the quick brown fox")
    for r in run("op7_decontamination"):
        w = words(TEXTS[r.doc_id - 1])
        hit = {j for s in range(len(w)) if w[s : s + len(item)] == item for j in range(s, s + len(item))}
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), int(bool(hit)), bool(hit))
        assert r.items_sha256 == hashlib.sha256(b"1" if hit else b"").hexdigest()


def test_op8(run):
    ids, at = whole("word_bpe_49k.json"), 0
    got = {r.doc_id: r for r in run("op8_token_ids")}
    for i, x in enumerate(ids, 1):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(x), crc(x))
        at += len(x)


def test_op9(run):
    got, first = {r.doc_id: r for r in run("op9_substring_dedup")}, {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(TEXTS, 1)}
    for i, w in split.items():
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    for i, w in split.items():
        gone = {j for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for j in range(s, s + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op10(run):
    got = {r.doc_id: r for r in run("op10_media_columns")}
    for i, text in enumerate(TEXTS, 1):
        b = (text or "").encode()
        payload = b + b" " * (-len(b) % 192 if b else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > len(payload) and len(r.media_sha256) == 64
    assert got[6].media_sha256 == got[7].media_sha256 and got[6].feature == got[7].feature and got[6].feature != got[9].feature
