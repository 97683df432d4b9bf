"""Every opN query on the smallest tables against independent code."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontamination, licenses, secret_scan, sharding, simhash_dedup, sketches, wrapper

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def result(query, spark, key="doc_id"):
    df = query(spark, DATA)
    rows = df.collect()
    return df.columns, {r[key]: r for r in rows}, rows


# ── Secrets ──

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def rule_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token):
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        symbols, plain = "0123456789abcdef", token.lower()
    elif re.fullmatch("[A-Z2-7]+", token):
        symbols, plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", token
    elif re.fullmatch("[a-z0-9]+", token):
        symbols, plain = "abcdefghijklmnopqrstuvwxyz0123456789", token
    elif token.isalnum():
        symbols, plain = ALNUM, token
    else:
        symbols, plain = ALNUM + "+/", token.replace("-", "+").replace("_", "/")
    n, size = len(plain), len(symbols)
    chi, df = size / n * sum(c * c for c in Counter(plain).values()) - n, size - 1
    chi_p = tail(((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    at = [symbols.index(c) for c in plain]
    high = [2 * v >= size for v in at]
    ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 2 * ones * (n - ones) / n + 1
    runs_p = 0.5 ** (n - 1)
    if 0 < ones < n:
        spread = math.sqrt((mean - 1) * (mean - 2) / (n - 1))
        runs_p = 2 * tail(abs(runs - mean) / spread) if spread else 1.0
    off = [v - sum(at) / n for v in at]
    own = sum(v * v for v in off)
    serial_p = 2 * tail(abs(sum(a * b for a, b in zip(off, off[1:], strict=False)) / own * math.sqrt(n))) if own else 0.0
    kind = lambda c: "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "sign"
    of_alphabet = Counter(map(kind, symbols)).values()
    two, three = sum((v / size) ** 2 for v in of_alphabet), sum((v / size) ** 3 for v in of_alphabet)
    alike = sum(kind(a) == kind(b) for a, b in zip(plain, plain[1:], strict=False))
    class_p = tail((alike - (n - 1) * two - 0.5) / math.sqrt((n - 1) * two * (1 - two) + 2 * (n - 2) * (three - two * two)))
    return min(1.0, 4 * min(chi_p, runs_p, class_p, serial_p))


def tokens_of(t):
    for m in re.finditer("[A-Za-z0-9+/_-]{16,}", t):
        mixed = re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0])
        if mixed or len(m[0]) >= 20 and re.search("[a-z][^A-Za-z]*[A-Z]", m[0]):
            yield m.start(), m.end(), m[0]


def brute_secrets(texts):
    """All spans of each text."""
    tokens = [(d, a, b, sum(b - a >= x for x in secret_scan.BANDS), battery(s)) for d, t in texts.items() for a, b, s in tokens_of(t)]
    cells = [min(800, math.floor(-math.log10(max(p, 1e-300)) / 0.05)) for *_, p in tokens]
    limit = {}
    for band in {t[3] for t in tokens}:
        mine = sorted((c for c, t in zip(cells, tokens, strict=True) if t[3] == band), reverse=True)
        good = [c for c in set(mine) if 10 ** (-c * 0.05) <= 0.05 * sum(x >= c for x in mine) / len(mine)]
        limit[band] = min(good, default=801)
    spans = {d: rule_spans(t) for d, t in texts.items()}
    for (d, a, b, band, _), c in zip(tokens, cells, strict=True):
        if c < limit[band]:
            spans[d].append((a, 3, b))
    kinds = ("assign", "access", "hex", "random")
    return {d: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(s)) for d, s in spans.items()}


def test_secrets(spark, texts):
    columns, rows, _ = result(secret_scan.op1_secret_scan, spark)
    assert columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and set(rows) == set(texts)
    want = brute_secrets(texts)
    for d, t in texts.items():
        base = sorted(rule_spans(t))
        assert (rows[d].n_assign, rows[d].n_access, rows[d].n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert rows[d].base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and rows[d].spans == want[d]


def test_battery_finds_what_is_random(spark):
    """Planted tokens of four encodings, and slugs, paths, identifiers and file names beside them."""
    import random

    rng = random.Random(1)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALNUM, ALNUM + "+/"]
    words = "report final summer budget review draft meeting project client invoice annual quarter photo holiday backup window server config update readme".split()
    planted = {i: "".join(rng.choices(alphabets[i % 4], k=rng.randint(24, 64))) for i in range(400)}
    planted = {i: t for i, t in planted.items() if re.search("[0-9]", t) and re.search("[A-Za-z]", t)}
    dull = {}
    for i in range(1000, 1400):
        some = rng.sample(words, 4)
        dull[i] = ["-".join(some) + f"-{rng.randint(1, 99)}", "/".join(some) + f"/{rng.randint(2000, 2030)}", "_".join(some) + f"_v{rng.randint(1, 9)}", some[0] + "".join(w.title() for w in some[1:]) + str(rng.randint(1, 9))][i % 4]
    texts = {**{i: f"key {t} here" for i, t in planted.items()}, **{i: f"see {t} there" for i, t in dull.items()}}
    out = secret_scan.scan_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id", secret_scan.span_text(F.col("spans")).alias("s")).collect()
    found = {r.doc_id: r.s for r in out}
    assert found == brute_secrets(texts)
    assert sum(bool(found[i]) for i in planted) >= 0.9 * len(planted)
    assert sum(bool(found[i]) for i in dull) <= 0.02 * len(dull)  # of runs of letters, digits and signs there are too few


# ── Benchmark items ──


def best_windows(texts, items, similarity=0.8):
    """For each document and item the highest weighted similarity of any window of the item's length."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    words = {i: cut(t) for i, t in items.items() if cut(t)}
    shingles = {i: grams(w, min(5, len(w))) for i, w in words.items()}
    distinct = {tuple(w) for w in words.values()}
    have = Counter(g for w in distinct for g in set(grams(list(w), min(5, len(w)))))
    weigh = lambda c: sum(n * math.log(1 + len(distinct) / have.get(g, 1)) for g, n in c.items())
    at = defaultdict(set)
    for i, s in shingles.items():
        for g in s:
            at[g].add(i)
    out = {}
    for d, t in texts.items():
        w = cut(t)
        for i in {i for k in range(1, 6) for g in set(grams(w, k)) for i in at.get(g, ()) if len(shingles[i][0]) == k}:
            own, k, n = Counter(shingles[i]), min(5, len(words[i])), len(words[i])
            # Every place inside the document, and those cut off at its ends on a diagonal or between neighbouring ones.
            diagonals = sorted({p - q for p, g in enumerate(grams(w, k)) for q, h in enumerate(shingles[i]) if g == h})
            cut_off = {b for x, y in zip(diagonals, diagonals[1:], strict=False) if y - x <= n for b in range(x, y)} | set(diagonals)
            for b in cut_off | set(range(max(1, len(w) - n + 1))):
                part = Counter(grams(w[max(b, 0) : b + n], k))
                both = weigh(part & own)
                score = both / (weigh(part) + weigh(own) - both)
                if score >= similarity - 1e-12 and score > out.get((d, i), 0):
                    out[d, i] = score
    return out


def same_leaks(rows, want):
    assert {(r.doc_id, r.item_id) for r in rows} == set(want)
    for r in rows:
        assert r.similarity == pytest.approx(want[r.doc_id, r.item_id]) and 0 <= r.hamming <= 64


def test_benchmark_items(spark, texts):
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    columns, _, rows = result(decontamination.op2_benchmark_decontamination, spark)
    assert columns == ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"] and rows
    same_leaks(rows, best_windows(texts, items))


def test_edited_items(spark):
    import random

    rng = random.Random(2)
    items = {i: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 12, 40, 80]))) for i in range(60)}
    items[60] = "a b c " * 10  # shingles that repeat
    docs = {}
    for i in range(240):
        words = items[rng.randrange(61)].split()
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(words))
            words[p : p + rng.randint(0, 1)] = [f"new{i}"] * rng.randint(0, 2)
            words = words or ["x"]
        docs[i] = " ".join(["before"] * rng.randint(0, 3) + words[rng.choice([0, 0, 1]) :] + ["after"] * rng.randint(0, 2))
    frames = (spark.createDataFrame(list(x.items()), f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))
    same_leaks(decontamination.find_leaks(*frames).collect(), best_windows(docs, items))


# ── Licences ──


def test_license_phrases(spark, texts):
    columns, rows, _ = result(licenses.op4_license_scan, spark)
    assert columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and set(rows) == set(texts)
    phrases = [("mit license".split(), "mit"), ("apache license".split(), "apache"), ("general public license".split(), "gpl")]
    for d, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        at = [(i, label) for i in range(len(w)) for p, label in phrases if w[i : i + len(p)] == p]
        places, labels = [i for i, _ in at], {label for _, label in at}
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | set() and 0 <= r.score <= 1


# ── Shards ──


def test_shards(spark, texts):
    columns, rows, every = result(sharding.op5_shard_shuffle, spark)
    assert columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(every) == len(texts)
    slots = defaultdict(list)
    for r in every:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(40)) <= 1


# ── Pages ──


class Article(HTMLParser):
    """Blocks of the article but what is marked as something else, read event by event."""

    BLOCKS = set("article p h1 h2 h3 h4 h5 h6 li ul ol div section blockquote pre table tr td th figure figcaption".split())
    VOID = set("br img hr input meta link".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.parts = [], [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.out.append(text)
        self.parts = []

    def inside(self):
        return any(t == "article" for t, _ in self.open) and not any(dull for _, dull in self.open)

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in self.BLOCKS:
            self.flush()
            if any(t == "p" for t, _ in self.open):
                while self.open.pop()[0] != "p":
                    pass
        words = re.split("[^a-z0-9]+", " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower())
        dull = tag in ("script", "style", "nav", "aside", "form", "header", "footer") or not wrapper._CLASSES.isdisjoint(words)
        if dull:
            self.flush()
        self.open.append((tag, dull))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            if tag in self.BLOCKS or self.open[-1][1]:
                self.flush()
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.inside():
            self.parts.append(data)


def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    columns, rows, _ = result(wrapper.op6_html_extraction, spark, "page_id")
    assert columns[:4] == ["page_id", "url", "text", "n_chars"] and len(rows) == len(pages)
    for p in pages:
        r = rows[p.page_id]
        assert r.url == p.url and r.n_chars == len(r.text) and r.text == "\n\n".join(Article(p.html or "").out)


# ── Byte pairs, SimHash, fingerprints ──


def test_byte_pairs(spark, texts):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    columns, rows, _ = result(bpe.op8_byte_bpe, spark)
    assert columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and set(rows) == set(texts)
    for d, t in texts.items():
        ids = encoding.encode_ordinary(t)
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == want


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark, texts):
    columns, rows, _ = result(simhash_dedup.op9_simhash_near_dedup, spark)
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"] and set(rows) == set(texts)
    fps = {d: plain_simhash(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for d in ids:
        assert (rows[d].fingerprint, rows[d].component_id) == (f"{fps[d]:016x}", find(d))


def plain_sketch(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in re.split(r"[ \t\n\x0B\f\r]+", text.lower()) if x]
    hashes = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        hashes.add(h >> 32)
    return (1, hashes) if len(hashes) <= 128 else (8, {h for h in hashes if h < (1 << 32) // 8})


def likeness(a, b):
    scale = max(a[0], b[0])
    x, y = ({h for h in s[1] if s[0] == scale or h < (1 << 32) / scale} for s in (a, b))
    return len(x & y) / len(x | y) if x or y else float(a == b)


def test_fingerprints(spark, texts):
    columns, rows, _ = result(sketches.op10_document_fingerprints, spark)
    assert columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and set(rows) == set(texts)
    ids = sorted(texts, reverse=True)
    shown = lambda s: f"{s[0]}:" + "".join(f"{h:08x}" for h in sorted(s[1]))
    for d, following in zip(ids, ids[1:] + ids[:1], strict=True):
        t, u = texts[d], texts[following]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        own, other, next_ = plain_sketch(t), plain_sketch(edited), plain_sketch(u)
        r = rows[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other))
        assert r.near_edited == pytest.approx(likeness(own, other)) and r.near_next == pytest.approx(likeness(own, next_))
