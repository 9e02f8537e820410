"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarrylex.llm import chunks, components, decontaminate, embeddings, language, minhash, packing, pii, quality, secrets, toxicity
from quarrylex.llm.base import slices, words
from quarrylex.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x", None, "s", 1), (4, "same text of six words here", "en", "s", 27), (5, "same text of six words here", "en", "s", 27), (5, "same text of six words here", "en", "s", 27), (6, "1 2 3 ... !!", "en", "s", 12), (7, "Ünïcödé 中文 \U0001f600 text", "fr", None, 20), (8, "word " * 20_000, "en", "s", 100_000)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def texts(spark, values):
    return frame(spark, [(i, v, "en", "s", len(v or "")) for i, v in enumerate(values)])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def all_operators(spark, d):
    label = frame(spark, [(3, 1, 0), (4, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    bench = frame(spark, [(1, "same text of six words here"), (2, None), (3, "")], "item_id long, text string")
    return {
        "quality": lambda: quality.classify(d, label), "language": lambda: language.identify(d), "minhash": lambda: minhash.near_duplicates(d), "toxicity": lambda: toxicity.score(d, label),
        "decontaminate": lambda: decontaminate.report(d, bench), "chunks": lambda: chunks.repeats(d), "pii": lambda: pii.find(d), "packing": lambda: packing.pack(packing.pieces(d)), "secrets": lambda: secrets.scan(d),
    }


NAMES = ["quality", "language", "minhash", "toxicity", "decontaminate", "chunks", "pii", "packing", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, name):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that clash."""
    from pyspark.sql import functions as F

    d = frame(spark, AWKWARD).withColumns({"score": F.lit("x"), "bucket": F.lit(1), "n": F.lit(2), "y": F.lit(3), "rep": F.lit(4), "words": F.lit("w"), "g": F.lit(5)})
    rows = all_operators(spark, d)[name]().collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    assert all_operators(spark, frame(spark, []))[name]().collect() == []


# --- shared scanning -----------------------------------------------------------------------------------------------------


def test_words_equal_a_pattern():
    values = ["The É-quick 12 brown", "", "a", "naïve\tb", "--", "last"]
    pattern = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    (s,) = slices(pa.array(values))
    starts, ends, hashes = words(s)
    low = bytes(s.data)
    assert [low[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for v in values for w in pattern.findall(v)]
    (t,) = slices(pa.array(["xx THE yy the", "The"]))
    h = words(t)[2]
    assert h[1] == h[3] == h[4] and len(set(h.tolist())) == 3


# --- 1, 2, 4: learned scores -----------------------------------------------------------------------------------------------


def test_quality_keeps_clean_documents(spark):
    path = "/root/testdata/sf0.01"
    d, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality.classify(d, known).join(known, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [r for r in held if r["quality"] == 1], [r for r in held if r["quality"] == 0]
    assert np.mean([r["keep"] for r in good]) >= 0.95 and np.mean([not r["keep"] for r in bad]) >= 0.7


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.99


def test_language_code_lengths_equal_a_plain_model():
    """The machine's bits are those of a direct walk down the contexts with escapes and exclusion."""
    rng = random.Random(5)
    train = ["".join(rng.choices("abc ", [5, 3, 2, 4], k=300)).encode() for _ in range(3)]
    counts: dict[bytes, dict[int, int]] = {}
    grams = []
    for t in train:
        padded = bytes(language.ORDER) + t
        for i in range(language.ORDER, len(padded)):
            before, b = padded[i - language.ORDER : i], padded[i]
            grams.append(int.from_bytes(before, "big") << 8 | b)
            for k in range(language.ORDER + 1):
                ctx = before[language.ORDER - k :]
                counts.setdefault(ctx, {}).setdefault(b, 0)
                counts[ctx][b] += 1
    gram, n = np.unique(np.asarray(grams, np.int64), return_counts=True)
    model = language.fit(["x"], np.asarray(["x"] * len(gram), object), gram, n, 10_000, 1)

    def bits(history: bytes, b: int) -> float:
        out, excluded = 0.0, set()
        for k in range(min(language.ORDER, len(history)), -1, -1):
            ctx = history[len(history) - k :]
            if ctx not in counts:
                continue
            left = {s: c for s, c in counts[ctx].items() if s not in excluded}
            total, kinds = sum(left.values()), len(left)
            if b in left:
                return out - np.log2(left[b] / (total + kinds))
            if kinds:
                out -= np.log2(kinds / (total + kinds))
            excluded |= set(counts[ctx])
        return out + np.log2(256 - len(counts[b""]))

    text = b"abca bcq aab"
    want = sum(bits(text[max(0, i - language.ORDER) : i], text[i]) for i in range(len(text)))
    got = model.code_lengths(np.frombuffer(text + text, np.uint8), np.asarray([0, len(text), 2 * len(text)]))
    assert np.allclose(got[:, 0], want, atol=1e-3)


def test_toxicity_finds_words_and_sentences(spark):
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(40)]
    rows, labelled = [], []
    for i in range(400):
        sents = [" ".join(rng.choices(plain, k=8)) for _ in range(4)]
        bad = i % 4 == 0
        if bad:
            sents[2] = "you " + rng.choice(["grumbrat", "snarkfool"]) + " there"
        rows.append((i, ". ".join(sents) + ".", "en", "s", 1))
        labelled.append((i, 1, int(bad)))
    d, known = frame(spark, rows), frame(spark, labelled, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(d, known).collect()}
    assert all(out[i]["predicted"] == int(i % 4 == 0) for i in range(400) if out[i]["held_out"])
    assert "grumbrat" in rows[0][1][out[0]["worst_start"] : out[0]["worst_end"]] or "snarkfool" in rows[0][1][out[0]["worst_start"] : out[0]["worst_end"]]
    model = toxicity.train(d, known)
    found = toxicity.offending(rows[4][1], model)
    assert len(found) == 1 and rows[4][1][found[0][0] : found[0][1]].startswith("you ")


# --- 3: near-duplicates ----------------------------------------------------------------------------------------------------


def brute_similarity(a: str, b: str) -> float:
    def bag(t):
        w = re.findall(r"[0-9a-z]+", t.lower())
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        return {g: grams.count(g) for g in grams}

    x, y = bag(a), bag(b)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x if d in y)


def corpus(seed=1, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(500)]
    out = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([4, 60, 120]))
        if g % 4 == 0:
            base = base + base[:30]  # repeated shingles
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 4) * len(w) // 100 + (c % 3 == 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out


def test_probability_jaccard():
    for a, b in itertools.combinations(corpus(3, 4, 5), 2):
        sets = []
        for t in (a, b):
            h, o, _, _ = minhash.shingles(next(slices(pa.array([t]))))
            h, _, w = minhash.weighted(h, o)
            sets.append((h, w))
        assert abs(minhash.probability_jaccard(*sets) - brute_similarity(a, b)) < 1e-9


def test_signatures_estimate_similarity():
    a, b = " ".join(f"a{k}" for k in range(400)), " ".join(f"a{k}" for k in range(40, 400))
    s = next(slices(pa.array([a, b])))
    h, o, w = minhash.weighted(*minhash.shingles(s)[:2])
    sig = minhash.signatures(h, o, w, 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - brute_similarity(a, b)) < 0.05


def test_near_duplicates_equal_all_pairs(spark):
    values = corpus() + corpus()[:5] + ["", "t1 t2 t3 t4", "t1 t2 t3 t4"]
    root = list(range(len(values)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in itertools.combinations(range(len(values)), 2):
        if brute_similarity(values[i], values[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(texts(spark, values)).collect()}
    assert got == {i: find(i) for i in range(len(values))}


def test_tile_links_equal_all_pairs():
    values = corpus(7, 6, 6)
    found = minhash.tile_links(np.arange(len(values)), np.arange(len(values)), pa.array(values), 0.8, columns=64)
    joined = {i: {i} for i in range(len(values))}
    for pairs in (found, [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if brute_similarity(values[i], values[j]) >= 0.8]):
        comp = {i: {i} for i in joined}
        for a, b in pairs:
            both = comp[a] | comp[b]
            for x in both:
                comp[x] = both
        if pairs is found:
            first = {i: min(c) for i, c in comp.items()}
    assert first == {i: min(c) for i, c in comp.items()}


@pytest.mark.parametrize("way", ["one task", "stars"])
def test_components(spark, way):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    links = frame(spark, pairs, "a long, b long")
    root = {x: x for p in pairs for x in p}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = components.components(links) if way == "one task" else components.star_components(links)
    got = {r["node"]: r["root"] for r in df.collect()}
    assert all(got.get(x, x) == find(x) for x in root)


# --- 5: decontamination ----------------------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(60)] + ["É", "é", "Word"]
    items = [(1, " ".join(rng.choices(vocabulary, k=30))), (2, "Short item É here"), (3, ""), (4, None), (10, " ".join(rng.choices(vocabulary, k=13)))]
    items.append((5, items[0][1]))
    values = []
    for k in range(40):
        w = rng.choices(vocabulary, k=rng.randrange(0, 200))
        if k % 3 == 0:
            part = items[rng.choice([0, 1, 4])][1].split()
            cut = rng.randrange(0, max(1, len(part) - 13))
            w[len(w) // 2 : len(w) // 2] = part[cut:]
        values.append(" ".join(w).upper().replace("É", rng.choice("Éé")) if k % 5 == 0 else ", ".join(w))
    pattern = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    cut = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {}
    for d, t in enumerate(values):
        w, hit, found = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[d] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    rows = decontaminate.report(texts(spark, values), frame(spark, items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == want
    assert all(r["n_near"] >= r["n_items"] for r in rows)


# --- 6: chunks -------------------------------------------------------------------------------------------------------------


def test_chunks_cover_texts_and_resist_shifts():
    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh ij", k=4000))
    b = "inserted " + a[:1000] + "XX" + a[1000:]
    s = next(slices(pa.array([a, b, "", "c"])))
    owner, start, end = chunks.cuts(s, 5, 16, 2048)
    whole = bytes(s.data)
    parts = [[whole[x:y] for o, x, y in zip(owner, start, end, strict=True) if o == d] for d in range(4)]
    assert [b"".join(p).decode() for p in parts] == [a, b, "", "c"]
    shared = set(parts[0]) & set(parts[1])
    assert sum(map(len, shared)) > 3500


def test_gear_is_a_sum_over_the_last_bytes():
    data = np.frombuffer(random.Random(3).randbytes(200), np.uint8)
    want = [sum(int(chunks._GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 65536 for i in range(len(data))]
    assert chunks.gear(data).tolist() == want


def test_one_word_again_and_again_is_repeated(spark):
    """Texts of one period have no cut by top bits; their chunks fall in step whatever stands before."""
    heads = ["Some words stand here first.", "Another beginning, of another length, goes before it."]
    rows = chunks.repeats(texts(spark, [f"{h} {'Ort ' * 400}" for h in heads] + ["alone " * 3])).collect()
    assert {r["doc_id"] for r in rows if r["has_repeat"]} == {0, 1}


def test_repeated_passages(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(n))
    passage = fresh(60)
    values = [fresh(100), fresh(30) + " " + passage + " " + fresh(40), fresh(200), passage + " " + fresh(10), fresh(50), "a b"]
    rows = {r["doc_id"]: r for r in chunks.repeats(texts(spark, values)).collect()}
    assert {d for d, r in rows.items() if r["has_repeat"]} == {1, 3}
    assert rows[3]["first_doc_ids"] == [1] and rows[1]["removed"] == "" and rows[3]["removed"]
    a, b = map(int, rows[3]["removed"].split(",")[0].split(":"))
    assert values[3][a:b] in passage + " "


# --- 7, 10: patterns -------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t: str) -> list[tuple[str, int, int]]:
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (pii.BASE.index(x[0]), x[1]))


def test_pii_equals_patterns(docs):
    rng = random.Random(6)
    values = [r["text"] for r in docs.collect()]
    pieces = ["a", "b.c", "@", ".", "com", "-", "_", "1", "12", "255", "4111111111111111", " ", "+", "(", ")", "é", "+49 ", "4111 1111-1111 1111", "..", "@x.y"]
    values += ["".join(rng.choices(pieces, k=rng.randrange(1, 25))) for _ in range(4000)]
    for v in values:
        assert pii.spans(v)[0] == plain_pii(v), v


def test_pii_leading_zeros():
    assert pii.numbers(f"at {'0' * 30}1.2.3.4 or 1.2.3.0256 or 1.2.3.256")[:1] == [("ip", 3, 40)] and len(pii.numbers("1.2.3.0256 1.2.3.256")) == 0


def test_pii_more_kinds():
    kinds = lambda t: {(k, t[a:b]) for k, a, b in pii.spans(t)[1]}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("IBAN: DE89 3704 0044 0532 0130 00 ok")
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00") == set()
    assert ("account", "12345678") in kinds("account number: 12345678.") and ("ssn", "123-45-6789") in kinds("SSN 123-45-6789")
    assert ("address", "mailto:a@b.de") in kinds("see mailto:a@b.de.") and kinds("http://x.com/a plain accountable 5") == set()
    assert pii.masked("mail a@b.de now") == "mail [EMAIL] now"


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)


def plain_secrets(t: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out, key=lambda x: (x[0], secrets.BASE.index(x[2])))


def test_secrets_equal_patterns(docs):
    rng = random.Random(6)
    values = [r["text"] for r in docs.collect()]
    pieces = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x", "ſecret", "toKen"]
    values += ["".join(rng.choices(pieces, k=rng.randrange(1, 20))) for _ in range(4000)]
    for v in values:
        assert secrets.base_spans(v) == plain_secrets(v), v


def test_secret_parts_are_linked_by_scope():
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    assert len(key) == 40
    alone = f"key {key} end"
    assert secrets.spans(alone) == ([], [])
    pair = f"client_id: abcdef99 then {key} at https://api.example.com/v1 end"
    assert {k for _, _, k in secrets.spans(pair)[1]} == {"client", "key40", "url"}
    assert secrets.spans(pair.replace(" then", "\n\n"))[1] == [] and secrets.spans(pair.replace(" then", " x" * 500))[1] == []
    assert secrets.redact("token=abcdefgh1 ok") == "[SECRET] ok"


def test_repeated_rows_stay_once(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, long, "en", "s", 1), (2, long, "en", "s", 1), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (4, "other words", "en", "s", 1)]
    d = frame(spark, rows)
    assert sorted(r["doc_id"] for r in minhash.deduplicated(d).collect()) == [1, 3, 4] and minhash.deduplicated(d).columns == d.columns
    assert minhash.near_duplicates(d).count() == len(rows)


def test_long_secrets_link_parts_on_both_sides():
    token, client = "token: " + "eyJhbGci" * 75, "client_id: abc123"
    for text in (f"{token}\n{client}", f"{client}\n{token}"):
        assert [k for _, _, k in secrets.spans(text)[1]] == ["client"] and secrets.redact(text) == "[SECRET]\n[SECRET]"
    assert secrets.spans(f"{token}\n\n{client}")[1] == []
    for gap, want in ((400, 1), (401, 0)):
        assert [len(secrets.spans(x + " " * gap + y)[1]) for x, y in ((token, client), (client, token))] == [want, want]


# --- 8: packing ------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer_file(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    values = [r["text"] for r in docs.collect()] + ["", " ", "a  b\n\n c\t", "<|endoftext|> x", "don't 12 \U0001f600中文 é 　x\u0085y​z", "ǅ ½ ² ٣"]
    encode = packing.encoder()
    for v in values:
        assert encode(v).tolist() == exact.encode(v, add_special_tokens=False).ids


def test_packing_round_trip(spark, docs):
    encode = packing.encoder()
    rows = packing.pack(packing.pieces(docs), group_rows=64).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == text.keys()
    for d, parts in by_doc.items():
        ids = [*encode(text[d] or "").tolist(), 0]
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert r["piece"] == k and r["start"] == at and (k == 0 or r["length"] == 2048)
            assert zlib.crc32(np.asarray(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    seqs: dict[int, list] = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_local_search_empties_bins():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(200, 900, 300)
        start = packing.best_fit(lengths, 2048)
        bins = packing.improve([list(b) for b in start], lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(300)) and all(lengths[b].sum() <= 2048 for b in bins)
        assert len(bins) <= len(start)
    bad = [[0, 1], [2, 3], [4]]  # 5 + 3, 5 + 3, 4 of 10: moves and exchanges make two bins
    assert len(packing.improve(bad, np.asarray([5, 3, 5, 3, 4]), 10)) == 2


def test_repeats_without_blanks_are_found(spark):
    rng = random.Random(4)
    drawn = {name: ["".join(rng.choices(signs, k=400)) for _ in range(3)] for name, signs in {"han": [chr(c) for c in range(0x4E00, 0x5200)], "thai": [chr(c) for c in range(0xE01, 0xE2F)], "key": "ACGT0123456789abcdef"}.items()}
    for name, (one, two, own) in drawn.items():
        values = [one, f"x {own[:200]}{two}", f"y {two}{own[200:]}", one, own[:7]]
        got = {r["doc_id"]: r for r in chunks.repeats(texts(spark, values)).collect()}
        assert [got[i]["has_repeat"] for i in range(5)] == [True, True, True, True, False], name
        assert got[3]["removed"] == "0:400" and got[3]["first_doc_ids"] == [0] and got[0]["removed"] == "", name
    short = "".join(chr(0x4E00 + 7 * k) for k in range(30))
    assert not any(r["has_repeat"] for r in chunks.repeats(texts(spark, [short, short, "six plain words", "six plain words"])).collect())


# --- 9: embeddings ---------------------------------------------------------------------------------------------------------


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 48))
    y = embeddings.rotated(x, 1)
    assert y.shape == (5, 64) and np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)


def test_embedding_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 64))
    near = [b + rng.normal(size=64) * s for b in base[:40] for s in (0.02, 0.05, 0.2, 0.3)]
    x = np.concatenate([base, near, base[:7], base[:3] * 2.5])
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] * 64), (n + 3, [None] + [1.0] * 63), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(n))
    assert found <= link.sum() and found >= 0.97 * link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(n)) and got[0]["n_links"] >= 2
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(n, n + 5)) and got[n + 5]["n_links"] == 1 and got[n + 6]["component_id"] == n + 5
    assert all(r["kept"] == (v == r["component_id"]) for v, r in got.items())


@pytest.mark.parametrize(("width", "hashes"), [(64, 2), (64, 4), (64, 5), (256, 5)])
def test_embedding_recall_does_not_fall_with_hashes(spark, width, hashes):
    rng, n = np.random.default_rng(8), 400
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, n, width)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = embeddings.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>"), hashes=hashes)
    assert got.where("vec_id < 400 and n_links > 0").count() >= 0.99 * n


def test_tiles_count_each_pair_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(6, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = [np.asarray(k) for k in ([1, 5], [1, 5], [5], [5, 9], [5, 9], [9])]
    total = np.zeros(6)
    for bucket in (1, 5, 9):
        rows = [i for i, k in enumerate(keys) if bucket in k]
        links, _ = embeddings.tile_links(np.asarray(rows), np.ones(len(rows)), np.full(len(rows), 2), x[rows], [keys[i] for i in rows], bucket, 0.95)
        total[rows] += links
    want = [sum(bool(set(a) & set(b)) for j, b in enumerate(keys) if j != i) for i, a in enumerate(keys)]
    assert total.tolist() == want


# --- the registered queries and the pipeline -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", QUERIES)
def test_query_covers_its_table(spark, name):
    path = "/root/testdata/sf0.001"
    table = "embeddings" if name.startswith("op9") else "documents"
    key = "vec_id" if table == "embeddings" else "doc_id"
    got = {r[key] for r in QUERIES[name](spark, path).select(key).collect()}
    assert got == {r[key] for r in spark.read.parquet(f"{path}/{table}.parquet").select(key).collect()}


def test_pipeline(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
            before, docs = docs.count(), corpus_pipeline.materialise(out, name)
            seen.append((name, before, docs.count()))
    assert all(b >= a for _, b, a in seen) and seen[3][1] == seen[3][2]
    assert not any(secrets.base_spans(r["text"]) for r in docs.collect())
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
